import math

import numpy as np

from docweave.operators import classify


def unit(*cosines):
    return [[c, math.sqrt(1 - c * c)] for c in cosines]


def test_rounded_scores_are_ranked_and_held_against_the_least(spark):
    """4 and 5 are equal when rounded, and 3 then reaches the least score."""
    items = spark.createDataFrame(list(enumerate(unit(0.9, 0.1, -0.5, 0.1999998, 0.4000001, 0.4000002))), "item_id long, vector array<double>")
    asked = spark.createDataFrame([(7, [1.0, 0.0])], "query_id long, vector array<double>")
    got = classify.nearest(asked, items, 4, min_score=0.2, digits=6).orderBy("rank").collect()
    assert [(r.item_id, r.score) for r in got] == [(0, 0.9), (4, 0.4), (5, 0.4), (3, 0.2)]
    assert [r.item_id for r in classify.nearest(asked, items, 4, min_score=0.2).orderBy("rank").collect()] == [0, 5, 4]


def test_search_in_blocks_is_that_of_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(classify, "QUERY_BLOCK", 3)
    monkeypatch.setattr(classify, "ITEM_BLOCK", 20)
    rng = np.random.default_rng(5)
    x = rng.normal(size=(90, 6))
    x[30:60] = x[3]  # copies: ties by item
    x[70] = 0
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(90, None), (91, [1.0, None])], "id long, vector array<double>")
    got = classify.nearest(frame.where("id % 10 = 0 or id > 89").withColumnRenamed("id", "query_id"), frame.withColumnRenamed("id", "item_id"), 7)
    assert "CartesianProduct" not in (plan := got._jdf.queryExecution().toString()) and "BroadcastNestedLoopJoin" not in plan
    size = np.linalg.norm(x, axis=1)
    cos = np.where(np.outer(size, size) < 1e-9, 0, (x @ x.T) / np.maximum(np.outer(size, size), 1e-9))
    want = {(q, i, r + 1) for q in range(0, 90, 10) for r, i in enumerate(sorted(range(90), key=lambda i: (-round(cos[q, i], 9), i))[:7])}
    assert {(r.query_id, r.item_id, r["rank"]) for r in got.collect()} == want
