import math

import numpy as np
from oracle import TABLES, differences

import __spark_entry__ as entry
from docweave.operators import vector_index as VI

SCHEMA = "id long, vector array<double>"


def unit(*cosines):
    return [[c, math.sqrt(1 - c * c)] for c in cosines]


def test_rounded_scores_are_ranked_and_held_against_the_least(spark):
    """4 and 5 are equal when rounded, and 3 then reaches the least score, wherever their cells are."""
    items = spark.createDataFrame(list(enumerate(unit(0.9, 0.1, -0.5, 0.1999998, 0.4000001, 0.4000002))), SCHEMA)
    asked = spark.createDataFrame([(7, [1.0, 0.0])], SCHEMA)
    index = VI.VectorIndex.build(items, VI.temporary(spark))
    for probes in (None, 1):
        got = index.search_exact(asked, 4, probes=probes, min_score=0.2, digits=6).orderBy("rank").collect()
        assert [(r.item_id, r.score) for r in got] == [(0, 0.9), (4, 0.4), (5, 0.4), (3, 0.2)]
    assert [r.item_id for r in index.search_exact(asked, 4, min_score=0.2).orderBy("rank").collect()] == [0, 5, 4]


def test_ties_of_rounded_scores_are_found_in_all_cells_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(VI, "ITEM_BLOCK", 40)
    rng = np.random.default_rng(7)
    x = rng.normal(size=(12, 5))[np.arange(600) % 12] + rng.normal(size=(600, 5)) * 0.1
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], SCHEMA)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    cos = np.sign(c := u @ u.T) * np.floor(np.abs(c) * 100 + 0.5) / 100
    want = {(q, i, r + 1, cos[q, i]) for q in range(0, 600, 30) for r, i in enumerate(sorted(range(600), key=lambda i: (-cos[q, i], i))[:9])}
    index = VI.VectorIndex.build(frame, VI.temporary(spark))
    for probes in (None, 1):
        got = index.search_exact(frame.where("id % 30 = 0"), 9, probes=probes, digits=2).collect()
        assert {(r.query_id, r.item_id, r["rank"], r.score) for r in got} == want


def test_queries_rank_by_the_rounded_score(spark, tmp_path):
    """Items whose scores are equal in the sixth digit are in the order of their ids, as in SQL, though the later ones are nearer; where the hundred nearest end, this decides which are among them."""
    cosines = [1.0, 0.9, 0.9000002] + [0.5 + 1e-9 * i for i in range(137)]
    rows = [(i, v, int(i > 99)) for i, v in enumerate(unit(*cosines))]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    for t in set(TABLES) - {"embeddings"}:
        spark.range(1).coalesce(1).write.parquet(f"{tmp_path}/{t}.parquet")
    for name in ("vector_index_exact", "route_by_index"):
        assert differences(spark, str(tmp_path), entry.plans.QUERIES[name], entry.plans.ORACLE_SQL[name]) == [], name
