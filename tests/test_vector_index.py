import numpy as np
import pytest
from pyspark.sql import functions as F

from docweave.operators import classify
from docweave.operators import vector_index as VI

SCHEMA = "id long, vector array<double>"


def clustered(n, groups=12, d=16, seed=1, spread=0.35):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(groups, d))
    return [(i, (centers[i % groups] + rng.normal(size=d) * spread).tolist()) for i in range(n)]


def brute(rows, queries, k):
    live = [(i, np.array(v) / np.linalg.norm(v)) for i, v in rows if v is not None and np.linalg.norm(v) >= 1e-9]
    out = {}
    for q, v in queries:
        if v is not None and np.linalg.norm(v) >= 1e-9:
            u = np.array(v) / np.linalg.norm(v)
            out[q] = [i for _, i in sorted((-round(float(u @ w), 12), i) for i, w in live)[:k]]
    return out


def listed(found):
    out = {}
    for r in found.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append(r.item_id)
    return out


@pytest.fixture
def odd():
    rows = clustered(600)
    rows += [(1000 + i, rows[5][1]) for i in range(300)]  # a third of all are copies
    return rows + [(2000, None), (2001, [0.0] * 16)]


@pytest.mark.parametrize("blocks", [(16_384, 2_048), (40, 3)])
def test_exact_search_equals_brute_force(spark, odd, monkeypatch, blocks):
    monkeypatch.setattr(VI, "ITEM_BLOCK", blocks[0])
    monkeypatch.setattr(VI, "QUERY_BLOCK", blocks[1])
    frame = spark.createDataFrame(odd, SCHEMA)
    index = VI.VectorIndex.build(frame, VI.temporary(spark))
    asked = [(i, v) for i, v in odd if i % 50 == 0 or i == 2001]
    assert listed(index.search_exact(spark.createDataFrame(asked, SCHEMA), 7)) == brute(odd, asked, 7)
    assert index.search_exact(frame.limit(0), 7).count() == 0


def test_few_cells_hold_the_neighbours_of_clustered_vectors(spark):
    rows = clustered(3000, groups=30)
    frame = spark.createDataFrame(rows, SCHEMA)
    index = VI.VectorIndex.build(frame, VI.temporary(spark))
    assert index.model.probes <= 0.2 * len(index.model.centroids)
    asked = frame.where("id % 100 = 0")
    exact = classify.nearest(asked.withColumnRenamed("id", "query_id"), frame.withColumnRenamed("id", "item_id"), 10)
    found = index.search(asked, 10)
    assert VI.recall(found, exact).first().recall >= 0.9
    scores = found.join(exact.withColumnRenamed("score", "true").drop("rank"), ["query_id", "item_id"])
    assert scores.where(F.abs(F.col("score") - F.col("true")) > 1e-9).count() == 0
    # cells that can't hold a better item aren't read: one probe and the bounds are enough
    assert listed(index.search_exact(asked, 10, probes=1)) == listed(exact)


def test_codes_are_near_their_vectors():
    rows = VI.unit_rows(np.array([v for _, v in clustered(500)]))
    model = VI.Model.fit(rows, 20)
    cells, angles, codes = model.encode(rows)
    back = np.stack([model.decode(c, x) for c, x in zip(cells, codes, strict=True)])
    assert np.linalg.norm(back - rows, axis=1).max() < 0.1 and np.abs(np.cos(angles) - (rows * model.centroids[cells]).sum(1)).max() < 1e-9


def test_changed_rows_join_their_cells(spark):
    rows = clustered(400)
    index = VI.VectorIndex.build(spark.createDataFrame(rows, SCHEMA), VI.temporary(spark))
    now = dict(rows)
    for step in range(2):
        changes = {i: now[(i + 1) % 400] for i in range(step, 400, 9)} | {500 + step: now[3]} | {7 + step: None}
        index.upsert(spark.createDataFrame(list(changes.items()), SCHEMA))
        now |= changes
        asked = [(i, v) for i, v in now.items() if i % 40 == 0]
        want = brute(list(now.items()), asked, 6)
        assert listed(index.search_exact(spark.createDataFrame(asked, SCHEMA), 6)) == want
        assert {r.id for r in index.items().collect()} == {i for i, v in now.items() if v is not None}
    small = index.compact()
    assert listed(small.search_exact(spark.createDataFrame(asked, SCHEMA), 6)) == want and len(small._segments()) == 1
    # a segment that wasn't finished doesn't count
    spark.createDataFrame([(0, 1)], "id long, x int").write.parquet(f"{small.path}/items/segment=000001")
    fs = spark._jvm.org.apache.hadoop.fs
    done = fs.Path(f"{small.path}/items/segment=000001/_SUCCESS")
    done.getFileSystem(spark._jsc.hadoopConfiguration()).delete(done, False)
    assert small._segments() == [0]


def test_an_empty_index_finds_nothing(spark):
    none = spark.createDataFrame([(1, None)], SCHEMA)
    index = VI.VectorIndex.build(none, VI.temporary(spark))
    asked = spark.createDataFrame([(1, [1.0, 0.0])], SCHEMA)
    assert index.search(asked, 3).count() == 0 and index.search_exact(asked, 3).count() == 0


def test_a_search_reads_the_cells_it_probes(spark):
    index = VI.VectorIndex.build(spark.createDataFrame(clustered(500), SCHEMA), VI.temporary(spark))
    plan = index.items([1, 2], "code")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [cell" in plan.replace("isnotnull(cell", "").replace("PartitionFilters: [(cell", "PartitionFilters: [cell") and "vector" not in plan.split("ReadSchema")[1]


def test_routing(spark):
    found = spark.createDataFrame([(1, 10, 0.9), (1, 11, 0.5), (1, 12, 0.01), (2, 13, 0.02)], "query_id int, item_id int, score double")
    member = spark.createDataFrame([(10, "a"), (11, "a"), (11, "b"), (12, "c"), (13, "a")], "item_id int, kg_id string")
    assert [tuple(r) for r in classify.route(found, member).orderBy("rank").collect()] == [(1, "a", 0.7, 1), (1, "b", 0.5, 2)]
