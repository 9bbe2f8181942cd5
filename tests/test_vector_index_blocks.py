import pytest

from docweave.operators import vector_index as VI
from test_vector_index import SCHEMA, brute, clustered, listed


def test_a_query_gets_k_items_of_a_block_not_of_a_cell(spark):
    rows = clustered(900)
    frame = spark.createDataFrame(rows, SCHEMA)
    index = VI.VectorIndex.build(frame, VI.temporary(spark))
    asked = frame.where("id % 100 = 0")
    cells = len(index.model.centroids)
    assert cells == 30
    found = index._compared(index._probes(asked, cells), 5, "vector").groupBy("query").count().collect()
    assert len(found) == 9 and {r["count"] for r in found} == {5}


@pytest.mark.parametrize("block", [7, 50, 250, 16_384])
def test_blocks_hold_their_rows_and_every_item_meets_its_queries(spark, monkeypatch, block):
    monkeypatch.setattr(VI, "ITEM_BLOCK", block)
    monkeypatch.setattr(VI, "TILE", 4)
    rows = clustered(500)
    rows += [(1000 + i, rows[3][1]) for i in range(120)]
    index = VI.VectorIndex.build(spark.createDataFrame(rows, SCHEMA), VI.temporary(spark))
    first, parts = index._blocks()
    counts = {r["cell"]: r["count"] for r in index.items().groupBy("cell").count().collect()}
    filled = {}
    for cell, n in counts.items():
        assert parts[cell] == -(-n // block)
        filled.setdefault(first[cell], []).append(n)
    assert all(sum(v) <= block or len(v) == 1 for v in filled.values())
    assert sum(parts[c] for c in counts if parts[c] > 1) + sum(1 for v in filled.values() if len(v) > 1 or v[0] <= block) == max(first + parts)
    asked = [(i, v) for i, v in rows if i % 50 == 0]
    assert listed(index.search_exact(spark.createDataFrame(asked, SCHEMA), 6, probes=2)) == brute(rows, asked, 6)
