import numpy as np

from docweave.operators import similarity as S


def test_vectors_without_groups_do_not_travel_to_every_cell(spark, monkeypatch):
    monkeypatch.setattr(S, "PIVOT_ROWS", 10)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(600, 48))
    x[300:320] = x[5] + rng.normal(size=(20, 48)) * 0.02
    seen, cells = [], S.cells

    def counted(*args):
        seen.append(cells(*args).count())
        return cells(*args)

    monkeypatch.setattr(S, "cells", counted)
    frame = spark.createDataFrame([("k", str(i), i, v.tolist()) for i, v in enumerate(x)], "kg_id string, name string, ord int, vector array<double>")
    got = {(int(r.name), int(r.other)) for r in S.pairs_within(frame, ["kg_id"], 0.88).select("name", "other").collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    assert got == {(int(a), int(b)) for a, b in np.argwhere(u @ u.T >= 0.88) if b < a} and len(got) >= 190
    assert seen[0] <= S.MOST_COPIES * len(x)
