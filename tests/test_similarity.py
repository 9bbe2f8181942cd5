import math

import numpy as np
import pytest

from docweave.operators import similarity as S

SCHEMA = "kg_id string, entity_type string, name string, ord int, vector array<double>"


def clustered(n, seed, spread=0.25, d=12, groups=15):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(groups, d))
    return [("k", "t" if i % 5 else "u", f"n{i}", i % 97, (centers[i % groups] + rng.normal(size=d) * spread).tolist()) for i in range(n)]


def all_pairs(rows, least):
    out = {}
    live = [(r, np.array(r[4]) / np.linalg.norm(r[4])) for r in rows if r[4] is not None and np.linalg.norm(r[4]) >= 1e-9 and None not in r[:2]]
    for a, x in live:
        for b, y in live:
            if a[:2] == b[:2] and (b[3], b[2]) < (a[3], a[2]) and (c := float(x @ y)) >= least and c > 0:
                out[a[0], a[1], a[2], b[2], b[3]] = c
    return out


@pytest.mark.parametrize("least", [0.5, 0.75, 0.88, 0.999])
def test_pairs_equal_comparing_all(spark, monkeypatch, least):
    monkeypatch.setattr(S, "PIVOT_ROWS", 20)
    monkeypatch.setattr(S, "BLOCK", 30)
    rows = clustered(400, 1, 0.5) + [("k", "t", f"copy{i}", i, [1.0] * 12) for i in range(60)] + [("k", "t", "null", 1, None), ("k", "t", "zero", 1, [0.0] * 12), (None, "t", "x", 1, [1.0] * 12)]
    got = {tuple(r)[:5]: r.cosine for r in S.pairs_within(spark.createDataFrame(rows, SCHEMA), ["kg_id", "entity_type"], least).collect()}
    want = all_pairs(rows, least)
    assert got.keys() == want.keys() and all(abs(got[k] - v) < 1e-9 for k, v in want.items())
    assert S.pairs_within(spark.createDataFrame(rows[-3:-1], SCHEMA), ["kg_id", "entity_type"], least).count() == 0


def test_rows_travel_to_near_cells_only():
    rng = np.random.default_rng(2)
    x = np.array([r[4] for r in clustered(4000, 3, 0.2, groups=40)])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    pivots = x[rng.choice(len(x), 60, replace=False)]
    angle = math.acos(0.88)
    own, near = S.near_cells(x, pivots, angle)
    assert near.sum(1).mean() < 30  # of 60 cells
    close = x @ x.T >= 0.88
    a, b = np.nonzero(close)
    assert near[b, own[a]].all()  # no partner is missed
    met = np.array([near[:, c].sum() for c in own]).sum()
    assert met < 0.4 * len(x) ** 2
