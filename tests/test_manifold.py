import numpy as np
import pytest

from docweave.operators import clusters, manifold


def kept(x, y, k=10):
    """Share of the k nearest in x that are among the k nearest in y."""
    near = lambda z: np.argsort(((z[:, None] - z[None]) ** 2).sum(2) + np.diag(np.full(len(z), np.inf)), axis=1)[:, :k]
    return np.mean([len(set(a) & set(b)) / k for a, b in zip(near(x), near(y), strict=True)])


def rolled(n, d=20, seed=1):
    """A sheet rolled up in space, which no flat projection can unroll."""
    rng = np.random.default_rng(seed)
    t = 1.5 * np.pi * (1 + 2 * rng.random(n))
    flat = np.column_stack([t * np.cos(t), 12 * rng.random(n), t * np.sin(t)])
    return np.concatenate([flat, rng.normal(size=(n, d - 3)) * 0.05], axis=1)


def axes_of(x, to):
    c = x - x.mean(0)
    return c @ np.linalg.svd(c, full_matrices=False)[2][:to].T


def points(spark, x, to=2):
    return spark.createDataFrame([("p", i, v.tolist(), a.tolist()) for i, (v, a) in enumerate(zip(x, axes_of(x, to), strict=True))], "pool string, item int, v array<double>, x array<double>")


def placed(found):
    return np.array([r.x for r in sorted(found.collect(), key=lambda r: r.item)])


def test_bandwidths_give_the_sum_they_should():
    d = np.sort(np.random.default_rng(1).random((50, 12)) + 0.1, axis=1)
    rho, sigma = manifold.bandwidths(d)
    assert np.allclose(rho, d[:, 0]) and np.allclose(np.exp(-(d - rho[:, None]) / sigma[:, None]).sum(1), np.log2(12), atol=1e-3)
    rho, sigma = manifold.bandwidths(np.zeros((2, 5)))  # copies
    assert (rho == 0).all() and (sigma > 0).all()


def test_neighbours_and_weights(spark):
    x = rolled(120)
    found = manifold.neighbours(points(spark, x), "pool", 6).collect()
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)) + np.diag(np.full(120, np.inf))
    own = {i: {r.other for r in found if r.item == i} for i in range(120)}
    assert all(own[i] == set(np.argsort(d[i], kind="stable")[:6]) for i in range(120))
    rows = manifold.graph_of(manifold.neighbours(points(spark, x), "pool", 6), "pool").collect()
    weights = {(r.item, r.other): r.w for r in rows}
    assert all(abs(weights[b, a] - w) < 1e-12 and 0 < w <= 1 + 1e-12 for (a, b), w in weights.items()) and {a for a, _ in weights} == set(range(120))


@pytest.mark.parametrize("block", [1000, 120])
def test_the_layout_keeps_neighbourhoods_and_reruns_agree(spark, monkeypatch, block):
    monkeypatch.setattr(clusters, "BLOCK", block)
    monkeypatch.setattr(manifold, "ROUNDS", 4)
    x = rolled(400)
    frame = points(spark, x)
    first = placed(manifold.layout(frame, "pool", rounds=4))
    assert kept(x, first) > kept(x, axes_of(x, 2)) + 0.1 and kept(x, first) > (0.6 if block == 1000 else 0.45)
    if block == 1000:
        assert np.allclose(first, placed(manifold.layout(frame.repartition(7), "pool", rounds=4)))


def test_clusters_after_the_layout(spark):
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(size=(30, 12)) * 0.2 + 6 * (np.arange(12) == k) for k in range(3)])
    rows = [("p", i, v.tolist()) for i, v in enumerate(x)] + [("small", i, [float(i), 0.0]) for i in range(4)] + [("p", 500, None)]
    got = {(r.pool, r.i): r.label for r in clusters.cluster_pool(spark.createDataFrame(rows, "pool string, i int, vector array<double>"), "pool", "i", reduce="manifold").collect()}
    groups = [{got["p", i] for i in range(a, a + 30) if got["p", i] >= 0} for a in (0, 30, 60)]
    assert all(groups) and not groups[0] & groups[1] and not groups[1] & groups[2] and not groups[0] & groups[2] and got["p", 500] == -1 and len(got) == 95
    with pytest.raises(ValueError, match="reduce must be"):
        clusters.cluster_pool(spark.createDataFrame(rows, "pool string, i int, vector array<double>"), "pool", "i", reduce="none")
