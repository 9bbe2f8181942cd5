import numpy as np

from docweave.operators import clusters


def tree_weights(x):
    """Lengths of the edges of the minimum spanning tree, point by point."""
    best, left, at, out = np.full(len(x), np.inf), np.ones(len(x), bool), 0, []
    for _ in range(len(x) - 1):
        left[at] = False
        best = np.minimum(best, np.sqrt(((x - x[at]) ** 2).sum(1)))
        at = int(np.where(left, best, np.inf).argmin())
        out.append(best[at])
    return np.sort(out)


def frame(spark, x, pool="p"):
    return spark.createDataFrame([(pool, i, v.tolist()) for i, v in enumerate(x)], "pool string, item int, x array<double>")


def test_distances_are_the_same_from_both_sides():
    rng = np.random.default_rng(5)
    for d in (2, 9, 64):
        x, y = rng.normal(size=(301, d)), rng.normal(size=(57, d))
        assert (clusters.distances_of(x, y) == clusters.distances_of(y, x).T).all()
        assert np.allclose(clusters.distances_of(x, y), np.linalg.norm(x[:, None] - y[None], axis=2))


def test_trees_of_many_dimensions_have_no_edge_twice(spark):
    x = np.random.default_rng(6).normal(size=(150, 64))
    edges = clusters.spanning_trees(frame(spark, x), "pool").collect()
    assert len(edges) == len({(e.a, e.b) for e in edges}) == 149 and np.allclose(np.sort([e.d for e in edges]), tree_weights(x))


def test_blocks_are_parts_of_space_whatever_the_points(spark, monkeypatch):
    monkeypatch.setattr(clusters, "BLOCK", 40)
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(size=(500, 3)), np.ones((200, 3)), np.full((1, 3), 50.0)])
    blocks = clusters.space_blocks(frame(spark, x), "pool")
    sizes = [r["count"] for r in blocks.groupBy("block").count().collect()]
    assert sum(sizes) == 701 and max(sizes) <= 80
    bounds = clusters.block_distances(blocks, "pool").collect()
    where = {r.item: r.block for r in blocks.collect()}
    at = {}
    for i, b in where.items():
        at.setdefault(b, []).append(x[i])
    for r in bounds[:: max(1, len(bounds) // 60)]:
        d = np.sqrt(((np.array(at[r.i])[:, None] - np.array(at[r.j])[None]) ** 2).sum(2))
        assert r.least <= d.min() + 1e-9 and d.max() <= r.most + 1e-9


def test_most_block_pairs_are_never_compared_and_the_tree_is_the_same(spark, monkeypatch):
    monkeypatch.setattr(clusters, "BLOCK", 20)
    rng, real, met, every = np.random.default_rng(3), clusters.block_pairs, [], []
    x = rng.normal(size=(600, 2)) * 0.15 + rng.integers(0, 4, (600, 2))
    x[:75] = x[0]  # copies

    def counted(placed, inside, distances, pool):
        pairs = real(placed, inside, distances, pool)
        met.append(pairs.count())
        every.append(distances.count() if met[-1] else 0)
        return pairs

    monkeypatch.setattr(clusters, "block_pairs", counted)
    edges = clusters.spanning_trees(frame(spark, x), "pool").collect()
    assert len(edges) == 599 and np.allclose(np.sort([e.d for e in edges]), tree_weights(x))
    assert sum(met) < 0.3 * sum(every), (met, every)
