import numpy as np
import pandas as pd

from docweave.operators import clusters
from test_trees import frame, tree_weights


def test_two_blocks_are_compared_once(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(clusters, "BLOCK", 10)
    monkeypatch.setattr(clusters, "WIDER", 4)
    log, real = tmp_path / "met", clusters.tree_between

    def between(mine, others, trees):
        with log.open("a") as f:
            f.write(f"{min(mine['item'].min(), others['item'].min())}:{max(mine['item'].min(), others['item'].min())}\n")
        return real(mine, others, trees)

    monkeypatch.setattr(clusters, "tree_between", between)
    x = np.random.default_rng(7).normal(size=(160, 24))
    x[40:60] = x[40]
    edges = clusters.spanning_trees(frame(spark, x), "pool").collect()
    met = log.read_text().split()
    assert len(edges) == len({(e.a, e.b) for e in edges}) == 159 and np.allclose(np.sort([e.d for e in edges]), tree_weights(x))
    assert len(met) == len(set(met)) > 0


def test_edges_between_blocks_and_their_trees_hold_the_tree_of_both():
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(size=(60, 3)), np.ones((30, 3)), rng.integers(0, 3, (60, 3))]).astype(float)
    items = rng.permutation(150)
    a, b = (pd.DataFrame({"item": items[s], "x": list(x[s])}) for s in (slice(0, 70), slice(70, None)))
    trees = pd.concat([clusters.block_tree(a), clusters.block_tree(b)])
    held = {tuple(r) for r in pd.concat([trees, clusters.tree_between(a, b, trees)]).itertuples(index=False)}
    whole = clusters.block_tree(pd.concat([a, b]))
    assert {tuple(r) for r in whole.itertuples(index=False)} <= held
    assert np.allclose(np.sort(whole["d"]), tree_weights(x))
