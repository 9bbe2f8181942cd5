"""Reduction of vectors by a layout of their neighbour graph.

Every point has its nearest neighbours as edges, with weights that fall off from the nearest one at a rate that suits the density around it; an edge counts as far as either end says so (a fuzzy
union). The layout begins at the principal components and follows, in epochs, the sampled gradients of attraction along edges and of repulsion from other
points, as in uniform manifold approximation (McInnes and others, 2018). Random draws depend on a seed, the block and the round alone.

Neighbours are searched in the blocks of space around a block. The layout moves all blocks of points at once, each holding the other ends of its edges as they
were, and meets again after a round; a pool of one block needs a single round. No group holds more than a block, its edges and their ends.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docweave.lineage import cut
from docweave.operators import clusters

#: Neighbours of a point, blocks of space in which they are searched, and negative draws for each edge that is drawn.
NEIGHBOURS, AROUND, DRAWS = 15, 8, 5
#: Epochs in all, and rounds for pools of several blocks.
EPOCHS, ROUNDS = 200, 10
#: The curve of attraction for a least distance of 0.1 and a spread of 1 (fixed values of the published method).
A, B = 1.577, 0.895
SEED = 42


def bandwidths(distances: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """rho (the nearest distance above 0) and sigma of each row of distances to neighbours: the weights exp(-(d - rho) / sigma) add up to log2 of their number."""
    rho = np.where(distances > 0, distances, np.inf).min(1)
    rho[~np.isfinite(rho)] = 0.0
    over = np.maximum(distances - rho[:, None], 0)
    target = np.log2(max(2, distances.shape[1]))
    low, high = np.zeros(len(over)), np.full(len(over), np.inf)
    sigma = np.ones(len(over))
    for _ in range(64):
        sums = np.exp(-over / sigma[:, None]).sum(1)
        high = np.where(sums > target, sigma, high)
        low = np.where(sums > target, low, sigma)
        sigma = np.where(np.isfinite(high), (low + high) / 2, sigma * 2)
    least = 1e-3 * np.maximum(distances.mean(1), 1e-12)
    return rho, np.maximum(sigma, least)


def neighbours(points: DataFrame, pool: str, k: int = NEIGHBOURS) -> DataFrame:
    """pool, item, other and d: the k nearest others of each point, as far as they are in the AROUND blocks nearest to its own (for pools of no more blocks: exactly), ties by item.
    points: pool, item, v (the vector), x (where it is in space, of a few dimensions)."""
    kind = {c: points.schema[c].dataType.simpleString() for c in (pool, "item")}
    placed = cut(clusters.space_blocks(points.select(pool, "item", "x"), pool).select(pool, "item", "block").join(points.select(pool, "item", "v"), [pool, "item"]), "placed")
    own = placed.select(pool, F.col("block").alias("i")).distinct().select(pool, "i", F.col("i").alias("j"), F.lit(-1.0).alias("least"))
    far = clusters.block_distances(clusters.space_blocks(points, pool), pool).select(pool, "i", "j", "least").unionByName(own)
    near = far.withColumn("r", F.row_number().over(Window.partitionBy(pool, "i").orderBy("least", "j"))).where(F.col("r") <= AROUND).select(pool, "i", "j")
    near = cut(near, "near")
    mine = near.join(placed.withColumnRenamed("block", "i"), [pool, "i"]).select(pool, "i", "j", "item", "v")
    others = near.join(placed.withColumnRenamed("block", "j"), [pool, "j"]).select(pool, "i", "j", "item", "v").toDF("o_pool", "o_i", "o_j", "o_item", "o_v")

    def search(key: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        a, b = a.sort_values("item"), b.sort_values("o_item")
        x, y = np.stack(a["v"].to_numpy()), np.stack(b["o_v"].to_numpy())
        d = np.sqrt(np.maximum(0, (x * x).sum(1)[:, None] + (y * y).sum(1) - 2 * x @ y.T))
        ai, bi = a["item"].to_numpy(), b["o_item"].to_numpy()
        d[ai[:, None] == bi[None]] = np.inf
        n = min(k, len(bi))
        at = np.argsort(d, axis=1, kind="stable")[:, :n]
        out = pd.DataFrame({"item": np.repeat(ai, n), "other": bi[at.ravel()], "d": np.take_along_axis(d, at, 1).ravel()})
        out = out[np.isfinite(out["d"])]
        return out.assign(**{pool: key[0]})[[pool, "item", "other", "d"]]

    found = mine.groupBy(pool, "i", "j").cogroup(others.groupBy("o_pool", "o_i", "o_j")).applyInPandas(search, f"{pool} {kind[pool]}, item {kind['item']}, other {kind['item']}, d double")
    rank = F.row_number().over(Window.partitionBy(pool, "item").orderBy("d", "other"))
    return found.withColumn("r", rank).where(F.col("r") <= k).drop("r")


def graph_of(found: DataFrame, pool: str) -> DataFrame:
    """pool, item, other and w: the fuzzy union of the edges of neighbours(), in both directions."""
    kind = {c: found.schema[c].dataType.simpleString() for c in (pool, "item")}
    lists = found.groupBy(pool, "item").agg(F.sort_array(F.collect_list(F.struct("d", "other"))).alias("near"))

    def run(frames):
        for f in frames:
            out = []
            for p, item, near in zip(f[pool], f["item"], f["near"], strict=True):
                d = np.array([[n["d"] for n in near]])
                rho, sigma = bandwidths(d)
                out += [(p, item, n["other"], float(w)) for n, w in zip(near, np.exp(-np.maximum(d[0] - rho[0], 0) / sigma[0]), strict=True)]
            yield pd.DataFrame(out, columns=[pool, "item", "other", "w"])

    one = lists.mapInPandas(run, f"{pool} {kind[pool]}, item {kind['item']}, other {kind['item']}, w double")
    both = one.unionByName(one.select(pool, F.col("other").alias("item"), F.col("item").alias("other"), "w"))
    # a pair that both ends name comes twice in each direction
    return both.groupBy(pool, "item", "other").agg(F.max("w").alias("a"), F.min("w").alias("b"), F.count("*").alias("n")).select(pool, "item", "other", F.when(F.col("n") > 1, F.col("a") + F.col("b") - F.col("a") * F.col("b")).otherwise(F.col("a")).alias("w"))


def moved(x: np.ndarray, fixed: np.ndarray, head: np.ndarray, tail: np.ndarray, w: np.ndarray, first: int, last: int, total: int, rng: np.random.Generator) -> np.ndarray:
    """x after the epochs first to last of total. head: rows of x; tail: rows of x, then of `fixed`, which doesn't move. An edge is drawn in an epoch with the chance of its weight."""
    x = x.copy()
    for epoch in range(first, last):
        rate = 1 - epoch / total
        drawn = np.flatnonzero(rng.random(len(w)) < w)
        if not len(drawn):
            continue
        every = np.concatenate([x, fixed]) if len(fixed) else x
        h, t = head[drawn], tail[drawn]
        apart = x[h] - every[t]
        d2 = (apart * apart).sum(1)
        pull = np.where(d2 > 0, -2 * A * B * np.maximum(d2, 1e-12) ** (B - 1) / (1 + A * d2**B), 0)
        step = np.zeros_like(x)
        np.add.at(step, h, np.clip(pull[:, None] * apart, -4, 4))
        h = np.repeat(h, DRAWS)
        t = rng.integers(0, len(every), len(h))
        apart = x[h] - every[t]
        d2 = (apart * apart).sum(1)
        push = np.where(d2 > 0, 2 * B / ((0.001 + d2) * (1 + A * d2**B)), 0)
        np.add.at(step, h, np.clip(push[:, None] * apart, -4, 4))
        x += rate * np.clip(step, -4, 4)
    return x


def _mover(pool: str, first: int, last: int, epochs: int, r: int, seed: int):
    """One round of a block: its points move, the other ends of its edges stay where they were."""

    def step(key: tuple, own: pd.DataFrame, links: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("item").reset_index(drop=True)
        x = np.stack(own["x"].to_numpy())
        if len(links):
            links = links.sort_values(["l_item", "l_other"])
            number = {v: i for i, v in enumerate(own["item"])}
            outside = links.loc[~links["l_other"].isin(number), ["l_other", "l_y"]].drop_duplicates("l_other")
            ghosts = {v: len(own) + i for i, v in enumerate(outside["l_other"])}
            fixed = np.stack(outside["l_y"].to_numpy()) if len(outside) else np.zeros((0, x.shape[1]))
            head, tail = links["l_item"].map(number).to_numpy(), links["l_other"].map(number | ghosts).to_numpy()
            draws = np.random.default_rng([seed, r, *str(key).encode()])
            x = moved(x, fixed, head, tail, links["l_w"].to_numpy(), first, last, epochs, draws)
        return pd.DataFrame({pool: [key[0]] * len(own), "item": own["item"], "x": list(x)})

    return step


def layout(points: DataFrame, pool: str, k: int = NEIGHBOURS, epochs: int = EPOCHS, rounds: int = ROUNDS, seed: int = SEED) -> DataFrame:
    """pool, item and x, the place of each point. points: pool, item, v, and x, its leading principal components, at which the layout begins. Points without neighbours stay there."""
    kind = {c: points.schema[c].dataType.simpleString() for c in (pool, "item")}
    edges = cut(graph_of(neighbours(points, pool, k), pool), "graph")
    reach = points.select(pool, F.array_max(F.transform("x", F.abs)).alias("m")).groupBy(pool).agg(F.max("m").alias("m"))
    begun = points.join(reach, pool).select(pool, "item", F.transform("x", lambda v: F.when(F.col("m") > 0, v * 10 / F.col("m")).otherwise(0.0)).alias("x"))
    blocks = cut(clusters.space_blocks(begun, pool), "blocks")
    if blocks.groupBy(pool).agg(F.countDistinct("block").alias("n")).where("n > 1").isEmpty():
        rounds = 1  # nothing to meet
    where, at = blocks.select(pool, "item", "block"), blocks.select(pool, "item", "x")
    ends = cut(edges.join(where, [pool, "item"]), "ends")
    for r in range(rounds):
        first, last = epochs * r // rounds, epochs * (r + 1) // rounds
        here = at.join(where, [pool, "item"])
        told = ends.join(at.select(pool, F.col("item").alias("other"), "x"), [pool, "other"]).select(pool, "block", "item", "other", "w", F.col("x").alias("y"))

        links = told.toDF("l_pool", "l_block", "l_item", "l_other", "l_w", "l_y")
        at = cut(here.groupBy(pool, "block").cogroup(links.groupBy("l_pool", "l_block")).applyInPandas(_mover(pool, first, last, epochs, r, seed), f"{pool} {kind[pool]}, item {kind['item']}, x array<double>"), "layout")
    return at
