"""Density clusters of pooled documents.

With one neighbour as core size, mutual reachability is the plain distance, and the
hierarchy is that of single linkage: the minimum spanning tree, condensed at a least cluster size, cut by
excess of mass. From `reduce_from` points on, vectors are first reduced, by principal components or by a layout
of their neighbour graph (manifold.py); labels there are our own, as random draws differ between tools.

Means and covariances are summed in the tasks. The spanning tree grows in rounds, each of which finds every component's
nearest neighbour outside it and joins the components. Points are in blocks of space; bounds on how near two blocks can be
leave most of them uncompared, and two blocks are compared once: what a later round can need of them are the edges of their own
tree. Only the tree, one edge a point, comes together for the labels.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docweave.config import DEFAULTS
from docweave.lineage import cut

#: Points of a pool that are held against as many others in one task.
BLOCK = 1000
#: From this many dimensions on bounds leave few blocks of space uncompared, and blocks for spanning trees hold this many times BLOCK.
FLAT, WIDER = 16, 3
#: Distances that are worked out at once, as a square of this side.
SIDE = 256


def tree_labels(n: int, tree: np.ndarray, least: int = DEFAULTS.cluster_min_size) -> np.ndarray:
    """A label for each of n points, -1 for noise, from the (a, b, distance) rows of their minimum spanning tree, in order of distance."""
    if n < least:
        return np.full(n, -1)
    # single linkage: node n + k joins two nodes at a distance
    parent, size, top = list(range(n)), [1] * n + [0] * (n - 1), list(range(n))
    children, height = {}, {}

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for k, (a, b, d) in enumerate(tree):
        x1, x2 = find(int(a)), find(int(b))
        node = n + k
        children[node], height[node], size[node] = (top[x1], top[x2]), d, size[top[x1]] + size[top[x2]]
        parent[x2], top[x1] = x1, node
    root = n + len(tree) - 1
    points: dict[int, list[tuple[int, float]]] = {0: []}  # cluster -> (point, density at which it leaves)
    born, kids, stack = {0: 0.0}, {0: []}, [(root, 0)]

    def leaves(node: int) -> list[int]:
        out, todo = [], [node]
        while todo:
            v = todo.pop()
            todo.extend(children[v]) if v >= n else out.append(v)
        return out

    while stack:
        node, cluster = stack.pop()
        if node < n:
            points[cluster].append((node, np.inf))
            continue
        density = 1 / height[node] if height[node] > 0 else 1e12
        big = [c for c in children[node] if size[c] >= least]
        if len(big) == 2:
            for c in big:
                new = len(born)
                born[new], points[new], kids[new] = density, [], []
                kids[cluster].append(new)
                stack.append((c, new))
        else:
            for c in children[node]:
                if c in big:
                    stack.append((c, cluster))
                else:
                    points[cluster] += [(p, density) for p in leaves(c)]
    weight: dict[int, float] = {}
    members = {}
    for c in sorted(born, reverse=True):
        members[c] = [p for p, _ in points[c]] + [p for k in kids[c] for p in members[k]]
        ends = [min(d, 1e12) for _, d in points[c]] + [born[k] for k in kids[c] for _ in members[k]]
        weight[c] = sum(e - born[c] for e in ends)
    chosen: dict[int, bool] = {}
    for c in sorted(born, reverse=True):
        below = sum(weight[k] for k in kids[c])
        chosen[c] = not kids[c] or weight[c] >= below
        weight[c] = max(weight[c], below)
    labels, todo, label = np.full(n, -1), [0], 0
    while todo:
        c = todo.pop(0)
        if chosen[c]:
            if c == 0:  # the only cluster: points that leave before its densest part are noise
                ends = dict(points[0]) | {p: np.inf for k in kids[0] for p in members[k]}
                cut = max((min(d, 1e12) for _, d in points[0]), default=np.inf) if not kids[0] else min(born[k] for k in kids[0])
                labels[[p for p, d in ends.items() if d >= cut]] = label
            else:
                labels[members[c]] = label
            label += 1
        else:
            todo += kids[c]
    return labels


def principal_axes(rows: DataFrame, pool: str, vector: str = "vector") -> DataFrame:
    """pool, mean and axes (the leading eigenvectors of its covariance, signs fixed by the largest entry) of each pool with `reduce_from` vectors and more.

    Tasks add up counts, sums and products first, one row for each pool they meet.
    """
    kind = rows.schema[pool].dataType.simpleString()
    schema = f"{pool} {kind}, n long, s array<double>, ss array<double>"

    def partial(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for key, g in f.groupby(pool, dropna=False, sort=False):
                x = np.stack([np.asarray(v, float) for v in g[vector]])
                out.append((key, len(x), x.sum(0), (x.T @ x).ravel()))
            yield pd.DataFrame(out, columns=[pool, "n", "s", "ss"])

    def axes(g: pd.DataFrame) -> pd.DataFrame:
        n = int(g["n"].sum())
        mean = np.sum(np.stack(g["s"]), 0) / n
        square = np.sum(np.stack(g["ss"]), 0).reshape(len(mean), -1) / n - np.outer(mean, mean)
        values, v = np.linalg.eigh(square)
        v = v[:, np.argsort(-values, kind="stable")[: min(DEFAULTS.reduce_to, n - 2)]].T
        v = v * np.sign(v[np.arange(len(v)), np.abs(v).argmax(1)])[:, None]
        return pd.DataFrame({pool: g[pool].iloc[:1], "mean": [mean], "axes": [v.tolist()]})[: int(n >= DEFAULTS.reduce_from)]

    sums = rows.where(F.col(vector).isNotNull()).select(pool, vector).mapInPandas(partial, schema)
    return sums.groupBy(pool).applyInPandas(axes, f"{pool} {kind}, mean array<double>, axes array<array<double>>")


def distances_of(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Distances of all rows of x to all of y. They are the same to the last bit whichever side a row is on and whatever rows are beside it, as squares are added up dimension by
    dimension: components must agree on which edge is shorter."""
    out = np.zeros((len(x), len(y)))
    xs, ys = np.ascontiguousarray(x.T), np.ascontiguousarray(y.T)
    for i in range(0, len(x), SIDE):
        for j in range(0, len(y), SIDE):
            total = np.zeros((len(x[i : i + SIDE]), len(y[j : j + SIDE])))
            part = np.empty_like(total)
            for u, v in zip(xs[:, i : i + SIDE], ys[:, j : j + SIDE], strict=True):
                np.subtract(u[:, None], v[None], out=part)
                np.multiply(part, part, out=part)
                total += part
            np.sqrt(total, out=out[i : i + SIDE, j : j + SIDE])
    return out


def grown_tree(rank: np.ndarray, rows: Callable[[int], list[tuple[np.ndarray | slice, np.ndarray]]]) -> list[tuple[float, int, int]]:
    """(d, a, b) of the minimum spanning tree of nodes in the order of d and the ranks of its ends, the smaller first; grown node by node. rank: of each node; rows(i): nodes next to i and their distances."""
    n = len(rank)
    names = np.arange(n)
    best, open_ = np.full(n, np.inf), np.full(n, np.inf)  # of nodes in the tree -inf, so that nothing is better, and inf, so that they aren't chosen
    towards, out, at = np.zeros(n, np.int64), [], 0
    key = lambda i, j: np.minimum(rank[i], rank[j]) * n + np.maximum(rank[i], rank[j])
    for _ in range(n - 1):
        best[at], open_[at] = -np.inf, np.inf
        for where, d in rows(at):
            old, mine = best[where], names[where]
            hit = mine[less] if (less := d < old).any() else mine[:0]
            best[hit] = open_[hit] = d[less]
            towards[hit] = at
            if (same := d == old).any():
                tied = mine[same]
                towards[tied[key(tied, at) < key(tied, towards[tied])]] = at
        nearest = int(open_.argmin())
        low = open_[nearest]
        ties = np.flatnonzero(open_ == low)
        if len(ties) > 1:
            nearest = int(ties[key(ties, towards[ties]).argmin()])
        at, end = nearest, int(towards[nearest])
        out.append((float(low), *sorted((at, end), key=lambda i: rank[i])))
    return out


def block_tree(g: pd.DataFrame) -> pd.DataFrame:
    """d, a and b, a < b, of the minimum spanning tree of the points of one block (item, x)."""
    g = g.sort_values("item")
    items, x = g["item"].to_numpy(), np.stack(g["x"].to_numpy())
    d = distances_of(x, x)
    tree = grown_tree(np.arange(len(x)), lambda i: [(slice(None), d[i])])
    return pd.DataFrame([(w, items[a], items[b]) for w, a, b in tree], columns=["d", "a", "b"])


def tree_between(mine: pd.DataFrame, others: pd.DataFrame, trees: pd.DataFrame) -> pd.DataFrame:
    """d, a and b, a < b, of those edges of the minimum spanning tree of two blocks' points (item, x) that go from one to the other. trees: (a, b, d) of the edges of the blocks' own trees,
    which with the edges between the blocks hold the tree of both."""
    mine, others = mine.sort_values("item"), others.sort_values("item")
    items, half = np.concatenate([mine["item"].to_numpy(), others["item"].to_numpy()]), len(mine)
    n, order = len(items), np.argsort(items, kind="stable")
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    d = distances_of(np.stack(mine["x"].to_numpy()), np.stack(others["x"].to_numpy()))
    back = np.ascontiguousarray(d.T)
    ends = order[np.searchsorted(items[order], np.concatenate([trees["a"].to_numpy(), trees["b"].to_numpy()]))]
    far, long, by = np.roll(ends, len(trees)), np.tile(trees["d"].to_numpy(), 2), np.argsort(ends, kind="stable")
    begin, far, long = np.searchsorted(ends[by], np.arange(n + 1)), far[by], long[by]
    left, right = slice(0, half), slice(half, n)

    def rows(i: int) -> list:
        own = slice(begin[i], begin[i + 1])
        return [(right, d[i]) if i < half else (left, back[i - half]), (far[own], long[own])]

    tree = [(w, items[a], items[b]) for w, a, b in grown_tree(rank, rows) if (a < half) != (b < half)]
    return pd.DataFrame(tree, columns=["d", "a", "b"])


def space_blocks(points: DataFrame, pool: str, size: int | None = None) -> DataFrame:
    """points (pool, item, x) with `block`: parts of space of about `size` (by default BLOCK) points of a pool each.

    Pools are halved at the median of their widest dimension, and the halves again, level by level and all at once, until none is too large. Points that
    are all alike can't be halved; they are dealt out by a hash.
    """
    size = size or BLOCK
    out = cut(points.select(pool, "item", "x", F.lit(0).cast("long").alias("node")), "points")
    while True:
        crowded = out.groupBy(pool, "node").agg(F.count("*").alias("n")).where(F.col("n") > size)
        large = cut(crowded, "large")
        if large.isEmpty():
            break
        each = out.join(large, [pool, "node"]).select(pool, "node", F.posexplode("x").alias("d", "v"))
        spread = each.groupBy(pool, "node", "d").agg((F.max("v") - F.min("v")).alias("w"), F.percentile_approx("v", 0.5).alias("at"), F.max("v").alias("top"))
        widest = spread.groupBy(pool, "node").agg(F.max(F.struct("w", (-F.col("d")).alias("d"), "at", "top")).alias("m")).where("m.w > 0")
        # the median can be the largest value: then what is below it is one half
        halves = cut(widest.select(pool, "node", (-F.col("m.d")).alias("d"), F.col("m.at").alias("at"), (F.col("m.at") < F.col("m.top")).alias("upto")), "halves")
        if halves.isEmpty():
            break
        at = F.get("x", F.col("d"))
        first = F.when(F.col("upto"), at <= F.col("at")).otherwise(at < F.col("at"))
        out = cut(out.join(halves, [pool, "node"], "left").select(pool, "item", "x", F.when(F.col("d").isNull(), F.col("node")).otherwise(F.col("node") * 2 + F.when(first, 1).otherwise(2)).alias("node")), "points")
    sizes = out.groupBy(pool, "node").agg(F.ceil(F.count("*") / size).cast("int").alias("parts"))
    part = F.when(F.col("parts") > 1, F.pmod(F.xxhash64("item"), "parts")).otherwise(F.lit(0))
    return out.join(sizes, [pool, "node"]).select(pool, "item", "x", F.concat_ws(":", "node", part.cast("int")).alias("block"))


def block_distances(points: DataFrame, pool: str) -> DataFrame:
    """pool, i, j, least and most: the bounds on the distance of points of two blocks of a pool, from the boxes around them. A row for each two blocks, which
    are fewer than points by BLOCK."""
    ends = points.select(pool, "block", F.posexplode("x").alias("d", "v")).groupBy(pool, "block", "d").agg(F.min("v").alias("low"), F.max("v").alias("high"))
    boxes = cut(ends.groupBy(pool, "block").agg(F.sort_array(F.collect_list(F.struct("d", "low", "high"))).alias("box")), "boxes")
    other = boxes.select(F.col(pool).alias("__pool"), F.col("block").alias("j"), F.col("box").alias("other"))
    both = boxes.join(other, boxes[pool].eqNullSafe(other["__pool"])).select(pool, F.col("block").alias("i"), "j", "box", "other")
    far = lambda f: F.sqrt(F.aggregate(F.zip_with("box", "other", f), F.lit(0.0), lambda s, x: s + x * x))
    least = far(lambda p, q: F.greatest(F.lit(0.0), p["low"] - q["high"], q["low"] - p["high"]))
    most = far(lambda p, q: F.greatest(F.abs(p["high"] - q["low"]), F.abs(q["high"] - p["low"])))
    return cut(both.where("i <> j").select(pool, "i", "j", least.alias("least"), most.alias("most")), "distances")


def block_pairs(placed: DataFrame, inside: DataFrame, distances: DataFrame, pool: str) -> DataFrame:
    """pool, i and j of the blocks that must be compared, i looking for neighbours in j: those where a component with points in i can have a nearer neighbour in j than it has in its own blocks.

    placed: pool, item, c, block; inside: pool, c and d, the nearest neighbour outside a component within its blocks. A component that fills its blocks has none there;
    its bound is the most that a point of another component can be away.
    """
    parts = placed.groupBy(pool, "block", "c").agg(F.lit(1).alias("one")).drop("one")
    filled = cut(parts.groupBy(pool, "block").agg(F.count("*").alias("k"), F.min("c").alias("c")), "filled")
    mine = filled.select(pool, F.col("block").alias("i"), F.col("k").alias("ki"), F.col("c").alias("ci"))
    theirs = filled.select(pool, F.col("block").alias("j"), F.col("k").alias("kj"), F.col("c").alias("cj"))
    foreign = cut(distances.join(mine, [pool, "i"]).join(theirs, [pool, "j"]).where("ki > 1 OR kj > 1 OR ci <> cj"), "foreign")
    reach = parts.join(inside.select(pool, "c", "d"), [pool, "c"], "left")
    beyond = reach.where("d IS NULL").join(foreign.groupBy(pool, F.col("i").alias("block")).agg(F.min("most").alias("most")), [pool, "block"], "left")
    bound = beyond.groupBy(pool, "c").agg(F.min("most").alias("b"))
    need = reach.join(bound, [pool, "c"], "left").groupBy(pool, F.col("block").alias("i")).agg(F.max(F.coalesce("d", "b", F.lit(float("inf")))).alias("need"))
    return foreign.join(need, [pool, "i"]).where(F.col("least") <= F.col("need") * (1 + 1e-9) + 1e-12).select(pool, "i", "j")


def spanning_trees(points: DataFrame, pool: str) -> DataFrame:
    """pool, d, a and b of the edges of each pool's minimum spanning tree. points: pool, item, x. Ties go to the smaller items,
    so the edges that the components choose make no circle.

    In a round every component finds its nearest neighbour, first among the edges that are known, then in those blocks that can hold a nearer one;
    blocks too far for all of a block's components are never compared with it. Known are the edges of each block's own tree and, of blocks that were compared, those edges of
    the tree of both that go from one to the other. The shortest way out of a component, within two blocks, is an edge of their tree, so no blocks are compared twice.
    """
    kind = {c: points.schema[c].dataType.simpleString() for c in (pool, "item")}
    dimensions = points.agg(F.max(F.size("x"))).first()[0] or 0
    points = cut(space_blocks(points, pool, BLOCK * (WIDER if dimensions >= FLAT else 1)), "points")
    distances = block_distances(points, pool)
    own = cut(points.select(pool, "item", F.col("item").alias("c")), "own")
    schema = f"{pool} {kind[pool]}, d double, a {kind['item']}, b {kind['item']}"

    def within(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        tree = block_tree(g)
        return tree.assign(block=key[1], **{pool: key[0]})  # not as a list: that of an empty tree has no type[[pool, "block", "d", "a", "b"]]

    def search(key: tuple, g: pd.DataFrame, trees: pd.DataFrame) -> pd.DataFrame:
        found = tree_between(g[g["mine"]], g[~g["mine"]], trees)
        return found.assign(**{pool: key[0]})[[pool, "d", "a", "b"]]

    trees = cut(points.groupBy(pool, "block").applyInPandas(within, f"{pool} {kind[pool]}, block string, d double, a {kind['item']}, b {kind['item']}"), "trees")
    known, compared, edges = trees, None, None
    rest = distances.count() // 2  # pairs of blocks that weren't compared

    def leaving(found: DataFrame) -> DataFrame:
        """The edges that go from one component to another, with these."""
        at = lambda side: own.select(pool, F.col("item").alias(side), F.col("c").alias(f"c_{side}"))
        return found.select(pool, "d", "a", "b").join(at("a"), [pool, "a"]).join(at("b"), [pool, "b"]).where("c_a <> c_b")

    def nearest(found: DataFrame) -> DataFrame:
        """pool, c, d, a, b and to: the nearest way out of each component, and the component it leads to."""
        both = F.explode(F.array(F.struct(F.col("c_a").alias("c"), F.col("c_b").alias("to")), F.struct(F.col("c_b").alias("c"), F.col("c_a").alias("to")))).alias("w")
        return found.select(pool, "d", "a", "b", both).groupBy(pool, F.col("w.c").alias("c")).agg(F.min(F.struct("d", "a", "b", "w.to")).alias("m")).select(pool, "c", "m.*")

    while True:
        known = cut(leaving(known), "known")
        if rest:
            inside = cut(nearest(known), "inside")
            open_ = own.groupBy(pool).agg(F.min("c").alias("x"), F.max("c").alias("y")).where("x <> y").select(pool)
            placed = cut(points.select(pool, "item", "block").join(own, [pool, "item"]).join(open_, pool), "placed")
            pairs = block_pairs(placed, inside, distances, pool).select(pool, F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j")).distinct()
            pairs = cut(pairs if compared is None else pairs.join(compared, [pool, "i", "j"], "left_anti"), "pairs")
            groups = pairs.count()
            if groups:
                side = lambda rows, s: pairs.join(rows.withColumnRenamed("block", s), [pool, s])  # noqa: B023, E731
                here, there = (side(points, s).select(pool, "i", "j", "item", "x", F.lit(s == "i").alias("mine")) for s in ("i", "j"))
                both = [side(trees, s).select(F.col(pool).alias("t_pool"), F.col("i").alias("t_i"), F.col("j").alias("t_j"), "d", "a", "b") for s in ("i", "j")]
                tasks = min(2000, groups)  # a number of its own, as groups are few bytes and much work
                left = here.unionByName(there).repartition(tasks, pool, "i", "j").groupBy(pool, "i", "j")
                right = both[0].unionByName(both[1]).repartition(tasks, "t_pool", "t_i", "t_j").groupBy("t_pool", "t_i", "t_j")
                near = cut(left.cogroup(right).applyInPandas(search, schema), "near")
                known = cut(known.unionByName(leaving(near)), "known")
                compared, rest = pairs if compared is None else cut(compared.unionByName(pairs), "compared"), rest - groups
        chosen = cut(nearest(known), "chosen")
        if chosen.isEmpty():
            return points.select(pool, F.lit(0.0).alias("d"), F.col("item").alias("a"), F.col("item").alias("b")).limit(0) if edges is None else edges
        new = chosen.select(pool, "d", "a", "b").distinct()
        edges = new if edges is None else edges.union(new)
        own = cut(own.join(_united(chosen.select(pool, "c", "to"), pool), [pool, "c"], "left").select(pool, "item", F.coalesce("to", "c").alias("c")), "own")


def _united(ways: DataFrame, pool: str) -> DataFrame:
    """pool, c and to: the root of each component, if each leads to the one at the end of its shortest way out. Of any such components exactly two lead to each other; the smaller of them is the root."""

    def onward(rows: DataFrame) -> DataFrame:
        ahead = rows.select(pool, F.col("c").alias("to"), F.col("to").alias("next"))
        return rows.select(pool, "c", "to").join(ahead, [pool, "to"]).select(pool, "c", F.col("to").alias("before"), F.col("next").alias("to"))

    ahead = onward(ways)
    roots = cut(ahead.select(pool, "c", F.when((F.col("to") == F.col("c")) & (F.col("c") < F.col("before")), F.col("c")).otherwise(F.col("before")).alias("to")), "roots")
    while True:
        roots = cut(onward(onward(onward(roots))), "roots")
        if roots.where("to <> before").isEmpty():
            return roots.select(pool, "c", "to")


def cluster_pool(rows: DataFrame, pool: str, item: str, vector: str = "vector", least: int = DEFAULTS.cluster_min_size, reduce: str = "axes") -> DataFrame:
    """pool, item and label for each row, items being distinct within a pool; rows without a vector, and pools of fewer than `least` vectors, are noise.
    Pools of `reduce_from` vectors and more are reduced to their principal axes, or with reduce="manifold" by a layout that begins there (see manifold.layout())."""
    if reduce not in ("axes", "manifold"):
        raise ValueError("reduce must be axes or manifold")
    kind = {c: rows.schema[c].dataType.simpleString() for c in (pool, item)}
    has = rows.where(F.col(vector).isNotNull()).select(pool, F.col(item).alias("item"), F.col(vector).cast("array<double>").alias("v"))
    axes = cut(principal_axes(has, pool, "v"), "axes")
    centred = F.zip_with("v", "mean", lambda a, m: a - m)
    x = F.when(F.col("mean").isNull(), F.col("v")).otherwise(F.transform("axes", lambda w: F.aggregate(F.zip_with(w, centred, lambda p, q: p * q), F.lit(0.0), lambda s, y: s + y)))
    points = cut(has.join(axes, pool, "left").select(pool, "item", "v", F.col("mean").isNotNull().alias("large"), x.alias("x")), "points")
    if reduce == "manifold":
        from docweave.operators import manifold

        points = cut(manifold.layout(points.where("large").drop("large"), pool).unionByName(points.where("NOT large").select(pool, "item", "x")), "points")
    trees = spanning_trees(points, pool)

    def fold(key, items: pd.DataFrame, edges: pd.DataFrame) -> pd.DataFrame:
        names = items["item"].sort_values().reset_index(drop=True)
        number = pd.Series(range(len(names)), index=names)
        edges = edges.sort_values(["d", "a", "b"])
        tree = np.column_stack([number[edges["a"]], number[edges["b"]], edges["d"]]) if len(edges) else np.zeros((0, 3))
        return pd.DataFrame({pool: [key[0]] * len(names), item: names, "label": tree_labels(len(names), tree, least)})

    labels = points.select(pool, "item").groupBy(pool).cogroup(trees.groupBy(pool)).applyInPandas(fold, f"{pool} {kind[pool]}, {item} {kind[item]}, label int")
    return labels.unionByName(rows.where(F.col(vector).isNull()).select(pool, item, F.lit(-1).alias("label")))


def dominant_label(labels: DataFrame, pool: str, item: str = "item") -> DataFrame:
    """The largest cluster of each pool, of equals that of the first item; pools of noise alone have none."""
    counts = labels.where("label >= 0").groupBy(pool, "label").agg(F.count("*").alias("n"), F.min(item).alias("first"))
    ranked = counts.withColumn("r", F.row_number().over(Window.partitionBy(pool).orderBy(F.desc("n"), "first")))
    return ranked.where("r = 1").select(pool, "label", "n")
