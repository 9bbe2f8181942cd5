"""Classification of document vectors to collections by the cosine with their prototypes."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docweave.config import DEFAULTS
from docweave.functions import vectors as V
from docweave.lineage import cut
from docweave.session import ship

#: Prototypes (collections) that are broadcast, and the numbers that their vectors hold together, at most; more are joined without a hint.
BROADCAST_ROWS, BROADCAST_NUMBERS = 20_000, 16_000_000
#: Queries and items of an exact search that are compared in one group at most, and the numbers that either side's vectors hold together.
QUERY_BLOCK, ITEM_BLOCK, BLOCK_NUMBERS = 2_048, 16_384, 4_000_000
#: Queries whose scores are held at once, and pairs whose cosines are worked out at once.
TILE, PAIRS = 256, 100_000


def document_vectors(chunks: DataFrame, key: str = "doc_id", vector: str = "vector") -> DataFrame:
    """The mean of each document's chunk vectors."""
    return V.mean_vectors(chunks, [key], vector).select(key, "vector")


def prototypes(members: DataFrame, kg: str = "kg_id", vector: str = "vector") -> DataFrame:
    """kg, prototype (mean of its documents' vectors, each document counting once) and member_count."""
    counts = members.groupBy(kg).agg(F.count("*").alias("member_count"))
    return V.mean_vectors(members, [kg], vector, "prototype").drop("n").join(counts, kg, "right")


def membership_keys(members: DataFrame, kg: str = "kg_id", doc: str = "doc_id") -> DataFrame:
    """kg and members_key: equal for equal sets of member names. Combined in the tasks, so a collection may have any number of members."""
    names = members.select(kg, F.col(doc).cast("string").alias("d")).distinct()
    parts = [F.hex(F.bit_xor(F.xxhash64("d", F.lit(i)))) for i in range(2)]
    return names.groupBy(kg).agg(F.concat_ws(":", F.count("*").cast("string"), *parts).alias("members_key"))


def cached_prototypes(members: DataFrame, cache: DataFrame, kg: str = "kg_id", doc: str = "doc_id", vector: str = "vector") -> DataFrame:
    """kg, members_key, prototype, member_count and cached: taken from the cache (of the same columns but the last) where the members' names are
    the same and it holds a prototype, else worked out anew. The result without `cached` is the next cache."""
    keys = membership_keys(members, kg, doc)
    good = cache.where(F.col("prototype").isNotNull()).select(kg, "members_key", "prototype", "member_count")
    kept = keys.join(good, [kg, "members_key"])
    stale = members.join(kept.select(kg), kg, "left_anti")
    fresh = prototypes(stale, kg, vector).join(keys, kg).select(kg, "members_key", "prototype", "member_count")
    return kept.withColumn("cached", F.lit(True)).unionByName(fresh.withColumn("cached", F.lit(False)))


def scores(docs: DataFrame, protos: DataFrame, doc: str = "doc_id", kg: str = "kg_id") -> DataFrame:
    """Cosine of every document (doc, vector) with every prototype. Norms are worked out once for each side; prototypes
    are one row for each collection and are broadcast up to BROADCAST_ROWS of them."""
    left = docs.where(F.col("vector").isNotNull()).select(doc, "vector", V.norm(F.col("vector")).alias("dn"))
    right = protos.where(F.col("prototype").isNotNull()).select(kg, "prototype", "member_count", V.norm(F.col("prototype")).alias("pn"))
    rows, numbers = right.limit(BROADCAST_ROWS + 1).agg(F.count("*"), F.coalesce(F.sum(F.size("prototype")), F.lit(0))).first()
    if rows <= BROADCAST_ROWS and numbers <= BROADCAST_NUMBERS:
        right = F.broadcast(right)
    return left.crossJoin(right).select(doc, kg, "member_count", V.cosine(F.col("vector"), F.col("prototype"), F.col("dn"), F.col("pn")).alias("score"))


def candidates(scored: DataFrame, doc: str = "doc_id", kg: str = "kg_id", min_score: float = DEFAULTS.min_score, min_members: int = DEFAULTS.cluster_min_size, digits: int = 4) -> DataFrame:
    """Ranked candidates: unrounded scores of min_score or more, by rounded score, ties by collection; low_confidence with too few members."""
    rank = F.row_number().over(Window.partitionBy(doc).orderBy(F.desc("score"), F.col(kg)))
    kept = scored.where(F.col("score") >= min_score).withColumn("score", F.round("score", digits))
    return kept.withColumn("rank", rank).withColumn("low_confidence", F.col("member_count") < min_members)


def best(ranked: DataFrame, doc: str = "doc_id") -> DataFrame:
    return ranked.where("rank = 1").drop("rank")


def _padded(vectors: pd.Series, length: int) -> np.ndarray:
    """The vectors as rows, shorter ones filled up with zeros."""
    out = np.zeros((len(vectors), length))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def _top(x: np.ndarray, y: np.ndarray, k: int, min_score: float, digits: int | None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rows of x, rows of y and cosines of the k best rows of y for each row of x, ties by row of y. Products of matrices choose who takes part; the cosines are
    then worked out pair by pair, so that equal vectors have equal ones."""
    nx, ny = np.sqrt((x * x).sum(1)), np.sqrt((y * y).sum(1))
    ux, uy = (np.where(n[:, None] < 1e-9, 0.0, v / np.maximum(n, 1e-9)[:, None]) for v, n in ((x, nx), (y, ny)))
    slack = 1e-9 + (0.0 if digits is None else 10.0**-digits)
    for at in range(0, len(x), TILE):
        c = ux[at : at + TILE] @ uy.T
        least = np.partition(c, -k, axis=1)[:, -k] if c.shape[1] > k else np.full(len(c), -2.0)
        p, r = np.nonzero(c >= np.maximum(least, min_score)[:, None] - slack)
        score = np.empty(len(p))
        for b in range(0, len(p), PAIRS):
            i, j = p[b : b + PAIRS] + at, r[b : b + PAIRS]
            size = nx[i] * ny[j]
            none = (nx[i] < 1e-9) | (ny[j] < 1e-9)
            score[b : b + PAIRS] = np.where(none, 0.0, np.clip((x[i] * y[j]).sum(1) / np.where(none, 1.0, size), -1, 1))
        if digits is not None:
            score = np.sign(score) * np.floor(np.abs(score) * 10.0**digits + 0.5) / 10.0**digits
        fit = score >= min_score
        p, r, score = p[fit], r[fit], score[fit]
        order = np.lexsort((r, -score, p))
        p, r, score = p[order], r[order], score[order]
        kept = np.arange(len(p)) - np.searchsorted(p, p) < k
        yield p[kept] + at, r[kept], score[kept]


def nearest(queries: DataFrame, items: DataFrame, k: int, query: str = "query_id", item: str = "item_id", min_score: float = -1.0, digits: int | None = None) -> DataFrame:
    """Exact top k by cosine of a stated set of queries against all items: query, item, score and rank; ties by item. With `digits` the scores are
    rounded before they are compared with min_score and with each other. Vectors that are null or hold a null have no neighbours.

    Both sides meet in blocks, each pair of blocks in one group, which keeps k items for each of its queries; a query's candidates are as many as there are
    blocks of items times k. A group is bounded by QUERY_BLOCK and ITEM_BLOCK rows, or by BLOCK_NUMBERS in their vectors.
    """
    ship(queries.sparkSession)
    whole = lambda rows, key, name: rows.where(V.norm(F.col("vector")).isNotNull()).select(F.col(key), V.as_double(F.col("vector")).alias(name))
    q, i = whole(queries, query, "qv"), whole(items, item, "vector")
    rows, length = q.agg(F.count("*"), F.max(F.size("qv"))).first()
    most = max(1, BLOCK_NUMBERS // max(1, length or 1))
    blocks, parts = max(1, -(-rows // min(QUERY_BLOCK, most))), max(1, -(-items.count() // min(ITEM_BLOCK, most)))
    dealt = lambda n, key: F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    tasks = min(2000, 3 * blocks * parts)  # a number of its own, as groups are few bytes and much work
    left = q.select(dealt(blocks, query).alias("qb"), each(parts).alias("ib"), F.col(query).alias("q"), "qv").repartition(tasks, "qb", "ib")
    right = i.select(each(blocks).alias("qb"), dealt(parts, item).alias("ib"), F.col(item).alias("i"), "vector").repartition(tasks, "qb", "ib")

    def compare(key: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"q": a["q"][:0], "i": b["i"][:0], "score": np.zeros(0)})
        b = b.sort_values("i", na_position="first")
        length = max(a["qv"].map(len).max(), b["vector"].map(len).max())
        found = list(_top(_padded(a["qv"], length), _padded(b["vector"], length), k, min_score, digits))
        p, r, score = (np.concatenate(c) for c in zip(*found, strict=True))
        return pd.DataFrame({"q": a["q"].iloc[p].reset_index(drop=True), "i": b["i"].iloc[r].reset_index(drop=True), "score": score})

    kind = {"q": q.schema[query].dataType.simpleString(), "i": i.schema[item].dataType.simpleString()}
    found = left.groupBy("qb", "ib").cogroup(right.groupBy("qb", "ib")).applyInPandas(compare, f"q {kind['q']}, i {kind['i']}, score double")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "i"))).where(F.col("rank") <= k)
    return ranked.select(F.col("q").alias(query), F.col("i").alias(item), "score", "rank")


def route(found: DataFrame, membership: DataFrame, top: int = DEFAULTS.route_kgs, min_score: float = DEFAULTS.min_score, digits: int = 4, query: str = "query_id", item: str = "item_id", kg: str = "kg_id") -> DataFrame:
    """query, kg, score and rank of the `top` collections to ask for each query: by the mean score (rounded to `digits`, min_score or more) of their members among its
    nearest items, ties by collection. found: query, item, score, the nearest DEFAULTS.coarse_top_k for example; membership: item, kg. An item may be in several collections or none."""
    means = found.join(membership.select(item, kg), item).groupBy(query, kg).agg(F.round(F.avg("score"), digits).alias("score")).where(F.col("score") >= min_score)
    return means.withColumn("rank", F.row_number().over(Window.partitionBy(query).orderBy(F.desc("score"), kg))).where(F.col("rank") <= top)


def mean_pairwise_cosine(rows: DataFrame, cluster: str, vector: str = "vector") -> DataFrame:
    """cluster, n and the mean cosine of its pairs, without making the pairs: for unit vectors
    the sum over pairs is (|sum|^2 - sum of |v|^2) / 2. A vector of norm below 1e-9 counts as zero; one member gives 1."""
    n = V.norm(F.col(vector))
    unit = rows.select(cluster, F.when(n >= 1e-9, F.transform(vector, lambda x: x / n)).otherwise(F.transform(vector, lambda x: F.lit(0.0))).alias("u"), F.when(n >= 1e-9, 1.0).otherwise(0.0).alias("s"))
    counts = unit.groupBy(cluster).agg(F.count("*").alias("n"), F.sum("s").alias("self"))
    sums = unit.select(cluster, F.posexplode("u").alias("i", "x")).groupBy(cluster, "i").agg(F.sum("x").alias("x")).groupBy(cluster).agg(F.sum(F.col("x") * F.col("x")).alias("square"))
    pairs = F.col("n") * (F.col("n") - 1) / 2
    return counts.join(sums, cluster).select(cluster, "n", F.when(F.col("n") < 2, 1.0).otherwise((F.col("square") - F.col("self")) / 2 / pairs).alias("intra_similarity"))


def assign_round(docs: DataFrame, protos: DataFrame, doc: str = "doc_id", kg: str = "kg_id", threshold: float = DEFAULTS.auto_score, min_score: float = DEFAULTS.min_score) -> tuple[DataFrame, DataFrame]:
    """auto_assign() in its parallel form: all docs are compared with the prototypes as they are, and those that reach the threshold move them
    together. Gives (doc, kg, score) of the assigned docs, and (kg, prototype, member_count) as they are after them."""
    ranked = best(candidates(scores(docs, protos, doc, kg), doc, kg, min_score))
    assigned = ranked.where(F.col("score") >= threshold).select(doc, kg, "score")
    new = V.mean_vectors(assigned.join(docs.select(doc, "vector"), doc), [kg], "vector", "__mean").withColumnRenamed("n", "__n")
    both = protos.select(kg, "prototype", "member_count").join(new, kg, "left")
    moved = F.zip_with("prototype", "__mean", lambda p, m: (p * F.col("member_count") + m * F.col("__n")) / (F.col("member_count") + F.col("__n")))
    kept = F.when(F.col("__n").isNull(), F.col("prototype")).when(F.col("member_count") == 0, F.col("__mean")).otherwise(moved)
    return assigned, both.select(kg, kept.alias("prototype"), (F.col("member_count") + F.coalesce("__n", F.lit(0))).alias("member_count"))


def auto_assign(docs: DataFrame, protos: DataFrame, doc: str = "doc_id", kg: str = "kg_id", threshold: float = DEFAULTS.auto_score, min_score: float = DEFAULTS.min_score,
                slices: int | None = None) -> DataFrame:
    """doc, kg, score and assigned, where each assignment moves its prototype before the next document (in order of doc, unique) is compared.

    The sequence is cut into slices, which run at the same time. Each starts from the prototypes as the slices before it are expected to leave them: at first as they
    are, then by what these assigned in the last round. A slice whose predecessors assigned the same in two rounds has started from the true prototypes and is settled;
    rounds go on from the first that hasn't. The first open slice always settles, so the result is that of the one sequence; as
    a few documents move a prototype little, most rounds settle all but the border cases of the round before. A task streams its slice and holds the prototypes only.
    By default there are as many slices as shuffle partitions.
    """
    spark = docs.sparkSession
    names = [r[kg] for r in protos.select(kg).orderBy(kg).collect()]  # a row for each collection
    place = spark.createDataFrame([(n, i) for i, n in enumerate(names)], f"__k {protos.schema[kg].dataType.simpleString()}, __i int")
    slices = slices or int(spark.conf.get("spark.sql.shuffle.partitions"))
    own = docs.select(F.col(doc).alias("__doc"), "vector")
    lows = own.select("__doc").repartitionByRange(slices, "__doc").groupBy(F.spark_partition_id().alias("p")).agg(F.min("__doc").alias("low")).orderBy("low").collect()
    after = sum((F.when(F.col("__doc") >= F.lit(r["low"]), 1).otherwise(0) for r in lows[1:]), F.lit(0))
    rows = cut(own.select(after.cast("int").alias("__slice"), F.lit(1).alias("__kind"), F.lit(None).cast("int").alias("__i"), F.lit(0).cast("long").alias("__n"), "__doc", "vector"), "pool")
    # the state of a prototype is the sum of its members, so that slices add up
    total = F.transform("prototype", lambda x: x * F.greatest(F.col("member_count"), F.lit(1)))
    start = cut(protos.join(place, F.col(kg) == F.col("__k")).select("__i", total.alias("vector"), F.col("member_count").cast("long").alias("__n")), "state")
    settled, digests, results, moved = 0, {}, [], []
    while settled < len(lows):
        states = _states(start, reduce(DataFrame.unionByName, moved) if moved else None, settled, len(lows))
        open_ = rows.where(F.col("__slice") >= settled)
        both = states.select("__slice", F.lit(0).alias("__kind"), "__i", "__n", F.lit(None).cast(rows.schema["__doc"].dataType).alias("__doc"), "vector").unionByName(open_)
        dealt = both.repartition(slices, "__slice").sortWithinPartitions("__slice", "__kind", "__doc")
        found = cut(_fold(dealt, len(names), threshold, min_score), "assigned")
        ones = found.where("added IS NULL")
        now = {r["__slice"]: r["d"] for r in ones.groupBy("__slice").agg(F.bit_xor(F.xxhash64("__doc", F.when(F.col("assigned"), F.col("__i")))).alias("d")).collect()}
        first, settled = settled, settled + 1
        while settled < len(lows) and digests.get(settled - 1) == now[settled - 1]:  # the slice has started from what those before it do
            settled += 1
        digests = now
        results.append(ones.where(F.col("__slice").between(first, settled - 1)))
        sums = found.where("added > 0").select("__slice", "__i", "vector", F.col("added").alias("__n"))
        moved = [m.where(F.col("__slice") < first) for m in moved] + [sums]
    if not results:
        return docs.limit(0).join(protos, F.lit(False)).select(doc, kg, F.lit(0.0).alias("score"), F.lit(False).alias("assigned"))
    every = reduce(DataFrame.unionByName, results)
    return every.join(F.broadcast(place.select("__i", F.col("__k").alias(kg))), "__i", "left").select(F.col("__doc").alias(doc), kg, "score", "assigned")


def _states(start: DataFrame, moved: DataFrame | None, first: int, slices: int) -> DataFrame:
    """__slice, __i, vector and __n: the sums of all prototypes at the start of the slices from `first` on, given the sums that slices have added to them
    (a row for each slice and prototype at most)."""
    every = start.withColumn("__slice", F.lit(-1))
    if moved is not None:
        every = every.unionByName(moved.select("__slice", *start.columns))

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        # one prototype: its own sum, then what each slice has added
        frame = frame.sort_values("__slice")
        vectors = [v for v in frame["vector"] if v is not None]
        known = frame["vector"].notna().to_numpy()
        steps = np.zeros((len(frame), len(vectors[0]) if vectors else 0))
        if vectors:
            steps[known] = np.stack(vectors)
        if len(frame) and frame["__n"].iloc[0] == 0 and known[0] and len(frame) > 1:
            steps[0] = 0  # a prototype without members is replaced by its first
        sums, counts, at = np.cumsum(steps, axis=0), np.cumsum(frame["__n"].to_numpy()), frame["__slice"].to_numpy()
        place = np.searchsorted(at, np.arange(first, slices), "left") - 1
        empty = not vectors
        none = (counts[place] == 0) if len(frame) else None
        initial = frame["vector"].iloc[0]
        out = [None if empty else (initial if z else v.tolist()) for v, z in zip(sums[place], none, strict=True)]
        return pd.DataFrame({"__slice": np.arange(first, slices), "__i": key[0], "vector": out, "__n": counts[place]})

    return every.groupBy("__i").applyInPandas(run, "__slice int, __i int, vector array<double>, __n long")


def _fold(dealt: DataFrame, n: int, threshold: float, min_score: float) -> DataFrame:
    """__slice, __doc, __i, score and assigned of the documents of each slice, and after them, with the number `added`, the sum of the vectors that each prototype has
    gained. In a slice its prototypes come first, then its documents in order."""
    kind = dealt.schema["__doc"].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, matrix, added = None, None, {}
        for frame in frames:
            out = []
            for own, row_kind, i, members, key, v in frame[["__slice", "__kind", "__i", "__n", "__doc", "vector"]].itertuples(index=False):
                if own != now:
                    out += closed(now, added)
                    now, sums, counts, matrix, added = own, [None] * n, [0] * n, None, {}
                if row_kind == 0:
                    sums[int(i)], counts[int(i)] = None if v is None else np.asarray(v, float), int(members)
                    continue
                if matrix is None:
                    width = max((len(s) for s in sums if s is not None), default=0)
                    matrix = np.array([s if s is not None else np.zeros(width) for s in sums]).reshape(n, width)
                    norms, there = np.linalg.norm(matrix, axis=1) / np.maximum(counts, 1), np.array([s is not None for s in sums], bool)
                best, score = -1, None
                if v is not None and n and matrix.shape[1]:
                    x = np.asarray(v, float)
                    size = np.linalg.norm(x)
                    good = there & (norms >= 1e-9) & (size >= 1e-9)
                    cos = np.where(good, np.clip(matrix @ x / np.where(good, norms * np.maximum(counts, 1) * size, 1), -1, 1), 0.0)
                    fit = np.where(there & (cos >= min_score), np.round(cos, 4), -2.0)
                    best = int(fit.argmax())  # of equals the first
                    score = float(fit[best])
                    best, score = (best, score) if score > -2 else (-1, None)
                taken = score is not None and score >= threshold
                if taken:
                    so_far, k = added.get(best, (0.0, 0))
                    added[best] = so_far + x, k + 1
                    matrix[best] = matrix[best] + x if counts[best] else x
                    counts[best] += 1
                    norms[best] = np.linalg.norm(matrix[best]) / counts[best]
                out.append((own, key, best if best >= 0 else None, score, taken, None, None))
            yield table(out)
        yield table(closed(now, added))

    def closed(own, added: dict) -> list[tuple]:
        return [(own, None, i, None, None, x.tolist(), k) for i, (x, k) in added.items()]

    def table(out: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(out, columns=["__slice", "__doc", "__i", "score", "assigned", "vector", "added"]).astype({"__i": "Int64", "score": "Float64", "added": "Int64"})

    return dealt.mapInPandas(run, f"__slice int, __doc {kind}, __i int, score double, assigned boolean, vector array<double>, added long")
