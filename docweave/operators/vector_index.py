"""A stored inverted-file index over vectors: coarse cells, compressed residuals, exact re-ranking.

Centroids are fitted on a bounded sample by spherical k-means; every row goes to the cell of its nearest centroid. The index
is a folder of tables: `cells` (centroids), `scale` (the code of residuals) and `items`, a row for each vector with its code and itself, partitioned by
segment and cell, so that a search reads the files of the cells it probes, and of the codes or the vectors only what it needs. A change of rows is a
new segment: a row joins its cell there, and where an older one was in another cell a mark in that cell says that it is gone. In every cell the
newest segment of an id counts.

Rows without direction (null, or a norm below 1e-9) have no neighbours and are left out, in items as in queries.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docweave.functions import vectors as V
from docweave.lineage import cut, shared_dir
from docweave.session import ship

#: Rows on which centroids are fitted, at most, and rounds of the fit.
SAMPLE, ROUNDS = 20_000, 12
#: Cells at most: their centroids are sent to every task.
MOST_CELLS = 4096
#: Rows of items and of queries that are compared in one group, about, and queries whose scores are held at once.
ITEM_BLOCK, QUERY_BLOCK, TILE = 16_384, 2_048, 256
#: Rows of a cell in one file, about.
FILE_ROWS = 65_536
#: How many rows for each wanted one are re-ranked.
OVERFETCH = 4
#: Rows of the sample that are searched for their TRIED_FOR nearest in it, and the share of these that the probed cells must hold.
TRIED, TRIED_FOR, COVERED = 400, 10, 0.96
#: Codes have values of -LEVELS to LEVELS; ranges of residuals end at this share of the sample.
LEVELS, RANGE_AT = 127, 0.999


def unit_rows(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def fit_centroids(sample: np.ndarray, cells: int, rounds: int = ROUNDS, seed: int = 5) -> np.ndarray:
    """Spherical k-means of unit rows. A cell that loses all its rows takes the row that is worst served."""
    rng = np.random.default_rng(seed)
    centroids = sample[rng.choice(len(sample), cells, replace=False)]
    for _ in range(rounds):
        scores = sample @ centroids.T
        own = scores.argmax(1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, sample)
        empty = np.flatnonzero(np.bincount(own, minlength=cells) == 0)
        sums[empty] = sample[np.argsort(scores.max(1), kind="stable")[: len(empty)]]
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        centroids = np.where(norms > 1e-9, sums / np.maximum(norms, 1e-9), centroids)
    return centroids


def enough_probes(sample: np.ndarray, centroids: np.ndarray) -> int:
    """The number of nearest cells in which COVERED of the neighbours of rows of the sample are, by brute force over the sample.
    All rows are denser than a sample and their neighbours nearer, so the cells hold no smaller share of these."""
    tried = sample[:TRIED]
    scores = tried @ sample.T
    scores[np.arange(len(tried)), np.arange(len(tried))] = -2
    n = min(TRIED_FOR, len(sample) - 1)
    if n < 1:
        return len(centroids)
    near = np.argpartition(-scores, n - 1, axis=1)[:, :n]
    cells = (sample @ centroids.T).argmax(1)[near]
    place = np.argsort(np.argsort(-(tried @ centroids.T), axis=1, kind="stable"), axis=1, kind="stable")
    return int(np.quantile(np.take_along_axis(place, cells, 1), COVERED)) + 1


@dataclass
class Model:
    """Centroids, the step of the residuals' code in each dimension, and how many cells a search probes by default."""

    centroids: np.ndarray
    steps: np.ndarray
    probes: int = 1

    @staticmethod
    def fit(sample: np.ndarray, cells: int) -> Model:
        centroids = fit_centroids(sample, cells)
        residuals = sample - centroids[(sample @ centroids.T).argmax(1)]
        reach = np.quantile(np.abs(residuals), RANGE_AT, axis=0)
        return Model(centroids, np.maximum(reach, 1e-9) / LEVELS, enough_probes(sample, centroids))

    def encode(self, units: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The cell of each row, the angle to its centroid, and the code of its residual, a byte for each dimension."""
        scores = units @ self.centroids.T
        cells = scores.argmax(1)
        codes = np.clip(np.rint((units - self.centroids[cells]) / self.steps), -LEVELS, LEVELS)
        return cells, np.arccos(np.clip(scores.max(1), -1, 1)), codes.astype(np.int8)

    def decode(self, cell: int, codes: np.ndarray) -> np.ndarray:
        return self.centroids[cell] + codes * self.steps


def _directed(rows: DataFrame, key: str, vector: str) -> DataFrame:
    v = rows.where(F.col(vector).isNotNull()).select(F.col(key).alias("id"), V.as_double(F.col(vector)).alias("vector"))
    return v.where(V.norm(F.col("vector")) >= 1e-9)


def _encoded(rows: DataFrame, model: Model) -> DataFrame:
    """cell, id, angle, code and vector of rows(id, vector)."""
    ship(rows.sparkSession)
    kind = rows.schema["id"].dataType.simpleString()

    def run(frames):
        for f in frames:
            if len(f):
                cells, angles, codes = model.encode(unit_rows(np.stack(f["vector"].to_numpy())))
                yield pd.DataFrame({"cell": cells, "id": f["id"], "angle": angles, "code": [c.tobytes() for c in codes], "vector": f["vector"]})

    return rows.mapInPandas(run, f"cell int, id {kind}, angle double, code binary, vector array<double>")


def _sample(rows: DataFrame, limit: int) -> np.ndarray:
    """At most `limit` unit rows, those with the least hashes of their ids."""
    found = rows.select("vector", F.xxhash64("id").alias("h")).orderBy("h").limit(limit).select("vector").toPandas()["vector"]
    return unit_rows(np.stack(found.to_numpy())) if len(found) else np.zeros((0, 1))


class VectorIndex:
    """An index in a folder. Readers see what was committed: a segment counts when its files are complete."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._read: dict[int, DataFrame] = {}  # finished segments don't change, so their files are listed once
        cells = spark.read.parquet(f"{self.path}/cells").orderBy("cell").toPandas()
        scale = spark.read.parquet(f"{self.path}/scale").first()
        self.model = Model(np.stack(cells["centroid"].to_numpy()) if len(cells) else np.zeros((0, len(scale["steps"]))), np.array(scale["steps"]), scale["probes"])
        self.schema = f"id {scale['kind']}, angle double, code binary, vector array<double>, gone boolean, cell int"

    @staticmethod
    def build(rows: DataFrame, path: str, key: str = "id", vector: str = "vector", cells: int | None = None, sample: int = SAMPLE) -> VectorIndex:
        """Fits centroids and writes the index. rows: unique ids and vectors of one length. cells: by default the root of the number of rows, MOST_CELLS at most."""
        spark = rows.sparkSession
        ready = _directed(rows, key, vector)
        points = _sample(ready, sample)
        cells = min(cells or max(1, int(ready.count() ** 0.5)), MOST_CELLS, len(points))
        model = Model.fit(points, cells) if cells else Model(np.zeros((0, 1)), np.ones(1))
        spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(model.centroids)], "cell int, centroid array<double>").coalesce(1).write.parquet(f"{path}/cells")
        spark.createDataFrame([(model.steps.tolist(), model.probes, ready.schema["id"].dataType.simpleString())], "steps array<double>, probes int, kind string").coalesce(1).write.parquet(f"{path}/scale")
        if not cells:
            ready = ready.limit(0)
        _write(_encoded(ready, model).withColumn("gone", F.lit(False)), f"{path}/items/segment={0:06d}")
        return VectorIndex(spark, path)

    def _segments(self) -> list[int]:
        jvm = self.spark._jvm
        top = jvm.org.apache.hadoop.fs.Path(f"{self.path}/items")
        fs = top.getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = [s.getPath().getName() for s in fs.listStatus(top)]
        done = [n for n in names if fs.exists(jvm.org.apache.hadoop.fs.Path(f"{self.path}/items/{n}/_SUCCESS"))]
        return sorted(int(n.split("=")[1]) for n in done)

    def items(self, cells: list[int] | None = None, *columns: str) -> DataFrame:
        """cell, id and `columns` of the rows that count, of these cells or all. Only their files are read, and only these columns."""
        parts: list[DataFrame] = []
        for s in self._segments():
            if s not in self._read:
                self._read[s] = self.spark.read.schema(self.schema).parquet(f"{self.path}/items/segment={s:06d}")
            part = self._read[s]
            part = part if cells is None else part.where(F.col("cell").isin(cells))
            parts.append(part.select("cell", "id", *columns, "gone", F.lit(s).alias("segment")))
        if len(parts) == 1:
            return parts[0].where("NOT gone").drop("gone", "segment")
        both = parts[0]
        for p in parts[1:]:
            both = both.unionByName(p)
        newest = both.groupBy("cell", "id").agg(F.max_by(F.struct("gone", *columns), "segment").alias("r"))
        return newest.where("NOT r.gone").select("cell", "id", *[f"r.{c}" for c in columns])

    def upsert(self, rows: DataFrame, key: str = "id", vector: str = "vector") -> None:
        """New and changed rows join their cells; where one was in another cell, it is gone from there. A null vector takes the row out."""
        new = _encoded(_directed(rows, key, vector), self.model).withColumn("gone", F.lit(False))
        new = cut(new, "vectors")
        ids = rows.select(F.col(key).alias("id")).distinct()
        left = self.items().join(ids, "id").join(new.select("id", "cell"), ["id", "cell"], "left_anti")
        marks = left.select("cell", "id", F.lit(None).cast("double").alias("angle"), F.lit(None).cast("binary").alias("code"), F.lit(None).cast("array<double>").alias("vector"), F.lit(True).alias("gone"))
        _write(new.unionByName(marks), f"{self.path}/items/segment={self._next():06d}")

    def _next(self) -> int:
        return (self._segments() or [-1])[-1] + 1

    def compact(self) -> VectorIndex:
        """The index without its history, in a folder beside it."""
        path = f"{self.path}-{uuid.uuid4().hex[:8]}"
        for name in ("cells", "scale"):
            self.spark.read.parquet(f"{self.path}/{name}").coalesce(1).write.parquet(f"{path}/{name}")
        _write(self.items(None, "angle", "code", "vector").withColumn("gone", F.lit(False)), f"{path}/items/segment={0:06d}")
        return VectorIndex(self.spark, path)

    def _probes(self, queries: DataFrame, probes: int) -> DataFrame:
        """query, qv (its vector) and cells: the `probes` cells with the nearest centroids."""
        model, kind = self.model, queries.schema["id"].dataType.simpleString()
        n = min(probes, len(model.centroids))

        def run(frames):
            for f in frames:
                if len(f) and n:
                    scores = unit_rows(np.stack(f["vector"].to_numpy())) @ model.centroids.T
                    near = np.argpartition(-scores, n - 1, axis=1)[:, :n]
                    yield pd.DataFrame({"query": f["id"], "qv": f["vector"], "cells": list(near.astype(np.int32))})

        return queries.mapInPandas(run, f"query {kind}, qv array<double>, cells array<int>")

    def search(self, queries: DataFrame, k: int, key: str = "id", vector: str = "vector", probes: int | None = None, min_score: float = -1.0) -> DataFrame:
        """query_id, item_id, score (exact cosine) and rank of the k best items that `probes` cells (by default those that enough_probes() found) hold for each query, ties by item.

        Codes give the OVERFETCH * k best; their vectors are read and compared exactly. Items and queries meet in blocks of many small cells or of a part of a
        crowded one, so neither a crowded cell nor a popular one is a single group.
        """
        probed = cut(self._probes(_directed(queries, key, vector), probes or self.model.probes), "probes")
        best = cut(_top(self._compared(probed, k * OVERFETCH, "code"), k * OVERFETCH), "best")
        items = self.items([r["cell"] for r in best.select("cell").distinct().collect()], "vector")  # a number for each cell
        sources = _directed(queries, key, vector).select(F.col("id").alias("query"), F.col("vector").alias("qv"))
        full = best.select("query", "cell", F.col("item").alias("id")).join(items, ["cell", "id"]).join(sources, "query")
        exact = full.select("query", "cell", F.col("id").alias("item"), V.cosine(F.col("vector"), F.col("qv")).alias("score"))
        return _named(_top(exact.where(F.col("score") >= min_score), k))

    def search_exact(self, queries: DataFrame, k: int, key: str = "id", vector: str = "vector", probes: int | None = None, min_score: float = -1.0, digits: int | None = None) -> DataFrame:
        """As search(), and complete: the k best of all items. With `digits` the scores are rounded before they are compared with min_score and with each other.

        The nearest cells give k scores; a cell can hold a better item only if the angle between the query and its centroid, less the widest angle in the cell,
        allows it. Those cells are compared too, all others are never read.
        """
        ready, probes = _directed(queries, key, vector), probes or self.model.probes
        probed = cut(self._probes(ready, probes), "probes")
        first = cut(_top(self._compared(probed, k, "vector", digits), k), "first")
        floors = first.groupBy("query").agg(F.min("score").alias("floor"), F.count("*").alias("n"))
        ranges = self.items(None, "angle").groupBy("cell").agg(F.max("angle").alias("angle")).toPandas()  # a row for each cell
        model, kind = self.model, ready.schema["id"].dataType.simpleString()
        angles = np.full(len(model.centroids), -1.0)  # cells without rows are never needed
        angles[ranges["cell"].to_numpy(int)] = ranges["angle"].to_numpy()
        slack = 1e-9 + (0.0 if digits is None else 10.0**-digits)  # a score may be rounded up to the floor

        def run(frames):
            for f in frames:
                if len(f) and len(angles):
                    scores = unit_rows(np.stack(f["vector"].to_numpy())) @ model.centroids.T
                    done = np.argpartition(-scores, min(probes, scores.shape[1]) - 1, axis=1)[:, :probes]
                    reach = np.cos(np.maximum(0, np.arccos(np.clip(scores, -1, 1)) - angles)) + slack
                    need = (reach >= np.maximum(f["floor"].to_numpy(float), min_score)[:, None]) & (angles >= 0)
                    np.put_along_axis(need, done, False, axis=1)
                    some = need.any(1)
                    if not some.any():
                        continue
                    yield pd.DataFrame({"query": f["id"][some], "qv": f["vector"][some], "cells": [np.flatnonzero(r).astype(np.int32) for r in need[some]]})

        open_ = ready.join(floors.withColumnRenamed("query", "id"), "id", "left").select("id", "vector", F.when(F.col("n") < k, -1.0).otherwise(F.coalesce("floor", F.lit(-1.0))).alias("floor"))
        more = cut(open_.mapInPandas(run, f"query {kind}, qv array<double>, cells array<int>"), "probes")
        every = first.unionByName(_top(self._compared(more, k, "vector", digits), k))
        return _named(_top(every.where(F.col("score") >= min_score), k))

    def _blocks(self) -> tuple[np.ndarray, np.ndarray]:
        """For each cell its first block of about ITEM_BLOCK rows and how many it fills: cells are gathered in blocks in their order, a cell of more rows has blocks of its own. -1 and 0 for empty cells."""
        counts = self.items().groupBy("cell").count().toPandas()  # a row for each cell
        first, parts = np.full(len(self.model.centroids), -1), np.zeros(len(self.model.centroids), int)
        block, room = -1, 0
        for cell, n in sorted(zip(counts["cell"], counts["count"], strict=True)):
            parts[cell] = -(-n // ITEM_BLOCK)
            if n > room:
                first[cell], room = block + 1, max(0, ITEM_BLOCK - n)
                block += parts[cell]
            else:
                first[cell], room = block, room - n
        return first, parts

    def _compared(self, probed: DataFrame, k: int, by: str, digits: int | None = None) -> DataFrame:
        """query, cell, item and score: the k best of each block of items for each query that probes cells in it, by `code` or by `vector`. probed: query, qv, cells.
        Of scores that are equal, to `digits` if given, the least items are kept."""
        model, (first, parts) = self.model, self._blocks()
        kind, item_kind = probed.schema["query"].dataType.simpleString(), self.schema.split(",")[0].split(" ", 1)[1]
        tile, query_block = TILE, QUERY_BLOCK

        def deal(frames):
            for f in frames:
                out = []
                for q, v, cells in zip(f["query"], f["qv"], f["cells"], strict=True):
                    cells = np.sort(cells[parts[cells] > 0])
                    at, begins = np.unique(first[cells], return_index=True)
                    for block, group in zip(at, np.split(cells, begins[1:]), strict=False):
                        out += [(q, v, int(block) + i, group) for i in range(parts[group[0]])]
                if out:
                    yield pd.DataFrame(out, columns=["query", "qv", "block", "cells"])

        asked = cut(probed.mapInPandas(deal, f"query {kind}, qv array<double>, block int, cells array<int>"), "asked")
        blocks = cut(asked.groupBy("block").agg(F.ceil(F.count("*") / query_block).cast("int").alias("qn")), "blocks")
        groups = blocks.agg(F.coalesce(F.sum("qn"), F.lit(0))).first()[0]
        tasks = max(1, min(2000, 3 * groups))  # a number of its own, as groups are few bytes and much work
        held = [(int(c), int(first[c]), int(parts[c])) for c in np.flatnonzero(parts)]
        places = F.broadcast(self.spark.createDataFrame(held, "cell int, first int, n int"))  # MOST_CELLS rows at most
        placed = self.items(None, by).join(places, "cell").select("cell", "id", by, (F.col("first") + F.pmod(F.xxhash64("id"), "n")).cast("int").alias("block"))
        left = placed.join(F.broadcast(blocks), "block").select("cell", "id", by, "block", F.explode(F.sequence(F.lit(0), F.col("qn") - 1)).alias("part")).repartition(tasks, "block", "part")
        right = asked.join(F.broadcast(blocks), "block").select("block", "query", "qv", "cells", F.pmod(F.xxhash64("query"), "qn").cast("int").alias("part")).repartition(tasks, "block", "part")

        def run(key: tuple, own: pd.DataFrame, asking: pd.DataFrame) -> pd.DataFrame:
            if not len(own) or not len(asking):
                return pd.DataFrame({"query": asking["query"][:0], "cell": own["cell"][:0], "item": own["id"][:0], "score": np.zeros(0)})
            own = own.sort_values("id", kind="stable")
            ids, cells, queries = own["id"].to_numpy(), own["cell"].to_numpy(), asking["query"].to_numpy()
            if by == "code":
                found = model.centroids[cells] + np.stack([np.frombuffer(c, np.int8) for c in own["code"]]) * model.steps
            else:
                found = unit_rows(np.stack(own["vector"].to_numpy()))
            units = unit_rows(np.stack(asking["qv"].to_numpy()))
            known, place = np.unique(cells, return_inverse=True)
            probes = np.stack([np.isin(known, c) for c in asking["cells"]])
            out = []
            for at in range(0, len(units), tile):
                scores = _rounded(np.clip(units[at : at + tile] @ found.T, -1, 1), digits)
                scores[~probes[at : at + tile][:, place] | np.isnan(scores)] = -np.inf
                least = np.partition(scores, -k, axis=1)[:, -k] if scores.shape[1] > k else np.full(len(scores), -2.0)
                q, i = np.nonzero(scores >= np.maximum(least, -2.0)[:, None])
                order = np.lexsort((i, -scores[q, i], q))  # of equals the least id
                q, i = q[order], i[order]
                kept = np.arange(len(q)) - np.searchsorted(q, q) < k
                q, i = q[kept], i[kept]
                out.append(pd.DataFrame({"query": queries[q + at], "cell": cells[i], "item": ids[i], "score": scores[q, i]}))
            return pd.concat(out, ignore_index=True)

        both = left.groupBy("block", "part").cogroup(right.groupBy("block", "part"))
        return both.applyInPandas(run, f"query {kind}, cell int, item {item_kind}, score double")


def _rounded(scores: np.ndarray, digits: int | None) -> np.ndarray:
    """To `digits`, halves away from zero as in SQL; without, to 12, so that equal vectors tie wherever they stand."""
    if digits is None:
        return np.round(scores, 12)
    return np.sign(scores) * np.floor(np.abs(scores) * 10.0**digits + 0.5) / 10.0**digits


def _top(scored: DataFrame, k: int) -> DataFrame:
    order = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "item"))
    return scored.withColumn("rank", order).where(F.col("rank") <= k).drop("rank")


def _named(top: DataFrame) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "item"))
    return top.select(F.col("query").alias("query_id"), F.col("item").alias("item_id"), "score", rank.alias("rank"))


def _write(rows: DataFrame, path: str) -> None:
    rows = cut(rows, "encoded")
    files = rows.groupBy("cell").agg(F.ceil(F.count("*") / FILE_ROWS).cast("int").alias("files"))  # MOST_CELLS rows at most
    dealt = rows.join(F.broadcast(files), "cell").withColumn("files", F.pmod(F.xxhash64("id"), "files"))
    dealt.repartition("cell", "files").drop("files").sortWithinPartitions("cell", "id").write.partitionBy("cell").parquet(path)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """queries, and the share of the exact neighbours (query_id, item_id) that were found."""
    hits = exact.join(found.select("query_id", "item_id", F.lit(1).alias("hit")), ["query_id", "item_id"], "left")
    return hits.agg(F.countDistinct("query_id").alias("queries"), F.avg(F.coalesce("hit", F.lit(0))).alias("recall"))


def temporary(spark: SparkSession) -> str:
    """A new folder for an index, in the shared folder."""
    return f"{shared_dir(spark)}/docweave-index-{uuid.uuid4().hex[:12]}"
