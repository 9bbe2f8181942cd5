"""Pairs of vectors within an angle, without all pairs.

Rows belong to the nearest of a few pivots. For a pair within the angle, the second row is no further than the angle from the cell of the first; how far it is from a cell
that isn't its own follows exactly from the two pivots: the cell lies behind the plane between them. So a row travels to its own cell and to those that near, and most cells never
meet. Where vectors have no groups and rows would travel to many cells, there is one cell. Within a cell rows meet in blocks, so that a crowded cell is many groups.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.functions import vectors as V
from docweave.lineage import cut
from docweave.session import ship

#: Pivots at most (they are sent to every task), rows for each pivot, about, and rows of a block.
MOST_PIVOTS, PIVOT_ROWS, BLOCK = 256, 400, 4_000
#: Cells that a row may travel to on average, the rows on which that is measured, and rows whose cosines, or whose copies, a task holds at once.
MOST_COPIES, TRIED, TILE, SENT = 8, 500, 500, 5_000


def pivots_of(rows: DataFrame, number: int) -> np.ndarray:
    """Unit vectors of `number` rows, those with the least hashes of their vectors, each once."""
    found = rows.select("vector").distinct().select("vector", F.xxhash64("vector").alias("h")).orderBy("h").limit(number).select("vector").toPandas()["vector"]
    x = np.stack(found.to_numpy())
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def near_cells(units: np.ndarray, pivots: np.ndarray, angle: float) -> tuple[np.ndarray, np.ndarray]:
    """The own cell of each row, and for each row and cell whether the cell can hold a row within the angle."""
    scores = units @ pivots.T
    own = scores.argmax(1)
    apart = np.linalg.norm(pivots[own][:, None] - pivots[None], axis=2)
    behind = (scores.max(1)[:, None] - scores) / np.maximum(apart, 1e-12)  # sine of the angle to the plane between the two pivots
    near = behind <= math.sin(min(angle, math.pi / 2)) + 1e-9
    near[np.arange(len(own)), own] = True
    return own, near


def cells(rows: DataFrame, pivots: np.ndarray, angle: float, keys: list[str], columns: str) -> DataFrame:
    """rows with `cell` and `own`: once in their own cell and once in each other that is near. columns: the schema of rows."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                x = np.stack(f["vector"].to_numpy())
                own, near = near_cells(x / np.linalg.norm(x, axis=1, keepdims=True), pivots, angle)
                every = np.nonzero(near)
                for at in range(0, len(every[0]), SENT):
                    row, cell = (e[at : at + SENT] for e in every)
                    yield pd.DataFrame({c: f[c].to_numpy()[row] for c in f.columns} | {"cell": cell.astype(np.int32), "own": cell == own[row]})

    return rows.mapInPandas(run, f"{columns}, cell int, own boolean")


def pairs_within(rows: DataFrame, keys: list[str], least: float) -> DataFrame:
    """keys, name, other, other_ord and cosine of every pair of rows with equal keys (none null) whose cosine is `least` or more and above 0, `other` being the earlier by (ord, name).
    rows: keys, name, ord, vector; names are unique within the keys; rows without direction have no partner."""
    ship(rows.sparkSession)
    n = V.norm(F.col("vector"))
    full = rows.where(F.col("vector").isNotNull()).where(n >= 1e-9)
    for k in keys:
        full = full.where(F.col(k).isNotNull())
    full = cut(full.select(*keys, "name", "ord", "vector"), "rows")
    kind = {f.name: f.dataType.simpleString() for f in full.schema.fields}
    total = full.count()
    out = ", ".join(f"`{k}` {kind[k]}" for k in keys) + f", name {kind['name']}, other {kind['name']}, other_ord {kind['ord']}, cosine double"
    if not total:
        return rows.sparkSession.createDataFrame([], out)
    angle, number = math.acos(max(-1.0, min(1.0, least))), max(1, min(MOST_PIVOTS, total // PIVOT_ROWS))
    tried = pivots_of(full, number + TRIED)
    pivots = tried[:number]
    if near_cells(tried, pivots, angle)[1].sum(1).mean() > MOST_COPIES:
        pivots = tried[:1]
    columns = ", ".join(f"`{c}` {k}" for c, k in kind.items())
    placed = cut(cells(full, pivots, angle, keys, columns), "cells")
    sizes = placed.groupBy(*keys, "cell").agg(F.ceil(F.count_if("own") / BLOCK).cast("int").alias("mine"), F.ceil(F.count("*") / BLOCK).cast("int").alias("all")).where("mine > 0")
    sized = placed.join(sizes, [*keys, "cell"])
    mine = sized.where("own").select(*keys, "cell", F.pmod(F.xxhash64("name"), "mine").cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.col("all") - 1)).alias("j"), "name", "ord", "vector")
    others = sized.select(*keys, "cell", F.explode(F.sequence(F.lit(0), F.col("mine") - 1)).alias("i"), F.pmod(F.xxhash64("name", F.lit(1)), "all").cast("int").alias("j"), "name", "ord", "vector")
    group = [*keys, "cell", "i", "j"]
    others = others.toDF(*[f"o_{c}" for c in others.columns])

    def compare(key: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        found: dict = {c: [] for c in [*keys, "name", "other", "other_ord", "cosine"]}
        if len(a) and len(b):
            x, y = np.stack(a["vector"].to_numpy()), np.stack(b["o_vector"].to_numpy())
            x, y = x / np.linalg.norm(x, axis=1, keepdims=True), y / np.linalg.norm(y, axis=1, keepdims=True)
            ao, bo, an, bn = a["ord"].to_numpy(), b["o_ord"].to_numpy(), a["name"].to_numpy(), b["o_name"].to_numpy()
            parts = []
            for at in range(0, len(x), TILE):
                cos = np.clip(x[at : at + TILE] @ y.T, -1, 1)
                p, q = np.nonzero((cos >= least - 1e-12) & (cos > 0))
                c, p = cos[p, q], p + at
                before = (bo[q] < ao[p]) | ((bo[q] == ao[p]) & (bn[q] < an[p]))
                parts.append((p[before], q[before], c[before]))
            p, q, c = (np.concatenate(v) for v in zip(*parts, strict=True))
            found = {k: [key[i]] * len(p) for i, k in enumerate(keys)} | {"name": an[p], "other": bn[q], "other_ord": bo[q], "cosine": c}
        text = [*keys, "name", "other"]  # as objects: an empty column of strings has no chunk to send
        return pd.DataFrame({c: pd.Series(v, dtype=object) if c in text else v for c, v in found.items()})

    return mine.groupBy(*group).cogroup(others.groupBy(*[f"o_{c}" for c in group])).applyInPandas(compare, out)
