"""Bounded, repeatable samples of labelled rows for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Steps of the scale on which a row's hash decides whether it is in a sample.
SCALE = 1_000_000


def bounded(rows: DataFrame, key: Column, bound: int, salt: int = 0) -> DataFrame:
    """All rows if there are at most `bound`, else about that many, chosen by a hash of their key."""
    n = rows.count()
    if n <= bound:
        return rows
    return rows.where(F.pmod(F.xxhash64(key, F.lit(salt)), F.lit(SCALE)) < int(SCALE * bound / n))


def labelled(docs: DataFrame, labels: DataFrame, label: str, train: Column, bound: int, id_col: str, text_col: str) -> DataFrame:
    """id, text and y of about `bound` labelled training rows at most, labels in their own proportion. train: a condition on the id.

    Rows without an id or a label are left out; of several labels of one id the largest counts.
    Only the sampled labels, which `bound` limits, are broadcast to find their texts.
    """
    known = labels.where(F.col(id_col).isNotNull() & F.col(label).isNotNull()).where(train).groupBy(id_col).agg(F.max(label).alias("y"))
    chosen = bounded(known, F.col(id_col), bound).select(F.col(id_col).alias("id"), "y")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.join(F.broadcast(chosen), "id").select("id", "text", "y")
