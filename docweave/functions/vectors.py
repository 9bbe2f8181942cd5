"""Vectors as arrays of doubles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Over the shorter length."""
    n = F.least(F.size(a), F.size(b))
    return F.aggregate(F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column, b: Column, na: Column | None = None, nb: Column | None = None) -> Column:
    """-1 to 1; 0 if either norm is below 1e-9. Norms can be handed in where a vector meets many others."""
    na, nb = norm(a) if na is None else na, norm(b) if nb is None else nb
    return F.when((na < 1e-9) | (nb < 1e-9), F.lit(0.0)).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / (na * nb))))


def as_double(v: Column) -> Column:
    return v.cast("array<double>")


def mean_vectors(rows: DataFrame, keys: list[str], vector: str, name: str = "vector") -> DataFrame:
    """keys, the element-wise mean and n: positions are averaged in the tasks before the shuffle, so a key of any size is no single group.
    Null vectors are left out; a key with none of them has no row."""
    every = rows.where(F.col(vector).isNotNull()).select(*keys, F.posexplode(vector).alias("i", "x"))
    means = every.groupBy(*keys, "i").agg(F.avg("x").alias("x"), F.count("*").alias("n"))
    out = means.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("v"), F.max("n").alias("n"))
    return out.select(*keys, F.transform("v", lambda e: e["x"]).alias(name), "n")


def updated_mean(old: Column, n: Column, new: Column) -> Column:
    """(old * n + new) / (n + 1); new if there was nothing before."""
    return F.when(old.isNull() | (n == 0), new).otherwise(F.zip_with(old, new, lambda o, x: (o * n + x) / (n + 1)))
