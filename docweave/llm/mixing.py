"""Mixing sources to target weights, in DataFrame functions only.

A source's target is met by whole passes over all its documents (epochs) and, for the rest, by a
weighted sample without replacement after Efraimidis and Spirakis: every document draws an exponential key divided by its
quality weight, documents are taken in ascending order of keys, and a prefix sum of their sizes
tells where the budget ends. The prefix sum is taken in two steps, over
slices of the key range and then within slices, so that a source of any size is spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

#: Weights of the sources in order of their names, repeating.
WEIGHTS = (5, 2, 1)
#: No document is taken more often.
MOST_EPOCHS = 3
#: Documents in a slice, about.
SLICE = 2000


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def quality_weight(text: Column) -> Column:
    """0.2 to 1: the share of letters and blanks in a text, squared; text full of marks and digits is drawn later."""
    plain = F.length(F.regexp_replace(text, "[^\\p{L} ]+", "")) / F.when(F.length(text) > 0, F.length(text))
    return F.greatest(F.lit(0.2), F.coalesce(plain * plain, F.lit(0.2)))


def exponential_key(key: Column, weight: Column, seed: int) -> Column:
    """-ln(u) / weight with u in (0, 1) from a hash of the id, the same in every run."""
    digits = F.substring(F.md5(F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(f":{seed}"))), 1, 13)
    u = (F.conv(digits, 16, 10).cast("long") + 0.5) / float(1 << 52)
    return -F.log(u) / weight


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """source, source_size, n_docs and target from (source, source_size, n_docs), a row for each source.

    Together the targets are all sizes. They follow the weights, but stop at MOST_EPOCHS times the source's size; what is above is
    shared out again by weight. In order of the size-to-weight ratio the full sources come first, so
    running sums give the level at which the others stand. Windows here run over one row for each source.
    """
    ranked = sizes.select("*", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())).alias("i"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("i") - 1, F.lit(len(weights))) + 1).cast("int"))
    order = Window.orderBy("ratio", "i")
    cap = F.col("source_size") * float(MOST_EPOCHS)
    level = (
        ranked.select("*", weight.alias("weight")).select("*", (cap / F.col("weight")).alias("ratio"))
        .select("*", F.sum(cap).over(order.rowsBetween(Window.unboundedPreceding, -1)).alias("full"),
                F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)).alias("open"), F.sum("source_size").over(Window.partitionBy()).alias("total"))
        .select("*", ((F.col("total") - F.coalesce("full", F.lit(0.0))) / F.col("open")).alias("level"))
    )
    # the level of the first source that isn't full holds for all that aren't
    first = F.min(F.when(F.col("ratio") >= F.col("level"), F.struct("ratio", "i", "level"))).over(Window.partitionBy())
    return level.select("*", first["level"].alias("at")).select("source", "source_size", "n_docs", F.least(cap, F.col("at") * F.col("weight")).alias("target"))


def plan(sized: DataFrame, scratch: Scratch, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """A row for each source: its target, epochs, and the last draw that the fractional part takes (null: none).

    sized: source, size, draw (a struct whose first field is the key, unique but for equal rows) and a weight.
    """
    sources = scratch.keep(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs")), weights).coalesce(1), "targets")
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    sources = sources.select("*", epochs.alias("epochs")).select("*", (F.col("target") - F.col("epochs") * F.col("source_size")).alias("budget"))
    own = sources.select(F.col("source").alias("own_source"), F.ceil(F.col("n_docs") / SLICE).alias("slices"), "budget")
    key = F.col("draw.key")
    slice_ = F.least(F.col("slices") - 1, F.floor(F.col("slices") * (1 - F.exp(-key))))
    placed = sized.join(own, sized["source"].eqNullSafe(own["own_source"])).select("source", "size", "draw", "budget", slice_.alias("slice"))
    sums = placed.groupBy("source", "slice").agg(F.sum("size").alias("sum"))
    before = sums.select(F.col("source").alias("b_source"), F.col("slice").alias("b_slice"), (F.sum("sum").over(Window.partitionBy("source").orderBy("slice")) - F.col("sum")).alias("before"))
    # only the slice in which the budget ends needs an order
    edge = placed.join(before, placed["source"].eqNullSafe(before["b_source"]) & (placed["slice"] == before["b_slice"]))
    within = Window.partitionBy("source", "slice").orderBy("draw").rowsBetween(Window.unboundedPreceding, -1)
    ordered = edge.where(F.col("before") <= F.col("budget")).select("source", "size", "draw", "budget", (F.col("before") + F.coalesce(F.sum("size").over(within), F.lit(0))).alias("before"))
    last = ordered.where((F.col("budget") > 0) & (F.col("before") + F.col("size") / 2 <= F.col("budget"))).groupBy("source").agg(F.max("draw").alias("last"))
    last = last.withColumnRenamed("source", "l_source")
    return scratch.keep(sources.join(last, sources["source"].eqNullSafe(last["l_source"]), "left").drop("l_source").coalesce(1), "plan")


def draws(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int, *keep: Column) -> DataFrame:
    text = F.col(text_col).cast("string")
    size, weight = n_words(text), quality_weight(text)
    ready = docs.select(*keep, F.col(id_col).alias("__id"), F.col(source_col).cast("string").alias("__source"), size.alias("__size"), weight.alias("__weight"), F.xxhash64(text).alias("__hash"))
    return ready.withColumn("__draw", F.struct(exponential_key(F.col("__id"), F.col("__weight"), seed).alias("key"), F.col("__id").alias("id"), F.col("__size").alias("size"), F.col("__hash").alias("hash")))


def _times() -> Column:
    return F.col("__epochs") + F.when(F.col("__draw") <= F.col("__last"), 1).otherwise(0)


def _of_source(plan_: DataFrame) -> DataFrame:
    return plan_.select(F.col("source").alias("__own"), F.col("source_size").alias("__source_size"), F.col("target").alias("__target"), F.col("epochs").alias("__epochs"), F.col("last").alias("__last"))


def takes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 17, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """id, size (words), source_size, target and taken (words, repeats counted) of each row of docs.

    A null text has size 0; null sources are one source, the last. Equal rows (one id, one text) draw one key and are taken together, which
    can pass the target by their size; ids may be null. Other columns are left out, whatever their names. Reruns agree. An empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "mix")
    drawn = scratch.keep(draws(docs, id_col, text_col, source_col, seed), "draws")
    made = _of_source(plan(drawn.select(F.col("__source").alias("source"), F.col("__size").alias("size"), F.col("__draw").alias("draw")), scratch, weights))
    out = drawn.join(made, drawn["__source"].eqNullSafe(made["__own"]))
    return out.select(F.col("__id").alias(id_col), F.col("__size").alias("size"), F.col("__source_size").alias("source_size"), F.col("__target").alias("target"), (_times() * F.col("__size")).alias("taken"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 17, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """The rows of docs with all their columns, each as often as takes() takes it. Texts stay where they are: only the plan, a row for each source, is joined.

    Rows without words come with the draws around them, at most MOST_EPOCHS times; nulls, ties, repeated rows and an empty table are as in takes().
    """
    scratch = Scratch(docs.sparkSession, "mix")
    drawn = scratch.keep(draws(docs, id_col, text_col, source_col, seed), "draws")
    made = _of_source(plan(drawn.select(F.col("__source").alias("source"), F.col("__size").alias("size"), F.col("__draw").alias("draw")), scratch, weights))
    again = draws(docs, id_col, text_col, source_col, seed, F.struct("*").alias("__row"))
    out = again.join(made, again["__source"].eqNullSafe(made["__own"]))
    return out.select("__row", F.explode(F.array_repeat(F.lit(1), _times().cast("int")))).select("__row.*")
