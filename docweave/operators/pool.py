"""The pool of documents without a collection: suggestions from clusters, and what stays outside."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docweave import providers
from docweave.config import DEFAULTS
from docweave.functions import text as T
from docweave.operators import classify, clusters

#: Names and concepts that a prompt lists at most; concepts that are looked for.
MOST_NAMES, MOST_CONCEPTS, CONCEPTS = 10, 20, 15


def top_concepts(bodies: DataFrame, keys: list[str], body: str = "body", n: int = CONCEPTS, order: str | None = None) -> DataFrame:
    """keys and concepts: the n most frequent tokens. Of equally frequent ones the first to occur comes first, bodies being in order of the column `order`; without it ties go
    by code point. Counts are combined in the tasks."""
    place = F.struct(F.col(order).alias("o"), F.col("pos")) if order else F.lit(0)
    tokens = bodies.select(*dict.fromkeys([*keys, *([order] if order else [])]), F.posexplode(T.concept_tokens(F.col(body))).alias("pos", "token"))
    counts = tokens.groupBy(*keys, "token").agg(F.count("*").alias("c"), F.min(place).alias("place"))
    first = counts.withColumn("r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("c"), "place", "token"))).where(F.col("r") <= n)
    return first.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("r", "token"))), lambda x: x["token"]).alias("concepts"))


def naming_prompt(names: Column, concepts: Column) -> Column:
    """Asks for a name and a description of documents with these names and concepts, of which it lists MOST_NAMES and MOST_CONCEPTS."""
    listed = F.array_join(F.transform(F.slice(names, 1, MOST_NAMES), lambda n: F.concat(F.lit("- "), n)), "\n")
    return F.concat(
        F.lit("請替下列文件取一個知識庫名稱，並寫一句描述。\n文件：\n"), listed, F.lit("\n關鍵概念："), F.array_join(F.slice(concepts, 1, MOST_CONCEPTS), "、"),
        F.lit("\n請只回兩行：\n名稱：（2 到 8 個字）\n描述：（一句話）"))


def unclustered(labels: DataFrame, item: str = "item") -> DataFrame:
    """The items that are noise or have no vector, in order."""
    return labels.where("label < 0").select(item).orderBy(item)


def naming_basis(labels: DataFrame, rows: DataFrame, pool: str, item: str, vector: str = "vector", least: int = DEFAULTS.cluster_min_size) -> DataFrame:
    """pool, label and item of the members a cluster is named by: those of its largest cluster when it is clustered again, all of them if there is none."""
    inner = labels.where("label >= 0").join(rows.select(item, vector), item).select(F.struct(pool, "label").alias("__cluster"), item, vector)
    again = clusters.cluster_pool(inner.withColumn("__key", F.to_json("__cluster")), "__key", item, vector, least)
    main = clusters.dominant_label(again, "__key", item).select(F.col("__key").alias("__k"), F.col("label").alias("__main"))
    of = inner.select(F.to_json("__cluster").alias("__key"), "__cluster", item)
    both = of.join(again.select("__key", F.col(item).alias("__item"), F.col("label").alias("__l")), (F.col("__item") == of[item]) & (again["__key"] == of["__key"])).drop(again["__key"])
    kept = both.join(main, F.col("__key") == F.col("__k"), "left").where(F.col("__main").isNull() | (F.col("__main") == F.col("__l")))
    return kept.select(f"__cluster.{pool}", "__cluster.label", item)


def analyze(rows: DataFrame, bodies: DataFrame, pool: str = "pool", item: str = "item", vector: str = "vector", model: providers.LanguageModel | None = None, least: int = DEFAULTS.cluster_min_size) -> DataFrame:
    """A suggestion for each cluster of each pool: pool, label, members, basis (the members it is named by), concepts, intra_similarity
    (to four places), name and description. rows: pool, item, vector; bodies: item, body. Without a model, or if it fails, the name is the default."""
    labels = clusters.cluster_pool(rows, pool, item, vector, least)
    basis = naming_basis(labels, rows, pool, item, vector, least)
    keys = [pool, "label"]
    listed = lambda df, name: df.groupBy(*keys).agg(F.sort_array(F.collect_list(F.col(item).cast("string"))).alias(name))
    inside = labels.where("label >= 0")
    alike = classify.mean_pairwise_cosine(inside.join(rows.select(item, vector), item).withColumn("__cluster", F.struct(*keys)), "__cluster", vector)
    alike = alike.select(f"__cluster.{pool}", "__cluster.label", F.round("intra_similarity", 4).alias("intra_similarity"))
    concepts = top_concepts(basis.join(bodies, item), keys, order=item)
    out = listed(inside, "members").join(listed(basis, "basis"), keys).join(alike, keys).join(concepts, keys, "left")
    out = out.withColumn("concepts", F.coalesce("concepts", F.array().cast("array<string>")))
    if model is None:
        out = out.withColumn("reply", F.lit("").cast("string"))
    else:
        out = providers.generate(out.withColumn("__prompt", naming_prompt(F.col("basis"), F.col("concepts"))), "__prompt", model).drop("__prompt", "reply_error")
    name, description = T.naming_reply(F.coalesce("reply", F.lit("")))
    return out.select(*keys, "members", "basis", "concepts", "intra_similarity", name.alias("name"), description.alias("description"))
