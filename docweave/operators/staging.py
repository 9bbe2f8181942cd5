"""From raw documents to staged tables, collections and windows ready for extraction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.config import DEFAULTS, PRONOUNS, RELATIONS
from docweave.functions import text as T
from docweave.lineage import cut
from docweave.sources import tables


def problem(source: Column, text: Column) -> Column:
    """Why a document can't be staged, or null: a blank source, or a text that gives no chunk."""
    blank = lambda c: T.strip(F.coalesce(c, F.lit(""))) == ""
    return F.when(blank(source), "source is blank").when(blank(text), "no chunks").cast("string")


def stage(docs: DataFrame, source: str = "source", text: str = "text") -> DataFrame:
    """source, error, folder, sentences, chunks and total_chunks of each document. A document with an error has no arrays; nothing is shuffled."""
    wrong = problem(F.col(source), F.col(text))
    out = docs.select(F.col(source).alias("source"), wrong.alias("error"), T.safe_stem(F.col(source)).alias("folder"), F.when(wrong.isNull(), T.sentences(F.col(text))).alias("sentences"))
    return out.withColumn("chunks", F.when(F.col("error").isNull(), T.chunks(F.col("sentences")))).withColumn("total_chunks", F.coalesce(F.size("chunks"), F.lit(0)))


def chunk_rows(staged: DataFrame) -> DataFrame:
    """A row for each chunk, with its file name and front matter, as they would be written."""
    rows = staged.where("error IS NULL").select("source", "folder", "total_chunks", F.posexplode("chunks").alias("i", "chunk")).withColumn("chunk_index", F.col("i") + 1)
    head = T.front_matter(source=F.col("source"), chunk_index=F.col("chunk_index"), total_chunks=F.col("total_chunks"))
    return rows.select(
        "source", "folder", "chunk_index", "total_chunks", "chunk", T.chunk_filename(F.col("chunk_index"), F.col("total_chunks")).alias("filename"),
        F.concat(head, F.lit("\n\n"), "chunk", F.lit("\n")).alias("file"))


def write_chunks(staged: DataFrame, path: str) -> None:
    """Stores chunk_rows() by folder. All chunks of the folders written are replaced, so none of an earlier, longer version stays; other folders stay as they are."""
    tables.write(chunk_rows(staged), path, "chunks", "folder")


def sentences_or_rebuild(sources: DataFrame, index: DataFrame, originals: DataFrame, key: str = "source") -> DataFrame:
    """Sentences of each source, a row for each, from the index, else from its original text; origin tells which. A source with neither has null sentences.
    Of a source that is stored more than once the greatest sentences or text count."""
    own = index.groupBy(key).agg(F.max("sentences").alias("stored"))
    raw = originals.groupBy(key).agg(F.max("text").alias("raw"))
    out = sources.select(key).distinct().join(own, key, "left").join(raw, key, "left")
    origin = F.when(F.col("stored").isNotNull(), "index").when(F.col("raw").isNotNull(), "original").otherwise("missing")
    return out.select(key, F.coalesce("stored", T.sentences(F.col("raw"))).alias("sentences"), origin.alias("origin"))


def required_sentences(spark: SparkSession, sources: DataFrame, index: str, originals: str, fetched: DataFrame | None = None) -> DataFrame:
    """kg_id, source and sentences of each of sources (kg_id, source): from the stored index, else from the stored text, else from `fetched` (kg_id, source, text, error), what a source of pages gave for
    addresses. What isn't in the index yet is stored there, what was fetched with its text as well, so that the next call finds it. A document that nothing gives
    is an error when the result is read.

    index and originals: folders of the tables `sentences` and `originals`, whose collections are rewritten with what is new.
    """
    key = ["kg_id", "source"]
    stored, texts = tables.read(spark, index, "sentences"), tables.read(spark, originals, "originals")
    wanted = sources.select(*key).distinct()
    missing = cut(wanted.join(stored, key, "left_anti"), "missing")
    found = missing.join(texts.select(*key, "text"), key, "left")
    if fetched is not None:
        pages = fetched.where("text IS NOT NULL").groupBy(*key).agg(F.max("text").alias("page"))
        found = cut(found.join(pages, key, "left"), "found")
        fresh = cut(found.where("text IS NULL AND page IS NOT NULL").select(*key, F.col("page").alias("text")), "fetched")
        _add(texts, fresh, originals, "originals")
        found = found.select(*key, F.coalesce("text", "page").alias("text"))
    rebuilt = cut(found.where("text IS NOT NULL").select(*key, T.sentences(F.col("text")).alias("sentences")).withColumn("total", F.size("sentences")), "rebuilt")
    kept = cut(wanted.join(stored.select(*key, "sentences"), key, "left"), "kept")
    _add(stored, rebuilt, index, "sentences")
    out = kept.join(rebuilt.select(*key, F.col("sentences").alias("__new")), key, "left").select(*key, F.coalesce("sentences", "__new").alias("sentences"))
    lost = F.raise_error(F.concat(F.lit("neither sentences nor text: "), F.col("source"))).cast("array<string>")
    return out.select(*key, F.when(F.col("sentences").isNull(), lost).otherwise(F.col("sentences")).alias("sentences"))


def _add(stored: DataFrame, new: DataFrame, path: str, name: str) -> None:
    """Rewrites the collections that get new rows, with their old rows and the new."""
    own = stored.join(new.select("kg_id").distinct(), "kg_id", "left_semi").join(new, ["kg_id", "source"], "left_anti")
    both = cut(own.select(*stored.columns).unionByName(new.select(*stored.columns)), name)
    if not both.isEmpty():
        tables.write(both, path, name)


def extraction_windows(sentences: DataFrame, key: str = "source", normalized: str = "normalized") -> DataFrame:
    """Windows of original and normalized sentences side by side, a row for each; arrays of different lengths are an error."""
    same = F.size("sentences") == F.size(normalized)
    checked = F.when(same, F.col("sentences")).otherwise(F.raise_error(F.lit("sentences and normalized sentences differ in number")).cast("array<string>"))
    pairs = F.arrays_zip(checked.alias("original"), F.col(normalized).alias("normalized"))
    rows = sentences.select(key, pairs.alias("p")).select(key, "p", F.explode(T.windows(F.transform("p", lambda x: x["original"]))).alias("w"))
    part = F.slice("p", F.col("w.sentence_start"), F.lit(DEFAULTS.window_sentences))
    return rows.select(key, "w.chunk_index", "w.total", "w.sentence_start", "w.sentence_end", F.transform(part, lambda x: x["original"]).alias("original"), F.transform(part, lambda x: x["normalized"]).alias("normalized"))


def assign(membership: DataFrame, moves: DataFrame) -> DataFrame:
    """The membership (source, kg_id) after moves of the same form: a source is in one collection, the one it was last moved to (moves.at decides)."""
    last = moves.groupBy("source").agg(F.max_by("kg_id", "at").alias("kg_id"))
    return membership.join(last, "source", "left_anti").select("source", "kg_id").unionByName(last)


def lexicon(custom: DataFrame, word: str = "word") -> DataFrame:
    """The default pronouns and a custom list, each once."""
    return custom.select(F.explode(F.array(*map(F.lit, PRONOUNS))).alias(word)).union(custom.select(word)).where(T.strip(F.col(word)) != "").distinct()


def strict_relation(rel: Column) -> Column:
    """The relation; one outside the vocabulary is an error."""
    return F.when(rel.isin(*RELATIONS), rel).otherwise(F.raise_error(F.concat(F.lit("unknown relation "), F.coalesce(rel, F.lit("null")))).cast("string"))


def create_collection(spark: SparkSession, name: str) -> None:
    spark.sql(f"CREATE DATABASE IF NOT EXISTS `{_checked(name)}`")


def drop_collection(spark: SparkSession, name: str) -> None:
    spark.sql(f"DROP DATABASE IF EXISTS `{_checked(name)}` CASCADE")


def list_collections(spark: SparkSession) -> list[str]:
    return sorted(d.name for d in spark.catalog.listDatabases() if d.name.startswith("kg"))


def _checked(name: str) -> str:
    if not name.startswith("kg") or not name.replace("_", "").isalnum():
        raise ValueError("a collection's name begins with kg and holds letters, digits and underscores")
    return name
