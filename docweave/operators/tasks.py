"""Task queue and document records as tables: every change is a query that gives the new table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.lineage import cut
from docweave.sources import tables

KEY = ["kg_id", "source", "chunk_index"]


def enqueue(tasks: DataFrame, new: DataFrame) -> DataFrame:
    """Adds the keys that aren't there yet as pending; those there keep their status."""
    fresh = new.select(*KEY).distinct().join(tasks.select(*KEY), KEY, "left_anti")
    return tasks.select(*KEY, "status").unionByName(fresh.withColumn("status", F.lit("pending")))


def update_status(tasks: DataFrame, changes: DataFrame) -> DataFrame:
    """Sets the status of the keys in changes; unknown keys change nothing."""
    new = changes.select(*KEY, F.col("status").alias("new_status"))
    return tasks.join(new, KEY, "left").select(*KEY, F.coalesce("new_status", "status").alias("status"))


def stamp(rows: DataFrame, at: Column | None = None, column: str = "updated_at") -> DataFrame:
    """rows with the time of a change as ISO text in UTC to the second; by default the time at which the query starts, the same for all rows."""
    at = F.current_timestamp() if at is None else at
    return rows.withColumn(column, F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss"))


def next_pending(tasks: DataFrame, kg_id=None) -> DataFrame:
    """The pending task with the lowest chunk index, ties by collection and source; one row at most."""
    rows = tasks.where("status = 'pending'")
    rows = rows if kg_id is None else rows.where(F.col("kg_id") == kg_id)
    return rows.select(*KEY, "status").orderBy("chunk_index", "kg_id", "source").limit(1)


def reset_stuck(tasks: DataFrame) -> DataFrame:
    return tasks.withColumn("status", F.when(F.col("status") == "processing", "pending").otherwise(F.col("status")))


def rebuild(records: DataFrame) -> DataFrame:
    """Pending tasks for the chunks after each record's progress; completed records and those without chunks have none."""
    total = F.coalesce("svo_total_chunks", "total_chunks")
    open_ = records.where((F.col("extraction_status") != "completed") & (total > 0) & (F.col("chunk_progress") < total))
    return open_.select("kg_id", "source", F.explode(F.sequence(F.col("chunk_progress") + 1, total)).alias("chunk_index"), F.lit("pending").alias("status"))


def init_records(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Records after (re-)chunking. A record stays; if its number of chunks changed, the vector, normalisation and window total are cleared.

    existing: source, total_chunks, svo_total_chunks, normalization_status, normalization_progress, document_vector; incoming: source, total_chunks.
    """
    new = incoming.select("source", F.col("total_chunks").alias("new_total"))
    changed = F.col("new_total").isNotNull() & ~F.col("total_chunks").eqNullSafe(F.col("new_total"))
    clear = lambda c, to: F.when(changed, F.lit(to)).otherwise(F.col(c)).alias(c)
    return existing.join(new, "source", "full").select(
        "source", F.coalesce("new_total", "total_chunks").alias("total_chunks"), clear("svo_total_chunks", None),
        clear("normalization_status", "pending"), clear("normalization_progress", 0), clear("document_vector", None),
    )


def set_progress(records: DataFrame, progress: DataFrame) -> DataFrame:
    """Normalisation progress by source; a value below 0 or above the total is an error."""
    new = progress.select("source", F.col("progress").alias("new_progress"))
    ok = F.col("new_progress").isNull() | F.col("new_progress").between(0, F.col("total_sentences"))
    out = records.join(new, "source", "left")
    checked = F.when(ok, F.coalesce("new_progress", "normalization_progress")).otherwise(F.raise_error(F.lit("progress out of range")).cast("int"))
    done = F.when(F.col("new_progress") == F.col("total_sentences"), "completed").when(F.col("new_progress").isNotNull(), "processing").otherwise(F.col("normalization_status"))
    return out.select("source", "total_sentences", checked.alias("normalization_progress"), done.alias("normalization_status"))


def set_vectors(records: DataFrame, vectors: DataFrame) -> DataFrame:
    """Keeps (source, vector) in the records; a source without a record is passed over."""
    return records.join(vectors.select("source", F.col("vector").alias("__v")), "source", "left").select(*[F.coalesce("__v", c).alias(c) if c == "document_vector" else F.col(c) for c in records.columns])


def set_window_total(records: DataFrame, totals: DataFrame) -> DataFrame:
    """Sets svo_total_chunks from (source, total); a source without a record is passed over, a negative total is an error when the result is read."""
    checked = F.when(F.col("__t") < 0, F.raise_error(F.lit("a total is negative")).cast("int")).otherwise(F.coalesce(F.col("__t").cast("int"), "svo_total_chunks"))
    out = records.join(totals.select("source", F.col("total").alias("__t")), "source", "left")
    return out.select(*[checked.alias(c) if c == "svo_total_chunks" else F.col(c) for c in records.columns])


def ensure_ready(spark: SparkSession, path: str, records: DataFrame) -> DataFrame:
    """The stored queue after a restart: if it can be read, what was being worked on is pending again; else the queue is rebuilt from the records. Stored and returned."""
    ready = reset_stuck(tables.read(spark, path, "tasks")) if tables.readable(spark, path, "tasks") else rebuild(records)
    ready = cut(ready, "tasks")
    tables.write(ready, path, "tasks", None)
    return tables.read(spark, path, "tasks")


def append_assignment(records: DataFrame, assigned: DataFrame) -> DataFrame:
    """Appends (kg_id, kg_name, method, assigned_at) to each source's history, resets its extraction, and makes a record where there is none."""
    new = assigned.groupBy("source").agg(F.sort_array(F.collect_list(F.struct("assigned_at", "kg_id", "kg_name", "method"))).alias("e"))
    new = new.select("source", F.transform("e", lambda x: F.struct(x["kg_id"], x["kg_name"], x["method"], x["assigned_at"])).cast(_history(assigned)).alias("new"))
    out = records.join(new, "source", "full")
    empty = F.array().cast(_history(assigned))
    return out.select(
        "source", F.concat(F.coalesce("assignment_history", empty), F.coalesce("new", empty)).alias("assignment_history"),
        F.when(F.col("new").isNotNull(), "pending").otherwise(F.col("extraction_status")).alias("extraction_status"),
        F.when(F.col("new").isNotNull(), 0).otherwise(F.col("chunk_progress")).alias("chunk_progress"),
    )


def _history(assigned: DataFrame) -> str:
    kinds = {f.name: f.dataType.simpleString() for f in assigned.schema}
    return f"array<struct<kg_id:{kinds['kg_id']},kg_name:{kinds['kg_name']},method:string,assigned_at:{kinds['assigned_at']}>>"


def latest_by_key(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The newest row of each key: an upsert where later rows win."""
    rest = [c for c in rows.columns if c not in keys]
    newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(order)).alias("r"))
    return newest.select(*keys, "r.*")


def check_and_register(meta: DataFrame, provider: str, model: str, dim: int) -> DataFrame:
    """The table of the embedding space (provider, model, dim) after a start with these settings: an empty one gets its row, an equal one
    stays; rows of another space are an error when the table is read, as their vectors can't be compared with new ones."""
    own = meta.sparkSession.createDataFrame([(provider, model, dim)], "provider string, model string, dim int")
    same = F.col("provider").eqNullSafe(F.lit(provider)) & F.col("model").eqNullSafe(F.lit(model)) & F.col("dim").eqNullSafe(F.lit(dim))
    message = F.format_string(f"vectors are from %s/%s (%s), not from {provider}/{model} ({dim})", "provider", "model", F.col("dim").cast("string"))
    checked = meta.select(F.when(same, F.col("provider")).otherwise(F.raise_error(message).cast("string")).alias("provider"), "model", F.col("dim").cast("int").alias("dim"))
    return checked.unionByName(own).distinct()


def embedding_guard(meta: DataFrame, provider: str, model: str, dim: int) -> Column:
    """registered (no row yet), ok, or mismatch, as a state; check_and_register() makes the row and raises."""
    same = (F.col("provider") == provider) & (F.col("model") == model) & (F.col("dim") == dim)
    return F.when(F.count("*") == 0, "registered").when(F.min(same.cast("int")) == 1, "ok").otherwise("mismatch")
