"""Registered queries of the task queue as a state machine, of the extraction trigger, and the same in SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.functions import text as T
from docweave.lineage import shared_dir
from docweave.streaming import queue
from docweave.streaming.trigger import ExtractionTrigger

from .queries import _SENTENCES, _STRIPPED, query, table

_EVENTS = """user_id % 4 AS kg_id, 's' || user_id AS source, CAST(event_id % 4 + 1 AS INT) AS chunk_index, event_id AS seq, ts,
CASE event_type WHEN 'signup' THEN 'pending' WHEN 'view' THEN 'processing' WHEN 'click' THEN 'pending_upload' WHEN 'purchase' THEN 'completed' ELSE 'failed' END AS status"""
#: Every task takes its events one by one; what is processing for twelve hours returns, at the end as of ten minutes before the last event.
_QUEUE_SQL = f"""WITH RECURSIVE a AS (SELECT {_EVENTS} FROM events), e AS (SELECT *, row_number() OVER (PARTITION BY kg_id, source, chunk_index ORDER BY ts, seq) AS r FROM a),
f AS (SELECT kg_id, source, chunk_index, CAST(0 AS BIGINT) AS r, CAST(NULL AS VARCHAR) AS st, TIMESTAMP '1970-01-01' AS since, 0 AS taken, 0 AS refused FROM (SELECT DISTINCT kg_id, source, chunk_index FROM e)
UNION ALL SELECT kg_id, source, chunk_index, r, CASE WHEN ok THEN asked ELSE st END, CASE WHEN ok THEN ts ELSE since END, taken + CAST(ok AS INT), refused + CAST(NOT ok AS INT)
FROM (SELECT *, ts >= since AND CASE WHEN st IS NULL THEN asked = 'pending' WHEN st = 'pending' THEN asked = 'processing' WHEN st = 'processing' THEN asked IN ('pending_upload', 'failed', 'pending')
  WHEN st = 'pending_upload' THEN asked IN ('completed', 'failed') WHEN st = 'failed' THEN asked = 'pending' ELSE false END AS ok
FROM (SELECT f.kg_id, f.source, f.chunk_index, e.r, e.ts, e.status AS asked, CASE WHEN back THEN 'pending' ELSE st END AS st, CASE WHEN back THEN since + INTERVAL 12 HOUR ELSE since END AS since, taken + CAST(back AS INT) AS taken, refused
FROM (SELECT f.*, e.r AS er, coalesce(f.st = 'processing' AND e.ts - f.since >= INTERVAL 12 HOUR, false) AS back FROM f JOIN e ON e.kg_id = f.kg_id AND e.source = f.source AND e.chunk_index = f.chunk_index AND e.r = f.r + 1) f
JOIN e ON e.kg_id = f.kg_id AND e.source = f.source AND e.chunk_index = f.chunk_index AND e.r = f.er))),
l AS (SELECT *, coalesce(st = 'processing' AND since + INTERVAL 12 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE, false) AS back FROM (SELECT *, row_number() OVER (PARTITION BY kg_id, source, chunk_index ORDER BY r DESC) AS last FROM f) WHERE last = 1)
SELECT kg_id, source, chunk_index, CASE WHEN back THEN 'pending' ELSE st END AS status, CAST(taken + CAST(back AS INT) AS BIGINT) AS taken, CAST(refused AS BIGINT) AS refused,
  CASE WHEN taken > 0 THEN strftime(CASE WHEN back THEN since + INTERVAL 12 HOUR ELSE since END, '%Y-%m-%dT%H:%M:%S') END AS updated_at FROM l"""
TIMEOUT, DELAY = "12 hours", "10 minutes"


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/docweave-{name}-{uuid.uuid4().hex[:12]}"


def _streamed(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table as a stream; a source of files takes a pattern, not a single file."""
    return spark.readStream.schema(table(spark, sf_dir, name).schema).parquet(f"{sf_dir}/{{{name}}}.parquet")


def _events(rows: DataFrame) -> DataFrame:
    return rows.withColumn("ts", F.col("ts").cast("timestamp")).selectExpr("user_id % 4 AS kg_id", "'s' || user_id AS source", "CAST(event_id % 4 + 1 AS INT) AS chunk_index", "event_id AS seq", "ts", _EVENTS[_EVENTS.index("CASE") :])


def _summary(steps: DataFrame) -> DataFrame:
    counts = steps.groupBy(*queue.KEY).agg(F.count_if("taken").alias("taken"), F.count_if(~F.col("taken")).alias("refused"))
    return counts.join(queue.current(steps), queue.KEY, "left").select(*queue.KEY, "status", "taken", "refused", F.date_format("updated_at", "yyyy-MM-dd'T'HH:mm:ss").alias("updated_at"))


@query(_QUEUE_SQL)
def task_queue_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _events(table(spark, sf_dir, "events"))
    until = events.selectExpr(f"unix_micros(max(ts) - INTERVAL {DELAY}) AS t").first()["t"]
    return _summary(queue.fold(events, TIMEOUT, until))


@query(_QUEUE_SQL)
def task_queue_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from a stream, with the state in the engine and timers for what is stuck."""
    where = _folder(spark, "queue")
    steps = queue.machine(_events(_streamed(spark, sf_dir, "events")), TIMEOUT, DELAY)
    steps.writeStream.format("parquet").outputMode("append").option("path", f"{where}/steps").option("checkpointLocation", f"{where}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return _summary(spark.read.schema(steps.schema).parquet(f"{where}/steps"))


@query(_SENTENCES + f""", n AS (SELECT doc_id, count(*) AS n FROM sent WHERE {_STRIPPED} <> '' GROUP BY doc_id)
SELECT d.source AS kg_id, CAST(d.doc_id AS VARCHAR) AS source, CASE WHEN n IS NULL THEN 0 ELSE CAST(greatest(ceil((n - 5) / 3.0), 0) AS INT) + 1 END AS svo_total_chunks,
  CASE WHEN n IS NULL THEN 0 ELSE CAST(greatest(ceil((n - 5) / 3.0), 0) AS BIGINT) + 1 END AS tasks FROM documents d LEFT JOIN n USING (doc_id)""")
def extraction_trigger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records and queue after a stream of documents, each assigned to the collection of its source."""
    where = _folder(spark, "trigger")
    trigger = ExtractionTrigger(spark, f"{where}/tables")
    docs = _streamed(spark, sf_dir, "documents").select(F.col("source").alias("kg_id"), F.col("doc_id").alias("source"), T.clean_sentences(T.sentences(F.col("text"))).alias("sentences"))
    trigger.start(docs, f"{where}/checkpoint").awaitTermination()
    counts = trigger.tasks().groupBy("kg_id", "source").agg(F.count("*").alias("tasks"))
    rows, same = trigger.records(), lambda c: F.col(f"r.{c}").eqNullSafe(F.col(f"c.{c}"))
    return rows.alias("r").join(counts.alias("c"), same("kg_id") & same("source"), "left").select("r.kg_id", "r.source", "svo_total_chunks", F.coalesce("tasks", F.lit(0)).alias("tasks"))
