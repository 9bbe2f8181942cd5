"""Extraction that is triggered by assignments, exactly once.

A stream of assigned documents changes two tables: a document's record gets the number of its windows, and each window a pending task. Both changes of a
batch are files of their own, and count from the moment the batch's number is in the ledger, which is one step. A driver that is lost between the two leaves files
that don't count; the replayed batch writes them anew, and one that is in the ledger already changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from docweave.functions import text as T
from docweave.session import ship

RECORDS = "kg_id string, source string, svo_total_chunks int, extraction_status string"
TASKS = "kg_id string, source string, chunk_index int, status string"


class ExtractionTrigger:
    """The tables `records` and `tasks` in a folder, and the ledger of the batches that count. The folder belongs to one checkpoint, whose batch numbers it knows."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self, path: str):
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return hadoop, hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def last(self) -> int:
        """The number of the last batch in the ledger; -1 before the first. Batches come in order, so all before it count as well."""
        _, fs = self._fs(self.path)
        found = fs.globStatus(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/ledger/*"))
        return max((int(f.getPath().getName()) for f in found or ()), default=-1)

    def apply(self, assigned: DataFrame, batch: int) -> None:
        """One batch of assignments (kg_id, source, sentences): for foreachBatch. Documents without sentences get no tasks and a total of 0.
        Between the two tables the batch is kept as numbers of windows, not as their sentences."""
        if batch <= self.last():
            return
        total = T.window_count(F.col("sentences"))
        rows = assigned.select(F.col("kg_id").cast("string").alias("kg_id"), F.col("source").cast("string").alias("source"), total.alias("svo_total_chunks"))
        rows = rows.persist()
        try:
            self._write(rows.withColumn("extraction_status", F.lit("pending")), "records", batch)
            numbers = F.explode(F.sequence(F.lit(1), "svo_total_chunks")).alias("chunk_index")
            self._write(rows.where("svo_total_chunks > 0").select("kg_id", "source", numbers, F.lit("pending").alias("status")), "tasks", batch)
            self._commit(batch)
        finally:
            rows.unpersist()

    def _write(self, rows: DataFrame, name: str, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.path}/{name}/batch={batch}")

    def _commit(self, batch: int) -> None:
        path, fs = self._fs(f"{self.path}/ledger/{batch}")
        fs.create(path, False).close()

    def _committed(self, name: str, schema: str) -> DataFrame:
        last = self.last()
        if last < 0:
            return self.spark.createDataFrame([], f"{schema}, batch long")
        return self.spark.read.schema(f"{schema}, batch long").parquet(f"{self.path}/{name}").where(F.col("batch") <= last)

    def records(self) -> DataFrame:
        """kg_id, source, svo_total_chunks and extraction_status: of each document as its last batch left it."""
        rows = self._committed("records", RECORDS)
        newest = rows.groupBy("kg_id", "source").agg(F.max_by(F.struct("svo_total_chunks", "extraction_status"), F.struct("batch", "svo_total_chunks")).alias("r"))
        return newest.select("kg_id", "source", "r.*")

    def tasks(self) -> DataFrame:
        """kg_id, source, chunk_index and status: a task that is there isn't added again."""
        return self._committed("tasks", TASKS).drop("batch").distinct()

    def start(self, stream: DataFrame, checkpoint: str) -> StreamingQuery:
        """Works through what the stream has and stops."""
        ship(self.spark)
        return stream.writeStream.foreachBatch(self.apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
