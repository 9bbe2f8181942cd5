"""Tables in files: sinks that overwrite only what they are given, readers that take a missing table for an empty one, and changes of rows."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Schemas of the stored tables.
SCHEMAS = {
    "chunks": "folder string, source string, chunk_index int, total_chunks int, chunk string, filename string, file string",
    "originals": "kg_id string, source string, text string",
    "sentences": "kg_id string, source string, sentences array<string>, total int",
    "windows": "kg_id string, source string, chunk_index int, total int, sentence_start int, sentence_end int, original array<string>, normalized array<string>",
    "sentence_vectors": "kg_id string, source string, sentence_idx int, vector array<double>",
    "records": "kg_id string, source string, total_chunks int, svo_total_chunks int, extraction_status string, chunk_progress int, document_vector array<double>",
    "registry": "kg_id string, source string, position int, name string, entity_type string, forms map<string,int>, first_seen int, occurrences array<int>",
    "lexicon": "word string",
    "tasks": "kg_id string, source string, chunk_index int, status string",
}


def _versions(spark: SparkSession, path: str) -> list[int]:
    """The complete versions of a table that is kept in versions, oldest first."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    top = hadoop.Path(path)
    fs = top.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.globStatus(hadoop.Path(f"{path}/version=*"))]
    return sorted(int(n.split("=")[1]) for n in names if fs.exists(hadoop.Path(f"{path}/{n}/_SUCCESS")))


def _latest(spark: SparkSession, path: str) -> str:
    known = _versions(spark, path)
    return f"{path}/version={known[-1]:08d}" if known else path


def read(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A stored table with its schema; an empty one where nothing is stored."""
    try:
        found = spark.read.schema(SCHEMAS[name]).parquet(_latest(spark, path))
        found.inputFiles()
        return found
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], SCHEMAS[name])


def write(rows: DataFrame, path: str, name: str, by: str | None = "kg_id") -> None:
    """Stores rows in the table's schema. The partitions of `by` that rows have are overwritten and all others stay. Without `by` the whole table is replaced: a new version is
    written beside the last, which readers see until the new one is complete; the last stays for readers that have begun, older ones go."""
    spark = rows.sparkSession
    kinds = {f.name: f.dataType for f in spark.createDataFrame([], SCHEMAS[name]).schema}
    out = rows.select(*[F.col(c).cast(t).alias(c) for c, t in kinds.items()])
    if by:
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)
        return
    known = _versions(spark, path)
    out.write.mode("overwrite").parquet(f"{path}/version={(known[-1] if known else 0) + 1:08d}")
    hadoop = spark._jvm.org.apache.hadoop.fs
    fs = hadoop.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    for old in known[:-1]:
        fs.delete(hadoop.Path(f"{path}/version={old:08d}"), True)


def readable(spark: SparkSession, path: str, name: str) -> bool:
    """Whether a stored table is there and all its columns can be read."""
    try:
        found = spark.read.parquet(_latest(spark, path))
        wanted = {c.split()[0] for c in SCHEMAS[name].split(", ")}
        if not wanted <= set(found.columns):
            return False
        found.limit(1).collect()
        return True
    except Exception:  # whatever a damaged file raises: it is to be built anew
        return False


def insert(rows: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """rows with the new ones; a key that is there, or twice among the new, is an error when the result is read."""
    times = new.groupBy(*keys).agg(F.count("*").alias("__n")).join(rows.select(*keys).distinct().withColumn("__there", F.lit(True)), keys, "left")
    taken = new.join(times, keys, "left")  # null keys aren't compared
    free = F.when(F.col("__there").isNull() & (F.coalesce("__n", F.lit(1)) == 1), F.col(keys[0])).otherwise(F.raise_error(F.concat(F.lit("already there: "), F.concat_ws(", ", *[F.col(k).cast("string") for k in keys]))).cast(new.schema[keys[0]].dataType))
    return rows.unionByName(taken.withColumn(keys[0], free).select(*new.columns))


def update(rows: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """rows with the columns of changes that aren't null, by key; unknown keys change nothing."""
    mine = [c for c in changes.columns if c not in keys]
    new = changes.select(*keys, *[F.col(c).alias(f"__new_{c}") for c in mine])
    out = rows.join(new, keys, "left")
    return out.select(*[F.coalesce(f"__new_{c}", c).alias(c) if c in mine else F.col(c) for c in rows.columns])


def find(rows: DataFrame, **values) -> DataFrame:
    """The rows with these values."""
    condition: Column = F.lit(True)
    for k, v in values.items():
        condition = condition & F.col(k).eqNullSafe(F.lit(v))
    return rows.where(condition)


def delete(rows: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return rows.join(gone.select(*keys), keys, "left_anti")
