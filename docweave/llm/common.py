"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.lineage import shared_dir
from docweave.session import ship

#: Words are maximal runs of characters other than ASCII white space.
WORD_GAP = "[\\x20\\x09-\\x0D]+"
#: Entries a worker keeps in one memo table, and the length of the longest; words beyond either are worked out anew.
MEMO_LIMIT, MEMO_LONGEST = 400_000, 64
#: Rows and bytes of one Arrow batch, at most (a single longer row is a batch of its own); documents are long, so batches are short.
BATCH_ROWS, BATCH_BYTES = 800, 32 << 20


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def short_batches(spark: SparkSession) -> None:
    """Sends the package to the executors, and keeps Arrow batches small enough for long texts."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


class Scratch:
    """Tables written to the shared folder to cut lineage; executors may be lost, the files stay."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.n = spark, count()
        self.base = f"{shared_dir(spark)}/docweave-{name}-{uuid.uuid4().hex[:12]}"

    def keep(self, df: DataFrame, name: str = "t", compression: str = "snappy") -> DataFrame:
        path = f"{self.base}/{name}-{next(self.n)}"
        df.write.parquet(path, compression=compression)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *tables: DataFrame) -> None:
        """Deletes the files of tables that are no longer needed, to save disk."""
        jvm = self.spark._jvm
        for f in [f for df in tables for f in df.inputFiles()[:1]]:
            path = jvm.org.apache.hadoop.fs.Path(f).getParent()
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


class Memo(dict):
    """word -> value, worked out once for each word of a worker, up to a fixed number of words."""

    def __init__(self, work: Callable, limit: int = MEMO_LIMIT):
        super().__init__()
        self.work, self.limit = work, limit

    def __missing__(self, word):
        value = self.work(word)
        if len(self) < self.limit and len(word) <= MEMO_LONGEST:
            self[word] = value
        return value


_held: dict = {}


def held(make: Callable, *args, key=None):
    """make(*args), kept by the worker process for its next tasks under `key` (by default args); only the last one asked for is kept, to save memory."""
    at = (make.__module__, make.__qualname__, args if key is None else key)
    if at not in _held:
        _held.clear()
        _held[at] = make(*args)
    return _held[at]


def ascii_lower_words(text: str | None) -> list[bytes]:
    """UTF-8 words of a text, A-Z lower-cased; bytes.split() parts at exactly the ASCII white space of WORD_GAP."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def words_of_batch(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """ascii_lower_words() of all texts, one after the other, as a binary column, and how many each text has."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(texts.fill_null("")))
    flat = split.flatten()
    full = np.concatenate([[0], np.cumsum(pc.binary_length(flat).to_numpy(zero_copy_only=False) > 0)])  # blanks at the ends leave empty words
    at = split.offsets.to_numpy() - split.offsets[0].as_py() if len(texts) else np.zeros(1, int)
    if full[-1] < len(flat):
        flat = flat.filter(pc.greater(pc.binary_length(flat), 0))
    return flat.cast(pa.binary()), np.diff(full[at])


def hash_memo() -> Memo:
    return Memo(xxhash.xxh64_intdigest)


def hashes(words: list[bytes], memo: Memo) -> np.ndarray:
    return np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))


_MULTIPLIERS = np.random.default_rng(20240601).integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """The finishing steps of a 64-bit hash."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(word_hashes: np.ndarray, width: int) -> np.ndarray:
    """64-bit hash of each window of `width` words, in order; of the whole sequence if it is shorter, none without words."""
    n = len(word_hashes)
    if not n:
        return word_hashes
    k = min(width, n)
    out = np.full(n - k + 1, k, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(k):
            out = mix(out + word_hashes[i : n - k + 1 + i] * _MULTIPLIERS[i])
    return out


def arrow_map(df: DataFrame, schema: str, per_batch: Callable[[], Callable[[pa.RecordBatch], dict | None]]) -> DataFrame:
    """mapInArrow where per_batch() is called once for each task and gives a function from a batch to columns."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    kind = StructType.fromDDL(schema)
    target = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = per_batch()
        for batch in batches:
            columns = work(batch)
            if columns is not None:
                yield pa.RecordBatch.from_arrays([_as_array(columns[f.name], f.type) for f in target], schema=target)

    return df.mapInArrow(run, kind)


def _as_array(values, kind: pa.DataType) -> pa.Array:
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    if isinstance(values, pa.Array):
        return values if values.type == kind else values.cast(kind)
    return pa.array(values, kind)


def list_array(rows: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    """A list column out of one numpy array for each row. A batch has BATCH_BYTES of text at most, or is one row, so its values fit 32-bit offsets."""
    offsets = np.zeros(len(rows) + 1, np.int64)
    np.cumsum([len(r) for r in rows], out=offsets[1:])
    flat = np.concatenate(rows) if rows else np.zeros(0)
    if offsets[-1] >= 2**31:
        raise ValueError("one row holds too many values")
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat, kind))


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str | None]:
    return batch.column(batch.schema.get_field_index(column)).to_pylist()


def crc_fold(column, parts: int):
    """crc32 of an id's text, modulo `parts`; a null id counts as the empty text."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % parts
