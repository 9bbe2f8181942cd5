"""Best-fit packing of token sequences in bounded space.

Pieces of documents arrive one by one and go to the fullest open bin that has room for
them. A packer keeps a fixed number of bins open: their free space is a
bitset, one bit for each number of free tokens, so the best bin is the
lowest bit from the piece's length on. If too many are open, the fullest is closed: it has
the least to gain. Pieces are dealt by a hash to shards of about `SHARD` pieces,
whatever the size of the corpus, and arrive in descending length; every shard has a packer of its own.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, arrow_map, held, short_batches, texts_of
from .token_file import UnitEncoder

#: Tokens of a sequence, bins that a packer keeps open, and pieces of a shard, about.
ROOM, OPEN_BINS, SHARD = 2048, 1024, 2048


class Packer:
    """Bounded-space best fit. put() gives the bins that are closed by the piece, close() the rest, each a list of what was put into it."""

    def __init__(self, room: int = ROOM, open_bins: int = OPEN_BINS):
        self.room, self.limit, self.open, self.free = room, open_bins, 0, 0
        self.bins: list[list[list]] = [[] for _ in range(room + 1)]  # by free space

    def _take(self, space: int) -> list:
        own = self.bins[space]
        found = own.pop()
        if not own:
            self.free ^= 1 << space
        self.open -= 1
        return found

    def put(self, size: int, item) -> list[list]:
        fits = self.free >> size
        if fits:
            space = size + (fits & -fits).bit_length() - 1
            into = self._take(space)
        else:
            space, into = self.room, []
        into.append(item)
        left, closed = space - size, []
        if left == 0:
            return [into]
        self.bins[left].append(into)
        self.free |= 1 << left
        self.open += 1
        if self.open > self.limit:
            closed.append(self._take((self.free & -self.free).bit_length() - 1))
        return closed

    def close(self) -> list[list]:
        out = []
        while self.free:
            out.append(self._take((self.free & -self.free).bit_length() - 1))
        return out


def cuts(n: int, room: int) -> list[int]:
    """Where the pieces of n tokens begin, and n. A document that fits is one piece; of others all pieces but the first are full."""
    return [0, *range(n % room or room, n + 1, room)]


def pieces(docs: DataFrame, tokenizer_path: str, end_id: int = 0, room: int = ROOM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, piece, start, length, ids (packed little-endian unsigned integers of `width` bytes) and salt, a row for each piece of each document."""
    short_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def start():
        encoder = held(UnitEncoder, tokenizer_path)
        width, end = np.dtype(encoder.dtype).itemsize, encoder._pack([end_id])

        def work(batch: pa.RecordBatch) -> dict:
            coded = [x + end for x in encoder.encode([t or "" for t in texts_of(batch)])]
            edges = [cuts(len(x) // width, room) for x in coded]
            row = np.repeat(np.arange(len(edges)), [len(e) - 1 for e in edges])
            begins = [a for e in edges for a in e[:-1]]
            ids = [x[a * width : b * width] for x, e in zip(coded, edges, strict=True) for a, b in zip(e, e[1:], strict=False)]
            return {
                "id": batch.column(0).take(pa.array(row)), "piece": [k for e in edges for k in range(len(e) - 1)], "start": begins,
                "length": [len(x) // width for x in ids], "width": np.full(len(row), width, np.int32), "ids": ids, "salt": row.astype(np.int32),
            }

        return work

    return arrow_map(rows, f"id {rows.schema['id'].dataType.simpleString()}, piece int, start long, length int, width int, ids binary, salt int", start)


def pack(found: DataFrame, room: int = ROOM, open_bins: int = OPEN_BINS, shard: int = SHARD) -> DataFrame:
    """sequence_id, width, doc_ids, pieces, starts, lengths (one entry for each piece, in their order in the sequence) and ids of each sequence.

    found: rows of pieces(), from a written table, since they are counted first. The shard of a piece follows from a hash of its id, place and length, so a long
    document is spread over many; rows without an id are told apart by their place in the batch.
    """
    spark, kind = found.sparkSession, found.schema["id"].dataType.simpleString()
    shards = max(1, -(-found.count() // shard))
    unlike = F.xxhash64("id", "piece", "length", F.when(F.col("id").isNull(), F.col("salt")))
    ready = found.select(F.pmod(unlike, F.lit(shards)).cast("int").alias("shard"), unlike.alias("h"), "id", "piece", "start", "length", "width", "ids")
    tasks = min(shards, max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism))
    dealt = ready.repartition(tasks, "shard").sortWithinPartitions("shard", F.desc("length"), "h", "id", "piece", "ids")
    schema = f"sequence_id long, width int, doc_ids array<{kind}>, pieces array<int>, starts array<long>, lengths array<int>, ids binary"

    def run(batches):
        now, packer, made = None, Packer(room, open_bins), 0
        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in (0, 2, 3, 4, 5, 6, 7)]
            for own, *item in zip(*columns, strict=True):
                if own != now:
                    for full in packer.close() if now is not None else ():
                        yield now, made, full
                        made += 1
                    now, made = own, 0
                for full in packer.put(item[3], item):
                    yield now, made, full
                    made += 1
        for full in packer.close() if now is not None else ():
            yield now, made, full
            made += 1

    return _rows(dealt, schema, run)


def _rows(df: DataFrame, schema: str, run: Callable, per_batch: int = 512) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    kind = StructType.fromDDL(schema)
    target = to_arrow_schema(kind)

    def batches(source):
        held_rows = []
        for shard, k, items in run(source):
            ids, places, starts, sizes, widths, tokens = zip(*items, strict=True)
            held_rows.append(((shard << 32) + k, widths[0], list(ids), list(places), list(starts), list(sizes), b"".join(tokens)))
            if len(held_rows) >= per_batch:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held_rows, strict=True), target, strict=True)], schema=target)
                held_rows = []
        if held_rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held_rows, strict=True), target, strict=True)], schema=target)

    return df.mapInArrow(batches, kind)


def pack_documents(docs: DataFrame, tokenizer_path: str, end_id: int = 0, room: int = ROOM, open_bins: int = OPEN_BINS, shard: int = SHARD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The packed sequences of docs (see pack()): as few as best fit needs, none above `room` tokens; only documents above it are cut, the first piece short.

    Every document ends with end_id, so a null or empty text is one token. Texts of any length are cut whole; rows that repeat an id are packed each; null ids
    are packed like others; an empty table gives no sequences; other columns are left out, whatever their names. With distinct ids the sequences depend neither on
    partitions nor on the order of rows; of equal rows it is open which one is where.
    """
    return pack(Scratch(docs.sparkSession, "pieces").keep(pieces(docs, tokenizer_path, end_id, room, id_col, text_col), "pieces", compression="zstd"), room, open_bins, shard)


def placements(sequences: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """id, piece, start, length, ids_crc32, sequence_id and offset of each piece, read from the packed sequences."""
    kind = sequences.schema["doc_ids"].dataType.elementType.simpleString()

    def start():
        def work(batch: pa.RecordBatch) -> dict:
            at = {c: batch.column(i) for i, c in enumerate(batch.schema.names)}
            sizes, sums, offsets = at["lengths"].to_pylist(), [], []
            for ids, width, own in zip(at["ids"].to_pylist(), at["width"].to_pylist(), sizes, strict=True):
                raw, begin = memoryview(np.frombuffer(ids, f"<u{width}").astype("<u4").tobytes()), 0
                for n in own:
                    sums.append(zlib.crc32(raw[4 * begin : 4 * (begin + n)]))
                    offsets.append(begin)
                    begin += n
            return {
                "id": at["doc_ids"].flatten(), "piece": at["pieces"].flatten(), "start": at["starts"].flatten(), "length": at["lengths"].flatten().cast(pa.int64()), "ids_crc32": sums,
                "sequence_id": np.repeat(at["sequence_id"].to_numpy(), [len(s) for s in sizes]), "offset": offsets,
            }

        return work

    short_batches(sequences.sparkSession)
    return arrow_map(sequences, f"id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long", start).withColumnRenamed("id", id_col)
