"""Token ids written as canonical, length-limited Huffman codes.

The file format is a Parquet table of independent blocks. A block holds whole
documents in ascending order of id: their ids and token counts, the code bits
of all their tokens, and a checkpoint (bit offset) for every `STEP` tokens of each, so
that any stretch can be decoded on its own and many stretches side by side. A
code is canonical: the list of code lengths, stored beside the blocks, is all
that a reader needs.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, arrow_map, held, list_array, short_batches, texts_of

#: Longest code in bits; a decoding table has 2**MAX_BITS entries.
MAX_BITS = 20
#: Tokens between two checkpoints, and tokens after which a block is closed.
STEP, BLOCK_TOKENS = 256, 1 << 18
#: Units in a worker's table of those in use; it keeps an older table of that size as well.
KNOWN_UNITS = 500_000
#: Code points of a text that are split into units at once.
PIECE = 1 << 20

_UNIT = re.compile(r"[ \t-\r]*[^ \t-\r]+|[ \t-\r]+")
_WORD_AND_MARKS = re.compile("( ?[A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u00FF]+)([!-&(-/:-@\\[-`{-~]*)")
_ODD_SPACE = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_UNEVEN = ("  ", "\n ", " \n", "\t", "\r", "\x0b", "\x0c")
_CUT = re.compile(r"(?<=[0-9A-Za-z]) (?=[0-9A-Za-z])")


class UnitEncoder:
    """ids of whole texts. A byte-level pre-token never reaches from a visible character into white space, so
    a text parts into units (white space, then a run without it) that the library encodes one by one with the same
    ids; each distinct unit is encoded once in a worker. In a unit of a word and marks of punctuation, the word
    is a pre-token of its own, which goes straight to the library's model. Texts with other white space or a special string go whole."""

    def __init__(self, path: str, limit: int = KNOWN_UNITS):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.known, self.older, self.limit = Tokenizer.from_file(path), {}, {}, limit
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.dtype = "<u2" if self.tokenizer.get_vocab_size() < 1 << 16 else "<u4"
        parts = self.tokenizer.pre_tokenizer
        self.plain = isinstance(parts, pre_tokenizers.ByteLevel) and parts.use_regex and not parts.add_prefix_space and self.tokenizer.normalizer is None
        if self.plain:
            byte = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
            two = "".join(map(chr, range(0x80, 0x800)))  # all bytes of letters in two bytes
            shown = byte.pre_tokenize_str(two)[0][0]
            self.line_end, self.marks = self._pack(self.tokenizer.encode("\n", add_special_tokens=False).ids), {}
            self.shown = {x: shown[i] for i, x in enumerate(two.encode()) if x >= 0x80} | {32: byte.pre_tokenize_str(" ")[0][0]}

    def _pack(self, ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}{'H' if self.dtype == '<u2' else 'I'}", *ids)

    def _word(self, word: str) -> bytes:
        text = word.replace(" ", self.shown[32]) if word.isascii() else word.encode().decode("latin-1").translate(self.shown)
        return self._pack([t.id for t in self.tokenizer.model.tokenize(text)])

    def _learn(self, units: set[str]) -> None:
        if len(self.known) > self.limit:
            self.known, self.older = {}, self.known  # words in use come back from the older table
        known, older, rest = self.known, self.older, []
        for u in units.difference(known):
            if u in older:
                known[u] = older[u]
            elif self.plain and (m := _WORD_AND_MARKS.fullmatch(u)):
                known[u] = self._marked(m)
            elif self.plain and "\n" in u and all(parts := [_WORD_AND_MARKS.fullmatch(x) for x in u.split("\n")]):
                known[u] = self.line_end.join(map(self._marked, parts))  # one line end between visible characters stands alone
            else:
                rest.append(u)
        for e, u in zip(self.tokenizer.encode_batch_fast(rest, add_special_tokens=False), rest, strict=True):
            self.known[u] = self._pack(e.ids)

    def _marked(self, m: re.Match) -> bytes:
        word, mark = m.groups()
        if (w := self.known.get(word)) is None:
            w = self._word(word)
        if mark and mark not in self.marks:
            self.marks[mark] = self._pack(self.tokenizer.encode(mark, add_special_tokens=False).ids)
        return w + self.marks[mark] if mark else w

    def pieces(self, text: str):
        at = 0
        while len(text) - at > PIECE and (m := _CUT.search(text, at + PIECE)):
            yield text[at : m.start()]
            at = m.start()
        yield text[at:]

    def encode(self, texts: list[str]) -> list[bytes]:
        """ids of each text, packed as self.dtype."""
        out: list[bytes] = [b""] * len(texts)
        simple = []
        for i, t in enumerate(texts):
            if self._whole(t):
                out[i] = self._pack(self.tokenizer.encode(t, add_special_tokens=False).ids)
            elif self.plain and self._single_spaced(t):
                simple.append(i)
            else:
                for piece in self.pieces(t):
                    units = _UNIT.findall(piece)
                    self._learn(set(units))
                    out[i] += b"".join(map(self.known.__getitem__, units))
        if simple:
            for i, ids in zip(simple, self._encode_single_spaced([texts[i] for i in simple]), strict=True):
                out[i] = ids
        return out

    def _single_spaced(self, t: str) -> bool:
        """Whether every blank stands alone between visible characters, so that units begin at the blanks."""
        return 0 < len(t) <= PIECE and not any(x in t for x in _UNEVEN) and t[0] not in " \n" and t[-1] not in " \n"

    def _encode_single_spaced(self, texts: list[str]) -> list[bytes]:
        """Splits and counts distinct units in Arrow; only those pass through Python."""
        split = pc.split_pattern(pa.array(texts, pa.string()), " ")
        offsets = split.offsets.to_numpy().astype(np.int64)
        coded = split.flatten().dictionary_encode()
        which = coded.indices.to_numpy().astype(np.int64)
        units = [" " + u for u in coded.dictionary.to_numpy(zero_copy_only=False)]
        first = [t.partition(" ")[0] for t in texts]  # the first unit has no blank before it
        self._learn(set(units).union(first))
        which[offsets[:-1]] = len(units) + np.arange(len(first))
        ids = list(map(self.known.__getitem__, units + first))
        flat = np.frombuffer(b"".join(ids), self.dtype)
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // flat.itemsize
        starts = np.cumsum(sizes) - sizes
        n = sizes[which]
        ends = np.cumsum(n)
        taken = flat[np.repeat(starts[which] - ends + n, n) + np.arange(ends[-1])].tobytes()
        cuts = np.concatenate([[0], ends[offsets[1:] - 1]]) * flat.itemsize
        return [taken[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]

    def _whole(self, text: str) -> bool:
        if any(s in text for s in self.special):
            return True
        return any(c in text for c in "\x1c\x1d\x1e\x1f") if text.isascii() else _ODD_SPACE.search(text) is not None


def code_lengths(counts: np.ndarray, max_bits: int = MAX_BITS) -> np.ndarray:
    """Lengths of an optimal prefix code with no code over max_bits (package-merge); 0 for ids without a count."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.uint8)
    if len(used) < 2:
        out[used] = 1
        return out
    if len(used) > 1 << max_bits:
        raise ValueError(f"{len(used)} ids don't fit codes of {max_bits} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[order].astype(np.float64)
    weights, masks = leaves, [np.ones(len(leaves), bool)]
    for _ in range(max_bits - 1):
        pairs = weights[: len(weights) // 2 * 2].reshape(-1, 2).sum(1)
        both = np.concatenate([leaves, pairs])
        by = np.argsort(both, kind="stable")
        weights = both[by]
        masks.append(by < len(leaves))
    take, lengths = 2 * len(leaves) - 2, np.zeros(len(leaves), np.int64)
    for mask in reversed(masks):
        n = int(mask[:take].sum())
        lengths[:n] += 1
        take = 2 * (take - n)
    out[order] = lengths
    return out


@dataclass
class Code:
    """A canonical code: codes in order of (length, id), each the number after the last, shifted to its length."""

    lengths: np.ndarray

    def __post_init__(self):
        self.order = np.lexsort((np.arange(len(self.lengths)), self.lengths))
        self.order = self.order[self.lengths[self.order] > 0]
        self.bits = int(self.lengths.max(initial=1))
        sized = self.lengths[self.order].astype(np.int64)
        spans = np.int64(1) << (self.bits - sized)  # table entries that begin with the code
        starts = np.cumsum(spans) - spans
        self.codes = np.zeros(len(self.lengths), np.uint64)
        self.codes[self.order] = (starts >> (self.bits - sized)).astype(np.uint64)
        self.spans = spans

    def table(self) -> tuple[np.ndarray, np.ndarray]:
        """The id, and the length of its code, for each value of the next `bits` bits."""
        ids = np.zeros(1 << self.bits, np.int32)
        sizes = np.ones(1 << self.bits, np.int64)
        ids[: self.spans.sum()] = np.repeat(self.order, self.spans)
        sizes[: self.spans.sum()] = np.repeat(self.lengths[self.order], self.spans)
        return ids, sizes

    def encode(self, ids: np.ndarray) -> tuple[int, np.ndarray, bytes]:
        """How many ids, the bit offsets of every STEP-th one, and their bits, first bit highest."""
        sizes = self.lengths[ids].astype(np.int64)
        ends = np.cumsum(sizes)
        begins = ends - sizes
        total = int(ends[-1]) if len(ends) else 0
        word = begins >> 5
        wide = self.codes[ids] << (64 - sizes - (begins & 31)).astype(np.uint64)  # two words of 32 bits from `word` on
        n = (total >> 5) + 2
        # bits of different codes don't overlap: sums stay below 2**32, which a double holds exactly
        bits = np.bincount(word, wide >> np.uint64(32), n)
        bits[1:] += np.bincount(word, wide & np.uint64(0xFFFFFFFF), n)[:-1]
        return len(ids), begins[::STEP], bits.astype(">u4").tobytes()[: (total + 7) // 8]

    def decode(self, payload: bytes, checkpoints: np.ndarray, sizes: np.ndarray, table: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """The ids of documents of these sizes; all stretches between checkpoints advance together, one table look-up for each token."""
        raw = np.frombuffer(payload + bytes(8 + -len(payload) % 4), ">u4").astype(np.uint64)
        pairs = (raw[:-1] << np.uint64(32)) | raw[1:]
        ids, lengths = table
        stretches = -(-sizes // STEP)
        full = np.full(int(stretches.sum()), STEP, np.int64)
        last = np.cumsum(stretches)[stretches > 0] - 1
        full[last] = (sizes - STEP * (stretches - 1))[stretches > 0]
        order = np.argsort(-full, kind="stable")  # the longest first, so that those still running are a prefix
        running = np.searchsorted(-full[order], -np.arange(STEP), "left")
        out = np.zeros((len(full), STEP), np.int32)
        at, shift = checkpoints[order].astype(np.int64), np.uint64(64 - self.bits)
        for i in range(int(full.max(initial=0))):
            k = running[i]
            now = at[:k]
            window = (pairs[now >> 5] << (now & 31).astype(np.uint64)) >> shift
            out[order[:k], i] = ids[window]
            now += lengths[window]
        return out[np.arange(STEP) < full[:, None]]


def encode_ids(docs: DataFrame, tokenizer_path: str, end_id: int | None = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, width and ids of each row of docs: packed little-endian unsigned integers of `width` bytes; a null text is empty."""
    short_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def start():
        encoder = held(UnitEncoder, tokenizer_path)
        end = b"" if end_id is None else encoder._pack([end_id])

        def work(batch: pa.RecordBatch) -> dict:
            coded = encoder.encode([t or "" for t in texts_of(batch)])
            return {"id": batch.column(0), "width": [np.dtype(encoder.dtype).itemsize] * len(coded), "ids": [x + end for x in coded]}

        return work

    return arrow_map(rows, f"id {rows.schema['id'].dataType.simpleString()}, width int, ids binary", start)


def id_counts(coded: DataFrame) -> np.ndarray:
    """How often each id occurs in all rows. Summed in the tasks first; the driver gets a number for each id of the vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(0, np.int64)
        for batch in batches:
            for width in (2, 4):
                blob = b"".join(x for w, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if w == width)
                n = np.bincount(np.frombuffer(blob, f"<u{width}"), minlength=len(sums))
                n[: len(sums)] += sums
                sums = n
        seen = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(sums[seen], pa.int64())], ["token", "n"])

    found = coded.select("width", "ids").mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(int(found["token"].max()) + 1 if len(found) else 1, np.int64)
    out[found["token"].to_numpy(np.int64)] = found["n"].to_numpy(np.int64)
    return out


def shard_bounds(coded: DataFrame, shards: int) -> list:
    """The least id of each shard but the first: range partitions of the ids alone, a value for each."""
    parts = coded.where("id IS NOT NULL").select("id").repartitionByRange(shards, "id").groupBy(F.spark_partition_id().alias("p")).agg(F.min("id").alias("low"))
    return sorted(r["low"] for r in parts.collect())[1:]


_BLOCK = "shard int, block int, block_start long, doc_ids array<{id}>, doc_tokens array<int>, n_tokens int, checkpoints binary, payload binary"


def write_blocks(coded: DataFrame, code: Code, path: str, shards: int) -> None:
    """Encodes each row, deals the rows out to shards (ranges of the id), sorts them, and writes each shard's blocks.
    Rows with one id keep a fixed order; null ids come first."""
    kind, bounds, lengths = coded.schema["id"].dataType.simpleString(), shard_bounds(coded, shards), code.lengths

    def coder():
        own = Code(lengths)

        def work(batch: pa.RecordBatch) -> dict:
            ids = batch.column(0).to_pylist()
            out = [own.encode(np.frombuffer(x, f"<u{w}")) for w, x in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            return {
                "shard": [0 if i is None else bisect_right(bounds, i) for i in ids], "id": batch.column(0),
                "n": [n for n, _, _ in out], "marks": [m.astype("<i8").tobytes() for _, m, _ in out], "bits": [b for _, _, b in out],
            }

        return work

    ready = arrow_map(coded, f"shard int, id {kind}, n int, marks binary, bits binary", coder)
    dealt = ready.repartition(int(coded.sparkSession.conf.get("spark.sql.shuffle.partitions")), "shard").sortWithinPartitions("shard", "id", "n", "bits")

    def packer():
        state = {"shard": -1, "block": 0, "start": 0}

        def work(batch: pa.RecordBatch) -> dict | None:
            rows = batch.to_pylist()
            out = {k: [] for k in ("shard", "block", "block_start", "doc_ids", "doc_tokens", "n_tokens", "checkpoints", "payload")}
            first, held = 0, 0
            for i, row in enumerate(rows):
                held += row["n"]
                if held >= BLOCK_TOKENS or i == len(rows) - 1 or rows[i + 1]["shard"] != row["shard"]:
                    own = rows[first : i + 1]
                    if state["shard"] != row["shard"]:
                        state.update(shard=row["shard"], block=0, start=0)
                    at, marks = 0, []  # every document begins with a whole byte
                    for r in own:
                        marks.append(np.frombuffer(r["marks"], "<i8") + 8 * at)
                        at += len(r["bits"])
                    values = (row["shard"], state["block"], state["start"], [r["id"] for r in own], [r["n"] for r in own], held, np.concatenate(marks).astype("<i8").tobytes(), b"".join(r["bits"] for r in own))
                    for k, v in zip(out, values, strict=True):
                        out[k].append(v)
                    state["block"] += 1
                    state["start"] += held
                    first, held = i + 1, 0
            return out if rows else None

        return work

    arrow_map(dealt, _BLOCK.format(id=kind), packer).write.parquet(f"{path}/blocks")


def write_token_file(docs: DataFrame, path: str, tokenizer_path: str, end_id: int | None = 2, id_col: str = "doc_id", text_col: str = "text", shards: int | None = None) -> None:
    """Encodes docs and writes `path`/code (code lengths) and `path`/blocks. Rows are tokenized once, into a scratch table
    in the shared folder, from which counts and blocks are made. shards: by default three for each shuffle partition.

    A null or empty text has the end id alone; texts of any length are written whole; null ids come first, rows that repeat an id in an order that their
    tokens give; an empty table gives a file without blocks; other columns are left out, whatever their names."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "ids")
    coded = scratch.keep(encode_ids(docs, tokenizer_path, end_id, id_col, text_col), "ids", compression="zstd")
    code = Code(code_lengths(id_counts(coded)))
    spark.createDataFrame([(bytearray(code.lengths.tobytes()),)], "lengths binary").coalesce(1).write.parquet(f"{path}/code")
    write_blocks(coded, code, path, shards or 3 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    scratch.drop(coded)


def read_token_file(spark: SparkSession, path: str, id_col: str = "doc_id", with_ids: bool = True) -> DataFrame:
    """id, start (ids of all documents before it, in order of id), n_tokens, ids_crc32 and, if asked for, ids of each document.

    An empty table has no blocks and gives no rows. The shards' totals, one number for each range partition, are
    summed up on the driver.
    """
    code = Code(np.frombuffer(spark.read.parquet(f"{path}/code").first()["lengths"], np.uint8))
    blocks = spark.read.parquet(f"{path}/blocks")
    kind = blocks.schema["doc_ids"].dataType.elementType.simpleString()
    totals = {r["shard"]: r["n"] for r in blocks.groupBy("shard").agg(F.max(F.col("block_start") + F.col("n_tokens")).alias("n")).collect()}
    before, at = {}, 0
    for shard in sorted(totals):
        before[shard], at = at, at + totals[shard]
    lengths = code.lengths

    def start():
        own = Code(lengths)
        table = own.table()

        def work(batch: pa.RecordBatch) -> dict:
            out = {"id": [], "start": [], "n_tokens": [], "ids_crc32": [], "ids": []}
            for row in batch.to_pylist():
                tokens = own.decode(row["payload"], np.frombuffer(row["checkpoints"], "<i8"), np.array(row["doc_tokens"], np.int64), table)
                raw, at, begin = memoryview(tokens.astype("<u4").tobytes()), 0, before[row["shard"]] + row["block_start"]
                for n in row["doc_tokens"]:
                    own_bytes = raw[4 * at : 4 * (at + n)]
                    out["start"].append(begin + at)
                    out["n_tokens"].append(n)
                    out["ids_crc32"].append(zlib.crc32(own_bytes))
                    out["ids"].append(bytes(own_bytes) if with_ids else None)
                    at += n
                out["id"] += row["doc_ids"]
            return out

        return work

    return arrow_map(blocks, f"id {kind}, start long, n_tokens long, ids_crc32 long, ids binary", start).withColumnRenamed("id", id_col)
