"""Benchmark passages inside documents.

Windows as long as an item slide over a document; a shorter document is one window. A window and an item are
compared by SimHash fingerprints of their word shingles, in which the j-th occurrence of a shingle is an element of its own, so that
weighted similarity is the similarity of sets and a passage that repeats itself is like any other. At the threshold a bit differs with
a chance of 0.15, whatever the text: 39 of 256 with a deviation of 6, and more than RADIUS with a chance below 0.00001. An index over
BLOCKS blocks guarantees all fingerprints within RADIUS: one of their blocks differs in RADIUS / BLOCKS bits at most,
as one of six pairs of unlike fingerprints does. What the index finds is confirmed by exact weighted similarity, the sum of
the smaller over the sum of the larger shingle counts.

A window can reach the threshold only if that share of its shingles occurs in
items of its length. Other windows get no fingerprint; this loses nothing. A shorter document needs no
fingerprint: all items that share shingles with it are compared.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, arrow_map, hashes, held, mix, shingles, short_batches, texts_of

#: Blocks of a fingerprint, and bits of a block.
BLOCKS, BLOCK_BITS = 16, 16
BITS = BLOCKS * BLOCK_BITS
#: Bits by which two fingerprints differ, at most, before they are compared exactly, and so by which their nearest blocks differ.
RADIUS = 63
BLOCK_RADIUS = RADIUS // BLOCKS
#: Entries up to which blocks are compared one by one; beyond, they are looked up. Both find the same.
FEW = 256
#: Words of benchmark items that are sent to the executors at once; a larger benchmark is compared in blocks.
BLOCK_WORDS = 1_000_000
#: Windows that are worked on at once.
CHUNK = 4096

_WORD = re.compile(r"\w+")


def word_memo() -> Memo:
    return Memo(lambda w: xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass")))


def words_of(text: str | None) -> list[str]:
    """Lower-cased runs of letters, digits and underscores: case and punctuation don't hide a passage."""
    return _WORD.findall(text.lower()) if text else []


_SPREAD = np.random.default_rng(77).integers(1, 2**63, BITS // 64, dtype=np.uint64)
_NUMBER = np.uint64(0x9E3779B97F4A7C15)


def numbered(own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """For windows of k shingles: the element that each shingle adds as the last of a window, and the one it takes away as the first.

    The j-th occurrence of a shingle in a window is the element (shingle, j). A shingle that comes in adds the number it brings its
    kind to, and one that leaves takes the highest number away.
    """
    n = len(own)
    _, kind = np.unique(own, return_inverse=True)
    order = np.argsort(kind, kind="stable")
    keys = kind[order] * (n + 1) + order
    at = np.arange(n)
    rank = np.empty(n, np.int64)
    rank[order] = at
    back = rank + 1 - np.searchsorted(keys, kind * (n + 1) + np.maximum(at - k + 1, 0))
    ahead = np.searchsorted(keys, kind * (n + 1) + np.minimum(at + k, n)) - rank
    element = lambda j: np.where(j == 1, own, mix(own + j.astype(np.uint64) * _NUMBER))
    return element(back), element(ahead)


def fingerprints(own: np.ndarray, starts: np.ndarray, k: int) -> np.ndarray:
    """SimHash of the k shingles from each start: a bit is set if more of their elements have it than not."""
    come, go = numbered(own, k)
    sums = np.zeros((len(own) + 1, BITS), np.int32)
    np.cumsum(bit_rows(come), axis=0, out=sums[1:])
    if np.array_equal(come, go):
        counts = sums[starts + k] - sums[starts]
    else:
        gone = np.zeros_like(sums)
        np.cumsum(bit_rows(go), axis=0, out=gone[1:])
        counts = sums[starts + k] - gone[starts]
    return np.packbits(counts * 2 > k, axis=1, bitorder="little").view(np.uint64)


def bit_rows(found: np.ndarray) -> np.ndarray:
    """The BITS bits of each element."""
    return np.unpackbits(mix(found[:, None] ^ _SPREAD).view(np.uint8), axis=1, bitorder="little")


def variants(bits: int) -> np.ndarray:
    """All values of a block with at most so many bits set."""
    return np.array([sum(1 << b for b in c) for n in range(bits + 1) for c in combinations(range(BLOCK_BITS), n)], np.int64)


class HammingIndex:
    """Pairs of a query and an entry that differ in at most RADIUS bits: all of them, since one of their blocks differs in at most BLOCK_RADIUS.

    Entries are kept under all values that differ from a block of theirs in one bit or none; queries ask for those that differ from
    theirs in the other bits, so that together every value within BLOCK_RADIUS is met."""

    def __init__(self, entries: np.ndarray, few: int = FEW):
        self.entries, self.blocks, self.direct = entries, entries.view(np.uint16).reshape(len(entries), BLOCKS), len(entries) <= few
        if not self.direct:
            keys = (self._keys(self.blocks)[:, :, None] ^ variants(1)).reshape(len(entries), -1)
            order = np.argsort(keys.ravel(), kind="stable")
            self.known, self.owner = keys.ravel()[order], (order // keys.shape[1]).astype(np.int32)

    @staticmethod
    def _keys(blocks: np.ndarray) -> np.ndarray:
        return blocks.astype(np.int64) + (np.arange(BLOCKS) << BLOCK_BITS)

    def near(self, queries: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs with a block within BLOCK_RADIUS, in parts; those of several blocks can come again."""
        blocks = queries.view(np.uint16).reshape(len(queries), BLOCKS)
        if self.direct:
            for i in range(0, len(queries), CHUNK):
                apart = np.bitwise_count(blocks[i : i + CHUNK, None, :] ^ self.blocks[None])
                q, e = np.nonzero((apart <= BLOCK_RADIUS).any(2))
                yield q + i, e
            return
        keys = self._keys(blocks)
        for v in variants(BLOCK_RADIUS - 1):
            own = (keys ^ v).ravel()
            low, high = np.searchsorted(self.known, own, "left"), np.searchsorted(self.known, own, "right")
            n = high - low
            at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
            yield np.repeat(np.arange(len(own)) // BLOCKS, n), self.owner[at].astype(np.int64)

    def search(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        found = [np.zeros(0, np.int64)]
        for q, e in self.near(queries):
            close = np.bitwise_count(queries[q] ^ self.entries[e]).sum(1) <= RADIUS
            found.append(np.unique(q[close] * len(self.entries) + e[close]))
        both = np.unique(np.concatenate(found))
        return both // len(self.entries), both % len(self.entries)


@dataclass
class SizeClass:
    """Items of one length in words."""

    words: int
    ids: list
    sets: list[tuple[np.ndarray, np.ndarray]]  # distinct shingles and their counts
    known: np.ndarray  # all their shingles, sorted
    index: HammingIndex
    owners: tuple[np.ndarray, np.ndarray]  # the distinct shingles of all sets in order, and the items they are of


@dataclass
class Items:
    """All items, by length, and quick tests on whether a shingle occurs in any of them."""

    classes: list[SizeClass]
    seen: np.ndarray  # a bit for each value of a shingle's low bits
    known: np.ndarray  # all shingles, sorted

    def places(self, own: np.ndarray) -> np.ndarray:
        """Where shingles of any item are."""
        maybe = np.flatnonzero(self.seen[own & np.uint64(len(self.seen) - 1)])
        return maybe[_among(self.known, own[maybe])] if len(maybe) else maybe


def _among(ordered: np.ndarray, values: np.ndarray) -> np.ndarray:
    at = np.searchsorted(ordered, values)
    return ordered[np.minimum(at, len(ordered) - 1)] == values


def prepare(items: list[tuple[object, np.ndarray]], width: int) -> Items:
    classes = size_classes(items, width)
    known = np.unique(np.concatenate([np.zeros(0, np.uint64), *(c.known for c in classes)]))
    seen = np.zeros(1 << 22, bool)
    seen[known & np.uint64(len(seen) - 1)] = True
    return Items(classes, seen, known)


def size_classes(items: list[tuple[object, np.ndarray]], width: int) -> list[SizeClass]:
    """items: id and word hashes. Items without words match nothing."""
    by: dict[int, list] = {}
    for key, found in items:
        if len(found):
            by.setdefault(len(found), []).append((key, shingles(found, width)))
    out = []
    for n, group in sorted(by.items()):
        k = len(group[0][1])
        prints = np.stack([fingerprints(s, np.zeros(1, int), k)[0] for _, s in group])
        sets = [np.unique(s, return_counts=True) for _, s in group]
        flat, owner = np.concatenate([s for s, _ in sets]), np.repeat(np.arange(len(sets)), [len(s) for s, _ in sets])
        order = np.argsort(flat, kind="stable")
        out.append(SizeClass(n, [key for key, _ in group], sets, np.unique(flat), HammingIndex(prints), (flat[order], owner[order])))
    return out


def sharing(own: np.ndarray, c: SizeClass) -> list[int]:
    """The items of a class that have any of these distinct shingles."""
    ordered, owner = c.owners
    low, high = np.searchsorted(ordered, own, "left"), np.searchsorted(ordered, own, "right")
    return sorted({i for a, b in zip(low.tolist(), high.tolist(), strict=True) for i in owner[a:b].tolist()})


def weighted_similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Sum of the smaller counts over the sum of the larger counts."""
    _, x, y = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    common = int(np.minimum(a[1][x], b[1][y]).sum())
    return common / (int(a[1].sum() + b[1].sum()) - common)


def matches(found: np.ndarray, items: Items, width: int, similarity: float) -> Iterator[tuple]:
    """The best window (earliest of equals) for each item that the document with these word hashes holds: id, start, words, similarity.
    The one window of a document shorter than an item is all of it."""
    by_width: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for c in items.classes:
        k, w = max(1, c.words - width + 1), min(width, c.words)
        if len(found) < w or len(found) - w + 1 < similarity * k - 1e-9:
            continue  # too short to reach the threshold
        if w not in by_width:
            own = shingles(found, w)
            by_width[w] = own, items.places(own)
        own, maybe = by_width[w]
        if len(maybe):
            maybe = maybe[_among(c.known, own[maybe])]
        if not len(maybe):
            continue
        if len(found) < c.words:
            if len(maybe) >= similarity * k - 1e-9:
                whole = np.unique(own, return_counts=True)
                for item in sharing(whole[0], c):
                    score = weighted_similarity(whole, c.sets[item])
                    if score >= similarity:
                        yield c.ids[item], 0, len(found), score
            continue
        hit = np.zeros(len(own) + 1, np.int32)
        hit[maybe + 1] = 1
        hit = np.cumsum(hit)
        starts = np.flatnonzero(hit[k:] - hit[:-k] >= np.ceil(similarity * k - 1e-9))
        best: dict[int, tuple] = {}
        for i in range(0, len(starts), CHUNK):
            part = starts[i : i + CHUNK]
            prints = fingerprints_near(own, part, k)
            q, e = c.index.search(prints)
            for at, item in zip((part[q]).tolist(), e.tolist(), strict=True):
                score = weighted_similarity(np.unique(own[at : at + k], return_counts=True), c.sets[item])
                if score >= similarity and (item not in best or score > best[item][0]):
                    best[item] = (score, at)
        for item, (score, at) in sorted(best.items()):
            yield c.ids[item], at, c.words, score


def fingerprints_near(own: np.ndarray, starts: np.ndarray, k: int) -> np.ndarray:
    """Fingerprints at sorted starts; shingles far from any of them aren't unpacked."""
    out = np.zeros((len(starts), BITS // 64), np.uint64)
    breaks = np.flatnonzero(np.diff(starts) > 4 * k) + 1
    for group in np.split(np.arange(len(starts)), breaks):
        a, b = starts[group[0]], starts[group[-1]] + k
        out[group] = fingerprints(own[a:b], starts[group] - a, k)
    return out


def _item_blocks(benchmark: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple]]:
    """The benchmark in parts of about BLOCK_WORDS words, each small enough to be sent to every executor."""
    items = benchmark.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    total = items.agg(F.sum(F.size(F.split(F.lower("text"), r"[^\p{L}\p{N}_]+")))).first()[0] or 0
    parts = max(1, -(-total // BLOCK_WORDS))
    memo = word_memo()
    for p in range(parts):
        rows = items.where(F.pmod(F.xxhash64("id", "text"), F.lit(parts)) == p).collect()
        yield [(r["id"], hashes(words_of(r["text"]), memo)) for r in rows]


def _ready(block, width: int) -> tuple[Memo, Items]:
    return word_memo(), prepare(block.value, width)


def contaminated(docs: DataFrame, benchmark: DataFrame, width: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text",
                 item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row for each document and item it holds: id, item id, start_word, n_words, similarity of the best window.

    A null or empty text holds nothing, one shorter than an item is compared as a whole; null, empty or blank items match nothing; items with equal texts are
    each reported; repeated rows of docs give repeated rows; other columns are left out, whatever their names. Items shorter than a
    shingle count as one shingle. Both ids may be null and are carried along. Of equally similar windows the earliest counts. Texts of any
    length are searched whole; without rows in either table there are none in the result.
    """
    short_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind, item_kind = rows.schema["id"].dataType.simpleString(), benchmark.schema[item_id_col].dataType.simpleString()
    out, sc = None, docs.sparkSession.sparkContext
    for block in map(sc.broadcast, _item_blocks(benchmark, item_id_col, item_text_col)):

        def start(block=block, name=uuid.uuid4().hex):
            memo, ready = held(_ready, block, width, key=name)

            def work(batch: pa.RecordBatch) -> dict | None:
                out = {k: [] for k in ("id", "item", "start_word", "n_words", "similarity")}
                for key, text in zip(batch.column(0).to_pylist(), texts_of(batch), strict=True):
                    for found in matches(hashes(words_of(text), memo), ready, width, similarity):
                        for column, value in zip(out.values(), (key, *found), strict=True):
                            column.append(value)
                return out if out["id"] else None

            return work

        part = arrow_map(rows, f"id {kind}, item {item_kind}, start_word long, n_words int, similarity double", start)
        out = part if out is None else out.union(part)
    return out.select(F.col("id").alias(id_col), F.col("item").alias(item_id_col), "start_word", "n_words", "similarity")


def clean(docs: DataFrame, benchmark: DataFrame, width: int = 5, similarity: float = 0.8, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, that hold no item, as contaminated() finds them; nothing is joined or shuffled.

    Null, empty and blank texts stay, and so do all rows if no item has words; repeated rows are judged each.
    """
    short_batches(docs.sparkSession)
    kept, at, sc = docs.schema, docs.columns.index(text_col), docs.sparkSession.sparkContext
    for block in map(sc.broadcast, _item_blocks(benchmark, item_id_col, item_text_col)):

        def run(batches, block=block, name=uuid.uuid4().hex):
            memo, ready = held(_ready, block, width, key=name)
            for batch in batches:
                free = [next(matches(hashes(words_of(t), memo), ready, width, similarity), None) is None for t in batch.column(at).to_pylist()]
                yield batch.filter(pa.array(free, pa.bool_()))

        docs = docs.mapInArrow(run, kept)
    return docs
