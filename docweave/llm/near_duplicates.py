"""Near-duplicate groups by circulant MinHash.

A document's set holds the 64-bit hashes of its distinct word shingles.
One permutation sends each shingle to a slot of a large circle; a second one, shifted
by k places round the circle, gives it its k-th rank; coordinate k of a signature is
the least k-th rank of the set. So the K ranks of a shingle are K neighbouring
entries of one table. Signatures are banded; documents that meet in a band
are candidates, which are confirmed on their full sets.

Copies (equal sets) are one class from the start. Candidates are linked in two steps, and nobody emits pairs, only the edges of
spanning trees. First, those of a band's bucket whose signatures agree in so many coordinates that they can be
at the threshold make up families; this needs no sets. Then the sets are sent once, to their family, where links are
confirmed. Buckets and families of any size are cut into blocks (see blocks.py).
"""

from __future__ import annotations

import hashlib
from functools import lru_cache
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocks import linked
from .common import Scratch, arrow_map, ascii_lower_words, hash_memo, hashes, held, list_array, mix, shingles, short_batches, texts_of

#: Coordinates of a signature, and slots of the circle.
COORDINATES, SLOTS = 192, 1 << 21
#: Chance, at most, that a pair exactly at the threshold shares no band; and that its signatures agree too seldom.
MISS = 1e-6
#: Members of a bucket or family, and shingles of a family, that are looked at in one piece.
BLOCK, FAMILY_BLOCK = 512, 1_000_000


def without_copies(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group, with all its columns: of the rows that near_duplicates() keeps the one with the smallest hash
    of all columns, where rows repeat an id and a text. Rows without words (null, empty, blank) all stay; an empty table stays empty."""
    near = near_duplicates(docs, width, percent, id_col, text_col).where("n_shingles > 0")
    marks = near.groupBy(F.col(id_col).alias("__id"), F.col("text_hash").alias("__hash")).agg(F.max("kept").alias("__kept"), F.count("*").alias("__n"))
    marks = Scratch(docs.sparkSession, "near-marks").keep(marks.where("not __kept or __n > 1"), "marks")
    repeated = marks.where("__kept")

    def same(other: DataFrame) -> Column:
        return docs[id_col].eqNullSafe(other["__id"]) & (F.xxhash64(docs[text_col].cast("string")) == other["__hash"])

    out = docs.join(marks.hint("shuffle_hash"), same(marks), "left_anti")
    if repeated.isEmpty():
        return out
    order = F.xxhash64(*[F.col(f.name) for f in docs.schema if f.dataType.typeName() != "map"])
    keys = F.col(id_col).alias("__id"), F.xxhash64(F.col(text_col).cast("string")).alias("__hash")
    one = docs.join(repeated.hint("shuffle_hash"), same(repeated), "left_semi").groupBy(*keys).agg(F.min_by(F.struct(*docs.columns), order).alias("__row"))
    return out.unionByName(one.select("__row.*"))


def band_rows(similarity: float, coordinates: int = COORDINATES) -> int:
    """The most coordinates a band can have so that a pair at `similarity` is missed with a chance of MISS at most."""
    return max(r for r in range(1, 33) if r == 1 or (1 - similarity**r) ** (coordinates // r) <= MISS)


def least_agreement(similarity: float, coordinates: int = COORDINATES) -> int:
    """The most coordinates that a pair at `similarity` agrees in but for a chance of MISS at most."""
    chance, n = 0.0, 0
    while n <= coordinates:
        chance += comb(coordinates, n) * similarity**n * (1 - similarity) ** (coordinates - n)
        if chance > MISS:
            break
        n += 1
    return n


@lru_cache(1)
def permutations() -> tuple[np.ndarray, np.ndarray]:
    """The slot permutation, and all windows of the rank permutation round the circle."""
    rng = np.random.default_rng(907)
    slots, ranks = rng.permutation(SLOTS).astype(np.uint32), rng.permutation(SLOTS).astype(np.uint32)
    return slots, np.lib.stride_tricks.sliding_window_view(np.concatenate([ranks, ranks[:COORDINATES]]), COORDINATES)


def signature(found: np.ndarray) -> np.ndarray:
    slots, windows = permutations()
    at = slots[found & np.uint64(SLOTS - 1)]
    out = np.full(COORDINATES, SLOTS, np.uint32)
    for i in range(0, len(at), 2048):
        np.minimum(out, windows[at[i : i + 2048]].min(0), out=out)
    return out


def band_keys(signatures: np.ndarray, rows: int) -> np.ndarray:
    """A 64-bit key for each band of each signature."""
    bands = COORDINATES // rows
    parts = signatures[:, : bands * rows].astype(np.uint64).reshape(-1, bands, rows)
    with np.errstate(over="ignore"):
        keys = mix(np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))[None, :].repeat(len(parts), 0)
        for r in range(rows):
            keys = mix(keys + parts[:, :, r])
    return keys.view(np.int64)


def shingle_set(text: str | None, width: int, memo) -> np.ndarray:
    return np.unique(shingles(hashes(ascii_lower_words(text), memo), width))


def set_key(found: np.ndarray) -> bytes:
    return hashlib.blake2b(found.tobytes(), digest_size=16).digest()


def _signatures(rows: DataFrame, width: int, similarity: float) -> DataFrame:
    """For each row the size and digest of its set, its bands, and the low byte of each coordinate (`marks`)."""
    r = band_rows(similarity)

    def start():
        memo = held(hash_memo)

        def work(batch: pa.RecordBatch) -> dict:
            sets = [shingle_set(t, width, memo) for t in texts_of(batch)]
            signatures = np.stack([signature(s) for s in sets]) if sets else np.zeros((0, COORDINATES), np.uint32)
            keys, marks = band_keys(signatures, r), signatures.astype(np.uint8)
            return {
                "id": batch.column(0), "h": batch.column(2), "n": [len(s) for s in sets], "node": [set_key(s) for s in sets],
                "bands": list_array(list(keys), pa.int64()), "marks": [m.tobytes() for m in marks],
            }

        return work

    kind = rows.schema["id"].dataType.simpleString()
    return arrow_map(rows, f"id {kind}, h long, n int, node binary, bands array<long>, marks binary", start)


def _sets(rows: DataFrame, width: int) -> DataFrame:
    def start():
        memo = held(hash_memo)

        def work(batch: pa.RecordBatch) -> dict:
            sets = [shingle_set(t, width, memo) for t in texts_of(batch)]
            return {"node": [set_key(s) for s in sets], "shingles": list_array([s.view(np.int64) for s in sets], pa.int64())}

        return work

    return arrow_map(rows, "node binary, shingles array<long>", start)


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_shingles, component_id, kept and text_hash (xxhash64 of the text) for each row of docs.

    Words are runs without ASCII white space, A-Z lower-cased; two sets link if 100 * |intersection| >= percent * |union|;
    component_id is the smallest id of the group. A text without words (null, empty, blank) has no shingles and links with
    nothing. Rows are told apart by their texts even if they repeat an id; a null id never names a group,
    and a group without any other id has a null component_id. kept marks the first row of a group by id (null last), then
    text_hash; rows that repeat its id and text are marked with it. Texts of any length are read whole; an empty table gives no rows;
    other columns are left out, whatever their names.
    """
    short_batches(docs.sparkSession)
    scratch = Scratch(docs.sparkSession, "near")
    text, least = F.col(text_col).cast("string"), least_agreement(percent / 100)
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.xxhash64(text).alias("h"))
    signed = scratch.keep(_signatures(rows, width, percent / 100), "signatures")
    # a class for each distinct set, combined in the tasks before it is shuffled
    first = F.min(F.struct(F.col("id").isNull().alias("unnamed"), "id", "h")).alias("first")
    classes = scratch.keep(signed.where("n > 0").groupBy("node").agg(first, F.min(F.struct("n", "bands", "marks")).alias("m")).select("node", "first", "m.*"), "classes")

    buckets = classes.select("node", F.explode("bands").alias("key"))
    shared = buckets.groupBy("key").agg(F.count("*").alias("members")).where("members > 1")
    met = scratch.keep(buckets.join(shared, "key"), "met")
    facts = scratch.keep(classes.select("node", "n", "marks").join(met.select("node").distinct(), "node"), "facts")
    members = met.select("key", "node", "members", F.ceil(F.col("members") / BLOCK).cast("int").alias("blocks")).join(facts, "node")
    families = linked(members, scratch, percent, least)
    scratch.drop(met, facts)

    # the first row of each class, whose id may be null or repeated, gives the set
    named = classes.join(families, "node")
    chosen = named.select(F.col("first.id").alias("of"), F.col("first.h").alias("fh"))
    own = rows.join(chosen.hint("shuffle_hash"), rows["id"].eqNullSafe(chosen["of"]) & (rows["h"] == chosen["fh"]), "left_semi").select("id", "text")
    sets = scratch.keep(_sets(own, width).dropDuplicates(["node"]), "sets")
    sized = named.groupBy("root").agg(F.count("*").alias("members"), F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n") / FAMILY_BLOCK)).cast("int").alias("blocks"))
    relatives = named.select(F.col("root").alias("key"), "node", "n", "marks").join(sized.withColumnRenamed("root", "key"), "key").join(sets, "node")
    roots = linked(relatives, scratch, percent, least)
    scratch.drop(sets, families)

    placed = classes.select("node", "first").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    lowest = placed.groupBy("root").agg(F.min("first").alias("lead"))
    of_class = placed.join(lowest, "root").select("node", "lead")
    out = signed.select("id", "h", "n", F.when(F.col("n") > 0, F.col("node")).alias("node")).join(of_class, "node", "left")
    component = F.when(F.col("n") > 0, F.col("lead.id")).otherwise(F.col("id"))
    leads = F.col("id").eqNullSafe(F.col("lead.id")) & (F.col("h") == F.col("lead.h"))
    return out.select(
        F.col("id").alias(id_col), F.col("n").cast("long").alias("n_shingles"), component.alias("component_id"),
        F.when(F.col("n") > 0, leads).otherwise(True).alias("kept"), F.col("h").alias("text_hash"),
    )
