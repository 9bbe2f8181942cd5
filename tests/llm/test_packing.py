import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from docweave.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")


def plain_best_fit(sizes, room, limit):
    """Bins as a plain list: the fullest that has room, and the fullest goes if there are too many."""
    bins, done = [], []
    for i, n in enumerate(sizes):
        fits = [b for b in bins if b[0] >= n]
        best = min(fits, key=lambda b: b[0], default=None)
        if best is None:
            best = [room, []]
            bins.append(best)
        best[0] -= n
        best[1].append(i)
        full = best if best[0] == 0 else min(bins, key=lambda b: b[0]) if len(bins) > limit else None
        if full is not None:
            bins = [b for b in bins if b is not full]
            done.append((room - full[0], len(full[1])))
    return sorted(done + [(room - b[0], len(b[1])) for b in bins])


@pytest.mark.parametrize("limit", [1, 3, 20])
def test_packer_equals_a_plain_search(limit):
    rng = random.Random(limit)
    sizes = [rng.randint(1, 64) if i % 3 else 64 for i in range(900)]
    packer, closed = packing.Packer(64, limit), []
    for i, n in enumerate(sizes):
        closed += packer.put(n, i)
        assert packer.open <= limit
    closed += packer.close()
    assert sorted(x for c in closed for x in c) == list(range(900))
    fills = sorted(sum(sizes[x] for x in c) for c in closed)
    assert max(fills) <= 64 and fills == [f for f, _ in plain_best_fit(sizes, 64, limit)]


def test_cuts():
    assert [packing.cuts(n, 8) for n in (1, 8, 9, 16, 19)] == [[0, 1], [0, 8], [0, 1, 9], [0, 8, 16], [0, 3, 11, 19]]


def texts():
    rng = random.Random(3)
    words = "the red fox ran über hills 12 of stone, and slept.".split()
    out = [" ".join(rng.choices(words, k=int(rng.paretovariate(0.9) * 12) % 900 + 1)) for _ in range(400)]
    return [*out, None, "", "same", "same", "word " * 4096, "no<|endoftext|>end"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, 7) for i, t in enumerate(texts())], "doc_id long, text string, sequence_id int")


@pytest.mark.parametrize("partitions", [1, 6])
def test_sequences_hold_the_librarys_ids(docs, partitions):
    t, room = Tokenizer.from_file(PATH), 256
    want = {i: [*t.encode(x or "", add_special_tokens=False).ids, 0] for i, x in enumerate(texts())}
    packed = packing.pack_documents(docs.repartition(partitions), PATH, room=room, shard=64)
    whole = {i: [] for i in want}
    places, rows = {}, packed.collect()
    for r in rows:
        ids = np.frombuffer(r.ids, f"<u{r.width}")
        assert len(ids) == sum(r.lengths) <= room
        at = 0
        for d, p, s, n in zip(r.doc_ids, r.pieces, r.starts, r.lengths, strict=True):
            whole[d].append((p, s, list(ids[at : at + n])))
            places[d, p] = (s, n, zlib.crc32(ids[at : at + n].astype("<u4").tobytes()), r.sequence_id, at)
            at += n
    for i, ids in want.items():
        own = sorted(whole[i])
        assert [x for _, _, part in own for x in part] == ids and [p for p, _, _ in own] == list(range(len(own)))
        assert len(own) == -(-len(ids) // room) and all(len(part) == room for _, _, part in own[1:])
    assert {(r.doc_id, r.piece): tuple(r)[2:] for r in packing.placements(packed).collect()} == places
    total = sum(map(len, want.values()))
    assert len(rows) == len({r.sequence_id for r in rows}) <= 1.03 * total / room + 3


def test_partitions_do_not_matter(docs):
    runs = [sorted(map(tuple, packing.placements(packing.pack_documents(docs.repartition(n), PATH, room=128, shard=100)).collect())) for n in (1, 5)]
    assert runs[0] == runs[1]


def test_rows_without_an_id_are_spread(spark):
    rows = spark.createDataFrame([(None, "one two")] * 500, "doc_id long, text string").coalesce(1)
    packed = packing.pack_documents(rows, PATH, room=16, shard=50).collect()
    assert sum(len(r.doc_ids) for r in packed) == 500 and len({r.sequence_id >> 32 for r in packed}) > 5
