import random
import re

import numpy as np
import pyarrow as pa
import pytest

from docweave.llm import blocks
from docweave.llm import near_duplicates as near_duplicates_module
from docweave.llm.near_duplicates import band_rows, least_agreement, near_duplicates, without_copies


def brute(rows, width, percent):
    """id -> (set size, smallest id of its group), by comparing everything with everything."""
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets[i] = {tuple(w[j : j + width]) for j in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} - {()}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


def corpus():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    base = [[rng.choice(words) for _ in range(rng.randint(40, 90))] for _ in range(12)]
    texts = ["", "   ", "one", "One", "one two", "a b c", "É b c d"]
    for b in base:
        for _ in range(12):
            w = list(b)
            for _ in range(rng.randint(0, 4)):
                w[rng.randrange(len(w))] = rng.choice(words)
            texts.append(rng.choice([" ", "\n", "\t "]).join(w))
    return [(i, t) for i, t in enumerate(texts)] + [(1000, None)]


@pytest.mark.parametrize(("width", "percent"), [(3, 85), (5, 80)])
def test_groups_are_those_of_all_links(spark, width, percent):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, kept string, n long")
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_duplicates(docs, width, percent).collect()}
    want = brute(rows, width, percent)
    assert got == {i: (n, c, i == c) for i, (n, c) in want.items()}
    assert len({c for _, c in want.values()}) < len(want) - 20


def test_null_ids_repeated_ids_and_empty_tables(spark):
    docs = spark.createDataFrame([(None, "a b c d"), (7, "a b c d"), (7, "x y z w"), (None, "q r s t")], "doc_id long, text string")
    got = sorted(((str(r.doc_id), r.component_id, r.kept) for r in near_duplicates(docs, 3, 85).collect()), key=str)
    assert got == sorted([("None", 7, False), ("7", 7, True), ("7", 7, True), ("None", None, True)], key=str)
    assert near_duplicates(docs.limit(0), 3, 85).collect() == []
    kept = [(str(r.doc_id), r.text) for r in without_copies(docs.union(spark.createDataFrame([(9, "x y z w")], docs.schema)), 3, 85).collect()]
    assert sorted(kept) == [("7", "a b c d"), ("7", "x y z w"), ("None", "q r s t")]


def test_bands_miss_one_pair_in_a_million_at_most():
    for s in (0.8, 0.85, 0.9):
        r = band_rows(s)
        assert (1 - s**r) ** (192 // r) <= 1e-6


def test_near_copies_hang_together_through_rows_with_null_or_repeated_ids(spark):
    words = [f"w{i}" for i in range(60)]
    middle = " ".join(words)
    left, right = " ".join(["x1", "x2", "x3", "x4", *words[4:]]), " ".join([*words[:-4], "y1", "y2", "y3", "y4"])
    alone = " ".join(f"v{i}" for i in range(40))
    rows = [(1, left), (None, middle), (2, right), (None, alone), (None, alone + " end"), (8, "p q r s"), (8, "p q r s"), (9, None), (9, None), (7, "t " + " ".join(words[::-1])), (7, " ".join(words[::-1]))]
    docs = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "doc_id long, text string, row int")
    got = near_duplicates(docs, 3, 85).collect()
    assert {(r.doc_id, r.component_id, r.kept) for r in got if r.n_shingles > 50 and r.doc_id != 7} == {(1, 1, True), (None, 1, False), (2, 1, False)}
    assert sorted(r.kept for r in got if r.doc_id == 7) == [False, True]
    kept = without_copies(docs, 3, 85)
    assert kept.columns == docs.columns
    left_over = sorted((str(r.doc_id), (r.text or "-").split()[0][0]) for r in kept.collect())
    assert left_over == sorted([("1", "x"), ("None", "v"), ("8", "p"), ("9", "-"), ("9", "-"), ("7", "t" if next(r for r in got if r.doc_id == 7 and r.kept).n_shingles == 59 else "w")])


def test_groups_cut_into_small_blocks_have_the_same_links(spark, monkeypatch):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(300)]
    base, rows = [rng.choice(words) for _ in range(60)], []
    for i in range(150):  # a large family, in which many pairs are just below the threshold
        w = list(base)
        for _ in range(rng.choice((1, 2, 3))):
            w[rng.randrange(len(w))] = rng.choice(words)
        rows.append((i, " ".join(w)))
    monkeypatch.setattr(near_duplicates_module, "BLOCK", 8)
    monkeypatch.setattr(near_duplicates_module, "FAMILY_BLOCK", 600)
    monkeypatch.setattr(blocks, "PIVOTS", 2)
    monkeypatch.setattr(blocks, "OUTSIDE", 5)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(docs, 3, 85).collect()}
    want = brute(rows, 3, 85)
    assert got == want
    assert 1 < len({c for _, c in want.values()}) < 100


def test_signatures_of_pairs_at_the_threshold_agree_often_enough():
    for s in (0.8, 0.85):
        least = least_agreement(s)
        assert s - 0.16 < least / 192 < s - 0.1


def test_searches_of_members_find_all_links():
    rng = random.Random(3)
    sets = [sorted(rng.sample(range(2**63, 2**63 + 60), 30)) for _ in range(40)]
    sets += [sorted({*s[:-3], *range(2**63 + 100, 2**63 + 103)}) for s in sets[:20]]
    rows = pa.RecordBatch.from_arrays(
        [pa.array([bytes([i]) for i in range(60)]), pa.array([len(s) for s in sets], pa.int32()), pa.array([bytes(192)] * 60), pa.array([[x - 2**64 for x in s] for s in sets], pa.list_(pa.int64()))],
        ["node", "n", "marks", "shingles"])
    members = blocks.Members(rows, 60, 100)
    linked = {(a, b) for a in range(60) for b in range(60) if a != b and 100 * len({*sets[a]} & {*sets[b]}) >= 60 * len({*sets[a]} | {*sets[b]})}
    assert linked == {(a, int(b)) for a in range(60) for b in members.links(a, np.array([x for x in range(60) if x != a]))}
    edges = [(int(a), int(b)) for a, near in members.trees(0, 60) for b in near]
    assert set(edges) <= linked and len({b for _, b in edges}) == len(edges)
    rooted = {i: i for i in range(60)}
    for a, b in edges:
        rooted = {k: rooted[a] if v == rooted[b] else v for k, v in rooted.items()}
    assert all(rooted[a] == rooted[b] for a, b in linked)


def test_batches_are_cut_between_groups():
    keys = [1, 1, 2, 3, 3, 3, 3, 4, 5, 5]
    rows = pa.RecordBatch.from_arrays([pa.array(keys), pa.array(range(10))], ["k", "x"])
    for size in (1, 2, 3, 10):
        parts = list(blocks.whole_groups(iter([rows[i : i + size] for i in range(0, 10, size)]), ["k"]))
        groups = [part.column(1)[s:e].to_pylist() for part, starts in parts for s, e in zip(starts.tolist(), starts[1:].tolist(), strict=False)]
        assert groups == [[0, 1], [2], [3, 4, 5, 6], [7], [8, 9]]
