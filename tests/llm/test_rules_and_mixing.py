import re
from collections import Counter

import pytest

from docweave.llm import mixing, quality_rules

TEXTS = [
    None, "", " \n ", "a", "a b c a b c", "a b c d a b c", "x x x x", "l1 a\nl1 a\n\n \nl1 a\nother", "é#* $% &|<> é", "a\x0bb\x0cc\td\re  f", "w " * 60, " ".join(f"w{i}" for i in range(70)),
    "one two three four five " * 30, "a b c", "a b c\na b c\nz", " ".join(["p q r s"] * 3 + ["t"] * 5),
]


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    n = Counter(windows)
    covered = {i + j for i, w in enumerate(windows) if n[w] > 1 for j in range(3)}
    lines = [s for s in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", s)]
    bare = sum(not re.search(r"[^\W\d_]", w) for w in words)
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), bare, sum(s.count("|") > 1 for s in lines))


def test_measures_equal_counting_by_hand(spark):
    docs = spark.createDataFrame([(i, t, 0) for i, t in enumerate(TEXTS)], "doc_id long, text string, n_words int")
    for r in quality_rules.judge(docs).collect():
        want = brute(TEXTS[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.n_bare_words, r.n_table_lines) == want, TEXTS[r.doc_id]
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r.base_failed and r.kept)


def test_estimation_finds_the_rules_that_agree(spark):
    import random

    rng, rows, want = random.Random(3), [], Counter()
    for _ in range(4000):
        good = rng.random() < 0.8
        votes = []
        for against in (0.6, 0.5, 0.3, 0.0):
            u = rng.random()
            votes.append(0 if u < 0.1 else -1 if not good and u < 0.1 + 0.9 * against else 1)
        rows.append(tuple(votes))
        want[good] += 1
    names = ["a", "b", "c", "d"]
    patterns = spark.createDataFrame([(*k, n) for k, n in Counter(rows).items()], "a int, b int, c int, d int, n long")
    rates, good = quality_rules.estimate(patterns, names)
    for k, p in zip(names[:3], (0.6, 0.5, 0.3), strict=True):
        assert abs(rates[k][-1][1] - 0.9 * p) < 0.12 and rates[k][-1][0] < 0.05
    assert abs(good - 0.8) < 0.06


def test_estimates_equal_those_of_plain_loops(spark):
    patterns = {(1, 1, 1): 900, (1, 1, 0): 60, (-1, 1, 1): 20, (-1, -1, 1): 50, (1, -1, -1): 15, (0, 1, 1): 30}
    rows = spark.createDataFrame([(*k, n) for k, n in patterns.items()], "a int, b int, c int, n long")
    good_r, bad_r, clean, own = [dict(quality_rules.PRIOR_GOOD) for _ in range(3)], [dict(quality_rules.PRIOR_BAD) for _ in range(3)], 0.8, 0.05 * 1075
    for _ in range(4):
        q = {}
        for k in patterns:
            g, b = clean, 1 - clean
            for i, v in enumerate(k):
                g, b = g * good_r[i][v], b * bad_r[i][v]
            q[k] = g / (g + b)
        n_good = sum(n * q[k] for k, n in patterns.items())
        for i in range(3):
            for v in (-1, 0, 1):
                good_r[i][v] = (sum(n * q[k] for k, n in patterns.items() if k[i] == v) + own * quality_rules.PRIOR_GOOD[v]) / (n_good + own)
                bad_r[i][v] = (sum(n * (1 - q[k]) for k, n in patterns.items() if k[i] == v) + own * quality_rules.PRIOR_BAD[v]) / (1075 - n_good + own)
        clean = (n_good + own * 0.8) / (1075 + own)
    rates, good = quality_rules.estimate(rows, ["a", "b", "c"], rounds=4)
    assert abs(good - clean) < 1e-9
    for i, k in enumerate("abc"):
        assert all(abs(rates[k][v][0] - good_r[i][v]) < 1e-9 and abs(rates[k][v][1] - bad_r[i][v]) < 1e-9 for v in (-1, 0, 1))
    got = {(r.a, r.b, r.c): r.q for r in rows.select("a", "b", "c", quality_rules.posterior(rates, good).alias("q")).collect()}
    for k in patterns:
        g, b = clean, 1 - clean
        for i, v in enumerate(k):
            g, b = g * good_r[i][v], b * bad_r[i][v]
        assert abs(got[k] - g / (g + b)) < 1e-9


def test_poor_labelled_documents_are_dropped_and_good_ones_kept(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    judged = [r for r in quality_rules.judge(docs).collect() if r.doc_id in labels and not r.base_failed]
    poor, good = ([r.kept for r in judged if labels[r.doc_id] == y] for y in (0, 1))
    assert len(poor) > 20 and sum(poor) <= 0.1 * len(poor)
    assert len(good) > 300 and sum(good) >= 0.98 * len(good)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    assert quality_rules.judge(docs).collect() == []
    assert mixing.takes(docs).collect() == []
    assert mixing.mix(docs).collect() == []


def fill(sizes):
    """Targets by sharing out again and again."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), {}
    while True:
        rest = total - sum(capped.values())
        open_ = [s for s in names if s not in capped]
        share = {s: rest * weight[s] / sum(weight[x] for x in open_) for s in open_}
        above = [s for s in open_ if share[s] > 3 * sizes[s]]
        if not above:
            return capped | share
        capped |= {s: 3.0 * sizes[s] for s in above}


@pytest.mark.parametrize("seed", [1, 2])
def test_takes_follow_targets(spark, seed):
    import random

    rng = random.Random(seed)
    rows = [(i, " ".join(["w"] * rng.randint(1, 40)), rng.choices(["a", "b", "c", "é", None, "tiny"], [50, 20, 10, 10, 8, 2])[0]) for i in range(3000)] + [(9000, None, "a"), (9001, "x", "lonely")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.takes(docs).collect()
    assert sorted(tuple(r) for r in mixing.takes(docs.repartition(7)).collect()) == sorted(map(tuple, got))
    source, sizes = {i: s for i, _, s in rows}, Counter()
    for r in got:
        sizes[source[r.doc_id]] += r.size
    want, taken = fill(dict(sizes)), Counter()
    assert len(got) == len(rows)
    for r in got:
        s = source[r.doc_id]
        taken[s] += r.taken
        assert r.source_size == sizes[s] and abs(r.target - want[s]) < 1e-6 * max(1, want[s])
        assert r.taken <= 3 * r.size and (not r.size or r.taken % r.size == 0)
        assert not r.size or r.taken // r.size - int(want[s] // sizes[s] + 1e-9) in (0, 1)
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 20.5
    copies = Counter(r.doc_id for r in mixing.mix(docs).collect())
    assert all(copies[r.doc_id] * r.size == r.taken for r in got)


def test_rows_without_words_are_not_taken_more_than_three_times(spark):
    rows = [(1, "", "a", 7, "x"), (2, None, "a", 7, "y"), (3, "w w", "a", 7, "z"), (4, "w " * 400, "b", 7, "z"), (None, "w " * 300, None, 7, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, __id int, __draw string")
    got = mixing.mix(docs)
    copies = Counter(r.doc_id for r in got.collect())
    assert got.columns == docs.columns and max(copies[i] for i in (1, 2, 3)) <= 3 and copies[3] == 3
    assert {(r.doc_id, r.taken) for r in mixing.takes(docs).collect()} >= {(1, 0), (2, 0), (3, 6)}


def test_better_texts_are_drawn_first(spark):
    docs = spark.createDataFrame([(i, "plain words here" if i % 2 else "## $$ 11", "s") for i in range(2000)], "doc_id long, text string, source string")
    keyed = mixing.draws(docs, "doc_id", "text", "source", 17).orderBy("__draw").limit(500).collect()
    assert sum(r["__id"] % 2 for r in keyed) > 350
