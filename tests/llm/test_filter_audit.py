import random
import re
from itertools import permutations

import numpy as np

from docweave.llm import filter_audit


def fails_of(rows):
    """Which filters each row (id, text, source) fails, one by one."""
    out = []
    for i, t, _ in rows:
        t = t or ""
        w = re.findall("[^\x20\x09-\x0d]+", t)
        same = any((u or "") == t and j is not None and (i is None or j < i) for j, u, _ in rows)
        out.append((len(w) < 50, 100 * len(set(w)) < 65 * len(w), 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), bool(re.search(r"[#$%&*|]", t)), same))
    return out


def plain(rows, labels):
    """By applying the filters to the documents, order by order."""
    fails, out = fails_of(rows), {}
    label = lambda k, i: any(r[0] == i and i is not None and r[k] == 1 for r in labels)
    for part in {s or "" for _, _, s in rows}:
        own = [k for k, (_, _, s) in enumerate(rows) if (s or "") == part]
        total = dict.fromkeys("ABCDE", 0)
        for order in map("".join, permutations("ABCDE")):
            left = list(own)
            for step, f in enumerate(order, 1):
                bit = "ABCDE".index(f)
                gone = [k for k in left if fails[k][bit]]
                left = [k for k in left if not fails[k][bit]]
                failing = sum(fails[k][bit] for k in own)
                total[f] += len(gone)
                out[part, order, step] = [len(left), len(gone), failing - len(gone), sum(fails[k][bit] and sum(fails[k]) == 1 for k in own), sum(label(1, rows[k][0]) for k in gone), sum(label(2, rows[k][0]) for k in gone)]
        for (p, order, step), v in out.items():
            if p == part:
                v.append(total[order[step - 1]])
    return out


def corpus():
    rng = random.Random(5)
    words = ["Alpha", "beta", "gamma", "Delta$", "x|y", "eta", "theta", "ÄÖ", "iota"]
    texts = [" ".join(rng.choice(words) + (str(rng.randrange(200)) if rng.random() < 0.6 else "") for _ in range(rng.choice([5, 49, 50, 51, 90]))) for _ in range(120)]
    texts += [" ".join(f"w{i}" for i in range(60))] * 5 + texts[:30] + [None, "", "", " \t\n", "A" * 30_000, "x " * 60_000]
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    ids[3], ids[130], ids[131] = None, None, ids[132]
    return [(i, t, rng.choice(["web", "books", None, ""])) for i, t in zip(ids, texts, strict=True)]


def test_audit_equals_filtering_document_by_document(spark):
    rows = corpus()
    rng = random.Random(6)
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in rng.choices(range(len(rows)), k=120)] + [(None, 1, 1)]
    docs = spark.createDataFrame([(*r, 1, "m") for r in rows], "doc_id long, text string, source string, n int, mask string").repartition(5)
    got = filter_audit.audit_documents(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert {(r.part, r.filter_order, r.step): list(r)[3:] for r in got.collect()} == plain(rows, labels)


def test_steps_are_those_of_the_first_failed_filter():
    masks = np.arange(16)
    orders, steps = filter_audit.removal_steps(masks, 4)
    assert len(orders) == 24
    for o, order in enumerate(orders):
        for m in masks:
            assert steps[m, o] == next((s for s, f in enumerate(order) if m >> f & 1), 4)


def test_any_number_of_filters_and_many_parts(spark):
    sums = spark.createDataFrame([(f"p{i}", m, 1 + i + m, m % 2, 0) for i in range(50) for m in range(0, 8, 1 + i % 3)], "part string, mask int, n long, good long, toxic long")
    got = filter_audit.audit(sums, "xyz").collect()
    assert len(got) == 50 * 6 * 3
    for r in got:
        if r.step == 3:
            i = int(r.part[1:])
            assert r.kept == 1 + i  # what fails nothing
    totals = {}
    for r in got:
        totals[r.part, r.filter_order] = totals.get((r.part, r.filter_order), 0) + r.removed
    assert all(len({v for (p, _), v in totals.items() if p == part}) == 1 for part in {p for p, _ in totals})
