import numpy as np
import pytest

from docweave.operators import classify


def plain(docs, protos, threshold, least=0.05):
    """One document after the other."""
    state = [[k, None if p is None else np.array(p, float), n] for k, p, n in sorted(protos)]
    out = []
    for key, v in sorted(docs):
        best = None
        for i, (_, p, _) in enumerate(state):
            if v is not None and p is not None:
                a, b = np.linalg.norm(v), np.linalg.norm(p)
                c = 0.0 if a < 1e-9 or b < 1e-9 else float(np.clip(np.dot(v, p) / (a * b), -1, 1))
                if c >= least and (best is None or round(c, 4) > best[1]):
                    best = (i, round(c, 4))
        taken = best is not None and best[1] >= threshold
        if taken:
            row = state[best[0]]
            row[1] = (row[1] * row[2] + np.array(v)) / (row[2] + 1)
            row[2] += 1
        out.append((key, state[best[0]][0] if best else None, best[1] if best else None, taken))
    return out


@pytest.mark.parametrize("members", [0, 1, 25])
def test_slices_at_the_same_time_equal_the_sequence(spark, members):
    rng = np.random.default_rng(members)
    centers = rng.normal(size=(6, 8))
    docs = [(i, (centers[rng.integers(6)] + rng.normal(size=8) * 1.6).tolist()) for i in range(500)] + [(600, None), (601, [0.0] * 8)]
    protos = [(f"k{i}", (centers[i] + rng.normal(size=8)).tolist(), members) for i in range(6)] + [("null", None, 3), ("zero", [0.0] * 8, 2)]
    want = plain(docs, protos, 0.45)
    assert 100 < sum(t for *_, t in want) < 480
    frame = spark.createDataFrame(docs, "doc_id long, vector array<double>").repartition(3)
    kgs = spark.createDataFrame(protos, "kg_id string, prototype array<double>, member_count long")
    for slices in (1, 5):
        got = sorted(map(tuple, classify.auto_assign(frame, kgs, threshold=0.45, slices=slices).collect()))
        assert got == want
    assert classify.auto_assign(frame.limit(0), kgs).collect() == []


def test_without_collections_nothing_is_assigned(spark):
    docs = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(9)], "doc_id long, vector array<double>")
    none = spark.createDataFrame([], "kg_id string, prototype array<double>, member_count long")
    got = classify.auto_assign(docs, none, slices=3).collect()
    assert len(got) == 9 and not any(r.assigned or r.kg_id or r.score for r in got)
