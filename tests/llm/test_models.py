import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from docweave.llm import passage_quality, toxicity, window_lm
from docweave.llm.queries import in_training


def words(rng, n):
    return " ".join("".join(rng.choice(["ti", "on", "er", "the", "an", "ou"]) for _ in range(rng.randint(1, 3))) for _ in range(n))


def accuracy(rows, labels, held):
    return np.mean([r.score >= 0.5 if labels[r.doc_id] else r.score < 0.5 for r in rows if r.doc_id in labels and held(r.doc_id)])


def test_toxic_words_are_learned_from_positives_and_unlabelled_texts(spark):
    rng, rows, toxic = random.Random(1), [], {}
    for i in range(3000):
        bad = rng.random() < 0.15
        rows.append((i, words(rng, 60) + (" " + rng.choice(["scum", "idiot", "vermin"]) + " x " + rng.choice(["scum", "idiot", "vermin"]) if bad else "")))
        if i % 2:
            toxic[i] = int(bad)
    rows += [(5000, None), (5001, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([*toxic.items(), (None, 1), (1, None), (1, toxic[1])], "doc_id long, toxic int")
    model = toxicity.train(docs, labels, in_training("doc_id", 5, 0))
    got = toxicity.score(docs, model).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert accuracy(got, toxic, lambda i: zlib.crc32(str(i).encode()) % 5 == 0) > 0.97
    kept = toxicity.below(docs, model, 0.5)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in got if r.score < 0.5}
    assert toxicity.score(docs.limit(0), model).count() == 0
    assert toxicity.train(docs, labels.limit(0), F.lit(True)).score(np.zeros(0, np.int32)) < 0.5


def test_risk_sums_and_the_step_equal_plain_loops(spark):
    rng = random.Random(6)
    texts = [words(rng, rng.randint(0, 30)) for _ in range(200)] + [None, ""]
    docs = spark.createDataFrame([(t,) for t in texts], "text string").repartition(5)
    memo = toxicity.feature_memo()
    known = sorted({int(f) for t in texts[:40] for f in toxicity.features(t, memo)})[:50]
    weights = np.zeros(toxicity.BUCKETS, np.float32)
    weights[known] = np.random.default_rng(1).normal(0, 1, len(known)) + 1
    model = toxicity.Model(weights, -1.5)
    s1, s2, loss = np.zeros(1 + len(known)), np.zeros(1 + len(known)), 0.0
    for t in texts:
        own = [0, *[1 + known.index(f) for f in toxicity.features(t, memo).tolist() if f in known]]
        s = model.score(toxicity.features(t, memo))
        loss -= np.log(1 - s)
        for f in own:
            s1[f] += s
            s2[f] += s * (1 - s) * len(own)
    got = toxicity.risk_sums(docs, model)
    assert np.allclose(got[0], s1) and np.allclose(got[1], s2) and got[2][0] == len(texts) and abs(got[2][1] - loss) < 1e-3
    positive = [toxicity.features(t, memo) for t in texts[:20]]
    better = toxicity.improved(model, positive, docs, 0.3)
    risk = lambda m: np.mean([-np.log(1 - m.score(toxicity.features(t, memo))) for t in texts]) - 0.3 * np.mean([m.bias + m.weights[x].sum() for x in positive])
    assert risk(better) < risk(model)


def test_risk_is_not_driven_below_zero():
    rng = np.random.default_rng(0)
    positive = [np.array([1, *rng.integers(10, 60, 5)], np.int32) for _ in range(300)]
    unlabelled = [np.array([1] * (rng.random() < 0.2) + list(rng.integers(10, 60, 5)), np.int32) for _ in range(1500)]
    model = toxicity.fit(positive, unlabelled, 0.2)
    assert model.score(np.array([1, 20])) > 0.5 > model.score(np.array([20, 30]))


def test_quality_is_learned_from_document_labels(spark):
    rng, rows, quality = random.Random(2), [], {}
    for i in range(1500):
        good = rng.random() < 0.7
        bad = rng.choice(["BUY!! " * 80, "same same " * 60, "x### y&&& z%%% " * 30])
        rows.append((i, words(rng, 150) if good else words(rng, 60) + " " + bad))
        if i % 2:
            quality[i] = int(good)
    docs = spark.createDataFrame([*rows, (5000, None), (5001, "")], "doc_id long, text string")
    net = passage_quality.train(docs, spark.createDataFrame(list(quality.items()), "doc_id long, quality int"), in_training("doc_id", 3, 1))
    got = passage_quality.score(docs, net).collect()
    assert accuracy(got, quality, lambda i: zlib.crc32(str(i).encode()) % 3 == 1) > 0.95
    assert all(abs(sum(r.attention) - 1) < 1e-4 for r in got) and len(got) == len(rows) + 2
    assert passage_quality.score(docs.limit(0), net).count() == 0


def test_attention_gradients_are_right():
    rng = np.random.default_rng(3)
    net, x, starts, y = passage_quality.Network(), rng.normal(size=(7, passage_quality.WIDTH)), np.array([0, 3, 4]), np.array([1.0, 0.0, 1.0])

    def loss():
        p = net.forward(x, starts)["score"]
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))

    grads = net.gradients(net.forward(x, starts), y)
    for k, g in grads.items():
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        old, e = net.p[k][at], 1e-5
        net.p[k][at] = old + e
        up = loss()
        net.p[k][at] = old - e
        down = loss()
        net.p[k][at] = old
        assert abs((up - down) / (2 * e) - g[at]) < 1e-5, k


def test_language_model_prefers_texts_like_the_corpus(spark):
    rng = random.Random(4)
    cycle = ["red", "green", "blue", "black", "white"]
    texts = [" ".join(cycle[(i + j) % 5] for j in range(40)) for i in range(400)] + [" ".join(rng.choice(cycle) for _ in range(40)) for _ in range(20)] + [None, "", "unseen words only"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    vocab, counts = window_lm.vocabulary(window_lm.word_counts(docs))
    assert counts.sum() == sum(len((t or "").split()) for t in texts)
    net = window_lm.train(docs, vocab, counts)
    got = {r.doc_id: r for r in window_lm.score(docs, vocab, counts, net).collect()}
    start = {r.doc_id: r for r in window_lm.score(docs, vocab, counts, window_lm.Network(counts)).collect()}
    mean = lambda rows, ids: np.mean([rows[i].mean_log_likelihood for i in ids])
    assert mean(got, range(400)) > mean(start, range(400)) + 0.2
    assert mean(got, range(400)) > mean(got, range(400, 420)) + 0.2
    assert (got[420].n_tokens, got[420].log_likelihood, got[420].mean_log_likelihood) == (0, 0.0, None) and got[422].n_tokens == 3
    empty = docs.limit(0)
    assert window_lm.score(empty, *window_lm.vocabulary(window_lm.word_counts(empty)), window_lm.train(empty, [], np.zeros(window_lm.OTHER))).count() == 0


def test_language_model_probabilities_sum_to_one_and_gradients_are_right():
    rng, size = np.random.default_rng(5), 700
    net = window_lm.Network((1000 / (1 + np.arange(size))).round())
    net.p = {k: v.astype(np.float64) + rng.normal(0, 0.3, v.shape) for k, v in net.p.items()}
    around = np.repeat(rng.integers(0, size, (4, 1)), size, axis=1)
    assert abs(np.exp(net.log_probabilities(np.arange(size), around)).sum() - 1) < 1e-6
    tokens, around = rng.integers(0, size, 50), rng.integers(0, size + 1, (4, 50))
    for k, g in net.gradients(tokens, around).items():
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        old, e = net.p[k][at], 1e-5
        net.p[k][at] = old + e
        up = -net.log_probabilities(tokens, around).mean()
        net.p[k][at] = old - e
        down = -net.log_probabilities(tokens, around).mean()
        net.p[k][at] = old
        assert abs((up - down) / (2 * e) - g[at]) < 1e-4, k


def test_language_model_begins_with_the_corpus_shares():
    counts = np.array([500.0, 300, 100, 50, 30, 11, 7, 1, 1, 0])
    net = window_lm.Network(counts)
    net.p["N"][:] = 0
    got = np.exp(net.log_probabilities(np.arange(10), np.zeros((4, 10), int)))
    assert np.allclose(got, (counts + 1) / (counts + 1).sum(), atol=1e-6)


def test_words_and_tokens_of_batches_equal_those_of_single_words():
    import pyarrow as pa

    from docweave.llm.common import ascii_lower_words, words_of_batch

    texts = [None, "", " ", "a", " A  b\tC\n", "x\x0by\x0cz\rÄÖ \u00a0 É", "ß\x1cq \x85", "end ", "日本 語"] * 3
    for column in (pa.array(texts), pa.array(["skip me", *texts])[1:], pa.array([], pa.string())):
        words, sizes = words_of_batch(column)
        want = [ascii_lower_words(t) for t in column.to_pylist()]
        assert words.to_pylist() == [w for ws in want for w in ws] and sizes.tolist() == [len(w) for w in want]
        vocab = [b"a", b"b", "日本".encode()]
        tokens = window_lm.Tokens(vocab).of(words)
        assert tokens.tolist() == [vocab.index(w) if w in vocab else 3 + window_lm.class_of(w) for ws in want for w in ws]


def one_by_one(text, words, net, corpus_counts):
    """The sum of log-probabilities of a text, token by token and turn by turn."""
    seen, totals = {w: i for i, w in enumerate(words)}, np.ones(window_lm.OTHER)
    for w, n in corpus_counts.items():
        if w not in seen:
            totals[window_lm.class_of(w)] += n + 1
    split = text.encode().lower().split()
    first = net.tokens - window_lm.OTHER
    ids = [seen.get(w, first + window_lm.class_of(w)) for w in split]
    out = 0.0
    for i, token in enumerate(ids):
        z = net.p["e"].astype(float)
        for place, o in enumerate(window_lm.OFFSETS):
            z = z + net.p["C"][place] * net.p["E"][ids[i + o] if 0 <= i + o < len(ids) else net.tokens]
        h = np.tanh(z)
        for step in range(int(net.tree.depth[token])):
            node, turn = net.tree.path[net.tree.starts[token] + step], net.tree.turn[net.tree.starts[token] + step]
            p = 1 / (1 + np.exp(-(net.p["N"][node] @ h + net.p["n"][node])))
            out += np.log(p if turn else 1 - p)
        if token >= first:
            out += np.log(max(1, corpus_counts.get(split[i], 0))) - np.log(totals[token - first])
    return out


def test_language_model_scores_are_those_of_each_token_and_do_not_depend_on_partitions(spark, monkeypatch):
    rng = random.Random(9)
    common = [f"c{i}" for i in range(200)]
    texts = [" ".join(rng.choice(common) if rng.random() < 0.9 else f"r{rng.randrange(3000)}" for _ in range(rng.randint(1, 120))) for _ in range(300)]
    texts += [texts[0], None, "", " \n ", "One \t c1  c2\nX\x0b\u00a0y"]
    rows = [(i if i % 50 else None, t, "x") for i, t in enumerate(texts)]
    monkeypatch.setattr(window_lm, "SHARD_WORDS", 4000)
    monkeypatch.setattr(window_lm, "SHARD_WORDS_A_TOKEN", 1)
    found = []
    for parts in (2, 16):
        docs = spark.createDataFrame(rows, "doc_id long, text string, word string").repartition(parts)
        corpus = window_lm.word_counts(docs)
        vocab, counts = window_lm.vocabulary(corpus)
        net = window_lm.train(docs, vocab, counts)
        found.append({(r.doc_id, r.n_tokens, r.log_likelihood) for r in window_lm.score(docs, vocab, counts, net).collect()})
    assert window_lm.shards_of(counts.sum(), len(counts)) > 3
    assert sorted(found[0], key=str) == sorted(found[1], key=str)
    known = {bytes(r.word): r.n for r in corpus.collect()}
    want = {(i, one_by_one(t, vocab, net, known)) for i, t, _ in rows if i is not None and t}
    got = {i: x for i, _, x in found[0]}
    assert all(abs(got[i] - x) < 1e-3 for i, x in want) and got[303] == 0


def test_language_model_vocabulary_grows_and_every_word_has_its_own_probability(spark):
    rng = random.Random(7)
    common = [f"c{i}" for i in range(3000)]
    texts = [" ".join(rng.choice(common) for _ in range(50)) for _ in range(1000)] + ["hapaxes once xyzed"] + ["seldom word xqzed"] * 5
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    corpus = window_lm.word_counts(docs).cache()
    vocab, counts = window_lm.vocabulary(corpus)
    limit = window_lm.threshold(int(counts.sum()))
    assert set(vocab) == {bytes(r.word) for r in corpus.collect() if r.n >= limit} and len(vocab) > 2000 and int(counts.sum()) == sum(len(t.split()) for t in texts)
    net = window_lm.Network(counts)
    assert net.tokens == len(counts) == len(vocab) + window_lm.OTHER
    # words of one class (the same last three bytes) between the same neighbours: five times, once, never
    probe = spark.createDataFrame([(0, "c1 xqzed c2"), (1, "c1 xyzed c2"), (2, "c1 xkzed c2")], "doc_id long, text string")
    got = {r.doc_id: r.log_likelihood for r in window_lm.score(probe, vocab, counts, net, corpus=corpus).collect()}
    assert abs(got[0] - got[1] - np.log(5)) < 1e-6 and got[1] == got[2]
    totals = window_lm.class_totals(corpus, vocab)
    rest = [(bytes(r.word), r.n) for r in corpus.collect() if bytes(r.word) not in set(vocab)]
    assert totals.sum() == sum(n + 1 for _, n in rest) + window_lm.OTHER
