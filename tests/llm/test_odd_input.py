"""Nulls, empty and very long texts, repeated rows, empty tables and clashing columns, for every operator and every stage."""

import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from docweave.llm import decontamination, fill_in_middle, filter_audit, mixing, near_duplicates, packing, passage_quality, quality_rules, secrets, token_counts, token_file, toxicity, window_lm
from docweave.llm.common import read
from docweave.llm.queries import QUERIES

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id int, h string, n string, node string, row string, score string, part string, key string, __id int, __hash int, __row int, spans int, kept int, n_words string, target string"


def rows():
    rng = random.Random(1)
    words = ["the", "red", "fox", "runs", "over", "a", "hill", "again", "vermin"]
    texts = [" ".join(rng.choice(words) + str(rng.randrange(50)) for _ in range(rng.randint(1, 90))) for _ in range(60)]
    texts += [None, None, "", "", " \n\t ", texts[0], texts[0], "word " * 150_000 + "end", "x" * 400_000, "日本語" * 60_000]
    ids = [*range(len(texts) - 7), None, None, 3, 3, 9000, 9001, 9002]
    return [(i, t, "en", ["a", "b", None][len(t or "") % 3], 1, 1, "h", "n", "q", "r", "s", "p", "k", 1, 2, 3, 4, 5, "w", "t") for i, t in zip(ids, texts, strict=True)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(4)


def lists():
    """Every operator as a function of docs that gives a row for each of docs."""
    path = public_tokenizers.path
    labels = lambda d, name: d.sparkSession.createDataFrame([(i, int(i % 3 == 0)) for i in range(40)] + [(None, 1), (5, None), (6, 1), (6, 0)], f"doc_id long, {name} int")

    def lm(d):
        corpus = window_lm.word_counts(d).cache()
        words, counts = window_lm.vocabulary(corpus)
        return window_lm.score(d, words, counts, window_lm.train(d, words, counts), corpus=corpus)

    def tokens(d):
        where = f"/tmp/docweave-test-{random.randrange(1 << 60)}"
        token_file.write_token_file(d, where, path("byte_bpe_50k.json"))
        return token_file.read_token_file(d.sparkSession, where).drop("ids", "start")

    return {
        "op2": lambda d: token_counts.prefix_counts(d, path("word_bpe_49k.json")).drop("prefix_ends"), "op3": near_duplicates.near_duplicates, "op4": lm, "op5": tokens,
        "op6": lambda d: secrets.find_secrets(d, (path("byte_bpe_50k.tiktoken"),), public_tokenizers.PATTERN), "op7": quality_rules.judge,
        "op8": lambda d: toxicity.score(d, toxicity.train(d, labels(d, "toxic"), F.lit(True))), "op9": mixing.takes,
        "op10": lambda d: passage_quality.score(d, passage_quality.train(d, labels(d, "quality"), F.lit(True))).drop("attention"),
        "op13": lambda d: fill_in_middle.restored(fill_in_middle.fill_in_middle(d)),
    }


@pytest.mark.parametrize("name", sorted(lists()))
def test_operators_give_a_row_for_each_row(odd, name):
    operator, docs = lists()[name], odd
    got = [tuple(r) for r in operator(docs).collect()]
    assert len(got) == docs.count()
    three = [r[1:] for r in got if r[0] == 3]  # an id with its own text and two equal rows of another text
    assert len(three) == 3 and len(set(three)) <= 2
    assert len([r for r in got if r[0] is None]) == 2 and operator(odd.limit(0)).collect() == []


def test_searches_and_stages_keep_columns(spark, odd):
    items = spark.createDataFrame([(1, "the word " * 10), (None, "word " * 30), (2, None), (3, "")], "item_id long, text string")
    found = decontamination.contaminated(odd, items)
    assert found.count() == 1 and found.first().item_id is None and decontamination.contaminated(odd, items.limit(0)).count() == 0
    clean = decontamination.clean(odd, items)
    assert clean.columns == odd.columns and clean.count() == odd.count() - 1
    left = near_duplicates.without_copies(odd)
    assert left.columns == odd.columns
    # of texts with words one row each stays, of the least id (null last); those without words all stay
    key = lambda r: (r.doc_id is None, r.doc_id or 0)
    rows_, want = odd.select("doc_id", "text").collect(), {}
    for r in rows_:
        if (r.text or "").split() and (r.text not in want or key(r) < key(want[r.text])):
            want[r.text] = r
    got = [(r.doc_id, r.text) for r in left.select("doc_id", "text").collect()]
    assert sorted(got, key=repr) == sorted([*((r.doc_id, t) for t, r in want.items()), *((r.doc_id, r.text) for r in rows_ if not (r.text or "").split())], key=repr)
    mixed = mixing.mix(odd)
    assert mixed.columns == odd.columns and mixed.groupBy("doc_id", "text").count().agg(F.max("count")).first()[0] <= 9


def test_packing_and_audit_of_odd_rows(spark, odd):
    packed = packing.placements(packing.pack_documents(odd, public_tokenizers.path("byte_bpe_50k.json"))).collect()
    assert len([r for r in packed if r.piece == 0]) == odd.count() and len([r for r in packed if r.doc_id is None]) == 2
    assert packing.placements(packing.pack_documents(odd.limit(0), public_tokenizers.path("byte_bpe_50k.json"))).collect() == []
    labels = spark.createDataFrame([(0, 1, None), (0, 0, 1), (None, 1, 1), (3, 0, 1)], "doc_id long, quality int, toxic int")
    got = filter_audit.audit_documents(odd, labels, source_col="lang").collect()
    assert len(got) == 600 and filter_audit.audit_documents(odd.limit(0), labels).collect() == []
    first = next(r for r in got if r.filter_order == "EABCD" and r.step == 1)
    rows = [(r.doc_id, r.text or "") for r in odd.collect()]
    want = sum(any(t == u and j is not None and (i is None or j < i) for j, u in rows) for i, t in rows)
    assert first.removed == want and first.removed + first.kept == len(rows)


def test_stages_break_ties_alike_whatever_the_partitions(spark, tmp_path):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join(rng.choices(words, k=60)) for _ in range(30)]
    rows = [(i % 25, texts[i % 12], "en", ["a", "b"][i % 2], 1) for i in range(90)] + [(i, texts[12 + i % 18], "en", "c", 1) for i in range(40)] + [(None, texts[0], "en", None, 1)] * 4 + [(7, None, "en", "a", 1), (7, "", "en", "a", 1)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    where = str(tmp_path / "ties")
    spark.createDataFrame([(i, i % 3 == 0) for i in range(25)], "doc_id long, toxic boolean").selectExpr("doc_id", "cast(toxic as int) AS toxic").write.parquet(f"{where}/labels.parquet")
    spark.createDataFrame([(1, texts[3]), (2, texts[3]), (3, texts[20])], "item_id long, text string").write.parquet(f"{where}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES:
        runs = [sorted(map(tuple, stage(spark, docs.repartition(n), where).collect()), key=repr) for n in (1, 6)]
        assert runs[0] == runs[1] and runs[0], name
    left = near_duplicates.without_copies(docs).where("text = '%s'" % texts[0]).collect()
    assert [(r.doc_id, r.text) for r in left] == [(0, texts[0])]  # of equal texts the least id stays, once
    assert {r.text for r in decontamination.clean(docs, read(spark, where, "benchmark")).collect()} == {r[1] for r in rows} - {texts[3], texts[20]}


def test_pipeline_of_odd_and_of_no_documents(spark, odd, tmp_path):
    for name, n in (("odd", 1000), ("none", 0)):
        where = tmp_path / name
        odd.limit(n).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{where}/documents.parquet")
        spark.createDataFrame([(i, int(i % 10 == 1)) for i in range(40)] + [(None, 1), (2, None), (1, 0)], "doc_id long, toxic int").limit(n).write.parquet(f"{where}/labels.parquet")
        spark.createDataFrame([(1, "word " * 30), (2, None)], "item_id long, text string").limit(n).write.parquet(f"{where}/benchmark.parquet")
        got = corpus_pipeline.run(spark, str(where)).collect()
        assert bool(got) == bool(n)
        docs = read(spark, str(where), "documents")
        for _, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, docs, str(where)).columns == docs.columns
    assert sorted(QUERIES) == sorted(f"op{i}_{k}" for i, k in enumerate("decontamination token_counts near_duplicates lm_scores token_file secrets quality_rules toxicity mixing passage_quality packing filter_audit fill_in_middle".split(), 1))
