import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from docweave.llm import token_counts, token_file

TEXTS = [
    None, "", " ", "one", "  a    b <|endoftext|> x\n\n y  ", "It's  \t tabs\x1c x don't      q \n", "́ ́a café ΑΣ Σ. İ ", "word.\nNext,line!!! &&& a&b",
    "the same", "the same", "x " * 3000, "日本語 テスト 👩‍👩‍👧 ok", "A1b2 3.14,000 e-mail@x.org_ñandú über-straße", "a\n b \nc\r\nd", " lead", "trail ", "no" + "spaces" * 500,
]


@pytest.fixture
def docs(spark):
    return spark.createDataFrame([(i, t, "clash", 5) for i, t in enumerate(TEXTS)], "doc_id long, text string, n_tokens string, start int")


def tokenizer(name):
    return Tokenizer.from_file(public_tokenizers.path(name))


LONG = ["x1,y.é;" * 4000, "日本語テスト" * 900, "ab" * 12000, "word " * 30000 + "end"]


def ends_of(t, text):
    return list(np.maximum.accumulate([e for _, e in t.encode(text, add_special_tokens=False).offsets] or [0]))[: len(t.encode(text, add_special_tokens=False).ids)]


def test_counts_of_every_prefix_equal_the_librarys(spark, docs):
    t = tokenizer("word_bpe_49k.json")
    more = spark.createDataFrame([(100 + i, x, "clash", 5) for i, x in enumerate(LONG)] + [(None, "null id", "c", 1)], docs.schema)
    found = token_counts.prefix_counts(docs.union(more), public_tokenizers.path("word_bpe_49k.json"), budget=7).collect()
    assert len(found) == len(TEXTS) + len(LONG) + 1
    for r in found:
        text = "null id" if r.doc_id is None else (LONG[r.doc_id - 100] if r.doc_id >= 100 else TEXTS[r.doc_id]) or ""
        want = ends_of(t, text)
        assert (r.n_tokens, r.n_bytes, r.prefix_ends) == (len(want), len(text.encode()), want)
        # where a text can be cut between words, the count is that of the prefix by itself
        ends = [e for e in dict.fromkeys(want) if e == len(text) or text[e] in " \n\t\r"]
        for end in ends[:: max(1, len(ends) // 40)]:
            assert sum(e <= end for e in want) == len(t.encode(text[:end], add_special_tokens=False).ids)
        assert r.budget_chars == max([e for e in want if sum(x <= e for x in want[:20]) <= 7 and e <= (want[7] if len(want) > 7 else e)], default=0)


def test_questions_are_answered_from_the_array(docs):
    out = token_counts.prefix_counts(docs, public_tokenizers.path("word_bpe_49k.json"), budget=7)
    rows = out.select("*", token_counts.chars_within(7).alias("c"), token_counts.tokens_before(4).alias("t")).collect()
    for r in rows:
        assert r.c == r.budget_chars and r.t == sum(e <= 4 for e in r.prefix_ends)
    assert any(r.c for r in rows) and token_counts.prefix_counts(docs.limit(0), public_tokenizers.path("word_bpe_49k.json")).count() == 0


@pytest.mark.parametrize("partitions", [1, 5])
def test_token_file_round_trip(spark, docs, tmp_path, partitions):
    t, path = tokenizer("byte_bpe_50k.json"), f"{tmp_path}/f"
    token_file.write_token_file(docs.repartition(partitions), path, public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    start = 0
    for r in sorted(token_file.read_token_file(spark, path).collect()):
        ids = [*t.encode(TEXTS[r.doc_id] or "", add_special_tokens=False).ids, 2]
        raw = np.array(ids, "<u4").tobytes()
        assert (r.start, r.n_tokens, r.ids_crc32, bytes(r.ids)) == (start, len(ids), zlib.crc32(raw), raw)
        start += len(ids)


def test_token_file_of_repeated_null_and_no_rows(spark, tmp_path):
    rows = spark.createDataFrame([(5, "b c"), (None, "a"), (5, "b c"), (None, None)], "doc_id long, text string")
    for i, d in enumerate((rows, rows.limit(0))):
        token_file.write_token_file(d, f"{tmp_path}/{i}", public_tokenizers.path("byte_bpe_50k.json"))
    got = sorted(token_file.read_token_file(spark, f"{tmp_path}/0").collect(), key=lambda r: r.start)
    assert [(r.doc_id, r.n_tokens) for r in got] == [(None, 1), (None, 2), (5, 3), (5, 3)]
    assert [r.start for r in got] == [0, 1, 3, 6]
    assert token_file.read_token_file(spark, f"{tmp_path}/1").collect() == []


def test_codes_are_optimal_within_the_limit():
    rng = np.random.default_rng(1)
    counts = np.zeros(300, np.int64)
    counts[rng.choice(300, 200, replace=False)] = (rng.pareto(0.5, 200) * 10).astype(np.int64) + 1
    lengths = token_file.code_lengths(counts, 12)
    used = counts > 0
    assert lengths[used].max() <= 12 and (lengths[~used] == 0).all()
    assert np.isclose((2.0 ** -lengths[used].astype(float)).sum(), 1)
    free = token_file.code_lengths(counts, 40)
    assert (counts * free).sum() <= (counts * lengths).sum() <= (counts * (free + 1)).sum()
    assert list(token_file.code_lengths(np.array([0, 3, 0]))) == [0, 1, 0]


def test_stretches_decode_alone():
    rng = np.random.default_rng(2)
    ids = rng.zipf(1.3, 5000) % 1000
    code = token_file.Code(token_file.code_lengths(np.bincount(ids, minlength=1000)))
    n, marks, bits = code.encode(ids)
    assert n == 5000 and (code.decode(bits, marks, np.array([5000]), code.table()) == ids).all()
    k = 7 * token_file.STEP
    assert (code.decode(bits, marks[7:8], np.array([token_file.STEP]), code.table()) == ids[k : k + token_file.STEP]).all()


def test_clashing_columns_are_left_out(docs):
    out = token_counts.prefix_counts(docs, public_tokenizers.path("word_bpe_49k.json"))
    assert dict(out.dtypes)["n_tokens"] == "bigint" and out.where(F.col("doc_id").isNull()).count() == 0
