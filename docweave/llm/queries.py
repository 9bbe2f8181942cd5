"""Queries over the driver's tables, one for each operator of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, fill_in_middle, filter_audit, mixing, near_duplicates, packing, passage_quality, quality_rules, secrets, token_counts, token_file, toxicity, window_lm
from .common import Scratch, crc_fold, read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    if f.__name__ in ALL_SQL:
        ORACLE_SQL[f.__name__] = ALL_SQL[f.__name__]
    return f


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: All links by counting common shingles of all pairs, then all that can be reached.
ALL_SQL = {
    "op3_near_duplicates": rf"""WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT doc_id, unnest(list_distinct(CASE WHEN len(ws) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) END)) AS sh FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS m FROM documents UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.m = e.a),
c AS (SELECT doc_id, min(m) AS component_id FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept FROM documents d JOIN c USING (doc_id) LEFT JOIN n USING (doc_id)""",
    "op9_mixing": r"""WITH t AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size, CAST(length(regexp_replace(text, '[^\p{L} ]+', '', 'g')) AS DOUBLE) / nullif(length(text), 0) AS plain,
  (CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':17'), 1, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496::DOUBLE AS u FROM documents),
d AS (SELECT doc_id, source, size, -ln(u) / greatest(0.2::DOUBLE, coalesce(plain * plain, 0.2::DOUBLE)) AS k FROM t),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS i FROM d GROUP BY source),
w AS (SELECT *, CAST([5, 2, 1][(i - 1) % 3 + 1] AS DOUBLE) AS weight, 3::DOUBLE * source_size AS cap FROM s),
o AS (SELECT *, cap / weight AS ratio FROM w),
v AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY ratio, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (ORDER BY ratio, i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM o),
g AS (SELECT *, least(cap, weight * (SELECT level FROM v WHERE ratio >= level ORDER BY ratio, i LIMIT 1)) AS target FROM v),
b AS (SELECT source, source_size, target, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS epochs FROM g),
f AS (SELECT doc_id, size, source_size, target, epochs, target - epochs * source_size AS budget, coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY k, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size, source_size, target, CAST((epochs + CASE WHEN before + size / 2::DOUBLE <= budget THEN 1 ELSE 0 END) * size AS BIGINT) AS taken FROM f""",
    "op12_filter_audit": r"""WITH l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels GROUP BY doc_id),
t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS x, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
d AS (SELECT t.part, coalesce(good, 0) AS good, coalesce(bad, 0) AS bad, [len(w) < 50, 100 * len(list_distinct(w)) < 65 * len(w), 100 * length(regexp_replace(x, '[^A-Z]+', '', 'g')) > 5 * length(x),
  regexp_matches(x, '[#$%&*|]'), t.doc_id > min(t.doc_id) OVER (PARTITION BY x)] AS fails FROM t LEFT JOIN l ON l.doc_id = t.doc_id),
g AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(bad) AS bad FROM d GROUP BY part, fails),
c AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c),
o AS (SELECT v.c || w.c || x.c || y.c || z.c AS filter_order FROM c v, c w, c x, c y, c z WHERE len(list_distinct([v.c, w.c, x.c, y.c, z.c])) = 5),
s AS (SELECT filter_order, unnest(range(1, 6)) AS step FROM o),
e AS (SELECT part, filter_order, step, n, good, bad, fails[ascii(substr(filter_order, step, 1)) - 64] AS f, len(list_filter(range(1, step), lambda i: fails[ascii(substr(filter_order, i, 1)) - 64])) AS earlier, len(list_filter(fails, lambda q: q)) AS k FROM g, s),
r AS (SELECT part, filter_order, step, sum(CASE WHEN earlier = 0 AND NOT f THEN n ELSE 0 END) AS kept, sum(CASE WHEN earlier = 0 AND f THEN n ELSE 0 END) AS removed, sum(CASE WHEN earlier > 0 AND f THEN n ELSE 0 END) AS redundant,
  sum(CASE WHEN f AND k = 1 THEN n ELSE 0 END) AS unique_fails, sum(CASE WHEN earlier = 0 AND f THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN earlier = 0 AND f THEN bad ELSE 0 END) AS toxic_lost FROM e GROUP BY part, filter_order, step)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, substr(filter_order, step, 1)) AS BIGINT) AS shapley FROM r""",
    "op13_fill_in_middle": r"""WITH t AS (SELECT doc_id, coalesce(text, '') AS x, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS s FROM documents),
h AS (SELECT *, len(u) AS n, list_transform(range(4), lambda i: CAST('0x' || substr(s, 8 * i + 1, 8) AS BIGINT)) AS h FROM t),
c AS (SELECT *, least(h[1] % (n + 1), h[2] % (n + 1)) AS a, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS b,
  CASE WHEN x = '' OR contains(x, '<P>') OR contains(x, '<S>') OR contains(x, '<M>') OR h[3] % 100 >= 50 THEN 'plain' WHEN h[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT doc_id, n, form, x, array_to_string(u[1:a], '') AS pre, array_to_string(u[a + 1:b], '') AS mid, array_to_string(u[b + 1:n], '') AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN x WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(x) AS restored_sha256 FROM p""",
}


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def in_training(id_col: str, parts: int, held_out: int) -> Column:
    """Rows whose crc32 of the id's text doesn't leave `held_out` modulo `parts`."""
    return crc_fold(F.col(id_col), parts) != held_out


@query
def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


@query
def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = token_counts.prefix_counts(read(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))
    return out.select("doc_id", "n_bytes", F.col("n_tokens"), (F.col("n_tokens") > 2048).alias("over_limit"), "budget_chars")


@query
def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.near_duplicates(read(spark, sf_dir, "documents"), width=3, percent=85).drop("text_hash")


@query
def op4_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, scratch = read(spark, sf_dir, "documents"), Scratch(spark, "lm")
    corpus = scratch.keep(window_lm.word_counts(docs), "words")
    words, counts = window_lm.vocabulary(corpus)
    return window_lm.score(docs, words, counts, window_lm.train(docs, words, counts), corpus=corpus)


@query
def op5_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = Scratch(spark, "token-file").base
    token_file.write_token_file(read(spark, sf_dir, "documents"), path, vocabulary("byte_bpe_50k.json"), end_id=2)
    return token_file.read_token_file(spark, path, with_ids=False).select("doc_id", "start", "n_tokens", "ids_crc32")


@query
def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return secrets.find_secrets(read(spark, sf_dir, "documents"), (vocabulary("byte_bpe_50k.tiktoken"), vocabulary("byte_bpe_multi_50k.tiktoken")), public_tokenizers.PATTERN)


@query
def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.judge(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality")


def _predicted(scores: DataFrame, parts: int, held_out: int) -> DataFrame:
    return scores.select("doc_id", (~in_training("doc_id", parts, held_out)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query
def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return _predicted(toxicity.score(docs, toxicity.train(docs, read(spark, sf_dir, "labels"), in_training("doc_id", 5, 0))), 5, 0)


@query
def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.takes(read(spark, sf_dir, "documents"))


@query
def op10_passage_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return _predicted(passage_quality.score(docs, passage_quality.train(docs, read(spark, sf_dir, "labels"), in_training("doc_id", 3, 1))), 3, 1)


@query
def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.placements(packing.pack_documents(read(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), end_id=0))


@query
def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit_documents(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


@query
def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fill_in_middle.restored(fill_in_middle.fill_in_middle(read(spark, sf_dir, "documents")))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))
