"""Registered queries of records, stored tables, names and images, and the same in SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.config import PRONOUNS
from docweave.functions import text as T
from docweave.functions import vectors as V
from docweave.lineage import shared_dir
from docweave.operators import clusters, entities, figures, pool, preparation, resolution, staging, tasks
from docweave.sources import tables

from .queries import _TASKS_ONE, _VEC, _tasks, _vectors, query, table


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/docweave-{name}-{uuid.uuid4().hex[:12]}"


_TOP = """t AS (SELECT source, doc_id, unnest(regexp_extract_all(text, '[一-鿿A-Za-z]{2,}')) AS token, generate_subscripts(regexp_extract_all(text, '[一-鿿A-Za-z]{2,}'), 1) AS pos FROM documents),
c AS (SELECT source, token, count(*) AS n, min((doc_id, pos)) AS place FROM t GROUP BY source, token), r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, place) AS r FROM c)"""


@query(f"WITH {_TOP} SELECT source, string_agg(token, ',' ORDER BY r) AS concepts FROM r WHERE r <= 15 GROUP BY source")
def pool_concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pool.top_concepts(table(spark, sf_dir, "documents").select("source", "doc_id", F.col("text").alias("body")), ["source"], order="doc_id")
    return found.select("source", F.array_join("concepts", ",").alias("concepts"))


@query("""WITH n AS (SELECT p_brand, list(p_name ORDER BY p_name, p_partkey) AS names, list(p_type ORDER BY p_type, p_partkey) AS kinds FROM part GROUP BY p_brand)
SELECT p_brand, '請替下列文件取一個知識庫名稱，並寫一句描述。' || chr(10) || '文件：' || chr(10) || array_to_string(list_transform(names[1:10], lambda n: '- ' || n), chr(10)) || chr(10) || '關鍵概念：' || array_to_string(kinds[1:20], '、')
  || chr(10) || '請只回兩行：' || chr(10) || '名稱：（2 到 8 個字）' || chr(10) || '描述：（一句話）' AS prompt FROM n""")
def naming_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts list ten names and twenty concepts at most."""
    listed = lambda c: F.transform(F.sort_array(F.collect_list(F.struct(c, "p_partkey"))), lambda x: x[c]).alias(c)
    rows = table(spark, sf_dir, "part").groupBy("p_brand").agg(listed("p_name"), listed("p_type"))
    return rows.select("p_brand", pool.naming_prompt(F.col("p_name"), F.col("p_type")).alias("prompt"))


@query(r"""SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN '新知識庫' ELSE p_brand END AS name, CASE p_partkey % 4 WHEN 1 THEN '' ELSE p_type END AS description FROM part""")
def naming_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.expr("CASE p_partkey % 4 WHEN 0 THEN '描述： ' || p_type WHEN 1 THEN '好的\n 名稱：' || p_brand || ' ' WHEN 2 THEN '名稱：x\n名稱：' || p_brand || '\n描述：' || p_type ELSE '  名称：' || p_brand || '\r\n描述：' || p_type || ' \n' END")
    name, description = T.naming_reply(raw)
    return table(spark, sf_dir, "part").select("p_partkey", name.alias("name"), description.alias("description"))


@query("SELECT vec_id AS item FROM embeddings WHERE label % 3 = 0 OR vec_id % 11 = 0")
def pool_unclustered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is noise, or has no vector, stays in the pool."""
    rows = _vectors(spark, sf_dir).select(F.col("vec_id").alias("item"), F.when((F.col("label") % 3 == 0) | (F.col("vec_id") % 11 == 0), -1).otherwise(F.col("label")).alias("label"))
    return pool.unclustered(rows)


@query("""WITH l AS (SELECT label % 3 AS pool, vec_id, (vec_id * 7 + label) % 5 - 1 AS label FROM embeddings), c AS (SELECT pool, label, count(*) AS n, min(vec_id) AS f FROM l WHERE label >= 0 GROUP BY pool, label)
SELECT pool, label, n FROM (SELECT *, row_number() OVER (PARTITION BY pool ORDER BY n DESC, f) AS r FROM c) WHERE r = 1""")
def dominant_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select((F.col("label") % 3).alias("pool"), "vec_id", ((F.col("vec_id") * 7 + F.col("label")) % 5 - 1).alias("label"))
    return clusters.dominant_label(rows, "pool", "vec_id")


@query("""SELECT CAST(o_orderkey AS VARCHAR) AS source, CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_custkey % 5 AS INT) ELSE CAST(o_custkey % 9 AS INT) END AS svo_total_chunks, CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_orderkey AS DOUBLE) END AS x0 FROM orders""")
def record_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Window totals and vectors kept in the records of all orders."""
    o = table(spark, sf_dir, "orders").withColumn("source", F.col("o_orderkey").cast("string"))
    records = o.select("source", (F.col("o_custkey") % 9).cast("int").alias("svo_total_chunks"), F.lit(None).cast("array<double>").alias("document_vector"))
    out = tasks.set_window_total(records, o.where("o_orderkey % 2 = 0").select("source", (F.col("o_custkey") % 5).alias("total")))
    out = tasks.set_vectors(out, o.where("o_orderkey % 3 = 0").select("source", F.array(F.col("o_orderkey").cast("double"), F.lit(1.0)).alias("vector")))
    return out.select("source", "svo_total_chunks", F.get("document_vector", F.lit(0)).alias("x0"))


@query("""SELECT CAST(o_orderkey AS VARCHAR) AS source, 10 AS total_sentences, CASE WHEN o_orderkey % 4 = 0 THEN CAST(o_custkey % 11 AS INT) ELSE 3 END AS normalization_progress,
CASE WHEN o_orderkey % 4 <> 0 THEN 'pending' WHEN o_custkey % 11 = 10 THEN 'completed' ELSE 'processing' END AS normalization_status FROM orders""")
def record_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").withColumn("source", F.col("o_orderkey").cast("string"))
    records = o.select("source", F.lit(10).alias("total_sentences"), F.lit(3).alias("normalization_progress"), F.lit("pending").alias("normalization_status"))
    return tasks.set_progress(records, o.where("o_orderkey % 4 = 0").select("source", (F.col("o_custkey") % 11).cast("int").alias("progress")))


@query(f"WITH {_TASKS_ONE} SELECT CAST(kg_id AS VARCHAR) AS kg_id, source, chunk_index, CASE WHEN status = 'processing' THEN 'pending' ELSE status END AS status FROM q")
def queue_ready(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored queue after a restart."""
    path = _folder(spark, "tasks")
    rows = _tasks(spark, sf_dir)
    tables.write(rows, path, "tasks", None)
    return tasks.ensure_ready(spark, path, rows.limit(0))


@query("""SELECT CAST(kg AS VARCHAR) AS kg_id, CAST(conv_id AS VARCHAR) AS source, len(s) AS total, md5(array_to_string(s, chr(10))) AS digest
FROM (SELECT conv_id % 5 AS kg, conv_id, list(coalesce(CASE WHEN conv_id % 5 = 2 THEN replace(text, 'e', 'E') ELSE text END, '') ORDER BY turn) AS s FROM conversations GROUP BY conv_id)""")
def stored_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences written by collection; one collection is written again, with other letters, and the others stay."""
    path = _folder(spark, "sentences")
    listed = F.transform(F.sort_array(F.collect_list(F.struct("turn", F.coalesce("text", F.lit("")).alias("t")))), lambda x: x["t"]).alias("sentences")
    rows = table(spark, sf_dir, "conversations").groupBy((F.col("conv_id") % 5).alias("kg_id"), F.col("conv_id").alias("source")).agg(listed).withColumn("total", F.size("sentences"))
    tables.write(rows, path, "sentences")
    tables.write(rows.where("kg_id = 2").withColumn("sentences", F.transform("sentences", lambda t: F.replace(t, F.lit("e"), F.lit("E")))), path, "sentences")
    return tables.read(spark, path, "sentences").select("kg_id", "source", "total", F.md5(F.array_join("sentences", "\n")).alias("digest"))


@query(f"SELECT DISTINCT word FROM (SELECT unnest([{', '.join(repr(p) for p in PRONOUNS)}]) AS word UNION ALL SELECT CASE p_partkey % 3 WHEN 0 THEN '  ' WHEN 1 THEN '他' ELSE p_brand END FROM part) WHERE trim(word) <> ''")
def lexicon_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return staging.lexicon(table(spark, sf_dir, "part").select(F.expr("CASE p_partkey % 3 WHEN 0 THEN '  ' WHEN 1 THEN '他' ELSE p_brand END").alias("word")))


@query("""SELECT p_partkey, p_brand || ':' || CASE p_size % 3 WHEN 0 THEN '人物' WHEN 1 THEN '組織' ELSE '概念' END || ',A-' || p_partkey || ':概念' AS mentions FROM part""")
def mention_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a tagger found, with the types it has here, and codes; each text once."""
    kind = entities.entity_type(F.expr("CASE p_size % 3 WHEN 0 THEN 'PERSON' WHEN 1 THEN 'ORG' ELSE 'MISC' END"))
    tagged = F.array(F.struct(F.col("p_brand").alias("text"), kind.alias("entity_type")), F.struct(F.concat(F.lit("A-"), "p_partkey").alias("text"), F.lit("概念").alias("entity_type")))
    found = entities.mentions_of(F.concat(F.lit("see A-"), "p_partkey", F.lit(" and A-"), "p_partkey", F.lit(" of "), "p_brand"), tagged)
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(F.transform(found, lambda m: F.concat(m["text"], F.lit(":"), m["entity_type"])), ",").alias("mentions"))


@query(f"""WITH {_VEC} SELECT vec_id, round(CASE WHEN label = 0 THEN x[1] ELSE (p[1] * label + x[1]) / (label + 1) END, 6) AS x0, round(CASE WHEN label = 0 THEN x[64] ELSE (p[64] * label + x[64]) / (label + 1) END, 6) AS x63
FROM (SELECT *, lag(x) OVER (ORDER BY vec_id) AS p FROM v) WHERE p IS NOT NULL""")
def running_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean of `label` vectors (those of the row before) with one more."""
    v = _vectors(spark, sf_dir)
    before = v.select((F.col("vec_id") + 1).alias("vec_id"), F.col("vector").alias("old"))
    mean = V.updated_mean(F.col("old"), F.col("label"), F.col("vector"))
    return v.join(before, "vec_id").select("vec_id", F.round(mean[0], 6).alias("x0"), F.round(mean[63], 6).alias("x63"))


@query("SELECT p_partkey, p_name AS name FROM part WHERE p_size = 7 AND p_brand = (SELECT min(p_brand) FROM part)")
def entity_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    rows = p.select(F.col("p_brand").alias("kg_id"), F.col("p_size").alias("entity_type"), F.col("p_name").alias("name"), "p_partkey")
    return resolution.entities_of(rows, F.lit(p.agg(F.min("p_brand")).first()[0]), F.lit(7)).select("p_partkey", "name")


@query("SELECT l_orderkey, l_linenumber, l_partkey, CASE l_returnflag WHEN 'A' THEN 'CAUSES' WHEN 'N' THEN 'USES' ELSE 'IS_A' END AS rel_type FROM lineitem")
def relation_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    rel = F.expr("CASE l_returnflag WHEN 'A' THEN 'CAUSES' WHEN 'N' THEN 'USES' ELSE 'IS_A' END")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", staging.strict_relation(rel).alias("rel_type"))


@query("SELECT p_partkey, p_name || chr(10) || '---' || chr(10) || p_type AS body FROM part")
def chunk_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bodies of chunk files; only the block at the top is taken off."""
    head = T.front_matter(source=F.col("p_brand"), chunk_index=F.col("p_partkey"))
    file = F.concat(head, F.lit("\n\n"), "p_name", F.lit("\n---\n"), "p_type")
    return table(spark, sf_dir, "part").select("p_partkey", T.without_front_matter(file).alias("body"))


@query("""WITH s AS (SELECT conv_id, list(coalesce(text, '') ORDER BY turn) AS s, count(*) AS n FROM conversations GROUP BY conv_id), w AS (SELECT *, unnest(range(0, CAST(greatest(ceil((n - 5) / 3.0), 0) AS BIGINT) + 1)) AS i FROM s)
SELECT conv_id, CAST(i + 1 AS INT) AS chunk_index, CAST(greatest(ceil((n - 5) / 3.0), 0) AS INT) + 1 AS total, CAST(3 * i + 1 AS INT) AS sentence_start, CAST(least(3 * i + 5, n) AS INT) AS sentence_end, md5(array_to_string(s[3 * i + 1:3 * i + 5], '|')) AS original,
  md5(array_to_string(list_transform(s[3 * i + 1:3 * i + 5], lambda t: replace(t, 'the', 'THE')), '|')) AS normalized FROM w""")
def prepared_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as documents of one sentence a turn, prepared for extraction; the resolver rewrites where the lexicon's words are, here none, so the sentences are as given."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("int").alias("sentence_idx"), F.coalesce("text", F.lit("")).alias("sentence"))
    windows, _ = preparation.prepare(rows, doc="conv_id")
    joined = lambda c: F.md5(F.array_join(c, "|"))
    return windows.select("conv_id", "chunk_index", "total", "sentence_start", "sentence_end", joined("original").alias("original"), joined(F.transform("normalized", lambda t: F.replace(t, F.lit("the"), F.lit("THE")))).alias("normalized"))


_IMAGES = """i AS (SELECT CAST(l_suppkey AS VARCHAR) AS doc_id, CAST(l_linenumber AS INT) AS page, l_orderkey * 1000000 + l_partkey AS image_id, CAST(l_quantity * 10 AS DOUBLE) AS y1, CAST(l_quantity * 3 AS DOUBLE) AS width, 60.0 AS height,
  CAST(l_discount * 1000 AS DOUBLE) AS ocr_confidence, CASE WHEN l_partkey % 4 = 0 THEN '' ELSE 'text ' || l_partkey END AS ocr_text, CAST(l_partkey % 101 AS DOUBLE) AS graphic, CASE l_linenumber % 3 WHEN 0 THEN 'pptx' WHEN 1 THEN 'pdf_native' ELSE 'docx' END AS doc_type FROM lineitem)"""


@query(f"""WITH {_IMAGES}, p AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page, y1 DESC, image_id) AS ord FROM i WHERE width >= 40 AND height >= 40),
s AS (SELECT *, round(0.3 * CASE doc_type WHEN 'pptx' THEN 90 ELSE 25 END + 0.4 * least(100, CASE WHEN ocr_text <> '' AND ocr_confidence < 30 THEN greatest(greatest(0, 100 - ocr_confidence), 85) ELSE greatest(0, 100 - ocr_confidence) END) + 0.3 * graphic, 2) AS score FROM p),
b AS (SELECT *, '[圖片:自補圖-' || ord || ']' || chr(10) || CASE WHEN ocr_text <> '' THEN '圖片 OCR 文字（來源: OCR' || CASE WHEN score >= 60 THEN '，資訊可能不足' ELSE '' END || '）: ' || ocr_text ELSE '（圖片無可辨識文字內容）' END AS block FROM s)
SELECT doc_id, page, md5('--- [第 ' || page || ' 頁圖片解析] ---' || chr(10) || string_agg(block, chr(10) || chr(10) ORDER BY ord)) AS digest, count(*) AS images, count(*) FILTER (score >= 60) AS upgraded FROM b GROUP BY doc_id, page""")
def image_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images scored, numbered in reading order and put into the text of their page."""
    rows = table(spark, sf_dir, "lineitem").selectExpr(
        "CAST(l_suppkey AS STRING) AS doc_id", "CAST(l_linenumber AS INT) AS page", "l_orderkey * 1000000 + l_partkey AS image_id", "CAST(l_quantity * 10 AS DOUBLE) AS y1", "CAST(l_quantity * 3 AS DOUBLE) AS width", "60D AS height",
        "CAST(l_discount * 1000 AS DOUBLE) AS ocr_confidence", "CASE WHEN l_partkey % 4 = 0 THEN '' ELSE 'text ' || l_partkey END AS ocr_text", "CAST(l_partkey % 101 AS DOUBLE) AS graphic",
        "CASE l_linenumber % 3 WHEN 0 THEN 'pptx' WHEN 1 THEN 'pdf_native' ELSE 'docx' END AS doc_type", "CAST(NULL AS STRING) AS caption", "CAST(NULL AS STRING) AS full_text", "false AS force")
    done = figures.process(rows)
    counts = done.groupBy("doc_id", "page").agg(F.count("*").alias("images"), F.count_if("upgraded").alias("upgraded"))
    return figures.page_blocks(done).join(counts, ["doc_id", "page"]).select("doc_id", "page", F.md5("text").alias("digest"), "images", "upgraded")
