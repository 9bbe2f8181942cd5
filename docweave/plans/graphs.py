"""Registered queries of traversal with defaults and of votes that merge, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.lineage import cut
from docweave.operators import graph
from docweave.operators.graph import CITATION

from .queries import _MENTIONS, query, table

#: Orders contain parts and were placed by customers: from a customer a third hop leads to the orders that share a part.
_FACTS = """m AS (SELECT 'O' || l_orderkey AS subject, 'CONTAINS' AS rel_type, 'P' || l_partkey AS object, max(CASE WHEN l_partkey % 7 <> 0 THEN 1 + CAST(l_quantity AS INT) % 5 END) AS confidence,
  max(struct_pack(d := l_orderkey, i := l_linenumber, s := l_linenumber * 3, e := l_linenumber * 3 + 4, v := l_returnflag)) AS last FROM lineitem GROUP BY l_orderkey, l_partkey),
f AS (SELECT * FROM m UNION ALL SELECT 'O' || o_orderkey, 'CREATED_BY', 'C' || o_custkey, NULL, NULL FROM orders)"""


def _triples(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Triples with citations, and those of orders and customers, which have none."""
    rows = table(spark, sf_dir, "lineitem").select(
        F.lit("k").alias("kg_id"), F.concat(F.lit("O"), "l_orderkey").alias("subject"), F.lit("CONTAINS").alias("rel_type"), F.concat(F.lit("P"), "l_partkey").alias("object"),
        F.when(F.col("l_partkey") % 7 != 0, 1 + F.col("l_quantity").cast("int") % 5).alias("confidence"), F.col("l_orderkey").alias("source_doc_id"), F.col("l_linenumber").alias("source_svo_chunk_index"),
        (F.col("l_linenumber") * 3).alias("source_sentence_start"), (F.col("l_linenumber") * 3 + 4).alias("source_sentence_end"), F.col("l_returnflag").alias("verb"))
    rows = rows.select("*", *[F.lit(None).cast("string").alias(c) for c in CITATION if c not in rows.columns])
    orders = table(spark, sf_dir, "orders").select(F.lit("k").alias("kg_id"), F.concat(F.lit("O"), "o_orderkey").alias("subject"), F.lit("CREATED_BY").alias("rel_type"), F.concat(F.lit("C"), "o_custkey").alias("object"))
    return rows, orders


@query(f"""WITH RECURSIVE {_FACTS}, b AS (SELECT subject AS a, object AS z FROM f UNION SELECT object, subject FROM f),
w AS (SELECT 'C' || c_custkey AS v, 0 AS d FROM customer WHERE c_acctbal > 9850 UNION SELECT z, d + 1 FROM w JOIN b ON a = v WHERE d < 2),
n AS (SELECT * FROM f WHERE subject IN (SELECT v FROM w) OR object IN (SELECT v FROM w))
SELECT subject, rel_type, object, CASE WHEN subject IN (SELECT 'O' || o_orderkey FROM orders WHERE o_orderkey % 3 = 0) THEN 'order' ELSE '概念' END AS subject_type,
  CASE WHEN p_partkey % 2 = 0 THEN p_brand ELSE '概念' END AS object_type, coalesce(confidence, 1) AS confidence, coalesce(last.v, rel_type) AS verb, last.d AS source_doc_id, last.i AS source_svo_chunk_index, last.s AS source_sentence_start
FROM n LEFT JOIN part ON object = 'P' || p_partkey""")
def traversal_3hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    (rows, placed), seeds = _triples(spark, sf_dir), table(spark, sf_dir, "customer").where("c_acctbal > 9850").select(F.concat(F.lit("C"), "c_custkey").alias("name"))
    parts = table(spark, sf_dir, "part").select(F.lit("k").alias("kg_id"), F.concat(F.lit("P"), "p_partkey").alias("name"), F.when(F.col("p_partkey") % 2 == 0, F.col("p_brand")).alias("entity_type"))
    orders = table(spark, sf_dir, "orders").where("o_orderkey % 3 = 0").select(F.lit("k").alias("kg_id"), F.concat(F.lit("O"), "o_orderkey").alias("name"), F.lit("order").alias("entity_type"))
    pairs = rows.select("subject", "object").union(placed.select("subject", "object"))
    reached = cut(graph.reached_entities(pairs, seeds, 3), "reached")
    made = graph.merge_facts(graph.touching(rows, reached))
    bare = graph.touching(placed, reached).distinct().select("*", F.lit(None).cast(made.schema["citations"].dataType).alias("citations"), F.lit(None).cast("int").alias("confidence"))
    found = made.unionByName(bare)
    out = graph.described(found, parts.union(orders))
    return out.select("subject", "rel_type", "object", "subject_type", "object_type", "confidence", "verb", "source_doc_id", "source_svo_chunk_index", "source_sentence_start")


@query(f"WITH {_MENTIONS} SELECT kg_id, entity_id, surface_form, count(DISTINCT doc_id) AS votes FROM m GROUP BY kg_id, entity_id, surface_form")
def alias_votes_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Votes of three batches, each a table of the documents that use a form; many documents are in two of them."""
    m = table(spark, sf_dir, "lineitem").selectExpr("CAST(l_suppkey % 4 AS INT) AS kg_id", "l_partkey % 100 AS entity_id", "repeat('x', CAST(l_quantity AS INT) % 4 + 1) || CAST(l_quantity AS INT) % 9 AS surface_form", "l_orderkey AS doc_id", "l_linenumber AS n")
    out = graph.vote_documents(m.where("n % 3 = 0"))
    for k in (1, 2):
        out = graph.united_documents(out, graph.vote_documents(m.where(f"n % 3 = {k}")))
    return graph.alias_votes(out)
