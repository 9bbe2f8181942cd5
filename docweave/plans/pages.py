"""Registered queries of page layout, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.operators import layout

from .queries import query, table

_COLUMNS = "l_suppkey AS doc_id, l_linenumber AS page, l_orderkey * 1000000 + l_partkey AS ord, l_quantity * 8 AS x0, l_quantity * 8 + CASE WHEN l_partkey % 6 = 0 THEN 430.0 ELSE 120.0 END AS x1, CAST(l_orderkey % 97 * 7 AS DOUBLE) AS y1, CAST(600 AS DOUBLE) AS page_width, ' t' || l_orderkey || ' ' AS text"
_PLACED = f"""WITH b AS (SELECT {_COLUMNS} FROM lineitem), k AS (SELECT *, CASE WHEN x1 - x0 > 390 AND x0 < 300 AND x1 > 300 THEN 'span' WHEN (x0 + x1) / 2 < 300 THEN 'left' ELSE 'right' END AS kind FROM b),
n AS (SELECT k.doc_id, k.page, k.ord, k.x0, k.y1, k.kind, k.text, count(*) FILTER (s.ord IS NOT NULL AND (k.kind <> 'span' OR s.y1 > k.y1 OR s.ord < k.ord)) AS slot
  FROM k LEFT JOIN k s ON s.kind = 'span' AND s.doc_id = k.doc_id AND s.page = k.page AND s.y1 >= k.y1 GROUP BY ALL),
p AS (SELECT *, CAST(row_number() OVER (PARTITION BY doc_id, page ORDER BY slot, CASE kind WHEN 'left' THEN 0 WHEN 'right' THEN 1 ELSE 2 END, y1 DESC, ord) AS INT) AS place FROM n)"""


def _boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr(*[c.strip() for c in _COLUMNS.replace(", ", "\n").split("\n")])


@query(_PLACED + " SELECT doc_id, page, ord, kind, place FROM p")
def page_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.page_order(_boxes(spark, sf_dir)).select("doc_id", "page", "ord", "kind", "place")


@query(_PLACED + ", t AS (SELECT doc_id, page, string_agg(trim(text), chr(10) ORDER BY place) AS text FROM p GROUP BY doc_id, page) SELECT doc_id, md5(string_agg(text, chr(10) || chr(10) ORDER BY page)) AS digest FROM t GROUP BY doc_id")
def layout_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.document_texts(_boxes(spark, sf_dir)).select("doc_id", F.md5("text").alias("digest"))
