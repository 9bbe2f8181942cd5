"""Registered queries of the stored vector index, and the same in SQL where the result is exact."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.operators import classify, vector_index
from docweave.operators.vector_index import VectorIndex, temporary

from .queries import _KNN, _vectors, query


def _index(spark: SparkSession, sf_dir: str) -> VectorIndex:
    """All vectors; a third of them comes as a change, so that the index has two segments."""
    rows = _vectors(spark, sf_dir).select("vec_id", "vector")
    index = VectorIndex.build(rows, temporary(spark), "vec_id")
    index.upsert(rows.where("vec_id % 3 = 0"), "vec_id")
    return index


def _queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _vectors(spark, sf_dir).where("vec_id % 100 = 0").select("vec_id", "vector")


@query(_KNN.format(-2) + " SELECT query_id, item_id, score, CAST(rank AS INT) AS rank FROM k WHERE rank <= 10")
def vector_index_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _index(spark, sf_dir).search_exact(_queries(spark, sf_dir), 10, "vec_id", digits=6)


@query("SELECT count(DISTINCT vec_id) AS queries, true AS recall_reached FROM embeddings WHERE vec_id % 100 = 0")
def vector_index_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the cells that are probed by default hold nine of ten exact neighbours or more."""
    index, asked = _index(spark, sf_dir), _queries(spark, sf_dir)
    items = _vectors(spark, sf_dir).select(F.col("vec_id").alias("item_id"), "vector")
    exact = classify.nearest(asked.withColumnRenamed("vec_id", "query_id"), items, 10)
    return vector_index.recall(index.search(asked, 10, "vec_id"), exact).select("queries", (F.col("recall") >= 0.9).alias("recall_reached"))


@query(_KNN.format(-2) + """, r AS (SELECT query_id, item_id, score FROM k WHERE rank <= 100), g AS (SELECT r.query_id, e.label AS kg_id, avg(r.score) AS score FROM r JOIN embeddings e ON e.vec_id = r.item_id GROUP BY r.query_id, e.label),
o AS (SELECT query_id, kg_id, round(score, 5) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 5) DESC, kg_id) AS INT) AS rank FROM g WHERE round(score, 5) >= 0.05) SELECT * FROM o WHERE rank <= 5""")
def route_by_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    membership = _vectors(spark, sf_dir).select(F.col("vec_id").alias("item_id"), F.col("label").alias("kg_id"))
    found = _index(spark, sf_dir).search_exact(_queries(spark, sf_dir), classify.DEFAULTS.coarse_top_k, "vec_id", digits=6)
    return classify.route(found, membership, digits=5)
