from pyspark.sql import functions as F

import __spark_entry__ as entry
from docweave.operators import graph


def test_merged_votes_are_exact_whatever_their_number(spark, tmp_path):
    """One form that 20,000 documents use, in batches that share documents."""
    spark.range(60_000).select(
        F.lit(4).cast("long").alias("l_suppkey"), F.lit(7).cast("long").alias("l_partkey"), F.lit(2.0).alias("l_quantity"), (F.col("id") % 20_011).alias("l_orderkey"), (F.col("id") % 7).alias("l_linenumber")
    ).write.parquet(f"{tmp_path}/lineitem.parquet")
    assert [r.votes for r in entry.queries()["alias_votes_merged"](spark, str(tmp_path)).collect()] == [20_011]


def test_votes_of_documents_unite(spark):
    few = spark.createDataFrame([(1, 1, "x", d) for d in (1, 1, 2, 3, None)] + [(1, 2, "y", None)], "kg_id int, entity_id int, surface_form string, doc_id int")
    both = graph.united_documents(graph.vote_documents(few), graph.vote_documents(few))
    assert sorted((r.entity_id, r.votes) for r in graph.alias_votes(both).collect()) == [(1, 3), (2, 0)]
