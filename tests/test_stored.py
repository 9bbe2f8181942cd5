import pytest
from pyspark.sql import functions as F

from docweave.operators import graph, staging
from docweave.sources import tables


def test_sentences_are_restored_and_stored(spark, tmp_path):
    index, originals = str(tmp_path / "sentences"), str(tmp_path / "originals")
    tables.write(spark.createDataFrame([("k", "a", ["one.", "two."], 2), ("other", "z", ["zz"], 1)], tables.SCHEMAS["sentences"]), index, "sentences")
    tables.write(spark.createDataFrame([("k", "b", "First. Second."), ("k", "a", "unused")], tables.SCHEMAS["originals"]), originals, "originals")
    wanted = lambda *names: spark.createDataFrame([("k", n) for n in names], "kg_id string, source string")
    pages = spark.createDataFrame([("k", "https://x/1", "Page. Text.", None), ("k", "https://x/2", None, "HTTPError: 404")], "kg_id string, source string, text string, error string")
    got = {r.source: r.sentences for r in staging.required_sentences(spark, wanted("a", "b", "https://x/1"), index, originals, pages).collect()}
    assert got["a"] == ["one.", "two."] and "".join(got["b"]) == "First. Second." and len(got["b"]) == 2 and "".join(got["https://x/1"]) == "Page. Text."
    # the next call finds everything in the index, and other rows are still there
    stored = {(r.kg_id, r.source): r.total for r in tables.read(spark, index, "sentences").collect()}
    assert stored == {("k", "a"): 2, ("k", "b"): 2, ("k", "https://x/1"): 2, ("other", "z"): 1}
    assert {r.source for r in tables.read(spark, originals, "originals").collect()} == {"a", "b", "https://x/1"}
    with pytest.raises(Exception, match="neither sentences nor text: https://x/2"):
        staging.required_sentences(spark, wanted("https://x/2"), index, originals, pages).collect()
    with pytest.raises(Exception, match="neither sentences nor text: lost.pdf"):
        staging.required_sentences(spark, wanted("a", "lost.pdf"), index, originals).collect()


def test_chunks_of_a_shorter_version_replace_all_earlier_ones(spark, tmp_path):
    path = str(tmp_path / "chunks")
    stage = lambda *rows: staging.stage(spark.createDataFrame(rows, "source string, text string"))
    staging.write_chunks(stage(("a.txt", "第一句。" * 400), ("b.txt", "句。")), path)
    before = tables.read(spark, path, "chunks")
    assert before.where("folder = 'a'").count() > 2
    staging.write_chunks(stage(("a.txt", "短。"), ("", "x")), path)
    got = [(r.folder, r.chunk_index, r.total_chunks, r.filename) for r in tables.read(spark, path, "chunks").orderBy("folder").collect()]
    assert got == [("a", 1, 1, "chunk-001-of-001.md"), ("b", 1, 1, "chunk-001-of-001.md")]


def test_sketched_votes_are_near_and_unite(spark):
    rows = spark.range(60_000).selectExpr("1 AS kg_id", "id % 3 AS entity_id", "'f' || id % 2 AS surface_form", "id % 20011 AS doc_id", "id % 2 AS batch")
    exact = graph.alias_votes(rows)
    both = graph.united_sketches(graph.vote_sketches(rows.where("batch = 0")), graph.vote_sketches(rows))
    one = graph.sketched_votes(both).withColumnRenamed("votes", "estimate")
    compared = exact.join(one, ["kg_id", "entity_id", "surface_form"])
    assert compared.count() == exact.count() == 6
    assert compared.where(F.abs(F.col("estimate") - F.col("votes")) > 0.06 * F.col("votes")).count() == 0  # four standard errors
    few = spark.createDataFrame([(1, 1, "x", d) for d in (1, 1, 2, 3, None)], "kg_id int, entity_id int, surface_form string, doc_id int")
    assert graph.sketched_votes(graph.united_sketches(graph.vote_sketches(few), graph.vote_sketches(few))).first().votes == 3


def test_defaults_of_found_facts(spark):
    cite = "struct<" + ",".join(f"{c}:{'int' if c in ('source_svo_chunk_index', 'source_sentence_start', 'source_sentence_end', 'confidence') else 'string'}" for c in graph.CITATION) + ">"
    facts = spark.createDataFrame([("k", "a", "USES", "b", None), ("k", "b", "IS_A", "c", 4)], "kg_id string, subject string, rel_type string, object string, confidence int")
    one = F.struct(*[F.lit({"verb": "runs", "source_doc_id": "d2"}.get(c)).alias(c) for c in graph.CITATION])
    facts = facts.withColumn("citations", F.when(F.col("subject") == "b", F.array(one, one)).cast(f"array<{cite}>"))
    kinds = spark.createDataFrame([("k", "a", "人物"), ("k", "b", None), ("other", "c", "地點")], "kg_id string, name string, entity_type string")
    got = {r.subject: r for r in graph.described(facts, kinds).collect()}
    assert (got["a"].subject_type, got["a"].object_type, got["a"].confidence, got["a"].verb, got["a"].source_doc_id) == ("人物", "概念", 1, "USES", None)
    assert (got["b"].subject_type, got["b"].object_type, got["b"].confidence, got["b"].verb, got["b"].source_doc_id) == ("概念", "概念", 4, "runs", "d2")
