import pytest
from oracle import TABLES, differences

import __spark_entry__ as entry
from docweave.operators import staging

BLANK = [None, "", " ", "\n \t", "One. Two."]


@pytest.mark.parametrize("rows", [[(i, BLANK[i % 5]) for i in range(60)], [(i, f"Text {n}. End.") for n in range(2) for i in range(0, 70, n + 1)]], ids=["without text", "ids twice"])
def test_documents_are_staged_as_in_sql(spark, tmp_path, rows):
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    for t in set(TABLES) - {"documents"}:
        spark.range(1).coalesce(1).write.parquet(f"{tmp_path}/{t}.parquet")
    assert differences(spark, str(tmp_path), entry.plans.QUERIES["stage_documents"], entry.plans.ORACLE_SQL["stage_documents"]) == []


def test_a_source_is_answered_once(spark):
    sources = spark.createDataFrame([("a",), ("a",), ("b",), ("b",), ("c",)], "source string")
    index = spark.createDataFrame([("a", ["x."]), ("a", ["y.", "z."]), ("c", None)], "source string, sentences array<string>")
    texts = spark.createDataFrame([("a", "t."), ("b", "First."), ("b", None)], "source string, text string")
    got = [(r.source, r.sentences, r.origin) for r in staging.sentences_or_rebuild(sources, index, texts).orderBy("source").collect()]
    assert got == [("a", ["y.", "z."], "index"), ("b", ["First."], "original"), ("c", None, "missing")]
