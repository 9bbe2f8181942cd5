from docweave.operators import coreference


def test_documents_stream_through_their_task(spark):
    """No group for each document: windows go on across batches, and end with their document."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        said = {d: [f"{d}{i} 它" if i % 2 else f"{d}{i}" for i in range(n)] for d, n in (("a", 1), ("b", 11), ("c", 4), (None, 7))}
        rows = spark.createDataFrame([(d, i, s) for d, each in said.items() for i, s in enumerate(each)], "doc_id string, sentence_idx int, sentence string")
        made = coreference.resolve(rows, lambda s, before, after: s.replace("它", f"{len(before)}<{before[-1]}|{','.join(after)}>"))
        got = {(r.doc_id, r.sentence_idx): r.sentence for r in made.collect()}
        assert "FlatMapGroupsInPandas" not in made._jdf.queryExecution().toString()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for d, each in said.items():
        done = []
        for i, s in enumerate(each):
            done.append(s.replace("它", f"{len(done[-4:])}<{done[-1]}|{','.join(each[i + 1 : i + 3])}>") if i % 2 else s)
        assert [got[d, i] for i in range(len(each))] == done
