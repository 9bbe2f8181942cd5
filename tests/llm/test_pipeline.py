import corpus_pipeline
from docweave.llm import decontamination, mixing, near_duplicates, toxicity
from docweave.llm.common import read
from docweave.llm.queries import in_training

SF = "/root/testdata/sf0.001"


def test_stages_do_what_the_operators_say(spark):
    docs = read(spark, SF, "documents")
    model = toxicity.train(docs, read(spark, SF, "labels"), in_training("doc_id", 5, 0))
    toxic = {r.doc_id for r in toxicity.score(docs, model).collect() if r.score >= 0.5}
    rows = {r.doc_id: r.text for r in docs.collect() if r.doc_id not in toxic}
    frame = lambda: docs.where(docs["doc_id"].isin(list(rows)))
    copies = {r.doc_id for r in near_duplicates.near_duplicates(frame()).collect() if not r.kept}
    rows = {i: t for i, t in rows.items() if i not in copies}
    leaks = {r.doc_id for r in decontamination.contaminated(frame(), read(spark, SF, "benchmark")).collect()}
    rows = {i: t for i, t in rows.items() if i not in leaks}
    assert copies and leaks
    times = {r.doc_id: r.taken // r.size for r in mixing.takes(frame()).collect() if r.size}
    got = {}
    for r in corpus_pipeline.run(spark, SF).collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + 1
    assert got == {i: n for i, n in times.items() if n}


def test_all_stages_but_the_last_keep_the_columns(spark):
    docs = read(spark, SF, "documents")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns
