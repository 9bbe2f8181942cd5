from pyspark.sql import functions as F

from docweave.functions import text as T
from docweave.streaming.trigger import ExtractionTrigger


def test_a_batch_is_kept_as_numbers_of_windows(spark, tmp_path, monkeypatch):
    kept, kind = [], type(spark.range(0))
    real = kind.persist
    monkeypatch.setattr(kind, "persist", lambda self, *a: kept.append(dict(self.dtypes)) or real(self, *a))
    trigger = ExtractionTrigger(spark, str(tmp_path / "out"))
    counts = {"none": None, "empty": 0, "one": 1, "five": 5, "six": 6, "nine": 9}
    docs = [("k", s, None if n is None else ["x."] * n) for s, n in counts.items()]
    frame = spark.createDataFrame(docs, "kg_id string, source string, sentences array<string>")
    trigger.apply(frame, 0)
    assert kept == [{"kg_id": "string", "source": "string", "svo_total_chunks": "int"}]
    assert {r.source: r.svo_total_chunks for r in trigger.records().collect()} == {"none": 0, "empty": 0, "one": 1, "five": 1, "six": 2, "nine": 3}
    assert sorted((r.source, r.chunk_index) for r in trigger.tasks().collect()) == [("five", 1), ("nine", 1), ("nine", 2), ("nine", 3), ("one", 1), ("six", 1), ("six", 2)]
    made = frame.select("source", F.size(T.windows(F.coalesce("sentences", F.array().cast("array<string>")))).alias("n"), T.window_count(F.col("sentences")).alias("m"))
    assert made.where("n <> m").isEmpty()
