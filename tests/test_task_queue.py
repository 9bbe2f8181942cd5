import random
from datetime import datetime, timedelta

import pytest

from docweave.streaming import queue
from docweave.streaming.trigger import ExtractionTrigger

SCHEMA = "kg_id string, source string, chunk_index int, seq long, ts timestamp, status string"
STATUSES = ["pending", "processing", "pending_upload", "completed", "failed"]
START = datetime(2024, 1, 1)


def events(n, seed=1):
    rng = random.Random(seed)
    return [("k", f"s{rng.randrange(4)}", rng.randrange(1, 3), i, START + timedelta(minutes=7 * i // 2), rng.choice(STATUSES + ["pending", "processing"])) for i in range(n)]


def by_hand(rows, hours, until=None):
    """Steps of each task, one event after the other."""
    out, state = [], {}
    limit = timedelta(hours=hours)
    for kg, source, chunk, seq, ts, asked in sorted(rows, key=lambda r: (r[4], r[3])):
        key = (kg, source, chunk)
        status, since = state.get(key, (None, START))
        if status == "processing" and ts - since >= limit:
            status, since = "pending", since + limit
            out.append((*key, None, since, "pending", None, True))
        ok = asked in {None: ["pending"], "pending": ["processing"], "processing": ["pending_upload", "failed", "pending"], "pending_upload": ["completed", "failed"], "failed": ["pending"], "completed": []}[status]
        if ok:
            status, since = asked, ts
        out.append((*key, seq, ts, status, asked, ok))
        state[key] = status, since
    for key, (status, since) in state.items():
        if until and status == "processing" and since + limit <= until:
            out.append((*key, None, since + limit, "pending", None, True))
    return sorted(out, key=repr)


def test_fold_takes_legal_steps_and_returns_stuck_tasks(spark):
    rows = events(300)
    until = START + timedelta(minutes=7 * 150 - 10)
    frame = spark.createDataFrame(rows, SCHEMA).repartition(3)
    micros = int((until - datetime(1970, 1, 1)).total_seconds() * 1e6)
    got = sorted(map(tuple, queue.fold(frame, "2 hours", micros).collect()), key=repr)
    assert got == by_hand(rows, 2, until) and any(r[6] is None for r in got) and {r[7] for r in got} == {True, False}
    last = {tuple(r)[:3]: r.status for r in queue.current(queue.fold(frame, "2 hours", micros)).collect()}
    want = {}
    for r in sorted((r for r in got if r[7]), key=lambda r: (r[4], r[3] is not None, r[3] or 0)):
        want[r[:3]] = r[5]
    assert last == want and queue.fold(frame.limit(0)).collect() == []


def feed(spark, rows, path):
    """One file for each stretch of time, older ones first."""
    for i in range(0, len(rows), 60):
        spark.createDataFrame(rows[i : i + 60], SCHEMA).coalesce(1).write.mode("append").parquet(path)


def test_a_stream_with_restarts_equals_the_fold(spark, tmp_path):
    rows = events(300, 2)
    where, out = str(tmp_path / "in"), str(tmp_path / "out")

    def run():
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(where)
        steps = queue.machine(stream, "2 hours", "10 minutes")
        steps.writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
        return spark.read.schema(steps.schema).parquet(out)

    feed(spark, rows[:120], where)
    early = run().count()
    feed(spark, rows[120:], where)
    steps = run()  # from the checkpoint
    assert early >= 120
    until = int((rows[-1][4] - timedelta(minutes=10) - datetime(1970, 1, 1)).total_seconds() * 1e6)
    want = sorted(map(tuple, queue.fold(spark.createDataFrame(rows, SCHEMA), "2 hours", until).collect()), key=repr)
    assert sorted(map(tuple, steps.collect()), key=repr) == want


DOCS = "kg_id string, source string, sentences array<string>"


def documents(spark, where, names, n):
    spark.createDataFrame([("k", s, [f"{i}." for i in range(n)]) for s in names], DOCS).coalesce(1).write.mode("append").parquet(where)


@pytest.mark.parametrize("lost", ["tasks", "ledger"])
def test_a_batch_that_is_lost_between_its_writes_counts_once(spark, tmp_path, monkeypatch, lost):
    where, state = str(tmp_path / "in"), str(tmp_path / "state")
    trigger = ExtractionTrigger(spark, str(tmp_path / "out"))
    assert trigger.tasks().count() == 0 and trigger.records().count() == 0
    documents(spark, where, ["a", "b"], 6)
    stream = lambda: spark.readStream.schema(DOCS).parquet(where)
    trigger.start(stream(), state).awaitTermination()
    documents(spark, where, ["b", "c"], 9)

    def fails(*_):
        raise RuntimeError("the driver is lost")

    real = trigger._write
    if lost == "tasks":
        monkeypatch.setattr(trigger, "_write", lambda rows, name, batch: fails() if name == "tasks" else real(rows, name, batch))
    else:
        monkeypatch.setattr(trigger, "_commit", fails)
    with pytest.raises(Exception, match="the driver is lost"):
        trigger.start(stream(), state).awaitTermination()
    # what was written doesn't count
    assert {r.source: r.svo_total_chunks for r in trigger.records().collect()} == {"a": 2, "b": 2} and trigger.tasks().count() == 4
    monkeypatch.undo()
    again = ExtractionTrigger(spark, str(tmp_path / "out"))
    again.start(stream(), state).awaitTermination()
    assert {r.source: r.svo_total_chunks for r in again.records().collect()} == {"a": 2, "b": 3, "c": 3}
    assert sorted((r.source, r.chunk_index) for r in again.tasks().collect()) == [("a", 1), ("a", 2), ("b", 1), ("b", 2), ("b", 3), ("c", 1), ("c", 2), ("c", 3)]
    before = again.last()
    again.apply(spark.createDataFrame([("k", "z", ["x."])], DOCS), before)  # a batch that is in the ledger
    assert again.records().count() == 3 and again.last() == before
