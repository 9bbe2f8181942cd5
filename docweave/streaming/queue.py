"""The task queue as a state machine over a stream of events.

A task (kg_id, source, chunk_index) is pending, processing, pending_upload, completed or failed. An event asks for a status; only steps of LEGAL are taken, any other
changes nothing and is reported. A task that is processing for `timeout` goes back to pending by itself. The same steps are there as a
stream, with the state of each task kept by the engine and a timer for it, and as a fold over a table of events.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from docweave.session import ship

KEY = ["kg_id", "source", "chunk_index"]
#: The statuses that can follow each; a task begins as pending, and asking for that again changes nothing unless it has failed.
LEGAL = {None: {"pending"}, "pending": {"processing"}, "processing": {"pending_upload", "failed", "pending"}, "pending_upload": {"completed", "failed"}, "failed": {"pending"}, "completed": set()}
#: State store that keeps several values and timers for each key.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

_STEPS = "kg_id {0}, source {1}, chunk_index int, seq long, at_us long, status string, asked string, taken boolean"
Step = Row(*KEY, "seq", "at_us", "status", "asked", "taken")
State = tuple[str | None, int]


def steps_of(state: State, seq: int, at: int, asked: str, timeout: int) -> tuple[State, list[tuple]]:
    """The state after an event, and (seq, at, status, asked, taken) of each step: of the return of a stuck task before it, if there is one, and of its own.
    Times are microseconds. An event older than the task's last change is not taken."""
    out = []
    status, since = state
    if status == "processing" and at - since >= timeout:
        status, since = "pending", since + timeout
        out.append((None, since, status, None, True))
    taken = asked in LEGAL[status] and at >= since
    if taken:
        status, since = asked, at
    out.append((seq, at, status, asked, taken))
    return (status, since), out


def stuck(state: State, timeout: int, until: int) -> tuple[State, list[tuple]]:
    """As steps_of(), if nothing has happened up to `until`."""
    status, since = state
    if status != "processing" or until < since + timeout:
        return state, []
    return ("pending", since + timeout), [(None, since + timeout, "pending", None, True)]


def _prepared(events: DataFrame) -> DataFrame:
    ship(events.sparkSession)
    return events.select(*KEY[:2], F.col("chunk_index").cast("int").alias("chunk_index"), F.col("seq").cast("long").alias("seq"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at_us"), "status", F.col("ts").cast("timestamp").alias("ts"))


def _schema(events: DataFrame) -> str:
    return _STEPS.format(*[events.schema[k].dataType.simpleString() for k in KEY[:2]])


def _columns(keys: tuple, rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame([(*keys, *r) for r in rows], columns=[*KEY, "seq", "at_us", "status", "asked", "taken"])
    return out.astype({"seq": "Int64"})


def _timed(steps: DataFrame) -> DataFrame:
    return steps.select(*KEY, "seq", F.timestamp_micros("at_us").alias("at"), "status", "asked", "taken")


def fold(events: DataFrame, timeout: str = "1 hour", until: int | None = None) -> DataFrame:
    """Every step of every task, from events (kg_id, source, chunk_index, seq, ts, status): kg_id, source, chunk_index, seq (null: a stuck task's return), at, status after it,
    asked and taken. Events of a task are taken by ts, then seq; a task streams through its worker, which holds its state only. until: the time, in microseconds since 1970, up to which stuck
    tasks return after their last event; by default none do."""
    limit, end = int(pd.Timedelta(timeout).value // 1000), until
    rows = _prepared(events).drop("ts")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state, out = None, (None, 0), []

        def closed():
            return [(*now, *s) for s in stuck(state, limit, end)[1]] if now is not None and end is not None else []

        for f in frames:
            for kg, source, chunk, seq, at, asked in f.itertuples(index=False):
                if (kg, source, chunk) != now:
                    out += closed()
                    now, state = (kg, source, chunk), (None, 0)
                state, steps = steps_of(state, seq, at, asked, limit)
                out += [(*now, *s) for s in steps]
            yield _columns((), out)
            out = []
        yield _columns((), closed())

    return _timed(rows.repartition(*KEY).sortWithinPartitions(*KEY, "at_us", "seq").mapInPandas(run, _schema(rows)))


class TaskMachine(StatefulProcessor):
    """The state of one task, and a timer while it is processing."""

    def __init__(self, timeout: int):
        self.timeout = timeout

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("task", "status string, since long")

    def _load(self) -> State:
        return tuple(self.state.get()) if self.state.exists() else (None, 0)

    def _store(self, old: State, new: State) -> None:
        if new == old:
            return
        self.state.update(new)
        due = lambda s: (s[1] + self.timeout + 999) // 1000
        if old[0] == "processing":
            self.handle.deleteTimer(due(old))
        if new[0] == "processing":
            self.handle.registerTimer(due(new))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        """The events of one task in one batch; they come in any order."""
        old = state = self._load()
        for at, seq, asked in sorted(((r.at_us, r.seq, r.status) for r in rows), key=lambda e: e[:2]):
            state, steps = steps_of(state, seq, at, asked, self.timeout)
            yield from (Step(*key, *s) for s in steps)
        self._store(old, state)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        old = self._load()
        new, out = stuck(old, self.timeout, expiredTimerInfo.getExpiryTimeInMs() * 1000)
        if new != old:
            self.state.update(new)
        yield from (Step(*key, *s) for s in out)

    def close(self) -> None:
        pass


def machine(events: DataFrame, timeout: str = "1 hour", watermark: str = "10 minutes") -> DataFrame:
    """fold() of a stream: steps come out as events arrive, and returns of stuck tasks when the watermark passes their time. Events later than the
    watermark are dropped by it; those of one task that come in another batch than their order asks for are reported as not taken."""
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    rows = _prepared(events).withWatermark("ts", watermark)
    out = rows.groupBy(*KEY).transformWithState(statefulProcessor=TaskMachine(int(pd.Timedelta(timeout).value // 1000)), outputStructType=_schema(rows), outputMode="Append", timeMode="EventTime")
    return _timed(out)


def current(steps: DataFrame) -> DataFrame:
    """kg_id, source, chunk_index, status and updated_at of each task after its steps."""
    last = steps.where("taken").groupBy(*KEY).agg(F.max_by("status", F.struct("at", F.col("seq").isNotNull(), "seq")).alias("status"), F.max("at").alias("updated_at"))
    return last.select(*KEY, "status", "updated_at")
