from types import SimpleNamespace

from pyspark.sql import Row

from docweave.streaming import queue


class Handle:
    """The state of one task, and its timers."""

    def __init__(self):
        self.value, self.timers = None, []
        self.registerTimer, self.deleteTimer = self.timers.append, self.timers.remove

    def getValueState(self, name, schema):
        return SimpleNamespace(exists=lambda: self.value is not None, get=lambda: self.value, update=lambda v: setattr(self, "value", v))


def test_a_task_takes_plain_rows():
    """No frame is made for a task: its events come as rows, in any order, and its steps leave as rows."""
    machine, handle = queue.TaskMachine(1_000_000), Handle()
    machine.init(handle)
    events = [Row(seq=2, at_us=20, status="processing"), Row(seq=1, at_us=10, status="pending")]
    got = list(machine.handleInputRows((1, "s", 3), iter(events), None))
    assert [(r.kg_id, r.source, r.chunk_index, r.seq, r.status, r.taken) for r in got] == [(1, "s", 3, 1, "pending", True), (1, "s", 3, 2, "processing", True)]
    assert handle.value == ("processing", 20) and handle.timers == [1001]
    back = list(machine.handleExpiredTimer((1, "s", 3), None, SimpleNamespace(getExpiryTimeInMs=lambda: 1001)))
    assert [(r.seq, r.at_us, r.status) for r in back] == [(None, 1_000_020, "pending")] and handle.value == ("pending", 1_000_020)
