"""The queue as a stream: cut anywhere and restarted, it ends as one pass over all events does."""

import random

from pyspark.sql import functions as F

from lumenarc.operators.workqueue import Policy
from lumenarc.streaming import items

POLICY = Policy(max_attempts=3, retry_base=60, retry_cap=90, revive_after=500, max_revives=1)


def folded(events, watermark):
    out = {}
    for i, seq, at, outcome, retryable in sorted(events, key=lambda e: (e[2], e[1])):
        item = out.get(i)
        item = items.Item() if item is None or item.over() else item
        item.takes(at, seq, outcome, bool(retryable), POLICY)
        out[i] = item
    for item in out.values():
        item.comes_back(watermark)
    return {i: (x.status, x.attempts, x.revives, x.has_analysis, x.due) for i, x in out.items()}


def test_transitions():
    item = items.Item()
    item.takes(0, 0, "error", True, POLICY)
    assert (item.status, item.attempts, item.due) == ("DOWNLOADED", 1, 60_000)
    item.takes(10, 1, "analyzed", False, POLICY)
    item.takes(20, 2, "error", True, POLICY)
    assert (item.status, item.attempts, item.due) == ("ANALYZED", 2, 90_020)
    item.takes(30, 3, "error", True, POLICY)
    assert (item.status, item.due) == ("FAILED", 500_030) and not item.over()
    assert item.comes_back(500_030) and (item.status, item.attempts, item.revives) == ("ANALYZED", 0, 1)
    item.takes(600_000, 4, "error", False, POLICY)
    assert item.over() and not item.comes_back(10**12)


def test_batches_restarts_and_timers(spark, tmp_path):
    r = random.Random(2)
    events = [(r.randrange(6), k, k * 7000 + r.randrange(5000), r.choice(["analyzed", "error", "error", "error", "ready"]), r.choice([True, True, False, None])) for k in range(90)]
    events.append((77, 900, 2_000_000, "ready", None))  # brings the watermark on
    def run(rows, k):
        spark.createDataFrame(rows, "id long, seq long, at long, outcome string, retryable boolean").withColumn("at", F.timestamp_millis("at")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("id long, seq long, at timestamp, outcome string, retryable boolean").parquet(str(tmp_path / "in"))
        items.run_available(items.states(stream, POLICY), str(tmp_path / "out"))

    run(events[:60], 0)
    first = items.latest(spark, str(tmp_path / "out")).count()
    run(events[60:], 1)  # another query on the same checkpoint: state and timers are kept
    got = {x.id: (x.status, x.attempts, x.revives, x.has_analysis, x.due) for x in items.latest(spark, str(tmp_path / "out")).withColumn("due", F.coalesce(F.unix_millis("due"), F.lit(-1))).collect()}
    assert first == 6 and got == folded(events, 2_000_000 - 500)
    state = spark.read.format("statestore").option("path", str(tmp_path / "out" / "checkpoint")).option("stateVarName", "item").load()
    assert state.count() == sum(not (s == "READY" or s == "FAILED" and due < 0) for s, *_, due in got.values())


def test_no_message_to_the_state_is_made_in_vain():
    from pyspark.sql import Row

    class State:
        def __init__(self):
            self.held, self.calls = None, []

        def __getattr__(self, name):
            return lambda *args: self.calls.append(name)

        def get(self):
            self.calls.append("get")
            return self.held

    made, state = items._Items(Policy()), State()
    made.value = made.handle = state
    event = lambda outcome: iter([Row(id=1, seq=1, at=5, outcome=outcome, retryable=True)])
    assert [r["status"] for r in made.handleInputRows((1,), event("ready"), None)] == ["READY"] and state.calls == ["get"]
    state.calls.clear()
    assert [r["status"] for r in made.handleInputRows((1,), event("analyzed"), None)] == ["EMBEDDING"] and state.calls == ["get", "update"]
