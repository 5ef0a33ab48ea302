"""Live rows over files that come in segments."""

import datetime

from agentmeter.streaming import live


def at(s):
    return datetime.datetime(2026, 1, 1) + datetime.timedelta(seconds=s)


SNAPS = "session_id string, request_id long, output_tokens long, tool_use_id string, ts timestamp"


def drained(spark, segments, tmp_path, make, schema):
    """The rows that a query gives over segments, read one a batch."""
    src, got = tmp_path / "in", []
    for i, rows in enumerate(segments):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(src))
        stream = spark.readStream.schema(schema).parquet(str(src))
        q = make(stream).writeStream.outputMode("update").foreachBatch(lambda b, e: got.extend(b.collect())).option("checkpointLocation", str(tmp_path / "cp"))
        q.trigger(availableNow=True).start().awaitTermination()
    return got


def test_larger_snapshots_replace_and_quiet_sessions_end(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    segments = [
        [("a", 1, 10, "t1", at(0)), ("a", 1, 30, "t1", at(1)), ("b", 9, 5, None, at(2))],
        [("a", 1, 20, "t2", at(3)), ("a", 2, 7, None, at(4))],  # smaller: no change; another tool
        [("a", 2, 9, None, at(5)), ("c", 1, 1, None, at(5000))],  # time moves on
        [("c", 2, 1, None, at(5001))],
    ]
    got = drained(spark, segments, tmp_path, lambda s: live.live_rows(s, 300, "10 minutes"), SNAPS)
    final = {r.session_id: (r.calls, r.output_tokens, r.tools) for r in got if r.final}
    assert final == {"a": (2, 39, 2), "b": (1, 5, 0)}
    newest = {}
    for r in got:
        if not r.final:
            newest[r.session_id] = (r.calls, r.output_tokens, r.tools)
    assert newest == {"a": (2, 39, 2), "b": (1, 5, 0), "c": (2, 2, 0)}


def test_windows_and_runs(spark, tmp_path):
    rows = [[("a", 1, 10, None, at(0)), ("a", 2, 20, None, at(500)), ("a", 3, 5, None, at(1200)), ("b", 1, 1, None, at(100))]]
    spend = drained(spark, rows, tmp_path / "w", lambda s: live.windowed_spend(s), SNAPS)
    assert {(r.session_id, r.window.start, r.output_tokens) for r in spend if r.window.start == at(0)} == {("a", at(0), 30), ("b", at(0), 1)}
    src = tmp_path / "w" / "in"
    runs = live.session_runs(spark.read.schema(SNAPS).parquet(str(src)))
    assert sorted((r.session_id, r.calls) for r in runs.collect()) == [("a", 1), ("a", 2), ("b", 1)]


TABLE = "session_id string, epoch long, version long, kind string, ord long, output_tokens long, units long, main boolean, ts timestamp, run_us long, duration long"


def ask(s, ord_, out, units, sec, main=True, epoch=0, version=0):
    return (s, epoch, version, "request", ord_, out, units, main, at(sec), None, None)


def bill(s, ord_, units, run_sec, duration, epoch=0, version=0):
    run = int(at(run_sec).replace(tzinfo=datetime.timezone.utc).timestamp() * 1_000_000)
    return (s, epoch, version, "checkpoint", ord_, None, units, False, at(run_sec + duration), run, duration)


def newest(rows):
    out = {}
    for r in rows:
        if not r.final:
            out[r.session_id] = r
    return {k: (r.calls, r.computed, r.beyond, r.reported) for k, r in out.items()}


def test_dollars_in_any_split(spark, tmp_path):
    import random

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = [
        ask("a", 1, 5, 100, 0), ask("a", 2, 5, 200, 1000), ask("a", 2, 9, 250, 1001), ask("a", 3, 1, 40, 1500, main=False), ask("a", 5, 1, 30, 2000), ask("a", 6, 1, 7, 2500, main=False),
        bill("a", 4, 260, 900, 700), bill("a", 3, 11, 900, 600), ask("b", 1, 1, 50, 0), bill("c", 1, 90, 0, 5), ask("c", 0, 2, 80, 1), ask("c", 2, 2, 5, 3, main=False),
    ]
    # a: request 1 lies before the run, 2 is billed, 3 of an agent and 5, 6 come after the newest billed main request; c: no main request follows
    want = {"a": (5, 427, 100 + 40 + 30 + 7, 260), "b": (1, 50, 50, None), "c": (2, 85, 0, 90)}
    for seed in range(3):
        draw = random.Random(seed)
        draw.shuffle(rows)
        cut = sorted(draw.sample(range(1, len(rows)), seed + 1))
        segments = [rows[i:j] for i, j in zip([0, *cut], [*cut, len(rows)], strict=True)]
        got = drained(spark, segments, tmp_path / str(seed), lambda s: live.live_dollars(s, late="10000 days"), TABLE)
        assert newest(got) == want, seed
        assert sum(r.is_new for r in got) == 3


def test_epochs_versions_and_pauses(spark, tmp_path):
    segments = [
        [ask("a", 1, 5, 100, 0), ask("a", 2, 5, 200, 10), ask("b", 1, 1, 10, 5)],
        [ask("a", 1, 5, 70, 20, epoch=1), ask("a", 9, 5, 999, 21), ask("z", 1, 1, 1, 5000)],  # replaced by a shorter file; a row of the old one; time moves on
        [ask("z", 2, 1, 1, 5001)],
        [ask("b", 2, 1, 5, 5002), ask("b", 1, 3, 12, 5003), ask("a", 1, 5, 90, 5004, epoch=1, version=1)],  # goes on after its final row; another catalog
    ]
    got = drained(spark, segments, tmp_path, lambda s: live.live_dollars(s, 300, late="10 minutes"), TABLE)
    assert {r.session_id: (r.calls, r.computed) for r in got if r.final} == {"a": (1, 70), "b": (1, 10)}
    assert newest(got) == {"a": (1, 90, 90, None), "b": (2, 17, 17, None), "z": (2, 2, 2, None)}


def test_a_new_session_is_not_looked_up_request_by_request():
    """State that is known to be empty is not read, and each key is written once a call."""
    import pandas as pd

    calls = []

    class State(dict):
        def __init__(self, name):
            self.name = name

        def containsKey(self, k):
            calls.append((self.name, "read"))
            return k in self

        def getValue(self, k):
            return self[k]

        def updateValue(self, k, v):
            calls.append((self.name, "write"))
            self[k] = v

        def removeKey(self, k):
            del self[k]

        def iterator(self):
            return iter(list(self.items()))

    class Value:
        held = None

        exists = lambda self: self.held is not None
        get = lambda self: self.held

        def update(self, v):
            self.held = v

        def clear(self):
            self.held = None

    class Timers:
        listTimers = lambda self: []
        registerTimer = lambda self, at: None

    d = live.Dollars()
    d.handle, d.best, d.instants, d.runs, d.total = Timers(), State("best"), State("instants"), State("runs"), Value()
    names = [c.split()[0] for c in TABLE.split(", ")]
    frame = lambda rows: iter([pd.DataFrame(rows, columns=names)])
    list(d.handleInputRows(("a",), frame([ask("a", i, out, 10 * out, i) for out in (1, 2) for i in range(50)]), None))
    assert ("best", "read") not in calls and calls.count(("best", "write")) == 50 and calls.count(("instants", "write")) == 50
    calls.clear()
    (row,) = list(d.handleInputRows(("a",), frame([ask("a", 3, 9, 90, 3), ask("a", 77, 1, 10, 77)]), None))
    assert calls.count(("best", "read")) == 2 and row["computed"][0] == 49 * 20 + 90 + 10 and row["calls"][0] == 51
