"""The event journal: what a batch adds once, and the epochs its events open."""

import datetime

from agentmeter.streaming import journal

ROW = "event_id string, ts timestamp, session_id string, agent_id string, kind string, reason string, path string, tokens long, bytes long"


def at(s):
    return datetime.datetime(2026, 1, 1) + datetime.timedelta(seconds=s)


def rows(spark, data):
    return spark.createDataFrame([(i, at(t), "s", a, k, r, p, 4, 16) for i, t, a, k, r, p in data], ROW)


def test_a_batch_adds_its_events_once(spark, tmp_path):
    j = journal.Journal(spark, str(tmp_path / "j"))
    assert j.read().count() == 0
    one = rows(spark, [("a", 0, "", "read", None, "p"), ("b", 1, None, "denial", "big", None), ("b", 5, None, "denial", "big", None), (None, 1, "", "read", None, None)])
    j.append(one, 0)
    j.append(one, 0)
    j.append(rows(spark, [("b", 1, "", "denial", "big", None), ("c", 2, "", "brief", "", None)]), 1)
    got = j.read().orderBy("event_id").collect()
    assert [(r.event_id, r.ts, r.agent_id, r.saved_tokens) for r in got] == [("a", at(0), "", 0), ("b", at(1), "", 0), ("c", at(2), "", 0)]
    # a batch that was left half written is none, and is written anew
    half = tmp_path / "j" / "batch=2"
    half.mkdir()
    (half / "part-0.parquet").write_bytes(b"torn")
    assert j.batches() == [0, 1]
    j.append(rows(spark, [("d", 9, "", "read", None, "q")]), 2)
    # a replay of an older batch neither adds nor sees what came later
    j.append(rows(spark, [("z", 9, "", "read", None, "q")]), 1)
    assert j.batches() == [0, 1, 2] and j.read().count() == 4
    bare = spark.createDataFrame([("e", at(3))], "event_id string, ts timestamp")
    j.append(bare, 3)
    assert j.read().filter("event_id = 'e'").first().session_id == "unknown"


def test_a_stream_goes_on_after_a_stop(spark, tmp_path):
    source, j = tmp_path / "in", journal.Journal(spark, str(tmp_path / "j"))
    for part in range(2):
        rows(spark, [(f"e{part}{i}", i, "", "read", None, "p") for i in range(3)] + [("twice", 0, "", "denial", "x", None)]).coalesce(1).write.mode("append").parquet(str(source))
        q = spark.readStream.schema(ROW).parquet(str(source)).writeStream.foreachBatch(j.append).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination(120)
    assert sorted(r.event_id for r in j.read().collect()) == ["e00", "e01", "e02", "e10", "e11", "e12", "twice"]


def test_epochs_by_kind_of_start(spark):
    data = [
        ("e00", 0, "", "read", None, "p"),        # before any start: an epoch of its own
        ("e01", 10, "", "start", "startup", None),
        ("e02", 30, "", "start", "clear", None),   # 20 s after the one that opened: the same
        ("e03", 45, "", "start", "fork", None),    # 35 s after it: another, though 15 s after the last that came
        ("e04", 50, "", "read", None, "p"),
        ("e05", 200, "", "start", "resume", None),  # keeps what the window held
        ("e06", 300, "", "compaction", "auto", None),
        ("e07", 310, "", "start", "compact", None),  # of that compaction
        ("e08", 315, "", "compaction", "manual", None),  # a compaction always opens one
        ("e09", 400, "", "start", "", None),
        ("e10", 500, "", "start", "odd", None),
        ("f00", 20, "a1", "start", "startup", None),  # an agent has windows of its own
    ]
    placed = journal.epochs(journal.normal(rows(spark, data)))
    got = {r.event_id: r.epoch for r in placed.collect()}
    assert got == {"e00": 1, "e01": 2, "e02": 2, "e03": 3, "e04": 3, "e05": 3, "e06": 4, "e07": 4, "e08": 5, "e09": 6, "e10": 6, "f00": 1}
    r = {(x.agent_id, x.epoch): x for x in journal.epoch_rows(placed).collect()}
    assert [r["", i].reason for i in range(1, 7)] == ["startup", "startup", "fork", "compact", "compact", "startup"]
    assert r["", 1].ended == at(10) and r["", 6].ended is None and r["", 3].read_tokens == 4
    assert journal.residency(placed).count() == 0  # the newest epoch has no reads
    assert {(x.epoch, x.reads) for x in journal.residency(placed, False).collect()} == {(1, 1), (3, 1)}
