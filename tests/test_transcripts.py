"""A small transcript tree against tables worked out by hand."""

import json

import pytest

from agentmeter.operators import marts, pricing, privacy
from agentmeter.sources import transcripts
from agentmeter.streaming import live


def line(kind, **more):
    return json.dumps({"type": kind, **more})


def request(rid, out, ts, model="claude-sonnet-4-5", content=(), **usage):
    return line("assistant", requestId=rid, timestamp=ts, message={"model": model, "content": list(content), "usage": {"input_tokens": 100, "output_tokens": out, **usage}})


@pytest.fixture
def tree(tmp_path):
    p = tmp_path / "proj"
    (p / "s1" / "subagents" / "workflows" / "wf_1").mkdir(parents=True)
    read = {"type": "tool_use", "id": "t1", "name": "Read", "input": {"file_path": "a.py", "limit": 20}}
    main = [
        line("user", promptId="p1", message={"content": "hello there"}),
        request("r1", 5, "2026-01-01T00:00:05Z", content=[read]),
        request("r1", 9, "2026-01-01T00:00:04Z", content=[read]),
        request("r1", 9, "2026-01-01T00:00:06Z", model="other"),
        line("user", message={"content": [{"type": "tool_result", "tool_use_id": "t1", "is_error": True, "content": "no"}]}),
        request("r2", 3, "2026-01-01T00:01:00Z", model="mystery", speed={"odd": 1}),
        '{"type":"assistant","requestId":"torn',
        line("assistant", requestId="r3", timestamp="bad", message="no object"),
    ]
    (p / "s1.jsonl").write_text("\n".join(main) + "\n")
    (p / "s1" / "subagents" / "agent-x.jsonl").write_text(request("r4", 7, "2026-01-01T00:02:00Z") + "\n")
    (p / "s1" / "subagents" / "workflows" / "wf_1" / "agent-y.jsonl").write_text(request("r5", 1, "2026-01-01T00:03:00Z") + "\n")
    return str(tmp_path)


def test_requests(spark, tree):
    lines = transcripts.raw_lines(spark, tree)
    assert lines.filter("bad").count() == 1
    snaps = transcripts.snapshots(lines)
    rows = {r.request_id: r for r in transcripts.assemble(snaps).collect()}
    assert sorted(rows) == ["r1", "r2", "r3", "r4", "r5"]
    assert (rows["r1"].output_tokens, rows["r1"].model, rows["r1"].lines, rows["r1"].prompt_id) == (9, "claude-sonnet-4-5", 3, "p1")
    assert str(rows["r1"].ts) == "2026-01-01 00:00:04"
    assert (rows["r4"].origin, rows["r4"].agent_id, rows["r4"].session_id) == ("subagent", "x", "s1")
    assert (rows["r5"].origin, rows["r5"].workflow_id) == ("workflow", "wf_1")
    assert rows["r3"].input_tokens == 0 and rows["r3"].ts is None
    uses = transcripts.tool_uses(snaps).collect()
    assert [(u.tool_use_id, u.path, u.limit) for u in uses] == [("t1", "a.py", 20)]
    assert [(r.tool_use_id, r.is_error) for r in transcripts.tool_results(lines).collect()] == [("t1", True)]
    priced = pricing.price(transcripts.assemble(snaps).withColumn("is_error", pricing.F.col("is_error")))
    by = {r.request_id: r for r in priced.collect()}
    assert by["r2"].unpriced and float(by["r2"].m_total) == 0
    assert float(by["r1"].m_total) == 100 * 3 + 9 * 15
    assert marts.totals(priced).first().calls == 5


def test_prices(spark):
    rows = [
        (1, 1, "claude-opus-4-7", True, "us", 10, 1, 100, 140, 7, 2),  # 1-hour writes are at most all; fast tier; geo
        (1, 2, "us.anthropic.claude-haiku-4-5-20251001-v1:0", False, None, 10, 1, 0, 5, 0, 0),  # no flat total
        (1, 3, "<synthetic>", False, None, 10, 1, 1, 1, 1, 1), (1, 4, None, False, None, 1, 1, 1, 1, 1, 1),
    ]
    names = "session_id long, request_id long, model string, fast boolean, geo string, input_tokens long, output_tokens long, cw_total long, cw_hour long, cache_read long, searches long"
    by = {r.request_id: r for r in pricing.price(spark.createDataFrame(rows, names)).collect()}
    assert (by[1].cw5_tokens, by[1].cw1_tokens, by[1].tier) == (0, 100, "fast_30_150")
    assert abs(float(by[1].m_total) - ((10 * 30 + 150 + 100 * 60 + 7 * 3) * 1.1 + 2 * 0.01 * 1e6)) < 1e-6
    assert (by[2].model_key, by[2].cw1_tokens) == ("claude-haiku-4-5", 5)
    assert not by[3].unpriced and not by[4].unpriced and float(by[3].m_total) == 0


def test_stream_equals_batch(spark, tmp_path):
    schema = "session_id long, request_id long, line int, ts timestamp, output_tokens long"
    rows = [(i % 3, i % 10, i, None, (i * 7) % 23) for i in range(60)]
    for k in range(3):
        spark.createDataFrame(rows[k * 20 : k * 20 + 20], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    live.run(spark, stream, str(tmp_path / "state"), str(tmp_path / "cp"))
    last = max((tmp_path / "state").iterdir(), key=lambda p: int(p.name[1:]))
    key = lambda d: sorted((r.session_id, r.calls, r.output_tokens) for r in d.collect())
    assert key(live.totals(spark.read.parquet(str(last)))) == key(live.totals(live.best(spark.createDataFrame(rows, schema))))


def test_scrub_is_idempotent_and_publish_is_gated(spark, tmp_path):
    t = spark.createDataFrame([(1, "mail a.b@c.example.org from 10.0.0.1 in /home/joe on fix/x-1"), (2, "nothing")], "id int, text string")
    once = privacy.scrubbed(t)
    assert privacy.findings(once).filter("kind <> 'home'").count() == 0
    assert privacy.scrubbed(once).collect() == once.collect()
    with pytest.raises(ValueError):
        privacy.publish({"t": t}, str(tmp_path))
    assert not list(tmp_path.iterdir())
    privacy.publish({"t": t.filter("id = 2")}, str(tmp_path))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 1
