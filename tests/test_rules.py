"""Rules that the given tables do not reach, each by a case worked out by hand."""

import datetime
import json

import pytest

from agentmeter.operators import advice, privacy, rereads, search, sourceindex
from agentmeter.sources import transcripts


def at(s):
    return datetime.datetime(2026, 1, 1) + datetime.timedelta(seconds=s)


TOOLS = "session_id string, request_id string, ts timestamp, name string, path string, window string, lo int, hi int, bytes long, is_error boolean"


def test_reread_reasons(spark):
    rows = [
        (1, "Read", "p", "a1", 1, 100),      # first of the path
        (2, "Read", "p", "a2", 1, 100),      # another agent's first, main never read it: subagent
        (3, "Read", "p", "main", 1, 50),     # main's first after an agent's: subagent
        (4, "Read", "p", "main", 40, 80),    # not covered: new_range
        (5, "Read", "p", "main", 10, 80),    # covered by the two together: avoidable
        (6, "Edit", "p", "a2", None, None),
        (7, "Read", "p", "main", 10, 20),    # written since: changed
        (8, "Read", "p", "main", 10, 20),    # avoidable again
        (20, "Read", "p", "main", 1, 10),    # after a compaction: post_compact
        (21, "Read", "q", "main", None, None),  # first, 2000 lines
        (22, "Read", "q", "main", 1, 2000),  # avoidable
        (23, "Read", "r", "a1", 1, 5),       # first
        (24, "Read", "r", "main", 1, 5),     # after a compaction, but main never read it: subagent
    ]
    data = [("s", f"r{99 - t}", at(t), n, p, w, lo, hi, 400, False) for t, n, p, w, lo, hi in rows]  # ids do not sort as times do
    data += [("s", "x1", at(9), "Read", "p", "main", 500, 600, 400, True), ("s", "x2", at(7.5), "Edit", "p", "main", None, None, 0, True)]  # failed: no effect
    marks = spark.createDataFrame([("s", at(15))], "session_id string, ts timestamp")
    got = {r.request_id: r.reason for r in rereads.classify(spark.createDataFrame(data, TOOLS), marks).collect()}
    want = "first subagent subagent new_range avoidable changed avoidable post_compact first avoidable first subagent".split()
    assert [got[f"r{99 - t}"] for t, n, *_ in rows if n == "Read"] == want and len(got) == len(want)


def test_a_read_is_written_once_and_carried(spark):
    reads = spark.createDataFrame([("s", "r", "avoidable", 4000, 3)], "session_id string, request_id string, reason string, bytes long, carry_requests long")
    rates = spark.createDataFrame([("s", 6.25, 0.5)], "session_id string, r_cw5 double, r_read double")
    r = rereads.priced(reads, rates).first()
    assert r.tokens == 1000 and abs(r.carry_usd - 1000 * (6.25 + 1.5) / 1e6) < 1e-12 and abs(r.calibrated_usd - 0.126) < 1e-12


def test_rejected_levers_do_not_count(spark):
    rows = [("s", "a", "g", "available", 2.0), ("s", "b", "g", "available", 3.0), ("s", "c", "h", "rejected", 9.0)]
    got = advice.combined(spark.createDataFrame(rows, "session_id string, lever string, grp string, status string, usd double")).first()
    assert (got.usd, got.groups) == (3.0, 1)


def test_audit_shapes_and_needles(spark):
    texts = [(1, "see 1.2.3.4.5 and 10.0.0.1, MAIN/x; élan@exämple.org"), (2, "ask joan, joanna or mary; ABC-12"), (3, None)]
    needles = spark.createDataFrame([("user", "joan"), ("user", "mary."), ("user", "joann")], "kind string, needle string")
    got = {(r.id, r.kind, r["sample"], r.n, r["first"]) for r in privacy.findings(spark.createDataFrame(texts, "id long, text string"), needles).collect()}
    assert got == {(1, "ipv4", "10.0.0.1", 1, 18), (1, "branch", "MAIN/x", 1, 28), (1, "email", "élan@exämple.org", 1, 36), (2, "user", "joann", 1, 10), (2, "ticket", "ABC-12", 1, 26)}


def test_names_are_told_where_they_name(spark):
    texts = [
        (1, "max(1, lo) max_tokens ~max /home/max/x /home/maxwell -home-max-repo max@host formax@x C:\\Users\\Max\\d"),
        (2, "joanna, xjoanna joanna1 _joanna JOANNAS-laptop (joanna) j.doe-jr j.doe"), (3, ""), (4, None), (5, "~ab home/ab " * 3),
    ]
    names = [("login", "max"), ("login", "joanna"), ("mail", "j.doe"), ("login", "ab"), ("login", "x"), ("login", "JOANNA")]
    df = spark.createDataFrame(texts, "id long, text string")
    got = sorted((r.id, r.needle, r.at) for r in privacy.needle_hits(df, spark.createDataFrame(names, "kind string, needle string")).collect())
    prefixes = ("/home/", "/users/", "\\home\\", "\\users\\", "home/", "users/", "home-", "users-", "~")
    letter = lambda c: c.isalnum() or c == "_"
    want = set()
    for i, t in texts:
        for n in ("max", "joanna", "j.doe", "ab"):
            for at in range(len(t or "")):
                end, low = at + len(n), t.lower()
                if low[at:end] != n:
                    continue
                left, right = at == 0 or not letter(t[at - 1]), end >= len(t) or not letter(t[end])
                if left if len(n) >= 5 else ((low[:at].endswith(prefixes) and right) or (left and t[end : end + 1] == "@")):
                    want.add((i, n, at))
    assert got == sorted(want) and len(want) > 12


def test_terms_of_words(spark):
    from agentmeter.operators import publishing

    texts = spark.createDataFrame([(1, "Alpha beta alpha-beta alphabet"), (2, None), (3, "a.b c a.bc"), (4, "alpha beta  alpha beta")], "id long, text string")
    terms = spark.createDataFrame([("ALPHA",), ("alpha beta",), ("a.b",), ("",), ("zeta",)], "term string")
    assert {(r.id, r.term, r.n) for r in publishing.denied(texts, terms).collect()} == {(1, "alpha", 2), (1, "alpha beta", 1), (3, "a.b", 1), (4, "alpha", 2), (4, "alpha beta", 2)}


def test_a_publication_is_replaced(spark, tmp_path):
    at = str(tmp_path / "out")
    for word in ("one", "two"):
        privacy.publish({"t": spark.createDataFrame([(word,)], "w string")}, at)
        assert [r.w for r in spark.read.parquet(f"{at}/t").collect()] == [word]
    assert sorted(x.name for x in tmp_path.iterdir()) == ["out"]


def test_work_targets(spark):
    from pyspark.sql import functions as F

    from agentmeter.sources import transcripts

    rows = [("Grep", "src", None, "foo", None), ("Glob", None, None, "*.py", None), ("Grep", "src", None, None, None), ("Read", "a.py", None, None, None), ("Bash", None, " ls   -l ", None, None)]
    df = spark.createDataFrame(rows, "n string, p string, c string, q string, u string")
    assert [r.t for r in df.select(transcripts.target(*[F.col(x) for x in "npcqu"]).alias("t")).collect()] == ["foo @ src", "*.py @ ", None, "a.py", "ls -l"]


def test_nothing_is_published_by_halves(spark, tmp_path):
    good, bad = spark.createDataFrame([("x",)], "t string"), spark.createDataFrame([("a@b.cd",)], "t string")
    with pytest.raises(ValueError):
        privacy.publish({"good": good, "bad": bad}, str(tmp_path / "out"))
    assert not (tmp_path / "out").exists()
    privacy.publish({"good": good}, str(tmp_path / "out"))
    privacy.publish({"good": good, "more": good}, str(tmp_path / "out"))
    assert sorted(x.name for x in (tmp_path / "out").iterdir()) == ["good", "more"]


def test_pseudonyms_keep_their_ordinals(spark):
    make = lambda rows: spark.createDataFrame(rows, "key string, ordinal int")
    assert {r.key: r.ordinal for r in privacy.merged(make([("a", 1), ("c", 2)]), make([("b", 1), ("a", 2), ("d", 3)])).collect()} == {"a": 1, "c": 2, "b": 3, "d": 4}
    assert privacy.allowed(make([("a", 1)]), ["ordinal", "other"]).columns == ["ordinal", "other"]


def test_identifiers_and_prefixes(spark):
    words = ["mountLauncher", "snake_case-word", "HTTPServer2", "plain", "ABC12"]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    got = {r.w: r.p for r in df.select("w", search.split_identifier(df.w).alias("p")).collect()}
    assert got["mountLauncher"] == ["mountlauncher", "mount", "launcher"] and got["plain"] == ["plain"]
    assert got["snake_case-word"] == ["snake_case-word", "snake", "case", "word"] and got["HTTPServer2"] == ["httpserver2", "http", "server2"]
    texts = spark.createDataFrame([(1, "launchers", "b"), (2, "", "launch"), (3, "x", "nothing here")], "id long, path string, text string")
    asked = spark.createDataFrame([(7, "launch")], "query_id long, text string")
    assert {r.id for r in search.bm25(texts, asked, weights={"path": 3.0, "text": 1.0}).collect()} == {1, 2}


def test_regions_follow_symbols(spark):
    text = "\n".join(["import x", ""] + ["def a():"] + ["    pass"] * 20 + ["def b():", "    pass"] + ["def c():"] + ["    pass"] * 200)
    t = spark.createDataFrame([(1, "py", text)], "id long, lang string, text string")
    found = sourceindex.symbols(t)
    assert [(r.name, r.lo, r.hi) for r in found.orderBy("lo").collect()] == [("a", 3, 23), ("b", 24, 25), ("c", 26, 226)]
    got = [(r.lo, r.hi, r.name) for r in sourceindex.regions(t, found).orderBy("lo").collect()]
    assert got == [(1, 25, "a"), (26, 165, "c"), (166, 226, "c")]
    cut = spark.createDataFrame([(1, text, 3, 10)], "id long, text string, lo int, hi int")
    r = sourceindex.text_slice(cut, 30).first()
    assert (r.lo, r.hi, r.part) == (3, 5, "def a():\n    pass\n    pass")


def test_turns_results_and_compactions(spark, tmp_path):
    line = lambda **x: json.dumps(x)
    user = lambda s, content, **x: line(type="user", timestamp=at(s).isoformat() + "Z", message={"role": "user", "content": content}, **x)
    call = lambda s, rid, **x: line(type="assistant", timestamp=at(s).isoformat() + "Z", requestId=rid, message={"role": "assistant", "model": "claude-opus-4-5", "usage": {"output_tokens": 1}, "content": [{"type": "tool_use", "id": f"t{rid}", "name": "Bash", "input": {"command": "ls   -l"}}]}, **x)
    rows = [
        user(0, "first  thing\n to do", promptId="p1"), call(1, "1", promptId="p1"), user(2, [{"type": "tool_result", "tool_use_id": "t1", "content": "x", "is_error": True}]),
        user(3, "<command-name>/clear</command-name> <command-args>now</command-args>", promptId="p2"), call(4, "2"), user(5, "hidden", isMeta=True), user(6, "<local-command-stdout>x</local-command-stdout>"),
        user(7, "third", promptId="p3"), call(8, "3", promptId="p1"),
        line(type="system", subtype="compact_boundary", timestamp=at(9).isoformat() + "Z", compactMetadata={"preTokens": 100, "postTokens": 10}),
    ]
    (tmp_path / "proj").mkdir()
    (tmp_path / "proj" / "s1.jsonl").write_text("\n".join(rows) + "\n")
    lines = transcripts.raw_lines(spark, str(tmp_path))
    turns = transcripts.prompts(lines)
    assert [r.preview for r in turns.orderBy("ts").collect()] == ["first thing to do", "/clear now", "third"]
    snaps = transcripts.snapshots(lines)
    calls = transcripts.assemble(snaps)
    got = {r.request_id: (r.turn_ts - at(0)).total_seconds() for r in transcripts.with_turns(calls, turns).collect()}
    assert got == {"1": 0.0, "2": 3.0, "3": 0.0}
    timings = spark.createDataFrame([("s1", "t1", 1, 5, 7, False), ("s1", "t1", 2, 9, 8, False)], "session_id string, tool_use_id string, ord int, duration_ms long, result_bytes long, is_error boolean")
    facts = {r.tool_use_id: r for r in transcripts.tool_facts(transcripts.tool_uses(snaps), transcripts.tool_results(lines), timings).collect()}
    assert len(facts) == 3 and facts["t1"].is_error and facts["t1"].duration_ms == 9 and not facts["t2"].is_error
    journal = spark.createDataFrame([("s1", at(9), "auto", 100, 10), ("s1", at(20), "manual", 300, 30)], "session_id string, ts timestamp, trigger string, pre_tokens long, post_tokens long")
    assert sorted(r.pre_tokens for r in transcripts.compactions(lines, journal).collect()) == [100, 300]


def test_scalar_rules(spark):
    from pyspark.sql import functions as F

    from agentmeter.functions import columns as X

    rows = [("cd x && git commit -m 'a'", "/a//b/./../c", "see src/a.py and lib/./b.ts, README.md", "12-5", "1.50"), ("/usr/bin/python3 run", "../x/../../y", "nothing", "x", "0.0070"), ("secret-tool run; ls", "/..", "", "7", "300"), (" ; ; secret || x/y | git", "/", "", "7", "0"), (None, "/", "", "7", "0")]
    r = spark.createDataFrame(rows, "cmd string, path string, text string, span string, num string").select(
        X.first_program(F.col("cmd")).alias("p"), X.normal_path(F.col("path")).alias("n"), X.named_paths(F.col("text")).alias("t"), *[c.alias(a) for c, a in zip(X.parsed_span(F.col("span"), 10), ("lo", "hi"))], X.significant(F.col("num")).alias("s"),
        X.best_line(F.lit("one two\ntwo  three two\nthree"), F.array(F.lit("two"), F.lit("three"))).alias("b"), X.chunk_terms(F.lit("b A b_1 9x")).alias("c"),
    ).collect()
    assert [x.p for x in r] == ["git", "python3", "ls", "other", "other"] and [x.n for x in r][:3] == ["/a/c", "../../y", "/"]
    assert r[0].t == ["src/a.py", "lib/b.ts", "README.md"] and [(x.lo, x.hi) for x in r][:3] == [(5, 10), (None, None), (7, 7)]
    assert [x.s for x in r][:3] == [3, 2, 1] and r[0].b == "two three two" and r[0].c == ["b_1"]


def test_journals(spark, tmp_path):
    from agentmeter.sources import journals

    s = tmp_path / "proj" / "s1"
    (s / "subagents").mkdir(parents=True)
    (s / "workflows").mkdir()
    (tmp_path / "proj" / "s1.jsonl").write_text('{"type":"bridge-session","ownerAccountUuid":"u1"}\n{"type":"bridge-session","ownerAccountUuid":"u2"}\n{"type":"user","timestamp":"2026-01-01T00:00:05Z"}\n{torn line here\n')
    (s / "subagents" / "agent-a1.jsonl").write_text('{"type":"user","timestamp":"2026-01-01T00:00:09Z"}\n')
    (s / "subagents" / "agent-a1.meta.json").write_text('{"agentType":"Explore","spawnDepth":1}')
    (s / "subagents" / "agent-a2.meta.json").write_text("not json")
    (s / "workflows" / "wf_1.json").write_text('{"workflowName":"w","phases":[{"title":"one"}],"workflowProgress":[{"type":"workflow_agent","agentId":"a1","tokens":5},{"type":"note"}]}')
    (tmp_path / "s1.tools.ndjson").write_text('{"tool_use_id":"t","duration_ms":1}\n{"tool_use_id":"t","duration_ms":2,"is_error":true}\nx\n')
    (tmp_path / "s1.compactions.ndjson").write_text('{"ts":"2026-01-01T00:00:00Z","preTokens":10}\n')
    (tmp_path / "x.attestations.ndjson").write_text('{"at":"2026-01-01T00:00:00Z","uuid":"u1","label":"primary"}\n' * 2)
    at_ = str(tmp_path)
    f = journals.session_files(spark, at_).collect()
    assert [(r.session_id, r.files) for r in f] == [("s1", 2)]
    assert [(r.session_id, r.agent_id, r.agent_type, r.spawn_depth) for r in journals.agent_metas(spark, at_).collect()] == [("s1", "a1", "Explore", 1)]
    head, steps = journals.workflows(spark, at_)
    assert head.first().phases == ["one"] and [(r.workflow_id, r.agent_id, r.tokens) for r in steps.collect()] == [("wf_1", "a1", 5)]
    e = journals.tool_events(spark, at_).collect()
    assert [(r.session_id, r.tool_use_id, r.duration_ms, r.is_error) for r in e] == [("s1", "t", 2, True)]
    assert [(r.trigger, r.pre_tokens, r.post_tokens) for r in journals.compaction_journal(spark, at_).collect()] == [("auto", 10, None)]
    lines = transcripts.raw_lines(spark, at_)
    assert [(r.session_id, r.account) for r in journals.owners(lines).collect()] == [("s1", "u1")] and journals.attestations(spark, at_).count() == 1
    assert sorted((r.lines, r.torn) for r in journals.head_and_tail(lines).collect()) == [(1, 0), (4, 1)]
    reads = spark.createDataFrame([("a", 1, 1), ("b", 1, 1), ("c", 1, 1)], "path string, size long, mtime long")
    index = spark.createDataFrame([("a", 1, 1), ("b", 2, 1)], "path string, size long, mtime long")
    assert [r.path for r in journals.fresh(reads, index).collect()] == ["a"]
    assert [(r.path, r.reason) for r in journals.stale(reads, index).collect()] == [("b", "size")]
    under = spark.createDataFrame([(1, 1, "h"), (1, 5, None), (2, 1, None)], "id long, lo int, heading string")
    assert {(r.id, r.lo): r.heading for r in journals.titled(under).collect()} == {(1, 1): "h", (1, 5): "h", (2, 1): None}


def test_alert_ladder(spark):
    from agentmeter.operators import alerts

    share = [0.1, 0.9, 0.9, 0.9, 0.9, 0.9, 0.9, 0.62, 0.9, 0.9, 0.2, 0.7, 0.8]
    rows = [("s", i + 1, x, "a.py" if i in (10, 11, 12) else None) for i, x in enumerate(share)]
    got = alerts.alerts(spark.createDataFrame(rows, "session_id string, prompt long, share double, reread string")).orderBy("prompt").collect()
    # urgent at 2, silent at 3, again at 4, silent at 5 and 6, again at 7; another kind at 8 starts the ladder anew
    assert [(r.prompt, r.level) for r in got] == [(1, "hint"), (2, "urgent"), (4, "urgent"), (7, "urgent"), (8, "nudge"), (9, "urgent"), (11, "reread:a.py"), (13, "warn")]


def test_figures_are_written_half_even(spark):
    from decimal import Decimal

    from pyspark.sql import functions as F

    from agentmeter.functions import columns as X

    values = ["0.125", "0.135", "2.5", "7.000005", "1000", "12.345678", "0.00005"]
    rows = spark.createDataFrame([(v,) for v in values], "t string").select("t", F.col("t").cast("decimal(18,6)").alias("v"))
    for r in X.written_forms(rows, "v").collect():
        assert r.written == format((Decimal(r.t) / r.scale).quantize(Decimal(1).scaleb(-r.places)), "f"), r
    want = {"100": 1, "1000": 1, "1050": 3, "1,234": 4, "0.00120": 3, "12.50": 4, "000": 3, "0": 1, "0.0": 0, "5": 1}
    got = spark.createDataFrame([(x,) for x in want], "n string").select("n", X.significant(F.col("n")).alias("s")).collect()
    assert {r.n: r.s for r in got} == want


def test_walk_of_nested_json(spark):
    from decimal import Decimal

    from agentmeter.functions import walk

    deep = '{"x":' * 12 + "7" + "}" * 12
    rows = [(1, '{"a":{"b":[1,{"c":2.50},[true,"3",null,4e2]]},"d":-0.000000000001,"e":{},"f":[]}'), (2, "12"), (3, "{bad"), (4, None), (5, deep), (6, '[[[["t"]]]]'), (7, '{"big":12345678901234567890123.5}')]
    df = spark.createDataFrame(rows, "id long, j string")
    got = sorted((r.id, r.path, r.number) for r in walk.numbers(df, "j").collect())
    D = Decimal
    assert got == [(1, "$.a.b[0]", D(1)), (1, "$.a.b[1].c", D("2.5")), (1, "$.a.b[2][3]", D(400)), (1, "$.d", D("-0.000000000001")), (2, "$", D(12)), (5, "$" + ".x" * 12, D(7)), (7, "$.big", D("12345678901234567890123.5"))]
    shallow = walk.leaves(df.filter("id = 5"), "j", depth=3).first()
    assert (shallow.path, shallow.kind) == ("$.x.x.x", "object")
    assert walk.numbers(df.filter("false"), "j").count() == 0


def test_usage_of_many_models(spark):
    from agentmeter.functions import walk

    rows = [("s", '{"m":{"inputTokens":5,"costUSD":0.1},"n":{"outputTokens":"7","thinkingTokens":true}}'), ("s", '{"m":{"inputTokens":2.9,"costUSD":"0.2"},"bad":[1],"n":null}'), ("t", "[]"), ("t", "{"), ("t", None)]
    got = {(r.session_id, r.model): r for r in walk.model_usage(spark.createDataFrame(rows, "session_id string, usage string")).collect()}
    assert set(got) == {("s", "m"), ("s", "n")}
    assert (got["s", "m"].runs, got["s", "m"].inputTokens, float(got["s", "m"].costUSD)) == (2, 7, 0.3) and (got["s", "n"].outputTokens, got["s", "n"].thinkingTokens) == (7, 0)


def test_needles_meet_places_and_not_parts(spark):
    """Few and many names find the same; texts are no rows of parts, and signs of two code units stay whole."""
    from agentmeter.operators import privacy

    texts = [(1, "\U0001f600Joanna \U0001f600\U0001f600joanna's ~Max \\Users\\max max@h xmax@h Kelvin kelvin"), (2, "/home/max-1 home-maxx users/MAX"), (3, "joanna"), (4, None), (5, "")]
    df = spark.createDataFrame(texts, "id long, text string")
    names = [("login", "joanna"), ("login", "max"), ("login", "kelvin")]
    many = [("login", f"{a}{b}{c}{d}eq") for a in "ghijklmq" for b in "ghijklmq" for c in "ghijklmq" for d in "abc"]
    seen = set()
    for own in (names, names + many, names + [("login", "été123")]):
        hits, cut = privacy.needle_places(df, spark.createDataFrame(own, "kind string, needle string"))
        seen.add(len(cut) > 200)
        assert "posexplode(split" not in hits._jdf.queryExecution().optimizedPlan().toString()
        got = {(r.id, r.needle, r.at) for r in hits.collect()}
        assert got == {(1, "joanna", 1), (1, "joanna", 10), (1, "max", 20), (1, "max", 31), (1, "max", 35), (1, "kelvin", 48), (1, "kelvin", 55), (2, "max", 6), (2, "max", 28), (3, "joanna", 0)}
    assert len(many) > privacy.FEW_HEADS and seen == {True, False}
