"""Redaction through maps, by cases worked out by hand."""

import datetime
import random
import re

from pyspark.sql import functions as F

from agentmeter.operators import privacy, redaction


def at(s):
    return datetime.datetime(2026, 1, 1) + datetime.timedelta(seconds=s)


KEYS = "kind string, key string, seen bigint"
U1, U2 = "0a1b2c3d-0000-4000-8000-00000000000a", "0a1b2c3d-0000-4000-8000-00000000000b"


def test_numbers_follow_the_order_even_where_one_value_holds_most_rows(spark):
    rows = [("hot", i * 7 % 1009) for i in range(1009)] + [("a", 5), ("z", 1)]
    got = redaction.numbered(spark.createDataFrame(rows, "g string, v int"), ["g", "v"]).collect()
    assert [(r.g, r.v) for r in sorted(got, key=lambda r: r.i)] == sorted(rows) and sorted(r.i for r in got) == list(range(1, len(rows) + 1))
    assert redaction.numbered(spark.createDataFrame([], "g string, v int"), ["g", "v"]).count() == 0


def test_a_map_keeps_what_it_gave_out(spark, tmp_path):
    kept = redaction.PseudonymMap(spark, str(tmp_path / "map"))
    assert kept.read().count() == 0 and kept.generation() == 0
    name = lambda: {(r.kind, r.key): r.pseudonym for r in kept.read().collect()}
    kept.allocate(spark.createDataFrame([("session", "b", 1), ("session", "a", 2), ("session", "b", 9), ("project", " p ", 1), ("session", "", 1), ("session", None, 1), ("session", "session_07", 1)], KEYS))
    first = name()
    assert first == {("session", "b"): "session_01", ("session", "a"): "session_02", ("project", "p"): "project_01"}
    more = spark.createDataFrame([("session", "c", 0), ("session", "a", 0), ("project", "q", 5)], KEYS)
    kept.allocate(more)
    assert name() == first | {("session", "c"): "session_03", ("project", "q"): "project_02"} and kept.generation() == 2
    kept.allocate(more)
    assert kept.generation() == 2
    # a generation that was left half written is none
    (tmp_path / "map" / "gen=3").mkdir()
    assert kept.generation() == 2
    hundred = redaction.allocated(kept.read(), spark.createDataFrame([("session", f"k{i:03}", i) for i in range(120)], KEYS))
    assert {r.pseudonym for r in hundred.filter("key = 'k119'").collect()} == {"session_123"}


def test_who_is(spark):
    names = spark.createDataFrame([("session", "abc", 1, "session_01"), ("session", "abcd", 2, "session_02"), ("session", "xyz", 3, "session_03"), ("project", "pq", 1, "project_01")], redaction.MAP)
    asked = spark.createDataFrame([(a,) for a in ["SESSION_02", "ab", "abc", "x", " project_01 ", "pq", "nobody", "", None]], "asked string")
    got = {(r.asked, r.key) for r in redaction.who_is(names, asked).collect()}
    assert got == {("SESSION_02", "abcd"), ("abc", "abc"), ("x", "xyz"), (" project_01 ", "pq")}


NAMES = [("project", "-srv-team-webshop", 1, "project_01"), ("project", "-srv-team-webshop-api", 2, "project_02"), ("project", "v", 3, "project_03"), ("project", "-opt-projects", 4, "project_04"), ("session", U1, 1, "session_01")]
SHOWN = [("-srv-team-webshop", "/srv/team/webshop"), ("-srv-team-webshop-api", "/srv/team/webshop-api"), ("-opt-projects", "/opt/projects")]
SCRUBBED = [
    ("/srv/team/webshop-api/x.py", "project_02/x.py"),
    ("cd webshop; ls -srv-team-webshop-api webshop-api, webshops xwebshop", "cd project_01; ls project_02 project_02, webshops xwebshop"),
    ("v projects /opt/projects", "v projects project_04"),
    ("/home/me/a /home/meadow/b /Users/ann.lee/c /home/someone", "~/a /home/<user>/b /home/<user>/c".replace("/home/<user>/c", "/Users/<user>/c") + " /home/<user>"),
    ("joanna-laptop max_tokens ~max/x max@host box7 BOX7.example", "<user>-laptop max_tokens ~<user>/x <user>@host <host> <host>"),
    (f"{U1} {U2} {U2.upper()}", None),
    ("Ann@Example.org bob@else.org", None),
    ("feature/abc-12 main/x ABC-12 claude-opus-9 anthropic.nova-2 UTF-8 secondary-3 sonnet-4 10.0.0.1 1.2.3.4.5", "<branch> main/x <ticket> claude-opus-9 anthropic.nova-2 UTF-8 secondary-3 sonnet-4 <ip> 1.2.3.4.5"),
    ("", ""), (None, None), ("nothing here", "nothing here"),
]


def test_texts_are_scrubbed_by_the_map(spark):
    names, shown = spark.createDataFrame(NAMES, redaction.MAP), spark.createDataFrame(SHOWN, "key string, display string")
    labels = spark.createDataFrame([("ann@example.org", "primary")], "address string, label string")
    users = spark.createDataFrame([("joanna",), ("max",)], "needle string")
    run = lambda texts: redaction.scrub(texts, names, shown, labels, users, "/home/me/", ("box7.example",))
    once = run(spark.createDataFrame([(i, a) for i, (a, _) in enumerate(SCRUBBED)], "id int, text string"))
    got = {r.id: r.text for r in once.collect()}
    for i, (_, want) in enumerate(SCRUBBED):
        if want is not None or i == 9:
            assert got[i] == want
    assert re.fullmatch(r"session_01 <id-[0-9a-f]{8}> <id-[0-9a-f]{8}>", got[5]) and re.fullmatch(r"<account:primary> <email-[0-9a-f]{8}>", got[6])
    assert {r.id: r.text for r in run(once).collect()} == got
    assert run(spark.createDataFrame([], "id int, text string")).count() == 0


def test_hits_apart_are_the_longest_first(spark):
    rng = random.Random(3)
    words, texts = ["abcdef", "abcdef-gh", "gh-abcdef", "gh-abcdef-gh-xy", "xy-abcdef"], []
    for i in range(60):
        texts.append((i, rng.choice("- /.").join(rng.choice(["abcdef", "gh", "xy", "z"]) for _ in range(rng.randint(0, 12)))))
    needles = spark.createDataFrame([(w, f"project_{i:02}") for i, w in enumerate(words)], "needle string, token string")
    df = spark.createDataFrame(texts, "id int, text string")
    got = {r.id: r.text for r in redaction.put_in(df, redaction.apart(redaction.project_hits(df, needles))).collect()}
    for i, t in texts:
        for w in sorted(words, key=len, reverse=True):
            t = re.sub(rf"(?<![A-Za-z0-9]){re.escape(w)}(?![A-Za-z0-9])", f"project_{words.index(w):02}", t)
        # equal lengths: the first in the text, not the first needle
        assert got[i].count("abcdef") == t.count("abcdef")


FORMS = {
    "turns": redaction.Mart(("ts",), {"turn": "turn_id"}, order=("ts", "turn_id")),
    "calls": redaction.Mart(("ts", "model"), {"call": "request_id", "turn": "turn_id", "agent": "agent_id"}, order=("ts", "request_id")),
    "tools": redaction.Mart(("ts", "name"), {"tooluse": "request_id", "agent": "agent_id"}, ("name", "path"), ("ts", "request_id")),
}


def marts(spark):
    turns = spark.createDataFrame([("s", at(5), "t9", "the prompt"), ("s", at(1), "t8", "another"), ("r", at(0), "t9", "x")], "session_id string, ts timestamp, turn_id string, preview string")
    calls = spark.createDataFrame([("s", at(9), "q1", "t7", None, "m", "secret"), ("s", at(2), "q2", "t8", "ag", "m", "secret"), ("s", at(2), "q2", "t8", "ag", "m", "secret"), (None, at(2), "q2", " ", "ag", "m", "secret")], "session_id string, ts timestamp, request_id string, turn_id string, agent_id string, model string, own string")
    tools = [("Read", "/a/b.PY"), ("Bash", "cd x && git push"), ("Bash", "/a/b.PY"), ("Grep", "x"), ("WebFetch", "u"), ("Odd", "./.profile"), ("Odd", "word"), ("Read", "/a/b.toolongending"), ("Read", ""), ("Read", None)]
    t = spark.createDataFrame([("s", at(i), f"u{i}", "ag" if i % 2 else "new", n, p) for i, (n, p) in enumerate(tools)], "session_id string, ts timestamp, request_id string, agent_id string, name string, path string")
    return {"turns": turns, "calls": calls, "tools": t}


def test_marts_leave_with_names_alone(spark):
    names = spark.createDataFrame([("session", "s", 7, "session_07")], redaction.MAP)
    out = redaction.redacted(marts(spark), FORMS, names)
    for mart, df in out.items():
        assert sorted(df.columns) == sorted(redaction.published(FORMS[mart]))
    turns = {(r.session, r.turn) for r in out["turns"].collect()}
    assert {t for s, t in turns if s == "session_07"} == {"turn_01", "turn_02"} and len({s for s, _ in turns}) == 2
    calls = sorted((r.call, r.turn or "", r.agent or "") for r in out["calls"].filter("session = 'session_07'").collect())
    # turns are numbered as the turns come, then those that calls alone name
    assert calls == [("call_0001", "turn_01", "agent_01"), ("call_0001", "turn_01", "agent_01"), ("call_0002", "turn_03", "")]
    (lost,) = out["calls"].filter("session = 'session_00'").collect()
    assert lost.turn is None and lost.call is None
    tools = {r.tooluse: (r.target, r.target_kind, r.target_ext, r.target_depth, r.target_argv0, r.agent) for r in out["tools"].collect()}
    assert tools["tooluse_0001"] == ("path_01", "file", ".py", 2, None, "agent_02") and tools["tooluse_0002"][:5] == ("cmd_01", "command", None, None, "git")
    assert tools["tooluse_0003"] == tools["tooluse_0001"]  # the same target has the same name, whatever used it next
    assert [tools[f"tooluse_000{i}"][0] for i in (4, 5, 6, 7, 8, 9)] == ["search_01", "web_01", "path_02", "target_01", "path_03", None]
    assert tools["tooluse_0006"][2:4] == ("", 1) and tools["tooluse_0008"][2] == ""
    again = redaction.redacted(out, FORMS, names)
    for mart in out:
        assert sorted(map(str, again[mart].select(*sorted(out[mart].columns)).collect())) == sorted(map(str, out[mart].select(*sorted(out[mart].columns)).collect()))
        text = " ".join(str(r) for r in out[mart].collect())
        assert not re.search(r"secret|prompt|'u\d'|'q\d'|'t\d'|/a/b", text)


def test_tickets_that_are_none(spark):
    df = spark.createDataFrame([(1, "ABC-12 claude-opus-5 anthropic.nova-2 utf-8 secondary-2 sonnet-4 sonnet-44")], "id int, text string")
    assert {r["sample"] for r in privacy.findings(df).filter("kind = 'ticket'").collect()} == {"ABC-12", "sonnet-44"}


def test_labels_of_targets(spark):
    rows = [("file", ".py", "a .py file, n: 3")]
    df = spark.createDataFrame(rows, "kind string, ext string, note string")
    got = df.select(redaction.target_label(F.col("kind"), F.lit("path_01"), F.col("ext"), F.lit(3), F.lit("git")).alias("l")).first().l
    assert got == ".py file, depth 3 (path_01)"


def test_texts_travel_once_and_keep_their_signs(spark):
    """Names among many others, signs of two code units, and names that begin a text, end it and follow each other."""
    needles = [(f"repo-{i:05}", f"project_{i:04}") for i in range(1500)]
    texts = [(1, "\U0001f600repo-00007 \U0001f600\U0001f600/repo-00008/x"), (2, "repo-00001repo-00002 repo-00003"), (3, "repo-01499"), (4, "-\U0001f600 x"), (5, None), (6, "")]
    df = spark.createDataFrame(texts, "id int, text string")
    want = {1: "\U0001f600project_0007 \U0001f600\U0001f600/project_0008/x", 2: "repo-00001repo-00002 project_0003", 3: "project_1499", 4: "-\U0001f600 x", 5: None, 6: ""}
    for some in (needles, needles[:9] + needles[-1:]):  # by all places where a word can begin; by the names' first signs
        n = spark.createDataFrame(some, "needle string, token string")
        cut = redaction.cut_before(n.withColumn("needle", F.concat(F.reverse("needle"), "needle")).unionByName(n)) if len(some) > 1000 else redaction.cut_before(n)
        assert (cut == redaction._CUT) == (len(some) > 1000)
        hits = redaction.project_hits(df, n, cut)
        assert {r.id: r.text for r in redaction.put_in(df, redaction.apart(hits), cut).collect()} == want
    # one plan: what is read twice is one exchange of the texts, and no part of a text is a row
    out = redaction.scrub(df, spark.createDataFrame(NAMES, redaction.MAP), spark.createDataFrame(SHOWN, "key string, display string"))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "posexplode(split" not in plan and plan.count("RepartitionByExpression") >= 1


def test_an_address_with_a_label_that_holds_a_session(spark):
    df = spark.createDataFrame([(1, f"Ann@Example.org {U1} x.y+z@a-b.cc-q@d.ee @ a@b")], "id int, text string")
    names, labels = spark.createDataFrame(NAMES, redaction.MAP), spark.createDataFrame([("ann@example.org", f"of {U1}"), ("-q@d.ee", "second")], "address string, label string")
    (got,) = redaction.scrub(df, names, labels=labels).collect()
    assert re.fullmatch(r"<account:of session_01> session_01 <email-[0-9a-f]{8}><account:second> @ a@b", got.text)
