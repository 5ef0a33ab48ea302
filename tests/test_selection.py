"""Selection of sessions, by cases worked out by hand."""

import datetime

import pytest

from agentmeter.operators import selection


def at(s):
    return datetime.datetime(2026, 3, 1) + datetime.timedelta(seconds=s)


def test_one_session_is_meant(spark):
    rows = spark.createDataFrame([("abc", "/p/abc.jsonl", at(5)), ("abcd", "/p/x", at(9)), ("aa", "/p/y", at(9)), ("q", "abcd", at(1))], "session_id string, path string, mtime timestamp")
    asked = spark.createDataFrame([(a,) for a in ["abc", "ab", "abcd", "/p/x", "last", "current", None, "nobody", " q "]], "asked string")
    got = {r.asked: (r.session_id, r.how, r.n) for r in selection.selected(rows, asked).collect()}
    assert got == {
        "abc": ("abc", "id", 1), "ab": (None, "ambiguous", 2), "abcd": ("q", "path", 1), "/p/x": ("abcd", "path", 1), "last": ("aa", "newest", 1), "current": ("aa", "newest", 1),
        None: ("aa", "newest", 1), "nobody": (None, "none", 0), " q ": ("q", "id", 1),
    }
    assert {(r.asked, r.session_id, r.n) for r in selection.selected(rows.limit(0), asked.filter("asked = 'last' or asked = 'ab'")).collect()} == {("last", None, 0), ("ab", None, 0)}


def test_sessions_of_an_account(spark):
    day = 86400
    rows = spark.createDataFrame(
        [("a1", at(0), at(9 * day), "p", "/x/p/"), ("a2", at(day - 1), at(day), "q", None), ("b1", at(day), at(day), "p2", "/x/p"), ("b2", None, at(2 * day + 5 * 3600), None, None)],
        "session_id string, started_at timestamp, mtime timestamp, project string, display string",
    )
    ids = lambda **k: {r.session_id for r in selection.for_account(rows, **k).collect()}
    assert ids(session="a") == {"a1", "a2"} and ids(before="2026-03-02") == {"a1", "a2"} and ids(after="2026-03-02") == {"b1", "b2"}
    assert ids(after="2026-03-02", before="2026-03-03") == {"b1"} and ids(project="/x/p/") == {"a1", "b1"} and ids(project="q") == {"a2"}
    # five hours behind: the day begins at five
    assert ids(after="2026-03-03", zone="-05:00") == {"b2"} and ids(before="2026-03-01", zone="-05:00") == {"a1"}
    for bad in ({}, {"before": "tomorrow"}):
        with pytest.raises(ValueError):
            ids(**bad)


def test_sessions_worth_following(spark):
    rows = spark.createDataFrame([("new", "p", at(1000), 9), ("edge", "p", at(900), 9), ("held", "q", at(500), 9), ("before", "q", at(300), 9), ("old", "q", at(0), 9), ("empty", "p", at(1000), 1)], "session_id string, slug string, mtime timestamp, size long")
    live = spark.createDataFrame([("q", at(400)), ("q", at(100))], "slug string, since timestamp")
    now = int(at(1000).replace(tzinfo=datetime.timezone.utc).timestamp()) * 1_000_000
    got = {r.session_id: r.why for r in selection.tracked(rows, now, live, 100, 800, 60).collect()}
    assert got == {"new": "fresh", "edge": "fresh", "held": "held"}
    p = selection.page(rows.withColumnRenamed("slug", "label"), now, 100, n=2).collect()
    assert [r.session_id for r in p] == ["empty", "new"] and p[0].found == 6
    assert selection.page(rows.withColumnRenamed("slug", "label"), now, 100, active=True, label="q").count() == 0
