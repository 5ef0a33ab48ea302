"""Reconciliation worked out by hand: each code has a session that shows it."""

import datetime
import decimal

import pytest

from agentmeter.operators import reconcile


def at(s):
    return datetime.datetime(2026, 1, 1) + datetime.timedelta(seconds=s)


PLACED = "session_id string, model_key string, origin string, place string, reported decimal(28,5), m_total decimal(28,5), input_tokens long, output_tokens long, cache_read long, cw5_tokens long, cw1_tokens long, unpriced boolean"
USAGE = "session_id string, model string, input long, output long, cache_read long, cache_write long, usd double"
OPUS, SONNET = "claude-opus-4-5", "claude-sonnet-4-5"


def dollars(x):
    return None if x is None else decimal.Decimal(x) * 1_000_000


@pytest.fixture(scope="module")
def figures(spark):
    row = lambda s, place, reported, usd, model=OPUS, origin="main", tokens=(0, 0, 0, 0, 0), unpriced=False: (s, model, origin, place, dollars(reported), dollars(usd), *tokens, unpriced)
    placed = [
        row("none", "none", None, "3"),
        row("same", "covered", "10", "9.9"), row("zero", "covered", "0", "0"), row("billed0", "covered", "0", "1"),
        # output short by 400,000 tokens, reads by 100,000, writes at a quarter for an hour
        row("lost", "covered", "20", "10", tokens=(0, 100_000, 900_000, 300, 100)), row("lost", "covered", "20", "0", origin="subagent", unpriced=True),
        row("spread", "covered", "20", "10", tokens=(0, 0, 0, 0, 0), origin="subagent"),
        row("over", "covered", "5", "8", tokens=(5, 5, 5, 5, 5)), row("main", "covered", "20", "10", tokens=(0, 1, 0, 0, 0)),
        row("part", "early", "10", "2"), row("part", "covered", "10", "10"), row("part", "late", "10", "1.5"), row("part", "late", "10", "0.5"),
        row("edge", "covered", "95", "95"), row("edge", "late", "95", "5"),
    ]
    usage = [
        ("same", OPUS, 0, 0, 0, 0, 10.0), ("zero", OPUS, 0, 0, 0, 0, 0.0), ("billed0", OPUS, 0, 0, 0, 0, 0.0),
        ("lost", OPUS, 0, 500_000, 1_000_000, 1400, 20.0), ("lost", "nobody", 7, 7, 7, 7, 0.0),
        ("spread", SONNET, 1_000_000, 100_000, 10_000_000, 0, 20.0), ("over", OPUS, 5, 5, 5, 10, 5.0), ("main", OPUS, 0, 1_000_000, 0, 0, 20.0), ("part", OPUS, 0, 0, 0, 0, 10.0), ("edge", OPUS, 0, 0, 0, 0, 95.0),
    ]
    p, u = spark.createDataFrame(placed, PLACED), spark.createDataFrame(usage, USAGE)
    runs = spark.createDataFrame([(s,) for s in "same zero billed0 lost spread over main part part edge".split()], "session_id string")
    return p, u, runs


def test_missing_dollars_by_kind(figures):
    p, u, _ = figures
    m = {(r.session_id, r.model): r for r in reconcile.by_model(p, u).collect()}
    r = m["lost", OPUS]
    # 5 and 25 a million, reads 0.5, writes 6.25 for five minutes and 10 for an hour, of which a quarter
    assert (r.missing_input, r.missing_output, r.missing_cache_read) == (0.0, 10.0, 0.05) and r.missing_cache_write == pytest.approx(1000 * (0.25 * 10 + 0.75 * 6.25) / 1e6)
    assert m["lost", "nobody"].missing_output == 0.0 and not m["lost", "nobody"].in_transcript
    own = m["spread", OPUS]
    assert own.reported_usd is None and own.delta_usd is None and own.in_transcript and m["spread", SONNET].missing_input == 3.0
    k = {(r.session_id, r.kind): r for r in reconcile.by_kind(p, u).collect()}
    assert len(k) == 4 * 9 and ("none", "input") not in k
    assert (k["lost", "output"].computed, k["lost", "output"].reported, k["lost", "output"].delta, k["lost", "output"].coverage_pct) == (100_000, 500_007, -400_007, 20.0)
    assert k["same", "output"].coverage_pct is None and k["over", "cache_write"].missing_usd == 0.0


def test_status_scale_and_codes(figures):
    p, u, runs = figures
    sessions = reconcile.reconciled(p, runs)
    s = {r.session_id: r for r in sessions.collect()}
    assert {k: r.status for k, r in s.items()} == {"none": "unavailable", "same": "ok", "zero": "ok", "billed0": "drift", "lost": "drift", "spread": "drift", "over": "drift", "main": "drift", "part": "partial", "edge": "ok"}
    assert s["none"].cost_scale == 1.0 and s["lost"].cost_scale == 2.0 and s["zero"].cost_scale == 1.0 and s["billed0"].delta_pct is None
    assert s["part"].uncovered_share == pytest.approx(4 / 14) and s["edge"].uncovered_share == pytest.approx(0.05)
    codes: dict = {}
    for r in reconcile.diagnosis(sessions, reconcile.by_kind(p, u)).collect():
        codes.setdefault(r.session_id, {})[r.code] = r
    assert {k: set(v) for k, v in codes.items()} == {
        "none": {"unavailable"}, "same": {"agrees"}, "zero": {"agrees"}, "billed0": {"over_reported"}, "lost": {"lost_dominated", "reads_lost", "unpriced"}, "spread": {"lost_spread", "reads_lost"},
        "over": {"over_reported"}, "part": {"partial", "early", "late", "runs"}, "edge": {"agrees", "late"},
    }  # a session without sub-agents that only lacks output has no reason of its own
    d = codes["lost"]["lost_dominated"]
    assert d.kind == "output" and d.n == 1 and d.usd == pytest.approx(10.05 + 0.0071875) and d.pct == pytest.approx(1000 / d.usd)
    # 3 of input, 1.5 of output, 3 of reads: the first of equal ones leads
    d = codes["spread"]["lost_spread"]
    assert (d.kind, d.n) == ("input", 1) and d.usd == pytest.approx(7.5) and d.pct == pytest.approx(40)
    assert codes["part"]["late"].n == 2 and codes["part"]["late"].usd == 2.0 and codes["part"]["runs"].n == 2 and codes["part"]["partial"].pct == pytest.approx(100 * 10 / 14)
