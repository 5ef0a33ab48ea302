"""The queries of more.py as DuckDB SQL, on the facts of oracle.py."""

from __future__ import annotations

from ..functions.rates import MODELS, TIERS
from ..operators.advice import CHEAPER, FANOUT, ROUND_TRIP, SLICE, TOOL_OUTPUT
from ..sources.facade import REPORTED_MODELS
from .oracle import LEDGER

_models = ", ".join(f"'{m}'" for m in REPORTED_MODELS)
_BILL = f""",
cp AS (SELECT user_id AS session_id, event_id AS ord, date_trunc('day', ts) AS run_start, epoch_us(ts) - epoch_us(date_trunc('day', ts)) AS duration, CAST(k * 100000 AS DECIMAL(28,5)) AS reported, [{_models}][k % {len(REPORTED_MODELS)} + 1] AS model_key FROM ev WHERE event_id % 40 = 0),
bt AS (SELECT cp.*, (SELECT max(c.ts) FROM calls c WHERE c.session_id = cp.session_id AND c.origin = 'main' AND c.request_id <= cp.ord) AS billed_ts FROM cp),
runs AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY session_id, run_start ORDER BY duration DESC, ord DESC) AS r FROM bt) WHERE r = 1),
edge AS (SELECT e.*, CASE WHEN last_us > mark_us THEN mark_us END AS hi_us FROM (SELECT session_id, min(epoch_us(run_start)) - 120000000 AS lo_us, max(epoch_us(billed_ts)) AS mark_us, sum(reported) AS reported FROM runs GROUP BY 1) e
         LEFT JOIN (SELECT session_id, max(epoch_us(ts)) AS last_us FROM calls WHERE origin = 'main' GROUP BY 1) USING (session_id)),
placed AS (SELECT p.*, edge.reported, CASE WHEN lo_us IS NULL THEN 'none' WHEN epoch_us(p.ts) < lo_us THEN 'early' WHEN epoch_us(p.ts) > hi_us THEN 'late' ELSE 'covered' END AS place FROM priced p LEFT JOIN edge USING (session_id)),
sums AS (SELECT session_id, CAST(max(reported) AS DOUBLE) / 1e6 AS reported_usd, CAST(sum(m_total) AS DOUBLE) / 1e6 AS computed_usd, CAST(coalesce(sum(m_total) FILTER (place <> 'covered'), 0) AS DOUBLE) / 1e6 AS open_usd FROM placed GROUP BY 1),
agreed AS (SELECT session_id, reported_usd, computed_usd, computed_usd - open_usd AS covered_usd, open_usd, CASE WHEN reported_usd IS NULL THEN computed_usd ELSE reported_usd + open_usd END AS usd,
         CASE WHEN reported_usd IS NULL THEN 'computed' WHEN open_usd > 0 THEN 'mixed' ELSE 'reported' END AS source,
         CASE WHEN reported_usd IS NULL THEN 'unavailable' WHEN open_usd > 0.05::DOUBLE * computed_usd THEN 'partial' WHEN abs(reported_usd - (computed_usd - open_usd)) / nullif(reported_usd, 0) <= 0.02::DOUBLE THEN 'ok' ELSE 'drift' END AS status FROM sums)
"""
_m = lambda c: f"CAST(coalesce(sum(m_total) FILTER ({c}), 0) AS DOUBLE)"
_CHEAP = dict(zip(("input_tokens", "output_tokens", "cw5_tokens", "cw1_tokens", "cache_read"), next(t for t in TIERS if t[0] == next(x[1] for x in MODELS if x[0] == CHEAPER))[1:6], strict=True))
_cheap = " + ".join(f"coalesce(sum({n}) FILTER (origin <> 'main'), 0)::DOUBLE * {r}::DOUBLE" for n, r in _CHEAP.items())
_ADVICE = LEDGER + f""",
f AS (SELECT * FROM (SELECT session_id, CAST(sum(m_total) AS DOUBLE) AS m, CAST(sum(m_read) AS DOUBLE) AS m_read, CAST(sum(m_cw5 + m_cw1) AS DOUBLE) AS m_write, CAST(sum(m_cw1) AS DOUBLE) AS m_cw1, {_m("origin <> 'main'")} AS m_side, {_m("is_error")} AS m_failed,
      count(*) FILTER (unpriced) AS unpriced, count(*) FILTER (is_error) AS failed, max(context_tokens) AS peak, CAST(sum(cache_read) AS DOUBLE) AS read_tokens, CAST(sum(context_tokens) AS DOUBLE) AS context_tokens,
      CAST(sum(cw5_tokens + cw1_tokens) AS DOUBLE) AS write_tokens, {_cheap} AS m_cheap FROM priced GROUP BY 1)
      LEFT JOIN (SELECT session_id, max(x) AS m_widest FROM (SELECT session_id, CAST(sum(m_total) AS DOUBLE) AS x FROM priced WHERE origin <> 'main' GROUP BY session_id, agent_type) GROUP BY 1) USING (session_id)
      LEFT JOIN (SELECT session_id, count(*) AS uses, count(*) FILTER (is_error) AS tool_errors, CAST(sum(bytes) AS DOUBLE) AS tool_bytes FROM tools GROUP BY 1) USING (session_id)
      LEFT JOIN (SELECT session_id, sum(w) AS wasted FROM (SELECT session_id, w, row_number() OVER (PARTITION BY session_id ORDER BY w DESC, name, path) AS r FROM (SELECT session_id, name, path, CAST(sum(bytes) * (count(*) - 1) // count(*) AS BIGINT) AS w FROM tools GROUP BY 1, 2, 3 HAVING count(*) >= 2)) WHERE r <= 20 GROUP BY 1) USING (session_id)
      LEFT JOIN (SELECT session_id, count(*) AS agent_reads, sum(carry_usd) AS agent_carry FROM ledger WHERE reason = 'subagent' GROUP BY 1) USING (session_id) LEFT JOIN pr USING (session_id)),
tk AS (SELECT *, r5 + read_tokens / greatest(1, write_tokens) * rr AS token FROM f),
lv AS (SELECT session_id, m, unnest([
      {{'lever': 'model-routing', 'grp': 'model-routing', 'status': 'available', 'usd': (m_side - m_cheap) / 1e6}}, {{'lever': 'redundant-reads', 'grp': 'context', 'status': 'available', 'usd': coalesce(wasted, 0)::DOUBLE / 4 * token / 1e6}},
      {{'lever': 'fanout-width', 'grp': 'fanout-width', 'status': 'available', 'usd': coalesce(m_widest, 0) * {FANOUT}::DOUBLE / 1e6}}, {{'lever': 'tool-output', 'grp': 'context', 'status': 'available', 'usd': coalesce(tool_bytes, 0) / 4 * token * {TOOL_OUTPUT}::DOUBLE / 1e6}},
      {{'lever': 'errors', 'grp': 'errors', 'status': 'available', 'usd': m_failed / 1e6}}, {{'lever': 'cache-ttl', 'grp': 'cache-ttl', 'status': 'rejected', 'usd': m_cw1 * 0.375::DOUBLE / 1e6}},
      {{'lever': 'slice-for-agents', 'grp': 'context', 'status': 'available', 'usd': CASE WHEN coalesce(agent_carry, 0) > 0.01 THEN greatest(0, agent_carry * {1 - SLICE!r}::DOUBLE - agent_reads * {ROUND_TRIP}::DOUBLE) ELSE 0 END}}], recursive := true) FROM tk),
levers AS (SELECT session_id, lever, grp, status, usd, usd / nullif(m / 1e6, 0) AS share, row_number() OVER (PARTITION BY session_id ORDER BY round(usd, 9) DESC, lever) AS rank FROM lv WHERE usd > 0.01)
"""
_find = lambda code, sev, value, least: f"SELECT session_id, '{code}' AS code, '{sev}' AS severity, CAST({value} AS DOUBLE) AS value FROM f WHERE {value} > {least}"
_share = lambda a, b: f"coalesce({a} / nullif({b}, 0), 0)"
_FOUND = " UNION ALL ".join(_find(*r) for r in (
    ("unpriced", "warn", "unpriced", 0), ("cache_hit", "info", _share("read_tokens", "context_tokens"), "0.9::DOUBLE"), ("read_share", "warn", _share("m_read", "m"), "0.55::DOUBLE"), ("side_share", "warn", _share("m_side", "m"), "0.5::DOUBLE"),
    ("failed_calls", "warn", "failed", 0), ("tool_errors", "warn", _share("CAST(tool_errors AS DOUBLE)", "uses"), "0.05::DOUBLE"), ("budget", "warn", "m / 1e6", 25), ("peak_context", "info", "peak", 150000),
))
_ACCOUNT = """,
ds AS (SELECT user_id AS owner, CAST(CAST(ts AS DATE) AS VARCHAR) AS session_id, min(ts) AS start FROM ev GROUP BY 1, 2),
att AS (SELECT user_id AS owner, ts AS at_, CASE WHEN k % 2 = 0 THEN 'primary' ELSE 'secondary' END AS label, event_id, k, CAST(CAST(ts AS DATE) AS VARCHAR) AS session_id FROM ev WHERE event_type = 'signup'),
br AS (SELECT owner, session_id, CASE WHEN b = a THEN b END AS label FROM (SELECT owner, session_id, (SELECT max_by(label, (at_, label)) FROM att WHERE att.owner = ds.owner AND at_ <= start) AS b, (SELECT min_by(label, (at_, label)) FROM att WHERE att.owner = ds.owner AND at_ > start) AS a FROM ds)),
l1 AS (SELECT owner, session_id, max_by(label, (at_, event_id)) AS one FROM att WHERE event_id % 97 = 0 GROUP BY 1, 2), l2 AS (SELECT owner, session_id, min_by(label, (at_, event_id)) AS two FROM att WHERE event_id % 7 = 0 GROUP BY 1, 2),
acc AS (SELECT owner, session_id, coalesce(one, two, label, 'unknown') AS label, CASE WHEN one IS NOT NULL THEN 'assigned' WHEN two IS NOT NULL THEN 'recorded' WHEN label IS NOT NULL THEN 'backup' ELSE 'unknown' END AS source
        FROM ds LEFT JOIN l1 USING (owner, session_id) LEFT JOIN l2 USING (owner, session_id) LEFT JOIN br USING (owner, session_id))
"""
_EPOCH = """,
ep AS (SELECT *, CAST(sum(CASE WHEN is_reset AND coalesce(epoch_us(ts) - before >= 30000000, true) THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY ts, request_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS epoch FROM
       (SELECT user_id AS session_id, ts, event_id AS request_id, event_type = 'signup' AND k % 5 = 0 AS is_reset, max(CASE WHEN event_type = 'signup' AND k % 5 = 0 THEN epoch_us(ts) END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM ev)),
rd AS (SELECT tools.*, epoch FROM tools JOIN ep USING (request_id) WHERE name = 'Read'),
isl AS (SELECT session_id, epoch, path, island, min(lo) AS lo, max(hi) AS hi, count(*) AS n, sum(bytes) AS b FROM (SELECT *, sum(gap) OVER (PARTITION BY session_id, epoch, path ORDER BY lo, hi, request_id ROWS UNBOUNDED PRECEDING) AS island FROM
       (SELECT *, CASE WHEN lo > max(hi) OVER (PARTITION BY session_id, epoch, path ORDER BY lo, hi, request_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 1 ELSE 0 END AS gap FROM rd)) GROUP BY 1, 2, 3, 4),
res AS (SELECT session_id, epoch, path, CAST(sum(n) AS BIGINT) AS reads, CAST(sum(b) AS BIGINT) AS bytes, count(*) AS spans, CAST(sum(hi - lo + 1) AS BIGINT) AS lines FROM isl GROUP BY 1, 2, 3)
"""
_RANKED = """,
rk AS (SELECT session_id AS key, row_number() OVER (PARTITION BY session_id ORDER BY bytes DESC, request_id) AS rank, bytes // 4 AS tokens FROM tools)
"""
_KINDS = ("input", "output", "cw5", "cw1", "read", "search")
_STATE = "CASE WHEN n.id IS NULL THEN 'removed' WHEN o.id IS NULL THEN 'added' WHEN n.size = o.size AND n.mtime = o.mtime THEN 'same' WHEN n.digest = o.digest THEN 'touched' ELSE 'changed' END"

BODY = {
    "a14_runs": _BILL + "SELECT session_id, epoch_us(run_start) AS run_us, ord, CAST(reported AS DOUBLE) / 1e6 AS usd, epoch_us(billed_ts) AS billed_us FROM runs",
    "a16_coverage": _BILL + "SELECT session_id, place, count(*) AS calls, count(*) FILTER (origin = 'main') AS main_calls, CAST(sum(m_total) AS DOUBLE) / 1e6 AS usd FROM placed GROUP BY 1, 2",
    "c02_reconcile": _BILL + "SELECT * FROM agreed",
    "t07_live_dollars": _BILL + "SELECT * FROM agreed",
    "j09_model_gap": _BILL + """, a AS (SELECT session_id, model_key, sum(m_total) AS m FROM priced GROUP BY 1, 2), b AS (SELECT session_id, model_key, sum(reported) AS r FROM runs GROUP BY 1, 2)
        SELECT session_id, model_key, CAST(m AS DOUBLE) / 1e6 AS computed_usd, CAST(r AS DOUBLE) / 1e6 AS reported_usd, m IS NOT NULL AS in_transcript, coalesce(CAST(r AS DOUBLE) / 1e6, 0) - coalesce(CAST(m AS DOUBLE) / 1e6, 0) AS delta_usd FROM a FULL JOIN b USING (session_id, model_key)""",
    "a24_provenance": _BILL + "SELECT source, count(*) AS sessions, round(sum(usd), 6) AS usd, bool_or(source <> 'reported') AS estimate, CASE source WHEN 'reported' THEN 'billed' WHEN 'mixed' THEN 'billed+measured' ELSE 'measured' END AS label FROM agreed GROUP BY 1",
    "c03_findings": _ADVICE + _FOUND,
    "c04_levers": _ADVICE + "SELECT * FROM levers",
    "c05_combined": _ADVICE + "SELECT session_id, round(sum(usd), 5) AS usd, count(*) AS groups FROM (SELECT session_id, grp, max(usd) AS usd FROM levers WHERE status <> 'rejected' GROUP BY 1, 2) GROUP BY 1",
    "a33_corpus_levers": _ADVICE + "SELECT lever, count(*) AS sessions, round(sum(usd), 4) AS usd FROM levers GROUP BY 1",
    "c07_turn_residency": """, bt AS (SELECT session_id, turn_id, count(*) AS calls, CAST(sum(m_total) * 100000 AS BIGINT) AS w FROM turned WHERE turn_id IS NOT NULL GROUP BY 1, 2)
        SELECT session_id, count(*) AS turns, median(w) / 1e11 AS turn_usd, median(w // calls) / 1e11 AS call_usd FROM bt GROUP BY 1 HAVING count(*) >= 3""",
    "j07_bracket": _ACCOUNT + "SELECT * FROM br",
    "c11_accounts": _ACCOUNT + "SELECT *, source = 'backup' AS is_guess FROM acc",
    "a25_account_rollup": _ACCOUNT + """, p AS (SELECT session_id AS owner, CAST(CAST(ts AS DATE) AS VARCHAR) AS session_id, sum(m_total) FILTER (NOT unpriced) AS m FROM priced GROUP BY 1, 2)
        SELECT label, count(*) AS sessions, coalesce(CAST(sum(m) AS DOUBLE) / 1e6, 0) AS usd, count(*) FILTER (m IS NULL) AS unpriced FROM acc LEFT JOIN p USING (owner, session_id) GROUP BY 1""",
    "a26_sources": _ACCOUNT + "SELECT source, count(*) AS n, CAST(list_position(['assigned', 'recorded', 'stamped', 'backup', 'unknown'], source) AS INTEGER) AS rank FROM acc GROUP BY 1",
    "w21_labels": _ACCOUNT + """SELECT owner, address, CASE i WHEN 1 THEN 'primary' WHEN 2 THEN 'secondary' ELSE 'secondary-' || (i - 1) END AS label FROM (SELECT *, row_number() OVER (PARTITION BY owner ORDER BY f, address) AS i FROM
        (SELECT owner, 'u' || (k % 4) AS address, min(at_) AS f FROM att GROUP BY 1, 2))""",
    "t15_epochs": _EPOCH + "SELECT session_id, request_id, epoch FROM ep",
    "a28_resident": _EPOCH + "SELECT * FROM res",
    "c27_replay": _EPOCH + """, d AS (SELECT request_id, count(DISTINCT l) AS n FROM (SELECT r.request_id, unnest(range(greatest(r.lo, p.lo), least(r.hi, p.hi) + 1)) AS l FROM rd r JOIN rd p ON p.session_id = r.session_id AND p.epoch = r.epoch AND p.path = r.path AND (p.ts, p.request_id) < (r.ts, r.request_id)) GROUP BY 1)
        SELECT request_id, epoch, coalesce(n, 0) AS dup_lines, CAST(greatest(1, floor(bytes / 4 + 0.5)) AS BIGINT) * coalesce(n, 0) // (hi - lo + 1) AS dup_tokens FROM rd LEFT JOIN d USING (request_id)""",
    "o12_candidate": _EPOCH + "SELECT session_id, epoch, path, reads, bytes FROM (SELECT *, row_number() OVER (PARTITION BY session_id, epoch ORDER BY bytes DESC, path) AS r FROM res WHERE reads >= 2 AND bytes / 4 >= 1000) WHERE r = 1",
    "t14_alerts": """, cx AS (SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY ts, request_id) AS prompt, CAST(context_tokens AS DOUBLE) / 60000 AS share FROM priced WHERE origin = 'main'),
        l0 AS (SELECT session_id, prompt, CASE WHEN share >= 0.85::DOUBLE THEN 'urgent' WHEN share >= 0.75::DOUBLE THEN 'warn' WHEN share >= 0.6::DOUBLE THEN 'nudge' END AS level FROM cx),
        l1 AS (SELECT session_id, prompt, coalesce(level, CASE WHEN prompt = min(prompt) FILTER (level IS NULL) OVER (PARTITION BY session_id) THEN 'hint' END) AS level FROM l0),
        lv AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY prompt) AS i FROM l1 WHERE level IS NOT NULL),
        st AS (SELECT session_id, i, level AS kind, prompt AS at_, 1 AS times, true AS given, prompt, level FROM lv WHERE i = 1 UNION ALL
        SELECT lv.session_id, lv.i, lv.level, CASE WHEN st.kind <> lv.level OR lv.prompt - st.at_ > [1, 2, 4, 8][least(st.times, 4)] THEN lv.prompt ELSE st.at_ END, CASE WHEN st.kind <> lv.level THEN 1 WHEN lv.prompt - st.at_ > [1, 2, 4, 8][least(st.times, 4)] THEN st.times + 1 ELSE st.times END,
        st.kind <> lv.level OR lv.prompt - st.at_ > [1, 2, 4, 8][least(st.times, 4)], lv.prompt, lv.level FROM st JOIN lv ON lv.session_id = st.session_id AND lv.i = st.i + 1)
        SELECT session_id, prompt, level FROM st WHERE given""",
    "t16_budget": """SELECT 'session' AS scope, CAST(session_id AS VARCHAR) AS key, CAST(sum(m_total) AS DOUBLE) / 1e6 AS usd FROM priced GROUP BY 2 HAVING CAST(sum(m_total) AS DOUBLE) / 1e6 >= 0.8::DOUBLE * 1 UNION ALL
        SELECT 'day', CAST(CAST(ts AS DATE) AS VARCHAR), CAST(sum(m_total) AS DOUBLE) / 1e6 FROM priced GROUP BY 2 HAVING CAST(sum(m_total) AS DOUBLE) / 1e6 >= 0.8::DOUBLE * 5""",
    "f11_prunable": "SELECT session_id, max(epoch_us(ts)) AS last_us FROM calls WHERE session_id NOT IN (SELECT session_id FROM marks) GROUP BY 1 HAVING max(epoch_us(ts)) < (SELECT max(epoch_us(ts)) FROM calls) - 21600000000",
    "c18_changes": f""", t AS (SELECT doc_id AS id, coalesce(text, '') AS text FROM documents), o AS (SELECT id, length(x) AS size, CASE WHEN id % 4 = 0 THEN 9 ELSE id % 3 END AS mtime, md5(x) AS digest FROM (SELECT id, CASE WHEN id % 5 = 0 THEN substring(text, 1, 20) ELSE text END AS x FROM t WHERE id % 7 <> 0)),
        n AS (SELECT id, length(text) AS size, id % 3 AS mtime, md5(text) AS digest FROM t WHERE id % 11 <> 0) SELECT state, count(*) AS n, CAST(sum(id) AS BIGINT) AS ids FROM (SELECT coalesce(n.id, o.id) AS id, {_STATE} AS state FROM o FULL JOIN n ON o.id = n.id) GROUP BY 1""",
    "w18_chunks": r""", t AS (SELECT doc_id AS id, string_split(text, chr(10)) AS rows FROM documents), c AS (SELECT *, CAST(unnest(range(0, (len(rows) - 1) // 20 + 1)) AS INTEGER) AS chunk FROM t)
        SELECT id, chunk, chunk * 20 + 1 AS lo, CAST(least((chunk + 1) * 20, len(rows)) AS INTEGER) AS hi, md5(array_to_string(rows[chunk * 20 + 1 : (chunk + 1) * 20], chr(10))) AS digest FROM c""",
    "j16_closure": """, e AS (SELECT DISTINCT user_id AS src, k AS dst FROM ev), s0 AS (SELECT DISTINCT user_id AS seed, user_id AS node, 0 AS depth FROM ev), s1 AS (SELECT DISTINCT seed, dst AS node, 1 AS depth FROM s0 JOIN e ON src = node),
        s2 AS (SELECT DISTINCT seed, dst AS node, 2 AS depth FROM s1 JOIN e ON src = node) SELECT seed, node, min(depth) AS depth FROM (SELECT * FROM s0 UNION ALL SELECT * FROM s1 UNION ALL SELECT * FROM s2) GROUP BY 1, 2""",
    "c23_packed": _RANKED + """, st AS (SELECT key, rank, tokens, CASE WHEN tokens <= 1500 THEN tokens ELSE 0 END AS spent, tokens <= 1500 AS got FROM rk WHERE rank = 1 UNION ALL
        SELECT rk.key, rk.rank, rk.tokens, CASE WHEN st.spent + rk.tokens <= 1500 THEN st.spent + rk.tokens ELSE st.spent END, st.spent + rk.tokens <= 1500 FROM st JOIN rk ON rk.key = st.key AND rk.rank = st.rank + 1) SELECT key, CAST(rank AS INTEGER) AS rank, tokens FROM st WHERE got""",
    "o09_budget": _RANKED + "SELECT key, count(*) AS n, CAST(max(spent) AS BIGINT) AS tokens FROM (SELECT *, sum(tokens) OVER (PARTITION BY key ORDER BY rank ROWS UNBOUNDED PRECEDING) AS spent FROM rk) WHERE spent <= 1500 GROUP BY 1",
    "p17_kinds": " UNION ALL ".join(f"SELECT model_key, '{k}' AS kind, CAST(sum(m_{k}) AS DOUBLE) / 1e6 AS usd FROM priced GROUP BY 1" for k in _KINDS),
    "p16_share": "SELECT session_id, model_key, m / nullif(a, 0) AS share FROM (SELECT session_id, model_key, CAST(sum(m_total) AS DOUBLE) AS m FROM priced GROUP BY 1, 2) JOIN (SELECT session_id, CAST(sum(m_total) AS DOUBLE) AS a FROM priced GROUP BY 1) USING (session_id)",
    "w03_turn_wall": "SELECT session_id, turn_id, greatest(0, coalesce(lead(epoch_us(ts)) OVER (PARTITION BY session_id ORDER BY ts, turn_id), last_us) - epoch_us(ts)) AS wall_us FROM prompts JOIN (SELECT session_id, max(epoch_us(ts)) AS last_us FROM calls GROUP BY 1) USING (session_id)",
    "w06_downsample": "SELECT session_id, epoch_us(ts) // 3600000000 AS hour, min(context_tokens) AS lo, max(context_tokens) AS hi, max_by(context_tokens, (ts, request_id)) AS last FROM priced WHERE origin = 'main' GROUP BY 1, 2",
    "w14_seen": "SELECT path, min(ts) AS first_ts, max(ts) AS last_ts, count(DISTINCT session_id) AS sessions, count(DISTINCT (session_id, win)) AS windows FROM tools GROUP BY 1",
    "a30_index_stats": "SELECT lang, count(*) AS files, CAST(sum(length(text)) AS BIGINT) AS chars, CAST(sum(len(string_split(text, chr(10)))) AS BIGINT) AS lines, count(DISTINCT source) AS sources FROM documents GROUP BY 1",
    "a32_medians": "SELECT session_id, CAST(median(context_tokens) AS DOUBLE) AS median_context, min(context_tokens) FILTER (context_tokens > 0) AS fixed_prefix FROM priced GROUP BY 1",
    "c16_figures": """, t AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '[0-9]{4,}')) AS figure FROM documents) SELECT doc_id, count(*) AS hits, min(figure) AS least FROM t
        WHERE figure IN (SELECT CAST(CAST(floor(value * 100) AS BIGINT) AS VARCHAR) AS f FROM ev WHERE length(CAST(CAST(floor(value * 100) AS BIGINT) AS VARCHAR)) >= 4) GROUP BY 1""",
}

#: Those that step through rows in order.
RECURSIVE = ("t14_alerts", "c23_packed")


def sql(facts: str) -> dict[str, str]:
    return {k: (facts.replace("WITH ev", "WITH RECURSIVE ev", 1) if k in RECURSIVE else facts) + v for k, v in BODY.items()}
