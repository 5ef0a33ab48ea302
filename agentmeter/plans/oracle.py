"""The queries again as DuckDB SQL; FACTS are the facade's definitions."""

from __future__ import annotations

from ..functions import rates
from ..operators import privacy
from ..operators.search import TERM
from ..sources.facade import WIRE_MODELS

_tiers = {t[0]: t[1:] for t in rates.TIERS}
_fast = dict(rates.FAST)
_rows = ", ".join(f"('{m}', {f}, '{t}', {', '.join(_tiers[t])})" for m, own, *_ in rates.MODELS for f, t in (("false", own), ("true", _fast.get(m, own))))

FACTS = rf"""
WITH ev AS (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k FROM events),
rate AS (SELECT model_key, fast, tier, CAST(r_in AS DECIMAL(10,4)) AS r_in, CAST(r_out AS DECIMAL(10,4)) AS r_out, CAST(r_cw5 AS DECIMAL(10,4)) AS r_cw5, CAST(r_cw1 AS DECIMAL(10,4)) AS r_cw1,
         CAST(r_read AS DECIMAL(10,4)) AS r_read, CAST(r_search AS DECIMAL(10,4)) AS r_search FROM (VALUES {_rows}) AS t(model_key, fast, tier, r_in, r_out, r_cw5, r_cw1, r_read, r_search)),
calls AS (SELECT user_id AS session_id, event_id AS request_id, ts, CASE WHEN event_id % 10 < 7 THEN 'main' WHEN event_id % 10 < 9 THEN 'subagent' ELSE 'workflow' END AS origin,
         CASE WHEN event_id % 10 >= 7 THEN 'a' || (event_id % 3) END AS agent_id, CASE WHEN event_id % 10 >= 7 THEN 't' || (event_id % 2) END AS agent_type,
         [{", ".join(f"'{m}'" for m in WIRE_MODELS)}][k % {len(WIRE_MODELS)} + 1] AS model, k % 17 = 0 AS fast, CASE WHEN k % 13 = 0 THEN 'us' END AS geo,
         k * 10 AS input_tokens, CAST(floor(value * 10) AS BIGINT) AS output_tokens, k * 100 AS cw_total, k * 40 AS cw_hour, event_id % 1000 * 50 AS cache_read, k % 3 AS searches, event_type = 'error' AS is_error FROM ev),
keyed AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(model), '\[[^\]]*\]\s*$', ''), '^(?:us|eu|apac)\.anthropic\.', ''), '[@:].*$', ''), '-v\d+$', ''), '-\d{{8}}$', '') AS model_key,
         cw_total - least(cw_hour, cw_total) AS cw5_tokens, least(cw_hour, cw_total) AS cw1_tokens, CAST(CASE WHEN geo = 'us' THEN 1.1 ELSE 1 END AS DECIMAL(2,1)) AS g FROM calls),
parts AS (SELECT keyed.*, coalesce(tier, CASE WHEN keyed.model_key IN ('<synthetic>', 'synthetic', '') THEN 'synthetic' ELSE 'unknown' END) AS tier, rate.r_in, tier IS NULL AND keyed.model_key NOT IN ('<synthetic>', 'synthetic', '') AS unpriced, input_tokens + cw_total + cache_read AS context_tokens, input_tokens + cw_total + cache_read + output_tokens AS total_tokens,
         coalesce(CAST(input_tokens AS DECIMAL(14,0)) * r_in * g, 0) AS m_input, coalesce(CAST(output_tokens AS DECIMAL(14,0)) * r_out * g, 0) AS m_output, coalesce(CAST(cw5_tokens AS DECIMAL(14,0)) * r_cw5 * g, 0) AS m_cw5,
         coalesce(CAST(cw1_tokens AS DECIMAL(14,0)) * r_cw1 * g, 0) AS m_cw1, coalesce(CAST(cache_read AS DECIMAL(14,0)) * r_read * g, 0) AS m_read, coalesce(CAST(searches AS DECIMAL(14,0)) * r_search * CAST(1000000 AS DECIMAL(7,0)), 0) AS m_search
         FROM keyed LEFT JOIN rate USING (model_key, fast)),
priced AS (SELECT *, CAST(m_input + m_output + m_cw5 + m_cw1 + m_read + m_search AS DECIMAL(28,5)) AS m_total FROM parts),
tools AS (SELECT * FROM (SELECT user_id AS session_id, event_id AS request_id, ts, CASE event_type WHEN 'view' THEN 'Read' WHEN 'purchase' THEN 'Edit' WHEN 'click' THEN 'Bash' END AS name, 'f' || (k % 3) AS path,
         CASE WHEN event_id % 10 < 7 THEN 'main' ELSE 'a' || (event_id % 3) END AS win, 1 + 20 * (event_id % 6) AS lo, 30 + 20 * (event_id % 6) AS hi, 400 + 8 * k AS bytes, k % 11 = 0 AS is_error,
         CASE WHEN k % 5 <> 0 THEN k * 3 END AS duration_ms FROM ev) WHERE name IS NOT NULL),
marks AS (SELECT user_id AS session_id, ts, event_id AS mark_id FROM ev WHERE event_type = 'signup' AND k % 10 = 0 AND event_id % 10 < 7),
prompts AS (SELECT user_id AS session_id, ts, event_id AS turn_id FROM ev WHERE event_type = 'signup'),
turned AS (SELECT p.*, (SELECT max_by(turn_id, (q.ts, turn_id)) FROM prompts q WHERE q.session_id = p.session_id AND q.ts <= p.ts) AS turn_id FROM priced p)
"""

_money = ", ".join(f"CAST(sum(m_{k}) AS DOUBLE) / 1e6 AS usd_{k}" for k in ("input", "output", "cw5", "cw1", "read", "search", "total"))
_tokens = ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in ("input_tokens", "output_tokens", "cw5_tokens", "cw1_tokens", "cache_read", "total_tokens"))
_usd = "CAST(sum(m_total) AS DOUBLE) / 1e6 AS usd_total"
# DuckDB's patterns cannot look around: an address is a whole run of digits and dots
_address = "((?:[0-9]{1,3}\\.){3}[0-9]{1,3})"
_FOUND = [f"SELECT doc_id AS id, text, '{k}' AS kind, '{s}' AS severity, unnest(regexp_extract_all(text, '{p}')) AS sample FROM documents" for k, s, p in privacy.RULES if k not in ("ipv4", "ticket")]
_models = r"(?i)\b(?:claude-|anthropic\.)[a-z][a-z0-9]{1,9}-[0-9]{1,6}\b"
_FOUND.append(f"""SELECT * FROM (SELECT doc_id AS id, text, 'ticket' AS kind, 'review' AS severity, unnest(regexp_extract_all(regexp_replace(text, '{_models}', ' ', 'g'), '{privacy.TICKET}')) AS sample FROM documents)
    WHERE lower(sample) NOT IN ({", ".join(f"'{t}'" for t in privacy.safe_tickets())}) AND NOT regexp_full_match(lower(sample), '{privacy.LABEL}')""")
_FOUND.append(f"SELECT * FROM (SELECT doc_id AS id, text, 'ipv4' AS kind, 'block' AS severity, unnest(regexp_extract_all(text, '[0-9.]+')) AS sample FROM documents) WHERE regexp_full_match(sample, '{_address}')")
_scrub = "text"
for _p, _by in privacy.SCRUB:
    if _p == privacy.IPV4:  # twice, as two addresses may share the sign between them
        for _ in range(2):
            _scrub = f"regexp_replace({_scrub}, '(^|[^0-9.]){_address}($|[^0-9.])', '\\1<ip>\\3', 'g')"
    else:
        _scrub = f"regexp_replace({_scrub}, '{_p}', '{_by.replace('$1', chr(92) + '1')}', 'g')"

#: A read by replay: what came before it on its path, in its session and in its epoch (window, generation).
_READS = r""",
t AS (SELECT tools.*, CASE WHEN win = 'main' THEN (SELECT count(*) FROM marks m WHERE m.session_id = tools.session_id AND m.ts <= tools.ts) ELSE 0 END AS gen
      FROM tools WHERE name IN ('Read', 'Edit') AND NOT is_error),
pre AS (SELECT r.request_id, r.lo, r.hi, p.ts AS pts, p.name = 'Read' AS isread, p.win AS pwin, p.win = r.win AND p.gen = r.gen AS now, p.lo AS plo, p.hi AS phi
        FROM t r JOIN t p ON p.session_id = r.session_id AND p.path = r.path AND (p.ts, p.request_id) < (r.ts, r.request_id) WHERE r.name = 'Read'),
lines AS (SELECT request_id, count(DISTINCT l) AS covered FROM (SELECT request_id, unnest(range(greatest(lo, plo), least(hi, phi) + 1)) AS l FROM pre WHERE isread AND now) GROUP BY 1),
flags AS (SELECT request_id, bool_or(isread) AS anyread, bool_or(isread AND pwin = 'main') AS mainread, max(pts) FILTER (isread AND now) AS lastread, max(pts) FILTER (NOT isread) AS lastwrite FROM pre GROUP BY 1),
reads AS (SELECT t.request_id, t.session_id, t.ts, t.win, t.gen, t.path, t.bytes, CASE
        WHEN NOT coalesce(anyread, false) THEN 'first'
        WHEN lastread IS NULL AND win = 'main' AND gen > 0 AND mainread THEN 'post_compact'
        WHEN lastread IS NULL THEN 'subagent'
        WHEN coalesce(covered, 0) < t.hi - t.lo + 1 THEN 'new_range'
        WHEN lastwrite > lastread THEN 'changed' ELSE 'avoidable' END AS reason
        FROM t LEFT JOIN flags USING (request_id) LEFT JOIN lines USING (request_id) WHERE t.name = 'Read')
"""
_rate5 = ", ".join(f"('{m}', {_tiers[t][2]}, {_tiers[t][4]})" for m, t, *_ in rates.MODELS)
_default = _tiers["tier_5_25"]
#: The ledger: what each read goes on costing, at the rates of the session's dearest model.
LEDGER = _READS + f""",
pm AS (SELECT session_id, model_key FROM (SELECT session_id, model_key, row_number() OVER (PARTITION BY session_id ORDER BY sum(m_total) DESC, min(request_id)) AS r FROM priced GROUP BY 1, 2) WHERE r = 1),
pr AS (SELECT session_id, coalesce(r5, {_default[2]})::DOUBLE AS r5, coalesce(rr, {_default[4]})::DOUBLE AS rr FROM pm LEFT JOIN (VALUES {_rate5}) AS v(model_key, r5, rr) USING (model_key)),
cw AS (SELECT session_id, ts, win, CASE WHEN win = 'main' THEN (SELECT count(*) FROM marks m WHERE m.session_id = w.session_id AND m.ts <= w.ts) ELSE 0 END AS gen
       FROM (SELECT session_id, ts, CASE WHEN origin = 'main' THEN 'main' ELSE agent_id END AS win FROM calls) w),
carried AS (SELECT reads.*, (SELECT count(*) FROM cw WHERE cw.session_id = reads.session_id AND cw.win = reads.win AND cw.gen = reads.gen AND cw.ts > reads.ts) AS n FROM reads),
ledger AS (SELECT carried.*, bytes / 4.0::DOUBLE AS tokens, bytes / 4.0::DOUBLE * (r5 + n * rr) / 1e6 AS carry_usd, bytes / 4.0::DOUBLE * 0.126::DOUBLE / 1000 AS calibrated_usd FROM carried JOIN pr USING (session_id))
"""



def _ident(w: str) -> str:
    """An identifier's parts: itself, those at _ and -, those that capitals and digits set off."""
    camel = rf"regexp_extract_all(regexp_replace({w}, '([A-Z]+)([A-Z][a-z])', '\1 \2', 'g'), '[A-Z]?[a-z0-9]+|[A-Z]+|[0-9]+')"
    long = "lambda x: length(x) > 1"
    return f"list_concat([lower({w})], CASE WHEN regexp_matches({w}, '[_-]') THEN list_filter(regexp_split_to_array(lower({w}), '[_-]+'), {long}) ELSE [] END, list_filter(list_transform({camel}, lambda x: lower(x)), {long}))"


def _file_words(old: bool, x: str) -> str:
    """CTEs d, w (id, word, x) and l (id, len), with x behind their names, of the kept index's files."""
    text = "CASE WHEN doc_id % 5 = 0 THEN substring(coalesce(text, ''), 1, 20) ELSE coalesce(text, '') END" if old else "coalesce(text, '')"
    fields = {"path": 3.0, "symbol": 8.0, "heading": 4.0, "body": 1.0}
    each = " UNION ALL ".join(f"SELECT id, unnest(regexp_extract_all(lower({f}), '[\\p{{L}}\\p{{N}}]+')) AS word, {v}::DOUBLE AS x FROM d{x}" for f, v in fields.items())
    return rf""", d{x} AS (SELECT id, path, symbol, string_split(body, chr(10))[1] AS heading, body FROM
            (SELECT doc_id AS id, coalesce(source, '') || '/doc_' || doc_id || '.txt' AS path, coalesce(lang, '') AS symbol, {text} AS body FROM documents {"WHERE doc_id % 7 <> 0" if old else ""})),
        i{x} AS (SELECT id, w, min(i) AS i FROM (SELECT id, unnest(x) AS w, unnest(range(1, len(x) + 1)) AS i FROM (SELECT id, regexp_extract_all(body || ' ' || symbol || ' ' || path, '[A-Za-z_][A-Za-z0-9_]{{1,63}}') AS x FROM d{x})) GROUP BY 1, 2),
        p{x} AS (SELECT id, p, min(i * 1000 + j) AS o FROM (SELECT id, i, unnest(x) AS p, unnest(range(1, len(x) + 1)) AS j FROM (SELECT id, i, {_ident("w")} AS x FROM i{x})) GROUP BY 1, 2),
        t{x} AS (SELECT id, p FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY o) AS r FROM p{x}) WHERE r <= 320),
        w{x} AS MATERIALIZED ({each} UNION ALL SELECT id, unnest(regexp_extract_all(p, '[\p{{L}}\p{{N}}]+')), 1.5 FROM t{x}), l{x} AS (SELECT d.id, count(w.word) AS len FROM d{x} d LEFT JOIN w{x} w USING (id) GROUP BY 1)"""


_RUNS = _file_words(True, "1") + _file_words(False, "2") + """,
        m AS (SELECT a.id, b.id IS NULL AS added, b.id IS NOT NULL AND (a.body <> b.body) AS changed, a.id % 4 = 0 AS later FROM d2 a LEFT JOIN d1 b USING (id))
        SELECT 1::BIGINT AS gen, count(*) AS scanned, count(*) AS asked, count(*) AS indexed, 0::BIGINT AS touched, 0::BIGINT AS removed, count(*) AS chunks, CAST(sum(len) AS BIGINT) AS length FROM l1
        UNION ALL SELECT 2, count(*), count_if(added OR changed OR later), count_if(added OR changed), count_if(later AND NOT added AND NOT changed), 0, count(*), (SELECT CAST(sum(len) AS BIGINT) FROM l2) FROM m"""

BODY = {
    "a01_requests": "SELECT session_id, request_id, model, output_tokens + request_id % 3 * 10 AS output_tokens, request_id % 3 + 1 AS lines, origin FROM calls",
    "c01_price": "SELECT request_id, model_key, tier, unpriced, context_tokens, " + ", ".join(f"CAST(m_{k} AS DOUBLE) / 1e6 AS usd_{k}" for k in ("input", "output", "cw5", "cw1", "read", "search", "total")) + " FROM priced",
    "x05_model_key": "SELECT model, model_key, count(*) AS calls FROM keyed GROUP BY 1, 2",
    "a03_totals": f"SELECT session_id, count(*) AS calls, count(*) FILTER (is_error) AS errors, count(*) FILTER (unpriced) AS unpriced, count(*) FILTER (origin <> 'main') AS side_calls, max(context_tokens) AS peak_context, {_tokens}, {_money} FROM priced GROUP BY 1",
    "a04_by_model": f"SELECT session_id, model, count(*) AS calls, {_tokens}, {_money} FROM priced GROUP BY 1, 2",
    "a05_by_origin": f"SELECT session_id, CASE WHEN origin = 'main' THEN 'main' ELSE origin || ':' || agent_type END AS origin, count(*) AS calls, count(DISTINCT agent_id) AS agents, string_agg(DISTINCT model_key, ',' ORDER BY model_key) AS models, {_usd} FROM priced GROUP BY 1, 2",
    "a06_by_tool": "SELECT session_id, name, count(*) AS uses, count(*) FILTER (is_error) AS errors, CAST(sum(bytes) // count(*) AS BIGINT) AS avg_bytes, max(bytes) AS max_bytes, CAST(sum(duration_ms) // nullif(count(duration_ms), 0) AS BIGINT) AS avg_ms FROM tools GROUP BY 1, 2",
    "a07_by_turn": f"SELECT session_id, coalesce(turn_id, -1) AS turn_id, count(*) AS calls, count(*) FILTER (origin <> 'main') AS side_calls, {_usd} FROM turned GROUP BY 1, 2",
    "a08_agents": f"SELECT session_id, agent_id, agent_type, count(*) AS calls, {_usd} FROM priced WHERE origin <> 'main' GROUP BY 1, 2, 3",
    "a09_agent_types": f"SELECT session_id, agent_type, count(DISTINCT agent_id) AS agents, {_usd} FROM priced WHERE origin <> 'main' GROUP BY 1, 2",
    "a10_cache": """, s AS (SELECT session_id, sum(cache_read) AS r, sum(context_tokens) AS c, CAST(sum(coalesce(CAST(cache_read AS DECIMAL(14,0)) * r_in, 0)) AS DOUBLE) / 1e6 AS unc, CAST(sum(m_read) AS DOUBLE) / 1e6 AS rd, CAST(sum(m_cw5) + sum(m_cw1) AS DOUBLE) / 1e6 AS wr FROM priced GROUP BY 1)
        SELECT session_id, coalesce(CAST(r AS DOUBLE) / nullif(c, 0), 0) AS hit_ratio, unc AS uncached_usd, unc - rd AS saved_usd, wr AS paid_usd, rd AS read_usd, unc - rd - wr AS net_usd FROM s""",
    "a11_waste": """SELECT session_id, failed_calls, failed_usd, tool_error_pct FROM (SELECT session_id, count(*) FILTER (is_error) AS failed_calls, CAST(coalesce(sum(m_total) FILTER (is_error), 0) AS DOUBLE) / 1e6 AS failed_usd FROM priced GROUP BY 1)
        LEFT JOIN (SELECT session_id, 100.0::DOUBLE * count(*) FILTER (is_error) / count(*) AS tool_error_pct FROM tools GROUP BY 1) USING (session_id)""",
    "a12_redundant": """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY wasted_bytes DESC, name, path) AS rank FROM (SELECT session_id, name, path, count(*) AS n, CAST(sum(bytes) AS BIGINT) AS bytes, count(DISTINCT win) AS callers,
        CAST(sum(bytes) * (count(*) - 1) // count(*) AS BIGINT) AS wasted_bytes FROM tools GROUP BY 1, 2, 3 HAVING count(*) >= 2)) WHERE rank <= 20""",
    "a13_primary_model": "SELECT session_id, model_key AS primary_model FROM (SELECT session_id, model_key, row_number() OVER (PARTITION BY session_id ORDER BY sum(m_total) DESC, min(request_id)) AS r FROM priced GROUP BY 1, 2) WHERE r = 1",
    "a18_reread_reasons": _READS + "SELECT session_id, reason, count(*) AS reads, CAST(sum(bytes) AS BIGINT) AS bytes FROM reads GROUP BY 1, 2",
    "a22_daily_rollup": f"SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, model_key, count(*) AS calls, CAST(sum(total_tokens) AS BIGINT) AS total_tokens, {_usd} FROM priced GROUP BY GROUPING SETS ((), (CAST(CAST(ts AS DATE) AS VARCHAR)), (model_key))",
    "a37_bounds": "SELECT session_id, min(ts) AS started_at, max(ts) AS last_activity, epoch_us(max(ts)) - epoch_us(min(ts)) AS wall_us FROM calls GROUP BY 1",
    "c06_settle": """, g AS (SELECT session_id, model_key, sum(m_total) AS m FROM priced GROUP BY 1, 2), h AS (SELECT session_id, model_key, m, sum(m) OVER (PARTITION BY session_id) AS a FROM g),
        p AS (SELECT *, CAST(floor(CAST(a AS DOUBLE) * 0.98) AS BIGINT) AS headline, coalesce(CAST(floor(CAST(m AS DOUBLE) * floor(CAST(a AS DOUBLE) * 0.98) / nullif(CAST(a AS DOUBLE), 0)) AS BIGINT), 0) AS q FROM h)
        SELECT session_id, model_key, headline, CAST(q + CASE WHEN row_number() OVER (PARTITION BY session_id ORDER BY m DESC, model_key) = 1 THEN headline - sum(q) OVER (PARTITION BY session_id) ELSE 0 END AS BIGINT) AS part FROM p""",
    "c12_audit": "SELECT id, kind, severity, sample, count(*) AS n, min(at_) AS first FROM (SELECT id, kind, severity, sample, CAST(strpos(text, sample) - 1 AS BIGINT) AS at_ FROM (" + " UNION ALL ".join(_FOUND) + ")) GROUP BY ALL",
    "c13_scrub": f"SELECT id, length(t) AS chars, md5(t) AS digest FROM (SELECT doc_id AS id, {_scrub} AS t FROM documents)",
    "c20_kept": _file_words(False, "") + r""", s AS (SELECT count(*) AS n, avg(len) AS mean FROM l),
        q0 AS (SELECT item_id AS query_id, i, regexp_replace(w, '^[-./]+|[-./]+$', '', 'g') AS w FROM (SELECT item_id, unnest(x) AS w, unnest(range(1, len(x) + 1)) AS i FROM (SELECT item_id, regexp_extract_all(text, '[A-Za-z0-9_./$-]{2,}') AS x FROM benchmark))),
        q1 AS (SELECT query_id, i, unnest(x) AS p, unnest(range(1, len(x) + 1)) AS j FROM (SELECT query_id, i, """ + _ident("w") + r""" AS x FROM q0)),
        q2 AS (SELECT query_id, p, min(i * 1000 + j) AS o FROM q1 WHERE regexp_full_match(p, '[a-z0-9]{2,}') GROUP BY 1, 2),
        q3 AS (SELECT query_id, o, 0 AS j, p AS key FROM q2 UNION ALL SELECT query_id, o, 1, p || '*' FROM q2 WHERE length(p) >= 4),
        q AS (SELECT query_id, key FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY o, j) AS r FROM q3) WHERE r <= 80), keys AS (SELECT DISTINCT key FROM q),
        k AS (SELECT word, key FROM (SELECT DISTINCT word FROM w) JOIN keys ON key = word UNION SELECT word, key FROM (SELECT DISTINCT word FROM w) JOIN keys ON ends_with(key, '*') AND starts_with(word, key[:-2])),
        tf AS (SELECT id, key, sum(x) AS tf FROM (SELECT id, word, sum(x) AS x FROM w GROUP BY 1, 2) JOIN k USING (word) GROUP BY 1, 2), f AS (SELECT key, count(*) AS df FROM tf GROUP BY 1),
        r AS (SELECT query_id, id, round(sum(greatest(1e-6, ln((n - df + 0.5) / (df + 0.5))) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean))), 6) AS score FROM q JOIN tf USING (key) JOIN f USING (key) JOIN l USING (id), s GROUP BY 1, 2)
        SELECT query_id, rank, id, score FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank FROM r) WHERE rank <= 10""",
    "c18_runs": _RUNS,
    "c20_bm25": f""", d AS (SELECT doc_id AS id, regexp_extract_all(lower(coalesce(source, '')), '{TERM}') AS a, regexp_extract_all(lower(coalesce(text, '')), '{TERM}') AS b FROM documents),
        s AS (SELECT count(*) AS n, avg(len(a) + len(b)) AS mean FROM d),
        w AS (SELECT id, len, unnest(a) AS w, 3.0::DOUBLE AS x FROM (SELECT *, len(a) + len(b) AS len FROM d) UNION ALL SELECT id, len, unnest(b), 1.0 FROM (SELECT *, len(a) + len(b) AS len FROM d)),
        q0 AS (SELECT query_id, min(i) AS i, w FROM (SELECT item_id AS query_id, unnest(range(1, len(t) + 1)) AS i, unnest(t) AS w FROM (SELECT item_id, regexp_extract_all(lower(text), '{TERM}') AS t FROM benchmark)) GROUP BY 1, 3),
        q1 AS (SELECT query_id, i, 0 AS j, w AS key FROM q0 UNION ALL SELECT query_id, i, 1, w || '*' FROM q0 WHERE length(w) >= 4),
        q AS (SELECT query_id, key FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY i, j) AS r FROM q1) WHERE r <= 80), keys AS (SELECT DISTINCT key FROM q),
        k AS (SELECT DISTINCT w.w, key FROM (SELECT DISTINCT w FROM w) w JOIN keys ON key = w.w OR (ends_with(key, '*') AND starts_with(w.w, key[:-2]))),
        p AS (SELECT id, key, sum(x) AS tf, any_value(len) AS len FROM w JOIN k USING (w) GROUP BY 1, 2), f AS (SELECT key, count(*) AS df FROM p GROUP BY 1),
        r AS (SELECT query_id, id, round(sum(greatest(1e-6, ln((n - df + 0.5) / (df + 0.5))) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean))), 6) AS score FROM q JOIN p USING (key) JOIN f USING (key), s GROUP BY 1, 2)
        SELECT query_id, rank, id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM r) WHERE rank <= 10""",
    "j04_asof": "SELECT request_id, turn_id FROM turned",
    "j11_overlap": """, r AS (SELECT * FROM tools WHERE name = 'Read'), c AS (SELECT path, unnest(range(1, top + 1, 25)) AS clo FROM (SELECT path, max(hi) AS top FROM r GROUP BY 1))
        SELECT request_id, CAST(sum(least(hi, clo + 24) - greatest(lo, clo) + 1) AS BIGINT) AS lines, count(*) AS chunks FROM r JOIN c USING (path) WHERE clo + 24 >= lo AND clo <= hi GROUP BY 1""",
    "o03_topk": "SELECT session_id, rank, request_id, CAST(m_total AS DOUBLE) / 1e6 AS usd_total FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY m_total DESC, request_id) AS rank FROM priced) WHERE rank <= 3",
    "t03_live": "SELECT session_id, count(*) AS calls, CAST(sum(output_tokens + request_id % 3 * 10) AS BIGINT) AS output_tokens, max(ts) AS last_activity FROM calls GROUP BY 1",
    "u03_except": """, r AS (SELECT session_id, path, CAST(ts AS DATE) AS day FROM tools WHERE name = 'Read'), l AS (SELECT session_id, max(day) AS last FROM r GROUP BY 1)
        SELECT DISTINCT session_id, path FROM r EXCEPT SELECT session_id, path FROM r JOIN l USING (session_id) WHERE day = last""",
    "w04_cumulative": "SELECT session_id, request_id, CAST(sum(m_total) OVER (PARTITION BY session_id ORDER BY ts, request_id ROWS UNBOUNDED PRECEDING) AS DOUBLE) / 1e6 AS cum_usd FROM priced",
    "w05_thinned": """, s AS (SELECT session_id, epoch_us(ts) AS t, min(epoch_us(ts)) OVER w AS t0, max(epoch_us(ts)) OVER w AS t1, count(*) OVER w AS n, row_number() OVER (PARTITION BY session_id ORDER BY ts, request_id) AS i,
        sum(m_total) OVER (PARTITION BY session_id ORDER BY ts, request_id ROWS UNBOUNDED PRECEDING) AS cum FROM priced WINDOW w AS (PARTITION BY session_id))
        SELECT session_id, CASE WHEN n <= 2000 THEN i - 1 ELSE coalesce((t - t0) * 1999 // nullif(t1 - t0, 0), 0) END AS bucket, max(t) AS t, CAST(max(cum) AS DOUBLE) / 1e6 AS cum_usd FROM s GROUP BY 1, 2""",
    "w08_growth": """, e AS (SELECT session_id, turn_id, max_by(context_tokens, (ts, request_id)) AS ctx, max((ts, request_id)) AS at_ FROM turned WHERE origin = 'main' GROUP BY 1, 2),
        s AS (SELECT session_id, ctx - lag(ctx) OVER (PARTITION BY session_id ORDER BY at_) AS step, lag(ctx) OVER (PARTITION BY session_id ORDER BY at_) AS prior FROM e)
        SELECT session_id, CAST(median(step) FILTER (step > 0) AS DOUBLE) AS median_rise, count(*) FILTER (step < 0) AS resets, count(*) FILTER (step < -0.25 * prior) AS major_resets FROM s GROUP BY 1""",
    "w09_carry": """, w AS (SELECT session_id, ts, CASE WHEN origin = 'main' THEN 'main' ELSE agent_id END AS win FROM calls),
        c AS (SELECT w.*, CASE WHEN win = 'main' THEN (SELECT count(*) FROM marks m WHERE m.session_id = w.session_id AND m.ts <= w.ts) ELSE 0 END AS gen FROM w),
        r AS (SELECT tools.*, CASE WHEN win = 'main' THEN (SELECT count(*) FROM marks m WHERE m.session_id = tools.session_id AND m.ts <= tools.ts) ELSE 0 END AS gen FROM tools WHERE name = 'Read')
        SELECT request_id, gen, (SELECT count(*) FROM c WHERE c.session_id = r.session_id AND c.win = r.win AND c.gen = r.gen AND c.ts > r.ts) AS carry_requests FROM r""",
    "w10_rereads": _READS + "SELECT request_id, reason FROM reads",
    "c08_ledger": LEDGER + "SELECT request_id, reason, gen, n AS carry_requests, tokens, round(carry_usd, 9) AS carry_usd, round(calibrated_usd, 9) AS calibrated_usd FROM ledger",
    "a18_summary": LEDGER + " UNION ALL ".join(
        f"SELECT session_id, {r} AS reason, {p} AS path, count(*) AS reads, count(*) FILTER (ledger.reason <> 'first') AS repeats, CAST(sum(bytes) AS BIGINT) AS bytes, sum(CAST(round(carry_usd * 1e12) AS BIGINT))::DOUBLE / 1e12 AS carry_usd, sum(CAST(round(calibrated_usd * 1e12) AS BIGINT))::DOUBLE / 1e12 AS calibrated_usd FROM ledger GROUP BY session_id{g}"
        for r, p, g in (("CAST(NULL AS VARCHAR)", "CAST(NULL AS VARCHAR)", ""), ("ledger.reason", "CAST(NULL AS VARCHAR)", ", ledger.reason"), ("CAST(NULL AS VARCHAR)", "ledger.path", ", ledger.path"))
    ),
    "a19_corpus_rereads": LEDGER + """, g AS (SELECT path, count(*) AS reads, count(*) FILTER (reason <> 'first') AS repeats, count(DISTINCT session_id) AS sessions, coalesce(sum(CAST(round(calibrated_usd * 1e12) AS BIGINT)) FILTER (reason <> 'first'), 0)::DOUBLE / 1e12 AS repeat_usd, round(avg(bytes) FILTER (reason = 'first'), 6) AS first_bytes FROM ledger GROUP BY 1)
        SELECT *, CAST(row_number() OVER (ORDER BY repeat_usd DESC, reads DESC, path) AS INTEGER) AS place FROM g""",
    "w07_contexts": ", win(model_key, w) AS (VALUES " + ", ".join(f"('{m}', {w})" for m, _, w, _ in rates.MODELS if w) + ") SELECT session_id, request_id, context_tokens, CAST(coalesce(w, 200000) AS BIGINT) AS max_tokens, floor(10000.0::DOUBLE * context_tokens / coalesce(w, 200000) + 0.5) / 100.0::DOUBLE AS pct FROM priced LEFT JOIN win USING (model_key) WHERE origin = 'main'",
    "w11_islands": """, r AS (SELECT *, CASE WHEN lo > max(hi) OVER (PARTITION BY session_id, path ORDER BY lo, hi, request_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 1 ELSE 0 END AS gap FROM tools WHERE name = 'Read'),
        i AS (SELECT *, 1 + sum(gap) OVER (PARTITION BY session_id, path ORDER BY lo, hi, request_id ROWS UNBOUNDED PRECEDING) AS island FROM r)
        SELECT session_id, path, CAST(island AS BIGINT) AS island, min(lo) AS lo, max(hi) AS hi, count(*) AS reads FROM i GROUP BY 1, 2, 3""",
    "w12_runs": """, g AS (SELECT *, CASE WHEN coalesce(epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY session_id ORDER BY ts, request_id)) > 600000000, true) THEN 1 ELSE 0 END AS new FROM calls),
        n AS (SELECT *, sum(new) OVER (PARTITION BY session_id ORDER BY ts, request_id ROWS UNBOUNDED PRECEDING) AS run FROM g)
        SELECT session_id, CAST(run AS BIGINT) AS run, count(*) AS calls, min(ts) AS first_ts, max(ts) AS last_ts FROM n GROUP BY 1, 2""",
    "w15_day_series": """, d AS (SELECT CAST(ts AS DATE) AS day, sum(m_total) AS m FROM priced GROUP BY 1), a AS (SELECT CAST(unnest(generate_series(min(day), max(day), INTERVAL 1 DAY)) AS DATE) AS day FROM d),
        f AS (SELECT day, coalesce(m, 0) AS m FROM a LEFT JOIN d USING (day))
        SELECT CAST(day AS VARCHAR) AS day, CAST(m AS DOUBLE) / 1e6 AS usd, CAST(sum(m) OVER (ORDER BY day ROWS 6 PRECEDING) AS DOUBLE) / 1e6 AS usd_7d FROM f""",
    "w19_capped_topk": """SELECT session_id, rank, path, request_id, bytes FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY bytes DESC, request_id) AS rank FROM
        (SELECT *, row_number() OVER (PARTITION BY session_id, path ORDER BY bytes DESC, request_id) AS r FROM tools) WHERE r <= 3) WHERE rank <= 8""",
    "w20_pseudonyms": "SELECT session_id, agent_id, 'n' || row_number() OVER (PARTITION BY session_id ORDER BY f) AS pseudonym FROM (SELECT session_id, agent_id, min((ts, request_id)) AS f FROM calls WHERE agent_id IS NOT NULL GROUP BY 1, 2)",
    "w23_burn": "SELECT session_id, request_id, CAST(sum(m_total) OVER (PARTITION BY session_id ORDER BY CAST(floor(epoch_us(ts) / 1000000) AS BIGINT) RANGE 900 PRECEDING) AS DOUBLE) / 1e6 AS usd_15m FROM priced",
}


def sql() -> dict[str, str]:
    return {k: FACTS + v for k, v in BODY.items()}
