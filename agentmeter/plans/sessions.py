"""Registered queries on session rows, texts and small scalar rules, each with its SQL beside it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as X
from ..functions import walk
from ..functions import rates
from ..operators import listing, pricing, privacy, publishing
from ..operators.series import micros
from ..sources import facade
from .more import costs
from .more_sql import _BILL

ZONE, HOURS = "-04:00", 4
#: Words of a prompt that say nothing of what it is about.
STOP = ("the", "and", "for", "that", "this", "with", "from", "are", "was", "not", "you", "have")


def priced(spark: SparkSession, d: str) -> DataFrame:
    return pricing.price(facade.calls(spark, d))


def windows(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(m, w) for m, _, w, _ in rates.MODELS if w], "model_key string, max_tokens long")


def newest(c: DataFrame) -> int:
    return c.agg(F.max(micros())).first()[0] or 0


def a23(spark: SparkSession, d: str) -> DataFrame:
    c = priced(spark, d)
    return listing.spend_now(c, newest(c), ZONE, 6 * 3600)


def c10(spark: SparkSession, d: str) -> DataFrame:
    return listing.scan_rows(priced(spark, d), costs(spark, d), windows(spark))


def o05(spark: SparkSession, d: str) -> DataFrame:
    rows = c10(spark, d).select("session_id", "last_activity", "usd")
    return listing.listed(rows, newest(facade.calls(spark, d)), 6 * 3600, 100)


def server_tools(spark: SparkSession, d: str) -> DataFrame:
    """Every third tool call as one of a server's."""
    name = F.when(F.col("request_id") % 3 == 0, F.concat(F.lit("mcp__srv"), F.col("bytes") % 4, F.lit("__"), "name")).otherwise(F.col("name"))
    return facade.tools(spark, d).withColumn("name", name)


def c29(spark: SparkSession, d: str) -> DataFrame:
    t = server_tools(spark, d).withColumn("server", F.coalesce(X.mcp_server(F.col("name")), F.lit("none")))
    return t.groupBy("server").agg(F.count("*").alias("uses"), F.count_if("is_error").alias("errors"), F.sum("bytes").alias("bytes"), F.countDistinct("name").alias("names"))


def a31(spark: SparkSession, d: str) -> DataFrame:
    t = facade.tools(spark, d).filter("name = 'Read'").withColumn("file_bytes", F.col("hi") * 40)
    return listing.retrieval_ratio(t)


def a34(spark: SparkSession, d: str) -> DataFrame:
    e = facade.events(spark, d).filter("event_type = 'signup' and k % 10 = 0 and event_id % 10 < 7")
    post = F.when(F.col("event_id") % 2 == 0, F.col("event_id") % 500)
    trigger = F.when(F.col("event_id") % 3 == 0, "manual").otherwise("auto")
    return listing.compaction_stats(e.select(F.col("user_id").alias("session_id"), trigger.alias("trigger"), (1000 + F.col("event_id") % 9000).alias("pre_tokens"), post.alias("post_tokens")))


def p17(spark: SparkSession, d: str) -> DataFrame:
    """Each priced kind of a model and speed: tokens, rate, dollars before the place's factor."""
    cat = rates.catalog(spark).select("model_key", "fast", "r_in", "r_out", "r_cw5", "r_cw1", "r_read")
    g = priced(spark, d).groupBy("model_key", "fast").agg(*[F.sum(n).alias(kind) for kind, n, _ in pricing.KINDS])
    kinds = F.array(*[F.struct(F.lit(kind).alias("kind"), F.col(kind).alias("tokens"), F.col(rate).alias("rate")) for kind, _, rate in pricing.KINDS])
    rows = g.join(F.broadcast(cat), ["model_key", "fast"]).select("model_key", "fast", F.explode(kinds).alias("r")).select("model_key", "fast", "r.*")
    return rows.select("model_key", "fast", "kind", "tokens", F.col("rate").cast("double").alias("rate"), ((F.col("tokens").cast("decimal(18,0)") * F.col("rate")).cast("double") / 1e6).alias("usd"))


def c25(spark: SparkSession, d: str) -> DataFrame:
    """Stored token facts under another catalog: every model at the rates of tier_2_10."""
    then = dict(zip(("input_tokens", "output_tokens", "cw5_tokens", "cw1_tokens", "cache_read"), next(t for t in rates.TIERS if t[0] == "tier_2_10")[1:6], strict=True))
    zero = F.lit(0).cast("decimal(28,5)")
    new = sum((F.col(n).cast("decimal(14,0)") * F.lit(r).cast(rates.RATE) * X.geo_factor(F.col("geo")) for n, r in then.items()), zero)
    c = priced(spark, d).withColumn("m_then", (new + F.col("m_search")).cast("decimal(28,5)"))
    return c.groupBy("model_key").agg(pricing.usd("m_total").alias("now_usd"), pricing.usd("m_then").alias("then_usd"))


def j19(spark: SparkSession, d: str) -> DataFrame:
    """The catalog against the models that were used: MISSING from it, STALE in it, or OK."""
    used = priced(spark, d).groupBy("model_key").agg(F.count("*").alias("calls"))
    known = rates.catalog(spark).filter("not fast").select("model_key", "tier")
    both = known.join(used, "model_key", "full")
    state = F.when(F.col("tier").isNull(), "MISSING").when(F.col("calls").isNull(), "STALE").otherwise("OK")
    return both.select("model_key", state.alias("state"), F.coalesce("calls", F.lit(0)).alias("calls"))


def turns(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/conversations.parquet")


def p12(spark: SparkSession, d: str) -> DataFrame:
    """Real prompts with a preview: what a user said, white space squeezed, 220 signs."""
    preview = F.substring(F.trim(F.regexp_replace("text", r"[\x20\x09-\x0D]+", " ")), 1, 220)
    t = turns(spark, d).filter("role = 'user' and text is not null").withColumn("preview", preview)
    return t.filter("preview <> '' and not startswith(preview, '<local-command-stdout>')").select("conv_id", "turn", "preview")


def x21(spark: SparkSession, d: str) -> DataFrame:
    return X.prompt_terms(turns(spark, d).filter("role = 'user'").select("conv_id", "turn", "text"), ["conv_id", "turn"], STOP)


def x12(spark: SparkSession, d: str) -> DataFrame:
    p = spark.read.parquet(f"{d}/pages.parquet").select("page_id", F.regexp_extract("url", r"://[^/?#]*([^?#]*)", 1).alias("path"))
    return p.select("page_id", X.extension(F.col("path")).alias("ext"), X.depth(F.col("path")).alias("depth"))


def x16(spark: SparkSession, d: str) -> DataFrame:
    t = spark.read.parquet(f"{d}/documents.parquet").filter("source is not null").select("source").distinct()
    return t.select("source", X.short_token("source", F.col("source")).alias("token"))


def x24(spark: SparkSession, d: str) -> DataFrame:
    """Spans as text, parsed, put in order and clamped to a file of 900 lines."""
    e = facade.events(spark, d).select("event_id", F.concat_ws("-", (F.col("event_id") % 1000).cast("string"), F.col("k").cast("string")).alias("span"))
    lo, hi = X.parsed_span(F.col("span"), 900)
    return e.select("event_id", lo.alias("lo"), hi.alias("hi"))


def x27(spark: SparkSession, d: str) -> DataFrame:
    """Values as the texts that could show them: quantised at 0 to 4 places, and by the usual scales."""
    e = facade.events(spark, d).filter("value > 0").select("event_id", F.col("value").cast("decimal(18,6)").alias("value"))
    return X.written_forms(e, "value").groupBy("scale", "places").agg(F.count("*").alias("n"), F.countDistinct("written").alias("forms"), F.sum(X.significant(F.col("written"))).alias("digits"))


def nested(spark: SparkSession, d: str) -> DataFrame:
    """A summary of every event as JSON of three levels."""
    e = facade.events(spark, d)
    inner = F.struct(F.col("value").alias("usd"), F.array(F.col("k"), F.col("k") + 1).alias("spans"))
    whole = F.struct(F.struct(F.struct(inner.alias("deep")).alias("b")).alias("a"), F.array(F.struct(F.col("event_id").alias("id")), F.struct((-F.col("k")).alias("id"))).alias("list"), F.lit(True).alias("flag"), F.lit("12").alias("text"))
    return e.select(F.to_json(whole).alias("j"))


def s13_walk(spark: SparkSession, d: str) -> DataFrame:
    n = walk.numbers(nested(spark, d), "j", depth=6)
    return n.groupBy("path").agg(F.count("*").alias("n"), F.sum("number").cast("double").alias("total"))


def usage_tables(spark: SparkSession, d: str) -> DataFrame:
    """The model tables of the billing snapshots: two models each, some entries bad."""
    e = facade.checkpoints(spark, d).withColumn("k", F.floor(F.col("reported") / 100000).cast("long"))
    of = lambda n: F.format_string('{"inputTokens":%d,"outputTokens":"%d","cacheReadInputTokens":%d.75,"costUSD":%d.25}', F.col("k") * n, F.col("k"), F.col("k"), F.col("k") * n)
    text = F.when(F.col("k") % 11 == 0, F.lit("[1,2]")).when(F.col("k") % 13 == 0, F.lit("{bad")).otherwise(F.format_string('{"m%d":%s,"other":%s,"none":null}', F.col("k") % 3, of(1), of(2)))
    return e.select("session_id", text.alias("usage"))


def a15_usage(spark: SparkSession, d: str) -> DataFrame:
    u = walk.model_usage(usage_tables(spark, d))
    return u.select("session_id", "model", "runs", F.col("inputTokens").alias("input"), F.col("outputTokens").alias("output"), F.col("cacheReadInputTokens").alias("cache_read"), F.col("webSearchRequests").alias("searches"), F.col("costUSD").cast("double").alias("usd"))


def p19(spark: SparkSession, d: str) -> DataFrame:
    status = F.when(F.col("k") % 2 == 0, F.col("k").cast("string")).otherwise(F.col("event_type"))
    e = facade.events(spark, d).select(X.error_status(status).alias("status"))
    return e.groupBy("status").agg(F.count("*").alias("n"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "a21_by_day": lambda s, d: listing.by_day(priced(s, d), ZONE), "a21_by_speed": lambda s, d: listing.by_speed(priced(s, d)), "a23_spend_now": a23,
        "a27_heavy_agents": lambda s, d: listing.heavy_share(facade.tools(s, d), 5, 2), "a31_retrieval": a31, "a34_compactions": a34,
        "a36_top_tool": lambda s, d: listing.top_tool(facade.tools(s, d)), "c10_session_rows": c10, "c25_reprice": c25, "c29_servers": c29,
        "j19_catalog": j19, "o05_listing": o05, "p12_previews": p12, "p14_models": lambda s, d: listing.models(priced(s, d)), "p17_kind_rates": p17,
        "p19_status": p19, "x12_paths": x12, "x16_tokens": x16, "x21_prompt_terms": x21, "x24_spans": x24, "x27_forms": x27, "s13_walk": s13_walk, "a15_usage": a15_usage, **more_queries(),
    }


_T210 = next(t for t in rates.TIERS if t[0] == "tier_2_10")
_then = " + ".join(f"CAST({n} AS DECIMAL(14,0)) * CAST({r} AS DECIMAL(10,4)) * g" for n, r in zip(("input_tokens", "output_tokens", "cw5_tokens", "cw1_tokens", "cache_read"), _T210[1:6], strict=True))
_windows = ", ".join(f"('{m}', {w})" for m, _, w, _ in rates.MODELS if w)
_stop = ", ".join(f"'{w}'" for w in STOP)
_ROWS = _BILL + f""",
win(model_key, w) AS (VALUES {_windows}),
own AS (SELECT session_id, min(ts) AS started_at, max(ts) AS last_activity, count(*) AS calls, CAST(sum(total_tokens) AS BIGINT) AS total_tokens,
        max_by(model_key, (ts, request_id)) FILTER (origin = 'main') AS model_key, max_by(context_tokens, (ts, request_id)) FILTER (origin = 'main') AS context_tokens FROM priced GROUP BY 1),
rows AS (SELECT own.*, usd, source, floor(10000.0::DOUBLE * context_tokens / coalesce(w, 200000) + 0.5) / 100.0::DOUBLE AS context_pct, source <> 'reported' AS estimate
         FROM own LEFT JOIN win USING (model_key) JOIN agreed USING (session_id))
"""
_now = "(SELECT max(epoch_us(ts)) FROM calls)"
_day = f"CAST(CAST(ts - INTERVAL {HOURS} HOUR AS DATE) AS VARCHAR)"

BODY = {
    "a21_by_day": f"SELECT session_id, {_day} AS day, count(*) AS calls, CAST(sum(m_total) AS DOUBLE) / 1e6 AS usd FROM priced GROUP BY 1, 2",
    "a21_by_speed": "SELECT session_id, model_key, CASE WHEN fast THEN 'fast' ELSE 'standard' END AS speed, count(*) AS calls, CAST(sum(m_total) AS DOUBLE) / 1e6 AS usd FROM priced GROUP BY 1, 2, 3",
    "a23_spend_now": f""", d AS (SELECT *, {_day} AS day FROM priced), l AS (SELECT session_id, max(epoch_us(ts)) AS last_us, sum(m_total) AS m FROM priced GROUP BY 1), f AS (SELECT * FROM l WHERE {_now} - last_us <= 21600000000)
        SELECT coalesce(CAST(sum(m_total) AS DOUBLE) / 1e6, 0) AS today_usd, count(DISTINCT session_id) AS today_sessions, (SELECT coalesce(CAST(sum(m) AS DOUBLE) / 1e6, 0) FROM f) AS flight_usd, (SELECT count(*) FROM f) AS flight_sessions
        FROM d WHERE day = (SELECT max(day) FROM d)""",
    "a27_heavy_agents": """, a AS (SELECT session_id, win, count(*) FILTER (name = 'Read') AS reads, max(ts) AS at_ FROM tools WHERE win <> 'main' GROUP BY 1, 2),
        r AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY at_ DESC, win) AS r FROM a) SELECT session_id, avg(CASE WHEN reads >= 2 THEN 1.0::DOUBLE ELSE 0 END) AS heavy_share, count(*) AS agents FROM r WHERE r <= 5 GROUP BY 1""",
    "a31_retrieval": """, e AS (SELECT session_id, path, sum(bytes) AS b, max(hi * 40) AS whole FROM tools WHERE name = 'Read' GROUP BY 1, 2)
        SELECT session_id, count(*) AS files, CAST(sum(b) AS DOUBLE) / 4 AS tokens, CAST(sum(whole) AS DOUBLE) / 4 AS whole_tokens, CAST(sum(b) AS DOUBLE) / nullif(sum(whole), 0) AS ratio FROM e GROUP BY 1""",
    "a34_compactions": """, m AS (SELECT user_id AS session_id, CASE WHEN event_id % 3 = 0 THEN 'manual' ELSE 'auto' END AS t, 1000 + event_id % 9000 AS pre, CASE WHEN event_id % 2 = 0 THEN event_id % 500 END AS post FROM ev WHERE event_type = 'signup' AND k % 10 = 0 AND event_id % 10 < 7)
        SELECT session_id, count(*) AS n, count(*) FILTER (t = 'auto') AS auto, avg(pre) AS mean_pre, coalesce(avg(post), 0.025::DOUBLE * avg(pre)) AS mean_post FROM m GROUP BY 1""",
    "a36_top_tool": """, e AS (SELECT session_id, name, count(*) AS n FROM tools GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY n DESC, name) AS r FROM e)
        SELECT session_id, CAST(sum(n) AS BIGINT) AS uses, count(*) AS tools, max(name) FILTER (r = 1) AS top_tool FROM r GROUP BY 1""",
    "c10_session_rows": _ROWS + "SELECT * FROM rows",
    "c25_reprice": f"SELECT model_key, CAST(sum(m_total) AS DOUBLE) / 1e6 AS now_usd, CAST(sum(CAST({_then} + m_search AS DECIMAL(28,5))) AS DOUBLE) / 1e6 AS then_usd FROM priced GROUP BY 1",
    "c29_servers": """, n AS (SELECT *, CASE WHEN request_id % 3 = 0 THEN 'mcp__srv' || (bytes % 4) || '__' || name ELSE name END AS full_name FROM tools)
        SELECT CASE WHEN full_name LIKE 'mcp\\_\\_%' ESCAPE '\\' THEN string_split(full_name, '__')[2] ELSE 'none' END AS server, count(*) AS uses, count(*) FILTER (is_error) AS errors, CAST(sum(bytes) AS BIGINT) AS bytes, count(DISTINCT full_name) AS names FROM n GROUP BY 1""",
    "j19_catalog": """, u AS (SELECT model_key, count(*) AS calls FROM priced GROUP BY 1), r AS (SELECT model_key, tier FROM rate WHERE NOT fast)
        SELECT model_key, CASE WHEN tier IS NULL THEN 'MISSING' WHEN calls IS NULL THEN 'STALE' ELSE 'OK' END AS state, coalesce(calls, 0) AS calls FROM r FULL JOIN u USING (model_key)""",
    "o05_listing": _ROWS + f", l AS (SELECT session_id, last_activity, usd, {_now} - epoch_us(last_activity) <= 21600000000 AS active, (SELECT count(*) FROM rows) AS found FROM rows) SELECT * FROM l ORDER BY active DESC, last_activity DESC, session_id LIMIT 100",
    "p12_previews": r""", p AS (SELECT conv_id, turn, left(trim(regexp_replace(text, '[\x20\x09-\x0D]+', ' ', 'g')), 220) AS preview FROM conversations WHERE role = 'user')
        SELECT * FROM p WHERE preview <> '' AND NOT starts_with(preview, '<local-command-stdout>')""",
    "p14_models": """, n AS (SELECT session_id, max_by(model_key, (ts, request_id)) AS model_now FROM priced GROUP BY 1), e AS (SELECT session_id, model_key, sum(m_total) AS m FROM priced GROUP BY 1, 2 HAVING sum(m_total) > 0),
        o AS (SELECT session_id, string_agg(model_key, ',' ORDER BY m DESC, model_key) AS others FROM e JOIN n USING (session_id) WHERE model_key <> model_now GROUP BY 1) SELECT session_id, model_now, coalesce(others, '') AS others FROM n LEFT JOIN o USING (session_id)""",
    "p17_kind_rates": " UNION ALL ".join(
        f"SELECT model_key, fast, '{kind}' AS kind, CAST(sum({n}) AS BIGINT) AS tokens, CAST(any_value(rate.{r}) AS DOUBLE) AS rate, CAST(sum({n})::DECIMAL(18,0) * any_value(rate.{r}) AS DOUBLE) / 1e6 AS usd FROM priced JOIN rate USING (model_key, fast) GROUP BY 1, 2"
        for kind, n, r in pricing.KINDS
    ),
    "p19_status": "SELECT CASE WHEN k % 2 = 0 THEN CAST(k AS VARCHAR) ELSE 'error' END AS status, count(*) AS n FROM ev GROUP BY 1",
    "x12_paths": r""", p AS (SELECT page_id, regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path FROM pages)
        SELECT page_id, regexp_extract(path, '(\.[A-Za-z0-9]{1,8})$', 1) AS ext, CAST(len(list_filter(string_split(path, '/'), lambda x: x <> '')) AS INTEGER) AS depth FROM p""",
    "x16_tokens": "SELECT DISTINCT source, left(sha256('source:' || source), 8) AS token FROM documents WHERE source IS NOT NULL",
    "x21_prompt_terms": f""", t AS (SELECT conv_id, turn, regexp_extract_all(lower(left(text, 4000)), '[a-z][a-z0-9_]+') AS w FROM conversations WHERE role = 'user'),
        e AS (SELECT conv_id, turn, unnest(w) AS term, unnest(range(1, len(w) + 1)) AS i FROM t), c AS (SELECT conv_id, turn, term, count(*) AS n, min(i) AS first FROM e WHERE length(term) > 2 AND term NOT IN ({_stop}) GROUP BY 1, 2, 3)
        SELECT conv_id, turn, term, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY n DESC, first) AS rank FROM c) WHERE rank <= 12""",
    "x24_spans": "SELECT event_id, greatest(1, least(900, least(event_id % 1000, k))) AS lo, greatest(1, least(900, greatest(event_id % 1000, k))) AS hi FROM ev",
}
BODY["s13_walk"] = """, w AS (SELECT unnest(['$.a.b.deep.usd', '$.a.b.deep.spans[0]', '$.a.b.deep.spans[1]', '$.list[0].id', '$.list[1].id']) AS path, unnest([value, k, k + 1, event_id, -k]) AS v FROM ev)
    SELECT path, count(v) AS n, CAST(sum(CAST(v AS DECIMAL(28,12))) AS DOUBLE) AS total FROM w WHERE v IS NOT NULL GROUP BY 1"""
BODY["a15_usage"] = """, c AS (SELECT user_id AS session_id, k FROM ev WHERE event_id % 40 = 0 AND k % 11 <> 0 AND k % 13 <> 0),
    m AS (SELECT session_id, 'm' || CAST(k % 3 AS VARCHAR) AS model, k, 1 AS n FROM c UNION ALL SELECT session_id, 'other', k, 2 FROM c)
    SELECT session_id, model, count(*) AS runs, CAST(sum(k * n) AS BIGINT) AS input, CAST(sum(k) AS BIGINT) AS output, CAST(sum(k) AS BIGINT) AS cache_read, 0::BIGINT AS searches, CAST(sum(k * n + 0.25) AS DOUBLE) AS usd FROM m GROUP BY 1, 2"""
#: The forms of a number in SQL, in whole numbers: v millionths over a scale, halves to even.
BODY["x27_forms"] = f""", v AS (SELECT CAST(CAST(value AS DECIMAL(18,6)) * 1000000 AS BIGINT) AS v FROM ev WHERE value > 0),
    d AS (SELECT v, scale, places, CAST(scale * pow(10, 6 - places) AS BIGINT) AS d FROM v, unnest({list(X.SCALES)}) AS s(scale), range(5) AS p(places)),
    q AS (SELECT scale, places, v // d + CASE WHEN 2 * (v % d) > d OR (2 * (v % d) = d AND (v // d) % 2 = 1) THEN 1 ELSE 0 END AS q FROM d),
    w AS (SELECT scale, places, CAST(pow(10, places) AS BIGINT) AS t, q FROM q),
    f AS (SELECT scale, places, CAST(q // t AS VARCHAR) AS a, CASE WHEN places > 0 THEN lpad(CAST(q % t AS VARCHAR), CAST(places AS INTEGER), '0') ELSE '' END AS b FROM w)
    SELECT CAST(scale AS INTEGER) AS scale, CAST(places AS INTEGER) AS places, count(*) AS n, count(DISTINCT a || '.' || b) AS forms,
    CAST(sum(CASE WHEN places > 0 THEN CASE WHEN a = '0' THEN length(ltrim(b, '0')) ELSE length(a) + length(b) END ELSE greatest(1, length(trim(a, '0'))) END) AS BIGINT) AS digits FROM f GROUP BY 1, 2"""


# --- publishing


def f12(spark: SparkSession, d: str) -> DataFrame:
    """The models that no rate is known for, and what used them."""
    c = priced(spark, d).filter("unpriced")
    return c.groupBy("model_key").agg(F.count("*").alias("calls"), F.countDistinct("session_id").alias("sessions"), F.sum("total_tokens").alias("total_tokens"))


def changed(spark: SparkSession, d: str) -> DataFrame:
    return facade.calls(spark, d).groupBy("session_id").agg(F.max("ts").alias("changed_at"))


def built(spark: SparkSession, d: str) -> DataFrame:
    """Every second session's artifacts, of its newest checkpoint, and those of sessions that are gone."""
    p = facade.events(spark, d).filter("event_id % 40 = 0").groupBy(F.col("user_id").alias("session_id")).agg(F.max("ts").alias("built_at"))
    return p.withColumn("session_id", F.when(F.col("session_id") % 2 == 0, F.col("session_id")).otherwise(F.col("session_id") + 1_000_000))


def c28(spark: SparkSession, d: str) -> DataFrame:
    """The first two long words of every benchmark item as terms, in all documents."""
    t = spark.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").alias("id"), "text")
    b = spark.read.parquet(f"{d}/benchmark.parquet")
    words = b.select(F.explode(F.slice(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]{5,})"), 1), 1, 2)).alias("term"))
    return publishing.denied(t, words).select("id", "term", F.col("n").cast("bigint").alias("n"))


def x29(spark: SparkSession, d: str) -> DataFrame:
    """Names of sources, languages and the benchmark's first words, where they stand as names in documents with a home folder and an address."""
    t = spark.read.parquet(f"{d}/documents.parquet")
    text = F.concat(F.lit("/home/"), F.coalesce("source", F.lit("none")), F.lit("/x "), F.coalesce("text", F.lit("")), F.lit(" "), F.coalesce("lang", F.lit("")), F.lit("@host"))
    first = spark.read.parquet(f"{d}/benchmark.parquet").select(F.regexp_extract(F.lower("text"), "([a-z]+)", 1).alias("needle"))
    names = t.select(F.col("source").alias("needle")).union(t.select("lang")).union(first).filter("needle is not null").distinct().select(F.lit("login").alias("kind"), "needle")
    hits = privacy.needle_hits(t.select(F.col("doc_id").alias("id"), text.alias("text")), names)
    return hits.groupBy("id", "needle").agg(F.count("*").alias("n"))


def c26(spark: SparkSession, d: str) -> DataFrame:
    c = facade.calls(spark, d)
    s = c.groupBy("session_id").agg(F.count("*").alias("rows"), F.sum("cache_read").alias("bytes"), F.max(micros()).alias("last_us"))
    return publishing.retention(s, s.filter(F.col("last_us") < newest(c) - 6 * 3600 * 1_000_000))


def o10(spark: SparkSession, d: str) -> DataFrame:
    c = priced(spark, d)
    return publishing.rank_bars(c, "model_key", "m_total").unionByName(publishing.rank_bars(c, "session_id", "m_total"))


def x31(spark: SparkSession, d: str) -> DataFrame:
    p = spark.read.parquet(f"{d}/pages.parquet").select("page_id", F.regexp_extract("url", r"://[^/?#]*([^?#]*)", 1).alias("path"))
    return p.select("page_id", publishing.slug(F.col("path")).alias("slug"))


def u06(spark: SparkSession, d: str) -> DataFrame:
    """Paths that pages of one half have and those of the other lack."""
    p = spark.read.parquet(f"{d}/pages.parquet").select("page_id", F.regexp_extract("url", r"://[^/?#]*([^?#]*)", 1).alias("path"))
    return publishing.drift(p.filter("page_id % 2 = 0"), p.filter("page_id % 2 = 1")).groupBy("state").agg(F.count("*").alias("n"), F.min("path").alias("first"))


def k02(spark: SparkSession, d: str) -> DataFrame:
    rows = publishing.request_rows(priced(spark, d))
    return rows.select("session_id", "request_id", "model_key", "tier", "fast", "cw5_tokens", "context_tokens", "usd_total", "unpriced", F.coalesce("stop_reason", F.lit("")).alias("stop_reason"))


def s13(spark: SparkSession, d: str) -> DataFrame:
    t = spark.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").alias("id"), "text")
    return publishing.numbers(t).groupBy("id").agg(F.count("*").alias("figures"), F.sum("n").alias("n"), F.max(F.length("figure")).alias("longest"))


def more_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "c26_retention": c26, "c28_denied": c28, "x29_needles": x29, "f12_unpriced": f12, "k02_export": k02, "k06_pending": lambda s, d: publishing.pending(changed(s, d), built(s, d)),
        "k07_orphans": lambda s, d: publishing.orphans(built(s, d), changed(s, d)), "k08_live": lambda s, d: publishing.live_rows(priced(s, d), facade.tools(s, d)),
        "o10_bars": o10, "s13_numbers": s13, "u06_drift": u06, "x31_slugs": x31,
    }


_built = "b AS (SELECT CASE WHEN user_id % 2 = 0 THEN user_id ELSE user_id + 1000000 END AS session_id, max(ts) AS built_at FROM ev WHERE event_id % 40 = 0 GROUP BY 1), ch AS (SELECT session_id, max(ts) AS changed_at FROM calls GROUP BY 1)"
_paths = r"pp AS (SELECT page_id, regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path FROM pages)"
_bars = lambda dim: f"""SELECT * FROM (SELECT '{dim}' AS dimension, CAST({dim} AS VARCHAR) AS name, CAST(sum(m_total) AS DOUBLE) / 1e6 AS usd, CAST(sum(m_total) AS DOUBLE) / (SELECT CAST(sum(m_total) AS DOUBLE) FROM priced) AS share
    FROM priced GROUP BY 2 ORDER BY sum(m_total) DESC, 2 LIMIT 8)"""  # noqa: E731
BODY |= {
    "c26_retention": f", s AS (SELECT session_id, count(*) AS n, sum(cache_read) AS b, max(epoch_us(ts)) < {_now} - 21600000000 AS goes FROM calls GROUP BY 1) SELECT count(*) FILTER (goes) AS go, count(*) FILTER (NOT goes) AS stay, CAST(coalesce(sum(n) FILTER (goes), 0) AS BIGINT) AS go_rows, CAST(coalesce(sum(b) FILTER (goes), 0) AS BIGINT) AS go_bytes, CAST(coalesce(sum(b) FILTER (NOT goes), 0) AS BIGINT) AS stay_bytes FROM s",
    "c28_denied": r""", t AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]{5,}')[1:2]) AS term FROM benchmark),
        w AS (SELECT doc_id AS id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS term FROM documents) SELECT id, term, count(*) AS n FROM w JOIN t USING (term) GROUP BY 1, 2""",
    "x29_needles": r""", t AS (SELECT doc_id AS id, lower('/home/' || coalesce(source, 'none') || '/x ' || coalesce(text, '') || ' ' || coalesce(lang, '') || '@host') AS t FROM documents),
        n AS (SELECT DISTINCT lower(needle) AS needle FROM (SELECT source AS needle FROM documents UNION ALL SELECT lang FROM documents UNION ALL SELECT regexp_extract(lower(text), '[a-z]+') FROM benchmark) WHERE length(needle) >= 2),
        o AS (SELECT id, t, needle, regexp_escape(needle) AS e FROM t JOIN n ON CASE WHEN length(needle) >= 5 THEN contains(t, needle)
            ELSE contains(t, '~' || needle) OR contains(t, 'home/' || needle) OR contains(t, 'home-' || needle) OR contains(t, 'users/' || needle) OR contains(t, 'users-' || needle) OR contains(t, needle || '@') END),
        c AS (SELECT id, needle, CASE WHEN length(needle) >= 5 THEN len(regexp_extract_all(t, '(?:^|[^\p{L}\p{N}_])' || e))
            ELSE len(regexp_extract_all(t, '(?:home[/-]|users[/-]|~)' || e || '(?:$|[^\p{L}\p{N}_])')) + len(regexp_extract_all(t, '(?:^|[^\p{L}\p{N}_])' || e || '@')) END AS n FROM o)
        SELECT id, needle, n FROM c WHERE n > 0""",
    "f12_unpriced": "SELECT model_key, count(*) AS calls, count(DISTINCT session_id) AS sessions, CAST(sum(total_tokens) AS BIGINT) AS total_tokens FROM priced WHERE unpriced GROUP BY 1",
    "k02_export": "SELECT CAST(session_id AS VARCHAR) AS session_id, CAST(request_id AS VARCHAR) AS request_id, model_key, tier, CAST(CAST(fast AS INTEGER) AS VARCHAR) AS fast, CAST(cw5_tokens AS VARCHAR) AS cw5_tokens, CAST(context_tokens AS VARCHAR) AS context_tokens, printf('%.10f', CAST(m_total AS DOUBLE) / 1e6) AS usd_total, CAST(CAST(unpriced AS INTEGER) AS VARCHAR) AS unpriced, '' AS stop_reason FROM priced",
    "k06_pending": f", {_built} SELECT session_id, changed_at FROM ch LEFT JOIN b USING (session_id) WHERE built_at IS NULL OR built_at < changed_at",
    "k07_orphans": f", {_built} SELECT DISTINCT session_id FROM b WHERE session_id NOT IN (SELECT session_id FROM ch)",
    "k08_live": """, l AS (SELECT *, max(epoch_us(ts)) OVER (PARTITION BY session_id) AS last_us FROM priced), o AS (SELECT session_id, CAST(sum(m_total) AS DOUBLE) / 1e6 AS usd, count(*) AS calls, max_by(model_key, (ts, request_id)) AS model_key, CAST(sum(m_total) FILTER (last_us - epoch_us(ts) <= 900000000) AS DOUBLE) / 1e6 AS burn_15m FROM l GROUP BY 1),
        e AS (SELECT session_id, name, row_number() OVER (PARTITION BY session_id ORDER BY count(*) DESC, name) AS r FROM tools GROUP BY 1, 2) SELECT o.*, e.name AS top_tool, usd * 4.0::DOUBLE AS budget_pct FROM o LEFT JOIN e ON e.session_id = o.session_id AND r = 1""",
    "o10_bars": _bars("model_key") + " UNION ALL " + _bars("session_id"),
    "s13_numbers": r""", f AS (SELECT doc_id AS id, unnest(regexp_extract_all(text, '[0-9]{1,3}(?:,[0-9]{3})+(?:\.[0-9]+)?|[0-9]+(?:\.[0-9]+)?')) AS f FROM documents), g AS (SELECT id, replace(f, ',', '') AS f, count(*) AS n FROM f GROUP BY 1, 2)
        SELECT id, count(*) AS figures, CAST(sum(n) AS BIGINT) AS n, CAST(max(length(f)) AS INTEGER) AS longest FROM g GROUP BY 1""",
    "u06_drift": f", {_paths}, a AS (SELECT DISTINCT path FROM pp WHERE page_id % 2 = 0), c AS (SELECT DISTINCT path FROM pp WHERE page_id % 2 = 1), x AS (SELECT path, 'extra' AS state FROM a WHERE path NOT IN (SELECT path FROM c) UNION ALL SELECT path, 'missing' FROM c WHERE path NOT IN (SELECT path FROM a)) SELECT state, count(*) AS n, min(path) AS first FROM x GROUP BY 1",
    "x31_slugs": f", {_paths} SELECT page_id, translate(path, '/._', '---') AS slug FROM pp",
}


def sql(facts: str) -> dict[str, str]:
    return {k: facts + v for k, v in BODY.items()}
