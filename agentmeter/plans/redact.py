"""Registered queries on redaction through maps, each with its SQL beside it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as X
from ..operators import figures, pricing, privacy, redaction
from ..operators.searchindex import scratch
from ..sources import facade
from .oracle import _address

TURNS = redaction.Mart(("ts",), {"turn": "turn_id"}, order=("ts", "turn_id"))
CALLS = redaction.Mart(("ts", "model", "origin", "agent_type", "context_tokens"), {"call": "request_id", "agent": "agent_id"}, order=("ts", "request_id"))
TOOLS = redaction.Mart(("ts", "name", "bytes", "is_error"), {"tooluse": "request_id", "agent": "agent_id"}, ("name", "path"), ("ts", "request_id"))
FORMS = {"turns": TURNS, "calls": CALLS, "tools": TOOLS}


def uuid_of(number: Column) -> Column:
    return F.regexp_replace(F.md5(number.cast("string")), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")


def session_keys(spark: SparkSession, d: str) -> DataFrame:
    e = facade.events(spark, d)
    return e.groupBy("user_id").agg(F.min("ts").alias("seen")).select(F.lit("session").alias("kind"), F.col("user_id").cast("string").alias("key"), "seen")


def kept_map(keys: DataFrame) -> DataFrame:
    """A map after two runs: the first sees every second session, the next all."""
    kept = redaction.PseudonymMap(keys.sparkSession, scratch(keys.sparkSession, "map"))
    kept.allocate(keys.filter(F.col("key").cast("bigint") % 2 == 0))
    return kept.allocate(keys)


def c14_map(spark: SparkSession, d: str) -> DataFrame:
    return kept_map(session_keys(spark, d))


def c14(spark: SparkSession, d: str) -> DataFrame:
    """Turns, calls and tool calls of every session as they are published."""
    calls = pricing.price(facade.calls(spark, d))
    agent = F.when(F.col("window") != "main", F.col("window"))
    marts = {"turns": facade.prompts(spark, d), "calls": calls, "tools": facade.tools(spark, d).withColumn("agent_id", agent)}
    out = redaction.redacted(marts, FORMS, c14_map(spark, d))
    null = lambda *cs: [F.lit(None).cast("string").alias(c) for c in cs]
    none, shape = F.lit(None).cast("bigint"), ["target", "target_kind", "target_ext", "target_argv0"]
    t = out["turns"].select(F.lit("turn").alias("mart"), "session", F.col("turn").alias("name"), *null("agent", *shape), none.alias("figure"))
    c = out["calls"].select(F.lit("call").alias("mart"), "session", F.col("call").alias("name"), "agent", *null(*shape), F.col("context_tokens").cast("bigint").alias("figure"))
    u = out["tools"].select(F.lit("tool").alias("mart"), "session", F.col("tooluse").alias("name"), "agent", *shape, F.col("bytes").cast("bigint").alias("figure"))
    return t.unionByName(c).unionByName(u)


def c15(spark: SparkSession, d: str) -> DataFrame:
    """Every pseudonym in capitals, and the first two and four signs of every session's key, asked of the map."""
    e = facade.events(spark, d).groupBy("user_id").agg(F.min("ts").alias("seen"))
    keys = e.select(F.lit("session").alias("kind"), uuid_of(F.col("user_id")).alias("key"), "seen")
    names = redaction.scratch_table(redaction.allocated(spark.createDataFrame([], redaction.MAP), keys), "map")
    asked = names.select(F.explode(F.array(F.upper("pseudonym"), F.substring("key", 1, 2), F.substring("key", 1, 4))).alias("asked"))
    return redaction.who_is(names, asked)


def c13(spark: SparkSession, d: str) -> DataFrame:
    """Documents between a project's folder, a session, an address, a branch and a ticket: by the names of a map."""
    t = spark.read.parquet(f"{d}/documents.parquet").withColumn("repo", F.concat(F.lit("repo-"), F.coalesce("source", F.lit("none"))))
    lines = [
        F.lit("cd /srv/"), "repo", F.lit("/src; ls -srv-"), "repo", F.lit("-x "), uuid_of(F.col("doc_id") % 200), F.lit(" u"), F.col("doc_id") % 50,
        F.lit("@host.org /home/someone/"), "repo", F.lit(" feature/abc-1 ABC-12 claude-new-7 utf-8 secondary-2 10.0.0.7\n"), F.coalesce("text", F.lit("")),
    ]
    texts = t.select(F.col("doc_id").alias("id"), F.concat(*lines).alias("text"))
    slug = F.concat(F.lit("-srv-"), "repo")
    projects = t.groupBy(F.lit("project").alias("kind"), slug.alias("key")).agg(F.lit(0).cast("bigint").alias("seen"))
    sessions = t.filter("doc_id % 200 % 2 = 1").groupBy(F.lit("session").alias("kind"), uuid_of(F.col("doc_id") % 200).alias("key")).agg(F.min(F.col("doc_id") % 200).cast("bigint").alias("seen"))
    names = redaction.scratch_table(redaction.allocated(spark.createDataFrame([], redaction.MAP), projects.unionByName(sessions)), "map")
    shown = t.select(slug.alias("key"), F.concat(F.lit("/srv/"), "repo").alias("display")).distinct()
    labels = t.select((F.col("doc_id") % 50).alias("n")).distinct().filter("n < 10").select(F.concat(F.lit("U"), "n", F.lit("@host.org")).alias("address"), F.concat(F.lit("l"), "n").alias("label"))
    out = redaction.scrub(texts, names, shown, labels)
    return out.select("id", F.length("text").alias("chars"), F.md5("text").alias("digest"))


def x15(spark: SparkSession, d: str) -> DataFrame:
    """Paths of pages as targets of tools, and commands on them."""
    p = spark.read.parquet(f"{d}/pages.parquet").select("page_id", F.coalesce(F.regexp_extract("url", r"://[^/?#]*([^?#]*)", 1), F.lit("")).alias("path"))
    i = F.col("page_id")
    tool = F.element_at(F.array(*[F.lit(x) for x in ("Read", "Bash", "Grep", "WebFetch", "Mine")]), (i % 5 + 1).cast("int"))
    program = F.element_at(F.array(*[F.lit(x) for x in ("/usr/bin/git", "python3", "secret")]), (i % 3 + 1).cast("int"))
    t = p.withColumn("tool", tool).withColumn("target", F.when(F.col("tool") == "Bash", F.concat(F.lit("cd /x && "), program, F.lit(" "), "path")).otherwise(F.col("path")))
    t = t.withColumn("kind", redaction.target_kind(F.col("tool"), F.col("target")))
    label = redaction.target_label(F.col("kind"), F.lit("n"), redaction.target_ending(F.col("target")), redaction.target_depth(F.col("target")), X.first_program(F.col("target")))
    return t.select("page_id", "kind", redaction.target_shape(F.col("tool"), F.col("target")).alias("shape"), label.alias("label"))


def reported(spark: SparkSession, d: str) -> DataFrame:
    """Every document with a line on what it cost, and on its length."""
    t, i = spark.read.parquet(f"{d}/documents.parquet"), F.col("doc_id")
    line = F.concat(F.lit("\nspent $"), i + 1, F.lit(".25 on "), F.length(F.coalesce("text", F.lit(""))), F.lit(" tokens, "), i % 100, F.lit("% of it; measured\n$3/Mtok"))
    return t.select(i.alias("id"), F.concat(F.coalesce("text", F.lit("")), line).alias("text"))


def c17(spark: SparkSession, d: str) -> DataFrame:
    allowed = spark.createDataFrame([("aggregate", "2000 tokens", "a limit")], "rule string, sample string, reason string")
    return figures.findings(reported(spark, d), allowed)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"c13_maps": c13, "c14_map": c14_map, "c14_marts": c14, "c15_whois": c15, "x15_targets": x15, "c17_figures": c17}


_MAP = """mp AS (SELECT CAST(user_id AS VARCHAR) AS key, row_number() OVER (ORDER BY user_id % 2, s, CAST(user_id AS VARCHAR)) AS ordinal FROM (SELECT user_id, min(ts) AS s FROM ev GROUP BY 1)),
    mq AS (SELECT key, ordinal, printf('session_%02d', ordinal) AS pseudonym FROM mp)"""
_uuid = lambda n: f"regexp_replace(md5(CAST({n} AS VARCHAR)), '^(.{{8}})(.{{4}})(.{{4}})(.{{4}})(.{{12}})$', '\\1-\\2-\\3-\\4-\\5')"
#: A text's own addresses, hashed as they are found; an IP address is a whole run of digits and points.
_own = f"array_to_string(list_transform(list_zip(string_split_regex(text, '{privacy.EMAIL}'), regexp_extract_all(text, '{privacy.EMAIL}')), lambda x: x[1] || coalesce('<email-' || left(sha256('email:' || x[2]), 8) || '>', '')), '')"
for _ in range(2):
    _own = f"regexp_replace({_own}, '(^|[^0-9.]){_address}($|[^0-9.])', '\\1<ip>\\3', 'g')"
BODY = {
    "c14_map": f", {_MAP} SELECT 'session' AS kind, key, ordinal, pseudonym FROM mq",
    "c14_marts": f""", {_MAP}, tu AS (SELECT *, CASE WHEN win <> 'main' THEN win END AS agent_id FROM tools),
        sg AS (SELECT session_id, 'turn' AS kind, CAST(turn_id AS VARCHAR) AS key, NULL AS tool, 0 AS m, ts, turn_id AS i FROM prompts UNION ALL SELECT session_id, 'call', CAST(request_id AS VARCHAR), NULL, 1, ts, request_id FROM calls
          UNION ALL SELECT session_id, 'agent', agent_id, NULL, 1, ts, request_id FROM calls WHERE agent_id IS NOT NULL UNION ALL SELECT session_id, 'tooluse', CAST(request_id AS VARCHAR), NULL, 2, ts, request_id FROM tu
          UNION ALL SELECT session_id, 'agent', agent_id, NULL, 2, ts, request_id FROM tu WHERE agent_id IS NOT NULL UNION ALL SELECT session_id, 'target', path, name, 2, ts, request_id FROM tu),
        f1 AS (SELECT session_id, kind, key, min((m, ts, i)) AS f, arg_min(tool, (m, ts, i)) AS tool FROM sg GROUP BY 1, 2, 3),
        f2 AS (SELECT *, CASE WHEN kind = 'target' THEN CASE WHEN tool = 'Bash' THEN 'command' ELSE 'file' END END AS form FROM f1), f3 AS (SELECT *, CASE form WHEN 'file' THEN 'path' WHEN 'command' THEN 'cmd' ELSE kind END AS p FROM f2),
        nm AS (SELECT session_id, kind, key, form, p || CASE WHEN kind IN ('call', 'tooluse') THEN printf('_%04d', r) ELSE printf('_%02d', r) END AS name FROM (SELECT *, row_number() OVER (PARTITION BY session_id, p ORDER BY f, key) AS r FROM f3)),
        x AS (SELECT 'turn' AS mart, session_id, 'turn' AS kind, CAST(turn_id AS VARCHAR) AS key, NULL AS agent_id, NULL AS path, NULL AS figure FROM prompts UNION ALL SELECT 'call', session_id, 'call', CAST(request_id AS VARCHAR), agent_id, NULL, context_tokens FROM priced
          UNION ALL SELECT 'tool', session_id, 'tooluse', CAST(request_id AS VARCHAR), agent_id, path, bytes FROM tu)
        SELECT mart, pseudonym AS session, n.name, a.name AS agent, t.name AS target, t.form AS target_kind, CASE WHEN t.form = 'file' THEN '' END AS target_ext, CASE WHEN t.form = 'command' THEN 'other' END AS target_argv0, CAST(figure AS BIGINT) AS figure
        FROM x JOIN mq ON mq.key = CAST(x.session_id AS VARCHAR) JOIN nm n ON n.session_id = x.session_id AND n.kind = x.kind AND n.key = x.key
        LEFT JOIN nm a ON a.session_id = x.session_id AND a.kind = 'agent' AND a.key = x.agent_id LEFT JOIN nm t ON t.session_id = x.session_id AND t.kind = 'target' AND t.key = x.path""",
    "c15_whois": f""", k AS (SELECT {_uuid('user_id')} AS key, min(ts) AS s FROM ev GROUP BY user_id), n AS (SELECT key, printf('session_%02d', row_number() OVER (ORDER BY s, key)) AS pseudonym FROM k),
        a AS (SELECT DISTINCT left(key, l) AS asked FROM n, (VALUES (2), (4)) AS v(l))
        SELECT upper(pseudonym) AS asked, 'session' AS kind, key, pseudonym FROM n UNION ALL SELECT asked, 'session', min(key), min(pseudonym) FROM a JOIN n ON starts_with(key, asked) GROUP BY 1 HAVING count(*) = 1""",
    "c13_maps": f""", t AS (SELECT doc_id, 'repo-' || coalesce(source, 'none') AS repo, {_own} AS text FROM (SELECT doc_id, source, coalesce(text, '') AS text FROM documents)),
        p AS (SELECT repo, printf('project_%02d', row_number() OVER (ORDER BY '-srv-' || repo)) AS project FROM (SELECT DISTINCT repo FROM t)),
        s AS (SELECT n, printf('session_%02d', row_number() OVER (ORDER BY n, u)) AS session FROM (SELECT DISTINCT doc_id % 200 AS n, {_uuid('doc_id % 200')} AS u FROM documents WHERE doc_id % 200 % 2 = 1)),
        o AS (SELECT doc_id AS id, 'cd ' || project || '/src; ls ' || project || '-x ' || coalesce(session, '<id-' || left(sha256('id:' || {_uuid('doc_id % 200')}), 8) || '>') || ' ' ||
        CASE WHEN doc_id % 50 < 10 THEN '<account:l' || (doc_id % 50) || '>' ELSE '<email-' || left(sha256('email:u' || (doc_id % 50) || '@host.org'), 8) || '>' END ||
        ' /home/<user>/' || project || ' <branch> <ticket> claude-new-7 utf-8 secondary-2 <ip>' || chr(10) || text AS t FROM t JOIN p USING (repo) LEFT JOIN s ON s.n = doc_id % 200)
        SELECT id, CAST(length(t) AS INTEGER) AS chars, md5(t) AS digest FROM o""",
    "x15_targets": r""", p AS (SELECT page_id, ['Read', 'Bash', 'Grep', 'WebFetch', 'Mine'][page_id % 5 + 1] AS tool, coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path, ['git', 'python3', 'other'][page_id % 3 + 1] AS program FROM pages),
        k AS (SELECT *, CASE tool WHEN 'Read' THEN 'file' WHEN 'Bash' THEN 'command' WHEN 'Grep' THEN 'search' WHEN 'WebFetch' THEN 'web' ELSE CASE WHEN starts_with(path, '/') THEN 'file' ELSE 'other' END END AS kind,
        lower(regexp_extract(regexp_extract(path, '([^/]*)/*$', 1), '[^/.][^/]*(\.[A-Za-z0-9]{1,8})$', 1)) AS ext, len(list_filter(string_split(path, '/'), lambda x: x <> '' AND x <> '.')) AS depth FROM p)
        SELECT page_id, kind, CASE kind WHEN 'file' THEN CASE WHEN ext <> '' THEN 'a ' || ext || ' file' ELSE 'a file' END WHEN 'command' THEN CASE WHEN program <> 'other' THEN 'a `' || program || '` command' ELSE 'a shell command' END
        WHEN 'search' THEN 'a code search' WHEN 'web' THEN 'a web fetch' ELSE 'a target' END AS shape,
        CASE kind WHEN 'file' THEN CASE WHEN ext = '' THEN 'no ext' ELSE ext END || ' file, depth ' || depth || ' (n)' WHEN 'command' THEN program || ' command (n)' ELSE kind || ' (n)' END AS label FROM k""",
}


def sql(facts: str) -> dict[str, str]:
    return {k: facts + v for k, v in BODY.items()}
