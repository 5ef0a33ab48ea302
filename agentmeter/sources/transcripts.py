"""Transcript trees to facts: lines, requests, tool calls.

Layout: <root>/<project>/<session>.jsonl and <session>/subagents/**/agent-*.jsonl. A line that is
no JSON is counted and skipped; any field may have the wrong type.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import whole


def raw_lines(spark: SparkSession, root: str) -> DataFrame:
    """file, ord, project, session_id, origin, agent_id, workflow_id, kind, bad, v, chars of every line of 12 characters or more."""
    lines = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.jsonl").text(root)
    path = F.col("_metadata.file_path")
    lines = lines.select("value", path.alias("file"), F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row")).alias("ord"))
    agent = F.nullif(F.regexp_extract("file", r"/agent-([^/]+)\.jsonl$", 1), F.lit(""))
    flow = F.nullif(F.regexp_extract("file", r"/(wf_[^/]+)/agent-", 1), F.lit(""))
    main = r"/([^/]+)/([^/]+)\.jsonl$"
    side = r"/([^/]+)/([^/]+)/subagents/"
    pick = lambda i: F.when(agent.isNull(), F.regexp_extract("file", main, i)).otherwise(F.regexp_extract("file", side, i))
    v = F.try_parse_json("value")
    out = lines.filter(F.length("value") >= 11).withColumn("v", v)
    return out.select(
        "file", "ord", pick(1).alias("project"), pick(2).alias("session_id"), F.when(agent.isNull(), "main").when(flow.isNotNull(), "workflow").otherwise("subagent").alias("origin"),
        agent.alias("agent_id"), flow.alias("workflow_id"), F.try_variant_get("v", "$.type", "string").alias("kind"), F.col("v").isNull().alias("bad"), "v", (F.length("value") + 1).alias("chars"),
    )


def field(path: str, kind: str = "string") -> Column:
    return F.try_variant_get("v", path, kind)


def snapshots(lines: DataFrame) -> DataFrame:
    """Assistant lines with the fields of a request, and the prompt carried forward in their file."""
    own = field("$.promptId")
    w = Window.partitionBy("file").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    carried = F.last(F.when(F.col("kind") == "user", own), ignorenulls=True).over(w)
    u = "$.message.usage."
    a = lines.withColumn("prompt_id", F.coalesce(own, carried)).filter((F.col("kind") == "assistant") | (F.col("kind").isNull() & ~F.col("bad") & (field("$.message.role") == "assistant")))
    rid = F.coalesce(F.nullif(field("$.requestId"), F.lit("")), F.concat(F.lit("uuid:"), field("$.uuid")))
    return a.select(
        "session_id", rid.alias("request_id"), "file", "ord", "origin", "agent_id", "workflow_id", "prompt_id", F.try_to_timestamp(field("$.timestamp")).alias("ts"),
        field("$.message.model").alias("model"), F.coalesce(field(u + "speed") == "fast", F.lit(False)).alias("fast"), field(u + "inference_geo").alias("geo"),
        whole(field(u + "input_tokens", "bigint")).alias("input_tokens"), whole(field(u + "output_tokens", "bigint")).alias("output_tokens"),
        whole(field(u + "cache_creation_input_tokens", "bigint")).alias("cw_total"), whole(field(u + "cache_creation.ephemeral_1h_input_tokens", "bigint")).alias("cw_hour"),
        whole(field(u + "cache_read_input_tokens", "bigint")).alias("cache_read"), whole(field(u + "server_tool_use.web_search_requests", "bigint")).alias("searches"),
        F.coalesce(field("$.isApiErrorMessage", "boolean"), F.lit(False)).alias("is_error"), F.try_variant_get("v", "$.message.content", "array<variant>").alias("content"),
    )


USAGE = ("model", "fast", "geo", "input_tokens", "output_tokens", "cw_total", "cw_hour", "cache_read", "searches")


def assemble(snaps: DataFrame, order: tuple[str, ...] = ("file", "ord")) -> DataFrame:
    """Snapshots of a request to one row: usage of the line with most output (the earlier on ties), the least ts, source and prompt of the first line."""
    place = F.struct(*order)
    keyed = snaps.withColumn("_place", place)
    first = [c for c in ("origin", "agent_id", "workflow_id", "prompt_id") if c in snaps.columns]
    ranks = Window.partitionBy("session_id", "request_id")
    keyed = keyed.withColumn("_best", F.row_number().over(ranks.orderBy(F.desc("output_tokens"), "_place")) == 1).withColumn("_first", F.row_number().over(ranks.orderBy("_place")) == 1)
    pick = lambda c, flag: F.max(F.when(F.col(flag), F.col(c))).alias(c)
    return keyed.groupBy("session_id", "request_id").agg(*[pick(c, "_best") for c in USAGE], *[pick(c, "_first") for c in first], F.min("ts").alias("ts"), F.max("is_error").alias("is_error"), F.count("*").alias("lines"))


def tool_uses(snaps: DataFrame) -> DataFrame:
    """Tool blocks of a request over all its lines, once each by id (by name and place without one)."""
    b = snaps.select("session_id", "request_id", "file", "ord", "ts", F.posexplode("content").alias("pos", "b"))
    get = lambda p, t="string": F.try_variant_get("b", p, t)
    b = b.filter(get("$.type") == "tool_use").withColumn("tool_use_id", get("$.id")).withColumn("name", get("$.name"))
    key = F.coalesce("tool_use_id", F.concat_ws("#", "name", "pos"))
    first = F.row_number().over(Window.partitionBy("session_id", "request_id", key).orderBy("file", "ord", "pos"))
    b = b.withColumn("_n", first).filter("_n = 1")
    return b.select("session_id", "request_id", "ts", "tool_use_id", "name", get("$.input.file_path").alias("path"), get("$.input.offset", "bigint").alias("offset"), get("$.input.limit", "bigint").alias("limit"))


def tool_results(lines: DataFrame) -> DataFrame:
    """The last result of each tool use in reading order."""
    r = lines.filter("kind = 'user' and not bad").select("session_id", "file", "ord", "chars", F.explode(F.try_variant_get("v", "$.message.content", "array<variant>")).alias("b"))
    r = r.filter(F.try_variant_get("b", "$.type", "string") == "tool_result").withColumn("tool_use_id", F.try_variant_get("b", "$.tool_use_id", "string"))
    return r.groupBy("session_id", "tool_use_id").agg(F.max_by(F.struct(F.coalesce(F.try_variant_get("b", "$.is_error", "boolean"), F.lit(False)).alias("is_error"), F.col("chars").alias("bytes")), F.struct((F.col("file").contains("/subagents/")).alias("side"), "file", "ord")).alias("r")).select("session_id", "tool_use_id", "r.*")


def file_span(block: str = "v") -> Column:
    """What a read returned, from the line's toolUseResult.file: start, count, total; null where a number is missing or out of range."""
    get = lambda f: F.try_variant_get(block, f"$.toolUseResult.file.{f}", "bigint")
    start, n, total = get("startLine"), get("numLines"), get("totalLines")
    good = (start >= 1) & (n >= 0) & (total >= 0)
    return F.when(good, F.struct(start.alias("start"), n.alias("n"), total.alias("total")))


def target(name: Column, path: Column, command: Column, pattern: Column, url: Column) -> Column:
    """A tool's work fingerprint: its file, a command with white space squeezed (300 signs), what is looked for and where, else the address."""
    squeezed = F.substring(F.trim(F.regexp_replace(command, r"\s+", " ")), 1, 300)
    looked = F.concat(pattern, F.lit(" @ "), F.coalesce(path, F.lit("")))
    return F.when(name == "Bash", squeezed).when(name.isin("Grep", "Glob"), looked).otherwise(F.coalesce(path, pattern, url))


def tool_facts(uses: DataFrame, results: DataFrame, timings: DataFrame | None = None) -> DataFrame:
    """uses with the result of each and, where a journal has them, its time and size; one row a use.

    timings: session_id, tool_use_id, ord, duration_ms, result_bytes, is_error; the last event of a use counts.
    """
    key = ["session_id", "tool_use_id"]
    t = uses.join(results.withColumnRenamed("bytes", "result_bytes"), key, "left").withColumn("is_error", F.coalesce("is_error", F.lit(False)))
    if timings is None:
        return t.withColumn("duration_ms", F.lit(None).cast("bigint"))
    last = timings.groupBy(*key).agg(F.max_by(F.struct("duration_ms", "result_bytes", "is_error"), "ord").alias("j"))
    t = t.join(last, key, "left")
    own = t.withColumn("result_bytes", F.coalesce("result_bytes", "j.result_bytes")).withColumn("duration_ms", F.col("j.duration_ms"))
    return own.withColumn("is_error", F.col("is_error") | F.coalesce("j.is_error", F.lit(False))).drop("j")


def prompts(lines: DataFrame, limit: int = 220) -> DataFrame:
    """The turns of a session: real prompts of the main file, with a preview of their text.

    Real: of the main file, neither meta nor side chain, without a tool result, with text that is
    no output of a local command. A slash command is shown as its name and arguments.
    """
    content = F.try_variant_get("v", "$.message.content", "array<variant>")
    blocks = F.transform(F.coalesce(content, F.expr("cast(array() as array<variant>)")), lambda b: F.try_variant_get(b, "$.text", "string"))
    kinds = F.transform(F.coalesce(content, F.expr("cast(array() as array<variant>)")), lambda b: F.try_variant_get(b, "$.type", "string"))
    text = F.coalesce(F.when(content.isNull(), field("$.message.content")), F.array_join(blocks, " "))
    name, args = F.regexp_extract(text, r"<command-name>\s*([^<]*?)\s*</command-name>", 1), F.regexp_extract(text, r"(?s)<command-args>\s*(.*?)\s*</command-args>", 1)
    shown = F.when(name != "", F.trim(F.concat_ws(" ", name, args))).otherwise(text)
    preview = F.substring(F.trim(F.regexp_replace(shown, r"\s+", " ")), 1, limit)
    flag = lambda p: F.coalesce(field(p, "boolean"), F.lit(False))
    u = lines.filter("kind = 'user' and not bad and origin = 'main'").filter(~flag("$.isMeta") & ~flag("$.isSidechain"))
    u = u.withColumns({"kinds": kinds, "preview": preview, "raw": text, "prompt_id": field("$.promptId"), "ts": F.try_to_timestamp(field("$.timestamp"))})
    return u.filter("not array_contains(kinds, 'tool_result') and preview <> '' and not startswith(raw, '<local-command-stdout>')").select("session_id", "file", "ord", "ts", "prompt_id", "preview")


def with_turns(calls: DataFrame, turns: DataFrame) -> DataFrame:
    """calls with turn_ts: that of the last turn of their prompt id, else the latest that began at or before them."""
    by_id = turns.filter("prompt_id is not null").groupBy("session_id", "prompt_id").agg(F.max("ts").alias("_by_id"))
    c = calls.join(by_id, ["session_id", "prompt_id"], "left")
    both = c.withColumn("_t", F.lit(None).cast("timestamp")).withColumn("_is", F.lit(1)).unionByName(turns.select("session_id", "ts", F.col("ts").alias("_t"), F.lit(0).alias("_is")), allowMissingColumns=True)
    w = Window.partitionBy("session_id").orderBy("ts", "_is").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("turn_ts", F.coalesce("_by_id", F.last("_t", ignorenulls=True).over(w))).filter("_is = 1").drop("_t", "_is", "_by_id")


def compactions(lines: DataFrame, journal: DataFrame | None = None) -> DataFrame:
    """session_id, ts, trigger, pre_tokens, post_tokens: those of the transcripts, and of a journal what they lack.

    A journal row (same columns) is known if its session's transcript has the same tokens before.
    """
    get = lambda p, t: field(f"$.compactMetadata.{p}", t)
    own = lines.filter((F.col("kind") == "system") & (field("$.subtype") == "compact_boundary") & (F.col("origin") == "main"))
    own = own.select("session_id", F.try_to_timestamp(field("$.timestamp")).alias("ts"), F.coalesce(get("trigger", "string"), F.lit("auto")).alias("trigger"), get("preTokens", "bigint").alias("pre_tokens"), get("postTokens", "bigint").alias("post_tokens"))
    if journal is None:
        return own
    more = journal.join(own.select("session_id", "pre_tokens"), ["session_id", "pre_tokens"], "left_anti")
    return own.unionByName(more.select(*own.columns))
