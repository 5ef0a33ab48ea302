"""What lies beside transcripts: files and their times, sidecars, workflow and event journals, owners, logins.

Any file may be torn or hold other types: what does not parse is left out, a field of a wrong type is null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

get = F.try_variant_get


def session_files(spark: SparkSession, root: str) -> DataFrame:
    """Per session: its files, their size, the newest change; a session's sub-agents count with it."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.jsonl").load(root).select("path", "length", "modificationTime")
    side = F.nullif(F.regexp_extract("path", r"/([^/]+)/subagents/", 1), F.lit(""))
    session = F.coalesce(side, F.regexp_extract("path", r"/([^/]+)\.jsonl$", 1))
    return f.groupBy(session.alias("session_id")).agg(F.count("*").alias("files"), F.sum("length").alias("bytes"), F.max("modificationTime").alias("changed_at"))


def _whole(spark: SparkSession, root: str, names: str) -> DataFrame:
    t = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", names).option("wholetext", True).text(root)
    return t.select(F.col("_metadata.file_path").alias("file"), F.try_parse_json("value").alias("v")).filter("v is not null")


def agent_metas(spark: SparkSession, root: str) -> DataFrame:
    """session_id, agent_id and what an agent's sidecar says of it."""
    m = _whole(spark, root, "agent-*.meta.json")
    return m.select(
        F.regexp_extract("file", r"/([^/]+)/subagents/", 1).alias("session_id"), F.regexp_extract("file", r"/agent-([^/]+)\.meta\.json$", 1).alias("agent_id"),
        get("v", "$.agentType", "string").alias("agent_type"), get("v", "$.description", "string").alias("description"),
        get("v", "$.spawnDepth", "int").alias("spawn_depth"), get("v", "$.toolUseId", "string").alias("tool_use_id"),
    )


def workflows(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """The header row of each workflow journal, and a row for each agent of its progress."""
    w = _whole(spark, root, "wf_*.json")
    key = [F.regexp_extract("file", r"/([^/]+)/workflows/", 1).alias("session_id"), F.regexp_extract("file", r"/(wf_[^/]+)\.json$", 1).alias("workflow_id")]
    head = w.select(
        *key, get("v", "$.workflowName", "string").alias("name"), get("v", "$.status", "string").alias("status"), get("v", "$.agentCount", "int").alias("agents"),
        get("v", "$.totalTokens", "bigint").alias("tokens"), get("v", "$.totalToolCalls", "bigint").alias("tool_calls"), get("v", "$.durationMs", "bigint").alias("duration_ms"),
        get("v", "$.summary", "string").alias("summary"), F.transform(get("v", "$.phases", "array<variant>"), lambda p: get(p, "$.title", "string")).alias("phases"),
    )
    steps = w.select(*key, F.posexplode(get("v", "$.workflowProgress", "array<variant>")).alias("step", "p")).filter(get("p", "$.type", "string") == "workflow_agent")
    steps = steps.select(
        "session_id", "workflow_id", "step", get("p", "$.agentId", "string").alias("agent_id"), get("p", "$.label", "string").alias("label"), get("p", "$.phaseTitle", "string").alias("phase"),
        get("p", "$.tokens", "bigint").alias("tokens"), get("p", "$.toolCalls", "bigint").alias("tool_calls"), get("p", "$.state", "string").alias("state"), get("p", "$.durationMs", "bigint").alias("duration_ms"),
    )
    return head, steps


def _lines(spark: SparkSession, root: str, names: str) -> DataFrame:
    t = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", names).text(root)
    t = t.select(F.col("_metadata.file_path").alias("file"), F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row")).alias("ord"), F.try_parse_json("value").alias("v"))
    return t.filter("v is not null")


def _first(*paths: str, kind: str = "bigint") -> Column:
    return F.coalesce(*[get("v", p, kind) for p in paths])


def tool_events(spark: SparkSession, root: str, names: str = "*.tools.ndjson") -> DataFrame:
    """The last event of each tool use in a session's journal, which is named like the session."""
    session = F.regexp_extract("file", r"/([^/.]+)\.[^/]*$", 1)
    e = _lines(spark, root, names).select(
        session.alias("session_id"), get("v", "$.tool_use_id", "string").alias("tool_use_id"), "ord",
        F.struct(_first("$.duration_ms").alias("duration_ms"), _first("$.is_error", kind="boolean").alias("is_error"), _first("$.result_bytes").alias("result_bytes")).alias("e"),
    )
    return e.filter("tool_use_id is not null").groupBy("session_id", "tool_use_id").agg(F.max("ord").alias("ord"), F.max_by("e", "ord").alias("e")).select("session_id", "tool_use_id", "ord", "e.*")


def compaction_journal(spark: SparkSession, root: str, names: str = "*.compactions.ndjson") -> DataFrame:
    """session_id, ts, trigger, pre_tokens, post_tokens, in either spelling of the fields."""
    session = F.regexp_extract("file", r"/([^/.]+)\.[^/]*$", 1)
    ts = F.coalesce(F.try_to_timestamp(get("v", "$.ts", "string")), F.try_to_timestamp(get("v", "$.timestamp", "string")))
    pre = _first("$.pre_tokens", "$.preTokens", "$.context_tokens")
    return _lines(spark, root, names).select(session.alias("session_id"), ts.alias("ts"), F.coalesce(get("v", "$.trigger", "string"), F.lit("auto")).alias("trigger"), pre.alias("pre_tokens"), _first("$.post_tokens", "$.postTokens").alias("post_tokens"))


def owners(lines: DataFrame) -> DataFrame:
    """The account that a session's first owner record names; lines as of transcripts.raw_lines."""
    o = lines.filter((F.col("kind") == "bridge-session") & (F.col("origin") == "main")).withColumn("account", get("v", "$.ownerAccountUuid", "string"))
    return o.filter("trim(account) <> ''").groupBy("session_id").agg(F.min_by(F.trim("account"), F.struct("file", "ord")).alias("account"))


def attestations(spark: SparkSession, root: str, names: str = "*.attestations.ndjson") -> DataFrame:
    """Logins seen: at, uuid, label, once each in the order of their times."""
    a = _lines(spark, root, names).select(F.try_to_timestamp(get("v", "$.at", "string")).alias("at"), get("v", "$.uuid", "string").alias("uuid"), get("v", "$.label", "string").alias("label"))
    return a.filter("at is not null and uuid is not null").distinct()


def head_and_tail(lines: DataFrame) -> DataFrame:
    """A file's first and last time and its counts of lines and of torn ones: what a listing shows before it is read."""
    ts = F.try_to_timestamp(get("v", "$.timestamp", "string"))
    return lines.groupBy("session_id", "file").agg(F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"), F.count("*").alias("lines"), F.count_if("bad").alias("torn"))


def stale(reads: DataFrame, index: DataFrame) -> DataFrame:
    """Reads of files that the index knows otherwise, with the reason (size, mtime): reads have path, size, mtime; index path, size, mtime."""
    i = index.select("path", F.col("size").alias("_size"), F.col("mtime").alias("_mtime"))
    reason = F.when(~F.col("size").eqNullSafe(F.col("_size")), "size").when(~F.col("mtime").eqNullSafe(F.col("_mtime")), "mtime")
    return reads.join(i, "path").withColumn("reason", reason).filter("reason is not null").drop("_size", "_mtime")


def fresh(reads: DataFrame, index: DataFrame) -> DataFrame:
    """Reads of files that the index knows and that have not changed since."""
    i = index.select("path", F.col("size").alias("_size"), F.col("mtime").alias("_mtime"))
    return reads.join(i, "path").filter("size <=> _size and mtime <=> _mtime").drop("_size", "_mtime")


def titled(chunks: DataFrame) -> DataFrame:
    """Chunks of a text with the heading they stand under: their own, else the last one before. chunks: id, lo, heading."""
    w = Window.partitionBy("id").orderBy("lo").rowsBetween(Window.unboundedPreceding, 0)
    return chunks.withColumn("heading", F.last("heading", ignorenulls=True).over(w))
