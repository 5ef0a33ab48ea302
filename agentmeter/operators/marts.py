"""Roll-ups of priced requests and tool calls: one grouped pass each, session_id in every key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .pricing import usd
from .series import micros


def money() -> list[Column]:
    return [usd(f"m_{k}").alias(f"usd_{k}") for k in ("input", "output", "cw5", "cw1", "read", "search", "total")]


def tokens() -> list[Column]:
    return [F.sum(c).alias(c) for c in ("input_tokens", "output_tokens", "cw5_tokens", "cw1_tokens", "cache_read", "total_tokens")]


def totals(c: DataFrame) -> DataFrame:
    return c.groupBy("session_id").agg(F.count("*").alias("calls"), F.count_if("is_error").alias("errors"), F.count_if("unpriced").alias("unpriced"), F.count_if(F.col("origin") != "main").alias("side_calls"), F.max("context_tokens").alias("peak_context"), *tokens(), *money())


def by_model(c: DataFrame) -> DataFrame:
    return c.groupBy("session_id", "model").agg(F.count("*").alias("calls"), *tokens(), *money())


def by_origin(c: DataFrame) -> DataFrame:
    origin = F.when(F.col("origin") == "main", "main").otherwise(F.concat_ws(":", "origin", "agent_type"))
    return c.groupBy("session_id", origin.alias("origin")).agg(F.count("*").alias("calls"), F.countDistinct("agent_id").alias("agents"), F.array_join(F.sort_array(F.collect_set("model_key")), ",").alias("models"), usd("m_total").alias("usd_total"))


def by_tool(t: DataFrame) -> DataFrame:
    return t.groupBy("session_id", "name").agg(F.count("*").alias("uses"), F.count_if("is_error").alias("errors"), F.expr("sum(bytes) div count(*)").alias("avg_bytes"), F.max("bytes").alias("max_bytes"), F.expr("sum(duration_ms) div nullif(count(duration_ms), 0)").alias("avg_ms"))


def by_agent(c: DataFrame) -> DataFrame:
    return c.filter("origin <> 'main'").groupBy("session_id", "agent_id", "agent_type").agg(F.count("*").alias("calls"), usd("m_total").alias("usd_total"))


def by_agent_type(c: DataFrame) -> DataFrame:
    """Of agents, so the second grouping of two."""
    agents = c.filter("origin <> 'main'").groupBy("session_id", "agent_id", "agent_type").agg(F.sum("m_total").alias("m"))
    return agents.groupBy("session_id", "agent_type").agg(F.count("*").alias("agents"), (F.sum("m").cast("double") / 1e6).alias("usd_total"))


def cache(c: DataFrame) -> DataFrame:
    """Hit ratio; what cached tokens would have cost as input, less what reading them cost; what writing cost; the two against each other."""
    zero = F.lit(0).cast("decimal(24,4)")
    uncached = F.sum(F.coalesce(F.col("cache_read").cast("decimal(14,0)") * F.col("r_in"), zero)).cast("double") / 1e6
    read, all_ = F.sum("cache_read"), F.sum("context_tokens")
    reads, writes = F.sum("m_read").cast("double") / 1e6, (F.sum("m_cw5") + F.sum("m_cw1")).cast("double") / 1e6
    ratio = F.coalesce(read.cast("double") / F.nullif(all_, F.lit(0)), F.lit(0.0))
    return c.groupBy("session_id").agg(
        ratio.alias("hit_ratio"), uncached.alias("uncached_usd"), (uncached - reads).alias("saved_usd"), writes.alias("paid_usd"),
        reads.alias("read_usd"), (uncached - reads - writes).alias("net_usd"),
    )


def waste(c: DataFrame, t: DataFrame) -> DataFrame:
    bad = c.groupBy("session_id").agg(F.count_if("is_error").alias("failed_calls"), (F.sum(F.when(F.col("is_error"), F.col("m_total")).otherwise(F.lit(0).cast("decimal(28,5)"))).cast("double") / 1e6).alias("failed_usd"))
    tool = t.groupBy("session_id").agg((100.0 * F.count_if("is_error") / F.count("*")).alias("tool_error_pct"))
    return bad.join(tool, "session_id", "left")


def redundant(t: DataFrame, least: int = 2, top: int = 20) -> DataFrame:
    """The same tool on the same target again; wasted bytes are all but one's share; the top 20 a session."""
    g = t.groupBy("session_id", "name", "path").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"), F.countDistinct("window").alias("callers")).filter(F.col("n") >= least)
    g = g.withColumn("wasted_bytes", F.expr("bytes * (n - 1) div n"))
    w = Window.partitionBy("session_id").orderBy(F.desc("wasted_bytes"), "name", "path")
    return g.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top)


def primary_model(c: DataFrame) -> DataFrame:
    g = c.groupBy("session_id", "model_key").agg(F.sum("m_total").alias("m"), F.min("request_id").alias("first"))
    return g.groupBy("session_id").agg(F.max_by("model_key", F.struct("m", -F.col("first"))).alias("primary_model"))


def bounds(c: DataFrame) -> DataFrame:
    return c.groupBy("session_id").agg(F.min("ts").alias("started_at"), F.max("ts").alias("last_activity"), (micros(F.max("ts")) - micros(F.min("ts"))).alias("wall_us"))


def daily(c: DataFrame, zone: str = "UTC") -> DataFrame:
    """One pass for all, by day and by model."""
    c = c.withColumn("day", F.to_date(F.from_utc_timestamp(F.col("ts").cast("timestamp"), zone)).cast("string"))
    g = c.groupingSets([[], ["day"], ["model_key"]], "day", "model_key")
    return g.agg(F.count("*").alias("calls"), F.sum("total_tokens").alias("total_tokens"), usd("m_total").alias("usd_total"))


def settled(c: DataFrame, headline: DataFrame) -> DataFrame:
    """Parts by model rescaled to a session's headline (micro-USD), what rounding leaves on the largest part."""
    g = c.groupBy("session_id", "model_key").agg(F.sum("m_total").alias("m")).join(headline, "session_id")
    w = Window.partitionBy("session_id")
    g = g.withColumn("all", F.sum("m").over(w)).withColumn("part", F.floor(F.col("m").cast("double") * F.col("headline") / F.nullif(F.col("all").cast("double"), F.lit(0.0))))
    g = g.withColumn("part", F.coalesce("part", F.lit(0)))
    first = F.row_number().over(w.orderBy(F.desc("m"), "model_key")) == 1
    left = F.col("headline") - F.sum("part").over(w)
    return g.withColumn("part", F.col("part") + F.when(first, left).otherwise(0)).select("session_id", "model_key", "headline", "part")
