"""Rows of sessions: what a listing shows, spend of today and in flight, models and tools of each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .pricing import usd
from .series import ORDER, micros


def local_day(ts: Column, zone: str) -> Column:
    """The day of a UTC time in a zone, as text."""
    return F.to_date(F.from_utc_timestamp(ts.cast("timestamp"), zone)).cast("string")


def by_day(c: DataFrame, zone: str) -> DataFrame:
    """A session's spend by day of a zone."""
    day = local_day(F.col("ts"), zone)
    return c.groupBy("session_id", day.alias("day")).agg(F.count("*").alias("calls"), usd("m_total").alias("usd"))


def by_speed(c: DataFrame) -> DataFrame:
    """A session's spend by model and speed."""
    speed = F.when(F.col("fast"), "fast").otherwise("standard")
    return c.groupBy("session_id", "model_key", speed.alias("speed")).agg(F.count("*").alias("calls"), usd("m_total").alias("usd"))


def spend_now(c: DataFrame, now_us: int, zone: str, active_s: int = 300) -> DataFrame:
    """One row: spend of the day that now is in a zone, and of the sessions that were active in the last seconds."""
    last = c.groupBy("session_id").agg(F.max(micros()).alias("last_us"), F.sum("m_total").alias("m"))
    flight = last.filter(F.lit(now_us) - F.col("last_us") <= active_s * 1_000_000)
    today = c.filter(local_day(F.col("ts"), zone) == local_day(F.timestamp_micros(F.lit(now_us)), zone))
    zero = F.lit(0.0)
    a = today.agg(F.coalesce(usd("m_total"), zero).alias("today_usd"), F.countDistinct("session_id").alias("today_sessions"))
    b = flight.agg(F.coalesce(usd("m"), zero).alias("flight_usd"), F.count("*").alias("flight_sessions"))
    one = F.lit(1).alias("one")
    return a.select("*", one).join(b.select("*", one), "one").drop("one")


def models(c: DataFrame) -> DataFrame:
    """The model of a session's newest request, and the others it paid for, the dearest first."""
    now = c.groupBy("session_id").agg(F.max_by("model_key", F.struct(*ORDER)).alias("model_now"))
    each = c.groupBy("session_id", "model_key").agg(F.sum("m_total").alias("m")).filter("m > 0")
    other = each.join(now, "session_id").filter("model_key <> model_now")
    # a session has as many models as the catalog at most
    ranked = F.sort_array(F.collect_list(F.struct((-F.col("m")).alias("m"), "model_key")))
    names = F.transform(ranked, lambda x: x["model_key"])
    others = other.groupBy("session_id").agg(F.array_join(names, ",").alias("others"))
    return now.join(others, "session_id", "left").withColumn("others", F.coalesce("others", F.lit("")))


def top_tool(t: DataFrame) -> DataFrame:
    """How many tool calls a session made, of how many tools, and the one it used most."""
    each = t.groupBy("session_id", "name").agg(F.count("*").alias("n"))
    best = Window.partitionBy("session_id").orderBy(F.desc("n"), "name")
    top = each.withColumn("r", F.row_number().over(best))
    first = F.max(F.when(F.col("r") == 1, F.col("name")))
    return top.groupBy("session_id").agg(F.sum("n").alias("uses"), F.count("*").alias("tools"), first.alias("top_tool"))


def scan_rows(c: DataFrame, costs: DataFrame, windows: DataFrame) -> DataFrame:
    """The row of a session in a listing: bounds, calls, model, cost with its source, how full the newest main context is.

    costs: session_id, usd, source; windows: model_key, max_tokens.
    """
    main = F.when(F.col("origin") == "main", F.struct(*ORDER))
    own = c.groupBy("session_id").agg(
        F.min("ts").alias("started_at"), F.max("ts").alias("last_activity"), F.count("*").alias("calls"), F.sum("total_tokens").alias("total_tokens"),
        F.max_by(F.struct("model_key", "context_tokens"), main).alias("newest"),
    )
    own = own.select("*", F.col("newest.model_key").alias("model_key"), F.col("newest.context_tokens").alias("context_tokens")).drop("newest")
    own = own.join(F.broadcast(windows), "model_key", "left").join(costs.select("session_id", "usd", "source"), "session_id")
    full = F.floor(10000.0 * F.col("context_tokens") / F.coalesce("max_tokens", F.lit(200_000)) + 0.5) / 100.0
    return own.withColumn("context_pct", full).withColumn("estimate", F.col("source") != "reported").drop("max_tokens")


def listed(rows: DataFrame, now_us: int, active_s: int, n: int) -> DataFrame:
    """The first n sessions, active ones before others, newest first, with how many there are."""
    active = F.lit(now_us) - micros(F.col("last_activity")) <= active_s * 1_000_000
    found = rows.count()
    first = rows.withColumn("active", active).orderBy(F.desc("active"), F.desc("last_activity"), "session_id").limit(n)
    return first.withColumn("found", F.lit(found).cast("bigint"))


def heavy_share(t: DataFrame, last: int = 5, least: int = 8) -> DataFrame:
    """Of a session's newest agents the share that read much; sessions without agents have no row."""
    each = t.filter("window <> 'main'").groupBy("session_id", "window").agg(F.count_if(F.col("name") == "Read").alias("reads"), F.max("ts").alias("at"))
    newest = Window.partitionBy("session_id").orderBy(F.desc("at"), "window")
    each = each.withColumn("r", F.row_number().over(newest)).filter(F.col("r") <= last)
    return each.groupBy("session_id").agg(F.avg((F.col("reads") >= least).cast("double")).alias("heavy_share"), F.count("*").alias("agents"))


def retrieval_ratio(reads: DataFrame) -> DataFrame:
    """Tokens that reads brought against the tokens of the distinct files they came from, whole."""
    each = reads.groupBy("session_id", "path").agg(F.sum("bytes").alias("b"), F.max("file_bytes").alias("whole"))
    g = each.groupBy("session_id").agg(F.sum("b").alias("b"), F.sum("whole").alias("whole"), F.count("*").alias("files"))
    return g.select("session_id", "files", (F.col("b") / 4).alias("tokens"), (F.col("whole") / 4).alias("whole_tokens"), (F.col("b").cast("double") / F.nullif("whole", F.lit(0))).alias("ratio"))


def compaction_stats(marks: DataFrame, default: float = 0.025) -> DataFrame:
    """Per session: compactions, those that came by themselves, mean tokens before and after (a share of those before where unknown)."""
    after = F.coalesce(F.avg("post_tokens"), default * F.avg("pre_tokens"))
    return marks.groupBy("session_id").agg(F.count("*").alias("n"), F.count_if(F.col("trigger") == "auto").alias("auto"), F.avg("pre_tokens").alias("mean_pre"), after.alias("mean_post"))
