"""Windows and time series over requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ORDER = ("ts", "request_id")


def micros(ts: Column | None = None) -> Column:
    """Microseconds of a time with or without zone (the session's zone is UTC)."""
    return F.unix_micros((F.col("ts") if ts is None else ts).cast("timestamp"))


def cumulative(c: DataFrame) -> DataFrame:
    w = Window.partitionBy("session_id").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, 0)
    return c.select("session_id", "request_id", (F.sum("m_total").over(w).cast("double") / 1e6).alias("cum_usd"))


def thinned(c: DataFrame, points: int = 2000) -> DataFrame:
    """The cumulative series: whole up to so many points, else the last point of each bucket of the session's time."""
    s = Window.partitionBy("session_id")
    t = micros()
    w = s.orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, 0)
    d = c.select("session_id", "request_id", "ts", t.alias("t"), F.sum("m_total").over(w).alias("cum"), F.row_number().over(s.orderBy(*ORDER)).alias("i"))
    d = d.withColumns({"n": F.count("*").over(s), "t0": F.min("t").over(s), "span": F.max("t").over(s) - F.min("t").over(s)})
    bucket = F.when(F.col("n") <= points, F.col("i") - 1).otherwise(F.expr(f"coalesce((t - t0) * {points - 1} div nullif(span, 0), 0)"))
    return d.groupBy("session_id", bucket.alias("bucket")).agg(F.max("t").alias("t"), (F.max("cum").cast("double") / 1e6).alias("cum_usd"))


def growth(c: DataFrame, turns: DataFrame) -> DataFrame:
    """Steps of the main context from turn end to turn end: median of the rises, falls, great falls."""
    main = asof_turn(c.filter("origin = 'main'"), turns)
    ends = main.groupBy("session_id", "turn_id").agg(F.max_by("context_tokens", F.struct(*ORDER)).alias("ctx"), F.max(F.struct(*ORDER)).alias("at"))
    step = F.col("ctx") - F.lag("ctx").over(Window.partitionBy("session_id").orderBy("at"))
    ends = ends.withColumn("step", step).withColumn("before", F.col("ctx") - F.col("step"))
    rise = F.when(F.col("step") > 0, F.col("step"))
    return ends.groupBy("session_id").agg(F.percentile(rise, 0.5).alias("median_rise"), F.count_if(F.expr("step < 0")).alias("resets"), F.count_if(F.expr("step < -0.25 * before")).alias("major_resets"))


def asof_turn(c: DataFrame, turns: DataFrame) -> DataFrame:
    """Each request with the latest turn that started at or before it: a union and a running last."""
    both = c.withColumn("_turn", F.lit(None).cast("bigint")).withColumn("_is", F.lit(1)).unionByName(turns.select("session_id", "ts", F.col("turn_id").alias("_turn"), F.lit(0).alias("_is")), allowMissingColumns=True)
    w = Window.partitionBy("session_id").orderBy("ts", "_is", "_turn", "request_id").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("turn_id", F.last("_turn", ignorenulls=True).over(w)).filter("_is = 1").drop("_turn", "_is")


def by_turn(c: DataFrame, turns: DataFrame) -> DataFrame:
    t = asof_turn(c, turns)
    return t.groupBy("session_id", F.coalesce("turn_id", F.lit(-1)).alias("turn_id")).agg(F.count("*").alias("calls"), F.count_if(F.col("origin") != "main").alias("side_calls"), (F.sum("m_total").cast("double") / 1e6).alias("usd_total"))


def runs(c: DataFrame, gap_s: int = 600) -> DataFrame:
    """Stretches of a session without a gap above gap_s."""
    w = Window.partitionBy("session_id").orderBy(*ORDER)
    new = F.coalesce((micros() - micros(F.lag("ts").over(w)) > gap_s * 1_000_000).cast("int"), F.lit(1))
    d = c.withColumn("new", new).withColumn("run", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return d.groupBy("session_id", "run").agg(F.count("*").alias("calls"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def days(c: DataFrame) -> DataFrame:
    """Spend of every day between the first and the last, zero where there is none, and of seven days back."""
    d = c.groupBy(F.to_date("ts").alias("day")).agg(F.sum("m_total").alias("m"))
    all_ = d.agg(F.min("day").alias("a"), F.max("day").alias("b")).select(F.explode(F.sequence("a", "b")).alias("day"))
    full = all_.join(d, "day", "left").withColumn("m", F.coalesce("m", F.lit(0).cast("decimal(38,5)")))
    # a row a day: small enough for one task at any size of c
    w = Window.orderBy(F.unix_date("day")).rangeBetween(-6, 0)
    return full.select(F.col("day").cast("string").alias("day"), (F.col("m").cast("double") / 1e6).alias("usd"), (F.sum("m").over(w).cast("double") / 1e6).alias("usd_7d"))


def contexts(c: DataFrame, windows: DataFrame, default: int = 200_000) -> DataFrame:
    """The main context at each request, and what share of its model's window it is. windows: model_key, max_tokens."""
    m = c.filter("origin = 'main'").join(F.broadcast(windows), "model_key", "left").withColumn("max_tokens", F.coalesce("max_tokens", F.lit(default)).cast("bigint"))
    return m.select("session_id", "request_id", "context_tokens", "max_tokens", (F.floor(10000.0 * F.col("context_tokens") / F.col("max_tokens") + 0.5) / 100.0).alias("pct"))


def top_calls(c: DataFrame, k: int = 3) -> DataFrame:
    w = Window.partitionBy("session_id").orderBy(F.desc("m_total"), "request_id")
    return c.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("session_id", "rank", "request_id", (F.col("m_total").cast("double") / 1e6).alias("usd_total"))


def capped(t: DataFrame, per_path: int = 3, k: int = 8) -> DataFrame:
    """The largest tool results of a session, at most per_path of one path."""
    a = Window.partitionBy("session_id", "path").orderBy(F.desc("bytes"), "request_id")
    b = Window.partitionBy("session_id").orderBy(F.desc("bytes"), "request_id")
    t = t.withColumn("r", F.row_number().over(a)).filter(F.col("r") <= per_path)
    return t.withColumn("rank", F.row_number().over(b)).filter(F.col("rank") <= k).select("session_id", "rank", "path", "request_id", "bytes")


def burn(c: DataFrame, back_s: int = 900) -> DataFrame:
    """Spend of the last quarter hour at each request."""
    w = Window.partitionBy("session_id").orderBy(F.unix_seconds(F.col("ts").cast("timestamp"))).rangeBetween(-back_s, 0)
    return c.select("session_id", "request_id", (F.sum("m_total").over(w).cast("double") / 1e6).alias("usd_15m"))


def pseudonyms(c: DataFrame, key: str) -> DataFrame:
    """Names by order of first sight within each session."""
    g = c.filter(F.col(key).isNotNull()).groupBy("session_id", key).agg(F.min(F.struct(*ORDER)).alias("first"))
    n = F.row_number().over(Window.partitionBy("session_id").orderBy("first"))
    return g.select("session_id", key, F.concat(F.lit("n"), n).alias("pseudonym"))
