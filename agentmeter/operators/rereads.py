"""Reads classified per context window, with what they go on costing.

An epoch is a window in a generation: the number of compactions of the main window at or before a
row, 0 in other windows. Carry: requests of the same epoch strictly after the read. Failed reads
and writes count for nothing. Reasons, the first that holds: first (of the path in the session);
post_compact (the epoch has not held the path, main has, before a compaction); subagent (the epoch
has not held it otherwise); new_range (lines that the epoch's reads do not cover); changed (written
after the epoch's last read); avoidable.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The tools that change a file; lines that a read without a limit asks for.
MUTATING = ("Edit", "Write", "MultiEdit", "NotebookEdit")
DEFAULT_LINES = 2000
#: Fixed value: USD to carry a thousand tokens, as calibrated upstream.
CARRY_USD_PER_1K = 0.126


def with_generation(rows: DataFrame, marks: DataFrame, window: str = "window") -> DataFrame:
    """rows plus gen: marks at or before ts in the main window, 0 elsewhere."""
    both = rows.withColumn("_m", F.lit(0)).unionByName(marks.select("session_id", "ts", F.lit("main").alias(window), F.lit(1).alias("_m")), allowMissingColumns=True)
    w = Window.partitionBy("session_id", window).orderBy("ts").rangeBetween(Window.unboundedPreceding, 0)
    return both.withColumn("gen", F.sum("_m").over(w)).filter("_m = 0").drop("_m")


def carry(reads: DataFrame, calls: DataFrame) -> DataFrame:
    """reads plus carry_requests; both have session_id, window, gen, ts."""
    both = reads.withColumn("_c", F.lit(0)).unionByName(calls.select("session_id", "window", "gen", "ts", F.lit(1).alias("_c")), allowMissingColumns=True)
    w = Window.partitionBy("session_id", "window", "gen")
    upto = F.sum("_c").over(w.orderBy("ts").rangeBetween(Window.unboundedPreceding, 0))
    return both.withColumn("carry_requests", F.sum("_c").over(w) - upto).filter("_c = 0").drop("_c")


def with_cover(reads: DataFrame, key: list[str]) -> DataFrame:
    """reads plus covered: the lines of [lo, hi] that earlier rows of the same key hold.

    A key's reads are folded once, in order, over the merged spans so far: the state grows with
    the gaps between spans, not with the reads.
    """
    rest = [c for c in reads.columns if c not in key]
    own = F.sort_array(F.collect_list(F.struct("ts", "request_id", *[c for c in rest if c not in ("ts", "request_id")])))
    touch = "y.hi >= x.lo - 1 and y.lo <= x.hi + 1"
    lo = f"array_min(array_append(transform(filter(s.held, y -> {touch}), y -> y.lo), x.lo))"
    hi = f"array_max(array_append(transform(filter(s.held, y -> {touch}), y -> y.hi), x.hi))"
    held = f"array_append(filter(s.held, y -> not ({touch})), named_struct('lo', {lo}, 'hi', {hi}))"
    lines = "aggregate(s.held, 0L, (n, y) -> n + greatest(0L, least(y.hi, x.hi) - greatest(y.lo, x.lo) + 1L))"
    start = "named_struct('held', cast(array() as array<struct<lo:bigint,hi:bigint>>), 'out', cast(array() as array<bigint>))"
    fold = f"aggregate(own, {start}, (s, x) -> named_struct('held', {held}, 'out', array_append(s.out, {lines})), s -> s.out)"
    g = reads.groupBy(*key).agg(own.alias("own")).withColumn("covered", F.expr(fold))
    return g.select(*key, F.explode(F.arrays_zip("own", "covered")).alias("x")).select(*key, *[F.col(f"x.own.{c}").alias(c) for c in rest], "x.covered")


def classify(tools: DataFrame, marks: DataFrame) -> DataFrame:
    """One row per read with gen and reason. tools: session_id, request_id, ts, name, path, window, lo, hi, bytes, is_error."""
    good = tools.filter(F.col("name").isin("Read", *MUTATING) & ~F.col("is_error") & F.col("path").isNotNull())
    span = {"lo": F.coalesce("lo", F.lit(1)).cast("bigint"), "hi": F.coalesce("hi", F.coalesce("lo", F.lit(1)) + DEFAULT_LINES - 1).cast("bigint")}
    t = with_generation(good, marks).withColumns(span)
    order, read = ("ts", "request_id"), F.col("name") == "Read"
    before = lambda *by: Window.partitionBy("session_id", *by, "path").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    t = t.withColumns({
        "_any": F.coalesce(F.max(read).over(before()), F.lit(False)), "_main": F.coalesce(F.max(read & (F.col("window") == "main")).over(before()), F.lit(False)),
        "_write": F.max(F.when(~read, F.col("ts"))).over(before()), "_read": F.max(F.when(read, F.col("ts"))).over(before("window", "gen")),
    })
    r = with_cover(t.filter(read).drop("name"), ["session_id", "window", "gen", "path"])
    reason = (
        F.when(~F.col("_any"), "first")
        .when(F.col("_read").isNull() & (F.col("window") == "main") & (F.col("gen") > 0) & F.col("_main"), "post_compact")
        .when(F.col("_read").isNull(), "subagent")
        .when(F.col("covered") <= F.col("hi") - F.col("lo"), "new_range").when(F.col("_write") > F.col("_read"), "changed").otherwise("avoidable")
    )
    return r.withColumn("reason", reason).select("session_id", "request_id", "ts", "window", "gen", "path", "lo", "hi", "bytes", "reason")


def priced(reads: DataFrame, rates: DataFrame) -> DataFrame:
    """reads (with carry_requests) plus tokens, carry_usd and calibrated_usd; rates: session_id, r_cw5, r_read of its primary model.

    A read is written to the cache once and read again by every request that carries it.
    """
    tokens = F.col("bytes") / 4
    r = reads.join(rates, "session_id", "left").withColumn("tokens", tokens)
    usd = F.col("tokens") * (F.col("r_cw5").cast("double") + F.col("carry_requests") * F.col("r_read").cast("double")) / 1e6
    return r.withColumn("carry_usd", usd).withColumn("calibrated_usd", F.col("tokens") * CARRY_USD_PER_1K / 1000).drop("r_cw5", "r_read")


def exact(usd: Column) -> Column:
    """The sum of prices of a read, which have twelve places at most, so that it does not depend on their order."""
    return F.sum(F.round(usd * 1e12).cast("bigint")) / 1e12


def summary(reads: DataFrame) -> DataFrame:
    """Reads, bytes and both prices by session, by reason and by path: one pass, the columns not grouped by are null."""
    g = reads.groupingSets([["session_id"], ["session_id", "reason"], ["session_id", "path"]], "session_id", "reason", "path")
    money = [exact(F.col(c)).alias(c) for c in ("carry_usd", "calibrated_usd")]
    return g.agg(F.count("*").alias("reads"), F.count_if(F.col("reason") != "first").alias("repeats"), F.sum("bytes").alias("bytes"), *money)


def corpus(reads: DataFrame) -> DataFrame:
    """Over all sessions, per path: reads, sessions, what repeats cost, the mean of first reads; ranked by repeat dollars, reads, path."""
    again = F.col("reason") != "first"
    g = reads.groupBy("path").agg(
        F.count("*").alias("reads"), F.count_if(again).alias("repeats"), F.countDistinct("session_id").alias("sessions"),
        F.coalesce(exact(F.when(again, F.col("calibrated_usd"))), F.lit(0.0)).alias("repeat_usd"), F.round(F.avg(F.when(~again, F.col("bytes"))), 6).alias("first_bytes"),
    )
    # a row a path: ranges are ranked in one window of as many rows as the corpus has distinct paths
    return g.withColumn("place", F.row_number().over(Window.orderBy(F.desc("repeat_usd"), F.desc("reads"), "path")))


def islands(reads: DataFrame) -> DataFrame:
    """Merged line ranges per session and path; ranges that touch are one."""
    w = Window.partitionBy("session_id", "path").orderBy("lo", "hi", "request_id")
    new = F.coalesce((F.col("lo") > F.max("hi").over(w.rowsBetween(Window.unboundedPreceding, -1)) + 1).cast("int"), F.lit(1))
    d = reads.withColumn("new", new).withColumn("island", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return d.groupBy("session_id", "path", "island").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.count("*").alias("reads"))
