"""Residency epochs, replayed residency, alerts with a cool-down, retention."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .rereads import with_cover
from .series import ORDER, micros

#: Share of the context window from which an alert is chosen, the most urgent first.
LADDER = (("urgent", 0.85), ("warn", 0.75), ("nudge", 0.60))
#: Fixed value: prompts an alert stays silent after the 1st, 2nd, 3rd and each later time.
BACKOFF = (1, 2, 4, 8)


def epochs(events: DataFrame, quiet_s: int = 30) -> DataFrame:
    """events (session_id, ts, request_id, is_reset) with epoch; a reset within quiet_s of the one before opens none."""
    s = Window.partitionBy("session_id").orderBy(*ORDER)
    before = F.max(F.when(F.col("is_reset"), micros())).over(s.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.col("is_reset") & F.coalesce(micros() - before >= quiet_s * 1_000_000, F.lit(True))
    return events.withColumn("opens", opens).withColumn("epoch", F.sum(F.col("opens").cast("int")).over(s.rowsBetween(Window.unboundedPreceding, 0)))


def resident(reads: DataFrame) -> DataFrame:
    """Per session, epoch and path: reads, bytes, merged spans and the lines they hold. reads: lo, hi, bytes, epoch."""
    key = ["session_id", "epoch", "path"]
    w = Window.partitionBy(*key).orderBy("lo", "hi", "request_id")
    gap = (F.col("lo") > F.max("hi").over(w.rowsBetween(Window.unboundedPreceding, -1)) + 1).cast("int")
    r = reads.withColumn("gap", F.coalesce(gap, F.lit(0))).withColumn("island", F.sum("gap").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    i = r.groupBy(*key, "island").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.count("*").alias("n"), F.sum("bytes").alias("b"))
    return i.groupBy(*key).agg(F.sum("n").alias("reads"), F.sum("b").alias("bytes"), F.count("*").alias("spans"), F.sum(F.col("hi") - F.col("lo") + 1).alias("lines"))


def duplicate_lines(reads: DataFrame) -> DataFrame:
    """Each read with the lines that the epoch's earlier reads of the path hold already, and their share of its tokens."""
    r = with_cover(reads.select("session_id", "epoch", "path", "ts", "request_id", F.col("lo").cast("bigint").alias("lo"), F.col("hi").cast("bigint").alias("hi"), "bytes"), ["session_id", "epoch", "path"])
    tokens = F.expr("cast(greatest(1, floor(bytes / 4 + 0.5)) as bigint)")
    return r.withColumn("tokens", tokens).select("request_id", "epoch", F.col("covered").alias("dup_lines"), F.expr("tokens * covered div (hi - lo + 1)").alias("dup_tokens"))


def reread_candidate(res: DataFrame, reads: int = 2, tokens: int = 3000) -> DataFrame:
    """The heaviest file of an epoch that was read often enough and is large enough."""
    w = Window.partitionBy("session_id", "epoch").orderBy(F.desc("bytes"), "path")
    return res.filter((F.col("reads") >= reads) & (F.col("bytes") / 4 >= tokens)).withColumn("r", F.row_number().over(w)).filter("r = 1").select("session_id", "epoch", "path", "reads", "bytes")


def levels(context: DataFrame) -> DataFrame:
    """context with level: what a prompt calls for, the most urgent first; null if nothing.

    context: session_id, prompt, share of the window, and where it has one reread, the name of a
    file that is in context already. A session's first prompt that calls for nothing else is a hint.
    """
    kind = F.lit(None).cast("string")
    rungs = [(F.lit(name), F.col("share") >= least) for name, least in LADDER]
    if "reread" in context.columns:
        rungs.insert(2, (F.concat(F.lit("reread:"), "reread"), F.col("reread").isNotNull()))
    for name, holds in reversed(rungs):
        kind = F.when(holds, name).otherwise(kind)
    own = context.withColumn("level", kind)
    first = F.min(F.when(F.col("level").isNull(), F.col("prompt"))).over(Window.partitionBy("session_id"))
    return own.withColumn("level", F.coalesce("level", F.when(F.col("prompt") == first, "hint")))


def alerts(context: DataFrame) -> DataFrame:
    """session_id, prompt, level of the alerts that are given: one that repeats waits 1, 2, 4, then 8 prompts; another kind starts anew.

    context: session_id, prompt (from 1), share, reread. The state of a session is folded over its
    prompts in order: (kind, turn it was given, times given).
    """
    g = levels(context).filter("level is not null").groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("prompt", "level"))).alias("a"))
    waits = "array(" + ", ".join(f"{b}L" for b in BACKOFF) + ")"
    first = "named_struct('kind', x.level, 'at', x.prompt, 'times', 1, 'got', array_append(s.got, x))"
    again = f"if(x.prompt - s.at > element_at({waits}, least(s.times, {len(BACKOFF)})), named_struct('kind', s.kind, 'at', x.prompt, 'times', s.times + 1, 'got', array_append(s.got, x)), s)"
    start = "named_struct('kind', '', 'at', 0L, 'times', 0, 'got', cast(array() as array<struct<prompt:bigint,level:string>>))"
    fold = F.expr(f"aggregate(a, {start}, (s, x) -> if(s.kind <> x.level, {first}, {again})).got")
    return g.select("session_id", F.explode(fold).alias("x")).select("session_id", "x.prompt", "x.level")


def budget_alerts(priced: DataFrame, per_session: float = 25.0, per_day: float = 150.0, warn: float = 0.8) -> DataFrame:
    """scope, key, usd of the sessions and days at or above their share of a budget."""
    usd = (F.sum("m_total").cast("double") / 1e6).alias("usd")
    s = priced.groupBy(F.lit("session").alias("scope"), F.col("session_id").cast("string").alias("key")).agg(usd).filter(F.col("usd") >= warn * per_session)
    d = priced.groupBy(F.lit("day").alias("scope"), F.to_date("ts").cast("string").alias("key")).agg(usd).filter(F.col("usd") >= warn * per_day)
    return s.unionByName(d)


def prunable(sessions: DataFrame, now_us: int, days: float, keep: DataFrame) -> DataFrame:
    """Sessions whose last activity is more than `days` old and that are not kept; sessions: session_id, last_us."""
    return sessions.filter(F.col("last_us") < F.lit(now_us - int(days * 86_400_000_000))).join(keep.select("session_id"), "session_id", "left_anti")
