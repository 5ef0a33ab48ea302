"""What billing snapshots say against our own prices: runs, coverage, reconciliation.

A checkpoint is a running total of one run (session, run_start); the one with the longest
duration counts. It bills through the newest main request read above it in its file.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .series import micros

#: A run's first request may be stamped before the run's own start.
LEAD_S = 120


def billed_through(calls: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """checkpoints with billed_ts: the newest main request at or above the checkpoint's place (ord) in its session."""
    main = calls.filter("origin = 'main'").select("session_id", F.col("request_id").alias("ord"), "ts", F.lit(0).alias("kind"))
    both = main.unionByName(checkpoints.withColumn("kind", F.lit(1)).withColumn("ts", F.lit(None).cast(dict(calls.dtypes)["ts"])), allowMissingColumns=True)
    w = Window.partitionBy("session_id").orderBy("ord", "kind").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("billed_ts", F.max("ts").over(w)).filter("kind = 1").drop("kind", "ts")


def latest(checkpoints: DataFrame) -> DataFrame:
    """One row a run: of the longest duration, the later line where two are equal."""
    rest = [c for c in checkpoints.columns if c not in ("session_id", "run_start")]
    best = F.max_by(F.struct(*rest), F.struct("duration", "ord"))
    return checkpoints.groupBy("session_id", "run_start").agg(best.alias("b")).select("session_id", "run_start", "b.*")


def edges(calls: DataFrame, runs: DataFrame) -> DataFrame:
    """Per session with a checkpoint: lo_us, hi_us (null: open), reported.

    The right edge is what was billed through, and falls away if no main request follows it.
    """
    each = runs.groupBy("session_id").agg((F.min(micros(F.col("run_start"))) - LEAD_S * 1_000_000).alias("lo_us"), F.max(micros(F.col("billed_ts"))).alias("mark_us"), F.sum("reported").alias("reported"))
    last = calls.filter("origin = 'main'").groupBy("session_id").agg(F.max(micros()).alias("last_us"))
    right = F.when(F.col("last_us") > F.col("mark_us"), F.col("mark_us"))
    return each.join(last, "session_id", "left").select("session_id", "lo_us", right.alias("hi_us"), "reported")


def covered(priced: DataFrame, runs: DataFrame) -> DataFrame:
    """priced with place (early, covered, late, none) and the session's edges."""
    c = priced.join(edges(priced, runs), "session_id", "left")
    place = F.when(F.col("lo_us").isNull(), "none").when(micros() < F.col("lo_us"), "early").when(micros() > F.col("hi_us"), "late").otherwise("covered")
    return c.withColumn("place", place)


def coverage(priced: DataFrame, runs: DataFrame) -> DataFrame:
    """Per session and place: requests and price; requests of main and of the others apart."""
    c = covered(priced, runs)
    return c.groupBy("session_id", "place").agg(F.count("*").alias("calls"), F.count_if(F.col("origin") == "main").alias("main_calls"), (F.sum("m_total").cast("double") / 1e6).alias("usd"))


def authoritative(priced: DataFrame, runs: DataFrame) -> DataFrame:
    """Per session: reported, computed and the cost that counts, with where it comes from and how well both agree.

    Reported plus our price of what no checkpoint covers; our price where there is none. Status:
    ok up to 2 % of drift, partial if more than 5 % of the price is not covered.
    """
    c = covered(priced, runs)
    out = F.coalesce(F.sum(F.when(F.col("place") != "covered", F.col("m_total"))), F.lit(0).cast("decimal(38,5)"))
    g = c.groupBy("session_id").agg(F.sum("m_total").alias("m"), out.alias("open"), F.max("reported").alias("reported"))
    computed, beyond, reported = F.col("m").cast("double") / 1e6, F.col("open").cast("double") / 1e6, F.col("reported").cast("double") / 1e6
    g = g.select("session_id", reported.alias("reported_usd"), computed.alias("computed_usd"), (computed - beyond).alias("covered_usd"), beyond.alias("open_usd"))
    none = F.col("reported_usd").isNull()
    drift = F.expr("abs(reported_usd - covered_usd) / nullif(reported_usd, 0)")
    g = g.withColumn("usd", F.when(none, F.col("computed_usd")).otherwise(F.col("reported_usd") + F.col("open_usd")))
    g = g.withColumn("source", F.when(none, "computed").when(F.col("open_usd") > 0, "mixed").otherwise("reported"))
    status = F.when(none, "unavailable").when(F.col("open_usd") > 0.05 * F.col("computed_usd"), "partial").when(drift <= 0.02, "ok").otherwise("drift")
    return g.withColumn("status", status)


def model_gap(priced: DataFrame, runs: DataFrame) -> DataFrame:
    """Our price and the reported one, per session and model: a full outer join."""
    ours = priced.groupBy("session_id", "model_key").agg(F.sum("m_total").alias("m"))
    theirs = runs.groupBy("session_id", "model_key").agg(F.sum("reported").alias("r"))
    both = ours.join(theirs, ["session_id", "model_key"], "full")
    a, b = F.col("m").cast("double") / 1e6, F.col("r").cast("double") / 1e6
    return both.select("session_id", "model_key", a.alias("computed_usd"), b.alias("reported_usd"), F.col("m").isNotNull().alias("in_transcript"), (F.coalesce(b, F.lit(0.0)) - F.coalesce(a, F.lit(0.0))).alias("delta_usd"))


def provenance(costs: DataFrame) -> DataFrame:
    """Sessions, dollars and whether a figure is an estimate, by where the cost comes from."""
    g = costs.groupBy("source").agg(F.count("*").alias("sessions"), F.round(F.sum("usd"), 6).alias("usd"), F.bool_or(F.col("source") != "reported").alias("estimate"))
    return g.withColumn("label", F.when(F.col("source") == "reported", "billed").when(F.col("source") == "mixed", "billed+measured").otherwise("measured"))
