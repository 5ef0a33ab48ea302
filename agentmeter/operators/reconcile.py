"""Reconciliation in full: what was billed against what the transcript holds, by model and by kind, and why they differ.

placed: priced requests with their place (`billing.covered`). usage: session_id, model, input, output, cache_read,
cache_write, usd: what the runs' snapshots report, summed over a session's runs. Only requests that a snapshot covers are compared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as X
from ..functions import rates

#: The kinds of tokens that snapshots report, in the order that settles which of equal gaps leads.
KINDS = ("input", "output", "cache_read", "cache_write")
#: Drift up to which both agree, the uncovered share from which only a part is compared, the coverage of
#: reads below which requests are missing, and the share from which one kind dominates a gap; all in percent.
AGREES, PARTIAL, READS, DOMINATES = 2.0, 5.0, 99.5, 60.0


def ours(placed: DataFrame) -> DataFrame:
    """Per session and model: covered requests, their price and tokens by kind, and the writes kept for an hour."""
    c = placed.filter("place = 'covered'")
    return c.groupBy("session_id", "model_key").agg(
        F.count("*").alias("calls"), F.sum("m_total").alias("m"), F.sum("input_tokens").alias("our_input"), F.sum("output_tokens").alias("our_output"),
        F.sum("cache_read").alias("our_cache_read"), F.sum(F.col("cw5_tokens") + F.col("cw1_tokens")).alias("our_cache_write"), F.sum("cw1_tokens").alias("hour"),
    )


def by_model(placed: DataFrame, usage: DataFrame) -> DataFrame:
    """session_id, model, both prices and tokens, in_transcript, missing_<kind>: what tokens that only the snapshot knows cost.

    Missing writes cost the blend of five minutes and an hour that the model's own writes had, five minutes where it had
    none. A model that the catalog lacks has no missing dollars; one that only the transcript has, no reported ones.
    """
    theirs = usage.withColumn("model_key", X.model_key(F.col("model")))
    both = theirs.join(ours(placed), ["session_id", "model_key"], "full")
    dim = rates.catalog(usage.sparkSession).filter("not fast").drop("fast", "tier", "r_search")
    both = both.join(F.broadcast(dim), "model_key", "left")
    share = F.coalesce(F.col("hour").cast("double") / F.nullif(F.col("our_cache_write"), F.lit(0)), F.lit(0.0))
    rate = {k: F.col(r).cast("double") for k, r in (("input", "r_in"), ("output", "r_out"), ("cache_read", "r_read"))}
    rate["cache_write"] = F.col("r_cw1").cast("double") * share + F.col("r_cw5").cast("double") * (F.lit(1.0) - share)
    gap = lambda k: F.greatest(F.lit(0), F.coalesce(F.col(k), F.lit(0)) - F.coalesce(F.col(f"our_{k}"), F.lit(0)))
    computed = F.coalesce(F.col("m").cast("double") / 1e6, F.lit(0.0))
    return both.select(
        "session_id", F.coalesce("model", "model_key").alias("model"), F.col("usd").alias("reported_usd"), computed.alias("computed_usd"),
        F.when(F.col("usd").isNotNull(), computed - F.col("usd")).alias("delta_usd"), F.col("output").alias("reported_output"), F.coalesce("our_output", F.lit(0)).cast("bigint").alias("computed_output"),
        F.col("cache_read").alias("reported_cache_read"), F.coalesce("our_cache_read", F.lit(0)).cast("bigint").alias("computed_cache_read"), F.col("calls").isNotNull().alias("in_transcript"),
        *[F.coalesce(gap(k) * rate[k] / 1e6, F.lit(0.0)).alias(f"missing_{k}") for k in KINDS],
    )


def by_kind(placed: DataFrame, usage: DataFrame) -> DataFrame:
    """session_id, kind, computed, reported, delta, coverage_pct, missing_usd: four rows a session that has a snapshot."""
    mine = ours(placed).groupBy("session_id").agg(*[F.sum(f"our_{k}").alias(f"our_{k}") for k in KINDS])
    theirs = usage.groupBy("session_id").agg(*[F.sum(k).alias(k) for k in KINDS])
    missing = by_model(placed, usage).groupBy("session_id").agg(*[F.round(F.sum(f"missing_{k}"), 6).alias(f"missing_{k}") for k in KINDS])
    one = theirs.join(mine, "session_id", "left").join(missing, "session_id", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint")
    rows = F.array(*[F.struct(F.lit(k).alias("kind"), zero(f"our_{k}").alias("computed"), zero(k).alias("reported"), F.col(f"missing_{k}").alias("missing_usd")) for k in KINDS])
    r = one.select("session_id", F.explode(rows).alias("r")).select("session_id", "r.*")
    pct = F.round(100.0 * F.col("computed") / F.nullif(F.col("reported"), F.lit(0)), 2)
    return r.select("session_id", "kind", "computed", "reported", (F.col("computed") - F.col("reported")).alias("delta"), pct.alias("coverage_pct"), "missing_usd")


def reconciled(placed: DataFrame, runs: DataFrame) -> DataFrame:
    """One row a session: prices, delta, status, the uncovered share, what a request's price is scaled by, and where requests stand.

    Where nothing was billed and nothing computed both agree. Without a snapshot the status is unavailable and the scale 1.
    """
    n_runs = runs.groupBy("session_id").agg(F.count("*").alias("runs"))
    covered, main = F.col("place").isin("covered", "none"), F.col("origin") == "main"
    usd = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("m_total"))), F.lit(0)).cast("double") / 1e6
    tokens = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("output_tokens"))), F.lit(0)).cast("bigint")
    g = placed.groupBy("session_id").agg(
        usd(F.lit(True)).alias("computed_usd"), usd(covered).alias("covered_usd"), (F.max("reported").cast("double") / 1e6).alias("reported_usd"),
        F.count_if(covered & main).alias("main_calls"), F.count_if(covered & ~main).alias("side_calls"), tokens(covered & main).alias("main_output"), tokens(covered & ~main).alias("side_output"),
        F.count_if("unpriced").alias("unpriced_calls"), F.count_if(F.col("place") == "early").alias("early_calls"), usd(F.col("place") == "early").alias("early_usd"),
        F.count_if(F.col("place") == "late").alias("late_calls"), usd(F.col("place") == "late").alias("late_usd"),
    ).join(n_runs, "session_id", "left").withColumn("runs", F.coalesce("runs", F.lit(0)))
    open_usd = F.col("early_usd") + F.col("late_usd")
    g = g.withColumn("uncovered_share", F.coalesce(open_usd / F.expr("nullif(covered_usd + early_usd + late_usd, 0)"), F.lit(0.0)))
    g = g.withColumn("delta_usd", F.col("covered_usd") - F.col("reported_usd"))
    nothing = (F.col("reported_usd") == 0) & (F.col("covered_usd") == 0)
    g = g.withColumn("delta_pct", F.when(nothing, 0.0).otherwise(100.0 * F.col("delta_usd") / F.expr("nullif(reported_usd, 0)")))
    part = (F.col("early_calls") + F.col("late_calls") > 0) & (F.col("uncovered_share") > PARTIAL / 100)
    status = F.when(F.col("reported_usd").isNull(), "unavailable").when(part, "partial").when(F.abs("delta_pct") <= AGREES, "ok").otherwise("drift")
    scale = F.coalesce(F.col("reported_usd") / F.expr("nullif(covered_usd, 0)"), F.lit(1.0))
    return g.withColumn("status", status).withColumn("cost_scale", scale)


def diagnosis(sessions: DataFrame, kinds: DataFrame) -> DataFrame:
    """session_id, code, kind, n, usd, pct: why both differ, each reason a code with its figures.

    sessions: `reconciled`; kinds: `by_kind`. unavailable stands alone. One of: lost_dominated or lost_spread (tokens billed
    that the transcripts of sub-agents never held: usd, the leading kind and its share, n requests of sub-agents), reads_lost,
    over_reported; partial; agrees. Then unpriced, early, late, runs.
    """
    one = kinds.groupBy("session_id").agg(
        *[F.max(F.when(F.col("kind") == k, F.col("missing_usd"))).alias(f"missing_{k}") for k in KINDS],
        F.max(F.when(F.col("kind") == "output", -F.col("delta"))).alias("output_gap"), F.max(F.when(F.col("kind") == "cache_read", F.col("coverage_pct"))).alias("read_pct"),
    )
    s = sessions.join(one, "session_id", "left")
    s = s.withColumn("missing", sum((F.coalesce(F.col(f"missing_{k}"), F.lit(0.0)) for k in KINDS), F.lit(0.0)))
    top = F.greatest(*[F.coalesce(F.col(f"missing_{k}"), F.lit(0.0)) for k in KINDS])
    lead: Column = F.lit(None).cast("string")
    for k in reversed(KINDS):
        lead = F.when(F.coalesce(F.col(f"missing_{k}"), F.lit(0.0)) == top, k).otherwise(lead)
    s = s.withColumn("share", F.coalesce(100.0 * top / F.expr("nullif(missing, 0)"), F.lit(0.0))).withColumn("lead", lead)
    drift, known = F.col("status") == "drift", F.col("status") != "unavailable"
    lost = drift & (F.col("side_calls") > 0) & (F.col("output_gap") > 0)

    def reason(when: Column, code: str, kind=None, n=None, usd=None, pct=None) -> Column:
        own = lambda c, t: (F.lit(None) if c is None else F.expr(c)).cast(t)
        fields = F.struct(F.lit(code).alias("code"), own(kind, "string").alias("kind"), own(n, "bigint").alias("n"), own(usd, "double").alias("usd"), own(pct, "double").alias("pct"))
        return F.when(when, fields)

    reasons = F.array(
        reason(~known, "unavailable"),
        reason(lost & (F.col("share") >= DOMINATES), "lost_dominated", "lead", "side_calls", "missing", "share"), reason(lost & (F.col("share") < DOMINATES), "lost_spread", "lead", "side_calls", "missing", "share"),
        reason(drift & (F.col("read_pct") < READS), "reads_lost", "'cache_read'", None, "missing_cache_read", "read_pct"),
        reason(drift & (F.col("delta_usd") > 0), "over_reported", None, None, "delta_usd", "delta_pct"),
        reason(F.col("status") == "partial", "partial", None, "early_calls + late_calls", "early_usd + late_usd", "100.0 * (1.0 - uncovered_share)"),
        reason(F.col("status") == "ok", "agrees", None, None, "delta_usd", "delta_pct"),
        reason(known & (F.col("unpriced_calls") > 0), "unpriced", None, "unpriced_calls"),
        reason(known & (F.col("early_calls") > 0), "early", None, "early_calls", "early_usd"), reason(known & (F.col("late_calls") > 0), "late", None, "late_calls", "late_usd"),
        reason(known & (F.col("runs") > 1), "runs", None, "runs"),
    )
    return s.select("session_id", F.explode(F.filter(reasons, lambda r: r.isNotNull())).alias("r")).select("session_id", "r.*")
