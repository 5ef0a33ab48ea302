"""Registered queries on reconciliation in full, each with its SQL beside it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rates import MODELS, TIERS
from ..operators import billing, reconcile
from .more import priced, runs
from .more_sql import _BILL

ASIDE = "claude-haiku-4-5-20251001"


def usage(spark: SparkSession, d: str) -> DataFrame:
    """What each run's newest snapshot reports, by model: the run's own model, and another that the transcript never shows."""
    r = runs(spark, d).withColumn("k", (F.col("reported") / 100000).cast("bigint"))
    n = lambda own, aside: F.when(F.col("aside"), F.col("k") * aside).otherwise(F.col("k") * own)
    r = r.withColumn("aside", F.explode(F.array(F.lit(False), F.lit(True))))
    r = r.select(
        "session_id", F.when(F.col("aside"), ASIDE).otherwise(F.col("model_key")).alias("model"), n(400, 3).alias("input"), n(60, 1).alias("output"), n(1000, 0).alias("cache_read"),
        n(150, 0).alias("cache_write"), F.when(F.col("aside"), F.lit(0)).otherwise(F.col("reported")).cast("decimal(28,5)").alias("m"),
    )
    sums = [F.sum(k).alias(k) for k in reconcile.KINDS]
    return r.groupBy("session_id", "model").agg(*sums, (F.sum("m").cast("double") / 1e6).alias("usd"))


def placed(spark: SparkSession, d: str) -> DataFrame:
    return billing.covered(priced(spark, d), runs(spark, d))


def by_model(spark: SparkSession, d: str) -> DataFrame:
    return reconcile.by_model(placed(spark, d), usage(spark, d))


def by_kind(spark: SparkSession, d: str) -> DataFrame:
    return reconcile.by_kind(placed(spark, d), usage(spark, d))


def sessions(spark: SparkSession, d: str) -> DataFrame:
    return reconcile.reconciled(placed(spark, d), runs(spark, d))


def diagnosis(spark: SparkSession, d: str) -> DataFrame:
    return reconcile.diagnosis(sessions(spark, d), by_kind(spark, d))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"c02_models": by_model, "c02_kinds": by_kind, "c02_sessions": sessions, "c02_diagnosis": diagnosis}


_tier = {t[0]: t[1:] for t in TIERS}
_rates = ", ".join(f"('{m}', {', '.join(_tier[t][:5])})" for m, t, *_ in MODELS)
_K = reconcile.KINDS
_USE = _BILL + f""", rr AS (SELECT session_id, model_key, CAST(reported / 100000 AS BIGINT) AS k, reported AS m FROM runs),
    us AS (SELECT session_id, model, CAST(sum(input) AS BIGINT) AS input, CAST(sum(output) AS BIGINT) AS output, CAST(sum(cache_read) AS BIGINT) AS cache_read, CAST(sum(cache_write) AS BIGINT) AS cache_write, CAST(sum(m) AS DOUBLE) / 1e6 AS usd FROM (
      SELECT session_id, model_key AS model, k * 400 AS input, k * 60 AS output, k * 1000 AS cache_read, k * 150 AS cache_write, m FROM rr UNION ALL SELECT session_id, '{ASIDE}', k * 3, k, 0, 0, 0 FROM rr) GROUP BY 1, 2),
    me AS (SELECT session_id, model_key, count(*) AS calls, CAST(sum(m_total) AS DOUBLE) / 1e6 AS usd, sum(input_tokens) AS input, sum(output_tokens) AS output, sum(cache_read) AS cache_read, sum(cw5_tokens + cw1_tokens) AS cache_write, sum(cw1_tokens) AS hour FROM placed WHERE place = 'covered' GROUP BY 1, 2),
    ra(model_key, r_in, r_out, r_cw5, r_cw1, r_read) AS (VALUES {_rates}),
    bm AS (SELECT coalesce(u.session_id, e.session_id) AS session_id, coalesce(model, e.model_key) AS model, u.usd AS reported_usd, coalesce(e.usd, 0) AS computed_usd, coalesce(e.usd, 0) - u.usd AS delta_usd, u.output AS reported_output, CAST(coalesce(e.output, 0) AS BIGINT) AS computed_output,
      u.cache_read AS reported_cache_read, CAST(coalesce(e.cache_read, 0) AS BIGINT) AS computed_cache_read, calls IS NOT NULL AS in_transcript, coalesce(CAST(hour AS DOUBLE) / nullif(e.cache_write, 0), 0) AS h,
      {", ".join(f"greatest(0, coalesce(u.{k}, 0) - coalesce(e.{k}, 0)) AS g_{k}" for k in _K)}, r_in::DOUBLE AS r_in, r_out::DOUBLE AS r_out, r_read::DOUBLE AS r_read, r_cw5::DOUBLE AS r_cw5, r_cw1::DOUBLE AS r_cw1
      FROM (SELECT *, regexp_replace(model, '-[0-9]{{8}}$', '') AS model_key FROM us) u FULL JOIN me e ON u.session_id = e.session_id AND u.model_key = e.model_key LEFT JOIN ra ON ra.model_key = coalesce(u.model_key, e.model_key)),
    mi AS (SELECT *, coalesce(g_input * r_in / 1e6, 0) AS missing_input, coalesce(g_output * r_out / 1e6, 0) AS missing_output, coalesce(g_cache_read * r_read / 1e6, 0) AS missing_cache_read, coalesce(g_cache_write * (r_cw1 * h + r_cw5 * (1 - h)) / 1e6, 0) AS missing_cache_write FROM bm),
    ki AS (SELECT u.session_id, kind, CAST(coalesce(c, 0) AS BIGINT) AS computed, CAST(r AS BIGINT) AS reported, CAST(coalesce(c, 0) - r AS BIGINT) AS delta, round(100.0::DOUBLE * coalesce(c, 0) / nullif(r, 0), 2) AS coverage_pct, round(mu, 6) AS missing_usd FROM (
      {" UNION ALL ".join(f"SELECT session_id, '{k}' AS kind, sum({k}) AS r FROM us GROUP BY 1" for k in _K)}) u
      LEFT JOIN ({" UNION ALL ".join(f"SELECT session_id, '{k}' AS kind, sum({k}) AS c FROM me GROUP BY 1" for k in _K)}) c USING (session_id, kind)
      LEFT JOIN ({" UNION ALL ".join(f"SELECT session_id, '{k}' AS kind, sum(missing_{k}) AS mu FROM mi GROUP BY 1" for k in _K)}) m USING (session_id, kind)),
    se0 AS (SELECT session_id, CAST(sum(m_total) AS DOUBLE) / 1e6 AS computed_usd, coalesce(CAST(sum(m_total) FILTER (place IN ('covered', 'none')) AS DOUBLE), 0) / 1e6 AS covered_usd, CAST(max(reported) AS DOUBLE) / 1e6 AS reported_usd,
      count(*) FILTER (place IN ('covered', 'none') AND origin = 'main') AS main_calls, count(*) FILTER (place IN ('covered', 'none') AND origin <> 'main') AS side_calls,
      CAST(coalesce(sum(output_tokens) FILTER (place IN ('covered', 'none') AND origin = 'main'), 0) AS BIGINT) AS main_output, CAST(coalesce(sum(output_tokens) FILTER (place IN ('covered', 'none') AND origin <> 'main'), 0) AS BIGINT) AS side_output,
      count(*) FILTER (unpriced) AS unpriced_calls, count(*) FILTER (place = 'early') AS early_calls, coalesce(CAST(sum(m_total) FILTER (place = 'early') AS DOUBLE), 0) / 1e6 AS early_usd,
      count(*) FILTER (place = 'late') AS late_calls, coalesce(CAST(sum(m_total) FILTER (place = 'late') AS DOUBLE), 0) / 1e6 AS late_usd FROM placed GROUP BY 1),
    se1 AS (SELECT se0.*, coalesce(runs, 0) AS runs, coalesce((early_usd + late_usd) / nullif(covered_usd + early_usd + late_usd, 0), 0) AS uncovered_share, covered_usd - reported_usd AS delta_usd,
      CASE WHEN reported_usd = 0 AND covered_usd = 0 THEN 0 ELSE 100.0::DOUBLE * (covered_usd - reported_usd) / nullif(reported_usd, 0) END AS delta_pct FROM se0 LEFT JOIN (SELECT session_id, count(*) AS runs FROM runs GROUP BY 1) USING (session_id)),
    se AS (SELECT *, CASE WHEN reported_usd IS NULL THEN 'unavailable' WHEN early_calls + late_calls > 0 AND uncovered_share > 0.05::DOUBLE THEN 'partial' WHEN abs(delta_pct) <= 2 THEN 'ok' ELSE 'drift' END AS status, coalesce(reported_usd / nullif(covered_usd, 0), 1) AS cost_scale FROM se1),
    kk AS (SELECT session_id, {", ".join(f"max(missing_usd) FILTER (kind = '{k}') AS m_{k}" for k in _K)}, max(-delta) FILTER (kind = 'output') AS output_gap, max(coverage_pct) FILTER (kind = 'cache_read') AS read_pct FROM ki GROUP BY 1),
    dg0 AS (SELECT se.*, output_gap, read_pct, m_cache_read, m_input + m_output + m_cache_read + m_cache_write AS missing, greatest(m_input, m_output, m_cache_read, m_cache_write) AS top,
      CASE greatest(m_input, m_output, m_cache_read, m_cache_write) WHEN m_input THEN 'input' WHEN m_output THEN 'output' WHEN m_cache_read THEN 'cache_read' ELSE 'cache_write' END AS lead FROM se LEFT JOIN kk USING (session_id)),
    dg AS (SELECT *, coalesce(100.0::DOUBLE * top / nullif(missing, 0), 0) AS share FROM dg0)
"""
_code = lambda code, where, kind="NULL", n="NULL", usd="NULL", pct="NULL": f"SELECT session_id, '{code}' AS code, CAST({kind} AS VARCHAR) AS kind, CAST({n} AS BIGINT) AS n, CAST({usd} AS DOUBLE) AS usd, CAST({pct} AS DOUBLE) AS pct FROM dg WHERE {where}"
_lost = "status = 'drift' AND side_calls > 0 AND output_gap > 0"
BODY = {
    "c02_models": f"SELECT session_id, model, reported_usd, computed_usd, delta_usd, reported_output, computed_output, reported_cache_read, computed_cache_read, in_transcript, {', '.join(f'missing_{k}' for k in _K)} FROM mi",
    "c02_kinds": "SELECT * FROM ki",
    "c02_sessions": f"""SELECT session_id, status, main_calls, side_calls, main_output, side_output, unpriced_calls, early_calls, late_calls, CAST(runs AS BIGINT) AS runs,
        computed_usd, covered_usd, reported_usd, early_usd, late_usd, uncovered_share, delta_usd, delta_pct, cost_scale FROM se""",
    "c02_diagnosis": " UNION ALL ".join([
        _code("unavailable", "status = 'unavailable'"), _code("lost_dominated", _lost + " AND share >= 60", "lead", "side_calls", "missing", "share"), _code("lost_spread", _lost + " AND share < 60", "lead", "side_calls", "missing", "share"),
        _code("reads_lost", "status = 'drift' AND read_pct < 99.5::DOUBLE", "'cache_read'", "NULL", "m_cache_read", "read_pct"), _code("over_reported", "status = 'drift' AND delta_usd > 0", usd="delta_usd", pct="delta_pct"),
        _code("partial", "status = 'partial'", n="early_calls + late_calls", usd="early_usd + late_usd", pct="100.0::DOUBLE * (1 - uncovered_share)"), _code("agrees", "status = 'ok'", usd="delta_usd", pct="delta_pct"),
        _code("unpriced", "status <> 'unavailable' AND unpriced_calls > 0", n="unpriced_calls"), _code("early", "status <> 'unavailable' AND early_calls > 0", n="early_calls", usd="early_usd"),
        _code("late", "status <> 'unavailable' AND late_calls > 0", n="late_calls", usd="late_usd"), _code("runs", "status <> 'unavailable' AND runs > 1", n="runs"),
    ]),
}


def sql(facts: str) -> dict[str, str]:
    return {k: facts + _USE + v for k, v in BODY.items()}
