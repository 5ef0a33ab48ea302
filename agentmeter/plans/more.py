"""More registered queries: billing, advice, accounts, epochs and alerts, source index, statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import accounts, advice, alerts, billing, pricing, series, sourceindex
from ..operators.series import micros
from ..sources import facade


def priced(spark: SparkSession, d: str) -> DataFrame:
    return pricing.price(facade.calls(spark, d))


def runs(spark: SparkSession, d: str) -> DataFrame:
    return billing.latest(billing.billed_through(facade.calls(spark, d), facade.checkpoints(spark, d)))


def costs(spark: SparkSession, d: str) -> DataFrame:
    return billing.authoritative(priced(spark, d), runs(spark, d))


def t07(spark: SparkSession, d: str) -> DataFrame:
    """Live dollars over a replay in three parts, each with requests before and after the snapshots that bill them."""
    from ..operators.searchindex import scratch
    from ..streaming import live

    all_ = live.lines(priced(spark, d), facade.checkpoints(spark, d))
    parts = [all_.filter(F.pmod(F.xxhash64("kind", "ord"), F.lit(3)) == i) for i in range(3)]
    return live.dollars(live.drained_dollars(parts, scratch(spark, "live"), late="36500 days"))


def a14(spark: SparkSession, d: str) -> DataFrame:
    r = runs(spark, d)
    return r.select("session_id", micros(F.col("run_start")).alias("run_us"), "ord", (F.col("reported").cast("double") / 1e6).alias("usd"), micros(F.col("billed_ts")).alias("billed_us"))


def facts(spark: SparkSession, d: str) -> DataFrame:
    from .catalog import ledger

    return advice.facts(priced(spark, d), facade.tools(spark, d), ledger(spark, d))


def levers(spark: SparkSession, d: str) -> DataFrame:
    return advice.levers(facts(spark, d))


def bracket(spark: SparkSession, d: str) -> DataFrame:
    return accounts.bracketed(facade.day_sessions(spark, d), facade.attestations(spark, d))


def attributed(spark: SparkSession, d: str) -> DataFrame:
    s, a = facade.day_sessions(spark, d), facade.attestations(spark, d)
    key = ["owner", "session_id"]
    day = a.withColumn("session_id", F.to_date("at").cast("string"))
    assigned = day.filter("event_id % 97 = 0").groupBy(*key).agg(F.max_by("label", F.struct("at", "event_id")).alias("label"))
    recorded = day.filter("event_id % 7 = 0").groupBy(*key).agg(F.min_by("label", F.struct("at", "event_id")).alias("label"))
    return accounts.resolved(s, assigned, recorded, accounts.bracketed(s, a))


def c11(spark: SparkSession, d: str) -> DataFrame:
    return attributed(spark, d).select("owner", "session_id", "label", "source", "is_guess")


def a25(spark: SparkSession, d: str) -> DataFrame:
    p = priced(spark, d).groupBy(F.col("session_id").alias("owner"), F.to_date("ts").cast("string").alias("session_id")).agg(F.sum(F.when(~F.col("unpriced"), F.col("m_total"))).alias("m"))
    return accounts.rollup(attributed(spark, d).join(p, ["owner", "session_id"], "left"))


def w21(spark: SparkSession, d: str) -> DataFrame:
    return accounts.labels(facade.attestations(spark, d).select("owner", F.concat(F.lit("u"), F.col("k") % 4).alias("address"), "at"))


def epochs(spark: SparkSession, d: str) -> DataFrame:
    e = facade.events(spark, d)
    return alerts.epochs(e.select(F.col("user_id").alias("session_id"), "ts", F.col("event_id").alias("request_id"), F.expr("event_type = 'signup' and k % 5 = 0").alias("is_reset")))


def reads(spark: SparkSession, d: str) -> DataFrame:
    return facade.tools(spark, d).filter("name = 'Read'").join(epochs(spark, d).select("request_id", "epoch"), "request_id")


def contexts(spark: SparkSession, d: str) -> DataFrame:
    """The main requests of a session, numbered, with the share of a window of 60,000 tokens."""
    c = priced(spark, d).filter("origin = 'main'")
    n = F.row_number().over(Window.partitionBy("session_id").orderBy(*series.ORDER)).cast("bigint")
    return c.select("session_id", n.alias("prompt"), (F.col("context_tokens") / 60000).alias("share"))


def f11(spark: SparkSession, d: str) -> DataFrame:
    """Sessions quiet for six hours before the newest request, but those that were compacted."""
    s = facade.calls(spark, d).groupBy("session_id").agg(F.max(micros()).alias("last_us"))
    newest = s.agg(F.max("last_us")).first()[0] or 0
    return alerts.prunable(s, newest, 0.25, facade.marks(spark, d).select("session_id").distinct())


def c18(spark: SparkSession, d: str) -> DataFrame:
    """The documents against a snapshot that lacks some, holds others shorter, and has some that are gone."""
    t = spark.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    snap = lambda df, text: df.select("id", F.length(text).cast("bigint").alias("size"), (F.col("id") % 3).alias("mtime"), F.md5(text.cast("binary")).alias("digest"))
    old = snap(t.filter("id % 7 <> 0"), F.when(F.col("id") % 5 == 0, F.substring("text", 1, 20)).otherwise(F.col("text")))
    return sourceindex.changes(old.withColumn("mtime", F.when(F.col("id") % 4 == 0, 9).otherwise(F.col("mtime"))), snap(t.filter("id % 11 <> 0"), F.col("text"))).groupBy("state").agg(F.count("*").alias("n"), F.sum("id").alias("ids"))


def w18(spark: SparkSession, d: str) -> DataFrame:
    t = spark.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").alias("id"), "text")
    return sourceindex.chunks(t, 20)


def j16(spark: SparkSession, d: str) -> DataFrame:
    e = facade.events(spark, d)
    edge = e.select(F.col("user_id").alias("src"), F.col("k").alias("dst")).distinct()
    seeds = e.select(F.col("user_id").alias("seed"), F.col("user_id").alias("node"))
    return sourceindex.closure(seeds, edge, 2)


def ranked(spark: SparkSession, d: str) -> DataFrame:
    r = F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("bytes"), "request_id"))
    return facade.tools(spark, d).select(F.col("session_id").alias("key"), r.alias("rank"), F.expr("bytes div 4").alias("tokens"))


def o09(spark: SparkSession, d: str) -> DataFrame:
    """What fits the budget in order, up to the first that does not."""
    w = Window.partitionBy("key").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    return ranked(spark, d).withColumn("spent", F.sum("tokens").over(w)).filter("spent <= 1500").groupBy("key").agg(F.count("*").alias("n"), F.max("spent").alias("tokens"))


def p17(spark: SparkSession, d: str) -> DataFrame:
    g = priced(spark, d).groupBy("model_key").agg(*[F.sum(f"m_{k}").alias(k) for k in ("input", "output", "cw5", "cw1", "read", "search")])
    return g.unpivot("model_key", ["input", "output", "cw5", "cw1", "read", "search"], "kind", "m").select("model_key", "kind", (F.col("m").cast("double") / 1e6).alias("usd"))


def p16(spark: SparkSession, d: str) -> DataFrame:
    g = priced(spark, d).groupBy("session_id", "model_key").agg(F.sum("m_total").cast("double").alias("m"))
    own = priced(spark, d).groupBy("session_id").agg(F.sum("m_total").cast("double").alias("all"))
    return g.join(own, "session_id").select("session_id", "model_key", F.expr("m / nullif(all, 0D)").alias("share"))


def w03(spark: SparkSession, d: str) -> DataFrame:
    """A turn lasts to the next one, the last to the session's last request."""
    p, c = facade.prompts(spark, d), facade.calls(spark, d).groupBy("session_id").agg(F.max(micros()).alias("last_us"))
    nxt = F.lead(micros()).over(Window.partitionBy("session_id").orderBy("ts", "turn_id"))
    t = p.withColumn("next_us", nxt).join(c, "session_id")
    return t.select("session_id", "turn_id", F.greatest(F.lit(0), F.coalesce("next_us", "last_us") - micros()).alias("wall_us"))


def w06(spark: SparkSession, d: str) -> DataFrame:
    """Context of each hour: least, greatest and last."""
    c = priced(spark, d).filter("origin = 'main'").withColumn("hour", F.expr("unix_micros(cast(ts as timestamp)) div 3600000000"))
    return c.groupBy("session_id", "hour").agg(F.min("context_tokens").alias("lo"), F.max("context_tokens").alias("hi"), F.max_by("context_tokens", F.struct("ts", "request_id")).alias("last"))


def w14(spark: SparkSession, d: str) -> DataFrame:
    t = facade.tools(spark, d)
    return t.groupBy("path").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.countDistinct("session_id").alias("sessions"), F.countDistinct("session_id", "window").alias("windows"))


def a30(spark: SparkSession, d: str) -> DataFrame:
    t = spark.read.parquet(f"{d}/documents.parquet")
    lines = F.size(F.split("text", "\n")).cast("bigint")
    return t.groupBy("lang").agg(F.count("*").alias("files"), F.sum(F.length("text").cast("bigint")).alias("chars"), F.sum(lines).alias("lines"), F.countDistinct("source").alias("sources"))


def a32(spark: SparkSession, d: str) -> DataFrame:
    c = priced(spark, d)
    return c.groupBy("session_id").agg(F.percentile("context_tokens", 0.5).alias("median_context"), F.min(F.when(F.col("context_tokens") > 0, F.col("context_tokens"))).alias("fixed_prefix"))


def c16(spark: SparkSession, d: str) -> DataFrame:
    """Numbers of four digits or more in texts that are figures of the private table, by document."""
    t = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"([0-9]{4,})"), 1))).alias("figure"))
    known = facade.events(spark, d).select(F.floor(F.col("value") * 100).cast("string").alias("figure")).filter("length(figure) >= 4").distinct()
    return t.join(known, "figure", "left_semi").groupBy("doc_id").agg(F.count("*").alias("hits"), F.min("figure").alias("least"))


def queries() -> dict:
    return {
        "a14_runs": a14, "a16_coverage": lambda s, d: billing.coverage(priced(s, d), runs(s, d)), "c02_reconcile": costs, "t07_live_dollars": t07, "j09_model_gap": lambda s, d: billing.model_gap(priced(s, d), runs(s, d)),
        "a24_provenance": lambda s, d: billing.provenance(costs(s, d)), "c03_findings": lambda s, d: advice.findings(facts(s, d)), "c04_levers": levers, "c05_combined": lambda s, d: advice.combined(levers(s, d)),
        "a33_corpus_levers": lambda s, d: advice.corpus(levers(s, d)), "c07_turn_residency": lambda s, d: advice.turn_residency(series.by_turn(priced(s, d), facade.prompts(s, d))),
        "j07_bracket": bracket, "c11_accounts": c11, "a25_account_rollup": a25, "a26_sources": lambda s, d: accounts.source_counts(attributed(s, d)), "w21_labels": w21,
        "t15_epochs": lambda s, d: epochs(s, d).select("session_id", "request_id", "epoch"), "a28_resident": lambda s, d: alerts.resident(reads(s, d)), "c27_replay": lambda s, d: alerts.duplicate_lines(reads(s, d)),
        "o12_candidate": lambda s, d: alerts.reread_candidate(alerts.resident(reads(s, d)), 2, 1000), "t14_alerts": lambda s, d: alerts.alerts(contexts(s, d)), "t16_budget": lambda s, d: alerts.budget_alerts(priced(s, d), 1.0, 5.0),
        "f11_prunable": f11, "c18_changes": c18, "w18_chunks": w18, "j16_closure": j16, "c23_packed": lambda s, d: sourceindex.packed(ranked(s, d), 1500), "o09_budget": o09,
        "p17_kinds": p17, "p16_share": p16, "w03_turn_wall": w03, "w06_downsample": w06, "w14_seen": w14, "a30_index_stats": a30, "a32_medians": a32, "c16_figures": c16,
    }
