"""All registered queries of the library, by inventory id, over the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as X
from ..functions import rates
from ..operators import advice, marts, pricing, privacy, rereads, search, searchindex, series
from ..sources import facade, transcripts
from . import journal, more, more_sql, oracle, reconciled, redact, selection, sessions

Query = Callable[[SparkSession, str], DataFrame]


def priced(spark: SparkSession, d: str) -> DataFrame:
    return pricing.price(facade.calls(spark, d))


def snapshots(spark: SparkSession, d: str) -> DataFrame:
    """Each request as 1 to 3 lines with growing output."""
    c = facade.calls(spark, d)
    return c.withColumn("line", F.explode(F.sequence(F.lit(0), (F.col("request_id") % 3).cast("int")))).withColumn("output_tokens", F.col("output_tokens") + F.col("line") * 10)


def a01(spark: SparkSession, d: str) -> DataFrame:
    return transcripts.assemble(snapshots(spark, d).withColumn("prompt_id", F.lit("p")), ("line",)).select("session_id", "request_id", "model", "output_tokens", "lines", "origin")


def c01(spark: SparkSession, d: str) -> DataFrame:
    return priced(spark, d).select("request_id", "model_key", "tier", "unpriced", "context_tokens", *[(F.col(f"m_{k}").cast("double") / 1e6).alias(f"usd_{k}") for k in ("input", "output", "cw5", "cw1", "read", "search", "total")])


def x05(spark: SparkSession, d: str) -> DataFrame:
    return facade.calls(spark, d).groupBy("model").agg(F.count("*").alias("calls")).withColumn("model_key", X.model_key(F.col("model")))


def w09(spark: SparkSession, d: str) -> DataFrame:
    m = facade.marks(spark, d)
    c = rereads.with_generation(facade.calls(spark, d).withColumn("window", X.window_key(F.col("origin"), F.col("agent_id"))), m)
    r = rereads.with_generation(facade.tools(spark, d).filter("name = 'Read'"), m)
    return rereads.carry(r, c).select("request_id", "gen", "carry_requests")


def ledger(spark: SparkSession, d: str) -> DataFrame:
    """The re-read ledger with what each read goes on costing."""
    m = facade.marks(spark, d)
    c = rereads.with_generation(facade.calls(spark, d).withColumn("window", X.window_key(F.col("origin"), F.col("agent_id"))), m)
    r = rereads.carry(rereads.classify(facade.tools(spark, d), m), c)
    return rereads.priced(r, advice.primary_rates(priced(spark, d)))


def c08(spark: SparkSession, d: str) -> DataFrame:
    return ledger(spark, d).select("request_id", "reason", "gen", "carry_requests", "tokens", F.round("carry_usd", 9).alias("carry_usd"), F.round("calibrated_usd", 9).alias("calibrated_usd"))


def w07(spark: SparkSession, d: str) -> DataFrame:
    windows = spark.createDataFrame([(m, w) for m, _, w, _ in rates.MODELS if w], "model_key string, max_tokens long")
    return series.contexts(priced(spark, d), windows)


def w10(spark: SparkSession, d: str) -> DataFrame:
    return rereads.classify(facade.tools(spark, d), facade.marks(spark, d)).select("request_id", "reason")


def a18(spark: SparkSession, d: str) -> DataFrame:
    r = rereads.classify(facade.tools(spark, d), facade.marks(spark, d))
    return r.groupBy("session_id", "reason").agg(F.count("*").alias("reads"), F.sum("bytes").alias("bytes"))


def j11(spark: SparkSession, d: str) -> DataFrame:
    """Reads and the fixed chunks of 25 lines that they overlap."""
    r = facade.tools(spark, d).filter("name = 'Read'")
    chunks = r.groupBy("path").agg(F.max("hi").alias("top")).select("path", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("top"), F.lit(25).cast("bigint"))).alias("clo")).withColumn("chi", F.col("clo") + 24)
    both = r.join(chunks, "path").filter("chi >= lo and clo <= hi")
    return both.groupBy("request_id").agg(F.sum(F.least("hi", "chi") - F.greatest("lo", "clo") + 1).alias("lines"), F.count("*").alias("chunks"))


def c06(spark: SparkSession, d: str) -> DataFrame:
    c = priced(spark, d)
    head = c.groupBy("session_id").agg(F.floor(F.sum("m_total").cast("double") * 0.98).alias("headline"))
    return marts.settled(c, head)


def texts(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").alias("id"), "text")


def c13(spark: SparkSession, d: str) -> DataFrame:
    return privacy.scrubbed(texts(spark, d)).select("id", F.length("text").cast("bigint").alias("chars"), F.md5("text").alias("digest"))


def c20(spark: SparkSession, d: str) -> DataFrame:
    """Every benchmark item asked of the documents' sources and texts."""
    t = spark.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").alias("id"), "source", "text")
    q = spark.read.parquet(f"{d}/benchmark.parquet").select(F.col("item_id").alias("query_id"), "text")
    return search.bm25(t, q, weights={"source": 3.0, "text": 1.0}).select("query_id", "rank", "id", "score")


def code_files(spark: SparkSession, d: str, old: bool = False) -> tuple[DataFrame, DataFrame]:
    """The documents as files: a listing, and their chunks; old: as they were before, some fewer and some shorter."""
    t = spark.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").alias("id"), F.coalesce("source", F.lit("")).alias("source"), F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    if old:
        t = t.filter("id % 7 <> 0").withColumn("text", F.when(F.col("id") % 5 == 0, F.substring("text", 1, 20)).otherwise(F.col("text")))
    mtime = F.when(F.col("id") % 4 == 0, F.lit(9 if old else 8)).otherwise(F.col("id") % 3)
    path = F.concat("source", F.lit("/doc_"), F.col("id").cast("string"), F.lit(".txt"))
    listing = t.select("id", F.octet_length("text").alias("size"), mtime.cast("long").alias("mtime"), path.alias("path"), "lang")
    return listing, t.select("id", F.lit(0).alias("chunk"), F.col("lang").alias("symbol"), F.substring_index("text", "\n", 1).alias("heading"), F.col("text").alias("body"))


def kept_index(spark: SparkSession, d: str) -> searchindex.SearchIndex:
    """An index of the documents as they were, brought up to date."""
    index = searchindex.SearchIndex(spark, searchindex.scratch(spark, "index"))
    for old in (True, False):
        listing, chunks = code_files(spark, d, old)
        index.update(listing, lambda ids, chunks=chunks: chunks.join(ids, "id"))
    return index


def c20_kept(spark: SparkSession, d: str) -> DataFrame:
    """Every benchmark item asked of the kept index."""
    q = spark.read.parquet(f"{d}/benchmark.parquet").select(F.col("item_id").alias("query_id"), "text")
    return kept_index(spark, d).search(q, 10).select("query_id", "rank", "id", "score")


def c18_runs(spark: SparkSession, d: str) -> DataFrame:
    """What both runs of the kept index did."""
    return kept_index(spark, d).runs().select("gen", "scanned", "asked", "indexed", "touched", "removed", "chunks", "length")


def t03(spark: SparkSession, d: str) -> DataFrame:
    """The live totals of a replay in three segments equal one batch's."""
    from ..streaming import live

    s = snapshots(spark, d)
    state = None
    for i in range(3):
        part = s.filter(F.col("line") == i)
        state = live.best(part if state is None else state.unionByName(part))
    return live.totals(state)


def u03(spark: SparkSession, d: str) -> DataFrame:
    """The files a user's days knew that the last day no longer saw: known except seen."""
    t = facade.tools(spark, d).filter("name = 'Read'").select("session_id", "path", F.to_date("ts").alias("day"))
    last = t.groupBy("session_id").agg(F.max("day").alias("last"))
    return t.select("session_id", "path").distinct().exceptAll(t.join(last, "session_id").filter("day = last").select("session_id", "path").distinct())


def queries() -> dict[str, Query]:
    on = lambda f, *more: lambda s, d: f(priced(s, d), *[m(s, d) for m in more])
    tools = lambda f: lambda s, d: f(facade.tools(s, d))
    return {
        "a01_requests": a01, "c01_price": c01, "x05_model_key": x05,
        "a03_totals": on(marts.totals), "a04_by_model": on(marts.by_model), "a05_by_origin": on(marts.by_origin), "a06_by_tool": tools(marts.by_tool),
        "a07_by_turn": on(series.by_turn, facade.prompts), "a08_agents": on(marts.by_agent), "a09_agent_types": on(marts.by_agent_type), "a10_cache": on(marts.cache),
        "a11_waste": on(marts.waste, facade.tools), "a12_redundant": tools(marts.redundant), "a13_primary_model": on(marts.primary_model), "a18_reread_reasons": a18,
        "a22_daily_rollup": on(marts.daily), "a37_bounds": on(marts.bounds), "c06_settle": c06, "c12_audit": lambda s, d: privacy.findings(texts(s, d)), "c13_scrub": c13, "c20_bm25": c20, "c20_kept": c20_kept, "c18_runs": c18_runs,
        "j04_asof": lambda s, d: series.asof_turn(facade.calls(s, d), facade.prompts(s, d)).select("request_id", "turn_id"), "j11_overlap": j11, "o03_topk": on(series.top_calls),
        "t03_live": t03, "u03_except": u03, "w04_cumulative": on(series.cumulative), "w05_thinned": on(series.thinned), "w08_growth": on(series.growth, facade.prompts),
        "w09_carry": w09, "w10_rereads": w10, "c08_ledger": c08, "a19_corpus_rereads": lambda s, d: rereads.corpus(ledger(s, d)), "a18_summary": lambda s, d: rereads.summary(ledger(s, d)), "w07_contexts": w07, "w11_islands": lambda s, d: rereads.islands(facade.tools(s, d).filter("name = 'Read'")), "w12_runs": on(series.runs),
        "w15_day_series": on(series.days), "w19_capped_topk": tools(series.capped), "w20_pseudonyms": lambda s, d: series.pseudonyms(facade.calls(s, d), "agent_id"), "w23_burn": on(series.burn),
        **more.queries(), **sessions.queries(), **redact.queries(), **reconciled.queries(), **journal.queries(), **selection.queries(),
    }


def oracle_sql() -> dict[str, str]:
    return oracle.sql() | more_sql.sql(oracle.FACTS) | sessions.sql(oracle.FACTS) | redact.sql(oracle.FACTS) | reconciled.sql(oracle.FACTS) | journal.sql(oracle.FACTS) | selection.sql(oracle.FACTS)
