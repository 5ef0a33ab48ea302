"""What is published and kept: pending and orphaned artifacts, exports, terms that must not appear, retention, the live row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .pricing import usd
from .series import ORDER, micros

#: The columns of the request export, in order; those that rows lack are empty.
CSV_COLUMNS = (
    "session_id", "request_id", "ts", "turn_id", "origin", "agent_id", "agent_type", "workflow_id", "model", "model_key", "tier", "fast", "geo", "input_tokens", "output_tokens",
    "cw5_tokens", "cw1_tokens", "cache_read", "context_tokens", "total_tokens", "thinking_tokens", "searches", "fetches", "usd_input", "usd_output", "usd_cw5", "usd_cw1", "usd_read",
    "usd_search", "usd_total", "unpriced", "is_error", "error_status", "stop_reason", "effort", "tools", "skill", "plugin", "mcp_server", "version",
)


def pending(transcripts: DataFrame, published: DataFrame, force: bool = False) -> DataFrame:
    """Sessions to build: those not published since they changed. transcripts: session_id, changed_at; published: session_id, built_at."""
    if force:
        return transcripts
    p = published.groupBy("session_id").agg(F.max("built_at").alias("built_at"))
    return transcripts.join(p, "session_id", "left").filter("built_at is null or built_at < changed_at").drop("built_at")


def orphans(published: DataFrame, transcripts: DataFrame) -> DataFrame:
    """Published sessions whose transcript is gone."""
    return published.select("session_id").distinct().join(transcripts.select("session_id"), "session_id", "left_anti")


def drift(shipped: DataFrame, tracked: DataFrame) -> DataFrame:
    """path, state of the files in one list only: extra (shipped, not tracked) or missing (tracked, not shipped)."""
    a, b = shipped.select("path").distinct(), tracked.select("path").distinct()
    extra, missing = a.join(b, "path", "left_anti"), b.join(a, "path", "left_anti")
    return extra.select("path", F.lit("extra").alias("state")).unionByName(missing.select("path", F.lit("missing").alias("state")))


def request_rows(priced: DataFrame) -> DataFrame:
    """The request export: CSV_COLUMNS in order, money in USD with ten places, flags as 0 and 1."""
    money = {f"usd_{k}": F.format_string("%.10f", F.col(f"m_{k}").cast("double") / 1e6) for k in ("input", "output", "cw5", "cw1", "read", "search", "total")}
    own = dict(priced.dtypes)

    def one(name: str) -> Column:
        if name in money:
            return money[name]
        if name not in own:
            return F.lit(None).cast("string")
        return F.col(name).cast("int").cast("string") if own[name] == "boolean" else F.col(name).cast("string")

    return priced.select(*[one(c).alias(c) for c in CSV_COLUMNS])


def export_csv(priced: DataFrame, path: str) -> None:
    """One folder a session's CSV parts with a header; nothing is gathered in one task."""
    request_rows(priced).write.mode("overwrite").partitionBy("session_id").option("header", True).csv(path)


def denied(texts: DataFrame, terms: DataFrame) -> DataFrame:
    """id, term, n: how often terms stand in texts as whole words, whatever the case. texts: id, text; terms: term.

    Terms of one word meet the texts' words in an equi-join; of other terms the first word does, and what it met is searched.
    """
    word = r"([\p{L}\p{N}_]+)"
    t = terms.select(F.lower("term").alias("term")).filter("term <> ''").distinct().withColumn("first", F.regexp_extract("term", word, 1))
    own = texts.select("id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(word), 1)).alias("first")).groupBy("id", "first").agg(F.count("*").alias("n"))
    one = own.join(t.filter("term = first"), "first").select("id", "term", "n")
    met = own.join(t.filter("term <> first and first <> ''"), "first").select("id", "term").join(texts.select("id", F.lower("text").alias("text")), "id")
    form = F.concat(F.lit(r"(?<![\p{L}\p{N}_])\Q"), "term", F.lit(r"\E(?![\p{L}\p{N}_])"))
    more = met.withColumn("n", F.regexp_count("text", form)).filter("n > 0").select("id", "term", F.col("n").cast("bigint").alias("n"))
    return one.unionByName(more)


def retention(sessions: DataFrame, doomed: DataFrame) -> DataFrame:
    """One row: how many sessions, rows and bytes would go and stay. sessions: session_id, rows, bytes; doomed: session_id."""
    d = doomed.select("session_id").distinct().withColumn("goes", F.lit(True))
    s = sessions.join(d, "session_id", "left").withColumn("goes", F.coalesce("goes", F.lit(False)))
    go, stay = F.col("goes"), ~F.col("goes")
    total = lambda c, f: F.coalesce(F.sum(F.when(f, F.col(c))), F.lit(0))
    return s.agg(F.count_if(go).alias("go"), F.count_if(stay).alias("stay"), total("rows", go).alias("go_rows"), total("bytes", go).alias("go_bytes"), total("bytes", stay).alias("stay_bytes"))


def slug(cwd: Column) -> Column:
    """The folder name of a project, from where its sessions ran."""
    return F.translate(cwd, "/._", "---")


def account_token(addresses: DataFrame, labels: DataFrame, salt: str = "") -> DataFrame:
    """addresses (address) with token: the label of a known login, else a short salted hash; none is given out anew."""
    short = F.concat(F.lit("account-"), F.substring(F.sha2(F.concat(F.lit(salt), F.lower("address")), 256), 1, 8))
    known = labels.select(F.lower("address").alias("_a"), "label")
    return addresses.join(known, F.lower("address") == F.col("_a"), "left").select(*addresses.columns, F.coalesce("label", short).alias("token"))


def brief_gate(share: Column, age_s: Column, least: float = 0.35, most_s: int = 6 * 3600) -> Column:
    """decision and reason: a brief is given if agents read much and the figure is fresh; what is unknown says no."""
    why = (
        F.when(share.isNull(), "no prior").when(age_s.isNull() | (age_s < 0), "age unknown").when(age_s > most_s, "prior too old")
        .when(share < least, "agents read little").otherwise("agents read much")
    )
    return F.struct((why == "agents read much").alias("brief"), why.alias("reason"))


def stamped(active: DataFrame, logins: DataFrame, known: DataFrame) -> DataFrame:
    """New stamps (owner, session_id, label) of running sessions: the owner's newest login; a session once stamped stays as it is."""
    now = logins.groupBy("owner").agg(F.max_by("label", "at").alias("label"))
    return active.join(known.select("owner", "session_id"), ["owner", "session_id"], "left_anti").join(now, "owner").select("owner", "session_id", "label")


def open_residency(residency: DataFrame, epochs: DataFrame) -> DataFrame:
    """Residency of each session's newest epoch; what closed epochs held is dropped. epochs: session_id, epoch."""
    newest = epochs.groupBy("session_id").agg(F.max("epoch").alias("epoch"))
    return residency.join(newest, ["session_id", "epoch"], "left_semi")


def rank_bars(rows: DataFrame, dimension: str, value: str, k: int = 8) -> DataFrame:
    """The k greatest of a dimension with their share of all, ties by name."""
    g = rows.groupBy(F.col(dimension).cast("string").alias("name")).agg(F.sum(value).alias("m"))
    all_ = rows.agg(F.coalesce(F.sum(value), F.lit(0)).cast("double")).first()[0]
    # only the k best of each partition meet: an ordered limit
    top = g.orderBy(F.desc("m"), "name").limit(k)
    return top.select(F.lit(dimension).alias("dimension"), "name", (F.col("m").cast("double") / 1e6).alias("usd"), (F.col("m").cast("double") / F.lit(all_ or None)).alias("share"))


def live_rows(priced: DataFrame, tools: DataFrame, session_budget: float = 25.0) -> DataFrame:
    """Per session what a live line shows: dollars, newest model, calls, the most used tool, share of the budget, spend of its last quarter hour."""
    last = priced.groupBy("session_id").agg(F.max(micros()).alias("last_us"))
    p = priced.join(last, "session_id")
    late = F.col("last_us") - micros() <= 900 * 1_000_000
    own = p.groupBy("session_id").agg(
        usd("m_total").alias("usd"), F.count("*").alias("calls"), F.max_by("model_key", F.struct(*ORDER)).alias("model_key"),
        (F.sum(F.when(late, F.col("m_total"))).cast("double") / 1e6).alias("burn_15m"),
    )
    each = tools.groupBy("session_id", "name").agg(F.count("*").alias("n"))
    best = Window.partitionBy("session_id").orderBy(F.desc("n"), "name")
    top = each.withColumn("r", F.row_number().over(best)).filter("r = 1").select("session_id", F.col("name").alias("top_tool"))
    return own.join(top, "session_id", "left").withColumn("budget_pct", F.col("usd") * (100.0 / session_budget))


def numbers(texts: DataFrame) -> DataFrame:
    """id, figure, n: the numbers in texts, thousands without their commas, as they are written. texts: id, text."""
    found = F.regexp_extract_all("text", F.lit(r"([0-9]{1,3}(?:,[0-9]{3})+(?:\.[0-9]+)?|[0-9]+(?:\.[0-9]+)?)"), 1)
    return texts.select("id", F.explode(found).alias("figure")).groupBy("id", F.regexp_replace("figure", ",", "").alias("figure")).agg(F.count("*").alias("n"))
