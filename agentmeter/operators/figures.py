"""Measured figures in texts that are published: numbers that look read off somebody's own data."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_W = r"[\p{L}\p{N}_]"
#: A number; one that stands alone; money; a number with its unit.
NUMBER = r"\d{1,3}(?:,\d{3})+(?:\.\d+)?|\d+(?:\.\d+)?"
ALONE = rf"(?<![\p{{L}}\p{{N}}_.,$#])(?<!-)(?:{NUMBER})(?![\p{{L}}\p{{N}}_.]|,\d)"
MONEY = rf"(?<!{_W})[$€£]\s?({NUMBER})[kKmM]?(?![\p{{L}}\p{{N}}_.])"
UNITS = "TiB|GiB|MiB|KiB|TB|GB|MB|KB|B|bytes?|tokens?|requests?|sessions?|files?|lines?|calls?|transcripts?|prompts?|turns?|ms"
WITH_UNIT = rf"(?<![\p{{L}}\p{{N}}_.,$#])(?<!-)({NUMBER})\s?([kKmMgG])?\s?(?:{UNITS})\b"
#: What is counted; words of money; what says that a figure was observed; a percentage; a rate; a list price.
NOUN = r"\b(?:bytes?|tokens?|requests?|sessions?|files?|lines?|calls?|transcripts?|prompts?|conversations?|rows?|records?)\b"
MONEY_WORD = r"(?i)\b(?:cost|costs|spend|spent|bill|billed|dollars?|usd|prices?|charged?|budget|burn)\b"
OBSERVED = rf"(?i)(?<!{_W})(?:measured|on this machine|on the real|this corpus|in practice here|i measured|we measured|observed here)(?!{_W})"
PERCENT = rf"((?:{NUMBER})\s?%)"
RATE = r"(?i)[$€£]\s?\d|\d\s?(?:/\s?1k\b|/\s?1,000\b|/\s?M?[Tt]ok\b)|per\s+1,?000\s+tokens|per\s+M?[Tt]ok"
LIST_PRICE = r"(?i)(?:/\s?M?[Tt]ok|per\s+M?[Tt]ok|per\s+million|/\s?1M|list price)"
#: Numbers that convert units; a whole number with a unit below it is a setting; what counts as large; the least
#: number beside an observation; how far a noun and a list price are looked for; lines around a percentage.
ANCHORS, UNIT_FLOOR, LARGE, LEAST_OBSERVED, NEAR, PRICE_NEAR, LINES = (1.0, 1000.0, 1024.0), 10.0, 1000, 10, 16, 18, 2


def value(raw: Column) -> Column:
    return F.replace(raw, F.lit(","), F.lit("")).try_cast("double")


def _matches(line: Column, pattern: str, signs: int) -> Column:
    """An array of (sample, after): what the pattern finds, and the signs that follow each."""
    whole = F.lit(f"({pattern})(?=(.{{0,{signs}}}))")
    last = len(re.findall(r"(?<!\\)\((?!\?)", pattern)) + 2  # groups of the pattern's own stand between
    return F.zip_with(F.regexp_extract_all(line, whole, 1), F.regexp_extract_all(line, whole, last), lambda s, a: F.struct(s.alias("sample"), a.alias("after")))


def _is_percent(after: Column) -> Column:
    return after.rlike(r"^\s?%")


def _first_number(sample: Column) -> Column:
    return F.regexp_extract(sample, f"({NUMBER})", 1)


def _measured_unit(sample: Column) -> Column:
    """Whether a number with a unit is a measurement and no setting: it is large, or has a point, a comma or a magnitude."""
    raw = _first_number(sample)
    scaled = (F.regexp_extract(sample, WITH_UNIT, 2) != "") | raw.rlike("[.,]")
    v = value(raw)
    return (v != 0) & ~v.isin(*ANCHORS) & (scaled | (v >= UNIT_FLOOR))


def lines_of(texts: DataFrame) -> DataFrame:
    """id, line (from 1), text, around: every line of a text, and the same with the lines beside it. texts: id, text."""
    beside = lambda i: F.array_join(F.slice("rows", F.greatest(F.lit(1), i + 1 - LINES), F.least(i, F.lit(LINES)) + LINES + 1), "\n")
    each = F.transform("rows", lambda x, i: F.struct((i + 1).alias("line"), x.alias("text"), beside(i).alias("around")))
    return texts.select("id", F.split("text", "\n").alias("rows")).select("id", F.explode(each).alias("l")).select("id", "l.*")


def findings(texts: DataFrame, allowed: DataFrame | None = None) -> DataFrame:
    """id, line, rule, sample, n, reason: every number that looks measured; reason says why one is allowed, else it is null.

    currency: money with its sign, not 0 nor a list price. amount: a number shaped like money in a line that speaks of it.
    aggregate: a large number beside what is counted, or one with its unit. observation: a line that says it was measured and
    holds an absolute that is not allowed. rate-percent: a percentage within two lines of a rate, which multiply back into an
    amount. allowed: rule, sample, reason. A text that is null or empty has none. Lines are judged apart, so work grows with the texts.
    """
    spark = texts.sparkSession
    if allowed is None:
        allowed = spark.createDataFrame([], "rule string, sample string, reason string")
    allowed = allowed.groupBy("rule", "sample").agg(F.min("reason").alias("reason"))
    t = F.col("text")
    money, alone, units = _matches(t, MONEY, PRICE_NEAR), _matches(t, ALONE, NEAR), _matches(t, WITH_UNIT, 2)
    gaps, numbers = F.split(t, ALONE), F.regexp_extract_all(t, F.lit(f"({ALONE})"), 1)
    lines = lines_of(texts).select("id", "line", "text", "around", money.alias("money"), alone.alias("alone"), units.alias("units"), gaps.alias("gaps"), numbers.alias("numbers"))
    # a number and what stands before it are two signs at least, so so many of them reach as far as a noun is looked for
    back = NEAR // 2
    first = lambda i: F.greatest(F.lit(1), i + 1 - back)
    both = lambda i: F.zip_with(F.slice("gaps", first(i), F.least(i, F.lit(back)) + 1), F.slice("numbers", first(i), F.least(i, F.lit(back))), lambda g, x: F.concat(g, F.coalesce(x, F.lit(""))))
    before = lambda i: F.right(F.array_join(both(i), ""), F.lit(NEAR))
    hit = lambda rule, sample: F.struct(F.lit(rule).alias("rule"), sample.alias("sample"))
    raw = lambda m: m["sample"]
    spent = F.col("text").rlike(MONEY_WORD)
    currency = F.transform(F.filter("money", lambda m: (value(_first_number(raw(m))) != 0) & ~m["after"].rlike(LIST_PRICE)), lambda m: hit("currency", F.trim(raw(m))))
    shaped = lambda x: (x.contains(",") & x.contains(".")) | x.rlike(r"^\d+\.\d{2}$")
    amount = F.transform(F.filter("alone", lambda m: spent & (value(raw(m)) != 0) & ~_is_percent(m["after"]) & shaped(raw(m))), lambda m: hit("amount", raw(m)))
    placed = F.transform("alone", lambda m, i: F.struct(raw(m).alias("sample"), m["after"].alias("after"), before(i).alias("before")))
    large = lambda m: (raw(m).contains(",") | (value(raw(m)) >= LARGE)) & ~value(raw(m)).isin(*ANCHORS) & (value(raw(m)) != 0) & ~_is_percent(m["after"])
    counted = F.transform(F.filter(placed, lambda m: large(m) & F.concat(m["before"], m["after"]).rlike(NOUN)), lambda m: hit("aggregate", raw(m)))
    measured = F.transform(F.filter("units", lambda m: _measured_unit(raw(m)) & ~_is_percent(m["after"])), lambda m: hit("aggregate", raw(m)))
    percent = F.when(F.col("around").rlike(RATE) & t.rlike(PERCENT), F.array(hit("rate-percent", F.regexp_extract(t, PERCENT, 1)))).otherwise(F.array().cast("array<struct<rule:string,sample:string>>"))
    rows = lines.select("id", "line", F.explode(F.concat(currency, amount, counted, measured, percent)).alias("f")).select("id", "line", "f.*")
    any_money = F.transform(F.filter("money", lambda m: value(_first_number(raw(m))) != 0), lambda m: hit("currency", F.trim(raw(m))))
    any_number = F.transform(F.filter("alone", lambda m: (value(raw(m)) >= LEAST_OBSERVED) & ~_is_percent(m["after"])), lambda m: hit("aggregate", raw(m)))
    seen = lines.filter(t.rlike(OBSERVED)).select("id", "line", F.substring(F.trim("text"), 1, 100).alias("said"), F.explode(F.concat(measured, any_money, any_number)).alias("f"))
    seen = seen.select("id", "line", "said", "f.*").join(allowed.select("rule", "sample"), ["rule", "sample"], "left_anti").select("id", "line", F.col("said").alias("sample")).distinct()
    rows = rows.unionByName(seen.select("id", "line", F.lit("observation").alias("rule"), "sample"))
    found = rows.groupBy("id", "line", "rule", "sample").agg(F.count("*").alias("n"))
    return found.join(allowed, ["rule", "sample"], "left").select("id", "line", "rule", "sample", "n", "reason")
