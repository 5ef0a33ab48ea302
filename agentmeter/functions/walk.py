"""Nested JSON of any shape, walked level by level as Variant: leaves with their paths, numbers, usage tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Levels below the top that a walk goes down.
DEPTH = 16


def kind(v: Column) -> Column:
    """object, array, number, boolean, string or null of a Variant."""
    t = F.schema_of_variant(v)
    number = t.startswith("DECIMAL") | t.isin("BIGINT", "DOUBLE", "FLOAT", "INT", "SMALLINT", "TINYINT")
    return F.when(t.startswith("OBJECT"), "object").when(t.startswith("ARRAY"), "array").when(number, "number").when(t == "BOOLEAN", "boolean").when(t == "STRING", "string").otherwise("null")


def leaves(rows: DataFrame, column: str, depth: int = DEPTH) -> DataFrame:
    """rows less the column, with path, kind and value (Variant) of each leaf of its JSON text; bad JSON has none.

    A level is one generator behind the other in the same stage: a leaf stays as it is, a container
    gives a row for each member. What lies deeper than `depth` stays a container, so that callers
    see it; empty containers have no leaf.
    """
    spark = rows.sparkSession
    out = rows.withColumn("value", F.try_parse_json(column)).drop(column).filter("value is not null").withColumn("path", F.lit("$")).withColumn("kind", kind(F.col("value")))
    for _ in range(depth):
        inner = F.when(F.col("kind").isin("object", "array"), F.col("value"))
        out = out.withColumn("_in", inner)
        out = out.lateralJoin(spark.tvf.variant_explode_outer(F.col("_in").outer()).select(F.col("pos").alias("_pos"), F.col("key").alias("_key"), F.col("value").alias("_value")))
        is_leaf = F.col("_in").isNull()
        out = out.filter(is_leaf | F.col("_value").isNotNull())
        step = F.when(is_leaf, F.col("path")).when(F.col("_key").isNotNull(), F.concat("path", F.lit("."), "_key")).otherwise(F.concat("path", F.lit("["), F.col("_pos").cast("string"), F.lit("]")))
        value = F.when(is_leaf, F.col("value")).otherwise(F.col("_value"))
        out = out.withColumns({"path": step, "value": value}).drop("_in", "_pos", "_key", "_value").withColumn("kind", kind(F.col("value")))
    return out


def numbers(rows: DataFrame, column: str, depth: int = DEPTH) -> DataFrame:
    """rows less the column, with path and number (a decimal of 12 places) of every number inside its JSON text.

    Truth values are no numbers, nor are texts that look like one.
    """
    text = F.col("value").cast("string")
    number = F.coalesce(text.try_cast("decimal(38,12)"), text.try_cast("double").try_cast("decimal(38,12)"))
    return leaves(rows, column, depth).filter("kind = 'number'").withColumn("number", number).drop("value", "kind")


#: The counts of a model in a checkpoint's table, and its price.
USAGE = ("inputTokens", "outputTokens", "cacheReadInputTokens", "cacheCreationInputTokens", "webSearchRequests", "thinkingTokens")


def model_usage(runs: DataFrame, column: str = "usage") -> DataFrame:
    """session_id, model, runs, the counts of USAGE and costUSD (decimal), summed over runs; a run may name many models.

    runs: session_id and the table as JSON text, {model: {count: n}}. A table that is no object, and
    a model whose entry is none, are left out; a count that is no number is 0.
    """
    spark = runs.sparkSession
    t = runs.select("session_id", F.try_parse_json(column).alias("u")).filter("u is not null")
    t = t.filter(kind(F.col("u")) == "object")
    t = t.lateralJoin(spark.tvf.variant_explode(F.col("u").outer()).select(F.col("key").alias("model"), "value")).filter(kind(F.col("value")) == "object")

    def count(name: str) -> Column:
        text = F.try_variant_get("value", f"$.{name}", "string")
        return F.coalesce(text.try_cast("bigint"), text.try_cast("double").try_cast("bigint"), F.lit(0))

    usd = F.coalesce(F.try_variant_get("value", "$.costUSD", "string").try_cast("decimal(28,10)"), F.lit(0).cast("decimal(28,10)"))
    return t.groupBy("session_id", "model").agg(F.count("*").alias("runs"), *[F.sum(count(n)).alias(n) for n in USAGE], F.sum(usd).alias("costUSD"))
