"""Which account a session belongs to, and roll-ups by account.

An attestation is a login seen at a time. A session is bracketed by the attestation before its
start and the one after it; only where both agree is the label taken, and then as a guess.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Where a label comes from, the surest first.
SOURCES = ("assigned", "recorded", "stamped", "backup", "unknown")


def bracketed(sessions: DataFrame, attestations: DataFrame) -> DataFrame:
    """sessions (owner, session_id, start) with label: of the attestations (owner, at, label) around the start, if both agree.

    A union and two running values within an owner; no pairs are made.
    """
    a = attestations.select("owner", F.col("at").alias("t"), "label", F.lit(0).alias("kind"))
    s = sessions.select("owner", "session_id", F.col("start").alias("t"), F.lit(None).cast("string").alias("label"), F.lit(1).alias("kind"))
    both = s.unionByName(a, allowMissingColumns=True)
    w = Window.partitionBy("owner").orderBy("t", "kind", "label", "session_id")
    before = F.last("label", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first("label", ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
    both = both.withColumn("before", before).withColumn("after", after).filter("kind = 1")
    return both.select("owner", "session_id", F.when(F.col("before") == F.col("after"), F.col("before")).alias("label"))


def resolved(sessions: DataFrame, assigned: DataFrame, recorded: DataFrame, bracket: DataFrame) -> DataFrame:
    """sessions with label, source and is_guess: assigned, then recorded, then bracketed, else unknown."""
    key = ["owner", "session_id"]
    s = sessions.join(assigned.select(*key, F.col("label").alias("l1")), key, "left").join(recorded.select(*key, F.col("label").alias("l2")), key, "left").join(bracket.select(*key, F.col("label").alias("l3")), key, "left")
    source = F.when(F.col("l1").isNotNull(), "assigned").when(F.col("l2").isNotNull(), "recorded").when(F.col("l3").isNotNull(), "backup").otherwise("unknown")
    s = s.withColumn("source", source).withColumn("label", F.coalesce("l1", "l2", "l3", F.lit("unknown")))
    return s.drop("l1", "l2", "l3").withColumn("is_guess", F.col("source") == "backup")


def rollup(rows: DataFrame) -> DataFrame:
    """Per label: sessions, known dollars, sessions without a price. rows: label, m (decimal millionths; null: no price)."""
    return rows.groupBy("label").agg(F.count("*").alias("sessions"), F.coalesce(F.sum("m").cast("double") / 1e6, F.lit(0.0)).alias("usd"), F.count_if(F.col("m").isNull()).alias("unpriced"))


def source_counts(rows: DataFrame) -> DataFrame:
    """Rows by source with the source's rank; a source without rows has none."""
    rank = F.array_position(F.array(*[F.lit(s) for s in SOURCES]), F.col("source")).cast("int")
    return rows.groupBy("source").agg(F.count("*").alias("n")).withColumn("rank", rank)


def labels(logins: DataFrame) -> DataFrame:
    """Names for accounts of an owner in order of first login: primary, secondary, secondary-2, ..."""
    first = logins.groupBy("owner", "address").agg(F.min("at").alias("first"))
    i = F.row_number().over(Window.partitionBy("owner").orderBy("first", "address"))
    name = F.when(F.col("i") == 1, "primary").when(F.col("i") == 2, "secondary").otherwise(F.concat(F.lit("secondary-"), F.col("i") - 1))
    return first.withColumn("i", i).select("owner", "address", name.alias("label"))


def selected(rows: DataFrame, wanted: list[str], known: list[str]) -> DataFrame:
    """rows of the wanted labels: all for an empty list; an unknown label selects nothing, a first letter its label."""
    if not wanted:
        return rows
    full = [k for w in wanted for k in known if k == w.strip().lower() or (len(w.strip()) == 1 and k.startswith(w.strip().lower()))]
    return rows.filter(F.col("label").isin(full) if full else F.lit(False))
