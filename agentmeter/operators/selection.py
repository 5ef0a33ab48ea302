"""Which sessions are meant: by id, prefix, path or age, by when they began, and those worth following."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What asks for the newest session.
NEWEST = ("", "last", "--last", "current")


def selected(rows: DataFrame, asked: DataFrame) -> DataFrame:
    """asked, session_id, how, n: the one session that is meant; where several or none fit, session_id is null and n says how many.

    A transcript's path comes first, then a whole id, then the start of one id alone; an empty selector, or one of NEWEST,
    means the session that was written last (of equals the smallest id). rows: session_id, path, mtime; asked: asked. Prefixes
    meet in an equi-join, so many selectors may be asked at once.
    """
    a = asked.select("asked", F.trim(F.coalesce("asked", F.lit(""))).alias("text")).distinct()
    newest = rows.agg(F.max("mtime").alias("m"))
    # of equal times the smallest id: a row
    last = rows.join(F.broadcast(newest), F.col("mtime") == F.col("m")).agg(F.min("session_id").alias("session_id"))
    by_age = a.filter(F.col("text").isin(*NEWEST)).join(F.broadcast(last.withColumn("_k", F.lit(1))), F.lit(1) == F.col("_k"), "left")
    by_age = by_age.select("asked", "session_id", F.lit("newest").alias("how"), F.when(F.col("session_id").isNull(), 0).otherwise(1).cast("bigint").alias("n"))
    named = a.filter(~F.col("text").isin(*NEWEST))
    paths = rows.groupBy(F.col("path").alias("text")).agg(F.min("session_id").alias("by_path"))
    starts = rows.select("session_id", F.explode(F.transform(F.sequence(F.lit(1), F.length("session_id")), lambda n: F.substring(F.col("session_id"), F.lit(1), n))).alias("text"))
    met = named.join(starts, "text").groupBy("asked").agg(
        F.count("*").alias("n"), F.max(F.when(F.col("session_id") == F.col("text"), F.col("session_id"))).alias("whole"), F.min("session_id").alias("first"),
    )
    found = named.join(paths, "text", "left").join(met, "asked", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    one = F.coalesce("by_path", "whole", F.when(F.col("n") == 1, F.col("first")))
    how = F.when(F.col("by_path").isNotNull(), "path").when(F.col("whole").isNotNull(), "id").when(F.col("n") == 1, "prefix").when(F.col("n") > 1, "ambiguous").otherwise("none")
    n = F.when(F.coalesce("by_path", "whole").isNotNull(), 1).otherwise(F.col("n"))
    return by_age.unionByName(found.select("asked", one.alias("session_id"), how.alias("how"), n.cast("bigint").alias("n")))


def for_account(rows: DataFrame, session: str | None = None, before: str | None = None, after: str | None = None, project: str | None = None, zone: str = "UTC") -> DataFrame:
    """The sessions that an account is given: by the start of an id; else by when they began; else by project.

    before and after are days (YYYY-MM-DD), from midnight in the zone: before leaves that day out, after takes it in. What
    has no start began when it was last written. rows: session_id, started_at, mtime, project, display.
    """
    if session:
        return rows.filter(F.col("session_id").startswith(session))
    if before or after:
        days = {k: datetime.date.fromisoformat(v) for k, v in (("before", before), ("after", after)) if v}
        began = F.coalesce(F.col("started_at").cast("timestamp"), F.col("mtime").cast("timestamp"))
        midnight = {k: F.to_utc_timestamp(F.lit(str(d)).cast("timestamp_ntz").cast("timestamp"), zone) for k, d in days.items()}
        keep = F.lit(True)
        if "before" in days:
            keep &= began < midnight["before"]
        if "after" in days:
            keep &= began >= midnight["after"]
        return rows.filter(keep)
    if project:
        want = project.rstrip("/")
        return rows.filter((F.regexp_replace(F.coalesce("display", F.lit("")), "/+$", "") == want) | (F.col("project") == want))
    raise ValueError("name a session, days or a project")


def tracked(rows: DataFrame, now_us: int, live: DataFrame, fresh_s: int, most_s: int, grace_s: int, least_size: int = 2) -> DataFrame:
    """Sessions worth following, with why: written within fresh_s, or of a project with a running program that they were written after.

    Nothing older than most_s, and no empty file. rows: session_id, slug, mtime, size; live: slug, since.
    """
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    since = live.groupBy("slug").agg(F.max(us("since")).alias("_since"))
    r = rows.filter(F.col("size") >= least_size).withColumn("_at", us("mtime")).filter(F.lit(now_us) - F.col("_at") <= most_s * 1_000_000).join(since, "slug", "left")
    fresh, held = F.lit(now_us) - F.col("_at") <= fresh_s * 1_000_000, F.coalesce(F.col("_at") >= F.col("_since") - grace_s * 1_000_000, F.lit(False))
    return r.filter(fresh | held).withColumn("why", F.when(fresh, "fresh").otherwise("held")).drop("_at", "_since")


def page(rows: DataFrame, now_us: int, active_s: int, active: bool = False, days: int | None = None, label: str | None = None, n: int = 0) -> DataFrame:
    """A page of a listing with how many the filters left (found): active first, newest first; n of 0 is all.

    rows: session_id, mtime, label. An empty label is all; one that no session has leaves nothing.
    """
    at = F.unix_micros(F.col("mtime").cast("timestamp"))
    r = rows.withColumn("active", F.lit(now_us) - at <= active_s * 1_000_000)
    if label:
        r = r.filter(F.col("label") == label)
    if active:
        r = r.filter("active")
    if days:
        r = r.filter(at >= now_us - days * 86_400_000_000)
    found = r.count()
    first = r.orderBy(F.desc("active"), F.desc("mtime"), "session_id")
    return (first.limit(n) if n else first).withColumn("found", F.lit(found).cast("bigint"))
