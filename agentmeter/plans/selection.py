"""Registered queries on the selection of sessions, each with its SQL beside it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import selection
from ..sources import facade

DAY, HOUR = 86_400, 3_600


def rows(spark: SparkSession, d: str) -> DataFrame:
    """A user as a session, named by a digest, in one of seven projects."""
    g = facade.events(spark, d).groupBy("user_id").agg(F.min("ts").alias("started_at"), F.max("ts").alias("mtime"), F.count("*").alias("size"))
    u = F.col("user_id")
    return g.select(
        F.md5(u.cast("string")).alias("session_id"), F.concat(F.lit("/t/"), u, F.lit(".jsonl")).alias("path"), F.concat(F.lit("p"), u % 7).alias("slug"),
        F.when(u % 2 == 0, "primary").otherwise("secondary").alias("label"), "started_at", "mtime", "size",
    )


def now_us(r: DataFrame) -> int:
    return r.agg(F.max(F.unix_micros(F.col("mtime").cast("timestamp")))).first()[0] or 0


def f15(spark: SparkSession, d: str) -> DataFrame:
    """Every session asked for by its path, its id, and the first one, three and five signs of it; and the newest."""
    r = rows(spark, d)
    forms = [F.col("path"), F.col("session_id"), *[F.substring("session_id", 1, n) for n in (1, 3, 5)], F.lit("last"), F.lit("nobody")]
    return selection.selected(r, r.select(F.explode(F.array(*forms)).alias("asked")))


def f16(spark: SparkSession, d: str) -> DataFrame:
    """Sessions written within an hour of the newest, or of a project that runs, of two days at most."""
    r = rows(spark, d)
    live = r.filter("slug in ('p1', 'p3', 'p4')").groupBy("slug").agg((F.max("mtime") - F.expr("interval 6 hours")).alias("since"))
    return selection.tracked(r, now_us(r), live, HOUR, 2 * DAY, 60, 3).select("session_id", "slug", "size", "why")


def f04(spark: SparkSession, d: str) -> DataFrame:
    r = rows(spark, d)
    return selection.page(r, now_us(r), 6 * HOUR, False, 3, "primary", 50).select("session_id", "active", "found")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"f15_selected": f15, "f16_tracked": f16, "f04_page": f04}


_R = """, r AS (SELECT md5(CAST(user_id AS VARCHAR)) AS session_id, '/t/' || user_id || '.jsonl' AS path, 'p' || (user_id % 7) AS slug, CASE WHEN user_id % 2 = 0 THEN 'primary' ELSE 'secondary' END AS label, min(ts) AS started_at, max(ts) AS mtime, count(*) AS size FROM ev GROUP BY user_id),
    nw AS (SELECT max(mtime) AS t FROM r)"""
BODY = {
    "f15_selected": _R + """, a AS (SELECT DISTINCT left(session_id, l) AS asked FROM r, (VALUES (1), (3), (5)) AS v(l)), m AS (SELECT asked, count(*) AS n, min(session_id) AS s FROM a JOIN r ON starts_with(session_id, asked) GROUP BY 1)
        SELECT path AS asked, session_id, 'path' AS how, 1::BIGINT AS n FROM r UNION ALL SELECT session_id, session_id, 'id', 1 FROM r UNION ALL SELECT 'last', min(session_id), 'newest', 1 FROM r WHERE mtime = (SELECT t FROM nw) UNION ALL SELECT 'nobody', NULL, 'none', 0
        UNION ALL SELECT asked, CASE WHEN n = 1 THEN s END, CASE WHEN n = 1 THEN 'prefix' ELSE 'ambiguous' END, n FROM m""",
    "f16_tracked": _R + """, l AS (SELECT slug, max(mtime) - INTERVAL 6 HOUR AS since FROM r WHERE slug IN ('p1', 'p3', 'p4') GROUP BY 1), j AS (SELECT r.*, (SELECT t FROM nw) - mtime <= INTERVAL 1 HOUR AS fresh, coalesce(mtime >= since - INTERVAL 60 SECOND, false) AS held FROM r LEFT JOIN l USING (slug)
        WHERE size >= 3 AND epoch_us((SELECT t FROM nw)) - epoch_us(mtime) <= 172800000000) SELECT session_id, slug, size, CASE WHEN fresh THEN 'fresh' ELSE 'held' END AS why FROM j WHERE fresh OR held""",
    "f04_page": _R + """, p AS (SELECT session_id, mtime, epoch_us((SELECT t FROM nw)) - epoch_us(mtime) <= 21600000000 AS active FROM r WHERE label = 'primary' AND epoch_us((SELECT t FROM nw)) - epoch_us(mtime) <= 259200000000)
        SELECT session_id, active, (SELECT count(*) FROM p) AS found FROM p ORDER BY active DESC, mtime DESC, session_id LIMIT 50""",
}


def sql(facts: str) -> dict[str, str]:
    return {k: facts + v for k, v in BODY.items()}
