"""Registered queries on the event journal, each with its SQL beside it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.searchindex import scratch
from ..sources import facade
from ..streaming import journal

REASONS = ("startup", "resume", "clear", "compact", "fork")


def context_events(spark: SparkSession, d: str) -> DataFrame:
    """Every event as one of a context: signups start windows, views read, purchases are compactions or given leave, errors denials, others briefs."""
    e, k = facade.events(spark, d), F.col("k")
    t = F.col("event_type")
    kind = F.when(t == "signup", "start").when(t == "view", "read").when((t == "purchase") & (k % 10 == 0), "compaction").when(t == "purchase", "allowed").when(t == "error", "denial").otherwise("brief")
    start = F.element_at(F.array(*[F.lit(r) for r in REASONS]), (k % len(REASONS) + 1).cast("int"))
    return e.select(
        F.concat(F.lit("e"), "event_id").alias("event_id"), F.timestamp_micros(F.col("event_id") * 200_000).alias("ts"), F.col("user_id").cast("string").alias("session_id"),
        F.when(F.col("event_id") % 10 >= 7, F.concat(F.lit("a"), F.col("event_id") % 3)).alias("agent_id"), kind.alias("kind"),
        F.when(kind == "start", start).when(k % 2 == 0, "even").otherwise("odd").alias("reason"), F.when(kind == "read", F.concat(F.lit("f"), k % 3)).alias("path"),
        (k * 4).alias("bytes"), k.alias("tokens"), F.when(kind == "denial", k * 7).alias("saved_tokens"), F.col("event_id").alias("n"),
    )


def kept(spark: SparkSession, d: str) -> DataFrame:
    """The journal after three batches, of which the second brings events of the first again and comes twice."""
    e = context_events(spark, d)
    j = journal.Journal(spark, scratch(spark, "journal"))
    for batch, part in ((0, "n % 3 = 0"), (1, "n % 3 = 1 or n % 6 = 0"), (1, "n % 3 = 1 or n % 6 = 0"), (2, "n % 3 = 2")):
        j.append(e.filter(part).drop("n"), batch)
    return j.read()


def k10(spark: SparkSession, d: str) -> DataFrame:
    rows = journal.epoch_rows(journal.epochs(kept(spark, d)))
    return rows.withColumn("started", F.unix_micros("started")).withColumn("ended", F.unix_micros("ended"))


def resident(spark: SparkSession, d: str) -> DataFrame:
    return journal.residency(journal.epochs(kept(spark, d)))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"k09_decisions": lambda s, d: journal.decisions(kept(s, d)), "k10_journal": k10, "t15_residency": resident}


_J = f""", ce0 AS (SELECT event_id AS n, 'e' || event_id AS event_id, event_id * 200000 AS us, CAST(user_id AS VARCHAR) AS session_id, CASE WHEN event_id % 10 >= 7 THEN 'a' || (event_id % 3) ELSE '' END AS agent_id, k,
      CASE WHEN event_type = 'signup' THEN 'start' WHEN event_type = 'view' THEN 'read' WHEN event_type = 'purchase' THEN CASE WHEN k % 10 = 0 THEN 'compaction' ELSE 'allowed' END WHEN event_type = 'error' THEN 'denial' ELSE 'brief' END AS kind FROM ev),
    ce AS (SELECT *, CASE WHEN kind = 'start' THEN {list(REASONS)}[k % 5 + 1] WHEN k % 2 = 0 THEN 'even' ELSE 'odd' END AS reason, CASE WHEN kind = 'read' THEN 'f' || (k % 3) ELSE '' END AS path, CASE WHEN kind = 'denial' THEN k * 7 ELSE 0 END AS saved FROM ce0)"""
_E = _J + """, rs AS (SELECT session_id, agent_id, us, event_id, kind, row_number() OVER (PARTITION BY session_id, agent_id ORDER BY us, event_id) AS i FROM ce WHERE kind = 'compaction' OR (kind = 'start' AND reason <> 'resume')),
    st AS (SELECT session_id, agent_id, i, event_id, us AS opened, true AS opens FROM rs WHERE i = 1 UNION ALL
      SELECT rs.session_id, rs.agent_id, rs.i, rs.event_id, CASE WHEN rs.kind = 'compaction' OR rs.us - st.opened >= 30000000 THEN rs.us ELSE st.opened END, rs.kind = 'compaction' OR rs.us - st.opened >= 30000000
      FROM st JOIN rs ON rs.session_id = st.session_id AND rs.agent_id = st.agent_id AND rs.i = st.i + 1),
    ep AS (SELECT *, sum(CASE WHEN o THEN 1 ELSE 0 END) OVER (PARTITION BY session_id, agent_id ORDER BY us, event_id) AS epoch FROM
      (SELECT ce.*, coalesce(st.opens, false) OR row_number() OVER (PARTITION BY ce.session_id, ce.agent_id ORDER BY us, ce.event_id) = 1 AS o FROM ce LEFT JOIN st USING (event_id)))"""
BODY = {
    "k09_decisions": _J + " SELECT kind, reason, count(*) AS n, count(DISTINCT session_id) AS sessions, CAST(sum(saved) AS BIGINT) AS saved_tokens FROM ce WHERE kind IN ('denial', 'allowed', 'brief') GROUP BY 1, 2",
    "k10_journal": _E + """, g AS (SELECT session_id, agent_id, CAST(epoch AS BIGINT) AS epoch, min(us) AS started, arg_min(CASE WHEN kind = 'compaction' THEN 'compact' WHEN kind = 'start' THEN reason ELSE 'startup' END, (us, event_id)) AS reason, count(*) AS events,
        count(*) FILTER (kind IN ('denial', 'allowed', 'brief')) AS decisions, CAST(sum(CASE WHEN kind = 'read' THEN k ELSE 0 END) AS BIGINT) AS read_tokens, CAST(sum(saved) AS BIGINT) AS saved_tokens FROM ep GROUP BY 1, 2, 3)
        SELECT *, lead(started) OVER (PARTITION BY session_id, agent_id ORDER BY epoch) AS ended FROM g""",
    "t15_residency": _E + """ SELECT session_id, agent_id, CAST(epoch AS BIGINT) AS epoch, path, count(*) AS reads, CAST(sum(k * 4) AS BIGINT) AS bytes, CAST(sum(k) AS BIGINT) AS tokens FROM ep JOIN (SELECT session_id, agent_id, max(epoch) AS epoch FROM ep GROUP BY 1, 2) USING (session_id, agent_id, epoch) WHERE kind = 'read' GROUP BY 1, 2, 3, 4""",
}


def sql(facts: str) -> dict[str, str]:
    return {k: facts.replace("WITH ev", "WITH RECURSIVE ev", 1) + v for k, v in BODY.items()}
