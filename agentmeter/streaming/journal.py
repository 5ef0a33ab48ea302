"""The journal of context events: decisions and events appended once, however often a batch comes again, and the epochs they open.

A journal is a folder of batches that all machines share. Each batch has its own folder, written whole or not at all, so a
batch that is replayed after a lost driver takes its own place again; an event that a later batch brings a second time, as a
re-sent hook does, is left out by its id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The columns of the journal. event_id names an event for good; reason is that of a start, or of a decision.
EVENTS = (
    "event_id string, ts timestamp, session_id string, agent_id string, turn bigint, kind string, reason string, path string, "
    "bytes bigint, tokens bigint, saved_tokens bigint, origin string, detail string"
)
#: What begins a window anew (an empty reason is a startup; a resume keeps what the window held); seconds within
#: which a second start is the same one.
RESETS, SAME_S = ("", "startup", "clear", "compact", "fork"), 30
#: Kinds that begin a window, and those that are decisions.
STARTS, DECISIONS = ("start", "compaction"), ("denial", "allowed", "brief", "refusal")


def normal(events: DataFrame) -> DataFrame:
    """events with all columns of the journal: no session is `unknown`, no agent the main one, no count is 0."""
    own = dict(c.split() for c in EVENTS.split(", "))
    has = lambda c, t: F.col(c).cast(t) if c in events.columns else F.lit(None).cast(t)
    empty = {"session_id": "unknown", "agent_id": "", "kind": "", "reason": "", "path": "", "origin": "", "bytes": 0, "tokens": 0, "saved_tokens": 0}
    cols = [F.coalesce(has(c, t), F.lit(empty[c]).cast(t)).alias(c) if c in empty else has(c, t).alias(c) for c, t in own.items()]
    out = events.select(*cols).withColumn("session_id", F.when(F.col("session_id") == "", "unknown").otherwise(F.col("session_id")))
    return out.filter("event_id is not null and ts is not null")


class Journal:
    """Batches of events under a folder; `append` is made for foreachBatch."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._Path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._Path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def batches(self) -> list[int]:
        """The whole batches, in order."""
        if not self._fs.exists(self._Path(self.path)):
            return []
        names = [f.getPath().getName() for f in self._fs.listStatus(self._Path(self.path))]
        return sorted(int(n[6:]) for n in names if n.startswith("batch=") and self._fs.exists(self._Path(f"{self.path}/{n}/_SUCCESS")))

    def read(self, before: int | None = None) -> DataFrame:
        """Every event of the whole batches, of those numbered below before."""
        paths = [f"{self.path}/batch={b}" for b in self.batches() if before is None or b < before]
        return self.spark.read.schema(EVENTS).parquet(*paths) if paths else self.spark.createDataFrame([], EVENTS)

    def append(self, events: DataFrame, batch_id: int) -> None:
        """The events that no earlier batch has, once each; of an id that comes twice in a batch the first by time.

        A batch that is there already stays, so a replay adds nothing; one left half written is written anew.
        """
        if batch_id in self.batches():
            return
        first = F.min_by(F.struct(*[c.split()[0] for c in EVENTS.split(", ")]), F.struct("ts", F.xxhash64("session_id", "agent_id", "kind", "path", "detail")))
        once = normal(events).groupBy("event_id").agg(first.alias("e")).select("e.*")
        once.join(self.read(batch_id).select("event_id"), "event_id", "left_anti").write.mode("overwrite").parquet(f"{self.path}/batch={batch_id}")

    def start(self, events: DataFrame, checkpoint: str):
        """A running query that appends a stream of events."""
        return events.writeStream.foreachBatch(self.append).option("checkpointLocation", checkpoint).start()


def epochs(events: DataFrame) -> DataFrame:
    """events with epoch (from 1) and opens, by session and agent in order of time.

    A start opens an epoch where its reason resets the window, unless the open one began within the last SAME_S seconds; so
    does a compaction. A resume opens none, and what comes before any start stands in an epoch of its own. A start within
    the time is measured from the last that opened one, not from the last that came.
    """
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    key = ["session_id", "agent_id"]
    e = events.withColumn("_us", us).withColumn("_reset", (F.col("kind") == "compaction") | ((F.col("kind") == "start") & F.col("reason").isin(*RESETS)))
    # resets within SAME_S of the one before form a chain; only in a chain does it matter which of them opened
    w = Window.partitionBy(*key).orderBy("_us", "event_id")
    r = e.filter("_reset").select(*key, "event_id", "_us", "kind")
    gap = F.col("_us") - F.lag("_us").over(w)
    r = r.withColumn("_chain", F.sum(F.when(gap < SAME_S * 1_000_000, 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    steps = F.array_sort(F.collect_list(F.struct("_us", "event_id", (F.col("kind") == "compaction").alias("always"))))
    chains = r.groupBy(*key, "_chain").agg(steps.alias("s"))
    fold = F.aggregate(
        "s", F.struct(F.lit(None).cast("bigint").alias("at"), F.expr("cast(array() as array<string>)").alias("ids")),
        lambda a, x: F.when(a["at"].isNull() | x["always"] | (x["_us"] - a["at"] >= SAME_S * 1_000_000), F.struct(x["_us"].alias("at"), F.array_append(a["ids"], x["event_id"]).alias("ids"))).otherwise(a),
    )
    opened = chains.select(*key, F.explode(fold["ids"]).alias("event_id")).withColumn("opens", F.lit(True))
    e = e.join(opened, [*key, "event_id"], "left").withColumn("opens", F.coalesce("opens", F.lit(False)))
    # the first event of a window opens an epoch where no start does
    first = F.row_number().over(w) == 1
    e = e.withColumn("opens", F.col("opens") | first)
    return e.withColumn("epoch", F.sum(F.col("opens").cast("bigint")).over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_us", "_reset")


def epoch_rows(placed: DataFrame) -> DataFrame:
    """One row an epoch: why it began, when it began and ended (null: open), and what it saw. placed: events with epoch and opens."""
    key = ["session_id", "agent_id", "epoch"]
    opener = F.struct("ts", "event_id")
    why = F.when(F.col("kind") == "compaction", "compact").when((F.col("kind") == "start") & (F.col("reason") != ""), F.col("reason")).otherwise("startup")
    g = placed.groupBy(*key).agg(
        F.min("ts").alias("started"), F.min_by(why, opener).alias("reason"), F.count("*").alias("events"), F.count_if(F.col("kind").isin(*DECISIONS)).alias("decisions"),
        F.sum(F.when(F.col("kind") == "read", F.col("tokens")).otherwise(0)).alias("read_tokens"), F.sum("saved_tokens").alias("saved_tokens"),
    )
    ended = F.lead("started").over(Window.partitionBy("session_id", "agent_id").orderBy("epoch"))
    return g.withColumn("ended", ended)


def decisions(events: DataFrame) -> DataFrame:
    """How often what was decided, for what reason, and what it saved."""
    d = events.filter(F.col("kind").isin(*DECISIONS))
    return d.groupBy("kind", "reason").agg(F.count("*").alias("n"), F.countDistinct("session_id").alias("sessions"), F.sum("saved_tokens").alias("saved_tokens"))


def residency(placed: DataFrame, open_only: bool = True) -> DataFrame:
    """What each window holds: session, agent, epoch, path, reads, bytes, tokens; of its newest epoch alone unless told otherwise."""
    reads = placed.filter("kind = 'read' and path <> ''")
    g = reads.groupBy("session_id", "agent_id", "epoch", "path").agg(F.count("*").alias("reads"), F.sum("bytes").alias("bytes"), F.sum("tokens").alias("tokens"))
    if not open_only:
        return g
    newest = placed.groupBy("session_id", "agent_id").agg(F.max("epoch").alias("epoch"))
    return g.join(newest, ["session_id", "agent_id", "epoch"], "left_semi")
