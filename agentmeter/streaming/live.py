"""Live totals of sessions from a stream of request snapshots.

A later snapshot of a request with more output replaces what the earlier one added: each batch
keeps the best snapshot of every request it brings, beside those of the state table, and the
totals are sums over requests. Batch and stream give the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


def best(snaps: DataFrame) -> DataFrame:
    """One row a request: the snapshot with most output, the earlier on ties."""
    w = Window.partitionBy("session_id", "request_id").orderBy(F.desc("output_tokens"), "ts", "line")
    return snaps.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def totals(requests: DataFrame) -> DataFrame:
    return requests.groupBy("session_id").agg(F.count("*").alias("calls"), F.sum("output_tokens").alias("output_tokens"), F.max("ts").alias("last_activity"))


def run(spark: SparkSession, stream: DataFrame, state: str, checkpoint: str) -> None:
    """Drains the stream; state holds the last two Parquet versions, each written whole before it is named current.

    A batch writes all requests again: for replays and small states. `live_rows` keeps state by key.
    """

    def merge(batch: DataFrame, epoch: int) -> None:
        before = spark.read.parquet(f"{state}/v{epoch - 1}") if epoch else None
        both = best(batch) if before is None else best(before.unionByName(batch))
        both.write.mode("overwrite").parquet(f"{state}/v{epoch}")
        if epoch > 1:  # the version before stays, for a batch that is done again
            old = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{state}/v{epoch - 2}")
            old.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(old, True)

    stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def windowed_spend(stream: DataFrame, late: str = "1 day", size: str = "15 minutes", slide: str = "5 minutes") -> DataFrame:
    """Output tokens in sliding windows of event time; rows later than the watermark are dropped."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", size, slide), "session_id").agg(F.sum("output_tokens").alias("output_tokens"))


def session_runs(stream: DataFrame, gap: str = "600 seconds", late: str = "1 day") -> DataFrame:
    """Stretches of a session without an idle gap."""
    return stream.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "session_id").agg(F.count("*").alias("calls"))


class Totals(StatefulProcessor):
    """The running totals of a session: a larger snapshot of a request takes back what the smaller one gave.

    State of a session: each request's best snapshot, tools seen, totals. A session that stays quiet
    for idle_s after its last request, by the watermark, gets its final row and gives up its state;
    one that speaks again starts anew, as a later run.
    """

    def __init__(self, idle_s: int = 300):
        self.idle_us = idle_s * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.best = handle.getMapState("best", "request_id long", "output_tokens long")
        self.tools = handle.getMapState("tools", "tool_use_id string", "seen boolean")
        self.total = handle.getValueState("total", "calls long, output_tokens long, tools long, last_us long")

    def _row(self, key: tuple, state: tuple, final: bool) -> pd.DataFrame:
        calls, tokens, tools, last = state
        row = {"session_id": key[0], "calls": calls, "output_tokens": tokens, "tools": tools, "last_us": last, "final": final}
        return pd.DataFrame([row])

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        calls, tokens, tools, last = self.total.get() if self.total.exists() else (0, 0, 0, 0)
        for batch in rows:
            for r in batch.itertuples(index=False):
                rid, n = (int(r.request_id),), int(r.output_tokens)
                known = self.best.containsKey(rid)
                before = int(self.best.getValue(rid)[0]) if known else 0
                if not known or n > before:
                    tokens += n - before
                    self.best.updateValue(rid, (n,))
                calls += not known
                if r.tool_use_id is not None and not self.tools.containsKey((r.tool_use_id,)):
                    self.tools.updateValue((r.tool_use_id,), (True,))
                    tools += 1
                last = max(last, int(r.ts.value // 1000))
        self.total.update((calls, tokens, tools, last))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer((last + self.idle_us) // 1000)
        yield self._row(key, (calls, tokens, tools, last), False)

    def handleExpiredTimer(self, key: tuple, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        yield self._row(key, self.total.get(), True)
        for state in (self.best, self.tools, self.total):
            state.clear()

    def close(self) -> None:
        pass


def live_rows(stream: DataFrame, idle_s: int = 300, late: str = "10 minutes") -> DataFrame:
    """A row of a session whenever it changes, and its final one. stream: session_id, request_id, output_tokens, tool_use_id, ts.

    State is kept by RocksDB (spark.sql.streaming.stateStore.providerClass), so that it may outgrow memory.
    """
    rows = stream.select("session_id", "request_id", "output_tokens", "tool_use_id", "ts").withWatermark("ts", late)
    schema = f"session_id {dict(stream.dtypes)['session_id']}, calls long, output_tokens long, tools long, last_us long, final boolean"
    return rows.groupBy("session_id").transformWithStateInPandas(Totals(idle_s), schema, "Update", "EventTime")


#: Dollars in state are whole hundred-thousandths of a millionth, the places of a price.
UNIT = 100_000
#: A run's first request may be stamped before the run's own start.
LEAD_US = 120_000_000
#: Requests and instants of a session that a call holds before it writes them.
MOST_HELD = 100_000


class Dollars(StatefulProcessor):
    """The dollars of a session against billing snapshots that may come before or long after the requests.

    State of a session: each request's best snapshot; the dollars at each instant; the latest checkpoint of each run; totals with
    two edges. A larger snapshot takes back what the smaller one gave. What lies before the left edge or after the right one
    is beyond the checkpoints; a request falls to its side at once, and when an edge moves (another checkpoint, or a main
    request that one of them bills) the instants are added up anew. So any split into batches ends in the same rows.

    Rows name the file's epoch (it grows when a file is cut short or replaced) and the catalog's version: a
    higher pair takes the place of all that is held, rows of a lower one are too late and fall away. A session
    quiet for idle_s gets a row with final; its state stays, so that it may go on, until forget_s have
    passed: then requests give up their snapshots and the totals stay, and what still comes is new.
    """

    def __init__(self, idle_s: int = 300, forget_s: int = 7 * 86_400):
        self.idle_us, self.forget_us = idle_s * 1_000_000, forget_s * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.best = handle.getMapState("best", "request_id long", "output_tokens long, units long, ts_us long, main boolean")
        self.instants = handle.getMapState("instants", "ts_us long", "units long, calls long")
        self.runs = handle.getMapState("runs", "run_us long", "duration long, ord long, units long, billed_us long")
        self.total = handle.getValueState("total", "epoch long, version long, calls long, units long, last_us long, last_main_us long, lo_us long, mark_us long, early long, late long, reported long, kept_us long")

    def _clear(self) -> None:
        for state in (self.best, self.instants, self.runs, self.total):
            state.clear()
        self._hold(None)

    def _hold(self, runs: dict[int, tuple] | None) -> None:
        """What a call has read and changed, so that a key is read and written once; runs None: nothing is in state yet."""
        self.is_empty, self.held_runs = runs is None, runs or {}
        self.held_best: dict[int, tuple | None] = {}
        self.held_instants: dict[int, tuple | None] = {}
        self.new_best: set[int] = set()
        self.new_instants: set[int] = set()

    def _read(self, held: dict[int, tuple | None], state: Any, key: int) -> tuple | None:
        if key not in held:
            held[key] = tuple(state.getValue((key,))) if not self.is_empty and state.containsKey((key,)) else None
        return held[key]

    def _write(self) -> None:
        """Puts what has changed into state, and lets go of it."""
        for rid in self.new_best:
            self.best.updateValue((rid,), self.held_best[rid])
        for ts in self.new_instants:
            if self.held_instants[ts] is not None:
                self.instants.updateValue((ts,), self.held_instants[ts])
            elif not self.is_empty and self.instants.containsKey((ts,)):
                self.instants.removeKey((ts,))
        runs, wrote = self.held_runs, bool(self.new_best or self.new_instants)
        self._hold(runs if wrote or runs or not self.is_empty else None)

    def _put(self, units: int, ts: int, calls: int) -> None:
        was = self._read(self.held_instants, self.instants, ts) or (0, 0)
        now = (int(was[0]) + units, int(was[1]) + calls)
        self.held_instants[ts] = None if now == (0, 0) else now
        self.new_instants.add(ts)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        names = ("epoch", "version", "calls", "units", "last_us", "last_main_us", "lo_us", "mark_us", "early", "late", "reported", "kept_us")
        t = dict(zip(names, self.total.get(), strict=True)) if self.total.exists() else None
        is_new, moved = t is None, False
        self._hold(None if is_new else {int(k[0]): tuple(v) for k, v in self.runs.iterator()})
        for batch in rows:
            if len(self.held_best) + len(self.held_instants) > MOST_HELD:
                self._write()
            for r in batch.itertuples(index=False):
                name = (int(r.epoch), int(r.version))
                if t is None or name > (t["epoch"], t["version"]):
                    self._clear()
                    t = dict.fromkeys(names, 0) | {"epoch": name[0], "version": name[1], "lo_us": None, "mark_us": None, "last_main_us": None, "reported": None}
                elif name < (t["epoch"], t["version"]):
                    continue
                moved |= self._checkpoint(r) if r.kind == "checkpoint" else self._request(r, t)
        self._write()
        if moved:
            self._edges(t)
        self.total.update(tuple(t[n] for n in names))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer((t["last_us"] + self.idle_us) // 1000)
        yield self._row(key, t, is_new, False)

    def _checkpoint(self, r: Any) -> bool:
        run, new = int(r.run_us), (int(r.duration), int(r.ord))
        was = self.held_runs.get(run)
        if was is not None and (int(was[0]), int(was[1])) >= new:
            return False
        self.held_runs[run] = (*new, int(r.units), None)
        self.runs.updateValue((run,), self.held_runs[run])
        return True

    def _request(self, r: Any, t: dict) -> bool:
        """Takes a snapshot in; whether an edge may have moved."""
        rid, n, ts, units, main = int(r.ord), int(r.output_tokens), int(r.ts.value // 1000), int(r.units), bool(r.main)
        moved = False
        if (was := self._read(self.held_best, self.best, rid)) is not None:
            out, old_units, old_ts, old_main = was
            if (n, -ts) <= (int(out), -int(old_ts)):
                return False
            self._side(t, -int(old_units), int(old_ts))
            self._put(-int(old_units), int(old_ts), -1)
            t["units"] -= int(old_units)
            t["calls"] -= 1
            moved = bool(old_main) or main
        self.held_best[rid] = (n, units, ts, main)
        self.new_best.add(rid)
        self._put(units, ts, 1)
        self._side(t, units, ts)
        t["units"] += units
        t["calls"] += 1
        t["last_us"] = max(t["last_us"], ts)
        if main:
            # behind what every run billed it can only open the right edge, which is read from the last main request
            t["last_main_us"] = max(ts, t["last_main_us"] or ts)
            moved |= any(rid <= int(v[1]) for v in self.held_runs.values())
        return moved

    @staticmethod
    def _side(t: dict, units: int, ts: int) -> None:
        if t["lo_us"] is not None and ts < t["lo_us"]:
            t["early"] += units
        elif t["mark_us"] is not None and ts > t["mark_us"]:
            t["late"] += units

    def _edges(self, t: dict) -> None:
        """Both edges and what lies beyond them, from what is held."""
        runs = [(int(k[0]), v) for k, v in self.runs.iterator()]
        mains = [(int(k[0]), int(v[2])) for k, v in self.best.iterator() if v[3]]
        marks = [max((ts for rid, ts in mains if rid <= int(v[1])), default=None) for _, v in runs]
        marks = [m for m in marks if m is not None]
        t["last_main_us"] = max((ts for _, ts in mains), default=None)
        t["lo_us"] = min((k for k, _ in runs), default=None)
        t["lo_us"] = None if t["lo_us"] is None else t["lo_us"] - LEAD_US
        t["mark_us"] = max(marks, default=None)
        t["reported"] = sum(int(v[2]) for _, v in runs) if runs else None
        t["early"] = t["late"] = 0
        for k, v in self.instants.iterator():
            self._side(t, int(v[0]), int(k[0]))

    def _row(self, key: tuple, t: dict, is_new: bool, final: bool) -> pd.DataFrame:
        # without a main request behind the mark the right edge falls away
        late = t["late"] if t["mark_us"] is not None and t["last_main_us"] is not None and t["last_main_us"] > t["mark_us"] else 0
        beyond = t["units"] if t["reported"] is None else t["early"] + late
        row = {"session_id": key[0], "epoch": t["epoch"], "version": t["version"], "calls": t["calls"], "computed": t["units"], "beyond": beyond, "reported": t["reported"], "last_us": t["last_us"], "is_new": is_new, "final": final}
        return pd.DataFrame([row]).astype({"reported": "Int64"})

    def handleExpiredTimer(self, key: tuple, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        names = ("epoch", "version", "calls", "units", "last_us", "last_main_us", "lo_us", "mark_us", "early", "late", "reported", "kept_us")
        t = dict(zip(names, self.total.get(), strict=True))
        if t["kept_us"] == t["last_us"]:  # the second timer since it last spoke
            self.best.clear()
            return
        t["kept_us"] = t["last_us"]
        self.total.update(tuple(t[n] for n in names))
        self.handle.registerTimer((t["last_us"] + self.forget_us) // 1000)
        yield self._row(key, t, False, True)

    def close(self) -> None:
        pass


LINES = "session_id {}, epoch long, version long, kind string, ord long, output_tokens long, units long, main boolean, ts timestamp, run_us long, duration long"


def lines(priced: DataFrame, checkpoints: DataFrame, epoch: int = 0, version: int = 0) -> DataFrame:
    """Requests with their price and checkpoints in one table, as `live_dollars` reads them."""
    name = [F.lit(epoch).cast("long").alias("epoch"), F.lit(version).cast("long").alias("version")]
    no = lambda kind: F.lit(None).cast(kind)
    ts = F.col("ts").cast("timestamp").alias("ts")
    asked = priced.select("session_id", *name, F.lit("request").alias("kind"), F.col("request_id").cast("long").alias("ord"), F.col("output_tokens").cast("long").alias("output_tokens"), (F.col("m_total") * UNIT).cast("long").alias("units"), (F.col("origin") == "main").alias("main"), ts, no("long").alias("run_us"), no("long").alias("duration"))
    run = F.unix_micros(F.col("run_start").cast("timestamp")).alias("run_us")
    at = F.timestamp_micros(F.unix_micros(F.col("run_start").cast("timestamp")) + F.col("duration")).alias("ts")
    told = checkpoints.select("session_id", *name, F.lit("checkpoint").alias("kind"), F.col("ord").cast("long").alias("ord"), no("long").alias("output_tokens"), (F.col("reported") * UNIT).cast("long").alias("units"), F.lit(False).alias("main"), at, run, F.col("duration").cast("long").alias("duration"))
    return asked.unionByName(told)


def live_dollars(stream: DataFrame, idle_s: int = 300, forget_s: int = 7 * 86_400, late: str = "10 minutes") -> DataFrame:
    """A row of a session whenever it changes: calls, computed, beyond (what no checkpoint covers), reported, in UNITs of micro-USD; is_new, final.

    stream: LINES. Spark drops rows whose ts lies further behind the newest than `late`: a replay in any order sets it beyond its span.
    """
    rows = stream.withWatermark("ts", late)
    schema = f"session_id {dict(stream.dtypes)['session_id']}, epoch long, version long, calls long, computed long, beyond long, reported long, last_us long, is_new boolean, final boolean"
    return rows.groupBy("session_id").transformWithStateInPandas(Dollars(idle_s, forget_s), schema, "Update", "EventTime")


def dollars(newest: DataFrame) -> DataFrame:
    """The rows of `live_dollars` in the terms of the batch reconciliation: what counts, where it comes from, how well both agree."""
    usd = lambda c: (F.col(c).cast("decimal(28,0)") * F.lit("0.00001").cast("decimal(6,5)")).cast("double") / 1e6
    g = newest.select("session_id", usd("reported").alias("reported_usd"), usd("computed").alias("computed_usd"), (usd("computed") - usd("beyond")).alias("covered_usd"), usd("beyond").alias("open_usd"))
    none = F.col("reported_usd").isNull()
    drift = F.expr("abs(reported_usd - covered_usd) / nullif(reported_usd, 0)")
    g = g.withColumn("usd", F.when(none, F.col("computed_usd")).otherwise(F.col("reported_usd") + F.col("open_usd")))
    g = g.withColumn("source", F.when(none, "computed").when(F.col("open_usd") > 0, "mixed").otherwise("reported"))
    return g.withColumn("status", F.when(none, "unavailable").when(F.col("open_usd") > 0.05 * F.col("computed_usd"), "partial").when(drift <= 0.02, "ok").otherwise("drift"))


#: What the streams need of a session while they run: state that may outgrow memory.
_STATE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


def drained_dollars(segments: list[DataFrame], folder: str, partitions: int = 8, **settings: Any) -> DataFrame:
    """Each session's newest row after a stream over the segments, a batch each, written under `folder`; partitions: of the state."""
    spark = segments[0].sparkSession
    own = _STATE | {"spark.sql.shuffle.partitions": str(partitions)}
    was = {k: spark.conf.get(k, None) for k in own}
    for k, v in own.items():
        spark.conf.set(k, v)
    try:
        for i, part in enumerate(segments):
            part.write.mode("append").parquet(f"{folder}/in")
            stream = dollars_stream(spark, f"{folder}/in", part.schema, **settings)

            def keep(batch: DataFrame, epoch: int) -> None:
                batch.withColumn("batch", F.lit(epoch)).write.mode("overwrite").parquet(f"{folder}/out/of={epoch}")

            stream.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    finally:
        for k, v in was.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    out = spark.read.parquet(f"{folder}/out")
    rest = [c for c in out.columns if c not in ("session_id", "of")]
    return out.groupBy("session_id").agg(F.max_by(F.struct(*rest), F.struct("batch", ~F.col("final"))).alias("r")).select("session_id", "r.*")


def dollars_stream(spark: SparkSession, path: str, schema: Any, **settings: Any) -> DataFrame:
    return live_dollars(spark.readStream.schema(schema).parquet(path), **settings)
