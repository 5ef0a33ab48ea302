"""What the operators of this subpackage share: inputs, folds, shared storage, what workers keep."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable
from typing import Any

from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of most contracts: runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The given table, by a path that Spark's readers open."""
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(key: Column, n: int) -> Column:
    """crc32 of the key as text, modulo n; a null key counts as empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % n


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where it is unset a local session gets a temporary folder; a cluster has no folder that all
    machines see but the one it names, so there it is an error.
    """
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir is unset: name a folder that the driver and all executors share")
        at = tempfile.mkdtemp(prefix="agentmeter-")
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


_written: dict[str, SparkSession] = {}


def saved(df: DataFrame) -> DataFrame:
    """df as a table written in the shared folder and read again: lineage ends here and survives a lost executor.

    The table stays until `forget` or the end of the session. Column names that clash are the
    caller's to resolve: it selects what it needs first.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/agentmeter-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if not _written:
        atexit.register(_forget_all)
    _written[path] = spark
    out = spark.read.schema(df.schema).parquet(path)
    out._saved_at = path
    return out


def forget(*tables: DataFrame) -> None:
    """Deletes tables of `saved` that nothing will read again, results that are still to be made included."""
    for t in tables:
        path = getattr(t, "_saved_at", None)
        if path in _written:
            _delete(_written.pop(path), path)


def _delete(spark: SparkSession, path: str) -> None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def _forget_all() -> None:
    for path, spark in _written.items():
        try:
            _delete(spark, path)
        except Exception:  # the session is gone: the folder is the cluster's to clean
            return


#: Spark's own defaults of the two settings below.
_DEFAULTS = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "1000"), "spark.sql.execution.arrow.maxBytesPerBatch": ("67108864b", str(16 << 20))}


def small_batches(spark: SparkSession) -> None:
    """Texts go to Python in batches small enough that a batch of very long ones fits a worker.

    A setting of the session, as Spark has no other place for it; one that the user changed stays.
    """
    for name, (default, own) in _DEFAULTS.items():
        if spark.conf.get(name, default).lower() == default:
            spark.conf.set(name, own)


def without(docs: DataFrame, *columns: str) -> DataFrame:
    """docs less its own columns that an operator's results would clash with: the results win."""
    clash = {c.lower() for c in columns}
    return docs.select(*[docs[f"`{c}`"] for c in docs.columns if c.lower() not in clash])


def packed(docs: DataFrame) -> Column:
    """All columns of docs in one struct, so that no name of an operator's own meets theirs."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns])


def free_name(docs: DataFrame, name: str) -> str:
    """A column name that docs do not have: the given one, with lines behind it while they do."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def named(docs: DataFrame) -> list[Column]:
    """The columns of docs, whatever signs their names hold."""
    return [F.col(f"`{c}`") for c in docs.columns]


def repeated(rows: DataFrame, times: str, step: int = 1 << 16) -> DataFrame:
    """rows, each as often as its column times says, with _copy from 0; no array is longer than step."""
    n = F.col(times).cast("long")
    lots = rows.withColumn("_lot", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((n - 1) / step))))
    last = F.least(n - F.col("_lot") * step, F.lit(step)) - 1
    return lots.withColumn("_in", F.explode(F.sequence(F.lit(0).cast("long"), last))).withColumn("_copy", F.col("_in") + F.col("_lot") * step).drop("_lot", "_in")


_kept: dict[str, tuple[Broadcast, Any]] = {}


def once(name: str, sent: Broadcast, make: Callable[[Any], Any]) -> Any:
    """What make builds of a broadcast's value, once in a worker process: its later tasks find it there.

    A worker keeps the last such thing only: that of the operator that ran before makes room.
    """
    held = _kept.get(name)
    if held is None or held[0] is not sent:
        make_room()
        _kept[name] = held = (sent, make(sent.value))
    return held[1]


def make_room() -> None:
    """Lets a worker forget what operators before kept in it."""
    _kept.clear()


def merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels (id, comp), written, after one step along links (a, b) between its ids.

    All ids of a label take the smallest label that a link leads to from any of them. Equal labels
    are always connected; connected ones may still differ, which `components` settles.
    """
    ends = links.join(labels.select(F.col("id").alias("a"), F.col("comp").alias("x")), "a").join(labels.select(F.col("id").alias("b"), F.col("comp").alias("y")), "b").filter("x <> y")
    least = ends.select(F.greatest("x", "y").alias("comp"), F.least("x", "y").alias("to")).groupBy("comp").agg(F.min("to").alias("to"))
    return saved(labels.join(least, "comp", "left").select("id", F.coalesce("to", "comp").alias("comp")))


def components(links: DataFrame, start: DataFrame | None = None, max_rounds: int = 50) -> DataFrame:
    """Connected components of links (a, b): a row (id, comp) per node, comp the smallest id it reaches.

    Each round gives a node, and the node that its label names, the smallest label of a label among
    its neighbours, and takes the label of its label: trees hook onto each other whole, so that the
    rounds grow with the logarithm of the longest path. All steps are equi-joins and partial
    aggregates; labels are written to the shared folder each round and those of the round before
    deleted. start: labels (id, comp) of `merged` to go on from; it holds all nodes, those without
    links too, and is deleted.
    """
    edges = saved(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = start if start is not None else saved(edges.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("comp")))
    for _ in range(max_rounds):
        hop = labels.join(labels.select(F.col("id").alias("comp"), F.col("comp").alias("far")), "comp").select("id", "comp", "far")
        near = edges.join(hop.select(F.col("id").alias("b"), "far"), "b").groupBy("a").agg(F.min("far").alias("m"))
        step = hop.join(near.withColumnRenamed("a", "id"), "id", "left")
        given = F.array(F.struct("id", F.least("far", "m").alias("comp"), F.col("comp").alias("was")), F.struct(F.col("comp").alias("id"), F.least("far", "m").alias("comp"), F.lit(None).alias("was")))
        new = saved(step.select(F.explode(given).alias("g")).groupBy("g.id").agg(F.min("g.comp").alias("comp"), F.max("g.was").alias("was")))
        forget(labels)
        if new.filter("comp <> was").isEmpty():
            forget(edges)
            return new.select("id", "comp")
        labels = new.select("id", "comp")
        labels._saved_at = new._saved_at
    raise RuntimeError("the components did not settle")
