"""A kept inverted index over files of chunks with five weighted fields: updated by what changed, searched by its terms' buckets.

The index is a folder of tables. A run writes one generation: the postings of the files that are
new or changed, partitioned by bucket; the ids whose older postings are dead; the state of all
files; last a row in `runs`, which makes the generation count. A run that fails before leaves
nothing that a reader sees. Postings are never changed in place: a posting is dead if a later
generation names its file. `compact` writes the living ones as one generation.

A word's bucket is that of its first PREFIX letters, so that a prefix of a query and all words that begin with it
lie in one bucket: a search reads the buckets of its terms and no texts. Which words stand for a
query's keys is found on the distinct words of those buckets.

Defined results: a null field is empty; a file without chunks has no postings; of rows that repeat an id in
a listing one counts; queries without a term have no rows; an empty index finds nothing. Whole
identifiers match by their parts: words hold letters and digits alone.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .search import MOST_TERMS, PREFIX, ranked, scratch_table, sent, split_identifier

#: The fields and what a word in them weighs.
WEIGHTS = {"path": 3.0, "symbol": 8.0, "heading": 4.0, "body": 1.0, "terms": 1.5}
#: Identifiers of a chunk, and words of a query.
IDENTIFIER, QUERY_WORD = r"([A-Za-z_][A-Za-z0-9_]{1,63})", r"([A-Za-z0-9_./$-]{2,})"
WORD = r"([\p{L}\p{N}]+)"
MOST_CHUNK_TERMS = 320


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder that all machines share: in spark.checkpoint.dir, in a local session without one a temporary one."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is unset: name a folder that the driver and all executors share")
        at = tempfile.mkdtemp(prefix="agentmeter-")
        spark.sparkContext.setCheckpointDir(at)
    return f"{at.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), 1)


def terms(text: Column, most: int = MOST_CHUNK_TERMS) -> Column:
    """The distinct parts of a text's identifiers, in the order they first come."""
    # an identifier is split once, however often it stands in the text
    own = F.transform(F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(IDENTIFIER), 1)), split_identifier)
    return F.slice(F.array_distinct(F.flatten(own)), 1, most)


def _of_field(found: Column, field: str) -> Column:
    return F.transform(found, lambda x: F.struct(x.alias("word"), F.lit(field).alias("field")))


def query_keys(queries: DataFrame) -> DataFrame:
    """query_id, key: parts of a query's words, and those of PREFIX letters or more as prefixes too, with * behind; the first of each query."""
    found = F.transform(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(QUERY_WORD), 1), lambda w: F.regexp_replace(w, "^[-./]+|[-./]+$", ""))
    parts = F.filter(F.array_distinct(F.flatten(F.transform(found, split_identifier))), lambda p: p.rlike("^[a-z0-9]{2,}$"))
    keys = F.flatten(F.transform(parts, lambda p: F.when(F.length(p) >= PREFIX, F.array(p, F.concat(p, F.lit("*")))).otherwise(F.array(p))))
    return queries.select("query_id", F.explode(F.slice(keys, 1, MOST_TERMS)).alias("key"))


def keys_of_words(vocabulary: DataFrame, keys: DataFrame) -> DataFrame:
    """word, key: which keys a distinct word stands for, itself and the wanted prefixes."""
    lengths = sorted(r[0] for r in keys.filter("endswith(key, '*')").select(F.length("key") - 1).distinct().collect())  # of words: few
    starts = F.filter(F.array(*[F.lit(n) for n in lengths]).cast("array<int>"), lambda n: n <= F.length("word"))
    both = F.concat(F.array(F.col("word")), F.transform(starts, lambda n: F.concat(F.col("word").substr(F.lit(1), n), F.lit("*"))))
    return vocabulary.select("word", F.explode(both).alias("key")).join(keys.select("key").distinct(), "key", "left_semi")


class SearchIndex:
    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets

    # --- tables

    def _there(self, name: str) -> bool:
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(at)

    def _drop(self, name: str) -> None:
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)

    def runs(self) -> DataFrame | None:
        """A row a run: gen, base (the first generation that readers need), and its counts."""
        return self.spark.read.parquet(f"{self.path}/runs") if self._there("runs") else None

    def _last(self) -> tuple[int, int]:
        runs = self.runs()
        last = runs.orderBy(F.desc("gen")).first() if runs is not None else None
        return (last.gen, last.base) if last else (0, 1)

    def files(self) -> DataFrame | None:
        """id, size, mtime, digest, path, lang, chunks, length of each file that is indexed."""
        gen, _ = self._last()
        return self.spark.read.parquet(f"{self.path}/files/gen={gen}") if gen else None

    def _generations(self, name: str) -> DataFrame:
        """A table over the generations that count."""
        gen, base = self._last()
        there = [f"{self.path}/{name}/gen={g}" for g in range(base, gen + 1)]
        own = f"id {self.files().schema['id'].dataType.simpleString()}, gen int"  # named, as a generation may have no row
        if name == "postings":
            own += f", chunk int, word string, length int, tf struct<{', '.join(f'{f}: int' for f in WEIGHTS)}>, bucket int"
        return self.spark.read.schema(own).option("basePath", f"{self.path}/{name}").parquet(*there)

    def postings(self, buckets: list[int] | None = None) -> DataFrame:
        """The living postings: id, chunk, word, tf (by field), length, bucket, gen; of some buckets only where asked."""
        p = self._generations("postings")
        if buckets is not None:
            p = p.filter(F.col("bucket").isin(buckets))
        dead = self._generations("dead").groupBy("id").agg(F.max("gen").alias("_until"))
        return p.join(dead, (p.id == dead.id) & (p.gen < dead["_until"]), "left_anti")

    # --- writing

    def update(self, listing: DataFrame, read: Callable[[DataFrame], DataFrame]) -> dict[str, int]:
        """Brings the index to the listing's state: one generation; its counts.

        listing: id, size, mtime, path, lang of all files there are. read gives id, text and, in rows of their own, chunk, symbol, heading,
        body for a table of ids: it is asked for files alone whose size or time differs from what is
        known, and of these only those whose text has another digest are indexed anew.
        """
        gen, base = self._last()
        gen += 1
        now = listing.dropDuplicates(["id"]).select("id", "size", "mtime", "path", "lang")
        known = self.files()
        if known is None:
            known = now.select("id", "size", "mtime", F.lit("").alias("digest"), "path", "lang", F.lit(0).cast("long").alias("chunks"), F.lit(0).cast("long").alias("length")).filter("false")
        old = known.select("id", F.col("size").alias("_size"), F.col("mtime").alias("_mtime"), F.col("digest").alias("_digest"), F.col("path").alias("_path"))
        met = now.join(old, "id", "left")
        same = F.col("_digest").isNotNull() & F.col("size").eqNullSafe(F.col("_size")) & F.col("mtime").eqNullSafe(F.col("_mtime")) & F.col("path").eqNullSafe(F.col("_path"))
        asked = self._kept(met.filter(~same), gen, "asked")
        chunks = read(asked.select("id"))
        chunks = chunks.select("id", F.col("chunk").cast("int").alias("chunk"), *[F.coalesce(c, F.lit("")).alias(c) for c in ("symbol", "heading", "body")])
        bodies = chunks.groupBy("id").agg(F.sha2(F.to_json(F.sort_array(F.collect_list(F.struct("chunk", "symbol", "heading", "body")))), 256).alias("digest"), F.count("*").alias("chunks"))
        judged = asked.join(bodies, "id", "left").withColumn("digest", F.coalesce("digest", F.lit(""))).withColumn("chunks", F.coalesce("chunks", F.lit(0)))
        touched = (F.col("digest") == F.coalesce("_digest", F.lit("?"))) & F.col("path").eqNullSafe(F.col("_path"))
        judged = self._kept(judged.withColumn("fresh", ~touched), gen, "judged")
        fresh = judged.filter("fresh")
        # postings: a row for each word of a chunk, with how often it stands in each field; a chunk is counted where it lies.
        # explode_outer, as before an explode Spark asks whether the array is empty, and so makes it twice
        c = chunks.join(fresh.select("id", "path"), "id").repartition("id", "chunk")
        own = {"path": words(F.col("path")), "symbol": words(F.col("symbol")), "heading": words(F.col("heading")), "body": words(F.col("body")), "terms": F.flatten(F.transform(terms(F.concat_ws(" ", "body", "symbol", "path")), lambda t: F.regexp_extract_all(t, F.lit(WORD), 1)))}
        all_words = F.concat(*[_of_field(w, f) for f, w in own.items()])
        c = c.select("id", "chunk", all_words.alias("w")).withColumn("length", F.size("w"))
        p = c.select("id", "chunk", "length", F.explode_outer("w").alias("w")).filter("w.word is not null").groupBy("id", "chunk", F.col("w.word").alias("word"))
        p = p.agg(F.max("length").alias("length"), F.struct(*[F.count_if(F.col("w.field") == f).cast("int").alias(f) for f in WEIGHTS]).alias("tf"))
        bucket = F.pmod(F.xxhash64(F.substring("word", 1, PREFIX)), F.lit(self.buckets)).cast("int")
        p = p.withColumn("bucket", bucket)
        p.repartition("bucket", F.pmod(F.xxhash64("id", "chunk"), F.lit(8))).write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/postings/gen={gen}")
        # dead: what was there and is indexed anew or gone
        gone = old.join(now.select("id"), "id", "left_anti").select("id")
        fresh.filter("_digest is not null").select("id").unionByName(gone).write.mode("overwrite").parquet(f"{self.path}/dead/gen={gen}")
        # a file's length is what its postings count; one without words has none
        made = self.spark.read.schema(p.schema).parquet(f"{self.path}/postings/gen={gen}")
        sizes = made.groupBy("id").agg(F.sum(sum((F.col(f"tf.{f}") for f in WEIGHTS), F.lit(0))).alias("length"))
        anew = fresh.join(sizes, "id", "left").select("id", "size", "mtime", "digest", "path", "lang", F.col("chunks").cast("long").alias("chunks"), F.coalesce("length", F.lit(0)).cast("long").alias("length"))
        rest = known.join(fresh.select("id"), "id", "left_anti").drop("size", "mtime", "path", "lang").join(now, "id").select(*anew.columns)
        rest.unionByName(anew).write.mode("overwrite").parquet(f"{self.path}/files/gen={gen}")
        by = judged.agg(F.count("*"), F.count_if("fresh")).first()
        counts = {"scanned": now.count(), "asked": by[0], "indexed": by[1], "touched": by[0] - by[1], "removed": gone.count()}
        self._commit(gen, base, counts)
        self._drop(f"run/gen={gen}")
        return counts

    def _kept(self, df: DataFrame, gen: int, name: str) -> DataFrame:
        """A table of this run, written once and read again."""
        at = f"{self.path}/run/gen={gen}/{name}"
        df.write.mode("overwrite").parquet(at)
        return self.spark.read.schema(df.schema).parquet(at)

    def _commit(self, gen: int, base: int, counts: dict[str, int]) -> None:
        total = self.spark.read.parquet(f"{self.path}/files/gen={gen}").agg(F.sum("chunks"), F.sum("length")).first()
        row = {"gen": gen, "base": base, "chunks": total[0] or 0, "length": total[1] or 0} | counts
        self.spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} long" for k in row)).coalesce(1).write.mode("append").parquet(f"{self.path}/runs")

    def compact(self) -> None:
        """All living postings as one generation; those before it go once it counts."""
        last, base = self._last()
        gen = last + 1
        self.postings().drop("gen").repartition("bucket", F.pmod(F.xxhash64("id", "chunk"), F.lit(8))).write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/postings/gen={gen}")
        files = self.files()
        files.write.mode("overwrite").parquet(f"{self.path}/files/gen={gen}")
        files.select("id").filter("false").write.mode("overwrite").parquet(f"{self.path}/dead/gen={gen}")
        self._commit(gen, gen, {"scanned": 0, "asked": 0, "indexed": 0, "touched": 0, "removed": 0})
        for g in range(base, gen):
            for name in ("postings", "dead", "files"):
                self._drop(f"{name}/gen={g}")

    # --- reading

    def search(self, queries: DataFrame, k: int = 8, lang: str | None = None, path_glob: str | None = None, weights: dict[str, float] | None = None, k1: float = 1.2, b: float = 0.75) -> DataFrame:
        """query_id, rank, id, chunk, score rounded to 6, by BM25 over weighted fields; k is at most 50. queries: query_id, text.

        lang and path_glob choose among the files that are ranked; a term's rarity is that in all.
        """
        weights, k = WEIGHTS | (weights or {}), max(1, min(50, k))
        wanted = query_keys(queries)
        stem = F.substring(F.regexp_replace("key", r"\*$", ""), 1, PREFIX)
        needed = [r[0] for r in wanted.select(F.pmod(F.xxhash64(stem), F.lit(self.buckets)).cast("int").alias("b")).distinct().collect()]  # of self.buckets
        p = self.postings(needed)
        of = sent(scratch_table(keys_of_words(p.select("word").distinct(), wanted), "words"))
        tf = sum((F.col(f"tf.{f}") * w for f, w in weights.items()), F.lit(0.0))
        # what can count of a chunk is dealt out together once
        p = p.select("id", "chunk", "length", "word", tf.alias("x")).join(of.select("word").distinct(), "word", "left_semi").repartition("id", "chunk")
        t = p.join(of, "word").groupBy("id", "chunk", "key").agg(F.sum("x").alias("tf"), F.max("length").alias("length"))
        size = self.runs().orderBy(F.desc("gen")).first()
        f = None
        if lang is not None or path_glob is not None:
            f = self.files()
            f = f if lang is None else f.filter(F.col("lang") == lang)
            f = f if path_glob is None else f.filter(F.col("path").rlike(glob_pattern(path_glob)))
            f = f.select("id")
        return ranked(t, wanted, ["id", "chunk"], size.chunks, size.length / size.chunks if size.length else 1.0, k, k1, b, f)


def glob_pattern(glob: str) -> str:
    """A pattern of *, ? and [...] as a regular expression over the whole path; * goes over slashes too."""
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        end = glob.find("]", i + 2) if c == "[" else -1
        if end > 0:
            inner = glob[i + 1 : end].replace("\\", "\\\\").replace("[", "\\[")
            out, i = out + f"[{inner}]", end + 1
            continue
        out += ".*" if c == "*" else "." if c == "?" else "\\" + c if not c.isalnum() else c
        i += 1
    return f"(?s)^{out}$"


def rebuilt(spark: SparkSession, path: str, listing: DataFrame, read: Callable[[DataFrame], DataFrame]) -> SearchIndex:
    """A new index of all that is listed."""
    out = SearchIndex(spark, path)
    out.update(listing, read)
    return out
