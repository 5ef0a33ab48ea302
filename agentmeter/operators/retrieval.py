"""Finding code: source trees, imports to files, typed suffixes, symbols, outlines, what a file pulls in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import normal_path
from .sourceindex import closure, language

#: What an import may leave out at its end, the surest first.
ENDINGS = ("", ".py", ".ts", ".tsx", ".js", ".jsx", ".svelte", ".css", ".md", ".sql", "/index.ts", "/index.tsx", "/index.js", "/__init__.py")
#: Kinds of symbols in the order in which they tell most of a file.
KINDS = ("class", "interface", "struct", "type", "enum", "function", "procedure", "table", "view", "const", "heading", "rule")


def scan(spark: SparkSession, root: str, exclude: tuple[str, ...] = ("/.git/", "/node_modules/", "/__pycache__/"), most_bytes: int = 1_000_000) -> DataFrame:
    """path, lang, size, mtime, text of the source files under a root: known languages, within the size, not binary, not excluded."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    f = f.withColumn("lang", language(F.col("path"))).filter(F.col("lang").isNotNull() & (F.col("length") <= most_bytes))
    for part in exclude:
        f = f.filter(~F.contains(F.col("path"), F.lit(part)))
    f = f.filter(~F.decode(F.substring("content", 1, 4096), "ISO-8859-1").contains("\x00"))
    return f.select("path", "lang", F.col("length").alias("size"), F.col("modificationTime").alias("mtime"), F.decode("content", "UTF-8").alias("text"))


def relative(specs: DataFrame, files: DataFrame) -> DataFrame:
    """src, spec, dst: specifiers that begin with a dot, resolved from the importing file's folder by the first ending that exists.

    specs: id (of the importing file), spec; files: id, path.
    """
    src = files.select(F.col("id").alias("src"), F.regexp_extract("path", r"^(.*/)[^/]*$", 1).alias("folder"))
    s = specs.filter("startswith(spec, '.')").select(F.col("id").alias("src"), "spec").distinct().join(src, "src")
    ends = F.array(*[F.struct(F.lit(i).alias("place"), F.lit(e).alias("end")) for i, e in enumerate(ENDINGS)])
    tried = s.select("src", "spec", F.explode(ends).alias("e"), "folder")
    tried = tried.withColumn("path", F.concat(normal_path(F.concat("folder", "spec")), "e.end"))
    met = tried.join(files.select(F.col("id").alias("dst"), "path"), "path")
    return met.groupBy("src", "spec").agg(F.min_by("dst", "e.place").alias("dst")).filter("src <> dst")


def by_suffix(typed: DataFrame, files: DataFrame) -> DataFrame:
    """typed (key, suffix) with the shortest path that ends in it, the first in order of equals; the suffix begins a part of the path."""
    parts = F.split("path", "/")
    ends = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, -n, n), "/"))
    keys = files.select("path", F.explode(ends).alias("suffix"))
    met = typed.withColumn("suffix", F.ltrim(F.col("suffix"), F.lit("/"))).join(keys, "suffix")
    return met.groupBy("key").agg(F.min_by("path", F.struct(F.length("path"), "path")).alias("path"))


def lookup(symbols: DataFrame, names: DataFrame, k: int = 10) -> DataFrame:
    """name, rank, id, kind, lo, hi of the symbols of that name: the longest first. symbols: id, kind, name, lo, hi."""
    met = symbols.join(names.select("name").distinct(), "name")
    w = Window.partitionBy("name").orderBy(F.desc(F.col("hi") - F.col("lo")), "id", "lo")
    return met.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("name", "rank", "id", "kind", "lo", "hi")


def outline(symbols: DataFrame, texts: DataFrame) -> DataFrame:
    """id, outline, tokens, whole_tokens: a line a symbol with its span, and what it and the whole text cost, in quarters of bytes."""
    line = F.concat_ws(" ", "kind", "name", F.concat_ws("-", "lo", "hi"))
    rows = symbols.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("lo", line.alias("line")))).alias("a"))
    own = texts.select("id", F.octet_length("text").alias("bytes")).join(rows, "id")
    text = F.array_join(F.col("a.line"), "\n")
    return own.select("id", text.alias("outline"), F.ceil(F.octet_length(text) / 4).alias("tokens"), F.ceil(F.col("bytes") / 4).alias("whole_tokens"))


def around(seeds: DataFrame, edge: DataFrame, depth: int = 2, direction: str = "out") -> DataFrame:
    """What seeds import (out), what imports them (in), or both. seeds: seed, node; edge: src, dst."""
    back = edge.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    use = {"out": edge.select("src", "dst"), "in": back, "both": edge.select("src", "dst").unionByName(back)}[direction]
    return closure(seeds, use, depth)


def ranked_chunks(reached: DataFrame, chunks: DataFrame, per_file: int = 3, k: int = 20) -> DataFrame:
    """The chunks of reached files to show: near files first, heads before the rest, kinds by what they tell, small ones first.

    reached: seed, node, depth; chunks: id, lo, kind, tokens. At most per_file a file, then k a seed.
    """
    kind = F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(x) for x in KINDS]), F.col("kind")), F.lit(0)), F.lit(len(KINDS) + 1))
    c = reached.join(chunks.withColumnRenamed("id", "node"), "node").withColumn("_kind", kind)
    order = [F.col("depth"), F.when(F.col("lo") == 1, 0).otherwise(1), F.col("_kind"), F.col("tokens"), F.col("node"), F.col("lo")]
    c = c.withColumn("_r", F.row_number().over(Window.partitionBy("seed", "node").orderBy(*order))).filter(F.col("_r") <= per_file)
    c = c.withColumn("rank", F.row_number().over(Window.partitionBy("seed").orderBy(*order))).filter(F.col("rank") <= k)
    return c.select("seed", "rank", "node", "lo", "kind", "tokens")


def rung(whole_file: Column, outline_tokens: Column, indexed: Column, lo: Column) -> Column:
    """What could have been read in a file's stead: the ladder of a read."""
    return (
        F.when(~F.coalesce(indexed, F.lit(False)), "never_indexed").when(F.coalesce(outline_tokens, F.lit(0)) <= 0, "no_outline")
        .when(whole_file, "whole_file").when(lo.isNull(), "span_unknown").otherwise("spanned")
    )


def shrink_bands(reads: DataFrame, index: DataFrame) -> DataFrame:
    """Per rung: reads, dollars, and what an outline instead would save; of spans it would lose, which is stated and never netted.

    reads: path, whole_file, lo, tokens, usd; index: path, tokens (of the outline).
    """
    i = index.select("path", F.col("tokens").alias("outline_tokens"), F.lit(True).alias("indexed"))
    r = reads.join(i, "path", "left").withColumn("rung", rung(F.coalesce("whole_file", F.lit(False)), F.col("outline_tokens"), F.col("indexed"), F.col("lo")))
    share = F.col("outline_tokens") / F.nullif(F.col("tokens"), F.lit(0))
    saves = F.when(F.col("rung") == "whole_file", F.greatest(F.lit(0.0), F.col("usd") * (1 - share)))
    loses = F.when(F.col("rung") == "spanned", F.greatest(F.lit(0.0), F.col("usd") * (share - 1)))
    zero = F.lit(0.0)
    return r.groupBy("rung").agg(F.count("*").alias("reads"), F.sum("usd").alias("usd"), F.coalesce(F.sum(saves), zero).alias("saves_usd"), F.coalesce(F.sum(loses), zero).alias("loses_usd"))
