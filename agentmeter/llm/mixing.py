"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source gets the same expected number of copies: target over size of its
source. Whole copies are taken at once; the fractions that are left are rounded by the pivotal
method. Two fractional documents meet, words move at random from one to the other until one
holds no or one whole further copy, and the other goes on. The words that a source takes stay
the same through every meeting, and each document's expected copies too.

Documents meet within cells (source, hash of doc_id, size and number among equal rows) of bounded
size; each cell leaves at most one fractional document, and these meet in a tree whose nodes join
`fan_in` cells, so that a source, or one doc_id, with a third of all rows is spread over as many
tasks as any other rows. What a cell leaves is settled: the document still fractional is rounded,
and small documents that the cell had rounded give or take the words in its stead, so that the one
left is small, and so is the error of the last rounding of a source.

Defined results: a null text has size 0; a document of size 0 takes 0; repeated rows are
documents of their own, however often they are repeated; an empty table gives no rows.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, forget, repeated, saved


def ranked(df: DataFrame, key: str, out: str) -> DataFrame:
    """df, one row per key, with the key's place from 0 in code point order, null last.

    Range partitions are numbered on their own and shifted by the rows before them, so that no
    task holds all keys.
    """
    parts = saved(df.repartitionByRange(F.col(key).asc_nulls_last()).withColumn("part", F.spark_partition_id()))
    counts = parts.groupBy("part").agg(F.count("*").alias("n"))
    before = counts.alias("x").join(counts.alias("y"), F.col("y.part") < F.col("x.part"), "left").groupBy("x.part").agg(F.coalesce(F.sum("y.n"), F.lit(0)).alias("before"))
    own = F.row_number().over(Window.partitionBy("part").orderBy(F.col(key).asc_nulls_last()))
    return parts.withColumn("own", own).join(before, "part").withColumn(out, F.col("before") + F.col("own") - 1).drop("part", "own", "before")


def targets(sizes: DataFrame, weights: Sequence[float] = (1, 2, 3), cap: float = 3.0, share: float = 1.0) -> DataFrame:
    """A row per source: source, source_size, docs, target.

    sizes: source, size. The level rises until the sources under their cap take the rest by
    weight; each step is one aggregate row.
    """
    each = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"), F.count("*").alias("docs"))
    each = ranked(each, "source", "place")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    each = saved(each.withColumn("weight", weight).withColumn("most", cap * F.col("source_size")))
    total = share * (each.agg(F.sum("source_size")).first()[0] or 0)
    level, under = 0.0, -1
    while True:
        full = F.col("most") < level * F.col("weight")
        row = each.agg(F.sum(F.when(full, F.col("most")).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(F.col("weight"))), F.count_if(full)).first()
        if row[2] == under or not row[1]:
            break
        under, level = row[2], (total - row[0]) / row[1]
    return each.select("source", "source_size", "docs", F.least("most", level * F.col("weight")).alias("target"))


def pivot(size: np.ndarray, part: np.ndarray, draw: np.random.Generator) -> np.ndarray:
    """part rounded to 0 and 1 but for one at most, the words sum(size * part) kept."""
    part, held = part.astype(float), -1
    for j in range(len(part)):
        if not 0 < part[j] < 1:
            continue
        if held < 0:
            held = j
            continue
        i = held
        to_i, to_j = min((1 - part[i]) * size[i], part[j] * size[j]), min(part[i] * size[i], (1 - part[j]) * size[j])
        a, b, moved = (i, j, to_i) if draw.random() * (to_i + to_j) < to_j else (j, i, to_j)  # from b to a
        room = (1 - part[a]) * size[a] <= part[b] * size[b]
        part[a] = 1.0 if room else part[a] + moved / size[a]
        part[b] = part[b] - moved / size[b] if room else 0.0
        for x in (a, b):
            part[x] = 0.0 if part[x] < 1e-12 else 1.0 if part[x] > 1 - 1e-12 else part[x]
        held = next((x for x in (i, j) if 0 < part[x] < 1), -1)
    return part


def settle(size: np.ndarray, part: np.ndarray, free: np.ndarray, draw: np.random.Generator) -> np.ndarray:
    """part with its fractional document made as small as can be, the words sum(size * part) kept.

    free: the documents that were fractional. The one left is rounded at random; what that adds or
    takes is made good by free documents rounded the other way, large ones first, and the rest by
    the smallest that can hold it, which is the fractional one then. Where the others are too small
    for one of its two ways it goes the way that they come nearer to.
    """
    part = part.copy()
    left = np.flatnonzero((part > 0) & (part < 1))
    if not len(left):
        return part
    i = int(left[0])
    full, none = (np.flatnonzero(free & (part == x) & (np.arange(len(part)) != i)) for x in (1, 0))
    short_up, short_down = max(0.0, (1 - part[i]) * size[i] - size[full].sum()), max(0.0, part[i] * size[i] - size[none].sum())
    up = bool(draw.random() < part[i])
    if short_up != short_down:
        up = short_up < short_down
    words = (1 - part[i] if up else part[i]) * size[i]  # to be taken from the others, or given to them
    others = full if up else none
    part[i] = 1.0 if up else 0.0
    others = others[np.lexsort((draw.random(len(others)), -size[others]))]
    kept = -1
    for j in others:
        if size[j] <= words:
            part[j] = 1 - part[j]
            words -= size[j]
        else:
            kept = j
    if words > 1e-9:
        at = kept if kept >= 0 else i
        part[at] += (-words if up else words) / size[at]
    return part


def mix(docs: DataFrame, weights: Sequence[float] = (1, 2, 3), cap: float = 3.0, share: float = 1.0, seed: int = 0, cell_rows: int = 4096, fan_in: int = 64) -> DataFrame:
    """Per document: doc_id, source, size, source_size, target, copies, taken. docs: doc_id, source, text."""
    sizes = docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    # equal rows are one row with a number, then rows of their own again, each with its place among them
    sizes = saved(repeated(sizes.groupBy("doc_id", "source", "size").agg(F.count("*").alias("times")), "times").drop("times"))
    goal = saved(targets(sizes, weights, cap, share))
    top = goal.agg(F.max("docs")).first()[0] or 0
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(cap)))).otherwise(0.0)
    whole = F.floor(F.col("rate") + 1e-9)
    rest = F.col("rate") - F.col("whole")
    joined = sizes.alias("d").join(goal.alias("g"), F.expr("d.source <=> g.source")).select("doc_id", "d.source", "size", "_copy", "source_size", "target", "docs", rate.alias("rate"))
    joined = joined.withColumn("whole", whole).withColumn("part", F.when((rest < 1e-9) | (F.col("size") == 0), 0.0).otherwise(rest))
    joined = joined.withColumn("cell", F.pmod(F.xxhash64("doc_id", "size", "_copy", F.lit(seed)), F.ceil(F.col("docs") / cell_rows)))
    fields = "doc_id {}, source string, size long, source_size long, target double, whole long, part double, cell long".format(dict(sizes.dtypes)["doc_id"])
    names = [x.split()[0] for x in fields.split(", ")]

    def meet(level: int):
        def cell(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
            rows = rows.sort_values(["size", "doc_id"], ascending=[False, True], kind="stable", ignore_index=True)
            name = zlib.crc32(b"" if key[0] is None else str(key[0]).encode())
            size, given = rows["size"].to_numpy(float), rows["part"].to_numpy()
            draw = np.random.default_rng([seed, level, name, int(key[1])])
            part = settle(size, pivot(size, given, draw), (given > 0) & (given < 1), draw)
            if level == depth:
                part = np.where((part > 0) & (part < 1), (part >= 0.5) * 1.0, part)  # a source's last: to the nearer
            return rows.assign(part=part)[names]

        return cell

    depth = max(0, math.ceil(math.log(max(1, math.ceil(top / cell_rows)), fan_in)))
    done, left = [], joined.select(*names)
    for level in range(depth + 1):
        if level:
            left = left.withColumn("cell", F.floor(F.col("cell") / fan_in))
        met = left.groupBy("source", "cell").applyInPandas(meet(level), fields)
        met = met if level == depth else saved(met)
        done.append(met.filter("part in (0, 1)"))
        left = met.filter("part not in (0, 1)")
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    copies = (F.col("whole") + F.col("part")).cast("long")
    return out.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))
