"""Exact top-k search by columnar branch and bound.

Vectors lie in vertical layout, dimension by dimension, in blocks of candidates. For a block of
queries the inner products are accumulated over one block of dimensions after another; after
each, a candidate goes on only while its sum so far plus the bound of what is left (the product
of the remaining lengths of query and candidate) can still reach the query's k-th score, and the
survivors are compacted. Dimensions with the greatest spread come first.

Candidates are dealt out in blocks of bounded size and each block meets the queries in blocks of
bounded size; a block returns its k best a query, and the best of all are taken per query after
those partial results. A first block gives every query a floor under its k-th score.

Defined results: a vector null or with a null or non-finite component takes no part; shorter
vectors count as padded with zeros; rows that repeat a vec_id are one vector; equal scores go to
the smaller vec_id; sums beyond 64 bits are cut to the largest long.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import saved

OUT = "query_id long, vec_id long, score long"
_LONG = 2**63 - 1


def quantised(rows: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id, v: floor(scale * x) of each vector that takes part, once each; exact as doubles."""
    good = F.col("embedding").isNotNull() & F.col("vec_id").isNotNull() & F.forall("embedding", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    # as doubles: floor of a double stays within a double's whole numbers
    v = F.transform("embedding", lambda x: F.rint(x.cast("double") * scale - F.pmod(x.cast("double") * scale, F.lit(1.0))))
    return rows.filter(good).select("vec_id", v.alias("v")).dropDuplicates(["vec_id"])


def matrix(vectors: pd.Series) -> np.ndarray:
    """Vectors as columns, padded with zeros."""
    d = max(map(len, vectors), default=0)
    out = np.zeros((d, len(vectors)))
    for i, v in enumerate(vectors):
        out[: len(v), i] = v
    return out


def exact(q: np.ndarray, c: np.ndarray) -> bool:
    """Whether doubles hold every partial sum."""
    return len(q) * float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) < 2**52


def _whole(q: np.ndarray, c: np.ndarray) -> list[int]:
    """Inner products in whole numbers of any size, cut to 64 bits: of a query and the columns of c."""
    own = [int(x) for x in q]
    return [max(-_LONG - 1, min(_LONG, sum(a * int(b) for a, b in zip(own, col, strict=True)))) for col in c.T]


def search(q_ids: np.ndarray, q: np.ndarray, floor: np.ndarray, c_ids: np.ndarray, c: np.ndarray, k: int, step: int = 16) -> Iterator[tuple[int, int, int]]:
    """The candidates (columns of c, ids ascending) among which each query's k best are, but for its own id.

    Where doubles cannot hold the sums, they are bounds still, widened by their error, over values
    scaled to 1 at most; what survives is counted in whole numbers.
    """
    d = max(len(q), len(c))
    q, c = (np.pad(x, ((0, d - len(x)), (0, 0))) for x in (q, c))
    sure = exact(q, c)
    whole_q, whole_c = q, c
    top_long = np.inf
    if not sure:
        by_q, by_c = (max(1.0, float(np.abs(x).max(initial=0))) for x in (q, c))
        q, c, top_long = q / by_q, c / by_c, 2.0**63 / by_q / by_c * (1 - 1e-9)  # from there on scores are cut and tie
    order = np.argsort(-(c**2).sum(axis=1), kind="stable")
    q, c = q[order], c[order]
    ends = [*range(step, d, step), d] if d else []
    # remaining lengths after each block of dimensions
    rest = lambda x, e: np.sqrt((x[e:] ** 2).sum(axis=0))
    c_rest, q_rest = {e: rest(c, e) for e in ends}, {e: rest(q, e) for e in ends}
    error = 0.0 if sure else 4 * d * 2.0**-52 * d  # of a sum of d products of values of 1 at most
    first = q[: ends[0]].T @ c[: ends[0]] if ends else np.zeros((q.shape[1], c.shape[1]))
    for i in range(q.shape[1]):
        alive = np.flatnonzero(c_ids != q_ids[i])
        part, at = first[i, alive], ends[0] if ends else 0
        # the best so far in full give a floor of the block's own; one from other blocks is in their scale
        low = floor[i] if sure else -np.inf
        if len(alive) > k:
            top = alive[np.argpartition(-part, k - 1)[:k]]
            low = max(low, (q[:, i] @ c[:, top]).min() - error)
            low = min(low, top_long - error)
        for e in ends[1:]:
            keep = part + q_rest[at][i] * c_rest[at][alive] * (1 + 1e-9) + (1e-6 if sure else error) >= low
            alive, part = alive[keep], part[keep]
            part = part + q[at:e, i] @ c[at:e, alive]
            at = e
        if sure:
            scores = part
        else:
            near = part + error >= low
            alive = alive[near]
            scores = np.array(_whole(whole_q[:, i], whole_c[:, alive]), dtype=object)
        for j in sorted(range(len(alive)), key=lambda x: (-scores[x], c_ids[alive[x]]))[:k] if not sure else np.lexsort((c_ids[alive], -scores))[:k]:
            if scores[j] >= floor[i]:
                yield int(q_ids[i]), int(c_ids[alive[j]]), int(scores[j])


def nearest(rows: DataFrame, every: int = 50, k: int = 5, scale: int = 256, block: int = 4096) -> DataFrame:
    """query_id, rank, vec_id, score of the k best for each row whose vec_id divides by every."""
    vectors = saved(quantised(rows, scale))
    n = vectors.count()
    blocks, n_slices = max(1, -(-n // block)), max(1, -(-n // every // block))
    numbers = lambda a, b: F.sequence(F.lit(a).cast("long"), F.lit(b).cast("long"))
    dealt = vectors.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)))
    queries = vectors.filter(F.col("vec_id") % every == 0)

    def meet(key: tuple, candidates: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out: list = []
        if len(candidates) and len(asked):
            candidates = candidates.sort_values("vec_id")
            c, ids = matrix(candidates["v"]), candidates["vec_id"].to_numpy()
            for i in range(0, len(asked), 512):
                own = asked.iloc[i : i + 512]
                out += search(own["vec_id"].to_numpy(), matrix(own["v"]), own["floor"].to_numpy(), ids, c, k)
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype("int64")

    def against(candidates: DataFrame, asked: DataFrame) -> DataFrame:
        # a query goes to each of the candidates' blocks, and there in slices of bounded size
        copies = asked.withColumn("slice", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(n_slices)))
        ranges = candidates.withColumn("slice", F.explode(numbers(0, n_slices - 1)))
        return ranges.groupBy("block", "slice").cogroup(copies.groupBy("block", "slice")).applyInPandas(meet, OUT)

    no_floor = queries.withColumn("floor", F.lit(float("-inf")))
    found = saved(against(dealt.filter("block = 0"), no_floor.withColumn("block", F.lit(0).cast("long"))))
    if blocks > 1:
        floors = found.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").cast("double").alias("floor")).filter(F.col("n") >= k)
        known = queries.join(floors.withColumnRenamed("query_id", "vec_id"), "vec_id", "left").select("vec_id", "v", F.coalesce("floor", F.lit(float("-inf"))).alias("floor"))
        spread = saved(known).withColumn("block", F.explode(numbers(1, blocks - 1)))
        found = found.unionByName(against(dealt.filter("block > 0"), spread))
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    ranks = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranks.select("query_id", "rank", "vec_id", "score")
