"""Vector code compression: product codes by k-means in whole numbers, on an exact GEMM over limbs.

A component x is the integer floor(scale * x). Vectors are cut into equal parts; each part position
has a codebook of `entries` integer centres, which starts as that part of the smallest ids and is
refined for a fixed number of rounds. Everything is exact, so that reruns and other partitions give
the same codes: a squared distance is |x|^2 - 2 x.c + |c|^2, and the dot products of a batch with
all centres are one matrix product for each pair of limbs. A limb is so narrow that no partial sum
of float64 BLAS leaves 2^53; the products are shifted and added in int64, and the first argmin is
the nearest centre with ties to the lower index. Where 64 bits cannot hold a distance, the same is
done in Python's integers.

A round is one pass over the vectors: a task adds up what it assigned for each centre and
component and gives the sums in limbs of 40 bits, which Spark adds up map side first; the driver
gets a row for each centre, component and limb, whatever the number of vectors, and sends back the
next codebooks. No row is shuffled by its code, so that equal vectors are no hot key.

Defined results: rows whose vector is null or holds null or non-finite components are left out;
shorter vectors count as padded with zeros, up to the longest length rounded up to a multiple of
the parts; with fewer rows than entries the codebooks are that much smaller; an empty vector has
empty parts, entry 0 and error 0; rows that repeat a vec_id are rows of their own, null ids come last;
where equal ids differ the smaller vector comes first; sums beyond a long are cut to it; an empty
table gives no rows. Columns of rows other than vec_id, embedding and label are not carried.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import forget, saved

_LONG = 2**63 - 1
#: Bits of a limb of the sums that tasks hand on.
SUM_BITS = 40


def limb_bits(d: int) -> int:
    """The widest limb with which d products stay below 2^53."""
    return (52 - max(0, d - 1).bit_length()) // 2


def limbs(x: np.ndarray, bits: int) -> list[np.ndarray]:
    """x (int64) as float64 limbs, lowest first: x = sum of limb[i] << (bits * i); only the last may be negative."""
    out = []
    while True:
        if not x.size or (-(1 << bits) < int(x.min()) and int(x.max()) < 1 << bits):
            return [*out, x.astype(np.float64)]
        out.append((x & ((1 << bits) - 1)).astype(np.float64))
        x = x >> bits


def exact_product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T of int64 matrices in int64, by float64 BLAS over limbs; the true products fit int64."""
    bits = limb_bits(a.shape[1])
    out = np.zeros((len(a), len(b)), np.int64)
    by = limbs(b, bits)
    for i, x in enumerate(limbs(a, bits)):
        for j, y in enumerate(by):
            out += (x @ y.T).astype(np.int64) << (bits * (i + j))
    return out


def distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances of the rows of x to all centres; int64 matrices, or objects where those are."""
    dots = x @ centres.T if x.dtype == object or centres.dtype == object else exact_product(x, centres)
    return (x * x).sum(axis=1)[:, None] - 2 * dots + (centres * centres).sum(axis=1)[None, :]


def whole(rows: pd.Series, width: int, narrow: bool) -> np.ndarray:
    """Vectors of whole doubles as a matrix padded with zeros: int64, or Python's integers where those are too small."""
    out = np.zeros((len(rows), width), np.int64 if narrow else object)
    for i, v in enumerate(rows):
        out[i, : len(v)] = v if narrow else [int(x) for x in v]
    return out


def is_narrow(most: float, width: int) -> bool:
    """Whether int64 holds every squared distance of vectors with components of at most `most`."""
    return 4.0 * max(1, width) * (most + 1) ** 2 < 2.0**62


def _spread(total: np.ndarray, count: np.ndarray) -> pd.DataFrame:
    """Sums (part, entry, component) as rows of limbs; the count of an entry is its component -1."""
    rows = []
    for p, e in zip(*np.nonzero(count), strict=True):
        for at, value in [(-1, int(count[p, e])), *enumerate(int(x) for x in total[p, e])]:
            limb = 0
            while value:
                low = value if -(1 << SUM_BITS) < value < 1 << SUM_BITS else value & ((1 << SUM_BITS) - 1)
                rows.append((p, e, at, limb, low))
                value = (value - low) >> SUM_BITS
                limb += 1
    return pd.DataFrame(rows, columns=["part", "entry", "at", "limb", "value"]).astype("int64")


def refined(books: list[np.ndarray], sums: pd.DataFrame) -> list[np.ndarray]:
    """The next codebooks: floor(sum / count) by component, unused entries as they were."""
    out = [b.astype(object) for b in books]
    held: dict[tuple[int, int, int], int] = {}
    for p, e, at, limb, value in sums.itertuples(index=False):
        held[p, e, at] = held.get((p, e, at), 0) + (int(value) << (SUM_BITS * limb))
    for (p, e, at), count in list(held.items()):
        if at == -1:
            out[p][e] = [held.get((p, e, i), 0) // count for i in range(out[p].shape[1])]
    return out


def codebook_text(books: list[np.ndarray]) -> str:
    """All entries' components by part, entry and position within the part, as decimals with commas."""
    return ",".join(str(x) for b in books for row in b for x in row)


def floored(x: Column) -> Column:
    return F.when(F.abs(x) < 2.0**52, F.floor(x).cast("double")).otherwise(x)


def compress(rows: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024) -> DataFrame:
    """vec_id, label, code, error, label_error, codebooks_sha256 of each row that takes part. rows: vec_id, embedding, label."""
    if not 0 < entries <= 256:
        raise ValueError("two hex digits name an entry: 1 to 256 entries")
    spark = rows.sparkSession
    good = F.col("embedding").isNotNull() & F.forall("embedding", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    # floor as a double, which holds any double's whole part; from 2^52 on doubles are whole
    scaled = F.transform("embedding", lambda x: floored(x.cast("double") * scale))
    vectors = saved(rows.filter(good).select("vec_id", "label", scaled.alias("v")))
    most = F.aggregate("v", F.lit(0.0), lambda m, x: F.greatest(m, F.abs(x)))
    n, longest, most = vectors.agg(F.count("*"), F.max(F.size("v")), F.max(most)).first()
    part = -(-(longest or 0) // parts)
    width, narrow = part * parts, is_narrow(most or 0.0, part)
    first = vectors.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).select("v").toPandas()
    start = whole(first["v"], width, narrow)
    books = [start[:, p * part : (p + 1) * part] for p in range(parts)]

    def assigned(v: np.ndarray, own: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        codes, errors = np.zeros((len(v), parts), np.int64), np.zeros(len(v), v.dtype)
        for p in range(parts):
            far = distances(v[:, p * part : (p + 1) * part], own[p])
            codes[:, p] = far.argmin(axis=1)
            errors = errors + far[np.arange(len(v)), codes[:, p]]
        return codes, errors

    def sent(own: list[np.ndarray]):
        return spark.sparkContext.broadcast([b.astype(np.int64 if narrow else object) for b in own])

    for _ in range(rounds if n else 0):
        now = sent(books)

        def add(batches: Iterator[pd.DataFrame], now=now) -> Iterator[pd.DataFrame]:
            total, count = np.zeros((parts, entries, part), np.int64 if narrow else object), np.zeros((parts, entries), np.int64)
            for batch in batches:
                v = whole(batch["v"], width, narrow)
                codes, _ = assigned(v, now.value)
                for p in range(parts):
                    np.add.at(total[p], codes[:, p], v[:, p * part : (p + 1) * part])
                    count[p] += np.bincount(codes[:, p], minlength=entries)
            yield _spread(total, count)

        sums = vectors.select("v").mapInPandas(add, "part long, entry long, at long, limb long, value long")
        books = refined(books, sums.groupBy("part", "entry", "at", "limb").agg(F.sum("value").alias("value")).toPandas())
        now.unpersist()
    last, digest = sent(books), hashlib.sha256(codebook_text(books).encode()).hexdigest()

    @F.pandas_udf("code string, error long")
    def coded(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            codes, errors = assigned(whole(batch, width, narrow), last.value)
            yield pd.DataFrame({"code": ["".join(f"{c:02x}" for c in row) for row in codes], "error": [min(int(e), _LONG) for e in errors]})

    done = saved(vectors.select("vec_id", "label", coded("v").alias("c")).select("vec_id", "label", "c.code", "c.error"))
    forget(vectors)
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(_LONG).cast("decimal(38,0)")).cast("long")
    sums = saved(done.groupBy("label").agg(total.alias("label_error"), F.count("*").alias("held")))
    # fewer than 1000 labels hold more than a thousandth of all rows: those go to every task, so that no label is a hot key of the join
    hot = sums.filter(F.col("held") * 1000 > n).select(F.col("label").alias("hot_label"), F.col("label_error").alias("hot_error"))
    rest = sums.filter(F.col("held") * 1000 <= n).select(F.col("label").alias("own_label"), F.col("label_error").alias("own_error"))
    met = done.join(F.broadcast(hot), F.col("label").eqNullSafe(F.col("hot_label")), "left")
    known = met.filter("hot_error is not null").select("vec_id", "label", "code", "error", F.col("hot_error").alias("label_error"))
    others = met.filter("hot_error is null").join(rest, F.col("label").eqNullSafe(F.col("own_label"))).select("vec_id", "label", "code", "error", F.col("own_error").alias("label_error"))
    return known.unionByName(others).withColumn("codebooks_sha256", F.lit(digest))
