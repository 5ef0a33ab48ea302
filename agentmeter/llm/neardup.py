"""Near duplicates by circulant MinHash.

Two permutations of one universe make all coordinates of a signature: the first scatters a
document's shingles, the second, shifted circularly by one place a coordinate, orders them.
Bands of coordinates are hashed to keys, and documents that share a key are candidates, whose
full shingle sets decide (Jaccard at or above the threshold, in whole numbers).

Equal shingle sets form one class first, so that a group of copies costs one signature row. In a
bucket every class meets the bucket's leader; classes that a link joins need not meet again. In
buckets where classes stay apart, further leaders are tried, all in one pass. The members of those still apart are
met by rare shingles: sets at the threshold share one of the rarest few of each, so that only those
pairs meet, and where such a shingle is frequent all its holders meet in blocks of bounded bytes.
No link between different texts that the bands found is lost.

Joins on a band key are salted by the size of its bucket.

Defined results: a document without words or text has an empty set, links with nothing and is
kept. A row is a document: rows that repeat a doc_id with another text have classes of their own
and may get different components, each named by the smallest doc_id in it; rows that repeat a
doc_id and its text get the same. Rows without doc_id are kept and have no component; an empty
table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import components, forget, make_room, merged, packed, saved

UNIVERSE = 1 << 20
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5], np.uint64)


class _Hashes(dict):
    """Word to 64-bit hash, kept within a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_hashes = _Hashes()


def finish(x: np.ndarray) -> np.ndarray:
    """A full mix of 64-bit values."""
    x = x ^ (x >> np.uint64(31))
    x = x * _MIX[0]
    x = x ^ (x >> np.uint64(29))
    x = x * _MIX[1]
    return x ^ (x >> np.uint64(32))


def shingle_set(text: str | None, n: int) -> np.ndarray:
    """The sorted distinct hashes of the text's runs of n words."""
    words = text.encode().lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
    size = min(n, len(words))
    total = np.full(len(words) - size + 1, size, np.uint64)
    for i in range(size):
        total = finish(total + h[i : i + len(total)])
    return np.unique(total)


class Signer:
    """Band keys of a shingle set."""

    def __init__(self, bands: int, rows: int, seed: int = 1):
        draw = np.random.default_rng(seed)
        self.first = draw.permutation(UNIVERSE).astype(np.uint32)
        second = draw.permutation(UNIVERSE).astype(np.uint32)
        k = bands * rows
        # row x of the view: the second permutation from x on, so that column j is it shifted by j
        self.shifted = np.lib.stride_tricks.sliding_window_view(np.concatenate([second, second[: k - 1]]), k)
        self.bands, self.rows = bands, rows
        self.factors = finish(np.arange(1, rows + 1, dtype=np.uint64)) | np.uint64(1)
        self.salts = finish(np.arange(1000, 1000 + bands, dtype=np.uint64))

    def signature(self, shingles: np.ndarray) -> np.ndarray:
        at = self.first[(shingles >> np.uint64(44)).astype(np.int64)]
        out = None
        for i in range(0, len(at), 2048):
            low = self.shifted[at[i : i + 2048]].min(axis=0)
            out = low if out is None else np.minimum(out, low)
        return out

    def keys(self, shingles: np.ndarray) -> np.ndarray:
        s = self.signature(shingles).astype(np.uint64).reshape(self.bands, self.rows)
        return finish((s * self.factors).sum(axis=1) + self.salts).view(np.int64)


@lru_cache(1)
def _signer(bands: int, rows: int) -> Signer:
    """One a worker process: its tasks share the permutations."""
    return Signer(bands, rows)


def _signed(n: int, bands: int, rows: int):
    @F.pandas_udf("n_shingles long, digest binary, bands array<long>")
    def sign(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        make_room()
        signer = _signer(bands, rows)
        for batch in texts:
            out = []
            for text in batch:
                s = shingle_set(text, n)
                out.append((len(s), xxhash.xxh3_128_digest(s.tobytes()), signer.keys(s)) if len(s) else (0, None, None))
            yield pd.DataFrame(out, columns=["n_shingles", "digest", "bands"])

    return sign


def _sets(n: int):
    @F.pandas_udf("binary")
    def sets(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: shingle_set(t, n).tobytes())

    return sets


def common(x: bytes, y: bytes) -> int:
    """The size of the intersection of two sets of distinct 64-bit values."""
    both = np.concatenate([np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)])
    both.sort(kind="stable")
    return int((both[1:] == both[:-1]).sum())


def _common():
    @F.pandas_udf("long")
    def sizes(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([common(x, y) for x, y in zip(a, b, strict=True)], dtype="int64")

    return sizes


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    left = pairs.join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb")), "b")
    both = left.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa")), "a")
    both = both.withColumn("common", _common()("sa", "sb"))
    union = (F.octet_length("sa") + F.octet_length("sb")).cast("long") / F.lit(8) - F.col("common")
    return both.filter(100 * F.col("common") >= percent * union).select("a", "b")


def intersections(a: list[np.ndarray], b: list[np.ndarray], width: int = 8192) -> np.ndarray:
    """The sizes of all intersections of two lists of sets: products of their membership matrices.

    Only values that both lists hold have a column; columns go in slices of bounded width.
    """
    flat_a, flat_b = np.concatenate(a), np.concatenate(b)
    shared = np.intersect1d(flat_a, flat_b)
    out = np.zeros((len(a), len(b)), np.float32)

    def cells(sets: list[np.ndarray], flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        row = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
        at = np.minimum(np.searchsorted(shared, flat), max(0, len(shared) - 1))
        held = shared[at] == flat if len(shared) else np.zeros(len(flat), bool)
        return row[held], at[held]

    (row_a, col_a), (row_b, col_b) = cells(a, flat_a), cells(b, flat_b)
    for i in range(0, len(shared), width):
        x, y = (np.zeros((n, min(width, len(shared) - i)), np.float32) for n in (len(a), len(b)))
        for m, row, col in ((x, row_a, col_a), (y, row_b, col_b)):
            own = (col >= i) & (col < i + width)
            m[row[own], col[own] - i] = 1
        out += x @ y.T
    return out.astype(np.int64)


def _values():
    @F.pandas_udf("array<long>")
    def values(shingles: pd.Series) -> pd.Series:
        return shingles.map(lambda x: np.frombuffer(x, np.int64))

    return values


def _rarest(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """members (id, n, comp) with key: the shared shingles among the rarest of each.

    Of a set that is similar enough at least percent of n are shared, so one of the n - that + 1
    rarest must be, if all sets put shingles in one order.
    """
    all_ = members.join(sets, "id").select("id", "n", "comp", F.explode(_values()("shingles")).alias("key"))
    held = all_.join(all_.groupBy("key").agg(F.count("*").alias("df")), "key")
    place = F.row_number().over(Window.partitionBy("id").orderBy("df", "key"))
    most = F.expr(f"n - (n * {percent} + 99) div 100 + 1")
    return held.withColumn("place", place).filter((F.col("place") <= most) & (F.col("df") > 1)).select("id", "n", "comp", "key")


def _in_blocks(held: DataFrame, sets: DataFrame, percent: int, block: int = 256, block_bytes: int = 16 << 20) -> DataFrame:
    """The links (a, b) between holders of frequent shingles that are of different components.

    held: key, id, comp, size and bytes of all holders. They are cut into blocks; each two blocks
    meet in a task of bounded size, where the full sets decide. Of a member's links to one
    component the first is enough.
    """
    parts = F.greatest(F.ceil(F.col("size") / block), F.ceil(F.col("bytes") / block_bytes))
    dealt = held.withColumn("own", F.pmod(F.xxhash64("id"), parts)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)))
    dealt = dealt.join(sets, "id")

    def meet(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        left, right = (rows[rows["own"] == key[i]].drop_duplicates("id").reset_index(drop=True) for i in (1, 2))
        none = pd.DataFrame({"a": pd.Series(dtype=object), "b": pd.Series(dtype=object)})
        if not len(left) or not len(right):
            return none
        sa, sb = ([np.frombuffer(x, np.uint64) for x in side["shingles"]] for side in (left, right))
        n = np.array([len(x) for x in sa])[:, None] + np.array([len(x) for x in sb])[None, :]
        c = intersections(sa, sb)
        linked = (100 * c >= percent * (n - c)) & (left["comp"].to_numpy()[:, None] != right["comp"].to_numpy()[None, :])
        i, j = np.nonzero(linked)
        if not len(i):
            return none
        found = pd.DataFrame({"a": left["id"].to_numpy()[i], "b": right["id"].to_numpy()[j], "comp": right["comp"].to_numpy()[j]})
        return found.drop_duplicates(["a", "comp"])[["a", "b"]]

    pairs = dealt.groupBy("key", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi")).applyInPandas(meet, "a binary, b binary")
    return pairs.distinct()


def _salted(rows: DataFrame, each: DataFrame, per: int = 512) -> DataFrame:
    """rows (key, id, size, ...) joined with the few rows of each by key; a bucket of many rows is met in as many shares."""
    share = F.ceil(F.col("size") / per)
    spread = each.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("in_all") / per) - 1))).drop("in_all")
    return rows.withColumn("salt", F.pmod(F.xxhash64("id"), share)).join(spread, ["key", "salt"]).drop("salt")


def _linked(docs: DataFrame, n: int, percent: int, bands: int, rows: int, leaders: int, few: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text_id, n_shingles, digest) of every row, and (digest, comp, component_id) of the classes."""
    text_id = F.xxhash64(F.coalesce("text", F.lit("")))
    signed = saved(docs.select("doc_id", text_id.alias("text_id"), _signed(n, bands, rows)("text").alias("s")).select("doc_id", "text_id", "s.*"))
    # a class is named by its digest; its text is that of any of its documents
    named = signed.filter("digest is not null and doc_id is not null")
    classes = named.groupBy("digest").agg(F.min(F.struct("doc_id", "text_id", "n_shingles", "bands")).alias("m"))
    classes = saved(classes.select(F.col("digest").alias("id"), "m.doc_id", "m.text_id", F.col("m.n_shingles").alias("n"), F.col("m.bands").alias("bands")))

    keyed = classes.select("id", "n", F.explode("bands").alias("key"))
    crowds = keyed.groupBy("key").agg(F.min(F.struct("id", "n")).alias("lead"), F.count("*").alias("size")).filter("size > 1")
    members = saved(keyed.join(crowds, "key").select("key", "id", "n", "lead", "size"))

    near_size = lambda x, y: 100 * F.least(x, y) >= percent * F.greatest(x, y)
    tested = saved(members.filter((F.col("id") != F.col("lead.id")) & near_size(F.col("n"), F.col("lead.n"))).select(F.least(F.col("lead.id"), F.col("id")).alias("a"), F.greatest(F.col("lead.id"), F.col("id")).alias("b")).distinct())
    # the texts of classes in some bucket, one each
    wanted = classes.join(members.select("id").distinct(), "id", "left_semi").select("id", "doc_id", "text_id")
    texts = docs.select("doc_id", "text", text_id.alias("text_id")).join(wanted, ["doc_id", "text_id"]).dropDuplicates(["id"])
    sets = saved(texts.select("id", _sets(n)("text").alias("shingles")))
    links = saved(verified(tested, sets, percent))
    # until the end labels need not be settled: equal ones are connected, which is all that spares a test
    near = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m"))
    first = saved(sets.select("id").join(near, "id", "left").select("id", F.least("id", "m").alias("comp")))
    comps = merged(first, links)
    forget(first)

    crowded = saved(members.filter("size > 2").select("key", "id", "n", "size"))
    forget(members)
    if leaders:
        now = crowded.join(comps, "id").select("key", "id", "n", "size", "comp")
        tries = [F.min(F.struct(F.xxhash64("id", F.lit(i)), F.struct("id", "n", "comp").alias("one")))["one"] for i in range(leaders)]
        apart = now.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.max("size").alias("in_all"), F.array(*tries).alias("leads")).filter("lo < hi")
        # written, as else the join would be dealt by the key alone, which the leaders are grouped by
        met = _salted(now, saved(apart.select("key", "in_all", F.explode(F.array_distinct("leads")).alias("lead"))))
        pairs = met.filter((F.col("comp") != F.col("lead.comp")) & near_size(F.col("n"), F.col("lead.n"))).select(F.least(F.col("id"), F.col("lead.id")).alias("a"), F.greatest(F.col("id"), F.col("lead.id")).alias("b")).distinct()
        pairs = saved(pairs.join(tested, ["a", "b"], "left_anti"))
        new = saved(verified(pairs, sets, percent))
        tested = tested.unionByName(pairs)
        if not new.isEmpty():
            links, before = links.unionByName(new), comps
            comps = merged(comps, links)
            forget(before)

    # the members of buckets still apart meet by their rare shingles
    now = crowded.join(comps, "id").select("key", "id", "n", "comp")
    apart = now.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.max("id").alias("some")).filter("lo < hi")
    open_ = saved(now.join(apart.select("key"), "key", "left_semi").select("id", "n", "comp").distinct())
    if not open_.isEmpty():
        shown = saved(_rarest(open_, sets, percent))
        frequent = shown.groupBy("key").agg(F.count("*").alias("size"), F.sum(F.col("n") * 8).alias("bytes"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo < hi").select("key", "size", "bytes")
        held = saved(shown.join(frequent, "key"))
        small = held.filter(F.col("size") <= few).select("key", F.col("id").alias("x"), "n", "comp")
        other = small.select("key", F.col("x").alias("y"), F.col("n").alias("m"), F.col("comp").alias("comp2"))
        pairs = small.join(other, "key").filter((F.col("x") < F.col("y")) & (F.col("comp") != F.col("comp2")) & near_size(F.col("n"), F.col("m"))).select(F.col("x").alias("a"), F.col("y").alias("b")).distinct()
        rare = verified(pairs.join(tested, ["a", "b"], "left_anti"), sets, percent)
        links = links.unionByName(saved(rare.unionByName(_in_blocks(held.filter(F.col("size") > few).select("key", "id", "comp", "size", "bytes"), sets, percent))))
        forget(held, shown)
    comps = components(links, comps)
    forget(crowded, sets)
    ends = classes.select("id", "doc_id").join(comps, "id", "left").select("id", "doc_id", F.coalesce("comp", "id").alias("comp"))
    least = ends.groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    return signed.drop("bands"), ends.join(least, "comp").select(F.col("id").alias("digest"), "comp", "component_id")


def near_duplicates(docs: DataFrame, n: int = 5, percent: int = 80, bands: int = 40, rows: int = 6, leaders: int = 2, few: int = 32) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id, kept. docs: doc_id, text.

    With 40 bands of 6 rows a pair at similarity 0.8 shares no band with probability 5e-6.
    """
    signed, named = _linked(docs.select("doc_id", "text"), n, percent, bands, rows, leaders, few)
    out = signed.join(named, "digest", "left").withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def deduplicated(docs: DataFrame, n: int = 5, percent: int = 80, bands: int = 40, rows: int = 6, leaders: int = 2, few: int = 32) -> DataFrame:
    """docs with one row of each group of near duplicates; rows without doc_id stay.

    The row that stays has the group's smallest doc_id, then the smallest hash of its text; of rows
    that agree in both the one with the smallest hash of its other columns. Rows without words
    group with those of the same doc_id and text alone.
    """
    signed, named = _linked(docs.select("doc_id", "text"), n, percent, bands, rows, leaders, few)
    met = signed.filter("doc_id is not null").join(named.select("digest", "comp"), "digest", "left")
    alone = F.xxhash64("doc_id", "text_id").cast("string").cast("binary")
    first = met.groupBy(F.coalesce("comp", alone).alias("comp")).agg(F.min(F.struct("doc_id", "text_id")).alias("m"))
    kept = first.select(F.col("m.doc_id").alias("doc_id"), F.col("m.text_id").alias("text_id")).distinct()
    rest = [F.col(f"`{c}`").cast("string") for c in docs.columns if c != "text"]
    row = docs.select(packed(docs).alias("row"), F.col("doc_id").alias("d"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("t"), F.xxhash64(*rest).alias("o"))
    stay = row.join(kept, (F.col("d") == F.col("doc_id")) & (F.col("t") == F.col("text_id"))).groupBy("d", "t").agg(F.min_by("row", "o").alias("row"))
    return stay.select("row.*").unionByName(docs.filter("doc_id is null"))
