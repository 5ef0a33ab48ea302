"""URL filters by a cascade of Bloom filters.

The first level holds the listed keys. Every key of the corpus's universe that it wrongly lets
through goes into the second level, every listed key that the second wrongly lets through into
the third, and so on until a level errs on none. A key of the universe is listed exactly if it
passes an odd number of levels before the first that it fails. The levels are as large as the
listed keys and their false positives ask, are checked against a bound, and are all that a
worker needs: pages are judged without a join.

Rules are (host, path): one fits its host and all subdomains if the url's path starts with the
rule's path. The keys of a url are its host's endings times its path's beginnings, of as many
labels and characters as some rule has; the universe holds those of all pages.

Defined results: a null url or one without :// has empty host and path and fits no rule; a url
that fits none gets the default verdict; repeated rows stay rows; columns of pages named host, path,
rule or verdict give way to the result; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import forget, packed, saved, without

SEP = "\x00"


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


def places(key: str, level: int, n_bits: int, k: int) -> list[int]:
    h = xxhash.xxh3_128_intdigest(key, seed=level)
    a, b = h & (2**64 - 1), h >> 64 | 1
    return [(a + i * b) % n_bits for i in range(k)]


@dataclass
class Level:
    words: np.ndarray  # 64 bits each
    n_bits: int
    k: int

    def has(self, key: str, level: int) -> bool:
        return all(int(self.words[p >> 6]) >> (p & 63) & 1 for p in places(key, level, self.n_bits, self.k))


class Cascade:
    """Levels built by Spark over listed and universe, both with a column key."""

    def __init__(self, levels: list[Level]):
        self.levels = levels

    def __contains__(self, key: str) -> bool:
        passed = 0
        for i, level in enumerate(self.levels):
            if not level.has(key, i):
                break
            passed += 1
        return passed % 2 == 1

    @classmethod
    def build(cls, listed: DataFrame, universe: DataFrame, bits_per_key: float = 10.0, k: int = 7, max_bits: int = 2**31, max_levels: int = 40) -> Cascade:
        inside = listed.select("key").distinct()
        outside = universe.select("key").distinct().join(inside, "key", "left_anti")
        levels: list[Level] = []
        coded, other = inside, outside
        for i in range(max_levels):
            n = coded.count()
            if not n:
                break
            n_bits = 1 << max(6, int(np.ceil(np.log2(n * bits_per_key))))
            if n_bits > max_bits:
                raise ValueError(f"level {i} needs {n_bits} bits for {n} keys; the bound is {max_bits}: list fewer keys a cascade")
            levels.append(cls._level(coded, i, n_bits, k))
            coded, other = cls._passing(other, levels[-1], i), coded
        else:
            raise RuntimeError("the cascade did not end")
        return cls(levels)

    @staticmethod
    def _level(keys: DataFrame, i: int, n_bits: int, k: int) -> Level:
        @F.pandas_udf("array<long>")
        def bits(keys: pd.Series) -> pd.Series:
            return keys.map(lambda x: places(x, i, n_bits, k))

        place = keys.select(F.explode(bits("key")).alias("p"))
        words = place.groupBy(F.expr("p div 64").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p % 64 as int))")).alias("b"))
        out = np.zeros(n_bits // 64, np.uint64)  # at most max_bits
        for w, b in words.toLocalIterator():
            out[w] = b % 2**64
        return Level(out, n_bits, k)

    @staticmethod
    def _passing(keys: DataFrame, level: Level, i: int) -> DataFrame:
        sent = keys.sparkSession.sparkContext.broadcast(level)

        @F.pandas_udf("boolean")
        def passes(keys: pd.Series) -> pd.Series:
            return keys.map(lambda x: sent.value.has(x, i))

        return keys.filter(passes("key"))


def with_host_and_path(pages: DataFrame) -> DataFrame:
    """pages with host and path, as the contract splits urls."""
    rest = F.when(F.locate("://", "url") > 0, F.expr("substring(url, locate('://', url) + 3)")).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    pages = without(pages, "host", "path", "rule", "verdict")
    return pages.select("*", host.alias("host"), path.alias("path"))


def keys_of(host: str, path: str, labels: Sequence[int], lengths: Sequence[int]) -> list[str]:
    """The url's keys, longest first (of equal length the longer host first)."""
    parts = host.rsplit(".", max(labels))
    ends = [".".join(parts[-n:]) for n in labels if n <= len(parts)] if host else []
    return [h + SEP + path[:n] for h, n in sorted(((h, n) for h in ends for n in lengths if n <= len(path)), key=lambda x: (-len(x[0]) - x[1], -len(x[0])))]


def judge(pages: DataFrame, rules: Sequence[Rule], default: str = "allow") -> DataFrame:
    """pages (with url) plus host, path, rule, verdict."""
    spark: SparkSession = pages.sparkSession
    labels = sorted({r.host.count(".") + 1 for r in rules})
    lengths = sorted({len(r.path) for r in rules})

    @F.pandas_udf("array<string>")
    def keys(host: pd.Series, path: pd.Series) -> pd.Series:
        return pd.Series([keys_of(h, p, labels, lengths) for h, p in zip(host, path, strict=True)])

    split = with_host_and_path(pages)
    universe = split.select("host", "path").distinct().select(F.explode(keys("host", "path")).alias("key")).distinct()
    universe = saved(universe)  # every level of every verdict reads it
    cascades = {}
    for verdict in sorted({r.verdict for r in rules}):
        listed = spark.createDataFrame([(r.host + SEP + r.path,) for r in rules if r.verdict == verdict], "key string")
        cascades[verdict] = Cascade.build(listed, universe)
    forget(universe)
    sent = spark.sparkContext.broadcast(cascades)

    @F.pandas_udf("rule string, verdict string")
    def probe(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        known: dict[str, str | None] = {}
        for host, path in batches:
            rows = []
            for h, p in zip(host, path, strict=True):
                row = (None, default)
                for key in keys_of(h, p, labels, lengths):
                    if key not in known:
                        if len(known) > 500_000:
                            known.clear()
                        known[key] = next((v for v, c in sent.value.items() if key in c), None)
                    if known[key]:
                        row = (key.replace(SEP, ""), known[key])
                        break
                rows.append(row)
            yield pd.DataFrame(rows, columns=["rule", "verdict"])

    return split.select(packed(split).alias("row"), probe("host", "path").alias("judged")).select("row.*", "judged.*")
