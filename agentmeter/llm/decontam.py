"""Benchmark decontamination: Wu-Manber multi-pattern search over words.

A pattern is a window of `window` consecutive words of a benchmark item (all of an item that has
fewer). A shift table over blocks of two words tells how far the search may go on; where a block
ends some pattern, the patterns under the hash of that suffix are compared word by word.
Patterns of one length share a table, since the shortest pattern bounds every shift.

The patterns go to the workers in parts of bounded size, one after the other: a worker and the
driver hold one part at a time. A benchmark of one part is searched without a join or shuffle; of
more parts each pass writes what it hit, and the hits of all meet the documents in one join.

Defined results: a null or empty text has no words and no hits; an item without words has no
window; an empty benchmark hits nothing; equal windows of several items count for each; repeated
rows stay rows; a column of docs named found gives way to the result.
"""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce
from itertools import chain

import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, named, once, packed, saved, without

#: Fixed by the contract: words of the lower-cased text, here over its UTF-8 bytes.
PLAIN_WORD = rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_words = re.compile(PLAIN_WORD).findall


def words_of(text: str | None) -> list[bytes]:
    """The words of a text, only A-Z lower-cased (bytes.lower leaves all but ASCII alone)."""
    return _words(text.encode().lower()) if text else []


def windows(words: list[bytes], n: int) -> list[tuple[bytes, ...]]:
    """Every run of n words; all words if fewer; none without words."""
    if not words:
        return []
    return [tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))]


class Searcher:
    """The tables of one set of patterns: window -> item ids."""

    BLOCK = 2

    def __init__(self, patterns: dict[tuple[bytes, ...], set]):
        self.parts = []
        by_length = defaultdict(list)
        for p in patterns:
            by_length[len(p)].append(p)
        for m, own in sorted(by_length.items()):
            b = min(self.BLOCK, m)
            shift: dict[object, int] = {}
            buckets = defaultdict(list)
            for p in own:
                for end in range(b, m + 1):
                    block = p[end - 1] if b == 1 else p[end - b : end]
                    shift[block] = min(shift.get(block, m - b + 1), m - end)
                buckets[p[m - b :]].append((p, patterns[p]))
            self.parts.append((m, b, shift, {k[0] if b == 1 else k: v for k, v in buckets.items()}))

    def hits(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """The runs [from, to) that the occurring patterns cover, and the ids of their items."""
        runs, items = [], set()
        for m, b, shift, buckets in self.parts:
            at, far, n = m - 1, m - b + 1, len(words)
            while at < n:
                block = words[at] if b == 1 else (words[at - 1], words[at])
                step = shift.get(block, far)
                if step:
                    at += step
                    continue
                first = at - m + 1
                for p, ids in buckets[block]:
                    if words[first] == p[0] and tuple(words[first : at + 1]) == p:
                        runs.append((first, at + 1))
                        items |= ids
                at += 1
        return runs, items


def _covered(runs: list[tuple[int, int]]) -> int:
    total, end = 0, 0
    for a, b in sorted(runs):
        total += max(0, b - max(a, end))
        end = max(end, b)
    return total


def _parts(benchmark: DataFrame, window: int, part_bytes: int) -> Iterator[dict]:
    """The benchmark's windows in parts of bounded size; the driver holds one part at a time."""
    part, size = defaultdict(set), 0
    for item, text in benchmark.select("item_id", "text").toLocalIterator():
        for w in windows(words_of(text), window):
            if w not in part:
                size += 64 + 8 * len(w) + sum(map(len, w))
            part[w].add(str(item))
        if size > part_bytes:
            yield dict(part)
            part, size = defaultdict(set), 0
    yield dict(part)


def _search(sent: Broadcast):
    """The column function that searches a text for the patterns sent."""

    @F.pandas_udf("n_words long, runs array<struct<a:int,b:int>>, items array<string>")
    def search(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        searcher = once("patterns", sent, Searcher)
        for batch in texts:
            rows = []
            for text in batch:
                words = words_of(text)
                runs, items = searcher.hits(words)
                rows.append((len(words), runs, sorted(items)))
            yield pd.DataFrame(rows, columns=["n_words", "runs", "items"])

    return search


def find(docs: DataFrame, benchmark: DataFrame, window: int = 13, share: float = 0.05, part_bytes: int = 64 << 20) -> DataFrame:
    """docs with a struct `found`: n_words, n_hit, n_items, items_sha256, contaminated.

    docs: text and any other columns. Contaminated: n_hit > 0 and n_hit >= share * n_words.
    """
    spark = docs.sparkSession
    least = round(1 / share)
    docs = without(docs, "found")

    @F.pandas_udf("n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")
    def judge(n_words: pd.Series, runs: pd.Series, items: pd.Series) -> pd.DataFrame:
        rows = []
        for n, r, own in zip(n_words, runs, items, strict=True):
            own, hit = sorted(set(own)), _covered([(x["a"], x["b"]) for x in r])
            rows.append((n, hit, len(own), hashlib.sha256(",".join(own).encode()).hexdigest(), hit > 0 and least * hit >= n))
        return pd.DataFrame(rows, columns=["n_words", "n_hit", "n_items", "items_sha256", "contaminated"])

    parts = _parts(benchmark, window, part_bytes)
    first, second = next(parts), next(parts, None)
    if second is None:
        s = free_name(docs, "s")
        one = docs.withColumn(s, _search(spark.sparkContext.broadcast(first))("text"))
        return one.select(*named(docs), judge(f"{s}.n_words", f"{s}.runs", f"{s}.items").alias("found"))
    # rows are numbered once, in what is written, so that every pass means the same rows
    numbered = saved(docs.select(F.monotonically_increasing_id().alias("id"), packed(docs).alias("row")))
    passes, sizes = [], None
    for part in chain([first, second], parts):
        sent = spark.sparkContext.broadcast(part)
        searched = numbered.select("id", _search(sent)("row.text").alias("s"))
        if sizes is None:
            searched = saved(searched)
            sizes = searched.select("id", "s.n_words")
        passes.append(saved(searched.filter("size(s.runs) > 0").select("id", "s.runs", "s.items")))
        sent.unpersist()
    hits = reduce(DataFrame.unionByName, passes).groupBy("id").agg(F.flatten(F.collect_list("runs")).alias("runs"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))
    none = F.expr("array()")
    met = numbered.join(sizes, "id").join(hits, "id", "left").select("row", "n_words", F.coalesce("runs", none.cast("array<struct<a:int,b:int>>")).alias("runs"), F.coalesce("items", none.cast("array<string>")).alias("items"))
    return met.select("row.*", judge("n_words", "runs", "items").alias("found"))
