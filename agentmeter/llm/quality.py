"""A quality classifier on random-indexing word vectors.

Every word has a sparse random index vector, made from its hash. Over all documents, a word's
context vector is the sum of the index vectors of the words beside it; its word vector is that,
scaled to length one, beside its own index vector. A document is the mean of its words' vectors,
with how alike words in a row are and how long the mean is. A two-layer network in numpy learns
the labels on a sample of bounded size, and a temperature, fitted on a part of it that was held
back, makes its outputs probabilities.

Words are runs of letters, of digits or of other signs, by a hash into `buckets` rows: words that
share a row share a vector, more of them the more words a corpus has. README gives the measured
effect; the number of rows, hence what a worker holds, is a parameter and does not grow.

Defined results: a null or empty text has the mean of nothing, zeros, and is scored like any
other; without labels of both kinds every score is the share of label 1, or 0.5 without labels;
a label repeated counts once, a document with both labels as one of each; columns of docs named
like a result give way to it; repeated rows stay rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import once, packed, without

_words = re.compile(r"[^\W\d_]+|\d+|[^\w\s]+|_+").findall


@dataclass(frozen=True)
class Space:
    """Buckets, dimensions and the index vectors: two places of sign +1 or -1 each."""

    buckets: int = 32_768
    dims: int = 64
    seed: int = 3

    def index(self) -> tuple[np.ndarray, np.ndarray]:
        draw = np.random.default_rng(self.seed)
        a = draw.integers(0, self.dims, self.buckets)
        b = (a + draw.integers(1, self.dims, self.buckets)) % self.dims
        return np.stack([a, b]), draw.choice([-1.0, 1.0], (2, self.buckets))


class _Buckets(dict):
    def __init__(self, n: int):
        super().__init__()
        self.n = n

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        self[word] = b = xxhash.xxh3_64_intdigest(word.encode()) % self.n
        return b


def _ids(text: str | None, buckets: _Buckets) -> np.ndarray:
    words = _words(text) if text else []
    return np.fromiter(map(buckets.__getitem__, words), np.int64, len(words))


def contexts(docs: DataFrame, space: Space) -> np.ndarray:
    """The context vectors of all buckets, from every document; the driver gets buckets x dims sums.

    A task gives one row for each bucket it met; Spark adds them up, map side first, so that no
    task holds more than its own buckets' sums however many tasks there are.
    """
    names = [f"d{i}" for i in range(space.dims)]

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        place, sign = space.index()
        own = _Buckets(space.buckets)
        total = np.zeros(space.buckets * space.dims)

        def add(left: np.ndarray, right: np.ndarray) -> None:
            # counts of each pair first: words and their neighbours repeat, and a pair's vectors are added once
            pair, n = np.unique(left * space.buckets + right, return_counts=True)
            left, right = pair // space.buckets, pair % space.buckets
            for k in range(2):
                for x, y in ((left, right), (right, left)):
                    np.add.at(total, x * space.dims + place[k, y], sign[k, y] * n)

        for batch in batches:
            held, n = [], 0
            for text in batch["text"]:
                ids = _ids(text, own)
                if len(ids) > 1:
                    held.append(ids)
                    n += len(ids)
                if n > 500_000:
                    add(np.concatenate([x[:-1] for x in held]), np.concatenate([x[1:] for x in held]))
                    held, n = [], 0
            if held:
                add(np.concatenate([x[:-1] for x in held]), np.concatenate([x[1:] for x in held]))
        rows = total.reshape(-1, space.dims)
        used = np.flatnonzero(rows.any(axis=1))
        for i in range(0, len(used), 4096):
            at = used[i : i + 4096]
            yield pd.DataFrame(rows[at], columns=names).assign(bucket=at)

    schema = ", ".join(f"{c} double" for c in names) + ", bucket long"
    sums = docs.select("text").mapInPandas(partial, schema).groupBy("bucket").agg(*[F.sum(c).alias(c) for c in names])
    got = sums.toPandas()  # at most a row a bucket
    out = np.zeros((space.buckets, space.dims))
    out[got["bucket"]] = got[names]
    return out


def word_vectors(context: np.ndarray, space: Space) -> np.ndarray:
    """Each bucket's context vector, without what all share and of length one, beside its index vector."""
    own = np.zeros((space.buckets, space.dims))
    for p, s in zip(*space.index(), strict=True):
        own[np.arange(space.buckets), p] += s
    length = np.linalg.norm(context, axis=1, keepdims=True)
    unit = context / np.maximum(length, 1e-12)
    used = length[:, 0] > 0
    unit[used] -= unit[used].mean(axis=0) if used.any() else 0
    unit /= np.maximum(np.linalg.norm(unit, axis=1, keepdims=True), 1e-12)
    return np.concatenate([unit * used[:, None], own / np.sqrt(2)], axis=1).astype(np.float32)


def pooled(ids: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """A document's vector."""
    d = vectors.shape[1]
    total, alike, same = np.zeros(d), np.zeros(2), 0
    for i in range(0, len(ids), 4096):
        rows = vectors[ids[i : i + 4097]]
        total += rows[:4096].sum(axis=0)
        for k, part in enumerate((rows[:, : d // 2], rows[:, d // 2 :])):
            near = np.einsum("ij,ij->i", part[1:], part[:-1])
            alike[k] += near.sum()
        same += int((near > 0.99).sum())  # the index vectors agree: a word after itself
    n = max(1, len(ids))
    mean = total / n
    return np.concatenate([mean, alike / n, [same / n, np.sqrt(same / n), np.linalg.norm(mean[: d // 2]), np.linalg.norm(mean[d // 2 :]), np.log1p(len(ids))]]).astype(np.float32)


@dataclass
class Network:
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.maximum((x - self.mean) / self.scale @ self.w1 + self.b1, 0) @ self.w2 + self.b2

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -40, 40)))


def train(x: np.ndarray, y: np.ndarray, hidden: int = 48, epochs: int = 60, rate: float = 3e-3, decay: float = 1e-4, seed: int = 5) -> Network:
    """Two layers by Adam on logistic loss; the weights that do best on a held-back fifth; then the temperature."""
    draw = np.random.default_rng(seed)
    d = x.shape[1]
    share = float(y.mean()) if len(y) else 0.5
    net = Network(np.zeros(d), np.ones(d), np.zeros((d, hidden)), np.zeros(hidden), np.zeros(hidden), float(np.log(max(share, 1e-6) / max(1 - share, 1e-6))))
    if len(y) < 10 or share in (0.0, 1.0):
        return net
    order = draw.permutation(len(y))
    back, fit = order[: len(y) // 5], order[len(y) // 5 :]
    net.mean, net.scale = x[fit].mean(axis=0), x[fit].std(axis=0) + 1e-3
    net.w1, net.w2 = draw.normal(0, np.sqrt(2 / d), (d, hidden)), draw.normal(0, np.sqrt(1 / hidden), hidden)
    loss = lambda t=1.0: float(np.mean(np.logaddexp(0, -(2 * y[back] - 1) * net.logits(x[back]) / t)))
    state, step, best = {}, 0, (np.inf, None)
    for _ in range(epochs):
        shuffled = draw.permutation(fit)
        for i in range(0, len(shuffled), 128):
            at = shuffled[i : i + 128]
            z = (x[at] - net.mean) / net.scale
            a = z @ net.w1 + net.b1
            h = np.maximum(a, 0)
            g = (1 / (1 + np.exp(-np.clip(h @ net.w2 + net.b2, -40, 40))) - y[at]) / len(at)
            gh = np.outer(g, net.w2) * (a > 0)
            step += 1
            for name, grad in (("w1", z.T @ gh + decay * net.w1), ("b1", gh.sum(axis=0)), ("w2", h.T @ g + decay * net.w2), ("b2", g.sum())):
                m, v = state.get(name, (0.0, 0.0))
                state[name] = m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
                setattr(net, name, getattr(net, name) - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8))
        now = loss()
        if now < best[0]:
            best = now, (net.w1, net.b1, net.w2, net.b2)
    net.w1, net.b1, net.w2, net.b2 = best[1]
    net.temperature = float(min(np.geomspace(0.25, 8, 61), key=loss))
    return net


def score(docs: DataFrame, labels: DataFrame, train_on: Column, space: Space | None = None, max_train: int = 20_000, cut: float = 0.3) -> DataFrame:
    """docs plus score and predicted. docs: doc_id, text; labels: doc_id, quality, of which those where train_on holds teach.

    The sample takes the labels whose hash lies under max_train over their count.
    """
    spark = docs.sparkSession
    space = space or Space()
    known = labels.filter(train_on & F.col("quality").isin(0, 1)).select("doc_id", F.col("quality").cast("int").alias("quality")).distinct()
    n = known.count()
    sample = known.filter(F.pmod(F.xxhash64("doc_id", F.lit(23)), F.lit(1_000_000)) < min(1.0, max_train / max(1, n)) * 1_000_000)
    sent = spark.sparkContext.broadcast(word_vectors(contexts(docs, space), space))
    width = 2 * space.dims + 7

    @F.pandas_udf("binary")
    def features(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = once("quality buckets", sent, lambda _: _Buckets(space.buckets))
        for batch in texts:
            yield pd.Series([pooled(_ids(t, own), sent.value).tobytes() for t in batch], dtype=object)

    # a sample of bounded size: its rows are small enough to go to every worker
    met = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("doc_id", "quality", features("text").alias("x"))
    # one row a label, however often a document is repeated
    taught = met.groupBy("doc_id", "quality").agg(F.min("x").alias("x"))
    # at most about max_train rows: put in an order of their own here, as a sort in Spark would make the features twice
    rows = taught.select("quality", "x").toPandas().sort_values(["x", "quality"], ignore_index=True)
    x = np.frombuffer(b"".join(rows["x"]), np.float32).reshape(-1, width).astype(float)
    net = spark.sparkContext.broadcast(train(x, rows["quality"].to_numpy(float)))

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = once("quality buckets", sent, lambda _: _Buckets(space.buckets))
        for batch in batches:
            x = np.array([pooled(_ids(t, own), sent.value) for t in batch]).reshape(-1, width)
            yield pd.Series(net.value.scores(x.astype(float)))

    kept = without(docs, "score", "predicted")
    done = kept.select(packed(kept).alias("row"), scored("text").alias("score"))
    return done.select("row.*", "score", (F.col("score") >= cut).cast("int").alias("predicted"))
