"""Language ID by unigrams over pieces, all segmentations summed.

The pieces are those of a fixed public vocabulary. For each language, a word's probability is
the sum over all ways to cut it into pieces of the product of the pieces' probabilities, by a
forward algorithm. The probabilities are fitted by expectation maximisation (forward-backward)
over the word counts of all labelled documents, each counted where it lies; a text's score
is the posterior of its most probable language, from all of its words.

That posterior knows the learned languages only: of a long text in any other it is near 1 too. A
model with a gauge also says whether a text is likely at all. Its gain is what its distinct words,
each in the language that gives it most, have over a baseline of the letters of all training rows,
in nats a letter; the least gain of a language is zero, or BELOW_MEDIAN under the median of its
training rows where that is less. A text is unlikely if it falls short of that by SHORTFALL in all:
a key or a name does not make a short text unlikely, and a few words alone are hardly ever.

Words are lower-cased runs of letters, of any length. Pieces that hold anything but lower-case
letters and the sign of a word's begin fit no such word and are left out without loss. Letters
outside the vocabulary cost the same in any language.

Defined results: a null text or one without letters is `und` with score 0; without training
documents every text is; ties go to the language first in code point order; repeated rows stay
rows and count each; columns of docs named like a result give way to it.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import forget, free_name, named, once, saved, without

UNKNOWN = "und"
BEGIN = "▁"  # the vocabulary's sign for the begin of a word
SHORT = 30  # words up to this length are summed together without scaling; longer ones one by one
LETTER_FLOOR = 1e-7
BELOW_MEDIAN, SHORTFALL = 1.0, 30.0
_runs = re.compile(r"[^\W\d_]+").findall


def letters_of(run: str) -> str:
    """A run's letters alone: the pattern of runs lets some signs like Roman numerals through."""
    return run if run.isalpha() else "".join(c for c in run if c.isalpha())


def words_of(text: str | None) -> list[str]:
    """The letter runs of a text, lower-cased."""
    return [w for run in _runs(text.lower()) if (w := letters_of(run))] if text else []


class Lattice:
    """Finds the pieces in words by a trie; the forward and backward sums over all segmentations."""

    DENSE = 64  # letters with a column of their own in the table of steps; rarer ones are searched for

    def __init__(self, pieces: list[str]):
        step: dict[tuple[int, str], int] = {}
        end, used = [-1], Counter()
        for k, piece in enumerate(pieces):
            at = 0
            for c in piece:
                if (at, c) not in step:
                    step[at, c] = len(end)
                    end.append(-1)
                    used[c] += 1
                at = step[at, c]
            end[at] = k
        self.end = np.array(end, np.int32)
        self.longest = max(map(len, pieces), default=1)
        codes = {c: i for i, (c, _) in enumerate(used.most_common(), 1)}
        self.code = np.zeros(0x110000, np.int32)  # 0: in no piece
        self.code[[ord(c) for c in codes]] = list(codes.values())
        self.table = np.zeros((len(end), self.DENSE), np.int32)
        self.width = np.int64(len(codes) + 1)
        rare = sorted((at * int(self.width) + codes[c], to) for (at, c), to in step.items() if codes[c] >= self.DENSE)
        self.keys, self.to = np.array([x[0] for x in rare], np.int64), np.array([x[1] for x in rare], np.int32)
        for (at, c), to in step.items():
            if codes[c] < self.DENSE:
                self.table[at, codes[c]] = to

    def codes(self, words: str) -> np.ndarray:
        return self.code[np.frombuffer(words.encode("utf-32-le", "surrogatepass"), np.uint32)]

    def step(self, node: np.ndarray, code: np.ndarray) -> np.ndarray:
        """Where each node goes with a letter; 0 for nowhere."""
        rare = code >= self.DENSE
        if not rare.any():
            return self.table[node, code]
        out = self.table[node, np.where(rare, 0, code)]
        at = np.flatnonzero(rare)
        if len(self.keys):
            key = node[at] * self.width + code[at]
            place = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            out[at] = np.where(self.keys[place] == key, self.to[place], 0)
        return out

    def arcs(self, words: list[str]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """Of words of one length: from, to, rows and pieces, by rising start; a single letter always passes."""
        code = self.codes("".join(words)).reshape(len(words), -1)
        n, none = code.shape[1], -1
        for i in range(n):
            rows, node = np.arange(len(words)), np.zeros(len(words), np.int32)
            for j in range(i + 1, n + 1):
                node = self.step(node, code[rows, j - 1])
                ids = self.end[node]
                if j == i + 1:
                    yield i, j, rows, ids  # -1: the last row of the probabilities, the floor
                else:
                    hit = ids > none
                    if hit.any():
                        yield i, j, rows[hit], ids[hit]
                on = node > 0
                if not on.all():
                    rows, node = rows[on], node[on]
                    if not len(rows):
                        break

    def forward(self, words: list[str], p: np.ndarray) -> tuple[np.ndarray, np.ndarray, list]:
        """For words of one length, SHORT at most: log sums (word, language), alphas, and the arcs.

        p: (piece, language), the last row that of a letter in no piece.
        """
        alpha = np.zeros((len(words[0]) + 1, len(words), p.shape[1]))
        alpha[0] = 1.0
        arcs = list(self.arcs(words))
        for i, j, rows, ids in arcs:
            if len(rows) == len(words):
                alpha[j] += alpha[i] * p[ids]
            else:
                alpha[j, rows] += alpha[i, rows] * p[ids]
        return np.log(alpha[-1]), alpha, arcs

    def expected(self, words: list[str], counts: np.ndarray, p: np.ndarray, lang: int) -> np.ndarray:
        """The expected uses of each piece in words of one length, under one language."""
        q = p[:, lang : lang + 1]
        if len(words[0]) > SHORT:
            return sum(self._expected_long(w, n, q[:, 0]) for w, n in zip(words, counts, strict=True))
        _, alpha, arcs = self.forward(words, q)
        beta = np.zeros_like(alpha)
        beta[-1] = 1.0
        weight, uses = counts / alpha[-1, :, 0], []
        for i, j, rows, ids in reversed(arcs):
            flow = q[ids, 0] * beta[j, rows, 0]
            beta[i, rows, 0] += flow
            uses.append(weight[rows] * alpha[i, rows, 0] * flow)
        return np.bincount(np.concatenate([x[3] for x in reversed(arcs)]) % len(p), weights=np.concatenate(uses), minlength=len(p))

    def ending(self, word: str, stretch: int = 1 << 16) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each end in a word of any length: the pieces' lengths and ids, found stretch by stretch."""
        code = self.codes(word)
        n = len(code)
        held: dict[int, list] = defaultdict(list)
        for a in range(0, n, stretch):
            start = np.arange(a, min(n, a + stretch))
            node = np.zeros(len(start), np.int32)
            for k in range(1, self.longest + 1):
                start, node = start[start + k <= n], node[start + k <= n]
                node = self.step(node, code[start + k - 1])
                ids = self.end[node]
                hit = (ids >= 0) if k > 1 else np.ones(len(ids), bool)
                for s, x in zip(start[hit].tolist(), ids[hit].tolist(), strict=True):
                    held[s + k].append((k, x))
                start, node = start[node > 0], node[node > 0]
                if not len(start):
                    break
            for j in range(a + 1, min(n, a + stretch) + 1):
                own = sorted(held.pop(j))
                yield j, np.array([x[0] for x in own]), np.array([x[1] for x in own])

    def long_sum(self, word: str, p: np.ndarray, keep: bool = False) -> tuple[np.ndarray, list]:
        """The log sum of one word of any length by language; with keep also each end's alphas and scale."""
        near = np.zeros((self.longest + 1, p.shape[1]))  # the last alphas, scaled so that the newest is 1
        near[0] = 1.0
        scale, kept = np.zeros(p.shape[1]), []
        for _, k, ids in self.ending(word):
            new = (near[k - 1] * p[ids]).sum(axis=0)
            scale = scale + np.log(new)
            near[1:] = near[:-1] / new
            near[0] = 1.0
            if keep:
                kept.append((k, ids, new[0]))
        return scale, kept

    def _expected_long(self, word: str, count: float, q: np.ndarray) -> np.ndarray:
        out = np.zeros(len(q))
        _, kept = self.long_sum(word, q[:, None], keep=True)
        # alphas scaled to 1 at every end: between two ends lies the product of the factors
        factor = np.log([x[2] for x in kept])
        total = np.concatenate([[0.0], np.cumsum(factor)])
        n = len(kept)
        beta = np.full(n + 1, -np.inf)  # logs, of the betas times the alphas at their place
        beta[n] = 0.0
        for j in range(n, 0, -1):
            k, ids, _ = kept[j - 1]
            flow = beta[j] + np.log(q[ids]) + total[j - k] - total[j]
            out += np.bincount(ids % len(q), weights=count * np.exp(flow), minlength=len(q))
            beta[j - k] = np.logaddexp(beta[j - k], flow)
        return out


def usable(pieces: list[str]) -> list[str]:
    """The vocabulary's lower-case letter pieces, in order, once each."""
    return list(dict.fromkeys(p for p in pieces if p.removeprefix(BEGIN).isalpha() and p == p.lower()))


def by_length(words: list[str]) -> dict[int, list[int]]:
    out = defaultdict(list)
    for i, w in enumerate(words):
        out[len(w)].append(i)
    return out


class Model:
    """letters: the baseline's log probabilities, least: the least gain of each language; None without a gauge."""

    def __init__(self, langs: list[str], pieces: list[str], p: np.ndarray, prior: np.ndarray):
        self.langs, self.pieces, self.p, self.prior = langs, pieces, p, prior
        self.letters: dict[str, float] | None = None
        self.least: np.ndarray | None = None


class Scorer:
    """Texts to languages; the scores of runs seen are kept, within a bound of runs and of letters."""

    def __init__(self, model: Model, max_words: int = 200_000, max_letters: int = 10_000_000):
        self.model, self.max_words, self.max_letters = model, max_words, max_letters
        self.lattice = Lattice(model.pieces)
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.held = 0  # letters of the runs known
        # row 0: of a run without letters
        self.rows = np.zeros((1, len(self.model.langs)))
        self.gains = np.zeros((1, 2))  # over the baseline, and letters, the begin included

    def learn(self, runs: list[str]) -> None:
        words = list(map(letters_of, runs))
        real = [i for i, w in enumerate(words) if w]
        rows = np.empty((len(real), len(self.model.langs)))
        for n, at in by_length([words[i] for i in real]).items():
            for k in range(0, len(at), 5_000):
                own = at[k : k + 5_000]
                full = [BEGIN + words[real[i]] for i in own]
                rows[own] = self.lattice.forward(full, self.model.p)[0] if n < SHORT else [self.lattice.long_sum(w, self.model.p)[0] for w in full]
        place = dict.fromkeys(runs, 0)
        place.update(zip((runs[i] for i in real), range(len(self.rows), len(self.rows) + len(real)), strict=True))
        self.known.update(place)
        self.held += sum(map(len, runs))
        self.rows = np.concatenate([self.rows, rows])
        if (own := self.model.letters) is not None:
            other = -math.log(max(len(own), 1))  # letters of no training row: as an average one
            base = [sum(own.get(c, other) for c in BEGIN + words[i]) for i in real]
            gains = np.array([rows.max(axis=1) - base, [len(words[i]) + 1 for i in real]]).T
            self.gains = np.concatenate([self.gains, gains.reshape(-1, 2)])

    def gain(self, at: np.ndarray, best: int) -> tuple[float | None, bool | None]:
        """A text's gain a letter, and whether that is likely in its best language."""
        if self.model.letters is None:
            return None, None
        total, n = self.gains[np.unique(at)].sum(axis=0)
        return float(total / n), None if self.model.least is None else bool(total >= n * self.model.least[best] - SHORTFALL)

    def score(self, texts: list[str | None]) -> list[tuple[str, float, float | None, bool | None]]:
        if not self.model.langs:
            return [(UNKNOWN, 0.0, None, False)] * len(texts)
        if len(self.known) > self.max_words or self.held > self.max_letters:
            self.clear()
        split = [_runs(t.lower()) if t else [] for t in texts]
        new = {w for runs in split for w in runs if w not in self.known}
        if new:
            self.learn(sorted(new))
        out = []
        for runs in split:
            at = np.fromiter(map(self.known.__getitem__, runs), np.int64, len(runs))
            at = at[at > 0]
            if not len(at):
                out.append((UNKNOWN, 0.0, None, False))
                continue
            x = self.rows[at].sum(axis=0) + self.model.prior
            best = int(x.argmax())
            out.append((self.model.langs[best], float(1 / np.exp(x - x[best]).sum()), *self.gain(at, best)))
        return out


def fit(docs: DataFrame, pieces: list[str], train: Column, docs_per_lang: int | None = None, rounds: int = 3, gauge: bool = False, parts: int = 32) -> Model:
    """docs: doc_id, text, lang. Learns all labels from all rows where train holds and lang is not null.

    Tasks count the words of their texts before anything is shuffled; a round goes over the distinct words of each
    language. The medians of a gauge are those of all these rows, too. parts: tasks of a round. docs_per_lang: for a caller
    that wants a sample of about so many rows a language, by hash; nothing here asks for one.
    """
    spark = docs.sparkSession
    rows = docs.filter(train & F.col("lang").isNotNull()).select("doc_id", "text", "lang")
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    langs = sorted(counts)
    pieces = usable(pieces)
    if not langs:
        return Model([], pieces, np.empty((len(pieces) + 1, 0)), np.empty(0))

    if docs_per_lang is not None:
        part = F.create_map(*[F.lit(x) for k in langs for x in (k, min(1.0, docs_per_lang / counts[k]))])[F.col("lang")]
        rows = rows.filter(F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(1_000_000)) < part * 1_000_000)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[str, Counter] = defaultdict(Counter)

        def told() -> pd.DataFrame:
            out = [(lang, word, n) for lang, own in seen.items() for word, n in own.items()]
            seen.clear()
            return pd.DataFrame(out, columns=["lang", "word", "n"]).astype({"n": "int64"})

        for batch in batches:
            for lang, text in zip(batch["lang"], batch["text"], strict=True):
                seen[lang].update(words_of(text))
            if sum(map(len, seen.values())) > 200_000:
                yield told()
        yield told()

    words = rows.select("lang", "text").mapInPandas(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    tally = saved(words.repartition(parts, F.xxhash64("lang", "word")))
    v = len(pieces) + 1
    p = np.full((v, len(langs)), 1.0 / v)
    p[-1] = LETTER_FLOOR
    own_pieces = spark.sparkContext.broadcast(pieces)
    for _ in range(rounds):
        sent = spark.sparkContext.broadcast(p)

        def expect(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            lattice, p = once("lattice", own_pieces, Lattice), sent.value
            total = np.zeros((len(langs), len(p)))
            held: dict[str, dict[str, int]] = defaultdict(dict)

            def add(lang: str) -> None:
                words, k = [BEGIN + w for w in held[lang]], langs.index(lang)
                n = np.array(list(held.pop(lang).values()), float)
                for _, at in by_length(words).items():
                    for i in range(0, len(at), 5000):
                        part = at[i : i + 5000]
                        total[k] += lattice.expected([words[x] for x in part], n[part], p, k)

            for batch in batches:
                for lang, word, n in batch.itertuples(index=False):
                    held[lang][word] = n
                for lang in [x for x, own in held.items() if len(own) > 20_000]:
                    add(lang)
            for lang in list(held):
                add(lang)
            lang, piece = np.nonzero(total)
            yield pd.DataFrame({"lang": lang, "piece": piece, "uses": total[lang, piece]})

        uses = tally.mapInPandas(expect, "lang int, piece int, uses double").groupBy("lang", "piece").agg(F.sum("uses").alias("uses"))
        c = np.zeros((v, len(langs)))  # at most vocabulary times languages rows
        got = uses.toPandas()
        c[got["piece"], got["lang"]] = got["uses"]
        c[-1] = 0
        p = (c + 0.05) / (c + 0.05).sum(axis=0)
        p[-1] = LETTER_FLOOR
        sent.unpersist()
    all_ = sum(counts.values())
    model = Model(langs, pieces, p, np.log([counts[k] / all_ for k in langs]))
    if gauge:
        c = tally.select(F.explode(F.split(F.concat(F.lit(BEGIN), "word"), "")).alias("letter"), "n").groupBy("letter").agg(F.sum("n").alias("n")).collect()
        uses = sum(r["n"] for r in c)
        model.letters = {r["letter"]: math.log(r["n"] / uses) for r in c}  # an alphabet's rows
        mid = {r["lang"]: r["mid"] for r in identify(rows, model).groupBy("lang").agg(F.percentile_approx("gain", 0.5).alias("mid")).collect()}
        # a language without letters in its rows has no median and rejects nothing
        model.least = np.array([-np.inf if mid.get(k) is None else min(0.0, mid[k] - BELOW_MEDIAN) for k in langs])
    forget(tally)
    return model


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """docs plus lang_pred and score, from text alone; with a gauge gain and likely, else null."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double, gain double, likely boolean")
    def scored(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scorer = once("langid", sent, Scorer)
        for batch in texts:
            rows = []
            for i in range(0, len(batch), 256):
                rows += scorer.score(batch.iloc[i : i + 256].tolist())
            yield pd.DataFrame(rows, columns=["lang_pred", "score", "gain", "likely"]).astype({"gain": "float64", "likely": "boolean"})

    own = without(docs, "lang_pred", "score", "gain", "likely")
    said = free_name(own, "said")
    return own.withColumn(said, scored("text")).select(*named(own), f"{said}.*")
