"""Toxicity: a learned lexicon in a trie, met by the Levenshtein automaton of each word, and scores of what stands around.

The lexicon holds words, and beginnings of words, that labelled toxic documents have and clean ones
lack: Spark counts the documents of either kind for every word and beginning, and the words it stands behind, so that
copies of a document are no evidence; a likelihood ratio picks. A word of a text is the automaton; its states are rows of edit distances cut at the allowed number of
edits, and the walk over the trie goes down a branch only while its state can still end in a match.
What differs from an entry by an edit (two from `two_from` letters on), by signs for letters or by
letters drawn out counts as its misspelling, unless clean documents hold that very word. How far a
misspelling is believed follows from how many such words clean documents have that were seen once (Good and Turing).

Around each hit a window of words is judged: quotation marks about it and words of reporting speak for quotation,
words of address for abuse. An entry speaks for toxicity by the share of toxic documents that have it against
the chance that clean words as many as the document's hold it so often, and as its hits' best context lets it; a text
that is long for its few hits loses up to `far`. The sum is the log odds of the score; documents without a hit have
their share of toxic ones.

Learned are labels of a bounded sample (`max_train` labels); labels beyond teach nothing. What is
learned does not grow with the corpus: `max_entries` entries at most.

Defined results: null and empty texts have no hit and get the score of documents without one;
without labels of both kinds every score is the share of label 1, or 0.5 without labels; a label repeated counts once, a
document with both labels as one of each; rows that repeat a labelled doc_id teach one of their texts; repeated rows stay
rows; columns of docs named like a result give way to it; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import forget, once, packed, saved, without

_words = re.compile(r"[^\W_]+(?:[@$!*|][^\W_]+)*")
_drawn = re.compile(r"(.)\1{2,}")
_signs = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "|": "i"})
_odd = re.compile(r"[0-9@$!*|]")
#: Signs that open and close quotations.
QUOTES = {'"': '"', "“": "”", "„": "“", "«": "»", "‘": "’", "”": "”"}
#: Words that report what others say, and words that address someone.
REPORTS = frozenset("said says say wrote writes quote quotes quoted called calls word words term terms means meaning sagte schrieb zitat wort begriff dit écrit mot terme citation dijo escribió palabra término cita".split())
ADDRESS = frozenset("you your you're youre ur du dich dein deine ihr tu toi ton vous votre tú usted eres".split())


@dataclass(frozen=True)
class Shape:
    """What is tried as an entry, and how many edits it allows."""

    least: int = 3  # signs of a beginning
    most: int = 8
    longest: int = 24  # signs of a word
    one_from: int = 5  # letters from which one edit is allowed
    two_from: int = 9
    misspelled: float = 0.05  # the share of an entry's uses that is misspelled
    window: int = 6
    quoted: float = -8.0  # log odds
    reported: float = -2.0
    addressed: float = 1.0
    cap: float = 7.0  # of an entry
    far: float = 3.0

    def edits(self, entry: str) -> int:
        return 0 if len(entry) < self.one_from else 1 if len(entry) < self.two_from else 2


#: Behind the entries that are whole words; in a node of the trie, the entries that end there, and the most edits below.
END, EDITS = "$", "edits"


class Trie:
    """Entries, whole words with END behind them; `near` intersects it with a word's Levenshtein automaton."""

    def __init__(self, entries: Iterator[str], shape: Shape):
        self.shape, self.entries = shape, sorted(entries)
        self.root: dict = {}
        for e in self.entries:
            node, k = self.root, shape.edits(e.removesuffix(END))
            for sign in e.removesuffix(END):
                node[EDITS] = max(node.get(EDITS, 0), k)
                node = node.setdefault(sign, {})
            node[EDITS] = max(node.get(EDITS, 0), k)
            node.setdefault(END, []).append(e)
        # a match with k edits leaves one of an entry's k + 1 pieces as it is, moved by k signs at most
        self.pieces: dict[tuple[int, int, int], set[str]] = defaultdict(set)
        for e in self.entries:
            plain, k = e.removesuffix(END), shape.edits(e.removesuffix(END))
            cuts = [len(plain) * i // (k + 1) for i in range(k + 2)]
            for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                self.pieces[b - a, max(0, a - k) if i else 0, a + k if i else 0].add(plain[a:b])
        self.least = min((len(e.removesuffix(END)) - shape.edits(e.removesuffix(END)) for e in self.entries), default=1 << 30)

    def may(self, word: str) -> bool:
        """Whether a word holds a piece of an entry near its place; without one it matches none."""
        if len(word) < self.least:
            return False
        return any(word[at : at + n] in own for (n, low, high), own in self.pieces.items() for at in range(low, high + 1))

    def near(self, word: str) -> list[tuple[str, int]]:
        """(entry, edits) of the entries within their allowed edits of the word, or of a beginning of it."""
        out, cut = [], self.root.get(EDITS, 0) + 1
        todo = [(self.root, tuple(min(i, cut) for i in range(len(word) + 1)))]
        while todo:
            node, state = todo.pop()
            for e in node.get(END, ()):
                d = state[-1] if e.endswith(END) else min(state)
                if d <= self.shape.edits(e.removesuffix(END)):
                    out.append((e, d))
            for sign, below in node.items():
                if sign in (END, EDITS):
                    continue
                step = [min(state[0] + 1, cut)]
                for i, other in enumerate(word):
                    step.append(min(state[i] + (sign != other), state[i + 1] + 1, step[i] + 1, cut))
                if min(step) <= below[EDITS]:
                    todo.append((below, tuple(step)))
        return out


@dataclass
class Lexicon:
    """Entry -> (log share of toxic documents, clean documents with it a clean word), where it stands as it is, and misspelled."""

    exact: dict[str, tuple[float, float]]
    misspelled: dict[str, tuple[float, float]]
    clean: frozenset[str]  # words that are misspellings of nothing
    shape: Shape
    without: float  # the score of a document without hits
    prior: float = 0.0  # log odds of toxicity
    rate: float = 0.0  # entries a word of toxic documents
    _trie: Trie | None = field(default=None, repr=False)

    def trie(self) -> Trie:
        if self._trie is None:
            self._trie = Trie((e for e in self.misspelled if self.shape.edits(e.removesuffix(END))), self.shape)
        return self._trie


def by_chance(rate: float, times: int) -> float:
    """Log of the chance of that many or more where `rate` are expected (Poisson)."""
    if times == 1:
        return math.log(-math.expm1(-rate))
    first = times * math.log(rate) - rate - math.lgamma(times + 1)
    more = term = 1.0
    for i in range(1, 60):
        term *= rate / (times + i)
        more += term
    return min(0.0, first + math.log(more))


class Matcher:
    """What a worker keeps: the trie and the words met."""

    def __init__(self, lexicon: Lexicon):
        self.lexicon, self.trie, self.seen = lexicon, lexicon.trie(), {}
        own = lexicon.exact
        self.whole = {e.removesuffix(END): e for e in own if e.endswith(END)}
        self.begin = {e for e in own if not e.endswith(END)}
        self.lengths = sorted({len(e) for e in self.begin})

    def exact(self, word: str) -> str | None:
        if word in self.whole:
            return self.whole[word]
        return next((word[:n] for n in self.lengths if word[:n] in self.begin), None)

    def variants(self, word: str) -> list[tuple[str, int]]:
        """Entries that the word misspells: (entry, edits)."""
        forms = {word}
        if _odd.search(word):
            forms |= {word.translate(_signs), word.replace("*", "")}
        forms |= {_drawn.sub(r"\1", x) for x in forms}
        out = []
        for form in forms:
            if form != word and (e := self.exact(form)) in self.lexicon.misspelled:
                out.append((e, 0))
            if self.trie.may(form):
                out += self.trie.near(form)
        return out

    def hit(self, word: str) -> tuple[str, bool] | None:
        """(entry, misspelled) of a lower-cased word."""
        if word in self.seen:
            return self.seen[word]
        if len(self.seen) > 300_000:
            self.seen.clear()
        found, lex = None, self.lexicon
        if e := self.exact(word):
            found = (e, False)
        elif word not in lex.clean:
            near = min(((d, e) for e, d in self.variants(word)), default=None)
            if near:
                found = (near[1], True)
        self.seen[word] = found
        return found

    def hits(self, text: str | None) -> tuple[int, list[tuple[int, int, str, bool, float]]]:
        """The number of words, and (begin, end, entry, misspelled, log odds by context) of the hits."""
        low = text.lower() if text else ""
        if len(low) != len(text or ""):  # a few capitals have two signs in lower case
            low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
        words = _words.findall(low)
        if not any(self.hit(w) for w in set(words)):
            return len(words), []
        found = [(m.start(), m.end(), m.group()) for m in _words.finditer(low)]
        quotes, shape, out = _quoted(low), self.lexicon.shape, []
        at = 0
        for i, (a, b, word) in enumerate(found):
            if not (h := self.hit(word)):
                continue
            while at < len(quotes) and quotes[at][1] < a:
                at += 1
            near = {w for _, _, w in found[max(0, i - shape.window) : i + shape.window + 1]}
            inside = at < len(quotes) and quotes[at][0] <= a
            out.append((a, b, *h, shape.quoted * inside + shape.reported * bool(near & REPORTS) + shape.addressed * bool(near & ADDRESS)))
        return len(words), out

    def score(self, words: int, hits: list[tuple]) -> float:
        if not hits:
            return self.lexicon.without
        lex, shape, total = self.lexicon, self.lexicon.shape, self.lexicon.prior
        by: dict[tuple[str, bool], list[float]] = defaultdict(list)
        for *_, e, wrong, near in hits:
            by[e, wrong].append(near)
        for (e, wrong), near in by.items():
            share, rate = (lex.misspelled if wrong else lex.exact)[e]
            best = max(near)
            speaks = share - by_chance(words * rate, max(1, sum(x >= 0 for x in near)))
            total += max(0.0, min(shape.cap, speaks) + best)
        total -= min(shape.far, words * lex.rate)
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, total))))


def _quoted(text: str, longest: int = 400) -> list[tuple[int, int]]:
    """Stretches between quotation marks, of at most `longest` signs."""
    out, at = [], 0
    for m in re.finditer("[" + "".join(QUOTES) + "]", text):
        if m.start() < at:
            continue
        end = text.find(QUOTES[m.group()], m.end(), m.end() + longest)
        if end > 0:
            out.append((m.start(), end))
            at = end + 1
    return out


def grams(words: list[str], shape: Shape, behind: bool = False) -> dict[str, int]:
    """The beginnings and whole words of a text, each with the words it stands behind as bits of a mask (0 unless asked for)."""
    masks: dict[str, int] = dict.fromkeys(words, 0)
    if behind:
        for before, w in zip(["", *words], words, strict=False):
            masks[w] |= 1 << (zlib.crc32(before.encode()) & 63)
    out: dict[str, int] = defaultdict(int)
    for w, mask in masks.items():
        for n in range(shape.least, min(shape.most, len(w)) + 1):
            out[w[:n]] |= mask
        if shape.least <= len(w) <= shape.longest:
            out[w + END] |= mask
    return out


def ratio(p: int, q: int, total_p: int, total_q: int) -> float:
    """Twice the log likelihood ratio of p of total_p against q of total_q; 0 where the share of p is not the larger."""
    n, total = p + q, total_p + total_q
    if not p or p * total_q <= q * total_p:
        return 0.0
    part = lambda seen, of: seen * math.log(seen / of) if seen else 0.0
    return 2 * sum(part(x, y * z / total) for x, y, z in ((p, n, total_p), (q, n, total_q), (total_p - p, total - n, total_p), (total_q - q, total - n, total_q)))


def chosen(counts: dict[str, tuple[int, int]], least_precision: float, pure: float) -> dict[str, tuple[int, int]]:
    """Of grams with (toxic, clean) documents: beginnings that are pure, short ones first, each made as long as it loses
    no document; then words that are precise and lie under none of them."""
    whole: dict[str, str] = {}  # beginning -> the word under it with most toxic documents
    longer: dict[str, str] = {}
    for g, (p, _) in sorted(counts.items()):
        if g.endswith(END):
            for n in range(1, len(g)):
                if p > counts.get(whole.get(g[:n], ""), (0, 0))[0]:
                    whole[g[:n]] = g
        elif p > counts.get(longer.get(g[:-1], ""), (0, 0))[0]:
            longer[g[:-1]] = g
    out: dict[str, tuple[int, int]] = {}
    for g in sorted(counts, key=lambda g: (g.endswith(END), len(g), g)):
        p, q = counts[g]
        if any(g[:n] in out for n in range(1, len(g))) or g in out or p / (p + q) < (least_precision if g.endswith(END) else pure):
            continue
        while not g.endswith(END):
            more = next((x for x in (whole.get(g), longer.get(g)) if x and counts[x][0] >= 0.95 * p), None)
            if more is None:
                break
            g = more
        out[g] = counts[g]
    return out


def learn(taught: DataFrame, shape: Shape, least_docs: int = 3, least_ratio: float = 20.0, least_precision: float = 0.8, pure: float = 0.98, max_entries: int = 2000) -> Lexicon:
    """The lexicon of labelled documents. taught: text, toxic; of bounded size.

    least_ratio: twice the log likelihood ratio from which a gram is no chance; pure: the share of toxic documents
    from which a beginning is an entry; least_precision: the same of words.
    """
    spark = taught.sparkSession
    by = dict(taught.groupBy("toxic").count().collect())
    pos, neg = by.get(1, 0), by.get(0, 0)
    share = pos / (pos + neg) if pos + neg else 0.5
    if not pos or not neg:
        return Lexicon({}, {}, frozenset(), shape, share)

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, list[int]] = defaultdict(lambda: [0, 0, 0])  # documents by gram, and masks; the words under the empty one
        rows = lambda: pd.DataFrame([(g, *c[:2], c[2] - (1 << 64) if c[2] >> 63 else c[2]) for g, c in held.items()], columns=["gram", "clean", "toxic", "behind"])
        for batch in batches:
            for text, toxic in zip(batch["text"], batch["toxic"], strict=True):
                words = _words.findall(text.lower()) if text else []
                held[""][toxic] += len(words)
                for g, mask in grams(words, shape, bool(toxic)).items():
                    own = held[g]
                    own[toxic] += 1
                    own[2] |= mask
                if len(held) > 300_000:
                    yield rows()
                    held.clear()
        yield rows()

    p, q = F.sum("toxic").alias("p"), F.sum("clean").alias("q")
    tested = taught.mapInPandas(counted, "gram string, clean long, toxic long, behind long").groupBy("gram").agg(p, q, F.bit_or("behind").alias("behind"))
    # the documents are a bounded sample, and few grams stand in toxic ones so often, so seldom in clean ones and behind many words
    varied_enough = F.bit_count("behind") >= F.greatest(F.lit(least_docs), F.least("p", F.lit(40)) / 2)
    is_good = (F.col("p") >= least_docs) & (F.col("p") >= least_precision * (F.col("p") + F.col("q"))) & varied_enough
    good = tested.filter(is_good | (F.col("gram") == "")).orderBy(F.col("gram") != "", F.col("p").desc(), "q", "gram").limit(50 * max_entries).collect()
    words = next(((r.p, r.q) for r in good if not r.gram), (0, 0))
    counts = {r.gram: (r.p, r.q) for r in good if r.gram and ratio(r.p, r.q, pos, neg) >= least_ratio}
    kept = chosen(counts, least_precision, pure)
    kept = dict(sorted(kept.items(), key=lambda x: (-ratio(*x[1], pos, neg), x[0]))[:max_entries])
    exact = {e: (math.log(p / pos), (q + 0.5) / max(1, words[1])) for e, (p, q) in kept.items()}
    # words that clean documents hold too are no names for abuse whose misspellings could be told
    lexicon = Lexicon(exact, {e: (0.0, 0.0) for e, (_, q) in kept.items() if not q}, frozenset(), shape, share, math.log(pos / neg), sum(p for p, _ in kept.values()) / max(1, words[0]))
    if not exact:
        return lexicon
    sent = spark.sparkContext.broadcast(lexicon)

    def varied(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, held, met = Matcher(sent.value), defaultdict(lambda: [0, 0]), {}
        none = {1: 0, 0: 0}
        for batch in batches:
            for text, toxic in zip(batch["text"], batch["toxic"], strict=True):
                hits = False
                for w in set(_words.findall(text.lower())) if text else ():
                    if w not in met:
                        met[w] = () if own.exact(w) else {e for e, _ in own.variants(w)}
                    hits = hits or bool(own.exact(w))
                    for e in met[w]:
                        held[e, w][toxic] += 1
                if len(met) > 300_000:
                    met.clear()
                none[toxic] += not hits
        rows = [(*k, *v) for k, v in held.items()] + [("", "", none[0], none[1])]
        yield pd.DataFrame(rows, columns=["entry", "word", "clean", "toxic"])

    seen = taught.mapInPandas(varied, "entry string, word string, clean long, toxic long").groupBy("entry", "word").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    seen = seen.filter("clean > 0 or entry = ''").collect()  # of the sample's words those near an entry
    none = next((r for r in seen if not r.entry), None)
    once_seen = Counter(r.entry for r in seen if r.clean == 1)
    lexicon.clean = frozenset(r.word for r in seen if r.entry and 2 * r.clean > r.toxic)
    # an entry whose like clean documents hold again and again has no misspellings that could be told
    told = [e for e in lexicon.misspelled if once_seen[e] < shape.misspelled * kept[e][0]]
    lexicon.misspelled = {e: (exact[e][0] + math.log(shape.misspelled), (once_seen[e] + 0.5) / max(1, words[1])) for e in told}
    lexicon.without = (none.toxic + share) / (none.clean + none.toxic + 1)
    sent.unpersist()
    return lexicon


HITS = "array<struct<begin:int,end:int,entry:string,misspelled:boolean,context:double>>"


def score(docs: DataFrame, labels: DataFrame, train_on: Column, shape: Shape | None = None, max_train: int = 20_000, cut: float = 0.5) -> DataFrame:
    """docs plus score, predicted and hits. docs: doc_id, text; labels: doc_id, toxic, of which those where train_on holds teach.

    The sample takes the labels whose hash lies under max_train over their count.
    """
    spark, shape = docs.sparkSession, shape or Shape()
    known = labels.filter(train_on & F.col("toxic").isin(0, 1)).select("doc_id", F.col("toxic").cast("int").alias("toxic")).distinct()
    n = known.count()
    sample = known.filter(F.pmod(F.xxhash64("doc_id", F.lit(29)), F.lit(1_000_000)) < min(1.0, max_train / max(1, n)) * 1_000_000)
    # a sample of bounded size: its rows are small enough to go to every worker
    met = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    taught = saved(met.dropDuplicates(["doc_id", "toxic"]).select("text", "toxic"))
    lexicon = learn(taught, shape)
    forget(taught)
    sent = spark.sparkContext.broadcast(lexicon)

    @F.pandas_udf(f"score double, hits {HITS}")
    def judged(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = once("toxic lexicon", sent, Matcher)
        for batch in batches:
            found = [own.hits(t) for t in batch]
            yield pd.DataFrame({"score": [own.score(n, h) for n, h in found], "hits": [h for _, h in found]})

    kept = without(docs, "score", "predicted", "hits")
    done = kept.select(packed(kept).alias("row"), judged("text").alias("j"))
    return done.select("row.*", "j.score", (F.col("j.score") >= cut).cast("int").alias("predicted"), "j.hits")
