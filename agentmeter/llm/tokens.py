"""Token counts by a compiled finite-state transducer.

Byte-pair encoding is compiled into a deterministic transducer over bytes. After each byte, one
token ends the encoding of the bytes so far, and the tokens before it are those of a shorter
prefix; so a state needs the last tokens only as far back as some token of the vocabulary may
still reach. A transition carries the change in the number of emitted tokens, and the count of a
piece is their sum. The driver compiles the states along every token of the vocabulary once and
sends them out. There are more states than a table can hold (any token may stand before any begin
of another): those that texts ask for beyond are added by the workers, within a bound.

A text is cut into chunks, and each chunk gives a state map: rows (state at its begin, state at its
end, tokens between). A state is no open piece, or the token that lies over the border and how many
of its bytes lie beyond: what a chunk's neighbour needs to know of it. Where pieces begin shows from
a few signs around, so a piece counts where it begins, and only one that goes on for long after the
border leaves it open; then the map has a row for each pair of tokens that the bytes around both
borders allow. Token sequences whose neighbours all fit are encodings, and a text has one, so just
one way leads through all maps. Maps compose associatively: Spark composes them in a tree.

The vocabulary is a byte-level BPE file of the tokenizers library, whose counts these equal:
without begin, end or added special tokens, special strings inside a text one token each.

Defined results: a null or empty text has no bytes and no tokens; repeated rows stay rows.
"""

from __future__ import annotations

import json
import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, repeated, saved

#: Fixed values of the public pattern: white space by Unicode, and what may follow an apostrophe.
WHITE = [0x20, *range(0x09, 0x0E), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
CONTRACTED = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")
OTHER, LETTER, NUMBER, BLANK, SPACE = range(5)


def _classes() -> np.ndarray:
    kind = {"L": LETTER, "N": NUMBER}
    out = np.array([kind.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)], np.uint8)
    out[WHITE] = BLANK
    out[0x20] = SPACE
    return out


def _byte_signs() -> dict[str, int]:
    """The sign that stands for each byte in the vocabulary file: itself if printable, else the next from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Merges of a byte-level BPE file, by bytes. Ranks: merges in order; single bytes before them."""

    def __init__(self, source: str):
        spec = json.loads(source)
        signs = _byte_signs()
        code = lambda x: bytes(signs[c] for c in x)
        self.rank: dict[bytes, int] = {bytes([b]): b for b in range(256)}
        self.parts: list[tuple[int, int] | None] = [None] * 256
        self.pair: dict[tuple[int, int], int] = {}
        for merge in spec["model"]["merges"]:
            left, right = map(code, merge if isinstance(merge, list) else merge.split(" "))
            a, b = self.rank[left], self.rank[right]
            if (a, b) in self.pair:
                continue
            new = self.rank.setdefault(left + right, len(self.parts))
            if new == len(self.parts):
                self.parts.append((a, b))
            self.pair[a, b] = new
        self.starts = {t[:i] for t in self.rank for i in range(1, len(t))}
        self.longest = max(map(len, self.rank))
        self.special = [x["content"] for x in spec.get("added_tokens", ())]

    def from_(self, data: bytes, at: int, end: int) -> Iterator[tuple[int, int]]:
        """The tokens that data has from a place on, up to end, the shortest first."""
        for to in range(at + 1, min(end, at + self.longest) + 1):
            own = data[at:to]
            token = self.rank.get(own)
            if token is not None:
                yield to, token
            if own not in self.starts:
                return


class Transducer:
    """Counts the tokens of a piece of text, byte by byte."""

    def __init__(self, vocabulary: Vocabulary, max_states: int = 400_000, max_pieces: int = 1_200_000):
        self.v, self.max_states, self.max_pieces = vocabulary, max_states, max_pieces
        self.fits: dict[tuple[int, int], bool] = {}
        self.whole: dict[int, bool] = {}
        self.pieces: dict[str, int] = {}
        self.reset()

    def reset(self) -> None:
        self.go: dict[int, int] = {}
        # a state: the bytes that some token may still take in; of each prefix that they may
        # start from, the last token (-1: nothing yet, -2: no token starts there) and its count less the count so far
        self.states: list[tuple[bytes, tuple[int, ...], tuple[int, ...]]] = [(b"", (-1,), (0,))]
        self.ids = {self.states[0]: 0}

    def meet(self, left: int, right: int) -> bool:
        """Whether the encoding of left's and right's bytes together is left, right."""
        key = (left, right)
        if key not in self.fits:
            if len(self.fits) > 2_000_000:
                self.fits.clear()
            self.fits[key] = self._meet(left, right)
        return self.fits[key]

    def _meet(self, left: int, right: int) -> bool:
        """Whether no merge over the border comes before those that take its sides in.

        Merges come in the order of their ranks, equal ones from the left. Going back in time,
        the side made later is undone; in between, the border pair stands side by side until
        one of its sides is taken in.
        """
        parts = self.v.parts
        over_left = over_right = 1 << 60  # the merges that take in the left and the right side
        while True:
            new = self.v.pair.get((left, right))
            if new is not None and new < over_left and new <= over_right:
                return False
            if left > right:
                if parts[left] is None:
                    return True
                over_left, left = left, parts[left][1]
            else:
                if parts[right] is None:
                    return True
                over_right, right = right, parts[right][0]

    def alone(self, token: int) -> bool:
        if token not in self.whole:
            self.whole[token] = self.encode_count(self.bytes_of(token)) == 1
        return self.whole[token]

    def bytes_of(self, token: int) -> bytes:
        parts = self.v.parts[token]
        return bytes([token]) if parts is None else self.bytes_of(parts[0]) + self.bytes_of(parts[1])

    def encode_count(self, data: bytes) -> int:
        """Plain BPE, for whole tokens only."""
        own = list(data)
        while len(own) > 1:
            new, at = min(((self.v.pair.get(p, 1 << 60), i) for i, p in enumerate(zip(own, own[1:], strict=False))))
            if new == 1 << 60:
                break
            own[at : at + 2] = [new]
        return len(own)

    def grow(self, state: int, byte: int) -> int:
        """The packed transition (state << 8 | change + 128), made on first use."""
        data, last, less = self.states[state]
        data += bytes([byte])
        n = len(data)
        for size in range(n, 0, -1):
            token = self.v.rank.get(data[n - size :])
            if token is None:
                continue
            before = last[n - size]
            if self.alone(token) if before < 0 else self.meet(before, token):
                break
        else:
            raise AssertionError("some token ends every encoding")
        change = less[n - size] + 1
        last, less = (*last, token), (*(x - change for x in less), 0)
        # only where some token may have begun and go on does the past matter
        open_ = [size for size in range(n, 0, -1) if data[n - size :] in self.v.starts]
        keep = open_[0] if open_ else 0
        old_last, old_less = [-2] * keep + [last[n]], [0] * keep + [0]
        for size in open_:
            old_last[keep - size], old_less[keep - size] = last[n - size], less[n - size]
        new = (data[n - keep :], tuple(old_last), tuple(old_less))
        if new not in self.ids:
            self.ids[new] = len(self.states)
            self.states.append(new)
        packed = self.ids[new] << 8 | change + 128
        self.go[state << 8 | byte] = packed
        return packed

    def piece(self, text: str) -> int:
        """Tokens of one piece; frequent pieces are kept as paths taken at once."""
        if len(self.states) > self.max_states:
            self.reset()
        state = total = 0
        go = self.go
        for byte in text.encode():
            packed = go.get(state << 8 | byte)
            if packed is None:
                packed = self.grow(state, byte)
            state = packed >> 8
            total += (packed & 255) - 128
        if len(text) <= 64:
            if len(self.pieces) > self.max_pieces:
                self.pieces.clear()
            self.pieces[text] = total
        return total

    def through(self, data: bytes, lo: int, hi: int, begin: int | None, end: int | None, first: int = 0) -> list[tuple[int, int, int]]:
        """A chunk's part of one open piece as rows (state at lo, state at hi, tokens ended between).

        begin: where the piece begins, None if before lo; end: where it ends, None if after hi.
        first: the earliest place that may belong to the piece.
        """
        v = self.v
        at: dict[int, dict[int, dict[int, int]]] = {}  # place -> last token -> state at lo -> tokens
        if begin is not None:
            at[begin] = {-1: {OPEN: 0}}
        else:
            for a in range(max(first, lo - v.longest), lo):
                for to, token in v.from_(data, a, len(data) if end is None else end):
                    if to >= lo and self.alone(token):
                        at.setdefault(to, {})[token] = {state(token, to - lo): 0}
        out = []
        for p in range(lo, len(data) + 1):
            nodes = at.pop(p, None)
            if nodes is None:
                continue
            if p == end:
                out += [(tag, OPEN, n) for tags in nodes.values() for tag, n in tags.items()]
                break
            if end is None and p >= hi:
                out += [(tag, state(token, p - hi), n) for token, tags in nodes.items() for tag, n in tags.items()]
                continue
            for to, token in v.from_(data, p, len(data) if end is None else end):
                for last, tags in nodes.items():
                    if self.alone(token) if last < 0 else self.meet(last, token):
                        own = at.setdefault(to, {}).setdefault(token, {})
                        for tag, n in tags.items():
                            own[tag] = n + 1
        return out


#: The state of a border without an open piece.
OPEN = 0


def state(token: int, beyond: int) -> int:
    """The state of a border that a token lies over, with so many of its bytes beyond it."""
    return 1 + (token << 16 | beyond)


class Counter:
    """Texts to token counts: special strings, then pieces, then the transducer."""

    def __init__(self, source: str):
        self.vocabulary = Vocabulary(source)
        self.transducer = Transducer(self.vocabulary)
        self.kind = _classes()

    def starts(self, text: str) -> np.ndarray:
        """Where the pieces of a text begin."""
        cp = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        kind = self.kind[cp]
        n = len(kind)
        white = kind >= BLANK
        start = np.ones(n, bool)
        # a sign that is no white space goes on a run of its kind, or takes in one space before it
        start[1:] = np.where(white[1:], ~white[:-1], (kind[1:] != kind[:-1]) & (kind[:-1] != SPACE))
        # the last white space before something else begins a piece
        start[:-1] |= white[:-1] & ~white[1:]
        for at in np.flatnonzero(start & (cp == 39)):
            for end in CONTRACTED:
                if text.startswith(end, at):
                    start[at + 1] = False
                    if at + len(end) < n and not white[at + len(end)]:
                        start[at + len(end)] = True
                    break
        return np.flatnonzero(start)

    def plain(self, text: str) -> int:
        if not text:
            return 0
        at = self.starts(text).tolist()
        known, piece = self.transducer.pieces, self.transducer.piece
        total = 0
        for a, b in zip(at, [*at[1:], len(text)], strict=True):
            p = text[a:b]
            n = known.get(p)
            total += piece(p) if n is None else n
        return total

    def count(self, text: str) -> int:
        for special in self.vocabulary.special:
            if special in text:
                return sum(map(self.count, text.split(special))) + text.count(special)
        return self.plain(text)

    def pieces(self, text: str, at: int = 0) -> list[tuple[int, bool]]:
        """Where pieces begin, and whether each is a special string; at: the text's place."""
        for special in self.vocabulary.special:
            if special in text:
                out = []
                for part in text.split(special):
                    out += [*self.pieces(part, at), (at + len(part), True)]
                    at += len(part) + len(special)
                return out[:-1]
        return [(at + int(x), False) for x in self.starts(text)] if text else []

    def around(self) -> int:
        """Signs before and after a chunk that its map looks at."""
        return self.vocabulary.longest + 2 * self.sure()

    def sure(self) -> int:
        """Signs from a cut after which the begins of pieces do not depend on what lies before it, or before it on what follows."""
        return 16 + max(map(len, self.vocabulary.special), default=0)

    def mapped(self, text: str, lo: int, hi: int, to_end: bool) -> list[tuple[int, int, int]]:
        """The state map of the chunk from lo to hi of a text of which `around` signs on both sides are given, or all up to its begin and end (to_end)."""
        begins = self.pieces(text)
        reach = self.vocabulary.longest + self.sure()  # a piece that ends so far after a border counts where it begins
        places = np.array([b for b, _ in begins] + ([len(text)] if to_end else []), int)

        def next_from(p: int) -> int | None:
            i = int(np.searchsorted(places, p))
            return int(places[i]) if i < len(places) else None

        def is_open(border: int) -> bool:
            end = next_from(border)
            return end is None or end > border + reach

        left, right = lo > 0 and is_open(lo), is_open(hi) and not (to_end and hi >= len(text))
        own = [(b, special) for b, special in begins if lo <= b < hi]
        total, tail = 0, None
        for i, (b, special) in enumerate(own):
            end = own[i + 1][0] if i + 1 < len(own) else None if right else next_from(b + 1)
            if end is None:
                tail = b
            else:
                total += 1 if special else self.plain_piece(text[b:end])
        if not left and not right:
            return [(OPEN, OPEN, total)]
        data, at = text.encode(), lambda p: len(text[:p].encode())
        head = [(OPEN, OPEN, 0)]
        if left:
            end = own[0][0] if own else None if right else next_from(hi)
            before = [b for b, _ in begins if b < lo and b >= self.sure()]
            head = self.transducer.through(data, at(lo), at(hi), None, None if end is None else at(end), at(before[-1]) if before else 0)
            if not own:
                return head
        tails = self.transducer.through(data, at(lo), at(hi), at(tail), None) if right else [(OPEN, OPEN, 0)]
        return [(a, c, n + total + m) for a, _, n in head for _, c, m in tails]

    def plain_piece(self, piece: str) -> int:
        n = self.transducer.pieces.get(piece)
        return self.transducer.piece(piece) if n is None else n


def compiled(source: str) -> Counter:
    """A counter whose transducer has the states along all tokens of the vocabulary."""
    own = Counter(source)
    t = own.transducer
    for token in own.vocabulary.rank:
        at = 0
        for byte in token:
            packed = t.go.get(at << 8 | byte)
            at = (t.grow(at, byte) if packed is None else packed) >> 8
    return own


def chunks(text: str, chunk: int, around: int) -> Iterator[tuple[int, str, int, int, bool]]:
    """place, text with its surroundings, begin and end of the chunk in it, whether it reaches the text's end."""
    for i, a in enumerate(range(0, len(text), chunk)):
        b, end = min(len(text), a + chunk), min(len(text), a + chunk + around)
        first = max(0, a - around)
        yield i, text[first:end], a - first, b - first, end == len(text)


def compose(maps: list[list[tuple[int, int, int]]]) -> list[tuple[int, int, int]]:
    """The state map of neighbours in order."""
    out = maps[0]
    for rows in maps[1:]:
        by = defaultdict(list)
        for a, b, n in rows:
            by[a].append((b, n))
        out = [(a, c, n + m) for a, b, n in out for c, m in by.get(b, ())]
    return out


_MAP = "array<struct<a:long,b:long,n:long>>"


def count_tokens(docs: DataFrame, vocabulary: str, limit: int = 1024, chunk: int = 1 << 16, fan_in: int = 64) -> DataFrame:
    """Per document: doc_id, n_bytes, n_tokens, over_limit. vocabulary: the file's content, of bounded size."""
    own = compiled(vocabulary)
    around = own.around()
    sent = docs.sparkSession.sparkContext.broadcast(own)

    @F.pandas_udf("long")
    def whole(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        count = sent.value.count
        for batch in texts:
            yield pd.Series([count(t) if t else 0 for t in batch], dtype="int64")

    @F.pandas_udf("array<struct<i:long,text:string,lo:int,hi:int,to_end:boolean>>")
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: list(chunks(t, chunk, around)))

    @F.pandas_udf(_MAP)
    def mapped(parts: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        for batch in parts:
            yield pd.Series([sent.value.mapped(*x) for x in batch[["text", "lo", "hi", "to_end"]].itertuples(index=False)], dtype=object)

    @F.pandas_udf(_MAP)
    def composed(maps: pd.Series) -> pd.Series:
        return maps.map(lambda own: compose([[(r["a"], r["b"], r["n"]) for r in m] for _, m in groupby(own, lambda r: r["i"])]))

    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes"))
    short = rows.filter(F.length("text") <= chunk).select("doc_id", "n_bytes", whole("text").alias("n_tokens"))
    key = ["doc_id", "n_bytes", "h", "c"]
    long_ = rows.filter(F.length("text") > chunk).select("doc_id", "n_bytes", F.xxhash64("text").alias("h"), F.crc32(F.col("text").cast("binary")).alias("c"), F.explode(cut("text")).alias("part"))
    # chunks go to many tasks, those of equal rows once, however many rows are equal
    parts = long_.select(*key, F.col("part.i").alias("i"), "part").groupBy(*key, "i").agg(F.first("part").alias("part"), F.count("*").alias("times"))
    # rows of some hundred bytes; written, so that a lost executor costs one level
    maps = saved(parts.select(*key, "i", "times", mapped("part").alias("m")))
    # a text has 2 GB at most, so the tree's height is known
    most = (1 << 31) // chunk
    while most > 0:
        below = maps
        edges = maps.select(*key, "i", "times", F.explode("m").alias("r")).select(*key, F.expr(f"i div {fan_in}").alias("j"), "times", F.struct("i", "r.a", "r.b", "r.n").alias("r"))
        gathered = edges.groupBy(*key, "j").agg(F.max("times").alias("times"), F.sort_array(F.collect_list("r")).alias("own"))
        maps = saved(gathered.select(*key, F.col("j").alias("i"), "times", composed("own").alias("m")))
        forget(below)
        most //= fan_in
    full = repeated(maps.select("doc_id", "n_bytes", F.col("m")[0]["n"].alias("n_tokens"), "times"), "times").select("doc_id", "n_bytes", "n_tokens")
    return short.unionByName(full).withColumn("over_limit", F.col("n_tokens") > limit)
