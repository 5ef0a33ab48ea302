r"""Personal data by bootstrapped contextual extraction.

Fixed rules find the base spans (the seeds). The words around every seed are lexical patterns, each
with a slot where the seed stood. What stands in such a slot anywhere in the corpus is an instance
of the pattern, of whatever form: a word that holds a digit, an @ or a sign inside, or a run of
numbers (words of letters alone name nobody for sure and are no instances). Spark keeps the graph of patterns and
instances and scores it in turns: a pattern by the share of its distinct instances that are held
for true, an instance by the patterns that point to it. Patterns that end with a high score and
enough distinct seeds mark the unseen strings in their slots as personal data of their seeds' kind.

Pattern counts are over distinct instances, so that copies of a document are no evidence. Words of
patterns are whole; one of more than LONG signs is named by its hash.

Defined results: a null text is empty and has no spans; a discovered span overlaps no base span;
repeated rows each get the same spans; numbers side by side are one instance; an empty table gives
no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import packed, saved

#: Fixed by the contract: the kinds in their order.
KINDS = ("email", "ip", "card", "phone")
_local = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_domain = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+").match
# a run of digits that starts no match starts none further on: only its begin is tried
_ip = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++").finditer
_card = re.compile(r"[0-9](?:[\x20-]?[0-9])+").finditer
_phone = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]").finditer
_digits = re.compile(r"[0-9]")
_plain = re.compile(r"\W").sub
# what makes a word more than letters: a digit, an @, or a sign inside
_mark = re.compile(r"[0-9@]|\w[._:/+()\[\]=#~]+\w").finditer
_space = re.compile(r"\s").search
_letter = re.compile(r"[^\W\d_]").search
LONG = 64
#: Signs that do not belong to the string they stand before or after.
LEADING, TRAILING = "\"'<[{", ".,;:!?>]}\"'"


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches; looks at the signs before each @, so long runs without one cost nothing."""
    at, end = text.find("@"), 0
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _local:
            start -= 1
        m = _domain(text, at + 1) if start < at else None
        if m:
            end = m.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The spans of the fixed rules, by kind and start."""
    out = [("email", a, b) for a, b in emails(text)]
    if not _digits.search(text):
        return out
    for m in _ip(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            out.append(("ip", *m.span()))
    for m in _card(text):
        d = m.group().replace(" ", "").replace("-", "")
        if 13 <= len(d) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    if "+" in text:
        for m in _phone(text):
            if 9 <= sum("0" <= c <= "9" for c in m.group()) <= 15:
                out.append(("phone", *m.span()))
    return out


def named(word: str) -> str:
    """A word itself, a long one by its hash."""
    return word if len(word) <= LONG else "#" + xxhash.xxh3_64_hexdigest(word)


def before(text: str, a: int) -> list[str]:
    """The two words before a place, or as many as there are; part of a word where the place is inside it."""
    out: list[str] = []
    while len(out) < 2:
        while a > 0 and text[a - 1].isspace():
            a -= 1
        if a == 0:
            break
        end = a
        while a > 0 and not text[a - 1].isspace():
            a -= 1
        out.insert(0, text[a:end])
    return out


def after(text: str, b: int) -> list[str]:
    while b < len(text) and text[b].isspace():
        b += 1
    end = _space(text, b)
    word = text[b : end.start() if end else len(text)]
    return [word] if word else []


def context(text: str, a: int, b: int) -> list[str]:
    """The lexical patterns around a string: two words before, and one on each side."""
    mask = lambda w: re.sub("[0-9]", "0", named(w.lower()))
    left, right = list(map(mask, before(text, a))), list(map(mask, after(text, b)))
    out = []
    if len(left) == 2:
        out.append(" ".join(left) + " _")
    if left and right:
        out.append(f"{left[-1]} _ {right[0]}")
    return out


def candidates(text: str, taken: list[tuple[str, int, int]]) -> list[tuple[int, int]]:
    """Where something stands that a slot may hold, clear of the spans taken: a word with a mark; numbers with one space between are one."""
    runs: list[list[int]] = []
    # the spans taken as stretches in order: what is looked at goes along them once
    held: list[list[int]] = []
    for x, y in sorted((x, y) for _, x, y in taken):
        if held and x <= held[-1][1]:
            held[-1][1] = max(held[-1][1], y)
        else:
            held.append([x, y])
    end = at = 0
    for m in _mark(text):
        a = m.start()
        if a < end:
            continue
        while a > end and not text[a - 1].isspace():
            a -= 1
        stop = _space(text, m.end())
        first, end = end, stop.start() if stop else len(text)
        while at < len(held) and held[at][1] <= a:
            at += 1
        clear = at == len(held) or end <= held[at][0]
        beside = clear and runs and runs[-1][1] == first and a == first + 1 and text[first] == " " and text[first - 1] not in TRAILING
        if beside and not _letter(text, *runs[-1]) and not _letter(text, a, end):
            runs[-1][1] = end
        elif clear:
            runs.append([a, end])
    out = []
    for a, b in runs:
        while a < b and text[a] in LEADING:
            a += 1
        while a < b and text[b - 1] in TRAILING:
            b -= 1
        if a < b:
            out.append((a, b))
    return out


_MENTION = "kind string, start int, stop int, seed boolean, instance string, patterns array<string>"


def _scan():
    @F.pandas_udf(f"base array<struct<kind:string,start:int,stop:int>>, mentions array<struct<{_MENTION.replace(' ', ':').replace(',:', ',')}>>")
    def scan(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            rows = []
            for text in batch:
                text = text or ""
                base = base_spans(text)
                both = [(*s, True) for s in base] + [(None, *s, False) for s in candidates(text, base)]
                rows.append((base, [(k, a, b, seed, named(_plain("", text[a:b]).lower()), context(text, a, b)) for k, a, b, seed in both]))
            yield pd.DataFrame(rows, columns=["base", "mentions"])

    return scan


def scanned(docs: DataFrame) -> DataFrame:
    """doc_id, text_id, base, mentions of every document; written once, without texts."""
    return saved(docs.select("doc_id", text_id().alias("text_id"), _scan()("text").alias("s")).select("doc_id", "text_id", "s.*"))


def text_id() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit("")))


def patterns(scan: DataFrame, rounds: int = 3, doubt: float = 2.0) -> DataFrame:
    """kind, pattern, score, seeds after the turns; score is the trusted share of its instances."""
    seen = scan.select(F.explode("mentions").alias("m")).select("m.*").select("kind", "instance", "seed", F.explode("patterns").alias("pattern")).distinct()
    seeds = saved(seen.filter("seed").select("kind", "pattern", "instance"))
    # a pattern without a seed stays at nothing: what stands in its slot is left out
    rooted = saved(seeds.groupBy("kind", "pattern").agg(F.count("*").alias("seeds")))
    unseen = seen.filter("not seed").select("pattern", "instance").join(rooted.select("kind", "pattern"), "pattern").select("kind", "pattern", "instance")
    both = seeds.withColumn("seed", F.lit(True)).unionByName(unseen.withColumn("seed", F.lit(False)))
    edges = both.groupBy("kind", "pattern", "instance").agg(F.max("seed").alias("seed"))
    edges = saved(edges.join(rooted, ["kind", "pattern"]))
    trust = edges.withColumn("trust", F.col("seed").cast("double"))
    for i in range(rounds):
        scored = trust.groupBy("kind", "pattern", "seeds").agg((F.sum("trust") / (F.count("*") + F.lit(doubt))).alias("score"))
        if i == rounds - 1:
            return saved(scored)
        scored = saved(scored)
        given = edges.join(scored.select("kind", "pattern", "score"), ["kind", "pattern"])
        by_instance = given.groupBy("kind", "instance").agg((1 - F.exp(F.sum(F.log1p(-F.least(F.col("score"), F.lit(0.999999)))))).alias("belief"))
        trust = saved(edges.join(by_instance, ["kind", "instance"]).withColumn("trust", F.when(F.col("seed"), 1.0).otherwise(F.col("belief"))).drop("belief"))
    raise ValueError("at least one round")


def discovered(scan: DataFrame, least_score: float = 0.7, least_seeds: int = 5, rounds: int = 3) -> DataFrame:
    """doc_id, text_id, found: the unseen strings that high-confidence patterns surround."""
    good = patterns(scan, rounds).filter((F.col("score") >= least_score) & (F.col("seeds") >= least_seeds)).select("kind", "pattern", "score")
    unseen = scan.select("doc_id", "text_id", F.explode("mentions").alias("m")).filter("not m.seed").select("doc_id", "text_id", "m.start", "m.stop", F.explode("m.patterns").alias("pattern"))
    hits = unseen.join(good, "pattern")
    # of a string's kinds the best; a string is found once
    one = hits.groupBy("doc_id", "text_id", "start", "stop").agg(F.max(F.struct("score", "kind")).alias("best"))
    return one.groupBy("doc_id", "text_id").agg(F.sort_array(F.collect_list(F.struct(F.col("best.kind").alias("kind"), "start", "stop"))).alias("found"))


def listed(spans: list) -> str:
    """Spans as kind:start:end, kinds in their order, then by start."""
    rows = sorted({(KINDS.index(s["kind"]), s["start"], s["stop"]) for s in spans})
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in rows)


def _few(more: DataFrame, most: int = 200_000) -> DataFrame:
    """more, written, and sent to all workers if its strings are few; else it meets the documents in a shuffle."""
    more = saved(more)
    n = more.agg(F.coalesce(F.sum(F.size("found")), F.lit(0))).first()[0]
    return F.broadcast(more) if n <= most else more


def find(docs: DataFrame, **bounds) -> DataFrame:
    """Per document: doc_id, n_<kind> and base_sha256 of the base spans, spans of all. docs: doc_id, text."""
    scan = scanned(docs)
    more = _few(discovered(scan, **bounds))

    @F.pandas_udf("base_sha256 string, spans string")
    def written(base: pd.Series, found: pd.Series) -> pd.DataFrame:
        rows = []
        for own, extra in zip(base, found, strict=True):
            extra = [] if extra is None else list(extra)
            rows.append((hashlib.sha256(listed(list(own)).encode()).hexdigest(), listed([*own, *extra])))
        return pd.DataFrame(rows, columns=["base_sha256", "spans"])

    both = scan.select("doc_id", "text_id", "base").join(more.withColumnsRenamed({"doc_id": "_d", "text_id": "_t"}), F.expr("doc_id <=> _d and text_id = _t"), "left")
    counts = [F.size(F.expr(f"filter(base, s -> s.kind = '{k}')")).cast("long").alias(f"n_{k}") for k in KINDS]
    return both.select("doc_id", *counts, written("base", "found").alias("w")).select("doc_id", *[f"n_{k}" for k in KINDS], "w.*")


def redacted(docs: DataFrame, **bounds) -> DataFrame:
    """docs with every span of text replaced by its kind in angle brackets; n_chars follows if there."""
    scan = scanned(docs)
    more = _few(discovered(scan, **bounds)).withColumnsRenamed({"doc_id": "d", "text_id": "t"})

    @F.pandas_udf("string")
    def masked(texts: pd.Series, found: pd.Series) -> pd.Series:
        out = []
        for text, extra in zip(texts, found, strict=True):
            if not text:
                out.append(text)
                continue
            spans = [(a, b, k) for k, a, b in base_spans(text)] + ([] if extra is None else [(s["start"], s["stop"], s["kind"]) for s in extra])
            parts, end = [], 0
            for a, b, k in sorted(spans):
                if a >= end:
                    parts += [text[end:a], f"<{k.upper()}>"]
                end = max(end, b)
            out.append("".join([*parts, text[end:]]))
        return pd.Series(out, dtype=object)

    rows = docs.select(packed(docs).alias("row"), text_id().alias("own"))
    met = rows.join(more, F.expr("row.doc_id <=> d and own = t"), "left").select("row", masked("row.text", "found").alias("clean"))
    own = lambda c: F.col("row")[c]
    new = {"text": F.col("clean"), "n_chars": F.length("clean").cast("long")}
    return met.select(*[new.get(c, own(c)).alias(c) for c in docs.columns])
