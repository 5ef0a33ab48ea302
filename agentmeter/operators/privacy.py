"""Audit and scrub of texts before they are published."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rates
from .search import sent

#: Shapes that must not be published. Words take letters and digits of any script, as upstream.
EMAIL = r"[\p{L}\p{N}_.+-]+@[\p{L}\p{N}_-]+\.[\p{L}\p{N}_.]{2,}"
HOME = r"/(?:home|Users)/[\p{L}\p{N}_]+"
UUID = r"(?i)\b[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\b"
BRANCH = r"(?i)\b(?:feature|fix|chore|main|hotfix|release|bugfix)/[\p{L}\p{N}_.-]+"
IPV4 = r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9.])"
TICKET = r"(?i)\b[A-Z][A-Z0-9]{1,9}-[0-9]{1,6}\b"
#: Kind, severity, pattern.
RULES = (("email", "block", EMAIL), ("home", "block", HOME), ("uuid", "block", UUID), ("branch", "block", BRANCH), ("ipv4", "block", IPV4), ("ticket", "review", TICKET))
#: Shapes of tickets that are none: what follows a model's family, a charset, labels given to later logins.
MODEL_BEFORE, SAFE_TICKETS, LABEL = r"(?<!claude-)(?<!anthropic\.)", ("utf-8",), "secondary-[0-9]{1,6}"
#: What a scrub replaces, in order. A branch of main alone names nobody and stays.
SCRUB = (
    (r"/(home|Users)/[A-Za-z0-9._-]+", "/$1/<user>"), (EMAIL, "<email>"), (UUID, "<uuid>"),
    (r"(?i)\b(?:feature|fix|chore|hotfix|release|bugfix)/[\p{L}\p{N}_.:/-]+", "<branch>"), (IPV4, "<ip>"),
)


def safe_tickets() -> list[str]:
    """What is shaped like a ticket and is none: the charset, and parts of the catalog's names."""
    return sorted({m.lower() for name, *_ in rates.MODELS for m in re.findall(TICKET, name)} | set(SAFE_TICKETS))


def ticket_pattern() -> str:
    """The pattern of a ticket that is neither a model's name nor another safe shape."""
    return rf"(?i)\b{MODEL_BEFORE}(?!(?:{'|'.join(safe_tickets())}|{LABEL})\b){TICKET.removeprefix('(?i)')}"


#: Signs from which a name is told wherever a word begins with it; the least signs of a name; what stands
#: before a shorter one where it can only be a login.
LONG_NEEDLE, LEAST_NEEDLE = 5, 2
LOGIN_BEFORE = r"(?i)(?:home/|users/|\\home\\|\\users\\|home-|users-|~)$"
_WORD = r"[\p{L}\p{N}_]"


#: First signs of names up to which places are looked for by them; of more, every place where a word can begin is one.
FEW_HEADS = 1000


def beginnings(heads: list[str], of: Callable[[str], str] = re.escape) -> str:
    """A pattern of what begins with any of the heads, which shares their first signs; of: the pattern of a sign."""
    if not heads:
        return "(?!)"
    after: dict[str, list[str]] = {}
    for h in sorted(set(heads)):
        if not h:
            return ""
        after.setdefault(h[0], []).append(h[1:])
    each = [of(c) + beginnings(rest, of) for c, rest in after.items()]
    return each[0] if len(each) == 1 else f"(?:{'|'.join(each)})"


def any_case(sign: str) -> str:
    """A pattern of all that is the lower-case ASCII sign once it is lower-cased; the sign of Kelvin is such a one."""
    return f"[{sign}{sign.upper()}{chr(0x212A) if sign == 'k' else ''}]" if sign.isalpha() else re.escape(sign)


def joined(parts: Column, a: Column, b: Column) -> Column:
    """Parts a (from 0) up to b as one text."""
    return F.array_join(F.slice(parts, a + 1, F.greatest(F.lit(0), b - a)), "")


def ahead(parts: Column, i: Column, n: Column) -> Column:
    """What stands from part i on, n signs of it at least where there are as many; a part has a sign."""
    own = F.get(parts, i)
    return F.when(F.length(own) >= n, own).otherwise(joined(parts, i, i + n))


def placed(texts: DataFrame, found: str, of: Callable[[Column], list[Column]]) -> DataFrame:
    """id, i, at and the columns of each of the column found (structs by rising i): what stands at part i of s, and its place in the text.

    Places are added up along what was found alone. Here and where texts are taken apart, explode_outer: before an explode Spark
    asks whether the array is empty, and so makes it twice.
    """
    gap = lambda x, k: F.length(joined(F.col("s"), F.coalesce(F.get(found, k - 1)["i"], F.lit(0)), x["i"]))
    each = texts.select("id", F.explode_outer(F.transform(found, lambda x, k: F.struct(x["i"].alias("i"), gap(x, k).alias("gap"), *of(x)))).alias("h")).select("id", "h.*").filter("i is not null")
    at = F.sum("gap").over(Window.partitionBy("id").orderBy("i"))
    return each.withColumn("at", at.cast("bigint")).drop("gap")


def needle_places(texts: DataFrame, needles: DataFrame) -> tuple[DataFrame, str]:
    """`needle_hits` with i, the part of its text that a hit begins; and the pattern that texts are cut by."""
    n = needles.select("kind", F.lower("needle").alias("needle")).filter(F.length("needle") >= LEAST_NEEDLE).distinct()
    n = n.withColumn("long", F.length("needle") >= LONG_NEEDLE).withColumn("key", F.substring("needle", 1, LONG_NEEDLE))
    heads = [r.key for r in n.filter("long").select("key").distinct().limit(FEW_HEADS + 1).collect()]
    # what is no ASCII changes with its case in ways that a pattern does not tell
    told = beginnings(heads, any_case) if len(heads) <= FEW_HEADS and all(h.isascii() for h in heads) else ""
    # the letters that most words have come first in the class
    letter = r"[A-Za-z0-9_\p{L}\p{N}]"
    word = rf"{letter}{{{LEAST_NEEDLE},{LONG_NEEDLE - 1}}}(?!{letter})"
    login = f"(?<={LOGIN_BEFORE.removesuffix('$')})".replace("(?i)", "(?i:", 1) + ")"
    cut = rf"(?<!{letter})(?![\x{{DC00}}-\x{{DFFF}}])" + (rf"(?=(?:{told})|{word}@|{login}{word})" if told else "")
    # the signs ahead of each place: the first of a long name, or a word that may be a short one
    signs = F.regexp_extract_all("text", F.lit(rf"(?:{cut}|^)(?=([\s\S]{{0,{LONG_NEEDLE}}}))"), 1)
    short = F.regexp_extract("signs", f"^({word})", 1)
    keys = F.array(F.struct(F.lit(True).alias("long"), F.lower("signs").alias("key")), F.struct(F.lit(False).alias("long"), F.lower(short).alias("key")))
    met = texts.select("id", F.posexplode_outer(signs).alias("i", "signs")).select("id", "i", F.explode(keys).alias("k")).select("id", "i", "k.*")
    found = met.filter("key <> ''").join(sent(n), ["long", "key"]).groupBy("id").agg(F.array_sort(F.collect_set(F.struct("i", "kind", "needle"))).alias("found"))
    own = texts.join(found, "id").select("id", F.split("text", cut + "(?!^)").alias("s"), "found")

    def stands(x: Column) -> Column:
        n, behind = F.length(x["needle"]), joined(F.col("s"), F.greatest(F.lit(0), x["i"] - 8), x["i"])
        is_login = behind.rlike(LOGIN_BEFORE) | (F.substring(ahead(F.col("s"), x["i"], n + 1), n + 1, F.lit(1)) == "@")
        return (F.lower(sample(x)) == x["needle"]) & ((n >= LONG_NEEDLE) | is_login)

    sample = lambda x: F.substring(ahead(F.col("s"), x["i"], F.length(x["needle"])), F.lit(1), F.length(x["needle"]))
    own = own.withColumn("found", F.filter("found", stands))
    return placed(own, "found", lambda x: [x["kind"].alias("kind"), x["needle"].alias("needle"), sample(x).alias("sample")]), cut


def needle_hits(texts: DataFrame, needles: DataFrame) -> DataFrame:
    """id, kind, needle, at (from 0), sample: every place where a name stands as a name. texts: id, text, an id once; needles: kind, needle.

    A name of LONG_NEEDLE signs or more is told where no letter, digit or _ stands before it, whatever follows; a
    shorter one only behind a home folder or ~, where its word ends with it, or as a whole word before an @. Case does not
    count. Places where words can begin, by the names' first signs where these are few, meet the names in an
    equi-join, so that the work grows with the texts and not with texts times names; texts travel once, to what was met in them.
    """
    return needle_places(texts, needles)[0].select("id", "kind", "needle", "at", "sample")


def findings(texts: DataFrame, needles: DataFrame | None = None) -> DataFrame:
    """id, kind, severity, sample, n, first: what is found, how often, and where first (from 0). texts: id, text.

    needles: kind, needle: names that must not be published, as many as there are (`needle_hits`).
    """
    found = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(s).alias("severity"), F.regexp_extract_all("text", F.lit(f"({ticket_pattern() if k == 'ticket' else p})"), 1).alias("hits")) for k, s, p in RULES])
    f = texts.select("id", "text", F.explode(found).alias("f")).select("id", "text", "f.kind", "f.severity", F.explode("f.hits").alias("sample"))
    f = f.groupBy("id", "kind", "severity", "sample").agg(F.count("*").alias("n"), F.min(F.expr("instr(text, sample) - 1")).cast("bigint").alias("first"))
    if needles is not None:
        own = needle_hits(texts, needles).groupBy("id", "kind", F.lit("block").alias("severity"), "sample")
        f = f.unionByName(own.agg(F.count("*").alias("n"), F.min("at").cast("bigint").alias("first")))
    return f


def scrubbed(texts: DataFrame) -> DataFrame:
    """texts with every rule's hits replaced, in the rules' order; doing it twice changes nothing."""
    out = F.col("text")
    for pattern, by in SCRUB:
        out = F.regexp_replace(out, pattern, by)
    return texts.withColumn("text", out)


def publish(tables: dict[str, DataFrame], path: str, needles: DataFrame | None = None) -> None:
    """Writes all tables, or none if a blocking finding is in any string column.

    Everything is audited, then written to a folder beside. The published one is moved aside before that takes
    its place, and goes last: where a step fails it is moved back, so that one of both is published.
    """
    spark = next(iter(tables.values())).sparkSession
    for name, df in tables.items():
        text = F.concat_ws("\n", *[c for c, t in df.dtypes if t == "string"])
        if not findings(df.select(F.lit(name).alias("id"), text.alias("text")), needles).filter("severity = 'block'").isEmpty():
            raise ValueError(f"{name} holds personal data: nothing is published")
    jvm = spark.sparkContext._jvm.org.apache.hadoop.fs
    beside, at = jvm.Path(f"{path}.new"), jvm.Path(path)
    files = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}.new/{name}")
    old = jvm.Path(f"{path}.old")
    files.delete(old, True)
    had = files.exists(at)
    if had and not files.rename(at, old):
        raise OSError(f"{path} could not be moved aside")
    if not files.rename(beside, at):
        if had:
            files.rename(old, at)
        raise OSError(f"{path} was not replaced")
    files.delete(old, True)


def allowed(rows: DataFrame, columns: list[str]) -> DataFrame:
    """The publishable columns of rows, in the list's order; a column that rows lack is null, one not listed never leaves."""
    return rows.select(*[F.col(c) if c in rows.columns else F.lit(None).cast("string").alias(c) for c in columns])


def merged(old: DataFrame, new: DataFrame) -> DataFrame:
    """Two pseudonym maps (key, ordinal) as one: a key of the old map keeps its ordinal, others follow in the new map's order."""
    top = old.agg(F.coalesce(F.max("ordinal"), F.lit(0))).first()[0]
    more = new.join(old.select("key"), "key", "left_anti")
    # a row a pseudonym: session and project names, as many as a report has
    i = F.row_number().over(Window.orderBy("ordinal", "key"))
    return old.select("key", F.col("ordinal").cast("bigint").alias("ordinal")).unionByName(more.withColumn("i", i).select("key", (F.col("i") + top).cast("bigint").alias("ordinal")))
