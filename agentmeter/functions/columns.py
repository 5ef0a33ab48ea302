"""Column builders: pure expressions, no actions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .rates import GEO, SYNTHETIC


def whole(c: Column) -> Column:
    """A tolerant integer: null or bad counts as 0."""
    return F.coalesce(c.try_cast("bigint"), F.lit(0).cast("bigint"))


def model_key(model: Column) -> Column:
    """A wire model id reduced to its catalog key; the order of the steps matters."""
    name = F.trim(F.regexp_replace(F.trim(F.coalesce(model, F.lit(""))), r"\[[^\]]*\]\s*$", ""))
    name = F.regexp_replace(name, r"^(?:us|eu|apac)\.anthropic\.", "")
    name = F.regexp_replace(name, r"[@].*$", "")
    name = F.regexp_replace(name, r":.*$", "")
    return F.regexp_replace(F.regexp_replace(name, r"-v\d+$", ""), r"-\d{8}$", "")


def is_synthetic(model: Column) -> Column:
    return model_key(model).isin(*SYNTHETIC)


def write_split(total: Column, hour: Column, five: Column | None = None) -> tuple[Column, Column]:
    """Cache writes of 5 minutes and 1 hour: the flat total is the base, 5 minutes the remainder."""
    total, hour = whole(total), whole(hour)
    base = F.when(total == 0, hour + (whole(five) if five is not None else 0)).otherwise(total)
    one = F.greatest(F.lit(0), F.least(hour, base))
    return base - one, one


def geo_factor(geo: Column) -> Column:
    out = F.lit("1")
    for name, factor in GEO:
        out = F.when(F.lower(geo) == name, F.lit(factor)).otherwise(out)
    return out.cast("decimal(2,1)")


def window_key(origin: Column, agent_id: Column) -> Column:
    """The context window: main, else the agent, else the origin."""
    return F.when(origin == "main", F.lit("main")).otherwise(F.coalesce(agent_id, origin))


def token_estimate(n_bytes: Column) -> Column:
    """A quarter of the bytes, rounded half up, 1 at least."""
    return F.greatest(F.lit(1), F.floor(n_bytes / 4 + 0.5)).cast("bigint")


def mcp_server(name: Column) -> Column:
    return F.when(name.startswith("mcp__"), F.nullif(F.split(name, "__")[1], F.lit("")))


def read_span(offset: Column, limit: Column) -> tuple[Column, Column]:
    """First and last line a read asks for; open without a limit."""
    lo = F.greatest(F.lit(1), F.coalesce(offset, F.lit(1)))
    return lo, F.when(F.coalesce(limit, F.lit(0)) > 0, lo + limit - 1)


def extension(path: Column) -> Column:
    """The ending of a path with its dot, of eight signs at most; empty without one."""
    return F.regexp_extract(F.coalesce(path, F.lit("")), r"(\.[A-Za-z0-9]{1,8})$", 1)


def depth(path: Column) -> Column:
    """How many named parts a path has."""
    return F.size(F.filter(F.split(F.coalesce(path, F.lit("")), "/"), lambda x: x != ""))


def short_token(kind: str, value: Column, salt: str = "") -> Column:
    """A stable name of eight hex digits for a value of a kind."""
    return F.substring(F.sha2(F.concat(F.lit(f"{salt}{kind}:"), value), 256), 1, 8)


def parsed_span(text: Column, lines: int) -> tuple[Column, Column]:
    """First and last line of a span written lo-hi or lo, in order and within a file of so many lines; null if it is neither."""
    part = lambda i: F.nullif(F.regexp_extract(text, r"^\s*([0-9]+)\s*(?:-\s*([0-9]+))?\s*$", i), F.lit("")).try_cast("bigint")
    a, b = part(1), F.coalesce(part(2), part(1))
    clamp = lambda c: F.greatest(F.lit(1), F.least(F.lit(lines), c))
    return F.when(a.isNotNull(), clamp(F.least(a, b))), F.when(a.isNotNull(), clamp(F.greatest(a, b)))


def error_status(value: Column) -> Column:
    """A whole number as it is, all else as `error`: what an error says may be private."""
    return F.coalesce(value.try_cast("int").cast("string"), F.lit("error"))


#: By what a figure may be scaled where it is shown.
SCALES = (1, 2, 3, 4, 5, 10, 100, 1000)


def written_forms(rows: DataFrame, value: str) -> DataFrame:
    """rows with scale, places and written: the value over each scale at 0 to 4 places, as it would be printed, halves to even.

    Of six places at most, so that eleven places of the quotient tell every half.
    """
    scaled = rows.withColumn("scale", F.explode(F.array(*[F.lit(s) for s in SCALES])))
    quotient = (F.col(value).cast("decimal(18,6)") / F.col("scale").cast("decimal(4,0)")).cast("decimal(28,11)")
    forms = F.array(*[F.struct(F.lit(p).alias("places"), F.bround(quotient, p).cast(f"decimal(22,{p})").cast("string").alias("written")) for p in range(5)])
    return scaled.withColumn("f", F.explode(forms)).select("*", "f.*").drop("f")


def significant(written: Column) -> Column:
    """The significant digits of a number as it is written, commas aside.

    Zeros in front never count; behind, they count after a point, while those that end a whole number do not, unless it is all zeros.
    """
    plain = F.replace(written, F.lit(","), F.lit(""))
    front = F.regexp_replace(F.substring_index(plain, ".", 1), "^0+", "")
    part = F.regexp_extract(plain, r"\.(.*)$", 1)
    inner = F.regexp_replace(plain, "^0+|0+$", "")
    with_point = F.when(F.length(front) > 0, F.length(front) + F.length(part)).otherwise(F.length(F.regexp_replace(part, "^0+", "")))
    return F.when(F.contains(plain, F.lit(".")), with_point).when(F.length(inner) > 0, F.length(inner)).otherwise(F.length(plain))


def prompt_terms(prompts: DataFrame, key: list[str], stop: tuple[str, ...], most: int = 12, signs: int = 4000) -> DataFrame:
    """key, term, n, rank: the words that a prompt says most often, ties by where they come first. prompts: key, text."""
    words = F.regexp_extract_all(F.lower(F.substring("text", 1, signs)), F.lit("([a-z][a-z0-9_]+)"), 1)
    t = prompts.select(*key, F.posexplode(words).alias("i", "term")).filter((F.length("term") > 2) & ~F.col("term").isin(*stop))
    g = t.groupBy(*key, "term").agg(F.count("*").alias("n"), F.min("i").alias("first"))
    w = Window.partitionBy(*key).orderBy(F.desc("n"), "first")
    return g.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= most).drop("first")


#: Programs whose name says nothing private.
PROGRAMS = (
    "git", "python3", "node", "npm", "pnpm", "ls", "cat", "grep", "find", "curl",
    "docker", "make", "sed", "awk", "jq", "dotnet", "java", "go", "cargo", "rg",
)


def first_program(command: Column) -> Column:
    """The program that a command runs first, if it is a listed one; else what follows the first separator; else `other`."""
    parts = F.filter(F.split(F.coalesce(command, F.lit("")), r"&&|\|\||;|\|"), lambda x: F.trim(x) != "")
    names = F.transform(F.slice(parts, 1, 2), lambda x: F.substring_index(F.regexp_extract(x, r"^\s*(\S+)", 1), "/", -1))
    return F.coalesce(F.try_element_at(F.filter(names, lambda x: x.isin(*PROGRAMS)), F.lit(1)), F.lit("other"))


def normal_path(path: Column) -> Column:
    """A path with single slashes, without . parts, and with .. parts resolved."""
    parts = F.filter(F.split(path, "/"), lambda x: (x != "") & (x != "."))
    up = lambda s, x: F.when((x == "..") & (F.size(s) > 0) & (F.element_at(s, -1) != ".."), F.slice(s, 1, F.size(s) - 1)).otherwise(F.array_append(s, x))
    own = F.aggregate(parts, F.expr("cast(array() as array<string>)"), lambda s, x: F.when((x == "..") & (F.size(s) == 0) & path.startswith("/"), s).otherwise(up(s, x)))
    return F.concat(F.when(path.startswith("/"), "/").otherwise(""), F.array_join(own, "/"))


def named_paths(text: Column) -> Column:
    """The path-shaped words of a text, normalised, once each: with a slash and an ending, or an ending of a source file."""
    found = F.regexp_extract_all(text, F.lit(r"((?:[A-Za-z0-9_.-]+/)+[A-Za-z0-9_.-]+\.[A-Za-z0-9]{1,8}|\b[A-Za-z0-9_-]+\.(?:py|ts|js|cs|sql|md|css|html))"), 1)
    return F.array_distinct(F.transform(found, normal_path))


def chunk_terms(text: Column, most: int = 320) -> Column:
    """The distinct identifiers of a text in the order they first come, lower-cased."""
    return F.slice(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"([a-z_][a-z0-9_]{1,63})"), 1)), 1, most)


def best_line(text: Column, terms: Column) -> Column:
    """The line of a text that holds most of the terms, the first of equals, white space squeezed."""
    scored = F.transform(F.split(text, "\n"), lambda line, i: F.struct(F.size(F.filter(terms, lambda t: F.contains(F.lower(line), t))).alias("n"), (-i).alias("i"), F.trim(F.regexp_replace(line, r"\s+", " ")).alias("line")))
    return F.array_max(scored)["line"]
