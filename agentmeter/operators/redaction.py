"""Redaction through maps: a pseudonym once given out stays, texts name it in place of the key, marts carry nothing else.

A map is a table (kind, key, ordinal, pseudonym). `PseudonymMap` keeps it in generations; `scrub` looks names up and
never gives one out; `report_names` numbers what one report names, in order of first sight; `redacted` projects marts to
their listed columns and names.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import columns as X
from . import privacy
from .search import sent
from .searchindex import scratch

MAP = "kind string, key string, ordinal bigint, pseudonym string"
#: What a kept pseudonym looks like; such a value is named already.
PSEUDONYM = r"^(session|project)_[0-9]+$"
#: The least signs of a project's name that is looked for in texts, and parts of paths that name nobody.
LEAST_PROJECT = 6
GENERIC_SEGMENTS = (
    "home", "users", "user", "tmp", "var", "opt", "src", "srv", "mnt", "documents", "desktop", "downloads", "projects", "project", "repos",
    "code", "workspace", "work", "dev", "git", "github", "source", "library", "application support", ".claude", "claude",
)
#: Where a name may begin: behind no ASCII letter or digit; never within a sign of two code units.
_CUT = r"(?<![A-Za-z0-9])(?![\x{DC00}-\x{DFFF}])"
#: The pattern of addresses, written so that a run of signs without an @ is gone through once; what it finds is the same.
_EMAIL = r"(?:(?<![\p{L}\p{N}_.+-])|\G)[\p{L}\p{N}_.+-]++@[\p{L}\p{N}_-]+\.[\p{L}\p{N}_.]{2,}"


def scratch_table(df: DataFrame, name: str) -> DataFrame:
    """df as a table written to the shared folder and read again: what is derived from it twice is the same both times."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows with i: their place from 1 in the order, which has to be total.

    Ranges of the order are sorted apart and set off by how many rows stand before them, so that no task holds more than a
    range, however many rows are equal in the first columns.
    """
    put = rows.repartitionByRange(*order).withColumn("_p", F.spark_partition_id())
    put = scratch_table(put, "ranges")
    # a row a range: as many as there are shuffle partitions
    sizes = put.groupBy("_p").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    own = F.row_number().over(Window.partitionBy("_p").orderBy(*order))
    offsets = F.broadcast(sizes.select("_p", before.alias("_before")))
    return put.withColumn("_i", own).join(offsets, "_p").withColumn("i", (F.col("_i") + F.col("_before")).cast("bigint")).drop("_p", "_i", "_before")


def padded(prefix: Column, ordinal: Column, width: int = 2) -> Column:
    """prefix_NN: an ordinal of more digits than the width keeps them all."""
    return F.concat(prefix, F.format_string(f"_%0{width}d", ordinal))


def allocated(known: DataFrame, keys: DataFrame) -> DataFrame:
    """The map with a name for every key: those of known stay, others follow its highest ordinal by (seen, key).

    keys: kind, key, seen. An empty key and one that is a pseudonym already get none.
    """
    fresh = keys.select("kind", F.trim("key").alias("key"), "seen").filter((F.col("key") != "") & ~F.col("key").rlike(PSEUDONYM))
    fresh = fresh.groupBy("kind", "key").agg(F.min("seen").alias("seen")).join(known.select("kind", "key"), ["kind", "key"], "left_anti")
    placed = scratch_table(numbered(fresh, ["kind", "seen", "key"]), "numbers")
    first = placed.groupBy("kind").agg(F.min("i").alias("_first"))
    top = known.groupBy("kind").agg(F.max("ordinal").alias("_top"))
    # a row a kind: two
    shift = F.broadcast(first.join(top, "kind", "left").select("kind", (F.coalesce("_top", F.lit(0)) - F.col("_first") + 1).alias("_shift")))
    new = placed.join(shift, "kind").withColumn("ordinal", (F.col("i") + F.col("_shift")).cast("bigint"))
    new = new.select("kind", "key", "ordinal", padded(F.col("kind"), F.col("ordinal")).alias("pseudonym"))
    return known.select("kind", "key", "ordinal", "pseudonym").unionByName(new)


class PseudonymMap:
    """A map kept in generations under a folder that all machines share; the newest whole one counts.

    `allocate` writes a new generation beside the others and marks it whole at the end, so a run that fails leaves the last
    one in force, and one that has nothing new writes nothing. One writer at a time: a second one finds its generation taken
    and fails.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        self._fs, self._Path = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), spark.sparkContext._jvm.org.apache.hadoop.fs.Path

    def generation(self) -> int:
        """The newest whole generation; 0 for none."""
        at = self._Path(self.path)
        if not self._fs.exists(at):
            return 0
        names = [f.getPath().getName() for f in self._fs.listStatus(at)]
        whole = [int(n[4:]) for n in names if n.startswith("gen=") and self._fs.exists(self._Path(f"{self.path}/{n}/_SUCCESS"))]
        return max(whole, default=0)

    def read(self) -> DataFrame:
        g = self.generation()
        return self.spark.read.schema(MAP).parquet(f"{self.path}/gen={g}") if g else self.spark.createDataFrame([], MAP)

    def allocate(self, keys: DataFrame) -> DataFrame:
        """The map after all keys have a name. keys: kind, key, seen."""
        known, g = self.read(), self.generation()
        wanted = keys.select("kind", F.trim("key").alias("key")).filter((F.col("key") != "") & ~F.col("key").rlike(PSEUDONYM))
        if wanted.join(known, ["kind", "key"], "left_anti").isEmpty():
            return known
        allocated(known, keys).write.mode("errorifexists").parquet(f"{self.path}/gen={g + 1}")
        return self.read()


def named(kind: str, key: Column, pseudonym: Column) -> Column:
    """The name of a key that was looked up; a pseudonym stays itself, an empty key is number 00, an unknown one a short hash."""
    text = F.trim(F.coalesce(key.cast("string"), F.lit("")))
    return (
        F.when(text == "", F.lit(f"{kind}_00")).when(text.rlike(PSEUDONYM), text)
        .otherwise(F.coalesce(pseudonym, F.concat(F.lit(f"<{kind}-"), X.short_token(kind, text), F.lit(">"))))
    )


def who_is(names: DataFrame, asked: DataFrame) -> DataFrame:
    """asked, kind, key, pseudonym: whom a pseudonym stands for, whatever its case, and what a session is called.

    asked: asked (string). A session is told by its whole key, else by the start of one key alone; what fits several, or none, has no row.
    """
    a = asked.select("asked", F.lower(F.trim("asked")).alias("name"), F.trim("asked").alias("text")).filter("text <> ''").distinct()
    out = ["asked", "kind", "key", "pseudonym"]
    by_name = a.join(names.withColumn("name", F.lower("pseudonym")), "name").select(*out)
    s = names.filter("kind = 'session'")
    starts = s.withColumn("text", F.explode(F.transform(F.sequence(F.lit(1), F.length("key")), lambda n: F.substring(F.col("key"), F.lit(1), n))))
    met = a.join(starts, "text").withColumn("whole", F.col("text") == F.col("key"))
    g = met.groupBy("asked").agg(F.count("*").alias("n"), F.max("whole").alias("whole"), F.max_by(F.struct("kind", "key", "pseudonym"), "whole").alias("best"))
    return by_name.unionByName(g.filter("whole or n = 1").select("asked", "best.*")).distinct()


# --- texts


def project_needles(names: DataFrame, displays: DataFrame | None = None) -> DataFrame:
    """needle, token: what stands for a project in texts: its key, the folder it was, and that folder's last part.

    displays: key, display. Short needles, parts that name nobody, and pseudonyms are none.
    """
    p = names.filter("kind = 'project'").select("key", "pseudonym")
    p = p.join(displays, "key", "left") if displays is not None else p.withColumn("display", F.lit(None).cast("string"))
    last = F.substring_index(F.regexp_replace("display", "^/+|/+$", ""), "/", -1)
    one = p.select(F.explode(F.array("key", "display", F.when(~F.lower(last).isin(*GENERIC_SEGMENTS), last))).alias("needle"), F.col("pseudonym").alias("token"))
    own = one.filter((F.length("needle") >= LEAST_PROJECT) & ~F.regexp_replace("needle", "^[/-]+", "").rlike(PSEUDONYM))
    return own.groupBy("needle").agg(F.min("token").alias("token"))  # of projects with one needle the first


def cut_before(needles: DataFrame) -> str:
    """The pattern of the places where a needle may begin: by the needles' first signs where these are few, else all of `_CUT`."""
    heads = needles.select(F.substring("needle", 1, LEAST_PROJECT).alias("head")).distinct().limit(privacy.FEW_HEADS + 1).collect()
    return _CUT if len(heads) > privacy.FEW_HEADS else f"(?={privacy.beginnings([r.head for r in heads])}){_CUT}"


def project_hits(texts: DataFrame, needles: DataFrame, cut: str = _CUT) -> DataFrame:
    """id, i, at (from 0), n, token: where needles stand with no ASCII letter or digit beside them; case counts. texts: id, text, an id once.

    Texts are cut before the places of cut; i is the part that a needle begins. What begins there meets the needles' first
    signs in an equi-join; texts travel once, to what was met in them.
    """
    n = needles.withColumn("head", F.substring("needle", 1, LEAST_PROJECT))
    heads = F.regexp_extract_all("text", F.lit(rf"(?:{cut}|^)(?=([\s\S]{{0,{LEAST_PROJECT}}}))"), 1)
    at = texts.select("id", F.posexplode_outer(heads).alias("i", "head"))
    found = at.join(sent(n), "head").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("i", "needle", "token"))).alias("found"))
    both = texts.join(found, "id").select("id", F.split("text", _parts(cut)).alias("s"), "found")

    def fits(x: Column) -> Column:
        n = F.length(x["needle"])
        rest = privacy.ahead(F.col("s"), x["i"], n + 1)
        return F.startswith(rest, x["needle"]) & ~F.substring(rest, n + 1, F.lit(1)).rlike("[A-Za-z0-9]")

    hits = both.withColumn("found", F.filter("found", fits))
    return privacy.placed(hits, "found", lambda x: [F.length(x["needle"]).alias("n"), x["token"].alias("token")])


def _parts(cut: str) -> str:
    return cut + "(?!^)"


def apart(hits: DataFrame) -> DataFrame:
    """Of hits that overlap in a text, the longest, then of what is left that does not touch it, and so on; the first of equals.

    Hits that overlap, by themselves or through others, are settled together; such a group is a stretch of one text.
    """
    w = Window.partitionBy("id").orderBy("at", F.desc("n"))
    reach = F.max(F.col("at") + F.col("n")).over(w.rowsBetween(Window.unboundedPreceding, -1))
    islands = hits.withColumn("_new", (F.coalesce(reach, F.lit(0)) <= F.col("at")).cast("int")).withColumn("_g", F.sum("_new").over(w))
    best_first = F.expr("array_sort(collect_list(struct(-n as m, at, n, token, i)))")
    groups = islands.groupBy("id", "_g").agg(best_first.alias("h"))
    free = lambda kept, x: ~F.exists(kept, lambda y: (x["at"] < y["at"] + y["n"]) & (y["at"] < x["at"] + x["n"]))
    kept = F.aggregate("h", F.slice("h", 1, 0), lambda acc, x: F.when(free(acc, x), F.array_append(acc, x)).otherwise(acc))
    return groups.select("id", F.explode(kept).alias("h")).select("id", "h.i", "h.at", "h.n", "h.token")


def put_in(texts: DataFrame, hits: DataFrame, cut: str = _CUT) -> DataFrame:
    """texts (id, text; an id once) with hits (id, i, n, token), none of which overlap, in place of what stands there.

    i is the part that a hit begins, of the text cut before the places of cut. A null text stays null.
    """
    own = hits.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("i", "n", "token"))).alias("own"))
    both = texts.join(own, "id", "left").select("id", "text", F.split("text", _parts(cut)).alias("s"), "own")

    def piece(x: Column, k: Column) -> Column:
        upto = F.coalesce(F.get("own", k + 1)["i"], F.size("s"))
        return F.concat(x["token"], F.substring(privacy.joined(F.col("s"), x["i"], upto), x["n"] + 1, F.lit(2**31 - 1)))

    new = F.concat(privacy.joined(F.col("s"), F.lit(0), F.get("own", F.lit(0))["i"]), F.array_join(F.transform("own", piece), ""))
    return both.select("id", F.coalesce(new, "text").alias("text"))


def looked_up(texts: DataFrame, names: DataFrame, tokens: dict[str, tuple[str, Callable[[Column, Column], Column]]]) -> DataFrame:
    """texts with what patterns find replaced by token(found, name), pattern after pattern. tokens: kind: (pattern, token); names: kind, key, name.

    What a pattern finds is looked for where those before it found nothing; none of their tokens is shaped as a later one's finds.
    Each text's distinct finds meet the names once, addresses whatever their case; a text keeps the map of those that have one.
    """
    of_kind = lambda kind: lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("found"))
    put_by = lambda token: lambda x: token(x, F.try_element_at("_names", x))
    rest, finds = F.col("text"), []
    for kind, (pattern, _) in tokens.items():
        finds.append(F.transform(F.array_distinct(F.regexp_extract_all(rest, F.lit(f"({pattern})"), 1)), of_kind(kind)))
        rest = F.regexp_replace(rest, pattern, " ")
    found = texts.select("id", F.explode_outer(F.concat(*finds)).alias("f")).select("id", "f.*")
    found = found.withColumn("key", F.when(F.col("kind") == "email", F.lower("found")).otherwise(F.col("found")))
    known = names.groupBy("kind", "key").agg(F.min("name").alias("name"))
    own = found.join(sent(known), ["kind", "key"]).groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("found", "name"))).alias("_names"))
    t = texts.join(own, "id", "left")
    for pattern, token in tokens.values():
        t = t.withColumn("_put", F.transform(F.regexp_extract_all("text", F.lit(f"({pattern})"), 1), put_by(token)))
        # gaps and tokens in turn; the last gap stands alone
        new = F.array_join(F.zip_with(F.split("text", pattern), "_put", lambda gap, t: F.concat(gap, F.coalesce(t, F.lit("")))), "")
        t = t.withColumn("text", F.when(F.size("_put") > 0, new).otherwise(F.col("text")))
    return t.select("id", "text")


def scrub(
    texts: DataFrame, names: DataFrame, displays: DataFrame | None = None, labels: DataFrame | None = None, users: DataFrame | None = None,
    home: str | None = None, hosts: tuple[str, ...] = (),
) -> DataFrame:
    """texts (id, text; an id once) with what names people and work replaced, in a fixed order of rules.

    Projects by their pseudonyms, longest first; the own home folder and those of others; names of users; hosts; addresses by
    a login's label or a short hash; UUIDs by a session's pseudonym or a short hash; branches; tickets; IP addresses.
    names: a pseudonym map; displays: key, display; labels: address, label; users: needle. Nothing is given a name here, and
    doing it twice changes nothing. A null text stays null, an empty one empty. Texts are dealt by id once and stay there.
    """
    # the parts of this one exchange are read again by all that joins on id
    t = texts.select("id", "text").repartition("id")
    needles = scratch_table(project_needles(names, displays), "needles")
    cut = cut_before(needles)
    t = put_in(t, apart(project_hits(t, needles, cut)), cut)
    out = F.col("text")
    if home and len(home.rstrip("/")) > 3:
        out = F.regexp_replace(out, _quoted(home.rstrip("/")) + r"(?=/|\b)", "~")
    t = t.select("id", F.regexp_replace(out, r"/(home|Users)/[A-Za-z0-9._-]+", "/$1/<user>").alias("text"))
    if users is not None:
        # what is taken apart and read again is written once between
        t = scratch_table(t, "scrub").repartition("id")
        hits, cut = privacy.needle_places(t, users.select(F.lit("user").alias("kind"), "needle"))
        spans = hits.select("id", "i", "at", F.length("sample").alias("n"), F.lit("<user>").alias("token"))
        t = put_in(t, apart(spans), cut)
    out = F.col("text")
    for host in sorted({h for full in hosts for h in (full, full.split(".")[0]) if len(h) >= 4}, key=len, reverse=True):
        out = F.regexp_replace(out, "(?i)" + _quoted(host), "<host>")
    t = t.select("id", out.alias("text"))
    hashed = lambda kind: lambda found, name: F.coalesce(name, F.concat(F.lit(f"<{kind}-"), X.short_token(kind, found), F.lit(">")))
    ids = {"id": (privacy.UUID, hashed("id"))}
    known = names.filter("kind = 'session'").select(F.lit("id").alias("kind"), "key", F.col("pseudonym").alias("name"))
    if labels is not None:
        told = labels.groupBy(F.lower("address").alias("id")).agg(F.min(F.concat(F.lit("<account:"), "label", F.lit(">"))).alias("text"))
        # a label that holds a UUID gives way as any text does
        told = looked_up(told, known, ids)
        known = scratch_table(known.unionByName(told.select(F.lit("email").alias("kind"), F.col("id").alias("key"), F.col("text").alias("name"))), "known")
    t = looked_up(t, known, {"email": (_EMAIL, hashed("email"))} | ids)
    out = F.regexp_replace("text", r"(?i)\b(?:feature|fix|chore|hotfix|release|bugfix)/[\p{L}\p{N}_.:/-]+", "<branch>")
    # the shape comes first, as few words have it
    out = F.regexp_replace(out, r"(?i)\b(?=[A-Z][A-Z0-9]{1,9}-[0-9])" + privacy.ticket_pattern().removeprefix(r"(?i)\b"), "<ticket>")  # the eight digits of a short hash are more than a ticket has
    return t.select("id", F.regexp_replace(out, "(?=[0-9])" + privacy.IPV4, "<ip>").alias("text"))


def _quoted(text: str) -> str:
    return r"\Q" + text.replace(r"\E", r"\E\\E\Q") + r"\E"


# --- marts


FILE_TOOLS, SEARCH_TOOLS, WEB_TOOLS = ("Read", "Write", "Edit", "NotebookEdit", "MultiEdit"), ("Grep", "Glob"), ("WebFetch", "WebSearch")


def target_kind(tool: Column, target: Column) -> Column:
    """file, command, search, web or other: by the tool; by a leading slash where the tool says nothing."""
    path = target.startswith("/") | target.startswith("./")
    return (
        F.when(tool.isin(*FILE_TOOLS), "file").when(tool == "Bash", "command").when(tool.isin(*SEARCH_TOOLS), "search")
        .when(tool.isin(*WEB_TOOLS), "web").when(path, "file").otherwise("other")
    )


def target_ending(target: Column) -> Column:
    """The ending of a path's last part, lower-cased, if it is short and plain; a name that only begins with a point has none."""
    name = F.substring_index(F.regexp_replace(target, "/+$", ""), "/", -1)
    return F.lower(F.regexp_extract(name, r"[^/.][^/]*(\.[A-Za-z0-9]{1,8})$", 1))


def target_depth(target: Column) -> Column:
    return F.size(F.filter(F.split(target, "/"), lambda x: (x != "") & (x != ".")))


def target_shape(tool: Column, target: Column) -> Column:
    """What a target is, in words without any of its own."""
    kind, ending, program = target_kind(tool, target), target_ending(target), X.first_program(target)
    return (
        F.when((kind == "file") & (ending != ""), F.concat(F.lit("a "), ending, F.lit(" file"))).when(kind == "file", "a file")
        .when((kind == "command") & (program != "other"), F.concat(F.lit("a `"), program, F.lit("` command"))).when(kind == "command", "a shell command")
        .when(kind == "search", "a code search").when(kind == "web", "a web fetch").otherwise("a target")
    )


def target_label(kind: Column, name: Column, ending: Column, depth: Column, program: Column) -> Column:
    """One line for a target that has its name."""
    return (
        F.when(kind == "file", F.concat(F.when(ending == "", "no ext").otherwise(ending), F.lit(" file, depth "), depth.cast("string"), F.lit(" ("), name, F.lit(")")))
        .when(kind == "command", F.concat(program, F.lit(" command ("), name, F.lit(")"))).otherwise(F.concat(kind, F.lit(" ("), name, F.lit(")")))
    )


#: The words that name what a report numbers, and of how many digits their numbers are at least.
WIDTHS = {"turn": 2, "call": 4, "agent": 2, "workflow": 2, "tooluse": 4, "path": 2, "cmd": 2, "search": 2, "web": 2, "target": 2}
TARGETS = {"file": "path", "command": "cmd", "search": "search", "web": "web", "other": "target"}


@dataclass(frozen=True)
class Mart:
    """How a mart leaves: the listed columns as they are, what columns hold as names of a kind, and its tool and target."""

    fields: tuple[str, ...]
    names: dict[str, str] = field(default_factory=dict)  # name's column and kind: raw column
    target: tuple[str, str] | None = None  # raw columns of tool and target
    order: tuple[str, ...] = ("ts",)


def sights(marts: dict[str, DataFrame], forms: dict[str, Mart]) -> DataFrame:
    """session_id, kind, key, tool, seen: everything the marts of a report name, mart after mart in the order of forms.

    The columns that order a mart's rows are of the same types in all marts.
    """
    out = None
    for place, (mart, form) in enumerate(forms.items()):
        df = marts[mart]
        seen = F.struct(F.lit(place).alias("mart"), *[F.col(c).alias(f"o{i}") for i, c in enumerate(form.order)])
        none = F.lit(None).cast("string")
        own = [F.struct(F.lit(k).alias("kind"), F.col(c).cast("string").alias("key"), none.alias("tool")) for k, c in form.names.items() if c in df.columns]
        if form.target and form.target[1] in df.columns:
            tool, target = form.target
            own.append(F.struct(F.lit("target").alias("kind"), F.col(target).cast("string").alias("key"), F.col(tool).cast("string").alias("tool")))
        if own:
            rows = df.select("session_id", F.explode(F.array(*own)).alias("n"), seen.alias("seen")).select("session_id", "n.*", "seen").filter("trim(key) <> ''")
            out = rows if out is None else out.unionByName(rows)
    return out


def report_names(seen: DataFrame) -> DataFrame:
    """session_id, kind, key, name, form: a number of each session's own for all it names, in order of first sight.

    seen: as `sights` gives it. Where a target is first seen tells its kind (`form`), and so its prefix. Numbers come from one
    order over all sessions, so that one that holds most rows is not numbered in one task.
    """
    first = seen.groupBy("session_id", "kind", "key").agg(F.min(F.struct("seen", "tool")).alias("f"))
    form = F.when(F.col("kind") == "target", target_kind(F.col("f.tool"), F.col("key")))
    prefix = F.col("kind")
    for own, word in TARGETS.items():
        prefix = F.when(form == own, F.lit(word)).otherwise(prefix)
    rows = first.select("session_id", "kind", "key", form.alias("form"), prefix.alias("prefix"), F.col("f.seen").alias("seen"))
    placed = scratch_table(numbered(rows, ["session_id", "prefix", "seen", "key"]).drop("seen"), "names")
    start = placed.groupBy("session_id", "prefix").agg(F.min("i").alias("start"))
    number = F.col("i") - F.col("start") + 1
    name = F.lit(None).cast("string")
    for word, width in WIDTHS.items():
        name = F.when(F.col("prefix") == word, padded(F.lit(word), number, width)).otherwise(name)
    return placed.join(start, ["session_id", "prefix"]).select("session_id", "kind", "key", name.alias("name"), "form")


def redacted(marts: dict[str, DataFrame], forms: dict[str, Mart], names: DataFrame, own: DataFrame | None = None) -> dict[str, DataFrame]:
    """The marts as they are published: listed columns, `session` by the kept map, what they name by numbers of the report.

    names: a pseudonym map; own: `report_names` of the same marts, else made here, so that one key has one name in all of them.
    A column that is not listed never leaves. A mart that was redacted before stays as it is.
    """
    raw = {m: df for m, df in marts.items() if "session_id" in df.columns}
    if own is None and raw:
        own = report_names(sights(raw, {m: f for m, f in forms.items() if m in raw}))
    sessions = names.filter("kind = 'session'").select(F.col("key").alias("_key"), "pseudonym")
    out = {}
    for mart, df in marts.items():
        form = forms[mart]
        if mart not in raw:
            out[mart] = df.select(*[c for c in df.columns if c in published(form)])
            continue
        df = df.withColumn("_key", F.col("session_id").cast("string")).join(sessions, "_key", "left").withColumn("session", named("session", F.col("session_id"), F.col("pseudonym"))).drop("pseudonym", "_key")
        wanted = [(k, k, c) for k, c in form.names.items()] + ([("target", "target", form.target[1])] if form.target else [])
        for column, kind, source in wanted:
            if source not in df.columns:
                df = df.withColumn(f"_{column}", F.lit(None).cast("string"))
                continue
            one = own.filter(F.col("kind") == kind).select("session_id", F.col("key").alias("_key"), F.col("name").alias(f"_{column}"), *([F.col("form").alias("_form")] if column == "target" else []))
            df = df.withColumn("_key", F.col(source).cast("string")).join(one, ["session_id", "_key"], "left").drop("_key")
        cols = [F.col("session"), *[F.col(f"_{c}").alias(c) for c, *_ in wanted]]
        if form.target:
            t = F.col(form.target[1])
            is_file, is_command = F.col("_form") == "file", F.col("_form") == "command"
            cols += [F.col("_form").alias("target_kind"), F.when(is_file, target_ending(t)).alias("target_ext"), F.when(is_file, target_depth(t)).alias("target_depth"), F.when(is_command, X.first_program(t)).alias("target_argv0")]
        out[mart] = df.select(*cols, *[F.col(c) for c in form.fields if c in df.columns])
    return out


def published(form: Mart) -> list[str]:
    """The columns that a mart may have once it is redacted."""
    shape = ["target", "target_kind", "target_ext", "target_depth", "target_argv0"] if form.target else []
    return ["session", *form.names, *shape, *form.fields]
