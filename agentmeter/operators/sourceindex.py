"""The index of source texts as tables: lines, symbols, chunks, imports, closures, snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: How a language declares: words that may stand before, keyword and kind, what a name may be.
_NAME = r"[A-Za-z_$][A-Za-z0-9_$]*"
DECLARATIONS = {
    "py": ("async", (("class", "class"), ("def", "function")), _NAME),
    "ts": ("export default declare abstract async const", (("class", "class"), ("interface", "interface"), ("enum", "enum"), ("type", "type"), ("namespace", "namespace"), ("function", "function")), _NAME),
    "cs": ("public private protected internal static sealed abstract partial readonly", (("class", "class"), ("struct", "struct"), ("interface", "interface"), ("record", "record"), ("enum", "enum"), ("namespace", "namespace")), r"[A-Za-z_][A-Za-z0-9_.]*"),
    "sql": ("create or replace alter temporary unique", (("table", "table"), ("view", "view"), ("procedure", "procedure"), ("function", "function"), ("trigger", "trigger"), ("index", "index")), r"[A-Za-z_\[][A-Za-z0-9_.\]\[]*"),
}
#: Constants of a module, headings and rules have no keyword of that shape.
SHAPES = (("ts", "const", rf"^\s*export\s+const\s+({_NAME})"), ("md", "heading", r"^#{1,6}\s+(.*\S)"), ("css", "rule", r"^\s*([.#][A-Za-z_][A-Za-z0-9_-]*)[^;]*\{"))
#: Where a language names what it imports: a test of the line, then the specifier as group 1.
IMPORTS = (
    ("py", r"^\s*(?:import|from)\s", r"^\s*(?:import|from)\s+([A-Za-z_.][A-Za-z0-9_.]*)"),
    ("ts", r"^\s*(?:import|export)\b|\brequire\s*\(|\bimport\s*\(", r"""(?:\bfrom\s+|\bimport\s+|\(\s*)['"]([^'"]+)['"]"""),
    ("cs", r"^\s*using\s", r"^\s*using\s+(?:static\s+)?([A-Za-z_][A-Za-z0-9_.]*)\s*;"),
    ("css", r"^\s*@import\s", r"""['"]([^'"]+)['"]"""),
    ("md", r"\]\(", r"\]\(([^)#\s]+)\)"),
)


def _symbol_rules() -> list[tuple[str, str, str]]:
    """language, kind, pattern with the name as group 1: leading words, keyword, name."""
    out = []
    for lang, (leading, kinds, name) in DECLARATIONS.items():
        before = r"^\s*(?:(?:" + "|".join(leading.split()) + r")\s+)*"
        own = "(?i)" if lang == "sql" else ""
        extra = r"(?:if\s+not\s+exists\s+)?" if lang == "sql" else ""
        out += [(lang, kind, rf"{own}{before}{word}\s+{extra}({name})") for word, kind in kinds]
    return [*out, *SHAPES]


#: Extension, language.
EXTENSIONS = (("py", "py"), ("ts", "ts"), ("tsx", "ts"), ("js", "ts"), ("jsx", "ts"), ("svelte", "ts"), ("cs", "cs"), ("sql", "sql"), ("md", "md"), ("html", "html"), ("css", "css"))

CHUNK_LINES = 140


def language(path: Column) -> Column:
    ext, out = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]{1,8})$", 1)), F.lit(None).cast("string")
    for e, lang in EXTENSIONS:
        out = F.when(ext == e, lang).otherwise(out)
    return out


def lines(texts: DataFrame) -> DataFrame:
    """id, lang, line (from 1), text of each line. texts: id, lang, text."""
    return texts.select("id", "lang", F.posexplode(F.split("text", "\n"))).select("id", "lang", (F.col("pos") + 1).alias("line"), F.col("col").alias("text"))


def symbols(texts: DataFrame) -> DataFrame:
    """id, kind, name, lo, hi: a symbol ends before the next that is indented no deeper, else with the text."""
    found = F.lit(None).cast("struct<kind:string,name:string>")
    for lang, kind, pattern in reversed(_symbol_rules()):
        name = F.regexp_extract("text", pattern, 1)
        found = F.when((F.col("lang") == lang) & (name != ""), F.struct(F.lit(kind).alias("kind"), name.alias("name"))).otherwise(found)
    s = lines(texts).withColumn("s", found)
    s = s.withColumn("indent", F.length(F.regexp_extract("text", r"^(\s*)", 1))).filter("s is not null").select("id", "line", "indent", "s.*")
    ends = texts.select("id", F.size(F.split("text", "\n")).alias("n"))
    each = s.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("line", "indent", "kind", "name"))).alias("all"))
    # a text's symbols are as many as its lines at most: the array is bounded by the text itself
    hi = F.expr("coalesce(try_element_at(filter(slice(all, pos + 2, size(all)), x -> x.indent <= s.indent), 1).line - 1, n)")
    each = each.join(ends, "id").select("id", "n", "all", F.posexplode("all").alias("pos", "s"))
    return each.select("id", "s.kind", "s.name", F.col("s.line").alias("lo"), hi.alias("hi"))


def chunks(texts: DataFrame, size: int = CHUNK_LINES) -> DataFrame:
    """id, chunk, lo, hi, digest: runs of at most size lines, with the hash of what they hold."""
    rows = F.split("text", "\n")
    n = F.size(rows)
    c = texts.select("id", rows.alias("rows"), n.alias("n"), F.explode(F.sequence(F.lit(0), F.floor((n - 1) / size).cast("int"))).alias("chunk"))
    lo, hi = F.col("chunk") * size + 1, F.least((F.col("chunk") + 1) * size, F.col("n"))
    return c.select("id", "chunk", lo.alias("lo"), hi.alias("hi"), F.md5(F.array_join(F.slice("rows", lo, F.lit(size)), "\n").cast("binary")).alias("digest"))


def specifiers(texts: DataFrame) -> DataFrame:
    """id, line, spec: what a line imports."""
    spec = F.lit("")
    for lang, line, pattern in IMPORTS:
        spec = F.when((F.col("lang") == lang) & F.col("text").rlike(line), F.regexp_extract("text", pattern, 1)).otherwise(spec)
    return lines(texts).withColumn("spec", spec).filter("spec <> ''").select("id", "line", "spec")


def edges(specs: DataFrame, files: DataFrame) -> DataFrame:
    """src, dst, spec: a specifier met with the one file whose module path or last parts it names.

    Keys are the last four, three, two and one parts of a file's path without its extension; a
    key that two files share decides nothing; the longest key wins.
    """
    parts = F.split(F.regexp_replace(F.regexp_replace("path", r"\.[A-Za-z0-9]{1,8}$", ""), r"/(?:index|__init__)$", ""), "/")
    keys = files.select(F.col("id").alias("dst"), parts.alias("p")).select("dst", F.explode(F.sequence(F.lit(1), F.least(F.lit(4), F.size("p")))).alias("k"), "p")
    keys = keys.select("dst", "k", F.array_join(F.slice("p", F.size("p") - F.col("k") + 1, F.col("k")), "/").alias("key"))
    sole = keys.groupBy("k", "key").agg(F.count("*").alias("n"), F.min("dst").alias("dst")).filter("n = 1").select("k", "key", "dst")
    name = F.regexp_replace(F.regexp_replace(F.translate("spec", ".", "/"), r"^/+", ""), r"/+", "/")
    wanted = specs.select(F.col("id").alias("src"), "spec", F.split(name, "/").alias("q")).distinct()
    wanted = wanted.select("src", "spec", F.explode(F.sequence(F.lit(1), F.least(F.lit(4), F.size("q")))).alias("k"), "q")
    wanted = wanted.select("src", "spec", "k", F.array_join(F.slice("q", F.size("q") - F.col("k") + 1, F.col("k")), "/").alias("key"))
    return wanted.join(sole, ["k", "key"]).groupBy("src", "spec").agg(F.max_by("dst", "k").alias("dst")).filter("src <> dst")


def closure(seeds: DataFrame, edge: DataFrame, depth: int = 2) -> DataFrame:
    """seed, node, depth: all that is reached in at most `depth` steps, each with its shortest way.

    seeds: seed, node. The visited pairs are an anti-join; a step is one equi-join.
    """
    seen = front = seeds.select("seed", "node", F.lit(0).alias("depth")).dropDuplicates(["seed", "node"])
    hop = edge.select(F.col("src").alias("node"), F.col("dst").alias("next")).distinct()
    for d in range(1, depth + 1):
        front = front.join(hop, "node").select("seed", F.col("next").alias("node"), F.lit(d).alias("depth")).distinct().join(seen.select("seed", "node"), ["seed", "node"], "left_anti")
        seen = seen.unionByName(front)
    return seen


def changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """id, state of a snapshot against the one before (id, size, mtime, digest): same, touched, changed, added, removed."""
    a, b = old.select("id", *[F.col(c).alias(f"o_{c}") for c in ("size", "mtime", "digest")], F.lit(True).alias("was")), new.select("id", "size", "mtime", "digest", F.lit(True).alias("now"))
    both = a.join(b, "id", "full")
    state = F.when(F.col("now").isNull(), "removed").when(F.col("was").isNull(), "added").when(F.expr("size = o_size and mtime <=> o_mtime"), "same").when(F.col("digest") == F.col("o_digest"), "touched").otherwise("changed")
    return both.select("id", state.alias("state"))


def packed(ranked: DataFrame, budget: int) -> DataFrame:
    """key, rank, tokens of what fits the budget in rank order; what overflows is skipped, not the end.

    ranked: key, rank, tokens. A key's rows are folded in order; what is larger than the budget is
    left out before, so a key holds no more than what could fit.
    """
    order = F.sort_array(F.collect_list(F.struct("rank", "tokens")))
    g = ranked.filter(F.col("tokens") <= budget).groupBy("key").agg(order.alias("a"))
    fold = F.expr(f"aggregate(a, named_struct('spent', 0L, 'got', cast(array() as array<struct<rank:int,tokens:bigint>>)), (s, x) -> if(s.spent + x.tokens <= {budget}, named_struct('spent', s.spent + x.tokens, 'got', array_append(s.got, x)), s)).got")
    return g.select("key", F.explode(fold).alias("x")).select("key", "x.rank", "x.tokens")


def regions(texts: DataFrame, found: DataFrame, tiny: int = 12, together: int = 36, size: int = CHUNK_LINES) -> DataFrame:
    """id, lo, hi, name: a text cut where its symbols begin; runs under `tiny` lines join up to `together`; none is longer than `size`.

    found: id, name, lo. A region is named by its first symbol, the part before any by null; the
    parts of a split region keep its name. A text's regions are folded in order.
    """
    ends = texts.select("id", F.size(F.split("text", "\n")).alias("n"))
    starts = found.groupBy("id", "lo").agg(F.min("name").alias("name")).unionByName(texts.select("id", F.lit(1).alias("lo"), F.lit(None).cast("string").alias("name")))
    starts = starts.groupBy("id", "lo").agg(F.max("name").alias("name"))
    nxt = F.lead("lo").over(Window.partitionBy("id").orderBy("lo"))
    r = starts.join(ends, "id").withColumn("hi", F.coalesce(nxt - 1, "n"))
    own = r.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("lo", "hi", "name"))).alias("a"))
    last = "element_at(s, -1)"
    joins = f"size(s) > 0 and ({last}.hi - {last}.lo + 1 < {tiny} or x.hi - x.lo + 1 < {tiny}) and x.hi - {last}.lo + 1 <= {together}"
    fold = f"aggregate(a, cast(array() as array<struct<lo:int,hi:int,name:string>>), (s, x) -> if({joins}, array_append(slice(s, 1, size(s) - 1), named_struct('lo', {last}.lo, 'hi', x.hi, 'name', coalesce({last}.name, x.name))), array_append(s, x)))"
    m = own.select("id", F.explode(F.expr(fold)).alias("x")).select("id", "x.*")
    cut = m.select("id", "hi", "name", F.explode(F.sequence("lo", "hi", F.lit(size))).alias("lo"))
    return cut.select("id", "lo", F.least(F.col("hi"), F.col("lo") + size - 1).alias("hi"), "name")


def text_slice(texts: DataFrame, most_bytes: int = 12_000) -> DataFrame:
    """id, lo, hi, part: the lines [lo, hi] of each text (id, text, lo, hi), cut at a line's end within most_bytes."""
    rows = F.slice(F.split("text", "\n"), F.greatest(F.lit(1), F.col("lo")), F.greatest(F.lit(0), F.col("hi") - F.greatest(F.lit(1), F.col("lo")) + 1))
    fold = f"aggregate(rows, named_struct('n', 0, 'b', 0), (s, x) -> if(s.b + octet_length(x) + 1 <= {most_bytes} and s.b >= 0, named_struct('n', s.n + 1, 'b', s.b + octet_length(x) + 1), named_struct('n', s.n, 'b', -1 - {most_bytes}))).n"
    t = texts.withColumn("rows", rows).withColumn("n", F.expr(fold))
    return t.select("id", "lo", F.expr("lo + n - 1").alias("hi"), F.array_join(F.slice("rows", F.lit(1), F.col("n")), "\n").alias("part"))
