"""Symbols, imports and closures of a small source tree, worked out by hand."""

from agentmeter.operators import accounts, sourceindex

PY = "class A:\n    def f(self):\n        return 1\n\n    def g(self):\n        pass\n\ndef top():\n    pass"
FILES = [("a", "src/pkg/a.py", PY), ("b", "src/pkg/b.py", "from pkg.a import A\nx = 1"), ("c", "src/web/c.ts", "import { f } from '../pkg/d'\nexport const k = 1"), ("n", "notes.md", None)]


def table(spark):
    df = spark.createDataFrame(FILES, "id string, path string, text string")
    return df.withColumn("lang", sourceindex.language(df["path"]))


def test_symbols_end_before_the_next_of_their_depth(spark):
    got = {(r["id"], r["name"]): (r["kind"], r["lo"], r["hi"]) for r in sourceindex.symbols(table(spark)).collect()}
    assert got == {("a", "A"): ("class", 1, 7), ("a", "f"): ("function", 2, 4), ("a", "g"): ("function", 5, 7), ("a", "top"): ("function", 8, 9), ("c", "k"): ("const", 2, 2)}


def test_imports_become_edges_and_closures(spark):
    t = table(spark)
    edges = sourceindex.edges(sourceindex.specifiers(t), t.select("id", "path"))
    assert [(r["src"], r["dst"]) for r in edges.collect()] == [("b", "a")]
    seeds = spark.createDataFrame([("b", "b")], "seed string, node string")
    assert sorted((r["node"], r["depth"]) for r in sourceindex.closure(seeds, edges, 2).collect()) == [("a", 1), ("b", 0)]


def test_an_unknown_label_selects_nothing(spark):
    rows = spark.createDataFrame([("primary",), ("secondary",)], "label string")
    known = ["primary", "secondary"]
    assert [accounts.selected(rows, w, known).count() for w in ([], ["p"], ["nobody"], [" Secondary "])] == [2, 1, 0, 1]
