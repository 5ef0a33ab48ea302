"""Code retrieval and publishing rules on small tables, worked out by hand."""

from pyspark.sql import functions as F

from agentmeter.operators import publishing, retrieval


def test_source_tree(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / ".git").mkdir()
    (tmp_path / "a" / "x.py").write_text("def f():\n    pass\n")
    (tmp_path / "a" / "y.txt").write_text("no source")
    (tmp_path / "a" / "big.py").write_text("x" * 200)
    (tmp_path / "a" / "bin.py").write_bytes(b"a\x00b")
    (tmp_path / ".git" / "z.py").write_text("hidden")
    got = retrieval.scan(spark, str(tmp_path), most_bytes=100).collect()
    assert [(r.path.rsplit("/", 1)[1], r.lang, r.size) for r in got] == [("x.py", "py", 18)] and got[0].text.startswith("def f")


def test_imports_and_suffixes(spark):
    files = spark.createDataFrame([(1, "src/app/main.ts"), (2, "src/app/util.ts"), (3, "src/lib/index.ts"), (4, "src/app/util.js"), (5, "other/main.ts")], "id long, path string")
    specs = spark.createDataFrame([(1, "./util"), (1, "../lib"), (1, "./gone"), (1, "react"), (2, "./util")], "id long, spec string")
    assert {(r.src, r.spec, r.dst) for r in retrieval.relative(specs, files).collect()} == {(1, "./util", 2), (1, "../lib", 3)}
    typed = spark.createDataFrame([("a", "app/main.ts"), ("b", "main.ts"), ("c", "ain.ts"), ("d", "/lib/index.ts")], "key string, suffix string")
    assert {r.key: r.path for r in retrieval.by_suffix(typed, files).collect()} == {"a": "src/app/main.ts", "b": "other/main.ts", "d": "src/lib/index.ts"}


def test_closure_ways_and_chunks(spark):
    edge = spark.createDataFrame([("a", "b"), ("b", "c"), ("d", "b"), ("c", "a")], "src string, dst string")
    seed = spark.createDataFrame([("b", "b")], "seed string, node string")
    reach = lambda way: {(r.node, r.depth) for r in retrieval.around(seed, edge, 1, way).collect()}
    assert reach("out") == {("b", 0), ("c", 1)} and reach("in") == {("b", 0), ("a", 1), ("d", 1)} and reach("both") == {("b", 0), ("c", 1), ("a", 1), ("d", 1)}
    chunks = spark.createDataFrame([("b", 9, "function", 5), ("b", 1, None, 50), ("b", 20, "class", 9), ("c", 1, "class", 1)], "id string, lo int, kind string, tokens int")
    got = retrieval.ranked_chunks(retrieval.around(seed, edge, 1), chunks, per_file=2, k=3).orderBy("rank").collect()
    assert [(r.node, r.lo) for r in got] == [("b", 1), ("b", 20), ("c", 1)]


def test_symbols_outlines_and_rungs(spark):
    s = spark.createDataFrame([(1, "function", "f", 1, 3), (1, "class", "C", 4, 30), (2, "function", "f", 1, 9)], "id long, kind string, name string, lo int, hi int")
    got = retrieval.lookup(s, spark.createDataFrame([("f",)], "name string")).orderBy("rank").collect()
    assert [(r.id, r.rank) for r in got] == [(2, 1), (1, 2)]
    o = retrieval.outline(s, spark.createDataFrame([(1, "x" * 400)], "id long, text string")).first()
    assert o.outline == "function f 1-3\nclass C 4-30" and o.tokens == 7 and o.whole_tokens == 100
    reads = [("a", True, None, 100, 1.0), ("a", False, 5, 10, 1.0), ("a", None, None, 100, 1.0), ("b", True, None, 50, 1.0), ("z", True, None, 50, 1.0)]
    index = spark.createDataFrame([("a", 20), ("b", 0)], "path string, tokens long")
    bands = {r.rung: (r.reads, round(r.saves_usd, 6), round(r.loses_usd, 6)) for r in retrieval.shrink_bands(spark.createDataFrame(reads, "path string, whole_file boolean, lo int, tokens long, usd double"), index).collect()}
    assert bands == {"whole_file": (1, 0.8, 0.0), "spanned": (1, 0.0, 1.0), "span_unknown": (1, 0.0, 0.0), "no_outline": (1, 0.0, 0.0), "never_indexed": (1, 0.0, 0.0)}


def test_gate_tokens_stamps_and_residency(spark):
    g = spark.createDataFrame([(0.5, 10), (0.5, 99999), (0.1, 10), (None, 10), (0.5, None)], "share double, age int").select(publishing.brief_gate(F.col("share"), F.col("age")).alias("g")).collect()
    assert [r.g.brief for r in g] == [True, False, False, False, False] and [r.g.reason for r in g][1:4] == ["prior too old", "agents read little", "no prior"]
    a = spark.createDataFrame([("A@x.org",), ("b@x.org",)], "address string")
    t = {r.address: r.token for r in publishing.account_token(a, spark.createDataFrame([("a@x.org", "primary")], "address string, label string")).collect()}
    assert t["A@x.org"] == "primary" and t["b@x.org"].startswith("account-") and len(t["b@x.org"]) == 16
    active = spark.createDataFrame([("o", "s1"), ("o", "s2")], "owner string, session_id string")
    logins = spark.createDataFrame([("o", 1, "old"), ("o", 2, "new")], "owner string, at long, label string")
    known = spark.createDataFrame([("o", "s1", "old")], "owner string, session_id string, label string")
    assert [(r.session_id, r.label) for r in publishing.stamped(active, logins, known).collect()] == [("s2", "new")]
    held = spark.createDataFrame([("s", 1, "p"), ("s", 2, "q")], "session_id string, epoch long, path string")
    assert [r.path for r in publishing.open_residency(held, held.select("session_id", "epoch")).collect()] == ["q"]


def test_export_and_terms(spark, tmp_path):
    rows = spark.createDataFrame([("s", "r", True, 1500000)], "session_id string, request_id string, fast boolean, m_total long").withColumns({f"m_{k}": F.lit(0) for k in ("input", "output", "cw5", "cw1", "read", "search")})
    publishing.export_csv(rows, str(tmp_path / "csv"))
    r = spark.read.option("header", True).csv(str(tmp_path / "csv")).first()
    assert r.usd_total == "1.5000000000" and r.fast == "1" and r.effort is None and len(publishing.CSV_COLUMNS) == 40
    texts = spark.createDataFrame([(1, "Acme and acme, acmeX"), (2, None), (3, "a+b a+bc")], "id long, text string")
    terms = spark.createDataFrame([("ACME",), ("a+b",)], "term string")
    assert {(r.id, r.term, r.n) for r in publishing.denied(texts, terms).collect()} == {(1, "acme", 2), (3, "a+b", 1)}
