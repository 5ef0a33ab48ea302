"""The kept index: reads what changed, finds what a rebuild finds, before and after it is compacted."""

import pytest
from pyspark.sql import functions as F

from agentmeter.operators.searchindex import SearchIndex, glob_pattern, query_keys

CHUNK = "id long, chunk int, symbol string, heading string, body string"
FILES = {
    1: ("src/pay.py", "py", [("mountLauncher", None, "def mountLauncher(x): return launch_all(x)"), ("other", "Title words", "the body of café")]),
    2: ("src/bill.ts", "ts", [("Invoice", "", "class Invoice total total launch")]),
    3: ("docs/read.md", "md", [("", "Launch notes", "how to launch the HTTPServer2 well")]),
    4: ("src/none.py", "py", []),
}


@pytest.fixture
def world(spark, tmp_path):
    asked = []

    def listing(files, stamp):
        rows = [(i, sum(len(c[2]) for c in v[2]), stamp.get(i, 0), v[0], v[1]) for i, v in files.items()]
        return spark.createDataFrame(rows + rows[:1], "id long, size long, mtime long, path string, lang string")

    def reader(files):
        def read(ids):
            own = [r.id for r in ids.collect()]
            asked.append(sorted(own))
            return spark.createDataFrame([(i, n, *c) for i in own for n, c in enumerate(files[i][2])], CHUNK)

        return read

    return SearchIndex(spark, str(tmp_path / "index"), buckets=8), listing, reader, asked


def found(index, text, **more):
    q = index.spark.createDataFrame([(1, text), (2, None), (3, "-- !")], "query_id long, text string")
    return [(r.id, r.chunk, r.score) for r in index.search(q, **more).orderBy("query_id", "rank").collect()]


def test_runs_read_what_changed_and_equal_a_rebuild(spark, world, tmp_path):
    index, listing, reader, asked = world
    assert index.update(listing(FILES, {}), reader(FILES)) == {"scanned": 4, "asked": 4, "indexed": 4, "touched": 0, "removed": 0}
    assert {x[0] for x in found(index, "launcher")} == {1} and found(index, "launcher")[0][:2] == (1, 0)
    assert {x[0] for x in found(index, "laun")} == {1, 2, 3}  # a prefix of a word
    assert {x[0] for x in found(index, "http_server")} == {3} and found(index, "zzz") == []
    assert {x[0] for x in found(index, "launch", lang="ts")} == {2} and {x[0] for x in found(index, "launch", path_glob="src/*")} == {1, 2}
    assert index.update(listing(FILES, {}), reader(FILES))["asked"] == 0
    new = {1: FILES[1], 2: ("src/bill.ts", "ts", [("Invoice", "", "class Invoice refund")]), 5: ("src/new.py", "py", [("fresh", None, "launch again")]), 4: FILES[4]}
    with pytest.raises(ZeroDivisionError):  # a run that fails counts for nothing
        index.update(listing(new, {1: 7}), lambda ids: 1 / 0)
    assert {x[0] for x in found(index, "laun")} == {1, 2, 3}
    assert index.update(listing(new, {1: 7}), reader(new)) == {"scanned": 4, "asked": 3, "indexed": 2, "touched": 1, "removed": 1}
    assert asked == [[1, 2, 3, 4], [], [1, 2, 5]]
    fresh = SearchIndex(spark, str(tmp_path / "fresh"), buckets=8)
    fresh.update(listing(new, {1: 7}), reader(new))
    for text in ("launch", "invoice refund", "mount launcher body", "total", "src/pay.py", "read"):
        assert found(index, text) == found(fresh, text)
    before = found(index, "launch class")
    index.compact()
    assert found(index, "launch class") == before and index.runs().count() == 4
    assert index.postings().select("gen").distinct().count() == 1


def test_empty_index(spark, world):
    index, listing, reader, _ = world
    assert index.update(listing(FILES, {}).filter("false"), lambda ids: spark.createDataFrame([], CHUNK))["scanned"] == 0
    assert found(index, "launch") == []


def test_query_keys_and_globs(spark):
    q = spark.createDataFrame([(1, "mountLauncher of a_b-cd ./x.py MAXLen2")], "query_id long, text string")
    assert [r.key for r in query_keys(q).collect()] == ["mountlauncher", "mountlauncher*", "mount", "mount*", "launcher", "launcher*", "of", "cd", "py", "maxlen2", "maxlen2*", "max", "len2", "len2*"]
    paths = spark.createDataFrame([("src/a.py",), ("src/sub/b.py",), ("a.ts",)], "p string")
    hit = lambda g: {r.p for r in paths.filter(F.col("p").rlike(glob_pattern(g))).collect()}
    assert hit("src/*.py") == {"src/a.py", "src/sub/b.py"} and hit("?.ts") == {"a.ts"} and hit("src/[a-b].py") == {"src/a.py"}


def test_words_are_found_once_and_stay_with_their_text(spark, world):
    """Nothing but texts and each task's best is dealt out; files of several chunks, one without words, count as before."""
    from agentmeter.operators import search

    t = spark.createDataFrame([(1, "alpha beta alpha"), (2, "beta gamma"), (3, ""), (4, None), (5, "alphabet")], "id long, text string")
    q = spark.createDataFrame([(1, "alpha beta"), (2, "none")], "query_id long, text string")
    out = search.bm25(t, q)
    assert [(r.query_id, r.id) for r in out.orderBy("query_id", "rank").collect()] == [(1, 1), (1, 2), (1, 5)]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(query_id#" in plan and not any(f"{x}#" in line for line in plan.split("\n") if "Exchange hashpartitioning" in line for x in ("key", " w") if "hashpartitioning(id#" in line)
    # the words of a text are not made once more to see whether there are any
    text = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Filter ((size(" not in text and "AND (size(" not in text
    index, listing, reader, _ = world
    index.update(listing(FILES, {}), reader(FILES))
    got = {r.id: (r.chunks, r.length) for r in index.files().collect()}
    want = {r.id: r.n for r in index.postings().groupBy("id").agg(F.sum(F.expr("tf.path + tf.symbol + tf.heading + tf.body + tf.terms")).alias("n")).collect()}
    assert {i: c for i, (c, _) in got.items()} == {1: 2, 2: 1, 3: 1, 4: 0} and {i: n for i, (_, n) in got.items() if n} == want
