"""Rules on measured figures: each with what it finds and what it leaves."""

from agentmeter.operators import figures

LINES = [
    ("it took $12.50 and €3k, $0.00 none, a$5", {("currency", "$12.50"), ("currency", "€3k")}),
    ("$3.00/Mtok and $15 per million are list prices, $4 is not", {("currency", "$4")}),
    ("the bill was 1,234.50 or 99.10 but not 99.1, 7.25% or 0.00", {("amount", "1,234.50"), ("amount", "99.10")}),
    ("99.10 alone is nothing", set()),
    ("rows: 5000 and 1,500 files", {("aggregate", "5000"), ("aggregate", "1,500"), ("aggregate", "1,500 files")}),
    ("sessions 1 2 3 4000 here", {("aggregate", "4000")}),
    ("sessions were far more than 4000 here", set()),
    ("1000 rows, 1024 rows and 2000% rows", set()),
    ("a window of 5 lines, 3 files, 12 files, 1.5 MB, 4k tokens, 0 calls", {("aggregate", "12 files"), ("aggregate", "1.5 MB"), ("aggregate", "4k tokens")}),
    ("v1.2 x9000 #7000 -8000 rows", set()),
    ("we measured 42 here", {("observation", "we measured 42 here")}),
    ("measured 7 here and 80%", set()),
    ("unmeasured 42", set()),
    ("measured 77 as agreed", set()),
    ("", set()),
]


def found(rows):
    return {(r.rule, r["sample"]) for r in rows}


def test_each_rule_finds_and_leaves(spark):
    texts = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(LINES)] + [(99, None)], "id int, text string")
    allowed = spark.createDataFrame([("aggregate", "77", "a default"), ("aggregate", "12 files", "a limit")], "rule string, sample string, reason string")
    rows = figures.findings(texts, allowed).collect()
    for i, (text, want) in enumerate(LINES):
        assert found([r for r in rows if r.id == i]) == want, text
    assert [r.reason for r in rows if r["sample"] == "12 files"] == ["a limit"] and not [r for r in rows if r.id == 99]


def test_a_percentage_near_a_rate(spark):
    far = "\n".join(["a share of 40 %", "x", "y", "$2 a line"])
    near = "\n".join(["x", "a share of 40 % or 50%", "per", "1,000 tokens", "60%"])
    rows = figures.findings(spark.createDataFrame([(1, far), (2, near)], "id int, text string")).filter("rule = 'rate-percent'").collect()
    assert {(r.id, r.line, r["sample"]) for r in rows} == {(2, 2, "40 %"), (2, 5, "60%")}


def test_equal_samples_of_a_line_are_counted(spark):
    (r,) = figures.findings(spark.createDataFrame([(1, "$5 and $5\nnothing")], "id int, text string")).collect()
    assert (r.line, r.n, r.reason) == (1, 2, None)


def test_the_query_equals_the_rules_alone(spark):
    """Money and percentages of the registered query against a reading of the same texts in Python."""
    import re

    from agentmeter.plans import redact

    sf = "/root/testdata/sf0.001"
    rows = redact.c17(spark, sf).collect()
    texts = {r.id: r.text for r in redact.reported(spark, sf).collect()}
    want = set()
    for i, text in texts.items():
        for n, line in enumerate(text.split("\n"), 1):
            for m in re.finditer(r"(?<!\w)[$€£]\s?(\d{1,3}(?:,\d{3})+(?:\.\d+)?|\d+(?:\.\d+)?)[kKmM]?(?![\w.])", line):
                if float(m.group(1).replace(",", "")) and not re.search(r"(?i)/\s?M?tok|per\s+M?tok|per\s+million|/\s?1M|list price", line[m.end() : m.end() + 18]):
                    want.add((i, n, m.group(0)))
    assert {(r.id, r.line, r["sample"]) for r in rows if r.rule == "currency"} == want and len(want) >= len(texts)
