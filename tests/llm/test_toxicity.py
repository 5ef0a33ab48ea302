"""Toxicity: the automaton against plain edit distances, the lexicon, contexts, odd inputs."""

import math
import random

import pytest

from agentmeter.llm import toxicity
from agentmeter.llm.toxicity import END, Lexicon, Matcher, Shape, Trie

draw = random.Random(11)


def distance(a, b):
    """Edit distances of a to every beginning of b."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        step = [i]
        for j, y in enumerate(b):
            step.append(min(row[j] + (x != y), row[j + 1] + 1, step[j] + 1))
        row = step
    return row


def test_automaton_meets_trie():
    shape = Shape()
    entries = {"".join(draw.choices("abc", k=draw.randint(5, 10))) + draw.choice(["", END]) for _ in range(60)}
    trie = Trie(iter(entries), shape)
    met = 0
    for _ in range(600):
        base = draw.choice(sorted(entries)).removesuffix(END)
        word = "".join(c for c in base if draw.random() > 0.1) + draw.choice(["", "", "a", "cb", "abc"])
        want = set()
        for e in entries:
            plain = e.removesuffix(END)
            row = distance(plain, word)
            d = row[-1] if e.endswith(END) else min(row)
            if d <= shape.edits(plain):
                want.add((e, d))
        assert set(trie.near(word)) == want
        assert trie.may(word) or not want
        met += len(want)
    assert met > 300


def test_poisson():
    for rate in (0.01, 0.5, 3.0):
        for k in (1, 2, 4):
            want = 1 - sum(math.exp(-rate) * rate**i / math.factorial(i) for i in range(k))
            assert math.isclose(toxicity.by_chance(rate, k), math.log(want), rel_tol=1e-6)


def test_contexts_and_forms():
    own = {"clown" + END: (-1.5, 1e-6), "worthless" + END: (-1.5, 1e-6), "vequ": (-1.0, 1e-6)}
    m = Matcher(Lexicon(own, {e: (x - 3, y) for e, (x, y) in own.items()}, frozenset({"crown"}), Shape(), 0.01, -2.0, 0.01))
    assert m.hit("clown") == ("clown" + END, False) and m.hit("vequai") == ("vequ", False) and m.hit("clowns") == ("clown" + END, True)
    for word in ("clwn", "c1own", "cl@wn", "cloooown", "clovn", "wortless", "w0rthl3ss"):
        assert m.hit(word) and m.hit(word)[1], word
    assert all(m.hit(w) is None for w in ("crown", "town", "vexed", "", "worth", "aequ"))
    score = lambda t: m.score(*m.hits(t))
    assert score("you are a clown") > 0.9 and score("what a CL0WN he is") > 0.5 and score("nothing here") == 0.01
    for quoted in ('he wrote "you clown" to them', "the word “clown” means a jester", "« clown » est un mot"):
        assert score(quoted) < 0.5, quoted
    assert score('he said "hello" but you are a worthless clown') > 0.9
    assert [t[:4] for t in m.hits("İ clown")[1]] == [(2, 7, "clown" + END, False)]


def test_ratio_and_choice():
    assert toxicity.ratio(0, 5, 10, 10) == 0 == toxicity.ratio(1, 5, 10, 10) and toxicity.ratio(9, 0, 10, 100) > 20
    counts = {"vaq": (40, 0), "vaqu": (40, 0), "vaqua": (12, 0), "idi": (30, 0), "idio": (30, 0), "idiot" + END: (30, 0), "idiot": (30, 0), "com": (30, 20), "comta" + END: (20, 1)}
    assert set(toxicity.chosen(counts, 0.8, 0.98)) == {"vaqu", "idiot" + END, "comta" + END}


@pytest.fixture(scope="module")
def corpus(spark):
    words = ["".join(draw.choices("aeiourstlnm", k=draw.randint(2, 7))) for _ in range(400)]
    say = lambda n: draw.choices(words, k=n)
    rows, labels = [], []
    for i in range(900):
        text, bad = say(draw.randint(5, 120)), i % 6 == 0
        for _ in range(1 + len(text) // 40 if bad else 0):
            text.insert(draw.randint(0, len(text)), draw.choice(["stupid", "clown", "blargh" + draw.choice(words)]))
        rows.append((i, " ".join(text), 9.0, "x", "y"))
        labels.append((i, int(bad), 1))
    odd = [(2000, None), (2001, ""), (2002, "  \n"), (2003, " ".join(say(60_000))), (2004, " ".join(say(20)) + " you st0pid clwn " + " ".join(say(20))), (2005, "x" * 100_000), (None, "you clown")]
    rows += [(i, t, 9.0, "x", "y") for i, t in odd]
    labels += [(5, 1, 1), (6, 0, 0), (6, 0, 0), (None, 1, 1), (7, None, 1), (99999, 1, 1)]
    schema = "doc_id long, text string, score double, hits string, predicted string"
    return rows, labels, spark.createDataFrame(rows + [rows[3]] * 2, schema).repartition(4), spark.createDataFrame(labels, "doc_id long, toxic int, quality int")


def test_score(corpus):
    rows, labels, df, known = corpus
    out = toxicity.score(df, known, known.doc_id % 5 != 0)
    assert sorted(out.columns) == ["doc_id", "hits", "predicted", "score", "text"]
    got = out.collect()
    assert len(got) == len(rows) + 2 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    by = {r.doc_id: r for r in got}
    held = [i for i in range(900) if i % 5 == 0]
    assert sum(by[i].predicted == (i % 6 == 0) for i in held) >= 0.98 * len(held)
    assert by[2004].predicted == 1 and {h.misspelled for h in by[2004].hits} == {True}
    assert by[2000].score == by[2001].score == by[2002].score == by[2005].score < 0.1 and by[2003].predicted == 0
    for r in got:
        assert all(r.text[h.begin : h.end].lower().startswith(h.entry.removesuffix(END)) for h in r.hits if not h.misspelled)


def test_without_labels(corpus):
    _, _, df, known = corpus
    assert {r.score for r in toxicity.score(df, known.filter("false"), known.doc_id > 0).collect()} == {0.5}
    assert {r.score for r in toxicity.score(df, known.filter("toxic = 1"), known.doc_id > 0).collect()} == {1.0}
    assert toxicity.score(df.filter("false"), known, known.doc_id > 0).count() == 0
