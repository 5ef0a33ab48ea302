"""The prefix trie against brute force, over blocks and partitions of any size."""

import collections
import hashlib
import random
import zlib

import pytest

from agentmeter.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string, depth int, parent_conv_id string"


def token(role, text):
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()[:32]


def brute(rows):
    """node -> the result row, from the rows themselves."""
    own = collections.defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, token(role or "", text or ""), role or "", text or ""))
    turns = {c: [(x[3], x[4]) for x in sorted(v)] for c, v in own.items()}
    built = {}
    for c, v in turns.items():
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = turns.get(c - (c % 20 if c >= 0 else -(-c % 20)), [])[:h] + v[h:]
    members, ends = collections.defaultdict(list), collections.defaultdict(list)
    for c, v in built.items():
        for d in range(len(v) + 1):
            members[tuple(v[:d])].append(c)
        ends[tuple(v)].append(c)
    kids = collections.Counter(k[:-1] for k in members if k)
    leaves, saved = collections.Counter(), collections.Counter()
    for k, m in members.items():
        words = len(trie_words(k[-1][1])) if k else 0
        for d in range(len(k) + 1):
            leaves[k[:d]] += not kids[k]
            saved[k[:d]] += (len(m) - 1) * words
    join = lambda ids: hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest()
    return sorted((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), kids[k], leaves[k], saved[k], join(ends.get(k, []))) for k, m in members.items())


def trie_words(text):
    return [w for w in text.replace("\t", " ").replace("\n", " ").split(" ") if w]


def got(df, **sizes):
    return sorted(map(tuple, trie.prefix_trie(df, **sizes).collect()))


@pytest.fixture(scope="module")
def conversations():
    draw = random.Random(4)
    say = ["a b", "c", "", None, "a  b\tc", "same words here", "ünï ©"]
    rows = []
    for c in [*range(45), -3, -20, -21, 4096, 8192, 10**12]:
        for turn in range(draw.choice([1, 1, 2, 3, 5, 9])):
            rows.append((c, turn, draw.choice(["user", "user", None]), draw.choice(say[: draw.choice([1, 2, 7])]), 1, "x"))
    rows += [(50 + i, t, "user", f"copy {t}", 1, "x") for i in range(12) for t in range(5)]  # equal conversations
    rows += [(80, t, "user", "long" if t < 30 else f"w {t}", 1, "x") for t in range(41)] + [(81, t, "user", "long", 1, "x") for t in range(33)]
    rows += [(90, None, "user", "first", 1, "x"), (90, 3, "b", "tie", 1, "x"), (90, 3, "a", "tie", 1, "x"), (None, 1, "user", "nobody", 1, "x")]
    return rows + rows[3:9] + [rows[5]] * 3  # repeated rows are turns of their own


@pytest.mark.parametrize("sizes", [{}, {"block": 1, "part_rows": 7}, {"block": 2, "part_rows": 3}, {"block": 3, "part_rows": 1}, {"block": 16, "part_rows": 5}])
def test_trie(spark, conversations, sizes):
    df = spark.createDataFrame(conversations, SCHEMA).repartition(3)
    assert got(df, **sizes) == brute(conversations)


def test_one_conversation_with_most_turns(spark):
    rows = [(7, i, "user", f"t {i % 50}", 1, "") for i in range(900)] + [(i, 0, "user", "hi there", 1, "") for i in range(100, 120)]
    assert got(spark.createDataFrame(rows, SCHEMA), block=8, part_rows=4) == brute(rows)


def test_odd_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert got(empty) == []
    assert got(spark.createDataFrame([(None, 1, "user", "x", 1, "")], SCHEMA)) == []
    long = [(1, 0, "user", "word " * 200_000, 1, ""), (2, 0, "user", "word " * 200_000, 1, "")]
    assert got(spark.createDataFrame(long, SCHEMA)) == brute(long)


def test_merges_make_branching_nodes():
    turn = lambda s: b"".join(x.encode() * trie.TURN for x in s)
    f = trie.Forest([turn(s) for s in ("a", "ab", "abcd", "abce", "acx", "b")])
    assert sorted(f.depth[v] for v, _ in f.upwards()) == [0, 1, 1, 2, 3, 3, 4, 4] and f.depth[f.top] == 0
    assert trie.shared(turn("abc"), turn("abd")) == 2 and trie.shared(b"", turn("a")) == 0
