"""Vector codes against brute force in Python's integers."""

import hashlib
import math
import random

import numpy as np
import pytest

from agentmeter.llm import codes

SCHEMA = "vec_id long, embedding array<{}>, label int, code string, held long"


def brute(rows, parts=4, entries=256, rounds=4):
    kept = [(i, [math.floor(1024 * x) for x in v], label) for i, v, label, *_ in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return []
    part = -(-max(len(v) for _, v, _ in kept) // parts)
    kept = [(i, v + [0] * (parts * part - len(v)), label) for i, v, label in kept]
    order = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    cut = lambda v, p: v[p * part : (p + 1) * part]
    books = [[cut(v, p) for _, v, _ in order] for p in range(parts)]
    far = lambda x, c: sum((a - b) ** 2 for a, b in zip(x, c, strict=True))
    near = lambda v, p: min(range(len(books[p])), key=lambda e: (far(cut(v, p), books[p][e]), e))
    for _ in range(rounds):
        at = [[near(v, p) for p in range(parts)] for _, v, _ in kept]
        for p in range(parts):
            for e in range(len(books[p])):
                own = [cut(v, p) for (_, v, _), a in zip(kept, at, strict=True) if a[p] == e]
                if own:
                    books[p][e] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    out = []
    for i, v, label in kept:
        at = [near(v, p) for p in range(parts)]
        out.append((i, label, "".join(f"{a:02x}" for a in at), sum(far(cut(v, p), books[p][a]) for p, a in enumerate(at))))
    digest = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    cap = lambda x: min(x, 2**63 - 1)
    return sorted(((i, label, code, cap(e), cap(sum(cap(r[3]) for r in out if r[1] == label)), digest) for i, label, code, e in out), key=repr)


def got(df, **sizes):
    return sorted(map(tuple, codes.compress(df, **sizes).collect()), key=repr)


@pytest.fixture(scope="module")
def vectors():
    draw = random.Random(8)
    f32 = lambda x: float(np.float32(x))
    rows = [(draw.randint(0, 500), [f32(draw.gauss(0, 0.4)) for _ in range(draw.choice([10, 10, 10, 9, 3]))], draw.choice([None, 1, 2, 3]), "x", 5) for _ in range(130)]
    rows += [rows[4]] * 60 + [(1000, None, 1, "x", 5), (1001, [1.0, None], 1, "x", 5), (1002, [float("nan")], 2, "x", 5), (1003, [float("inf")], 2, "x", 5), (None, [0.5, -1e-30], None, "x", 5), (1004, [], 1, "x", 5)]
    return rows


@pytest.mark.parametrize("entries", [256, 16, 1])
def test_codes(spark, vectors, entries):
    df = spark.createDataFrame(vectors, SCHEMA.format("float")).repartition(5)
    assert got(df, entries=entries) == brute(vectors, entries=entries)


@pytest.mark.parametrize("scale", [1e3, 4e5, 1e9, 1e30])
def test_large_values(spark, scale):
    draw = random.Random(9)
    rows = [(i, [draw.choice([-1, 1]) * draw.random() * scale for _ in range(8)], i % 3, "x", 1) for i in range(40)]
    df = spark.createDataFrame(rows, SCHEMA.format("double"))
    assert got(df, entries=8, rounds=2) == brute(rows, entries=8, rounds=2)


def test_products_are_exact():
    draw = np.random.default_rng(2)
    for d, bits in ((16, 20), (16, 29), (1, 31), (500, 26), (3, 5)):
        a, b = (draw.integers(-(2**bits), 2**bits, (7, d)) for _ in range(2))
        want = (a.astype(object) @ b.astype(object).T).tolist()
        assert codes.exact_product(a, b).tolist() == want
        width = codes.limb_bits(d)
        assert d * (2**width - 1) ** 2 < 2**53
        assert sum(x.astype(object) * 2 ** (width * i) for i, x in enumerate(codes.limbs(a, width))).astype(object).tolist() == a.tolist()


def test_empty(spark, vectors):
    df = spark.createDataFrame(vectors, SCHEMA.format("float"))
    assert got(df.filter("false")) == [] and got(df.filter("vec_id = 1000")) == []
