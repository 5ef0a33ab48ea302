"""Candidates of personal data lie clear of the spans taken, in time that grows with the text."""

import random
import time

from agentmeter.llm import pii


def test_candidates_are_clear_of_spans():
    draw = random.Random(3)
    words = ["a.b@c.org", "10.0.0.1", "x1", "+1 (017) 555-7713", "plain", "12 34", "4111 1111 1111 1111", "k=v", "@me", "(z9)"]
    for _ in range(400):
        text = " ".join(draw.choices(words, k=draw.randint(0, 12)))
        base = pii.base_spans(text)
        got = pii.candidates(text, base)
        assert got == sorted(got) and all(b <= x or y <= a for a, b in got for _, x, y in base)
        assert pii.candidates(text, []) or not any(pii._mark(text))
        # taken one by one they leave what they leave together
        assert set(got) <= {c for c in pii.candidates(text, [])} | set(got)
        free = [c for c in pii.candidates(text, []) if all(c[1] <= x or y <= c[0] for _, x, y in base)]
        assert all(any(a <= x and y <= b for a, b in got) for x, y in free)


def test_long_lists_of_addresses():
    text = " ".join(f"user{i}@host{i}.example.org tag-{i}" for i in range(40_000))
    began = time.time()
    base = pii.base_spans(text)
    got = pii.candidates(text, base)
    assert len(base) == len(got) == 40_000 and time.time() - began < 30
