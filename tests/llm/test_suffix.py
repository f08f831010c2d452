import hashlib
import random

import numpy as np
import pytest

from tests.llm.util import docs
from tidemark.llm import suffix


def brute(texts, least=50):
    low = {}
    for k, t in texts:
        raw = (t or "").encode()
        for i in range(len(raw) - least + 1):
            g = raw[i : i + least]
            low[g] = min(low.get(g, k), k)
    out = []
    for k, t in texts:
        raw = (t or "").encode()
        gone = np.zeros(len(raw) + 1, bool)
        for i in range(len(raw) - least + 1):
            if low[raw[i : i + least]] < k:
                gone[i : i + least] = True
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        spans = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        out.append((k, len(raw), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def corpus(seed, n=150):
    r = random.Random(seed)
    signs = "abé d\n\0"
    word = lambda k: "".join(r.choice(signs) for _ in range(k))
    passages = [word(r.randint(45, 120)) for _ in range(6)]
    texts = [None, "", "x" * 49, "x" * 50, "x" * 51, "x" * 300, "ab" * 200, "ab" * 60 + "c" + "ab" * 60]
    for _ in range(n):
        parts = [r.choice([word(r.randint(0, 80)), r.choice(passages), r.choice(passages)[5:], "x" * r.randint(40, 70)]) for _ in range(r.randint(1, 5))]
        texts.append("".join(parts))
        if r.random() < 0.2:
            texts.append(texts[-1])
        if r.random() < 0.2:
            t = texts[-1]
            i = r.randrange(len(t) + 1)
            texts.append(t[:i] + "#" + t[i:])
    ids = r.sample(range(-50, 5000), len(texts))
    rows = list(zip(ids, texts))
    return rows + [rows[12], (9999, "x" * 50)]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_dedup_matches_brute_force(spark, seed):
    texts = corpus(seed)
    got = suffix.dedup(docs(spark, texts).withColumnRenamed("source", "sha")).collect()
    assert sorted(tuple(r) for r in got) == brute(texts)


def test_long_texts_and_many_batches(spark, monkeypatch):
    r = random.Random(9)
    base = "".join(r.choice("abcdef ghij") for _ in range(30_000))
    texts = [(7, base), (3, base[10_000:20_000] + "!" + base[:5_000]), (9, base[::-1]), (1, base[500:560]), (2, base[500:549])]
    got = suffix.dedup(docs(spark, texts)).collect()
    assert sorted(tuple(x) for x in got) == brute(texts)
    assert suffix.dedup(docs(spark, [])).count() == 0


def test_intervals_share_exactly_the_minimum_length():
    r = random.Random(4)
    bodies = sorted({"".join(r.choice("ab") for _ in range(r.randint(50, 90))).encode() for _ in range(30)} | {b"a" * 60, b"a" * 75, b"\0" * 55 + b"b"})
    interval, rank = suffix.together(bodies)
    at, seen = 0, {}
    for b in bodies:
        for i in range(len(b) - 49):
            seen.setdefault(b[i : i + 50], set()).add(int(interval[rank[at + i]]))
        at += len(b) + 1
    assert all(len(x) == 1 for x in seen.values())
    assert len({next(iter(x)) for x in seen.values()}) == len(seen)
