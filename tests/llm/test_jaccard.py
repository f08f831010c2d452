import random
import re

import numpy as np
import pandas as pd
import pytest

from tests.llm.util import docs
from tidemark.llm import jaccard
from tidemark.operators import graph

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def fold(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def brute(texts):
    sets = []
    for _, t in texts:
        w = WORD.findall(fold(t or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    parent = list(range(len(sets)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                parent[max(root(i), root(j))] = min(root(i), root(j))
    small = {}
    for i, (k, _) in enumerate(texts):
        small[root(i)] = min(small.get(root(i), k), k)
    return sorted((k, len(sets[i]), small[root(i)]) for i, (k, _) in enumerate(texts))


def corpus(seed, n=260):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)]
    passage = " ".join(r.choice(vocab) for _ in range(40))
    base = [" ".join(r.choice(vocab) for _ in range(r.randint(3, 60))) for _ in range(25)]
    texts = ["", None, " \n", "one two", "ONE\tTwo", "one two three four five", "one two three four five six"]
    for _ in range(n):
        w = r.choice(base).split() if r.random() < 0.8 else [r.choice(vocab) for _ in range(r.randint(1, 80))]
        for _ in range(r.choice([0, 0, 1, 1, 2, 3])):
            w[r.randrange(len(w))] = r.choice(vocab)
        if r.random() < 0.3:
            w = (passage.split() + w) if r.random() < 0.5 else (w + passage.split())
        if r.random() < 0.2:
            w = w[: max(1, int(len(w) * r.uniform(0.7, 1)))]
        texts.append(r.choice([" ", "\n", "  "]).join(w))
    ids = r.sample(range(10_000), len(texts))
    out = list(zip(ids, texts))
    return out + [out[10]] + [(9_999_000 + i, out[20][1]) for i in range(30)]


@pytest.mark.parametrize(("seed", "family", "pivots", "inner", "hot"), [(1, 1024, 16, 8, 10_000), (2, 8, 2, 1, 20), (3, 4, 1, 2, 1), (4, 16, 3, 8, 100)])
def test_components_match_brute_force(spark, monkeypatch, seed, family, pivots, inner, hot):
    monkeypatch.setattr(jaccard, "FAMILY", family)
    monkeypatch.setattr(jaccard, "PIVOTS", pivots)
    monkeypatch.setattr(jaccard, "INNER", inner)
    monkeypatch.setattr(jaccard, "HOT", hot)
    texts = corpus(seed)
    got = jaccard.join(docs(spark, texts).withColumnRenamed("source", "component_id")).collect()
    assert sorted(tuple(r) for r in got) == brute(texts)


def test_links_between_regions(spark, monkeypatch):
    """Two linked hubs, each with copies that link to their own hub only: pivots are copies of both."""
    monkeypatch.setattr(jaccard, "FAMILY", 128)
    r = random.Random(3)
    hub = [f"h{i}" for i in range(104)]
    other = [*hub[:20], "x", *hub[21:60], "y", *hub[61:]]

    def copy(of, k):
        i, j = r.sample([i for i in range(5, 99, 5) if i not in (20, 60)], 2)
        return [f"{k}_{at}" if at in (i, j) else w for at, w in enumerate(of)]

    words = [hub, other] + [copy(hub, f"a{k}") for k in range(100)] + [copy(other, f"b{k}") for k in range(100)]
    texts = [(i, " ".join(w)) for i, w in enumerate(words)]
    want = brute(texts)
    assert {root for *_, root in want} == {0}
    assert sorted(tuple(r) for r in jaccard.join(docs(spark, texts)).collect()) == want


def test_empty_and_long(spark):
    assert jaccard.join(docs(spark, [])).count() == 0
    long = " ".join(f"x{i}" for i in range(60_000))
    texts = [(5, long), (3, long + " end"), (9, "y " + long[: len(long) // 2]), (2, "For " * 5000), (7, "for " * 9)]
    assert sorted(tuple(r) for r in jaccard.join(docs(spark, texts)).collect()) == brute(texts)


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 60)] + [(100, 101), (102, 101), (7, 7)], "a long, b long")
    got = {r.node: r.root for r in jaccard.components(edges).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 101: 100, 102: 100}


@pytest.mark.parametrize("inner", [1, 2, 8])
def test_a_family_in_one_task_by_regions(monkeypatch, inner):
    monkeypatch.setattr(jaccard, "INNER", inner)
    r = random.Random(inner)
    base = [[r.randrange(10**6) for _ in range(60)] for _ in range(6)]
    sets = []
    for _ in range(150):
        s = set(r.choice(base))
        for x in r.sample(sorted(s), r.randint(0, 12)):
            s.discard(x)
        sets.append(s | {r.randrange(10**6) for _ in range(r.randint(0, 6))})
    rows = pd.DataFrame({"owner": range(150), "n": [len(s) for s in sets], "keys": [np.array(sorted(x for x in s if sum(x in o for o in sets) > 1), np.int64) for s in sets]})
    label = list(range(150))
    for a, b in jaccard.linked_in(rows):
        assert 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])
        label = [label[a] if x == label[b] else x for x in label]
    for i in range(150):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                assert label[i] == label[j]


@pytest.mark.parametrize("percent", [75, 80])
def test_large_families_are_split_before_sets_meet(spark, monkeypatch, percent):
    monkeypatch.setattr(jaccard, "FAMILY", 64)
    monkeypatch.setattr(jaccard, "_voronoi", lambda *_: pytest.fail("sets that only a few shingles join went on to pivots"))
    r = np.random.default_rng(5)
    sets = []
    for i in range(200):  # families of 3 by what they share; all share ten shingles, and some one that others hold too
        own = r.integers(0, 2**62, 90)
        for changed in (0, 8, 30):
            keys = own.copy()
            keys[:changed] = r.integers(0, 2**62, changed)
            sets.append(np.unique(np.concatenate([keys, np.arange(10), [100 + i % 50]])))
    rows = [(int(o), 1, len(k), k.tolist()) for o, k in zip(r.permutation(10_000), sets)]
    found = jaccard.linked(spark.createDataFrame(rows, "owner long, family long, n long, keys array<long>"), percent).collect()
    links = [(a[0], b[0]) for i, a in enumerate(rows) for b in rows[i + 1 :] if 100 * len(x := set(a[3]) & set(b[3])) >= percent * (a[2] + b[2] - len(x))]
    assert links and {frozenset(x) for x in map(tuple, found)} <= {frozenset(x) for x in links}

    def roots(pairs):
        pairs = [p for p in map(tuple, pairs)]
        return {int(n): int(q) for n, q in zip(*graph.united(*(np.array(x) for x in zip(*pairs))))}

    assert roots(found) == roots(links)
