import math
import random
import re

import numpy as np

from tests.llm.util import docs
from tidemark.llm import quality, topk, words

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    w = WORD.findall(text or "")
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    covered = set()
    for i, g in enumerate(grams):
        if grams.count(g) > 1:
            covered |= set(range(i, i + 5))
    lines, seen, dup = (text or "").split("\n"), set(), 0
    for x in lines:
        if WORD.search(x):
            dup += x in seen
            seen.add(x)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(covered)


R = random.Random(3)
TEXTS = [None, "", "\n \n", "a b", "For " * 60, "a b c d e f a b c d e", "a\nb\na\n \n \nb ", "é# ü$ 　x y 日本 **", "l1 x\r\nl1 x\r\nl2\x1cz"] + [
    "\n".join(" ".join(R.choice("ab cd é# $ ef gh %".split()) for _ in range(R.randint(0, 12))) for _ in range(R.randint(1, 12))) for _ in range(120)
]


def test_counts_match_brute_force(spark):
    rows = {r.doc_id: r for r in quality.judge(docs(spark, TEXTS), spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect()}
    assert len(rows) == len(TEXTS)
    for i, t in enumerate(TEXTS):
        r, want = rows[i], base(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, (i, t)
        assert r.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0]) and r.kept == (not r.base_failed)


def test_cutoffs_limit_false_rejection(spark):
    r = random.Random(4)
    texts, labels = [], []
    for i in range(1600):
        good = r.random() < 0.6
        vocab = [f"w{j}" + ("" if good or r.random() < 0.5 else "###") for j in range(400)]
        texts.append(" ".join(r.choice(vocab) for _ in range(60)))
        labels.append((i, int(good), 0))
    rows = quality.judge(docs(spark, texts), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    good = {i for i, q, _ in labels if q}
    assert sum(not x.kept for x in rows if x.doc_id in good) <= 0.03 * len(good)
    assert sum(not x.kept for x in rows if x.doc_id not in good) >= 0.9 * (1600 - len(good))


def test_tail_is_the_binomial_distribution():
    for k, n, p in [(0, 10, 0.1), (3, 20, 0.05), (7, 500, 0.0125), (5, 5, 0.3)]:
        assert abs(quality.tail(k, n, p) - sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))) < 1e-9


def test_empty(spark):
    labels = spark.createDataFrame([(1, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    assert quality.judge(docs(spark, []), labels).count() == 0


def test_word_hashes_are_by_content():
    raws = [b"ab cd ab", b"", b"cd\tab\n\nabcd"]
    h, owner, _ = words.words(raws)
    assert owner.tolist() == [0, 0, 0, 2, 2, 2]
    assert h[0] == h[2] == h[4] and h[1] == h[3] and len(set(h.tolist())) == 3


def brute(vectors, k):
    ok = [(i, np.floor(64 * np.array(v, dtype=float)).astype(int)) for i, v in vectors if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for i, q in ok:
        if i % 20 == 0:
            found = sorted((-int(q @ c), j) for j, c in ok if j != i)[:k]
            out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(found)]
    return sorted(out)


def test_search_matches_brute_force(spark, monkeypatch):
    g = np.random.default_rng(1)
    vectors = [(i, [float(x) for x in np.float32(g.normal(0, 0.2, 16))]) for i in range(1500)]
    vectors += [(1500 + i, vectors[7][1]) for i in range(60)]  # ties
    vectors += [(2000, None), (2020, [1.0] * 15 + [None]), (2040, [float("nan")] * 16), (2060, [float("inf")] * 16), (2080, [0.0] * 16)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>").repartition(4)
    for blocks in (32, 2):
        monkeypatch.setattr(topk, "LEAST_BLOCKS", blocks)
        got = topk.search(df).collect()
        assert sorted(tuple(r) for r in got) == brute(vectors, 20)
    few = spark.createDataFrame(vectors[:5], "vec_id long, embedding array<float>")
    assert sorted(tuple(r) for r in topk.search(few).collect()) == brute(vectors[:5], 20)
    assert topk.search(df.limit(0)).count() == 0


def test_reading_stops_when_outsiders_cannot_qualify():
    g = np.random.default_rng(5)
    cand = np.floor(g.pareto(1.2, (3000, 6)) * 20)  # few large values: the heads of the lists decide
    queries = np.abs(np.floor(g.normal(0, 20, (8, 6))))
    found, shares = topk.Lists(cand).best(queries, np.zeros((8, 3000), bool), 5)
    assert len(shares) < len(topk.ROUNDS) and shares[0] < 0.2 and shares == sorted(shares, reverse=True)
    for q, (held, scores) in zip(queries, found):
        assert len(held) <= 5 and sorted(scores) == sorted(cand @ q)[-len(held) :]


def test_bounds_hold_every_score_at_any_depth():
    g = np.random.default_rng(6)
    cand, queries = np.floor(g.normal(0, 30, (200, 9))), np.floor(g.normal(0, 30, (5, 9)))
    lists = topk.Lists(cand)
    for depth in (1, 17, 100, 150, 200):
        low, high = lists.bounds(np.arange(200), queries, depth)
        assert (low <= queries @ cand.T).all() and (queries @ cand.T <= high).all()
    assert (low == high).all()


def test_repeated_ids_and_extra_columns(spark):
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (20, [0.5, 0.5]), (3, [1.0, 1.0]), (3, [1.0, 1.0]), (None, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 as rank", "'x' as score")
    got = [tuple(r) for r in topk.search(df).orderBy("query_id", "rank").collect()]
    assert [g[:3] for g in got] == [(0, 1, 3), (0, 2, 3), (0, 3, 20), (20, 1, 3), (20, 2, 3), (20, 3, 0), (20, 4, 0)]


def test_bounds_of_a_block_are_made_once_and_useless_rounds_are_left_out(monkeypatch):
    g = np.random.default_rng(5)
    cand, ids = np.floor(64 * g.normal(size=(600, 16))), np.arange(600)
    made, looked = [], []
    init, bounds = topk.Lists.__init__, topk.Lists.bounds
    monkeypatch.setattr(topk.Lists, "__init__", lambda self, c: (init(self, c), made.append(self))[0])
    monkeypatch.setattr(topk.Lists, "bounds", lambda self, rows, q, depth: (looked.append(depth), bounds(self, rows, q, depth))[1])
    got = topk.best(cand, ids, cand[:256], ids[:256], 5)
    assert got == [(q, i, s) for q in range(256) for s, i in sorted(((int(cand[q] @ cand[i]), i) for i in range(600) if i != q), key=lambda x: (-x[0], x[1]))[:5]]
    assert len(made) == 1 and len(made[0].tables) < len(topk.ROUNDS) and len(looked) < 4 * len(topk.ROUNDS)
