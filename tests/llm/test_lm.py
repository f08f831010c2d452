import math
import random
import tracemalloc
from collections import Counter

import numpy as np
import pandas as pd
import pytest

from tests.llm.util import docs
from tidemark.llm import lm
from tidemark.llm import words as W


def split(text):
    return [w.lower() for w in (text or "").split()]


def brute(texts, model):
    """Each text's log-probability, windows counted by the words themselves."""
    vocabulary, params, _, _ = model
    sides = lambda w, i: tuple(w[j] if 0 <= j < len(w) else None for j in (i - 2, i - 1, i + 1, i + 2))
    every = [split(t) for t in texts]
    around = Counter(sides(w, i) for w in every for i in range(len(w)))
    full = Counter((sides(w, i), w[i]) for w in every for i in range(len(w)))
    out = []
    for w in every:
        total = 0.0
        if w:
            entry = vocabulary.entries(W.words([" ".join(w).encode()])[0])
            padded = [lm.END, lm.END, *entry.tolist(), lm.END, lm.END]
            for i in range(len(w)):
                h = np.tanh(sum(params[0][k][padded[i + 2 + d]] for k, d in enumerate((-2, -1, 1, 2))))
                c, o = divmod(int(entry[i]), lm.WORDS)
                logs = lambda x: x - np.log(np.exp(x).sum())
                p = logs(h @ params[1] + params[3])[c] + logs(h @ params[2][c] + params[4][c])[o] + vocabulary.share[entry[i]]
                n4, n5 = around[sides(w, i)] - 1, full[sides(w, i), w[i]] - 1
                total += math.log((n5 + lm.STRENGTH * math.exp(p)) / (n4 + lm.STRENGTH))
        out.append(total)
    return out


def chain(r, n):
    return " ".join(w for _ in range(n) for w in (lambda k: (f"a{k}", f"b{k}", f"c{k}"))(r.randrange(8)))


@pytest.mark.parametrize("least", [lm.COMMON, 2])  # with 2, windows go by the table of common ones
def test_scores_are_sums_of_conditional_log_probabilities(spark, monkeypatch, least):
    monkeypatch.setattr(lm, "COMMON", least)
    r = random.Random(1)
    good = [chain(r, 20) for _ in range(60)]
    texts = [None, "", " \n", "one", *good, *[" ".join(r.sample(x.split(), 60)) for x in good[:20]], good[0], "A0 " * 3000]
    df = docs(spark, texts).withColumnRenamed("lang", "key")
    model = lm.learn(df)
    rows = {x.doc_id: x for x in lm.score(df, model).collect()}
    assert len(rows) == len(texts)
    for i, (t, want) in enumerate(zip(texts, brute(texts, model), strict=True)):
        assert rows[i].n_tokens == len(split(t))
        assert math.isclose(rows[i].log_prob, want, rel_tol=2e-3, abs_tol=2e-2)
        assert (rows[i].mean_log_prob is None) == (not split(t))
    assert math.isclose(rows[4].log_prob, rows[84].log_prob, rel_tol=1e-6)


def test_repeated_documents_and_order_are_told_by_the_score(spark):
    r = random.Random(2)
    words = [f"w{i}" for i in range(4000)]
    fresh = [" ".join(r.choice(words) for _ in range(80)) for _ in range(80)]
    texts = fresh + fresh[:20] + [chain(r, 30) for _ in range(200)]
    rows = {x.doc_id: x.mean_log_prob for x in lm.score(docs(spark, texts)).collect()}
    assert min(rows[i] for i in [*range(20), *range(80, 100)]) > max(rows[i] for i in range(20, 80))


def test_repeated_rows_empty_table_and_odd_ids(spark):
    df = docs(spark, [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (None, None)])
    rows = lm.score(df).collect()
    assert len(rows) == 4 and len({round(x.log_prob, 6) for x in rows if x.n_tokens}) == 1
    assert lm.score(docs(spark, [])).count() == 0


def test_training_learns_and_probabilities_are_normalised():
    g = np.random.default_rng(3)
    left = g.integers(0, 50, 20_000)
    near = np.stack([left, (left * 7 + 1) % 50, (left * 3 + 2) % 50, left])
    target = (left * 11 + 5) % 50 * 80 % lm.SIZE
    trainer = lm.Trainer(lm.start(np.bincount(target, minlength=lm.SIZE).astype(float)))
    losses = [trainer.step(near, target) for _ in range(60)]
    assert losses[-1] < losses[0] / 4
    every = np.arange(lm.SIZE)
    logs = lm.forward(trainer.p, np.repeat(near[:, :1], lm.SIZE, axis=1), every)
    assert abs(np.exp(logs.astype(float)).sum() - 1) < 1e-3


def test_gradients_match_differences():
    g = np.random.default_rng(4)
    near, target = g.integers(0, 300, (4, 40)), g.integers(0, 300, 40)
    p = [x.astype(np.float64) for x in lm.start(np.ones(lm.SIZE))]
    grads = [np.zeros_like(x) for x in p]
    lm.forward(p, near, target, grads)
    for k, at in ((0, (1, int(near[1, 0]), 3)), (1, (2, 1)), (2, (int(target[0]) // lm.WORDS, 5, 7)), (3, (1,)), (4, (2, 3))):
        p[k][at] += 1e-2
        up = -lm.forward(p, near, target).mean(dtype=np.float64)
        p[k][at] -= 2e-2
        down = -lm.forward(p, near, target).mean(dtype=np.float64)
        p[k][at] += 1e-2
        assert abs((up - down) / 2e-2 - grads[k][at]) < 2e-4


def test_words_of_a_task_leave_once_and_hashing_holds_few_copies(monkeypatch):
    monkeypatch.setattr(lm, "BATCH", 300)
    r = random.Random(5)
    texts = [" ".join(r.choice("ab cde F ghij").lower() + "x" for _ in range(40)) for _ in range(50)]
    rows = pd.concat(lm.counted(iter([pd.DataFrame({"text": texts}), pd.DataFrame({"text": [None, *texts[:9]]})])))
    found = rows[rows["kind"] == 0]
    every = Counter(w for t in texts + texts[:9] for w in split(t))
    assert found["name"].is_unique and sorted(found["n"]) == sorted(every.values())
    raws = [" ".join(r.choice(["ab", "cde", "fghij", "klmnopq"]) for _ in range(2000)).encode() for _ in range(100)]
    W.words(raws, fold=True)  # makes the powers
    tracemalloc.start()
    W.words(raws, fold=True)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 24 * sum(map(len, raws))


def test_a_word_has_one_hash_wherever_it_stands():
    r = random.Random(6)
    word = "".join(r.choice("abcXYZ\u00e9") for _ in range(3 * W.BLOCK))
    for before in (0, 1, W.BLOCK - 2, W.BLOCK, 2 * W.BLOCK + 7):
        hashes, owner, _ = W.words([b"y" * before + b"\t" + word.encode() + b" q", b"", word.lower().encode()], fold=True)
        at = int(before > 0)
        assert hashes[at] == hashes[-1] and owner.tolist() == [0] * (at + 2) + [2]


def test_names_are_found_as_by_search():
    g = np.random.default_rng(7)
    for size in (0, 1, 5, 3000, 60_000):
        top = np.unique(np.append(g.integers(0, 1 << 62, size, dtype=np.uint64) << np.uint64(2), g.integers(0, 9, size, dtype=np.uint64)))
        if size:
            top = np.append(top, ~np.uint64(0))
        names = np.concatenate([top, top + np.uint64(1), g.integers(0, 1 << 62, 1000, dtype=np.uint64)])
        where = {x: i for i, x in enumerate(top.tolist())}
        which, at = lm._found(top, names)
        assert dict(zip(which.tolist(), at.tolist(), strict=True)) == {i: where[x] for i, x in enumerate(names.tolist()) if x in where}
        vocabulary = lm.Vocabulary(g.permutation(top)[:3000], np.zeros(lm.SIZE, np.float32))
        own = {x: i for i, x in zip(vocabulary.order.tolist(), vocabulary.sorted.tolist(), strict=True) if i >= 0}
        hashed = lambda x: lm.SIZE - lm.HASHED + (x >> 40) % (lm.HASHED - 1)
        assert vocabulary.entries(names).tolist() == [own.get(x, hashed(x)) for x in names.tolist()]


def test_steps_too_far_do_not_overflow():
    g = np.random.default_rng(8)
    near, target = g.integers(0, 300, (4, 500)), g.integers(0, lm.SIZE, 500)
    p = [x * 400 for x in lm.start(np.ones(lm.SIZE))]
    grads = [np.zeros_like(x) for x in p]
    h = np.tanh(sum(p[0][k][near[k]] for k in range(4)))
    logs = lambda x: x - np.log(np.exp(x).sum(axis=-1, keepdims=True))
    clipped = lambda x: np.clip(x.astype(float), -60, 60)
    row, (c, o) = np.arange(500), divmod(target, lm.WORDS)
    want = logs(clipped(h @ p[1] + p[3]))[row, c] + logs(clipped(np.einsum("nh,nhw->nw", h, p[2][c]) + p[4][c]))[row, o]
    assert np.allclose(lm.forward(p, near, target, grads), want, rtol=1e-4, atol=1e-3)
    assert all(np.isfinite(x).all() for x in grads)
