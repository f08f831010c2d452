import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tests.llm.util import docs
from tidemark.llm import variants

RUN = re.compile("[A-Za-zÀ-ÿ]+")


def near(a, b):
    """One code point inserted, deleted or replaced, by trying each place."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(texts):
    n = Counter()
    for k, t in texts:
        for run in RUN.findall(t or ""):
            w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if k is None else k}:{w}".encode())
            n[w[: h % len(w)] + w[h % len(w) + 1 :] if h % 199 == 0 else w] += 1
    n = {w: c for w, c in n.items() if len(w) >= 6 and c >= 5}
    by = {w: sorted((x for x in n if near(w, x)), key=lambda x: (-n[x], x)) for w in n}
    form = {w: by[w][0] if by[w] and n[by[w][0]] >= 5 * n[w] else None for w in n}

    def root(w):
        return w if form[w] is None else root(form[w])

    return sorted((w, form[w] or "", root(w), n[w], len(by[w]), n[form[w]] if form[w] else -1) for w in n)


def corpus(seed):
    r = random.Random(seed)
    base = ["".join(r.choice("abcdeéÀÿ÷") for _ in range(r.randint(5, 9))) for _ in range(40)] + ["aaaaaaa", "aaaaaab", "abababab", "babababa", "x" * 3000, "x" * 3001]
    weights = [6 ** r.uniform(0, 4) for _ in base]
    texts = [None, "", " ", "12 34", "Ünïcode日本WORD"]
    for _ in range(300):
        out = []
        for w in r.choices(base, weights, k=60):
            for _ in range(r.choice([0, 0, 0, 1, 1, 2])):
                at = r.randrange(len(w))
                w = r.choice([w[:at] + w[at + 1 :], w[:at] + r.choice("abcé") + w[at:], w[:at] + r.choice("abcé") + w[at + 1 :]])
            out.append(w.capitalize() if r.random() < 0.2 else w)
        texts.append(r.choice([" ", "-", "_\n", "日"]).join(out))
    texts += ["karlaaa " * 900, "karlaab " * 150, "Karlabb " * 20]
    return list(enumerate(texts)) + [(7, texts[7]), (7, texts[7]), (None, texts[9])]


@pytest.mark.parametrize("seed", [1, 2])
def test_forms_match_brute_force(spark, seed):
    texts = corpus(seed)
    want = brute(texts)
    got = sorted((x.word, x.form or "", x.root, x.n, x.n_near, -1 if x.form_n is None else x.form_n) for x in variants.group(docs(spark, texts)).collect())
    assert got == want
    assert sum(x[1] != "" for x in want) > 20 and any(root not in (w, form) for w, form, root, *_ in want)


def test_one_apart_matches_trying_each_place():
    r = random.Random(2)
    words = ["".join(r.choice("ab") for _ in range(r.randint(0, 5))) for _ in range(60)]
    assert all(variants.one_apart(a, b) == near(a, b) for a in words for b in words)


def test_keys_are_shared_once_by_near_words():
    r = random.Random(5)
    words = ["".join(r.choice("ab") for _ in range(r.randint(1, 7))) for _ in range(120)] + ["é" * 6, "éa" * 4]
    keys = [set(k.tolist()) for k in variants.deletion_keys(words)]
    for w, k, made in zip(words, keys, variants.deletion_keys(words)):
        assert len(k) == len(made) == 1 + len({w[:i] + w[i + 1 :] for i in range(len(w))})
    for i, a in enumerate(words):
        for j, b in enumerate(words):
            if near(a, b):
                assert len(keys[i] & keys[j]) == 1


def test_chains_of_forms(spark):
    forms = spark.createDataFrame([(f"w{i:03}", f"w{i + 1:03}") for i in range(50)] + [("x", "w049")], "word string, form string")
    assert {r.root for r in variants.roots(forms).collect()} == {"w050"}


def test_empty_and_very_long_words(spark):
    assert variants.group(docs(spark, [])).count() == 0
    r = np.random.default_rng(1)
    long = "".join(map(chr, r.integers(97, 123, 20_000)))
    texts = [long] * 9 + [long[:100] + long[101:]] + [" ".join([long[:-1]] * 5)]
    got = {len(x.word): x for x in variants.group(docs(spark, [(i * 7, t) for i, t in enumerate(texts)])).collect()}
    want = {len(x[0]): x for x in brute([(i * 7, t) for i, t in enumerate(texts)])}
    assert {k: (x.n, x.n_near) for k, x in got.items()} == {k: (x[3], x[4]) for k, x in want.items()}
