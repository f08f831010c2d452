import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from tests.llm.util import docs
from tidemark.llm import fim

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def plain(doc_id, text):
    """The contract, by slices of a list of units."""
    text = text or ""
    units = UNIT.findall(text)
    digest = hashlib.sha256(f"42:{doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[i : i + 8], 16) for i in (0, 8, 16, 24))
    n = len(units)
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h4 % 100 < 80:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def corpus(r):
    texts = [None, "", " ", "\n\t ", "one", " one ", "a<P>b", "<S>", "x <M", "end <", "<S", "zwei  wörter", "日本 語 x y", "w" * 5000, " " * 700, "a " * 3000, "é" * 300 + "\r\n"]
    for _ in range(150):
        words = ["".join(r.choice("abé<>PSM日") for _ in range(r.randint(1, 6))) for _ in range(r.randint(1, 900))]
        texts.append("".join(r.choice(["", " ", "\n\n", "  "]) + w for w in words) + r.choice(["", " ", "\n"]))
    return texts


def test_cuts_and_returns_match_slices(spark, monkeypatch):
    texts = corpus(random.Random(1))
    rows = list(enumerate(texts)) + [(3, "again the same id"), (9, texts[30]), (9, texts[30])]
    df = docs(spark, rows)
    out = fim.transform(df.withColumn("n", F.lit("own")).withColumn("fim", F.lit("gone")))
    assert out.columns == [*df.columns, "n", "fim"]
    got = sorted((x.doc_id, *x.fim) for x in out.collect())
    assert got == sorted((i, *plain(i, t)) for i, t in rows)
    assert {x[2] for x in got} == {"plain", "spm", "psm"}
    sha = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    want = sorted((i, *plain(i, t)[:4], sha(plain(i, t)[4]), sha(t)) for i, t in rows)
    assert sorted(tuple(x) for x in fim.digest(df).collect()) == want


def test_no_rows_and_no_ids(spark):
    assert fim.digest(docs(spark, [])).count() == 0
    out = fim.digest(docs(spark, [(None, "a b c"), (None, None)])).collect()
    assert sorted(x.n for x in out) == [0, 3]


@pytest.mark.parametrize("seed", range(6))
def test_rope_splits_and_joins(seed):
    r = random.Random(seed)
    text = r.choice(corpus(r)[17:]) * r.choice([1, 3])
    units = UNIT.findall(text)
    tree = fim.rope(text)
    assert (tree.units, tree.points, fim.flat(tree)) == (len(units), len(text), text)
    for _ in range(30):
        k = r.randint(-1, len(units) + 1)
        a, b = fim.split(tree, k)
        assert fim.flat(a) == "".join(units[: max(k, 0)]) and fim.flat(a, b) == text
        assert a.units + b.units == len(units) and a.points + b.points == len(text)
        c, d = fim.split(tree, r.randint(0, len(text)), "points")
        assert fim.flat(c) == text[: c.points] and fim.flat(d) == text[c.points :]
        tree = fim.joined(c, d) if r.random() < 0.3 and not text[: c.points].strip() else tree


def test_rope_stays_balanced():
    tree = fim.rope("word " * 200_000)
    for k in range(40):
        a, b = fim.split(tree, (k * 4999) % tree.units)
        tree = fim.joined(b, a)

    def check(t):
        if t.left is None:
            return 0
        x, y = check(t.left), check(t.right)
        assert abs(x - y) <= 2 and t.height == 1 + max(x, y)
        return t.height

    assert check(tree) < 20 and tree.points == 1_000_000
