import random
import zlib
from collections import Counter, defaultdict

from tests.llm.util import docs
from tidemark.llm import language, mixing, sharding


def water(sizes, weights, share=1.5, ceiling=2.0):
    """Targets by resharing the excess until none is above its ceiling."""
    full, total = set(), share * sum(sizes)
    while True:
        rest = total - sum(ceiling * sizes[i] for i in full)
        w = sum(weights[i] for i in range(len(sizes)) if i not in full)
        goal = [ceiling * s if i in full else rest * weights[i] / w for i, s in enumerate(sizes)]
        over = {i for i in range(len(sizes)) if i not in full and goal[i] > ceiling * sizes[i]}
        if not over:
            return goal
        full |= over


def test_mix_meets_targets(spark):
    r = random.Random(1)
    sources = [r.choice(["a", "b", "c", "d", "é", None]) if r.random() < 0.7 else "a" for _ in range(400)]
    texts = [" ".join(["w"] * r.randint(0, 40)) if r.random() < 0.97 else None for _ in range(400)]
    df = docs(spark, texts, sources=sources)
    rows = mixing.mix(df).collect()
    again = {x.doc_id: x.taken for x in mixing.mix(df.repartition(7)).collect()}
    names = sorted({s for s in sources if s is not None}) + [None]
    size = {s: sum(len((t or "").split()) for t, u in zip(texts, sources) if u == s) for s in names}
    goal = dict(zip(names, water([size[s] for s in names], [(5, 2, 1)[i % 3] for i in range(len(names))])))
    took = Counter()
    for x in rows:
        assert x.size == len((texts[x.doc_id] or "").split()) and x.source_size == size[x.source]
        assert abs(x.target - goal[x.source]) < 1e-6 and 0 <= x.taken <= 2 * x.size
        assert again[x.doc_id] == x.taken
        took[x.source] += x.taken
    assert len(rows) == 400
    assert all(abs(took[s] - goal[s]) <= 0.5 for s in names)


def test_mix_edge_tables(spark):
    assert mixing.mix(docs(spark, [])).count() == 0
    assert [x.taken for x in mixing.mix(docs(spark, [None, " ", ""])).collect()] == [0, 0, 0]
    out = mixing.repeat(docs(spark, ["a b c d", "e f"], sources=["x", "x"])).collect()
    assert sum(len(x.text.split()) for x in out) == 9


def test_shard_law(spark):
    texts = [None, "", "é"] + ["same text"] * 500 + [f"t{i}" for i in range(1500)]
    rows = sharding.shard(docs(spark, texts)).collect()
    slots = defaultdict(list)
    for x in rows:
        raw = (texts[x.doc_id] or "").encode()
        assert x.size == len(raw) + 1 and x.text_crc32 == zlib.crc32(raw) and x.law == "key"
        assert x.grown_shard in (x.shard, 8)
        slots[x.shard].append(x.slot)
    assert set(slots) == set(range(8))
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert all(150 < len(v) < 350 for v in slots.values())
    assert 120 < sum(x.grown_shard == 8 for x in rows) < 330
    assert sharding.shard(docs(spark, [])).count() == 0


def test_weight_changes_move_rows_within_subtrees_only(spark):
    from pyspark.sql import functions as F

    old = sharding.tree(8)
    new = [(a, b, s, 3.0 if s == 5 else w) for a, b, s, w in old]
    df = spark.range(4000).select(sharding.place(F.col("id").cast("string"), old).alias("a"), sharding.place(F.col("id").cast("string"), new).alias("b")).collect()
    for x in df:
        if x.a // 4 == 0:
            assert x.b == x.a or x.b // 4 == 1  # from the other region only into the heavier one
        else:
            assert x.b // 4 == 1
        if x.a // 2 == 2:
            assert x.b // 2 == 2  # the heavier rack keeps its rows
    share = Counter(x.b for x in df)
    assert abs(share[5] / 4000 - 3 / 10) < 0.04


def test_language_held_out_accuracy(spark):
    r = random.Random(2)
    parts = {"en": "the and ing tion er at th on re st", "fr": "é è eau ou tion la que ment ai le", "de": "ü sch ein ung der ich keit und ge pf", "es": "ción os la ñ que ado ía de mi ga"}
    texts, langs = [], []
    for i in range(400):
        k = r.choice(sorted(parts))
        texts.append(" ".join("".join(r.choice(parts[k].split()) for _ in range(r.randint(1, 3))) for _ in range(r.randint(20, 80))))
        langs.append(k)
    texts += [None, "", "123 --- 456", "Привет", "x " * 40000]
    langs += ["en", "en", "fr", None, None]
    rows = {x.doc_id: x for x in language.identify(docs(spark, texts, langs=langs)).collect()}
    assert len(rows) == len(texts)
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(rows[i].held_out == (i in held) for i in range(400))
    assert sum(rows[i].lang_pred == langs[i] for i in held) >= 0.97 * len(held)
    assert [rows[i].lang_pred for i in (400, 401, 402)] == ["und"] * 3 and rows[400].score == 0
    assert rows[403].lang_pred in parts and rows[404].lang_pred in parts
    assert all(0 <= x.score <= 1 for x in rows.values())


def test_language_without_labels(spark):
    assert {x.lang_pred for x in language.identify(docs(spark, ["abc", "def"], langs=[None, None])).collect()} == {"und"}
    assert language.identify(docs(spark, [])).count() == 0


def test_phrases_are_longest_matches():
    p = language.Parser({"aa": "banana band", "bb": "cabcab"})
    text, count, rest = "bananabandana", 0, "bananabandana"
    while rest:
        n = next((n for n in range(len(rest), 0, -1) if rest[:n] in "banana band"), 1)
        rest, count = rest[n:], count + 1
    bits, has = p.bits_of([text])
    assert has[0] and abs(bits[0][0] - count * p.bits[0] / len(text)) < 1e-9
