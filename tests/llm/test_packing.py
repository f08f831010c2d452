import random
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from tests.llm.util import docs
from tidemark.llm import packing
from tidemark.llm.queries import tokenizer_path


def direct_ids(texts):
    from tokenizers import Tokenizer

    return [c.ids + [1] for c in Tokenizer.from_file(tokenizer_path()).encode_batch([t or "" for t in texts], add_special_tokens=False)]


TEXTS = ["The cat sat.", None, "", "  \n\t ", "It's 2024, isn't it?\x1cX\xa0Y", "naïve café é ́x İSTANBUL ΣΑΣ", "<|endoftext|> a <|startoftext|>b", "word " * 9000, "x" * 5000, "日本語 テキスト", "ÉÀß ÇA, là-bas: Größe; ÿ×÷ ªº µ don't I'll x'Y end... !? a.b a.,b", "The cat sat."]


def test_ids_by_word_equal_ids_of_whole_texts():
    coder = packing.WordIds(tokenizer_path())
    for got, want in zip(coder.packed(TEXTS), direct_ids(TEXTS), strict=True):
        assert np.frombuffer(got, "<u4").tolist() == want


def test_random_words_have_the_same_ids():
    r = random.Random(7)
    signs = "abcXYZéÈßñçÿ.,;:!?'0129-_/É"
    texts = [" ".join("".join(r.choice(signs) for _ in range(r.randint(1, 9))) for _ in range(50)) for _ in range(200)]
    coder = packing.WordIds(tokenizer_path())
    for got, want in zip(coder.packed(texts), direct_ids(texts), strict=True):
        assert np.frombuffer(got, "<u4").tolist() == want


def test_pack_is_a_packing(spark):
    rows = packing.pack(docs(spark, TEXTS), tokenizer_path()).collect()
    want = direct_ids(TEXTS)
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append((r.offset, r.length))
    assert set(by_doc) == set(range(len(TEXTS)))
    for i, ids in enumerate(want):
        got = sorted(by_doc[i], key=lambda r: r.piece)
        assert [r.piece for r in got] == list(range(-(-len(ids) // 4096)))
        for r in got:
            part = ids[r.start : r.start + r.length]
            assert r.length == len(part) and r.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes())
    for places in by_seq.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(by_seq) == packing.lower_bound(Counter(r.length for r in rows), 4096)


def optimum(sizes, capacity):
    best = [len(sizes)]

    def go(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(sizes):
            best[0] = len(bins)
            return
        for j in range(len(bins)):
            if bins[j] + sizes[i] <= capacity and bins[j] not in bins[:j]:
                bins[j] += sizes[i]
                go(i + 1, bins)
                bins[j] -= sizes[i]
        go(i + 1, [*bins, sizes[i]])

    go(0, [])
    return best[0]


@pytest.mark.parametrize("seed", range(40))
def test_plan_matches_exhaustive_search(seed):
    r = random.Random(seed)
    sizes = sorted((r.randint(1, 60) for _ in range(r.randint(1, 11))), reverse=True)
    bins = packing.plan(dict(Counter(sizes)), 100)
    assert Counter(s for lengths, n in bins for s in lengths for _ in range(n)) == Counter(sizes)
    assert all(sum(lengths) <= 100 for lengths, _ in bins)
    assert sum(n for _, n in bins) == optimum(sizes, 100)


def test_many_lengths_are_searched_as_far_as_few():
    r = random.Random(0)
    sizes = []
    for _ in range(400):
        a, b = r.randint(1000, 1700), r.randint(1000, 1700)
        sizes += [a, b, 4096 - a - b]
    bins = packing.plan(dict(Counter(sizes)), 4096)
    assert Counter(s for lengths, n in bins for s in lengths for _ in range(n)) == Counter(sizes)
    assert all(sum(lengths) <= 4096 for lengths, _ in bins)
    assert sum(n for _, n in bins) <= 434  # 438 with the search cut at 61 branches; 400 is the least


def test_repeated_rows_and_empty_table(spark):
    df = docs(spark, [(1, "a b c"), (1, "a b c"), (2, "a b c")])
    rows = packing.pack(df.withColumn("length", df.doc_id), tokenizer_path()).collect()
    assert len(rows) == 3 and sorted(r.offset for r in rows) == [0, 4, 8]
    assert packing.pack(docs(spark, []), tokenizer_path()).count() == 0


def test_memory_follows_the_bytes_coded_at_once():
    r = random.Random(3)
    vocab = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(3, 9))) for _ in range(20000)]
    texts = [" ".join(r.choices(vocab, k=300)) for _ in range(3000)]  # 6.3 MB
    batch = pa.record_batch({"doc_id": range(len(texts)), "text": texts})
    coder = packing.WordIds(tokenizer_path())
    coder.packed(["once"])
    tracemalloc.start()
    n = sum(b.num_rows for b in packing.cut(batch, coder, 4096))
    peak = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    assert n == len(texts)
    assert peak < 60


def test_rows_sent_at_once_are_few_and_the_session_keeps_its_own_number(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    with packing.arrow_rows(spark, 2000):
        assert spark.conf.get(name) == "2000"
        with packing.arrow_rows(spark, 5000):
            assert spark.conf.get(name) == "2000"
    assert spark.conf.get(name) == before


def test_large_ids_beside_a_null_one_stay_exact(spark):
    rows = packing.pack(docs(spark, [(2**53 + 1, "a b c"), (None, "a b"), (3, None)], parts=1), tokenizer_path()).collect()
    assert sorted((r.doc_id or 0, r.length) for r in rows) == [(0, 3), (3, 1), (2**53 + 1, 4)]
