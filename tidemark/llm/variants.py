"""Spelling variants: words one edit apart, each led to a far more frequent form and on to a root.

Symmetric deletion: every word emits the hash of itself and of each distinct string that one deletion makes of it. Two words
one edit apart share exactly one of these (the longer one's deletion is the shorter one, or both lack the place where they
differ), so an equi-join finds each pair once; the others that share one (neighbours swapped, say) fall to an exact
distance. Words that share a key differ in one place from it, so a key has at most as many words as it has places times
the alphabet has letters: no key grows with the corpus. Words are counted in each batch before any shuffle, so the most frequent
word is one row of each batch. Rows carry 64-bit ids, not words, since a word of n letters has n keys.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm import words as W
from tidemark.llm.common import saved

#: Runs of letters in lower-cased UTF-8: a to z, and U+00C0 to U+00FF.
RUN = re.compile(rb"(?:[a-z]++|\xc3[\x80-\xbf])++")
#: One run in so many loses a letter.
NOISE = 199
#: A word's code points and occurrences at least; how many times as frequent a form is.
LETTERS, TIMES, RATIO = 6, 5, 5


def shortened(run: bytes, h: int) -> bytes:
    """The run without its code point h % length."""
    text = run.decode()
    at = h % len(text)
    return (text[:at] + text[at + 1 :]).encode()


def told(doc_id: object, text: str | None, into: Counter) -> None:
    """Adds the words of one text; a null doc_id hashes as nothing."""
    if not text:
        return
    start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    for run, n in Counter(RUN.findall(text.encode("utf-8", "replace").lower())).items():
        h = zlib.crc32(run, start)
        into[run if h % NOISE else shortened(run, h)] += n


def counted(docs: DataFrame) -> DataFrame:
    """word, n: every word of LETTERS code points or more, as often as it occurs."""

    def count(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in it:
            seen: Counter = Counter()
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                told(doc_id, text, seen)
            kept = [(w.decode(), n) for w, n in seen.items() if len(w) - w.count(b"\xc3") >= LETTERS]
            yield pd.DataFrame(kept, columns=["word", "n"])

    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInPandas(count, "word string, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("n"))


def deletion_keys(words: list[str]) -> list[np.ndarray]:
    """For each word the hashes of itself and of its distinct single deletions, all from running sums of one polynomial."""
    codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    lens = np.array([len(w) for w in words])
    end = np.cumsum(lens)
    begin = end - lens
    owner = np.repeat(np.arange(len(words)), lens)
    p, q = W.powers(int(lens.max(initial=0)) + 2)
    sums = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(W.mixed(codes.astype(np.uint64) + np.uint64(1)) * p[np.arange(len(codes)) - begin[owner]], out=sums[1:])
    at = np.arange(len(codes))
    at = at[(at == begin[owner]) | (codes != np.roll(codes, 1))]  # of equal letters in a row only the first
    own = owner[at]
    less = sums[at] - sums[begin[own]] + (sums[end[own]] - sums[at + 1]) * q[1]
    hashes = np.concatenate([sums[end] - sums[begin], less])
    sizes = np.concatenate([lens, lens[own] - 1]).astype(np.uint64)
    of = np.concatenate([np.arange(len(words)), own])
    order = np.argsort(of, kind="stable")
    keys = W.mixed(hashes + sizes * np.uint64(W.BASE))[order].astype(np.int64)
    cuts = np.searchsorted(of[order], np.arange(len(words) + 1))
    return [keys[i:j] for i, j in zip(cuts[:-1], cuts[1:], strict=True)]


@F.pandas_udf(T.ArrayType(T.LongType()))
def _keys(words: pd.Series) -> pd.Series:
    return pd.Series(deletion_keys(words.tolist()), dtype=object)


def one_apart(a: str, b: str) -> bool:
    """Whether one inserted, deleted or replaced code point parts two words; time grows with their length."""
    a, b = (a, b) if len(a) <= len(b) else (b, a)
    if len(b) - len(a) > 1 or a == b:
        return False
    low, high = 0, len(a)  # the length of what both begin with
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[low:mid] == b[low:mid] else (low, mid - 1)
    return a[low + (len(a) == len(b)) :] == b[low + 1 :]


@F.pandas_udf(T.BooleanType())
def _one_apart(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([one_apart(x, y) for x, y in zip(a, b, strict=True)], dtype=bool)


def near(vocabulary: DataFrame) -> DataFrame:
    """a, b: each two words (``word`` of distinct rows) that one inserted, deleted or replaced code point parts, once."""
    words = vocabulary.select(F.xxhash64("word").alias("id"), "word")
    keyed = saved(words.select("id", F.explode(_keys("word")).alias("key")))
    other = keyed.select(F.col("id").alias("other"), "key")
    pairs = keyed.join(other, "key").filter("id < other").select("id", "other")
    named = pairs.join(words.withColumnRenamed("word", "a"), "id").join(words.select(F.col("id").alias("other"), F.col("word").alias("b")), "other")
    return named.filter(_one_apart("a", "b")).select("a", "b")


def roots(forms: DataFrame) -> DataFrame:
    """word, root of rows word, form: forms followed to the last, each round twice as far. Forms must not go in circles."""
    reached = saved(forms.select("word", F.col("form").alias("root")))
    while True:
        up = reached.select(F.col("word").alias("root"), F.col("root").alias("_up"))
        moved = saved(reached.join(up, "root", "left").select("word", F.coalesce("_up", "root").alias("root"), F.col("_up").isNotNull().alias("_moved")))
        reached = moved.select("word", "root")
        if moved.filter("_moved").isEmpty():
            return reached


def group(docs: DataFrame) -> DataFrame:
    """word, n, n_near, form, form_n and root of every word of LETTERS code points that occurs TIMES times or more.

    A word's form is its near word of largest n (ties: the smallest in code-point order), if that n is RATIO times the
    word's own; else it has none and is its own root. Each form is more frequent than its word, so chains end. Null, empty
    and wordless texts add nothing; repeated rows count as often as they stand; empty tables give no rows.
    """
    vocabulary = saved(counted(docs).filter(F.col("n") >= TIMES))
    pairs = near(vocabulary)
    both = saved(pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    known = both.join(vocabulary.select(F.col("word").alias("b"), F.col("n").alias("bn")), "b")
    best = known.groupBy(F.col("a").alias("word")).agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("bn")).alias("less"), "b")).alias("best"))
    led = -F.col("best.less") >= RATIO * F.col("n")
    formed = saved(vocabulary.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(led, F.col("best.b")).alias("form"), F.when(led, -F.col("best.less")).alias("form_n")))
    ends = roots(formed.filter("form is not null"))
    return formed.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
