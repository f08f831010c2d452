"""Quality rules with risk-controlled thresholds.

Besides fixed base rules, each rule rejects documents whose statistic passes a cutoff. Cutoffs come from labelled
documents: in each stratum (language) and for each rule, cutoffs are tried from lenient to strict in a fixed sequence;
one is certified while an exact binomial test shows that it rejects at most a share ``RISK`` of good documents, at a
level that is divided by all strata and rules tested. Among the certified cutoffs, the one that parts bad from good
documents best is taken, or none if none helps.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from operator import or_

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import words as W
from tidemark.llm.common import saved

#: False rejections allowed to each rule, and the chance that any cutoff of any stratum breaks that.
RISK, LEVEL = 0.0125, 0.05
#: Rules: the statistic (0 to 1, or scaled to it) of which more is worse.
RULES = ("symbols", "dup_lines", "repeats", "long_words")
#: Cutoffs tried, from 1 down.
STEPS = 100
SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True


def counts(docs: DataFrame) -> DataFrame:
    """doc_id, lang, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines for every row."""

    def counted(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in it:
            texts, rows = batch["text"].tolist(), []
            for at, raws in W.batches(texts):
                hashes, owner, flat = W.words(raws)
                n = len(raws)
                bounds = np.concatenate([[0], np.cumsum([len(r) + 1 for r in raws])])
                chars = np.add.reduceat((~W.SPACE[flat] & ((flat & 0xC0) != 0x80)).astype(np.int64), bounds[:-1])
                symbols = np.add.reduceat(SYMBOL[flat].astype(np.int64), bounds[:-1])
                n_words = np.bincount(owner, minlength=n)
                made, first = W.windows(hashes, owner)
                tail = np.searchsorted(owner[first], np.arange(n + 1))
                repeats = np.zeros(n, np.int64)
                starts = np.concatenate([[0], np.cumsum(n_words)])
                for i in range(n):
                    own = made[tail[i] : tail[i + 1]]
                    if len(own) > 1:
                        order = np.argsort(own, kind="stable")
                        same = own[order][1:] == own[order][:-1]
                        if same.any():
                            again = np.zeros(len(own), bool)
                            again[order[1:][same]] = again[order[:-1][same]] = True
                            edge = np.zeros(n_words[i] + 1, np.int64)
                            at_ = first[tail[i] : tail[i + 1]][again] - starts[i]
                            np.add.at(edge, at_, 1)
                            np.add.at(edge, at_ + 5, -1)
                            repeats[i] = int((np.cumsum(edge) > 0).sum())
                for i, raw in enumerate(raws):
                    seen: set[bytes] = set()
                    dup = lines = 0
                    for line in raw.split(b"\n"):
                        if line.strip():
                            lines += 1
                            dup += line in seen
                            seen.add(line)
                    rows.append((int(n_words[i]), int(chars[i]), int(symbols[i]), dup, int(repeats[i]), lines))
            made_rows = pd.DataFrame(rows, columns=["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"], dtype="int64")
            yield pd.concat([batch[["doc_id", "lang"]].reset_index(drop=True), made_rows], axis=1)

    kind = docs.schema["doc_id"].dataType.simpleString()
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string").alias("lang")
    return docs.select("doc_id", "text", lang).mapInPandas(counted, f"doc_id {kind}, lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long")


def statistics(name: str):
    """A rule's statistic as a column, 0 to 1."""
    part = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b)), F.lit(0.0))
    return F.least(F.lit(1.0), {"symbols": part("n_symbols", "word_chars"), "dup_lines": part("n_dup_lines", "n_lines"), "repeats": part("n_repeat_words", "n_words"), "long_words": part("word_chars", "n_words") / 50}[name])


def tail(k: int, n: int, p: float) -> float:
    """P(X <= k) for X binomial(n, p), exactly up to rounding: the regularised incomplete beta function at 1 - p, by its
    continued fraction, whose cost hardly grows with n."""
    if k >= n:
        return 1.0
    a, b, x = float(n - k), float(k + 1), 1.0 - p
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1) / (a + b + 2):
        return min(1.0, front * _fraction(a, b, x) / a)
    return max(0.0, 1.0 - front * _fraction(b, a, 1 - x) / b)


def _fraction(a: float, b: float, x: float) -> float:
    """The continued fraction of the incomplete beta function, evaluated from the front."""
    tiny = 1e-300
    c, d = 1.0, 1.0 / (1.0 - (a + b) * x / (a + 1) or tiny)
    out, m = d, 0
    while True:
        m += 1
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 / (1.0 + top * d or tiny)
            c = 1.0 + top / c or tiny
            out *= c * d
        if abs(c * d - 1.0) < 1e-14:
            return out


def choose(good: np.ndarray, bad: np.ndarray, level: float, risk: float = RISK) -> int | None:
    """The step whose cutoff is taken, from counts of labelled documents by step of their statistic; or None."""
    n_good, n_bad, best, gain = int(good.sum()), int(bad.sum()), None, 0.0
    for step in range(STEPS, -1, -1):  # rejects documents at this step and above
        k = int(good[step:].sum())
        if k > risk * n_good or tail(k, n_good, risk) > level:
            break
        if n_bad and (g := bad[step:].sum() / n_bad - k / max(1, n_good)) > gain:
            best, gain = step, g
    return best


def cutoffs(counted: DataFrame, labels: DataFrame, risk: float = RISK, level: float = LEVEL) -> dict[tuple[str, str], int]:
    """The step taken by stratum and rule; every stratum is tested by itself.

    What comes to the driver is at most strata (languages) times rules times steps times two counts.
    """
    marks = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("_quality"))
    # equal ids share a label; labelled rows only, narrow
    known = counted.filter(~base_failed()).join(marks, "doc_id").select("_quality", F.coalesce("lang", F.lit("")).alias("stratum"), *[F.floor(statistics(r) * STEPS).cast("int").alias(r) for r in RULES])
    long = known.select("_quality", "stratum", F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(r).alias("step")) for r in RULES])).alias("x"))
    rows = long.groupBy("stratum", "x.rule", "x.step", (F.col("_quality") > 0).alias("good")).count().collect()
    tables: dict[tuple[str, str], np.ndarray] = {}
    for r in rows:
        tables.setdefault((r["stratum"], r["rule"]), np.zeros((2, STEPS + 1), np.int64))[int(r["good"]), r["step"]] += r["count"]
    each = level / max(1, len(tables))
    return {k: step for k, t in tables.items() if (step := choose(t[1], t[0], each, risk)) is not None}


def base_failed():
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def judge(docs: DataFrame, labels: DataFrame, risk: float = RISK, level: float = LEVEL) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept for every row of ``docs``.

    Null and blank texts have no words and fail the base rules. Null languages are a stratum of their own. Labels that
    are null, or of documents that aren't there, don't count; of several for one id the lowest counts. Without enough
    labels no cutoff is certified, and what passes the base rules is kept. Repeated rows are judged alike.
    """
    counted = saved(counts(docs))
    cut = cutoffs(counted, labels, risk, level)
    rows = [(name, *[cut.get((name, rule), STEPS + 1) for rule in RULES]) for name in sorted({name for name, _ in cut})]
    table = counted.sparkSession.createDataFrame(rows, ", ".join(["_stratum string", *[f"_{r} int" for r in RULES]]))
    # a row per stratum at most
    counted = counted.join(F.broadcast(table), F.coalesce("lang", F.lit("")) == F.col("_stratum"), "left")
    rejected = F.coalesce(reduce(or_, [F.floor(statistics(r) * STEPS) >= F.col(f"_{r}") for r in RULES]), F.lit(False))
    return counted.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed().alias("base_failed"), (~base_failed() & ~rejected).alias("kept"))
