"""Mixing sources to target weights: hash-random keys, ranges of keys within each source, distributed prefix
sums of word counts, and a cut at each source's exact budget, over as many epochs as that takes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import WORD, boxed, running, saved, unboxed

#: Weights of the sources in code point order, repeating.
WEIGHTS = (5, 2, 1)


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, ceiling: float = 2.0) -> DataFrame:
    """A row per source: _source, source_size, target (double).

    Sources share ``share`` times all words by weight; a source stops at ``ceiling`` times its own words, and what
    it can't take is shared anew by weight. Going through the sources by ceiling over weight, all before the first
    that can hold its share are full; the rest is shared by weight. The windows run over one row per source.
    """
    n = len(weights)
    per = sizes.groupBy("_source").agg(F.sum("size").alias("source_size"))
    ranked = per.withColumn("_at", F.row_number().over(Window.orderBy("_source")) - 1)
    ranked = ranked.withColumn("_w", F.element_at(F.array(*map(F.lit, weights)), (F.col("_at") % n + 1).cast("int")).cast("long"))
    full = Window.orderBy(F.col("source_size") / F.col("_w"), "_at")
    before, rest = full.rowsBetween(Window.unboundedPreceding, -1), full.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    level = (share * F.sum("source_size").over(everything) - ceiling * F.coalesce(F.sum("source_size").over(before), F.lit(0))) / F.sum("_w").over(rest)
    levelled = ranked.withColumn("_level", level).withColumn("_holds", F.col("_level") * F.col("_w") <= ceiling * F.col("source_size"))
    first = F.min(F.when(F.col("_holds"), F.struct(F.col("source_size") / F.col("_w"), "_at", "_level"))).over(everything)
    out = levelled.withColumn("_first", first["_level"])
    held = F.least(F.col("_first") * F.col("_w"), ceiling * F.col("source_size"))
    return out.select("_source", "source_size", F.coalesce(held, ceiling * F.col("source_size")).cast("double").alias("target"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, ceiling: float = 2.0) -> DataFrame:
    """doc_id, size, source_size, target, taken for every row of ``docs``.

    A source's whole epochs take each of its documents whole; the last epoch takes them in the order of their
    hash-random keys until the budget (the target, to the nearest word) is met, the last document in part. So no
    document is taken more than ``ceiling`` times, rounded up to whole epochs, and a source takes its target to the word.
    Null or blank text has size 0 and takes nothing; a null source is a source of its own, the last. Repeated rows
    are rows of their own. A source without words has target 0. Empty tables give no rows.
    """
    sizes = docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("_key"))
    named = F.coalesce(F.concat(F.lit("a"), "source"), F.lit("b"))  # in code point order, null last
    sizes = saved(sizes.withColumns({"_part": F.substring("_key", 1, 2), "_source": named}))
    ordered = running(sizes, ["_source"], ["_key", "doc_id", "size"], F.col("size"), "_before", "_part")
    joined = ordered.join(targets(sizes, weights, share, ceiling), "_source")
    budget = F.round("target").cast("long")
    whole = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0)
    cut = budget - whole * F.col("source_size") - F.col("_before")
    taken = whole * F.col("size") + F.least(F.greatest(cut, F.lit(0)), F.col("size"))
    return joined.select("doc_id", "source", "size", "source_size", "target", taken.cast("long").alias("taken"))


def repeat(docs: DataFrame, **how) -> DataFrame:
    """``docs`` as the mix takes them: whole copies by epoch, then the leading words of the last one taken in part.

    Rows are joined to their share by doc_id, which must be unique and not null (true after deduplication).
    """
    share = mix(docs, **how).select(F.col("doc_id").alias("_id"), F.col("size").alias("_size"), F.col("taken").alias("_taken")).dropDuplicates(["_id"])
    rows = boxed(docs, "doc_id", "text").join(share, F.col("doc_id") == F.col("_id")).filter(F.col("_taken") > 0)
    copies = F.sequence(F.lit(1), F.ceil(F.col("_taken") / F.col("_size")).cast("int"))
    rows = rows.withColumn("_copy", F.explode(copies)).withColumn("_left", F.least(F.col("_size"), F.col("_taken") - (F.col("_copy") - 1) * F.col("_size")).cast("int"))
    lead = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), F.lit(1), F.col("_left")), " ")
    rows = rows.withColumn("_text", F.when(F.col("_left") < F.col("_size"), lead).otherwise(F.col("text")))
    new = {"text": F.col("_text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.length("_text").cast(docs.schema["n_chars"].dataType)
    return unboxed(rows, docs.columns, ("doc_id", "text"), **new)
