"""Statement lines led to entities by the names that these have filed: by number, by ticker, by exact name, by trigrams.

Equal inputs are scored once. A name that scores enough shares one of the input's rarest trigrams (as many that not enough
are left without them), so only these are joined; scores of what meets are exact, whatever the number of names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tidemark.functions.core import as_column
from tidemark.functions.text import digits, name_core, name_norm, trigrams

#: Scores at least, words of a short input, the score of a hint at most, candidates told, the gap that tells two apart.
LEAST, SHORT, HINT, TOP, GAP = 0.25, 4, 0.5, 5, 0.05
#: Relative difference of a quota that confirms a candidate.
TOLERANCE = 0.005


def ordered_trigrams(norm: str | Column) -> Column:
    """All trigrams of a normalised name in the order they stand, repeats kept; words padded by two blanks and one."""
    words = F.filter(F.split(as_column(norm), "[^a-z0-9]+"), lambda w: F.length(w) > 0)
    return F.flatten(F.transform(words, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.substr(F.concat(F.lit("  "), w, F.lit(" ")), i, F.lit(3)))))


def best_extent(asked: list[str], name: list[str]) -> float:
    """The largest similarity of the asked trigrams and those of any extent of the name's; an extent that isn't bounded by
    asked trigrams is never the best."""
    own, best = set(asked), 0.0
    at = [i for i, g in enumerate(name) if g in own]
    for k, i in enumerate(at):
        seen: set[str] = set()
        both, last = 0, i
        for j in at[k:]:
            both += name[j] not in seen
            seen.update(name[last : j + 1])
            last = j + 1
            best = max(best, both / (len(own) + len(seen) - both))
    return best


def with_extents(pairs: DataFrame, asked: str, name: str, into: str) -> DataFrame:
    """Adds the best extent's similarity of two columns of ordered trigrams; null where either is null."""

    def told(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in it:
            yield batch.assign(**{into: [None if x is None or y is None else best_extent(list(x), list(y)) for x, y in zip(batch[asked], batch[name], strict=True)]})

    return pairs.mapInPandas(told, StructType([*pairs.schema.fields, StructField(into, DoubleType())]))


def scores(asked: DataFrame, names: DataFrame, least: float = LEAST) -> DataFrame:
    """asked, name, score of every pair of normalised names that reaches ``least``: similarity of their trigram sets, and for
    an input of SHORT words or fewer the best extent's if that is larger."""
    a = asked.select("asked", trigrams("asked").alias("_a"), ordered_trigrams("asked").alias("_ao"), (F.size(F.split("asked", " ")) <= SHORT).alias("_short")).filter(F.size("_a") > 0)
    b = names.select("name", trigrams("name").alias("_b"), ordered_trigrams("name").alias("_bo")).filter(F.size("_b") > 0)
    grams = b.select("name", F.explode("_b").alias("g"))
    known = grams.groupBy("g").agg(F.count("*").alias("df"))
    each = a.select("asked", F.size("_a").alias("n"), F.explode("_a").alias("g")).join(known, "g")  # a trigram of no name meets none
    missing = F.col("n") - F.count("*").over(Window.partitionBy("asked"))
    rank = F.row_number().over(Window.partitionBy("asked").orderBy("df", "g"))
    keys = each.withColumns({"_rank": rank, "_missing": missing}).filter(F.col("_rank") + F.col("_missing") <= F.col("n") - F.ceil(F.col("n") * least) + 1).select("asked", "g")
    met = keys.join(grams, "g").select("asked", "name").distinct().join(a, "asked").join(b, "name")
    both = F.size(F.array_intersect("_a", "_b"))
    plain = both / (F.size("_a") + F.size("_b") - both)
    long_ = met.filter("not _short").select("asked", "name", plain.alias("score"))
    short = with_extents(met.filter("_short").select("asked", "name", plain.alias("_plain"), "_ao", "_bo"), "_ao", "_bo", "_extent").select("asked", "name", F.greatest("_plain", "_extent").alias("score"))
    return long_.unionByName(short).filter(F.col("score") >= least)


def resolved(lines: DataFrame, names: DataFrame, quotas: DataFrame, tickers: DataFrame, boilerplate: tuple[str, ...] = (), number_least: float = 0.0) -> DataFrame:
    """line, id, matched, kind, score, rank, quota_diff, is_ambiguous: each line's candidates, TOP at most; one row without an id
    for a line that finds none.

    lines: line, name, number, quota, quota_day. names: id, name, is_current, last_period. quotas: id, day, quota. tickers:
    ticker, id. A number wins (digits only, padded to fourteen; its likest name is told, of names below ``number_least`` the current one), then a name that is a ticker, then an exact normalised name (kind
    exact_current or exact_history), else trigrams: an entity's best name counts. A name that only reaches LEAST once the
    input's boilerplate words are gone is a hint, scored HINT at most. Candidates rank by a confirming quota of that very
    day, then hints last, then score. Ambiguous: the first two are within GAP and the quota doesn't tell them apart, or the
    first is a hint that no quota confirms.
    """
    norm = name_norm(F.nullif(F.trim("name"), F.lit("")))
    given = F.nullif(digits(F.coalesce("number", F.lit(""))), F.lit(""))
    own = lines.select("line", F.col("name").alias("_input"), norm.alias("_nn"), F.when(given.isNotNull(), F.lpad(given, 14, "0")).alias("_number"), "quota", "quota_day")
    history = names.select("id", F.col("name").alias("matched"), name_norm("name").alias("_norm"), "is_current", "last_period").filter("id is not null and _norm is not null")

    numbered = own.filter("_number is not null").join(history.withColumnRenamed("id", "_id"), F.col("_number") == F.col("_id"), "left")
    likeness = F.size(F.array_intersect(trigrams("_nn"), trigrams("_norm"))) / F.nullif(F.size(F.array_union(trigrams("_nn"), trigrams("_norm"))), F.lit(0))
    short = F.size(F.split("_nn", " ")) <= SHORT
    numbered = numbered.select("line", "_number", "matched", "is_current", "last_period", F.when(F.col("_nn").isNotNull() & F.col("_norm").isNotNull(), likeness).alias("_like"), F.when(short, ordered_trigrams("_nn")).alias("_a"), F.when(short, ordered_trigrams("_norm")).alias("_b"))
    numbered = with_extents(numbered, "_a", "_b", "_extent").withColumn("_s", F.greatest("_like", "_extent"))
    like = F.when(F.col("_s") >= number_least, F.col("_s")).otherwise(0.0)
    first = F.min(F.struct((-like).alias("a"), (~F.coalesce("is_current", F.lit(False))).alias("b"), F.col("last_period").isNotNull().alias("c"), F.datediff(F.lit("2100-01-01").cast("date"), "last_period").alias("d"), "matched", F.col("_s").alias("s")))
    by_number = numbered.groupBy("line", "_number").agg(first.alias("_f")).select("line", F.col("_number").alias("id"), "_f.matched", F.lit("number").alias("kind"), F.col("_f.s").alias("score"), F.lit(False).alias("_hint"))

    named = own.filter("_number is null and _nn is not null")
    etf = tickers.filter("id is not null").select(F.col("ticker"), "id").distinct()
    by_ticker = named.join(etf, F.upper(F.trim("_input")) == F.col("ticker")).select("line", "id", F.col("ticker").alias("matched"), F.lit("ticker").alias("kind"), F.lit(1.0).alias("score"), F.lit(False).alias("_hint"))
    rest = named.join(by_ticker.select("line"), "line", "left_anti")
    exact = rest.join(history, F.col("_nn") == F.col("_norm")).groupBy("line", "id").agg(F.min("matched").alias("matched"), F.when(F.max("is_current"), "exact_current").otherwise("exact_history").alias("kind"))
    exact = exact.select("line", "id", "matched", "kind", F.lit(1.0).alias("score"), F.lit(False).alias("_hint"))
    rest = rest.join(exact.select("line").distinct(), "line", "left_anti")

    inputs = rest.select("_nn").distinct().withColumn("_core", name_core("_nn", boilerplate)).withColumn("_core", F.when(F.col("_core") != F.col("_nn"), F.col("_core")))
    asked = inputs.select(F.col("_nn").alias("asked")).union(inputs.filter("_core is not null").select("_core")).distinct()
    found = scores(asked, history.select(F.col("_norm").alias("name")).distinct())
    direct = inputs.join(found, F.col("_nn") == F.col("asked")).select("_nn", F.col("name").alias("_norm"), "score", F.lit(False).alias("_hint"))
    hints = inputs.join(found, F.col("_core") == F.col("asked")).select("_nn", F.col("name").alias("_norm"), F.least(F.lit(HINT), "score").alias("score"), F.lit(True).alias("_hint")).join(direct.select("_nn", "_norm"), ["_nn", "_norm"], "left_anti")
    best = F.min(F.struct((-F.col("score")).alias("a"), F.col("last_period").isNotNull().alias("c"), F.datediff(F.lit("2100-01-01").cast("date"), "last_period").alias("d"), "matched", "_hint"))
    per = direct.unionByName(hints).join(history, "_norm").groupBy("_nn", "id").agg(best.alias("_b")).select("_nn", "id", F.col("_b.matched").alias("matched"), (-F.col("_b.a")).alias("score"), F.col("_b._hint").alias("_hint"))
    rank = F.row_number().over(Window.partitionBy("_nn", "_hint").orderBy(F.col("score").desc(), "id"))
    per = per.withColumn("_r", rank).filter(F.col("_hint") | (F.col("_r") <= TOP)).drop("_r")
    fuzzy = rest.join(per, "_nn").select("line", "id", "matched", F.lit("trigram").alias("kind"), "score", "_hint")

    all_ = reduce(DataFrame.unionByName, (by_number, by_ticker, exact, fuzzy)).join(own.select("line", "quota", "quota_day"), "line")
    filed = quotas.filter("quota is not null").select("id", F.col("day").alias("quota_day"), F.col("quota").alias("_filed"))
    off = F.abs(F.col("_filed") - F.col("quota")) / F.abs(F.nullif(F.col("quota"), F.lit(0.0)))
    near = all_.join(filed, ["id", "quota_day"], "left").groupBy("line", "id", "matched", "kind", "score", "_hint").agg(F.min(off).alias("quota_diff"))
    near = near.withColumn("_ok", F.coalesce(F.col("quota_diff") <= TOLERANCE, F.lit(False)))
    order = Window.partitionBy("line").orderBy(F.col("_ok").desc(), "_hint", F.col("score").desc_nulls_last(), F.col("quota_diff").asc_nulls_last(), "id")
    ranked = near.withColumns({"rank": F.row_number().over(order), "_next": F.lead(F.struct("score", "_ok")).over(order)})
    alone = F.col("_next").isNull()
    unsure = (
        F.when(F.col("kind").isin("number", "ticker"), False)
        .when(F.col("_ok") & ~F.coalesce(F.col("_next._ok"), F.lit(False)), False)
        .when(F.col("_hint"), True)
        .when(alone, False)
        .otherwise(F.coalesce("score", F.lit(0.0)) - F.coalesce(F.col("_next.score"), F.lit(0.0)) < GAP)
    )
    ranked = ranked.withColumn("is_ambiguous", F.max(F.when(F.col("rank") == 1, unsure)).over(Window.partitionBy("line"))).filter(F.col("rank") <= TOP)
    told = own.select("line").join(ranked, "line", "left")
    return told.select("line", "id", "matched", "kind", F.round("score", 4).alias("score"), "rank", F.round("quota_diff", 6).alias("quota_diff"), F.coalesce("is_ambiguous", F.lit(False)).alias("is_ambiguous"))
