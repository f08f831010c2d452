"""Document registers: versions and their pairs, differences of bodies, captures as of a time, flagged and new documents."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def in_window(documents: DataFrame, at: str, since: Column, until: Column) -> DataFrame:
    """Documents from the first day to the last, whole days of a timestamp (half open)."""
    return documents.filter((F.col(at) >= since) & (F.col(at) < F.date_add(until, 1)))


def version_pairs(documents: DataFrame, key: Sequence[str], version: str, at: str, document: str = "doc") -> DataFrame:
    """Each document beside the one with the next lower version of its key (nulls of the key match nulls): previous
    document and version, and days between both. First versions have no previous one and are left out."""
    w = Window.partitionBy(*key).orderBy(version, document)
    before = documents.withColumns({"previous": F.lag(document).over(w), "previous_version": F.lag(version).over(w), "_before": F.lag(at).over(w)})
    return before.filter("previous is not null").withColumn("lag_days", F.datediff(at, "_before")).drop("_before")


def flat_fields(documents: DataFrame, document: str, fields: Sequence[str]) -> DataFrame:
    """document, path, value of every field that isn't null."""
    return documents.select(F.col(document).alias("doc"), *[F.col(c).cast("string").alias(c) for c in fields]).unpivot(["doc"], list(fields), "path", "value").filter("value is not null")


def body_diff(pairs: DataFrame, fields: DataFrame) -> DataFrame:
    """doc, previous, path, kind (added, removed, changed), old, new and delta (of numbers) of every field that differs
    between the documents of a pair. Two keyed sides, joined outer on pair and path."""
    side = lambda which, name: pairs.select("doc", "previous").join(fields.select(F.col("doc").alias("_doc"), "path", F.col("value").alias(name)), F.col(which) == F.col("_doc")).drop("_doc")
    both = side("previous", "old").join(side("doc", "new"), ["doc", "previous", "path"], "full_outer")
    kind = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").otherwise("changed")
    delta = F.col("new").try_cast("double") - F.col("old").try_cast("double")
    return both.filter(~F.col("old").eqNullSafe(F.col("new"))).select("doc", "previous", "path", kind.alias("kind"), "old", "new", delta.alias("delta"))


def captured_as_of(captures: DataFrame, by: Sequence[str], captured: str, as_of: Column) -> DataFrame:
    """Of each key, the newest capture made up to a point in time."""
    eligible = captures.filter(F.col(captured) <= as_of)
    w = Window.partitionBy(*by).orderBy(F.col(captured).desc(), F.col("capture").desc())
    return eligible.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def wide(observations: DataFrame, by: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Long to wide for known metrics, in one aggregation; the largest of repeated values."""
    return observations.groupBy(*by).agg(*[F.max(F.when(F.col("metric") == m, F.col("value"))).alias(m) for m in metrics])


def first_seen_on(documents: DataFrame, seen: str, zone: str, day: Column) -> DataFrame:
    """Documents first seen on a local day of a zone; ``seen`` is in UTC. The day's ends are told in UTC, so that the filter
    is on the column as it is stored."""
    start, end = (F.to_utc_timestamp(d.cast("timestamp"), zone) for d in (day.cast("date"), F.date_add(day.cast("date"), 1)))
    kind = documents.schema[seen].dataType
    return documents.filter((F.col(seen) >= start.cast(kind)) & (F.col(seen) < end.cast(kind)))


def coverage_by_code(cases: DataFrame, code: Column, names: Mapping[str, str], flag: Column) -> DataFrame:
    """Cases and flagged cases (distinct) by the name that a part of their number stands for; unknown codes are kept."""
    table = F.create_map(*[x for k, v in names.items() for x in (F.lit(k), F.lit(v))])
    named = cases.withColumn("court", F.coalesce(F.try_element_at(table, code), F.concat(F.lit("? "), code)))
    return named.groupBy("court").agg(F.countDistinct("case").alias("n_cases"), F.countDistinct(F.when(flag, F.col("case"))).alias("n_flagged"))
