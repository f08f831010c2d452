"""Ranks and exact percentiles of groups of any size, by ranges of values.

Equal values are counted first, so ties travel as one row. The counted values are dealt by range, the parts' sums get a running
total (one row a group and part), and within a part values are counted on from there. No task sees more than a part, whichever
group or value holds the most rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.checkpoint import saved
from tidemark.functions.core import as_column


def _key(by: Sequence[str]) -> Column:
    """A group as one value, in which nulls are equal."""
    return F.struct(*[F.col(c) for c in by]) if by else F.struct(F.lit(0).alias("_all"))


def placed(counts: DataFrame) -> DataFrame:
    """_by, _value, _n with below (rows of the group with a smaller value; nulls come last), present (rows with a value) and
    total. One row for each different value of a group."""
    order = F.col("_value").asc_nulls_last()
    parts = saved(counts.repartitionByRange(F.col("_by"), order).withColumn("_part", F.spark_partition_id()))
    here = Window.partitionBy("_by").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("_by")
    sums = parts.groupBy("_by", "_part").agg(F.sum("_n").alias("_sum"), F.sum(F.when(F.col("_value").isNotNull(), F.col("_n"))).alias("_has"))
    sums = sums.select("_by", "_part", F.coalesce(F.sum("_sum").over(here), F.lit(0)).alias("_base"), F.sum("_sum").over(whole).alias("total"), F.coalesce(F.sum("_has").over(whole), F.lit(0)).alias("present"))
    within = Window.partitionBy("_by", "_part").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    counted = parts.withColumn("_before", F.coalesce(F.sum("_n").over(within), F.lit(0)))
    return counted.join(sums, ["_by", "_part"]).select("_by", "_value", "_n", (F.col("_base") + F.col("_before")).alias("below"), "present", "total")


def counted(rows: DataFrame, by: Sequence[str], value: Column) -> DataFrame:
    return rows.groupBy(_key(by).alias("_by"), value.alias("_value")).agg(F.count("*").alias("_n"))


def percentiles_of(counts: DataFrame, by: Sequence[str], shares: Mapping[str, float]) -> DataFrame:
    """The group's columns and a column for each share: the linearly interpolated percentile of counted values (_by, _value,
    _n). Groups without any value are missing."""
    own = placed(counts.filter("_value is not null"))
    aggs = []
    for name, p in shares.items():
        k = F.lit(float(p)) * (F.col("present") - 1)
        for end, at in (("low", F.floor(k)), ("high", F.ceil(k))):
            aggs.append(F.max(F.when((F.col("below") <= at) & (at < F.col("below") + F.col("_n")), F.col("_value"))).alias(f"_{name}_{end}"))
    found = own.groupBy("_by").agg(F.first("present").alias("present"), *aggs)
    out = []
    for name, p in shares.items():
        k, low, high = F.lit(float(p)) * (F.col("present") - 1), F.col(f"_{name}_low"), F.col(f"_{name}_high")
        out.append(F.when(F.floor(k) == F.ceil(k), low).otherwise((F.ceil(k) - k) * low + (k - F.floor(k)) * high).alias(name))
    return found.select(*[F.col("_by")[c].alias(c) for c in by], *out)


def percentiles(rows: DataFrame, by: Sequence[str], value: str | Column, shares: Mapping[str, float]) -> DataFrame:
    """The same from rows."""
    return percentiles_of(counted(rows, by, as_column(value).cast("double")), by, shares)


def joined_by(left: DataFrame, right: DataFrame, by: Sequence[str]) -> DataFrame:
    """Left rows with the columns of the right row of their group, if there is one; null groups are groups."""
    new = [c for c in right.columns if c not in by]
    other = right.select(_key(by).alias("_by"), *new)
    return left.withColumn("_by", _key(by)).join(other, "_by", "left").drop("_by")


def ranked(rows: DataFrame, by: Sequence[str], value: str, rank: str = "rank", percent_rank: str | None = None) -> DataFrame:
    """Adds RANK (largest first, nulls last) and, if named, PERCENT_RANK (smallest first, nulls last) within the group."""
    own = placed(counted(rows, by, F.col(value))).withColumnsRenamed({"_by": "_k", "_value": "_v"})
    met = rows.withColumn("_by", _key(by)).join(own, (F.col("_by") == F.col("_k")) & F.col(value).eqNullSafe(F.col("_v")))
    place = F.when(F.col("_v").isNull(), F.col("present") + 1).otherwise(F.col("present") - F.col("below") - F.col("_n") + 1)
    new = [place.cast("int").alias(rank)]
    if percent_rank:
        new.append(F.when(F.col("total") > 1, F.col("below") / (F.col("total") - 1)).otherwise(0.0).alias(percent_rank))
    return met.select(*rows.columns, *new)
