"""What the operators of this subpackage share: reading, checkpoints, word patterns, distributed ranks."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.checkpoint import saved  # noqa: F401

#: A word: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder, read by Spark's own reader."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@contextmanager
def arrow_rows(spark: SparkSession, most: int) -> Iterator[None]:
    """Jobs run inside send at most ``most`` rows to a Python worker at once, so that neither side holds thousands of long
    texts; a smaller number that the session has stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, most if int(before) <= 0 else min(most, int(before)))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def boxed(df: DataFrame, *names: str) -> DataFrame:
    """The named columns, and all others in one struct ``_row``: what an operator adds can't clash with columns that the
    caller has, and no text is held twice."""
    others = [F.col(f"`{c}`") for c in df.columns if c not in names] or [F.lit(None).alias("_none")]
    return df.select(F.struct(*others).alias("_row"), *[F.col(f"`{c}`") for c in names])


def unboxed(df: DataFrame, columns: list[str], names: tuple[str, ...], **new: Column) -> DataFrame:
    """The caller's columns: those in ``names`` (as given to ``boxed``) from the top, others from ``_row``, some anew."""
    return df.select(*[(new[c] if c in new else F.col(f"`{c}`") if c in names else F.col("_row").getField(c)).alias(c) for c in columns])


def running(df: DataFrame, group: list[str], order: list[str], value: Column, into: str, buckets: str) -> DataFrame:
    """Adds ``into``: the sum of ``value`` over the rows of the group that come before this one.

    ``buckets`` names a column that splits every group into a fixed number of ordered parts, so that one
    large group is spread over many tasks: the parts are summed first (partial aggregation), the few sums
    get a running total within their group, and rows are ranked only within their part. Rows are ordered
    by ``buckets``, then by ``order``. Group and bucket columns hold no nulls.
    """
    keys = [*group, buckets]
    sums = df.groupBy(*keys).agg(F.sum(value).alias("_sum"))
    over = Window.partitionBy(*group).orderBy(buckets).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*keys, F.coalesce(F.sum("_sum").over(over), F.lit(0)).cast("long").alias("_base"))
    joined = df.join(sums, keys)
    within = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return joined.withColumn(into, F.col("_base") + F.coalesce(F.sum(value).over(within), F.lit(0)).cast("long")).drop("_base")
