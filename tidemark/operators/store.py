"""Facts kept by period: only periods that new rows touch are built again, staged, checked and then swapped in.

A table is Parquet in one folder a period, so screens of some months read those folders alone. Spark's own writers commit what
is staged; a lost executor costs its tasks, and a refused period keeps what it had.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import guards
from tidemark.functions.core import month

#: Periods that one refresh touches at most: a century of months.
MOST = 1200


def stored(spark: SparkSession, path: str, since: str | date | None = None, until: str | date | None = None) -> DataFrame:
    """The table, or its periods from ``since`` to before ``until``: a filter on folders, which no other folder is read for."""
    out = spark.read.parquet(path)
    if since is not None:
        out = out.filter(F.col("period") >= F.lit(str(since)).cast("date"))
    if until is not None:
        out = out.filter(F.col("period") < F.lit(str(until)).cast("date"))
    return out


def written(fact: DataFrame, path: str) -> None:
    """Writes a whole table by its column ``period``; the rows of one period meet before they are written, in parts whose
    size adaptive execution chooses."""
    fact.hint("rebalance", "period").write.mode("overwrite").partitionBy("period").parquet(path)


def touched(new: DataFrame, day: str) -> list[date]:
    """Months of the new rows; few, and refused beyond MOST."""
    found = [r["period"] for r in new.select(month(day).alias("period")).filter("period is not null").distinct().limit(MOST + 1).collect()]
    if len(found) > MOST:
        raise guards.Refused(f"new rows touch more than {MOST} periods: build the whole table")
    return sorted(found)


def refreshed(raw: DataFrame, new: DataFrame, day: str, build: Callable[[DataFrame], DataFrame], path: str, ratio: float = 0.5, least: int = 100) -> DataFrame:
    """Builds the periods that ``new`` touches again from ``raw`` (which holds the new rows), and swaps in those that pass.

    period, rows_before, rows_after, status: new, replaced, or refused: no rows came out, or fewer than ``ratio`` of at least
    ``least`` rows before. raw is filtered by bounds on ``day``, so that a scan skips other months.
    """
    spark = raw.sparkSession
    periods = touched(new, day)
    staging = f"{path}-staging"
    if not periods:
        return spark.createDataFrame([], "period date, rows_before long, rows_after long, status string")
    kind = raw.schema[day].dataType
    after = F.add_months(F.lit(periods[-1]), 1).cast(kind)
    own = raw.filter((F.col(day) >= F.lit(periods[0]).cast(kind)) & (F.col(day) < after) & month(day).isin(*periods))
    built = build(own)
    written(built.filter(F.col("period").isin(*periods)), staging)
    asked = spark.createDataFrame([(p,) for p in periods], "period date")
    counts = lambda df, name: df.filter(F.col("period").isin(*periods)).groupBy("period").agg(F.count("*").alias(name))
    staged = spark.read.schema(built.schema).parquet(staging)
    verdict = asked.join(counts(_present(spark, path, built), "rows_before"), "period", "left").join(counts(staged, "rows_after"), "period", "left")
    verdict = verdict.fillna(0, ["rows_before", "rows_after"])
    short = (F.col("rows_after") == 0) | ((F.col("rows_before") >= least) & (F.col("rows_after") < ratio * F.col("rows_before")))
    verdict = verdict.withColumn("status", F.when(short, "refused").when(F.col("rows_before") == 0, "new").otherwise("replaced"))
    rows = verdict.collect()  # MOST at most
    passed = [r["period"] for r in rows if r["status"] != "refused"]
    if passed:
        swap = staged.filter(F.col("period").isin(*passed)).hint("rebalance", "period").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        swap.partitionBy("period").parquet(path)
    return spark.createDataFrame(rows, verdict.schema)


def _present(spark: SparkSession, path: str, built: DataFrame) -> DataFrame:
    try:
        return spark.read.parquet(path)
    except AnalysisException:  # nothing is stored yet
        return spark.createDataFrame([], built.schema)
