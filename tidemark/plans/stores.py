"""Queries on facts that are kept by period.

The orders until 2000 are the first load; those of the three months from 1998-03 that have status F come late, with all of
2001. The refreshed table must be what one build from all orders gives.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.checkpoint import shared_folder
from tidemark.operators import facts
from tidemark.operators import store as S
from tidemark.plans.base import FACT, daily, query


def build(rows: DataFrame) -> DataFrame:
    """The monthly fact without its quota, whose class is chosen over all months."""
    return facts.entity_month_fact(rows).drop("quota")


def loaded(spark: SparkSession, d: str) -> tuple[str, DataFrame]:
    """A table in the shared folder after its first load and a refresh, and the refresh's verdicts."""
    raw = daily(spark, d)
    spring = (F.col("day") >= F.lit("1998-03-01").cast("date")) & (F.col("day") < F.lit("1998-06-01").cast("date"))
    late = (spring & (F.col("inflow") > 0)) | (F.col("day") >= F.lit("2001-01-01").cast("date"))
    path = shared_folder(spark, "fact")
    S.written(build(raw.filter(~late)), path)
    return path, S.refreshed(raw, raw.filter(late), "day", build, path)


@query(f"WITH {FACT} SELECT entity, period, nav, holders, inflow, outflow FROM fact")
def fact_by_period(spark: SparkSession, d: str) -> DataFrame:
    """The monthly fact as it stands by period after late rows came in."""
    path, _ = loaded(spark, d)
    return S.stored(spark, path).select("entity", "period", "nav", "holders", "inflow", "outflow")


@query(
    f"""WITH {FACT},
late AS (SELECT DISTINCT period FROM daily WHERE (day >= DATE '1998-03-01' AND day < DATE '1998-06-01' AND inflow > 0) OR day >= DATE '2001-01-01'),
early AS (SELECT period, count(DISTINCT entity) AS n FROM daily WHERE nav IS NOT NULL AND NOT ((day >= DATE '1998-03-01' AND day < DATE '1998-06-01' AND inflow > 0) OR day >= DATE '2001-01-01') GROUP BY period),
whole AS (SELECT period, count(*) AS n FROM fact GROUP BY period)
SELECT period, coalesce(early.n, 0) AS rows_before, coalesce(whole.n, 0) AS rows_after, CASE WHEN whole.n IS NULL THEN 'refused' WHEN early.n IS NULL THEN 'new' ELSE 'replaced' END AS status
FROM late LEFT JOIN early USING (period) LEFT JOIN whole USING (period)"""
)
def fact_refresh(spark: SparkSession, d: str) -> DataFrame:
    """Which months late rows touched, and what became of them."""
    return loaded(spark, d)[1]
