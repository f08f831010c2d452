"""Screens: entities whose filings fit a pattern that deserves a look."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import guards
from tidemark.functions.core import exact, latest_by, month, pct_cont, safe_div


def in_window(rows: DataFrame, end: str, months: int, period: str = "period") -> DataFrame:
    """Rows of the ``months`` months up to ``end``."""
    last = month(F.lit(end))
    return rows.filter((F.col(period) > F.add_months(last, -months)) & (F.col(period) <= last))


def growing_overdue(aging: DataFrame, fact: DataFrame, period: str, least_pct: float, least_nav: float) -> DataFrame:
    """At one period: overdue over NAV above a threshold while the NAV is above a floor."""
    at = F.lit(period).cast("date")
    rows = aging.filter(F.col("period") == at).join(fact.filter(F.col("period") == at).select("entity", "nav"), "entity")
    out = rows.withColumn("pct", safe_div("overdue", "nav") * 100)
    return out.filter((F.col("pct") > least_pct) & (F.col("nav") > least_nav)).select("entity", "overdue", "nav", "pct")


def captive(fact: DataFrame, end: str, months: int, holders: int, least_nav: float) -> DataFrame:
    """Few holders at the least, much NAV at the most, over the window."""
    out = in_window(fact, end, months).groupBy("entity").agg(F.min("holders").alias("min_holders"), F.max("nav").alias("max_nav"), F.count("*").alias("n_months"))
    return out.filter((F.col("min_holders") < holders) & (F.col("max_nav") > least_nav))


def evergreen(aging: DataFrame, end: str, months: int, least_pct: float, variation: float) -> DataFrame:
    """A large share of long-overdue value that hardly varies."""
    out = in_window(aging, end, months).groupBy("entity").agg(F.max("pct_long").alias("max_pct"), F.min("pct_long").alias("min_pct"), F.count("*").alias("n_months"))
    return out.filter((F.col("max_pct") > least_pct) & (F.col("max_pct") - F.col("min_pct") < variation))


def overdue_series(rows: DataFrame, keys: Sequence[str], day: str, maturity: str, status: str, closed: Sequence[str], as_of: str, value: str, least: float) -> DataFrame:
    """The latest row of each series that is past its maturity and isn't closed. A null status is neither: it drops out."""
    last = latest_by(rows, keys, [F.col(day).desc(), F.col(value).desc_nulls_last(), F.col(status).asc_nulls_last()])
    return last.filter((F.col(maturity) < F.lit(as_of).cast("date")) & ~F.col(status).isin(*closed) & (F.col(value) >= least))


def _dormant(n: Column, reported: Column, moved: Column, holders: Column, months: int) -> Column:
    quiet = (n == months) & reported & (moved == 0)
    return F.when(quiet & (holders == 0), "empty_shell").when(quiet, "parked_capital")


def dormant(fact: DataFrame, end: str, months: int) -> DataFrame:
    """Entities seen in exactly all months of the window, all flows and holders reported and no flow at all."""
    whole = F.col("inflow").isNotNull() & F.col("outflow").isNotNull() & F.col("holders").isNotNull()
    out = in_window(fact, end, months).groupBy("entity").agg(
        F.countDistinct("period").alias("n_months"), F.bool_and(whole).alias("_all"), F.sum(exact("inflow") + exact("outflow")).alias("_moved"), F.max("holders").alias("max_holders"), F.max_by("nav", "period").alias("nav")
    )
    out = out.withColumn("dormancy", _dormant(F.col("n_months"), F.col("_all"), F.col("_moved"), F.col("max_holders"), months))
    return out.filter("dormancy is not null").select("entity", "dormancy", "max_holders", "nav")


def dormant_trend(fact: DataFrame, months: int) -> DataFrame:
    """Dormant entities by period: the same rule over a window of months that rolls along each entity."""
    at = F.year("period") * 12 + F.month("period")
    w = Window.partitionBy("entity").orderBy("_at").rangeBetween(-(months - 1), 0)
    whole = (F.col("inflow").isNotNull() & F.col("outflow").isNotNull() & F.col("holders").isNotNull()).cast("int")
    rolled = fact.withColumn("_at", at).select("period", "entity", F.count("*").over(w).alias("n"), (F.min(whole).over(w) == 1).alias("whole"), F.sum(exact("inflow") + exact("outflow")).over(w).alias("moved"), F.max("holders").over(w).alias("most"))
    kind = _dormant(F.col("n"), F.col("whole"), F.col("moved"), F.col("most"), months)
    return rolled.withColumn("dormancy", kind).groupBy("period").agg(F.count_if(F.col("dormancy") == "empty_shell").alias("empty_shells"), F.count_if(F.col("dormancy") == "parked_capital").alias("parked"), F.count("*").alias("n_entities"))


def drivers(fact: DataFrame, part: str, start: str, end: str, least_months: int, least_sum: float, least_points: float, earliest: str | None = None) -> DataFrame:
    """What drives a rate from the first to the last month of a window: change of the sum and of the percentage, named.

    Windows that begin before a break of the series are refused. Only rows with a positive NAV count.
    """
    if earliest:
        guards.window(F_date(start), F_date(end), F_date(earliest))
    rows = fact.filter(F.col("period").between(F.lit(start).cast("date"), F.lit(end).cast("date")) & (F.col("nav") > 0) & F.col(part).isNotNull())
    pct = F.col(part) / F.col("nav") * 100
    ends = F.struct(F.col(part).alias("v"), pct.alias("p"))
    out = rows.groupBy("entity").agg(F.min_by(ends, "period").alias("a"), F.max_by(ends, "period").alias("b"), F.countDistinct("period").alias("n_months"), F.max("period").alias("last_period")).filter(F.col("n_months") >= least_months)
    out = out.select("entity", (F.col("b.v") - F.col("a.v")).alias("d_sum"), (F.col("b.p") - F.col("a.p")).alias("d_points"), "n_months", (F.col("last_period") < month(F.lit(end))).alias("stopped_reporting"))
    up, steep = F.col("d_sum") >= least_sum, F.col("d_points") >= least_points
    name = F.when(up & steep, "consistent_worsening").when(up, "value_up_rate_masked").when(steep, "denominator_only")
    return out.withColumn("driver", name.when((F.col("d_sum") <= -least_sum) & (F.col("d_points") <= -least_points), "improvement").otherwise("stable"))


def F_date(text: str):
    """A date from ISO text."""
    from datetime import date

    return date.fromisoformat(text)


def late_filers(filings: DataFrame, days: int = 15, least_days: int = 5, least_late: int = 2) -> DataFrame:
    """Entities whose first filings for a month came after month end plus ``days``, at least ``least_late`` times by
    ``least_days`` days. ``filings``: entity, period, delivered (dates)."""
    first = filings.groupBy("entity", "period").agg(F.min("delivered").alias("delivered"))
    late = first.withColumn("lag", F.datediff("delivered", F.date_add(F.last_day("period"), days)))
    out = late.groupBy("entity").agg(F.count("*").alias("n_filed"), F.count_if(F.col("lag") >= least_days).alias("n_late"), pct_cont("lag", 0.5).alias("median_lag"), F.max("lag").alias("max_lag"))
    return out.filter(F.col("n_late") >= least_late)


def silent_filers(fact: DataFrame, latest: str, least: int, most: int) -> DataFrame:
    """Entities whose last filing lies ``least`` to ``most`` months before the latest complete period."""
    last = fact.groupBy("entity").agg(F.max("period").alias("last_period"))
    gap = (F.year(F.lit(latest).cast("date")) - F.year("last_period")) * 12 + F.month(F.lit(latest).cast("date")) - F.month("last_period")
    return last.withColumn("silent_months", gap).filter(F.col("silent_months").between(least, most))


def restatements(docs: DataFrame, entity: str, key: Sequence[str], version: str, kind: str, least: int, least_pct: float) -> DataFrame:
    """Per entity: documents, those with more than one version, the rate, and the kinds restated; thresholds after that."""
    per = docs.groupBy(entity, *key, kind).agg(F.count("*").alias("_n"))
    again = F.col("_n") > 1
    out = per.groupBy(entity).agg(F.count("*").alias("n_docs"), F.count_if(again).alias("n_restated"), F.array_join(F.array_sort(F.collect_set(F.when(again, F.col(kind)))), ",").alias("kinds"))
    out = out.withColumn("rate_pct", 100 * safe_div("n_restated", "n_docs"))
    return out.filter((F.col("n_restated") >= least) & (F.col("rate_pct") >= least_pct))


def severity(value: Column, moderate: float, attention: float) -> Column:
    return F.when(value.isNull(), None).when(value > attention, "atencao").when(value > moderate, "moderado").otherwise("baixo")


def with_parameters(df: DataFrame, **given) -> DataFrame:
    """A screen's rows with its parameters as JSON beside them."""
    return df.withColumn("parameters", F.to_json(F.struct(*[F.lit(v).alias(k) for k, v in sorted(given.items())])))
