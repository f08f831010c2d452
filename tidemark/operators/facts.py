"""Monthly facts, dimensions, completeness and coverage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.core import exact, latest_by, month, total, unpivot
from tidemark.functions.ranges import joined_by, percentiles_of

#: Share of the trailing median of filers that makes a period complete.
COMPLETE, TRAILING = 0.80, 6


def entity_month_fact(daily: DataFrame) -> DataFrame:
    """One row per entity and month from daily rows (entity, subclass, day, nav, quota, inflow, outflow, holders).

    Flows are summed over all days of the month, also those without a NAV. Then the newest day with a NAV of each
    subclass counts: NAV and holders are summed over subclasses, and the quota is that of one subclass for good, the one
    with the latest period, then the largest NAV, then the smallest name among rows with a positive quota.
    Days are summed up by entity, month and subclass before any shuffle; the windows see monthly rows only.
    """
    per = daily.withColumn("period", month("day")).groupBy("entity", "period", "subclass").agg(
        F.sum(exact("inflow")).alias("_in"),
        F.sum(exact("outflow")).alias("_out"),
        F.max_by(F.struct("nav", "quota", "holders"), F.when(F.col("nav").isNotNull(), F.struct("day", "nav", "quota", "holders"))).alias("_last"),
    )
    flows = Window.partitionBy("entity", "period")
    rows = per.withColumns({"in_month": F.sum("_in").over(flows), "out_month": F.sum("_out").over(flows)})
    last = rows.filter("_last is not null").select("entity", "period", "subclass", "in_month", "out_month", "_last.*")
    chosen = Window.partitionBy("entity").orderBy((F.coalesce(F.col("quota"), F.lit(0.0)) > 0).desc(), F.col("period").desc(), F.col("nav").desc_nulls_last(), F.col("subclass"))
    last = last.withColumn("_class", F.first("subclass").over(chosen))
    return last.groupBy("entity", "period").agg(
        total("nav").alias("nav"),
        F.max(F.when((F.col("subclass") == F.col("_class")) & (F.col("quota") > 0), F.col("quota"))).alias("quota"),
        F.sum("holders").alias("holders"),
        F.max("in_month").cast("double").alias("inflow"),
        F.max("out_month").cast("double").alias("outflow"),
    )


def period_completeness(fact: DataFrame, as_of: str) -> DataFrame:
    """period, n_entities, trailing_median, is_complete: the month has ended by ``as_of`` and at least 0.80 of the median
    of the six periods before filed; without any before, ended suffices. The window runs over one row per period."""
    counts = fact.groupBy("period").agg(F.countDistinct("entity").alias("n_entities"))
    before = Window.orderBy("period").rowsBetween(-TRAILING, -1)
    out = counts.withColumn("trailing_median", F.percentile("n_entities", F.lit(0.5)).over(before))
    ended = F.last_day("period") < F.lit(as_of).cast("date")
    enough = F.coalesce(F.col("n_entities") >= COMPLETE * F.col("trailing_median"), F.lit(True))
    return out.withColumn("is_complete", ended & enough)


def latest_complete_period(completeness: DataFrame, as_of: str) -> DataFrame:
    """One row: the latest complete period, else the month before ``as_of``."""
    return completeness.agg(F.coalesce(F.max(F.when(F.col("is_complete"), F.col("period"))), F.add_months(month(F.lit(as_of)), -1)).alias("period"))


def metric_coverage(fact: DataFrame, metrics: Sequence[str], family: str = "family") -> DataFrame:
    """First and last period, filed and total rows of each metric by family; metrics that were never filed are left out."""
    long = unpivot(fact.select(family, "period", *[F.col(m).cast("double").alias(m) for m in metrics]), [family, "period"], metrics)
    filed = F.col("value").isNotNull()
    out = long.groupBy(family, "metric").agg(F.min(F.when(filed, F.col("period"))).alias("first_period"), F.max(F.when(filed, F.col("period"))).alias("last_period"), F.count("value").alias("filed_rows"), F.count("*").alias("total_rows"))
    return out.filter("filed_rows > 0")


def dim_entity(families: dict[str, DataFrame], registry: DataFrame | None = None, excluded: DataFrame | None = None) -> DataFrame:
    """First and last period and number of periods of each entity, over families that have (entity, period)."""
    out: DataFrame | None = None
    for family, rows in families.items():
        one = rows.groupBy("entity").agg(F.min("period").alias("first_period"), F.max("period").alias("last_period"), F.countDistinct("period").alias("n_periods")).withColumn("family", F.lit(family))
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError("no family given")
    if excluded is not None:
        out = out.join(excluded, "entity", "left_anti")
    return out if registry is None else out.join(registry, "entity", "left")


def dim_series(rows: DataFrame, keys: Sequence[str], day: str, texts: Sequence[str]) -> DataFrame:
    """One row per series: first and last day, the greatest of each text (not the latest), distinct days."""
    return rows.groupBy(*keys).agg(F.min(day).alias("first_day"), F.max(day).alias("last_day"), *[F.max(t).alias(t) for t in texts], F.countDistinct(day).alias("n_days"))


def series_month_fact(rows: DataFrame, flows: DataFrame, series: str, group: str, day: str, value: str, flow: str) -> DataFrame:
    """The newest row of each series and month, with its group's monthly flow beside it (repeated for each series)."""
    last = latest_by(rows.withColumn("period", month(day)), [series, "period"], [F.col(day).desc(), F.col(value).desc_nulls_last()])
    sums = flows.withColumn("period", month(day)).groupBy(group, "period").agg(total(flow).alias("flow"))
    return last.join(sums, [group, "period"], "left").select(series, group, "period", F.col(value).cast("double").alias("value"), "flow")


def latest_version(rows: DataFrame, keys: Sequence[str], version: str, ties: Sequence[str] = ()) -> DataFrame:
    """The row of the highest version of each key."""
    return latest_by(rows, keys, [F.col(version).desc(), *[F.col(t).asc() for t in ties]])


def latest_with_age(rows: DataFrame, keys: Sequence[str], day: str, as_of: str, ties: Sequence[str] = (), unit: str = "days") -> DataFrame:
    """The newest row of each key, with its age at ``as_of`` in days or whole months."""
    out = latest_by(rows, keys, [F.col(day).desc(), *[F.col(t).asc() for t in ties]])
    end = F.lit(as_of).cast("date")
    age = F.datediff(end, F.col(day)) if unit == "days" else F.floor(F.months_between(end, F.col(day))).cast("int")
    return out.withColumn(f"age_{unit}", age)


def mode_by(rows: DataFrame, key: str, value: str, into: str = "mode") -> DataFrame:
    """The most frequent value of each key, and how often it occurs; ties go to the smaller value."""
    counts = rows.filter(F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("n"))
    best = F.min(F.struct((-F.col("n")).alias("n"), F.col(value).alias("v")))
    return counts.groupBy(key).agg(best.alias("b")).select(key, F.col("b.v").alias(into), (-F.col("b.n")).alias("n"))


def activity_grains(rows: DataFrame, grains: Sequence[Sequence[str]], value: str, distinct: str) -> DataFrame:
    """Rows, sum, distinct count and median of ``value`` at several grains at once (GROUPING SETS), labelled by the
    columns that a grain has."""
    columns = sorted({c for g in grains for c in g})
    if len(grains) < 2:
        raise ValueError("give two grains or more")
    label = F.concat_ws("+", *[F.when(F.grouping(c) == 0, F.lit(c)) for c in columns])
    sets = [[F.col(c) for c in g] for g in grains]
    out = rows.groupingSets(sets, *[F.col(c) for c in columns]).agg(label.alias("grain"), F.count("*").alias("n_rows"), total(value).alias("total"), F.countDistinct(distinct).alias("n_distinct"))
    # medians by ranges: equal values of the finest grain are counted once, then counted on for each grain
    fine = rows.groupBy(*columns, F.col(value).cast("double").alias("_value")).agg(F.count("*").alias("_n"))
    kinds = [F.struct(F.lit("+".join(c for c in columns if c in g)).alias("grain"), *[(F.col(c) if c in g else F.lit(None)).alias(c) for c in columns]) for g in grains]
    counts = fine.select(F.explode(F.array(*kinds)).alias("_by"), "_value", "_n").groupBy("_by", "_value").agg(F.sum("_n").alias("_n"))
    keys = ["grain", *columns]
    return joined_by(out, percentiles_of(counts, keys, {"median": 0.5}), keys).select(*keys, "n_rows", "total", "n_distinct", "median")


def instrument_activity(families: dict[str, tuple[DataFrame, str]], as_of: str) -> DataFrame:
    """First and last period and rows by instrument; active if the last is recent: for yearly families since January of
    last year, else within three months before ``as_of``'s month."""
    end = F.lit(as_of).cast("date")
    out: DataFrame | None = None
    for family, (rows, frequency) in families.items():
        since = F.add_months(F.trunc(end, "YEAR"), -12) if frequency == "year" else F.add_months(month(end), -3)
        one = rows.groupBy("entity").agg(F.min("period").alias("first_period"), F.max("period").alias("last_period"), F.count("*").alias("n_rows"))
        one = one.withColumns({"family": F.lit(family), "is_active": F.col("last_period") >= since})
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError("no family given")
    return out


def stock_and_flow(stock: DataFrame, flow: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Stocks and flows of the same keys side by side; either may be missing (full outer join)."""
    return stock.join(flow, list(keys), "full_outer")


def manager_dim(registry: DataFrame, fact: DataFrame, manager: str) -> DataFrame:
    """Entities, active entities and latest assets by manager. ``registry``: entity, active and the manager's column."""
    newest = latest_by(fact.filter("nav is not null"), ["entity"], [F.col("period").desc()]).select("entity", "nav")
    own = registry.join(newest, "entity", "left")
    return own.groupBy(manager).agg(F.countDistinct("entity").alias("n_entities"), F.countDistinct(F.when(F.col("active"), F.col("entity"))).alias("n_active"), F.coalesce(total("nav"), F.lit(0.0)).alias("aum"))


def category(c: Column, rules: Sequence[tuple[str, str]], other: str) -> Column:
    """The label of the first pattern (case-insensitive LIKE) that fits, else ``other``."""
    out = None
    for pattern, label in rules:
        out = F.when(c.ilike(pattern), label) if out is None else out.when(c.ilike(pattern), label)
    return F.lit(other) if out is None else out.otherwise(other)


def monthly_savings(flows: DataFrame, levels: DataFrame, rates: DataFrame) -> DataFrame:
    """Monthly inflow and outflow by vehicle, month-end level, and the last rate of the month."""
    moved = flows.withColumn("period", month("day")).groupBy("vehicle", "period").agg(total("inflow").alias("inflow"), total("outflow").alias("outflow"))
    held = latest_by(levels.withColumn("period", month("day")), ["vehicle", "entity", "period"], [F.col("day").desc(), F.col("level").desc()])
    stock = held.groupBy("vehicle", "period").agg(total("level").alias("aum"))
    last = latest_by(rates.withColumn("period", month("day")), ["period"], [F.col("day").desc(), F.col("rate").desc()]).select("period", F.col("rate").cast("double").alias("rate"))
    return stock_and_flow(stock, moved, ["vehicle", "period"]).join(last, "period", "left")
