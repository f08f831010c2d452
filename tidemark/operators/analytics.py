"""Trends, rankings, distributions, concentration and coverage over an entity-month fact."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.core import as_column, exact, latest_by, month, months_mod_12, pct_cont, rank_top, safe_div, total
from tidemark.functions.ranges import joined_by, percentiles


def profile(fact: DataFrame, as_of: str, quiet_days: int = 90) -> DataFrame:
    """Per entity: periods, peak NAV, latest NAV that isn't null with its period, and whether it filed of late."""
    has = F.col("nav").isNotNull()
    return fact.groupBy("entity").agg(
        F.min("period").alias("first_period"),
        F.max("period").alias("last_period"),
        F.max("nav").alias("peak_nav"),
        F.max_by("nav", F.when(has, F.col("period"))).alias("latest_nav"),
        F.max(F.when(has, F.col("period"))).alias("latest_nav_period"),
    ).withColumn("is_active", F.col("last_period") >= F.date_sub(F.lit(as_of).cast("date"), quiet_days))


def search(entities: DataFrame, fact: DataFrame, query: str, limit: int = 50) -> DataFrame:
    """Entities whose id or name holds the text, largest latest NAV first, nulls last, then by id."""
    found = entities.filter(F.col("name").ilike(f"%{query}%") | F.col("entity").cast("string").ilike(f"%{query}%"))
    newest = fact.filter("nav is not null").join(found.select("entity"), "entity", "left_semi").groupBy("entity").agg(F.max_by("nav", "period").alias("latest_nav"))
    return found.join(newest, "entity", "left").orderBy(F.col("latest_nav").desc_nulls_last(), "entity").limit(limit)


def new_per_period(dim: DataFrame, start: str, end: str, by: str = "family") -> DataFrame:
    """Entities that first appear, by month and family."""
    rows = dim.filter(F.col("first_period").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    return rows.groupBy(month("first_period").alias("period"), by).agg(F.count("*").alias("n_new"))


def flow_trend(fact: DataFrame) -> DataFrame:
    """Net flow, running net flow and redemptions over NAV of each entity."""
    w = Window.partitionBy("entity").orderBy("period").rowsBetween(Window.unboundedPreceding, 0)
    net = exact("inflow") - exact("outflow")
    return fact.select("entity", "period", net.cast("double").alias("net_flow"), F.sum(net).over(w).cast("double").alias("cumulative"), safe_div("outflow", "nav").alias("pressure"))


def industry_trend(fact: DataFrame, by: Sequence[str] = ("period", "family")) -> DataFrame:
    return fact.groupBy(*by).agg(total("nav").alias("aum"), F.countDistinct("entity").alias("n_entities"), F.sum(exact("inflow") - exact("outflow")).cast("double").alias("net_flow"))


def distribution(rows: DataFrame, value: str, benchmark: float | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Exact percentiles, mean, sample deviation, count, and count and spread above a benchmark."""
    v = F.col(value)
    shares = {f"p{p}": p / 100 for p in (10, 25, 50, 75, 90)}
    aggs = [F.avg(v).alias("mean"), F.stddev_samp(v).alias("sd"), F.count(v).alias("n")]
    if benchmark is not None:
        aggs.append(F.count_if(v > benchmark).alias("n_above"))
    out = joined_by(rows.groupBy(*by).agg(*aggs), percentiles(rows, by, value, shares), by)
    names = [*by, *shares, "mean", "sd", "n"]
    return out.select(*names) if benchmark is None else out.select(*names, "n_above", (F.col("p50") - benchmark).alias("spread"))


def ranking(fact: DataFrame, metrics: dict[str, Column], metric: str, limit: int, within: Sequence[str] = ()) -> DataFrame:
    """Rank of entities by a chosen metric, ties kept."""
    if metric not in metrics:
        raise ValueError(f"unknown metric {metric}")
    return rank_top(fact.withColumn("value", metrics[metric]), "value", limit, within=within)


def concentration(rows: DataFrame, value: str, by: Sequence[str] = (), tops: Sequence[int] = (5, 10, 20)) -> DataFrame:
    """Herfindahl index times 10,000 and the shares of the largest; equal values share a rank, so that a top may hold more."""
    if by:  # sums are combined before the shuffle, and only rows of the largest ranks of each group go to its window
        square = exact(value) * exact(value)
        sums = rows.groupBy(*by).agg(total(value).alias("_total"), F.sum(square).cast("double").alias("_squares"), F.count(value).alias("n"))
        rank = F.rank().over(Window.partitionBy(*by).orderBy(F.col(value).desc_nulls_last()))
        largest = rows.withColumn("_rank", rank).filter(F.col("_rank") <= max(tops))
        held = largest.groupBy(*by).agg(*[total(F.when(F.col("_rank") <= k, F.col(value))).alias(f"_top{k}") for k in tops])
        both = sums.join(held, list(by), "left")
        return both.select(*by, (safe_div("_squares", F.col("_total") * F.col("_total")) * 10000).alias("hhi"), *[safe_div(f"_top{k}", "_total").alias(f"top{k}") for k in tops], "n")
    # the total and the edges of the tops are found by distributed aggregation, not by a window over all rows
    edges = rows.filter(F.col(value).isNotNull()).orderBy(F.col(value).desc()).limit(max(tops)).agg(F.sort_array(F.collect_list(value), False).alias("_top"))
    ranked = rows.crossJoin(F.broadcast(rows.agg(total(value).alias("_total")))).crossJoin(F.broadcast(edges))  # one row each
    ranked = ranked.withColumn("_rank", F.when(F.array_position("_top", F.col(value)) > 0, F.array_position("_top", F.col(value))).otherwise(F.lit(1 << 30)))
    share = safe_div(value, "_total")
    return ranked.groupBy(*by).agg((F.sum(share * share) * 10000).alias("hhi"), *[(total(F.when(F.col("_rank") <= k, F.col(value))) / F.first("_total")).alias(f"top{k}") for k in tops], F.count(value).alias("n"))


def cross_family(fact: DataFrame, metric: str) -> DataFrame:
    """One value per family and period: assets summed, flows summed, or the median yield."""
    value = {"aum": total("nav"), "flow": F.sum(exact("inflow") - exact("outflow")).cast("double"), "yield": pct_cont(safe_div("inflow", "nav"), 0.5)}
    if metric not in value:
        raise ValueError(f"unknown metric {metric}")
    return fact.groupBy("family", "period").agg(value[metric].alias("value"))


def holders_trend(fact: DataFrame, by: Sequence[str] = ("period",)) -> DataFrame:
    return fact.groupBy(*by).agg(F.sum("holders").alias("holders"), F.avg("holders").alias("mean_holders"), F.countDistinct(F.when(F.col("holders").isNotNull(), F.col("entity"))).alias("n_entities"))


def rate_trend(rows: DataFrame, part: str, whole: str, threshold: float = 0.05) -> DataFrame:
    """Mean rate, sums, shares with any and with more than a threshold, and the change of the mean on the month before.
    The lag runs over one row per period, after aggregation."""
    rate = safe_div(part, whole)
    out = rows.groupBy("period").agg(F.avg(rate).alias("mean_rate"), total(part).alias("part"), total(whole).alias("whole"), F.avg(F.when(F.col(part) > 0, 1.0).otherwise(0.0)).alias("share_any"), F.avg(F.when(rate > threshold, 1.0).otherwise(0.0)).alias("share_above"))
    return out.withColumn("change", F.col("mean_rate") - F.lag("mean_rate").over(Window.orderBy("period")))


def conditional_share(rows: DataFrame, by: Sequence[str], value: str, label: str, patterns: Sequence[str]) -> DataFrame:
    """Sum of what any pattern names, over all; null unless the ratio lies in 0 to 1."""
    named = F.lit(False)
    for p in patterns:
        named = named | F.col(label).ilike(p)
    out = rows.groupBy(*by).agg(F.count_if(named).alias("n_named"), F.count("*").alias("n"), F.coalesce(total(F.when(named, F.col(value))), F.lit(0.0)).alias("named"), total(value).alias("whole"))
    ratio = safe_div("named", "whole")
    return out.withColumn("ratio", F.when(ratio.between(0, 1), ratio))


def issuance_trend(rows: DataFrame, day: str, value: str, status: str, statuses: Sequence[str]) -> DataFrame:
    """Series, volume and counts by status (none: null status) by month."""
    counts = [F.count_if(F.col(status) == s).alias(f"n_{s.lower()}") for s in statuses]
    return rows.groupBy(month(day).alias("period")).agg(F.count("*").alias("n"), total(value).alias("volume"), *counts, F.count_if(F.col(status).isNull()).alias("n_none"))


def maturity_ladder(rows: DataFrame, maturity: str, as_of: str, value: str, years: Sequence[int] = (1, 3, 5)) -> DataFrame:
    """Count and sum by years left: up to each step, beyond the last, matured, and without a maturity."""
    day, end = as_column(maturity).cast("date"), F.lit(as_of).cast("date")
    bucket = F.when(day.isNull(), "perpetual").when(day < end, "matured")
    low = 0
    for y in years:
        bucket = bucket.when(day < F.add_months(end, 12 * y), f"{low}-{y}y")
        low = y
    return rows.groupBy(bucket.otherwise(f"{low}y+").alias("bucket")).agg(F.count("*").alias("n"), total(value).alias("total"))


def latest_credible_period(rows: DataFrame, least: float = 0.5) -> DataFrame:
    """One row: the newest period that has at least half as many rows as the period before it."""
    counts = rows.groupBy("period").agg(F.count("*").alias("n")).withColumn("_before", F.lag("n").over(Window.orderBy("period")))
    return counts.filter(F.col("n") >= least * F.coalesce("_before", F.lit(0))).agg(F.max("period").alias("period"))


def distressed(rows: DataFrame, status: str, statuses: Sequence[str]) -> DataFrame:
    """Rows of the latest credible period with one of the statuses."""
    return rows.join(F.broadcast(latest_credible_period(rows)), "period", "left_semi").filter(F.col(status).isin(*statuses))  # one row


def data_coverage(rows: DataFrame, family: str, as_of: str) -> DataFrame:
    """Entities by family, last period, and the months part of the age since then (modulo 12)."""
    out = rows.groupBy(family).agg(F.countDistinct("entity").alias("n_entities"), F.min("period").alias("first_period"), F.max("period").alias("last_period"))
    return out.withColumn("months_since", months_mod_12(F.lit(as_of).cast("date"), "last_period"))


def ingest_summary(log: DataFrame, source: str, status: str, rows: str, at: str) -> DataFrame:
    """Runs by outcome, rows, latest start and the latest failed start of each source."""
    failed = F.col(status) == "error"
    return log.groupBy(source).agg(F.count_if(F.col(status) == "ok").alias("n_ok"), F.count_if(failed).alias("n_error"), F.sum(F.when(F.col(status) == "ok", F.col(rows))).alias("rows"), F.max(at).alias("last_at"), F.max(F.when(failed, F.col(at))).alias("last_error_at"))


def class_performance(fact: DataFrame, cls: str, rate: str, benchmark: float) -> DataFrame:
    out = fact.groupBy("period", cls).agg(F.countDistinct("entity").alias("n_entities"), total("nav").alias("aum"), pct_cont(rate, 0.5).alias("median_rate"))
    return out.withColumn("spread", F.col("median_rate") - benchmark)


def manager_ranking(fact: DataFrame, manager: str, period: str, metric: str, limit: int) -> DataFrame:
    """Managers at one period, ranked by assets, entities or holders; rank within ties, rows limited by rank then name."""
    own = fact.filter(F.col("period") == F.lit(period).cast("date"))
    out = own.groupBy(manager).agg(total("nav").alias("aum"), F.countDistinct("entity").alias("entities"), F.sum("holders").alias("holders"))
    return rank_top(out, metric, limit).orderBy("rank", manager).limit(limit)


def monthly_from_annual(rate: Column) -> Column:
    """A year's rate in percent as the month's, to six digits."""
    return F.round((F.pow(1 + rate / 100, F.lit(1 / 12)) - 1) * 100, 6)


def aging_buckets(rows: DataFrame, keys: Sequence[str], days: str, value: str, edges: Sequence[int]) -> DataFrame:
    """Shares of value by days overdue, in percent to two digits, and the sum beyond the last edge."""
    aggs, low = [total(value).alias("overdue")], 0
    for e in edges:
        aggs.append(F.coalesce(total(F.when((F.col(days) > low) & (F.col(days) <= e), F.col(value))), F.lit(0.0)).alias(f"d{e}"))
        low = e
    aggs.append(F.coalesce(total(F.when(F.col(days) > low, F.col(value))), F.lit(0.0)).alias("long_tail"))
    out = rows.filter(F.col(days) > 0).groupBy(*keys).agg(*aggs)
    return out.select(*keys, "overdue", "long_tail", *[F.round(safe_div(f"d{e}", "overdue") * 100, 2).alias(f"pct_d{e}") for e in edges], F.round(safe_div("long_tail", "overdue") * 100, 2).alias("pct_long"))


def acceleration_screen(rows: DataFrame, rate: str, period: str, months: int, least: float) -> DataFrame:
    """Entities whose rate rose by ``least`` points or more over some months (self join of two snapshots)."""
    now = rows.filter(F.col("period") == F.lit(period).cast("date")).select("entity", F.col(rate).alias("now"))
    then = rows.filter(F.col("period") == F.add_months(F.lit(period).cast("date"), -months)).select("entity", F.col(rate).alias("then"))
    out = now.join(then, "entity").withColumn("delta", F.col("now") - F.col("then"))
    return out.filter(F.col("delta") >= least)


def entity_years(rows: DataFrame) -> DataFrame:
    """Yearly filers: the newest filing of each class and year, summed, dated the year's last day."""
    own = rows.withColumn("_year", F.year("day"))
    last = latest_by(own, ["entity", "_year", "subclass"], [F.col("day").desc(), F.col("nav").desc_nulls_last(), F.col("holders").desc()])
    return last.groupBy("entity", F.make_date("_year", F.lit(12), F.lit(31)).alias("period")).agg(total("nav").alias("nav"), F.sum("holders").alias("holders"))
