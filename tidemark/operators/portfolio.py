"""Sections of a portfolio diagnosis: allocation, ladders, fees, taxes, peers, equivalents, unit-price chains."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import guards
from tidemark.functions.core import exact, latest_by, pct_cont, safe_div, total

#: Days of the maturity ladder's steps; the guarantee limit; brackets of tax by days held; days of the levy on early gains.
LADDER = (0, 365, 730, 1826, 3652)
GUARANTEE = 250_000
BRACKETS = ((180, 0.225), (360, 0.20), (720, 0.175), (None, 0.15))
LEVY_DAYS = 30


def allocation(lines: DataFrame, by: Sequence[str], cls: str) -> DataFrame:
    """Value and share of each class; lines without a class are ``unclassified``, which sorts last."""
    out = lines.groupBy(*by, F.coalesce(F.col(cls), F.lit("unclassified")).alias("class")).agg(total("value").alias("value"))
    w = Window.partitionBy(*by)
    place = F.row_number().over(w.orderBy(F.col("class") == "unclassified", F.col("value").desc(), "class"))
    return out.withColumns({"share": safe_div("value", F.sum(exact("value")).over(w)), "place": place})


def consolidated(lines: DataFrame, keys: Sequence[str], accounts: str) -> DataFrame:
    """Lines of several accounts merged on their identity; values add up exactly to those given, or it is refused."""
    out = lines.groupBy(*keys).agg(total("value").alias("value"), F.countDistinct(accounts).alias("n_accounts"), F.count("*").alias("n_lines"))
    sums = out.agg(F.sum(exact("value")).alias("a")).first()["a"], lines.agg(F.sum(exact("value")).alias("a")).first()["a"]
    if sums[0] != sums[1]:
        raise guards.Refused(f"values don't add up: {sums[0]} and {sums[1]}")
    return out


def bucket(days: Column, edges: Sequence[int], none: str = "none") -> Column:
    """The label of the first edge that days don't exceed."""
    out = F.when(days.isNull(), none)
    for e in edges:
        out = out.when(days <= e, f"<={e}")
    return out.otherwise(f">{edges[-1]}")


def maturity_ladder(lines: DataFrame, by: Sequence[str], maturity: str, position: str) -> DataFrame:
    days = F.datediff(F.col(maturity), F.lit(position).cast("date"))
    return lines.groupBy(*by, bucket(days, LADDER).alias("bucket")).agg(total("value").alias("value"), F.count("*").alias("n"))


def guarantee_by_issuer(lines: DataFrame, by: Sequence[str], issuer: str, limit: float = GUARANTEE) -> DataFrame:
    """Sum by holder and issuer, flagged where it passes the limit of the deposit guarantee."""
    out = lines.groupBy(*by, issuer).agg(total("value").alias("value"))
    return out.withColumn("over_limit", F.col("value") > limit)


def liquidity_bucket(kind: Column, lock_up: Column, days: Column) -> Column:
    """Kinds with a market of their own first, then lock-ups, then days until payment; no term is its own bucket."""
    own = F.when(kind.isin("cash", "treasury", "credit", "exchange"), kind)
    return own.when(lock_up > 0, "lock_up").when(days.isNull(), "no_term").when(days <= 5, "<=5").when(days <= 30, "<=30").otherwise(">30")


def top_exposures(rows: DataFrame, by: Sequence[str], key: str, n: int) -> DataFrame:
    """The largest exposures of each portfolio with their share of it; ties by key."""
    sums = rows.groupBy(*by, key).agg(total("value").alias("value"))
    w = Window.partitionBy(*by)
    out = sums.withColumns({"share": safe_div("value", F.sum(exact("value")).over(w)), "rank": F.row_number().over(w.orderBy(F.col("value").desc(), key))})
    return out.filter(F.col("rank") <= n)


def by_rules(text: Column, exact_rules: dict[str, str], patterns: Sequence[tuple[str, str]], other: str = "unclassified") -> Column:
    """A label by exact key first, then by the first pattern that fits."""
    out = F.when(text.isNull(), other)
    for key, label in exact_rules.items():
        out = out.when(text == key, label)
    for pattern, label in patterns:
        out = out.when(text.rlike(pattern), label)
    return out.otherwise(other)


def tax(lines: DataFrame, day: str, bought: str, gain: str, exempt: str) -> DataFrame:
    """Adds days held, the bracket's rate, the levy's share of early gains, the tax, and the taxable equivalent of exempt gains."""
    days = F.datediff(F.col(day), F.col(bought))
    rate = None
    for most, r in BRACKETS:
        step = F.lit(r)
        rate = F.when(days <= most, step) if rate is None else (rate.when(days <= most, step) if most is not None else rate.otherwise(step))
    levy = F.when((days >= 0) & (days < LEVY_DAYS), F.floor((LEVY_DAYS - days) * 100 / LEVY_DAYS) / 100).otherwise(0.0)
    gained = F.greatest(F.col(gain), F.lit(0.0))
    due = F.when(F.col(exempt), 0.0).otherwise(gained * levy + gained * (1 - levy) * rate)
    return lines.withColumns({"days": days, "rate": rate, "levy": levy, "tax": due, "gross_up": F.when(F.col(exempt), F.col(gain) / (1 - rate))})


def fees(funds: DataFrame, sources: Sequence[DataFrame], month_end: str, valid: tuple[float, float] = (0.0, 5.0)) -> DataFrame:
    """The disclosed fee of each fund by priority of source: the newest filing of the first source that has a plausible one.
    ``sources``: entity, day, fee. A fee of 0 is as filed; negative or too large ones are hidden."""
    out = funds.select("entity")
    at = F.lit(month_end).cast("date")
    for i, source in enumerate(sources):
        own = latest_by(source.filter((F.col("day") <= at) & F.col("fee").between(*valid)), ["entity"], [F.col("day").desc(), F.col("fee").asc()])
        out = out.join(own.select("entity", F.col("fee").alias(f"_f{i}")), "entity", "left")
    fee, name = F.coalesce(*[F.col(f"_f{i}") for i in range(len(sources))]), F.coalesce(*[F.when(F.col(f"_f{i}").isNotNull(), F.lit(i)) for i in range(len(sources))])
    return out.select("entity", fee.alias("fee"), name.alias("source"))


def fee_estimate(rows: DataFrame) -> DataFrame:
    """A yearly fee in percent from an accumulated expense (negative, reset each fiscal year): the month's change times 12
    over NAV; in a reset month the amount itself; an increase is unknown. ``rows``: entity, period, acc, nav."""
    w = Window.partitionBy("entity").orderBy("period")
    before = F.lag("acc").over(w)
    consecutive = F.add_months(F.lag("period").over(w), 12) >= F.col("period")
    month = F.when(F.month("period") == 1, -F.col("acc")).when(consecutive & (F.col("acc") <= before), before - F.col("acc"))
    return rows.withColumn("fee", safe_div(month * 12, "nav") * 100)


def peers(funds: DataFrame, cell: str, value: str, valid: tuple[float, float] = (0.0, 5.0), least: int = 30) -> DataFrame:
    """Quartiles of usable values (above the lower and up to the upper bound) in each class; null below ``least``."""
    ok = (F.col(value) > valid[0]) & (F.col(value) <= valid[1])
    v = F.when(ok, F.col(value))
    out = funds.groupBy(cell).agg(F.count(v).alias("n"), F.count_if(~ok | F.col(value).isNull()).alias("n_excluded"), *[pct_cont(v, p / 100).alias(f"p{p}") for p in (25, 50, 75)])
    return out.select(cell, "n", "n_excluded", *[F.when(F.col("n") >= least, F.col(f"p{p}")).alias(f"p{p}") for p in (25, 50, 75)])


def class_returns(rows: DataFrame, cls: str, months: int, end: str, value: str) -> DataFrame:
    """Quartiles of each class's returns over some months; entities without both ends are counted as excluded."""
    last = F.lit(end).cast("date")
    own = rows.filter((F.col("period") == last) | (F.col("period") == F.add_months(last, -months)))
    ends = own.groupBy("entity", cls).agg(F.max(F.when(F.col("period") == last, F.col(value))).alias("b"), F.max(F.when(F.col("period") != last, F.col(value))).alias("a"))
    ret = safe_div("b", "a") - 1
    return ends.groupBy(cls).agg(F.count(ret).alias("n"), F.count_if(ret.isNull()).alias("n_excluded"), *[pct_cont(ret, p / 100).alias(f"p{p}") for p in (25, 50, 75)])


def equivalents(classes: DataFrame, mapping: DataFrame, funds: DataFrame) -> DataFrame:
    """For each class the largest active fund that is mapped to it, or a reason. ``mapping``: class, ticker; ``funds``: ticker, nav."""
    own = mapping.join(funds, "ticker")
    ranked = own.withColumn("rank", F.row_number().over(Window.partitionBy("class").orderBy(F.col("nav").desc_nulls_last(), "ticker"))).filter("rank = 1")
    found = classes.join(ranked, "class").select("class", "ticker", "nav", F.lit("equivalent").alias("reason"))
    mapped = mapping.select("class").distinct().withColumn("_m", F.lit(True))
    rest = classes.join(ranked.select("class"), "class", "left_anti").join(mapped, "class", "left")
    none = rest.select("class", F.lit(None).cast(mapping.schema["ticker"].dataType).alias("ticker"), F.lit(None).cast("double").alias("nav"), F.when(F.col("_m"), "no active fund").otherwise("no pair").alias("reason"))
    return found.unionByName(none)


def price_chain(rows: DataFrame, key: str, most_repeat: bool = True) -> DataFrame:
    """Monthly factor (price + paid) / price before, with the first flag that applies: ambiguous, missing_month,
    invalid_value, quantity_changed, repeated_price, drop_without_event, payment_above_price, or null.

    ``rows``: key, period, price, paid, qty; a key with two rows in a month is ambiguous.
    """
    one = rows.groupBy(key, "period").agg(F.count("*").alias("_n"), F.max("price").alias("price"), F.max("paid").alias("paid"), F.max("qty").alias("qty"))
    w = Window.partitionBy(key).orderBy("period")
    p, q, at = F.lag("price").over(w), F.lag("qty").over(w), F.lag("period").over(w)
    out = one.withColumns({"_p": p, "_q": q, "_at": at})
    paid = F.coalesce(F.col("paid"), F.lit(0.0))
    flag = (
        F.when(F.col("_n") > 1, "ambiguous")
        .when(F.col("_at").isNull() | (F.col("_at") != F.add_months("period", -1)), "missing_month")
        .when(F.col("price").isNull() | (F.col("price") <= 0) | (F.col("_p") <= 0), "invalid_value")
        .when(~F.col("qty").eqNullSafe(F.col("_q")), "quantity_changed")
        .when((F.col("price") == F.col("_p")) & F.lit(most_repeat), "repeated_price")
        .when((F.col("price") < F.col("_p")) & (paid == 0), "drop_without_event")
        .when(paid > F.col("_p"), "payment_above_price")
    )
    return out.select(key, "period", safe_div(F.col("price") + paid, "_p").alias("factor"), flag.alias("flag"))


def median_price_returns(rows: DataFrame, key: str, least: int = 3, most_drop: float | None = None) -> DataFrame:
    """Median price over holders by month (``least`` holders at least), its change, and whether a drop is pending: any drop
    where no limit is given, else one beyond the limit (percent)."""
    per = rows.groupBy(key, "period").agg(F.count("*").alias("n"), pct_cont("price", 0.5).alias("median")).filter(F.col("n") >= least)
    change = safe_div("median", F.lag("median").over(Window.partitionBy(key).orderBy("period"))) - 1
    out = per.withColumn("change", change)
    limit = 0.0 if most_drop is None else -most_drop / 100
    return out.withColumn("is_pending", F.coalesce(F.col("change") < limit, F.lit(False)))


def fits(rows: DataFrame, declared: dict[str, tuple[str, float]]) -> DataFrame:
    """A row per portfolio and declared limit (column, most): the fact, the limit and whether it holds."""
    checks = F.array(*[F.struct(F.lit(name).alias("constraint"), F.col(c).cast("double").alias("fact"), F.lit(float(most)).alias("most")) for name, (c, most) in declared.items()])
    out = rows.select("portfolio", F.explode(checks).alias("x")).select("portfolio", "x.*")
    return out.withColumn("holds", F.col("fact") <= F.col("most"))
