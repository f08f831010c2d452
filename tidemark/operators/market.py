"""Sessions, turnover, lending legs, adjusted prices, dividends and contracts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.core import latest_by, pct_cont, safe_div, total, weighted

#: Letters of contract months, January to December; kinds of share events whose factor is the ratio itself.
MONTH_LETTERS = "FGHJKMNQUVXZ"
DIRECT = ("GRUPAMENTO",)


def trailing_turnover(bars: DataFrame, n: int = 21) -> DataFrame:
    """Adds mean volume and quantity of the last ``n`` sessions of each ticker, and how many there are."""
    w = Window.partitionBy("ticker").orderBy("day").rowsBetween(-(n - 1), 0)
    return bars.select("ticker", "day", F.avg("volume").over(w).alias("adtv"), F.avg("qty").over(w).alias("adqty"), F.count("*").over(w).alias("n_sessions"))


def newest_float(instruments: DataFrame, weights: DataFrame, priority: Sequence[str]) -> DataFrame:
    """Newest instrument row of each ticker beside its newest index row; of several indices the first in ``priority``.
    Either may be missing."""
    a = latest_by(instruments, ["ticker"], [F.col("day").desc()]).select("ticker", F.col("day").alias("i_day"), "shares")
    at = F.array_position(F.array(*map(F.lit, priority)), F.col("index_code"))
    order = F.when(at > 0, at).otherwise(len(priority) + 1)
    b = latest_by(weights, ["ticker"], [F.col("day").desc(), order, F.col("index_code")]).select("ticker", F.col("day").alias("w_day"), "index_code", "float_shares")
    out = a.join(b, "ticker", "full_outer")
    return out.select("ticker", "shares", "index_code", "float_shares", F.greatest("i_day", "w_day").alias("as_of"))


def short_interest(positions: DataFrame, floats: DataFrame, turnover: DataFrame) -> DataFrame:
    """Open position of each ticker and day: sum, quantity-weighted rate, percent of float, days to cover."""
    own = positions.groupBy("ticker", "day").agg(F.sum("qty").alias("short_qty"), weighted("rate", "qty").alias("rate"))
    out = own.join(floats.select("ticker", "float_shares"), "ticker", "left").join(turnover.select("ticker", "day", "adqty"), ["ticker", "day"], "left")
    return out.select("ticker", "day", "short_qty", "rate", (safe_div("short_qty", "float_shares") * 100).alias("pct_float"), safe_div("short_qty", "adqty").alias("days_to_cover"))


def month_deltas(snapshots: DataFrame, by: Sequence[str], day: str, value: str, calendar: DataFrame) -> DataFrame:
    """Daily amounts from month-to-date snapshots: the first difference within a month. A month's first snapshot counts as
    it is only on the month's first session (``calendar``: day); otherwise the amount is unknown."""
    first = calendar.groupBy(F.trunc(day, "MM").alias("_month")).agg(F.min(day).alias("_open"))
    w = Window.partitionBy(*by, "_month").orderBy(day)
    out = snapshots.withColumn("_month", F.trunc(day, "MM")).withColumn("_before", F.lag(value).over(w)).join(F.broadcast(first), "_month", "left")  # a row per month
    opens = F.col(day) == F.col("_open")
    delta = F.when(F.col("_before").isNotNull(), F.col(value) - F.col("_before")).when(opens, F.col(value))
    basis = F.when(F.col("_before").isNotNull(), "delta").when(opens, "month_open").otherwise("unknown")
    return out.select(*by, day, delta.alias("amount"), basis.alias("basis"))


def lending_trades(trades: DataFrame, by: Sequence[str]) -> DataFrame:
    """Trades summed: count, quantity, weighted mean rate, extremes, distinct legs, and trades of a house with itself
    (two unknown legs count as the same)."""
    return trades.groupBy(*by).agg(
        F.count("*").alias("n_trades"),
        F.sum("qty").alias("qty"),
        weighted("rate", "qty").alias("mean_rate"),
        F.min("rate").alias("min_rate"),
        F.max("rate").alias("max_rate"),
        F.countDistinct("lender").alias("n_lenders"),
        F.countDistinct("borrower").alias("n_borrowers"),
        F.count_if(F.col("lender").eqNullSafe(F.col("borrower"))).alias("n_internal"),
    )


def participant_legs(trades: DataFrame, by: Sequence[str]) -> DataFrame:
    """Both legs of all trades by participant: quantity lent and borrowed, their difference, weighted rates of each leg."""
    leg = lambda who, side: trades.select(*by, F.col(who).alias("participant"), F.lit(side).alias("side"), "qty", "rate")
    both = leg("lender", "lent").unionByName(leg("borrower", "borrowed"))
    on = lambda side, c: F.when(F.col("side") == side, c)
    aggs = []
    for side in ("lent", "borrowed"):
        aggs += [F.coalesce(F.sum(on(side, F.col("qty"))), F.lit(0)).alias(f"{side}_qty"), weighted(on(side, F.col("rate")), "qty").alias(f"{side}_rate")]
    return both.groupBy(*by, "participant").agg(*aggs).withColumn("net_qty", F.col("lent_qty") - F.col("borrowed_qty"))


def share_ratio(kind: Column, factor: Column) -> Column:
    """Shares after an event over shares before: the factor itself for groupings, 1 + factor / 100 for others; null unless
    positive."""
    r = F.when(kind.isin(*DIRECT), factor).otherwise(1 + factor / 100)
    return F.when(r > 0, r)


def adjusted_close(bars: DataFrame, events: DataFrame, anchor: str) -> DataFrame:
    """Adds ``close_adj``: the close over the product of the distinct ratios of events whose last day with rights is the
    bar's day or later, and before ``anchor``; six digits.

    Events (ticker, last_cum, kind, factor) are far fewer than bars: a ticker's become one sorted array of logs, which each of
    its bars sums from its own day on.
    """
    ratios = events.select("ticker", "last_cum", share_ratio(F.col("kind"), F.col("factor")).alias("ratio")).filter(F.col("ratio").isNotNull() & (F.col("last_cum") < F.lit(anchor).cast("date"))).distinct()
    per = ratios.groupBy("ticker").agg(F.sort_array(F.collect_list(F.struct("last_cum", F.log("ratio").alias("ln")))).alias("_events"))
    later = F.aggregate(F.filter("_events", lambda e: e["last_cum"] >= F.col("day")), F.lit(0.0), lambda s, e: s + e["ln"])
    out = bars.join(per, "ticker", "left")
    return out.withColumn("close_adj", F.round(F.col("close") / F.exp(F.coalesce(later, F.lit(0.0))), 6)).drop("_events")


def total_return(bars: DataFrame, cash: DataFrame) -> DataFrame:
    """Adds ``close_tr``: the adjusted close over the product of 1 + cash / close at the ex-day, for payments on later days.
    Null where a later payment has no close. ``cash``: ticker, last_cum, amount, ex_close."""
    factor = F.log1p(safe_div("amount", "ex_close"))
    per = cash.select("ticker", "last_cum", factor.alias("ln")).groupBy("ticker").agg(F.sort_array(F.collect_list(F.struct("last_cum", "ln"))).alias("_cash"))  # summed in one order
    own = F.filter("_cash", lambda e: e["last_cum"] >= F.col("day"))
    known = ~F.exists(own, lambda e: e["ln"].isNull())
    grown = F.aggregate(own, F.lit(0.0), lambda s, e: s + F.coalesce(e["ln"], F.lit(0.0)))
    out = bars.join(per, "ticker", "left")
    return out.withColumn("close_tr", F.when(F.coalesce(known, F.lit(True)), F.round(F.col("close_adj") / F.exp(F.coalesce(grown, F.lit(0.0))), 6))).drop("_cash")


def next_session(events: DataFrame, bars: DataFrame, key: str, day: str, within: int, into: str = "ex_day") -> DataFrame:
    """Adds the first session of the key after ``day``, if it comes within so many days.

    One window over both tables together: each event looks ahead for the next session; nothing is joined by range.
    """
    marks = bars.select(key, F.col("day").alias("_at"), F.lit(True).alias("_bar")).distinct()
    asked = events.select("*", F.col(day).alias("_at"))
    both = asked.unionByName(marks, allowMissingColumns=True)
    w = Window.partitionBy(key).orderBy("_at").rangeBetween(1, within)
    numbered = both.withColumn("_at", F.datediff("_at", F.lit("1970-01-01").cast("date")))
    found = numbered.withColumn("_next", F.min(F.when(F.col("_bar"), F.col("_at"))).over(w)).filter("_bar is null")
    return found.withColumn(into, F.date_add(F.lit("1970-01-01").cast("date"), F.col("_next").cast("int"))).drop("_at", "_bar", "_next")


def event_return(bars: DataFrame, events: DataFrame, most_days: int = 7) -> DataFrame:
    """Adds ``ret``: close times the share ratio of events since the bar before, over the close before, less 1; null where
    an event can't be read, the factor of quotation changed, or the gap is over ``most_days`` days. Over a close of 0 it is
    infinite, or no number if the close is 0 too."""
    w = Window.partitionBy("ticker").orderBy("day")
    rows = bars.withColumns({"_close": F.lag("close").over(w), "_day": F.lag("day").over(w), "_unit": F.lag("unit").over(w)})
    ratio = share_ratio(F.col("kind"), F.col("factor"))
    per = events.groupBy("ticker").agg(F.sort_array(F.collect_list(F.struct("last_cum", F.log(ratio).alias("ln")))).alias("_events"))  # summed in one order
    own = F.filter("_events", lambda e: (e["last_cum"] >= F.col("_day")) & (e["last_cum"] < F.col("day")))
    readable = F.coalesce(~F.exists(own, lambda e: e["ln"].isNull()), F.lit(True))
    grown = F.coalesce(F.aggregate(own, F.lit(0.0), lambda s, e: s + F.coalesce(e["ln"], F.lit(0.0))), F.lit(0.0))
    sound = readable & (F.datediff("day", "_day") <= most_days) & F.col("unit").eqNullSafe(F.col("_unit"))
    out = rows.join(per, "ticker", "left")
    worth = F.col("close") * F.exp(grown)
    ret = F.when(F.col("_close") == 0, worth * F.lit(float("inf"))).otherwise(F.try_divide(worth, "_close")) - 1
    return out.withColumn("ret", F.when(sound, ret)).drop("_close", "_day", "_unit", "_events")


def resolve_unique(asked: DataFrame, candidates: DataFrame, keys: Sequence[str], name: str, price: str, close: str, tolerance: float = 0.005) -> DataFrame:
    """Adds ``name`` of the one candidate of each key, if there is exactly one; null too where its close is off by more than
    the tolerance."""
    one = candidates.groupBy(*keys).agg(F.countDistinct(name).alias("n_candidates"), F.min(name).alias("_name"), F.min(close).alias("_close"))
    out = asked.join(one, list(keys), "left")
    near = F.abs(F.col(price) - F.col("_close")) <= tolerance * F.col("_close")
    return out.withColumn(name, F.when((F.col("n_candidates") == 1) & near, F.col("_name"))).drop("_name", "_close")


def payment_dates(history: DataFrame, supplement: DataFrame, keys: Sequence[str], amount: str, tolerance: float = 1e-8) -> DataFrame:
    """Adds ``pay_day`` from a supplement (keys, amount, pay_day): the one date if there is one; the nth of as many dates as
    the payment has installments; else null. Amounts match within a tolerance: neighbouring steps of it are joined, so
    that the join stays on equal keys."""
    step = tolerance * 4
    extra = supplement.select(*keys, F.col(amount).alias("_amount"), "pay_day", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda i: F.floor(F.col(amount) / step) + i)).alias("_step"))
    nth = Window.partitionBy(*keys, amount).orderBy("installment")
    rows = history.withColumns({"_step": F.floor(F.col(amount) / step), "_nth": F.row_number().over(nth), "_all": F.count("*").over(Window.partitionBy(*keys, amount))})
    near = F.abs(F.col(amount) - F.col("_amount")) < tolerance
    joined = rows.join(extra, [*keys, "_step"], "left")
    out = joined.groupBy(*history.columns, "_nth", "_all").agg(F.array_sort(F.collect_set(F.when(near, F.col("pay_day")))).alias("_days"))
    n = F.size("_days")
    day = F.when(n == 1, F.get("_days", F.lit(0))).when(n == F.col("_all"), F.get("_days", F.col("_nth") - 1))
    return out.withColumn("pay_day", day).select(*history.columns, "pay_day")


def contract_maturity(ticker: Column) -> Column:
    """First day of the month that a contract's letter and two-digit year (its last three characters) name."""
    at = F.position(F.substring(ticker, -3, 1), F.lit(MONTH_LETTERS))
    year = F.substring(ticker, -2, 2).try_cast("int")
    return F.when((at > 0) & year.isNotNull(), F.make_date(2000 + year, at, F.lit(1)))


def nth_contract(rows: DataFrame, n: int, by: Sequence[str] = ("day",)) -> DataFrame:
    """Of each session's contracts that mature after the current month, the nth."""
    open_ = rows.filter(F.col("maturity") > F.last_day("day"))
    w = Window.partitionBy(*by).orderBy("maturity", "ticker")
    return open_.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") == n)


def best_underlying(options: DataFrame, cash: DataFrame, keys: Sequence[str], priority: Column) -> DataFrame:
    """Each option with the first of its matching cash rows in order of priority, then ticker; options without one stay."""
    best = cash.groupBy(*keys).agg(F.min(F.struct(priority.alias("p"), F.col("ticker").alias("underlying"), F.col("close").alias("underlying_close"))).alias("_b"))
    return options.join(best, list(keys), "left").select(*options.columns, "_b.underlying", "_b.underlying_close")


def divisor_steps(levels: DataFrame, by: Sequence[str], day: str, value: str, low: float = 0.5, high: float = 2.0) -> DataFrame:
    """Adds ``is_step``: the level left the band of one-session ratios that a market move explains."""
    ratio = safe_div(value, F.lag(value).over(Window.partitionBy(*by).orderBy(day)))
    return levels.withColumn("ratio", ratio).withColumn("is_step", F.coalesce(~ratio.between(low, high), F.lit(False)))


def lineage(changes: DataFrame, start: str, hops: int = 10) -> DataFrame:
    """A ticker's earlier names, one hop at a time: each step takes the one predecessor there is and stops where there is
    none or more than one. ``changes``: old, new, day. The path has at most ``hops`` rows; the table is only filtered."""
    spark = changes.sparkSession
    path, at = [], start
    for hop in range(1, hops + 1):
        found = changes.filter(F.col("new") == at).select("old", "day").distinct().limit(2).collect()  # two rows at most
        if len(found) != 1 or found[0]["old"] in [p[1] for p in path] + [start]:
            break
        at = found[0]["old"]
        path.append((hop, at, found[0]["day"]))
    return spark.createDataFrame(path, f"hop int, name {changes.schema['old'].dataType.simpleString()}, day {changes.schema['day'].dataType.simpleString()}")


def by_sector(rows: DataFrame, sector: Column, qty: str, value: str) -> DataFrame:
    return rows.groupBy(sector.alias("sector")).agg(F.sum(qty).alias("qty"), total(value).alias("value"), pct_cont(value, 0.5).alias("median_value"), F.count("*").alias("n"))


def active_tickers(filings: DataFrame, bars: DataFrame, keys: Sequence[str], order: Sequence[Column], as_of: str, days: int = 30, least: int = 5) -> DataFrame:
    """Latest filing of each company and ticker; active with ``least`` distinct sessions in the last days."""
    last = latest_by(filings, keys, order)
    end = F.lit(as_of).cast("date")
    seen = bars.filter((F.col("day") > F.date_sub(end, days)) & (F.col("day") <= end)).groupBy("ticker").agg(F.countDistinct("day").alias("n_sessions"))
    out = last.join(seen, "ticker", "left")
    return out.withColumn("is_active", F.coalesce(F.col("n_sessions"), F.lit(0)) >= least)
