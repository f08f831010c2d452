"""Quote histories: raw, adjusted and total-return closes across renamed tickers, refused where they can't be told."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import guards
from tidemark.functions.core import keyset_after
from tidemark.operators import facts
from tidemark.operators.market import adjusted_close, share_ratio, total_return

#: The specifications of a history, and the share events that can be adjusted for.
SPECS = ("raw", "adjusted", "total_return")
SUPPORTED = ("DESDOBRAMENTO", "GRUPAMENTO", "BONIFICACAO")


def adjustment_status(events: DataFrame, anchors: DataFrame) -> DataFrame:
    """ticker, anchor, block_through, block_reason: the last day up to which no adjustment may go, and why.

    Of a ticker's different share events before its anchor (its newest session), those block that are of an unsupported
    kind, have an unreadable factor, or are published twice for one day: with one factor paid in two assets, or with two
    factors. Of several on the last day the first reason in order of text counts. events: ticker, last_cum, kind, factor,
    asset; anchors: ticker, anchor."""
    own = events.select("ticker", "kind", "last_cum", "factor", "asset").distinct().join(anchors, "ticker").filter(F.col("last_cum") < F.col("anchor"))
    one = Window.partitionBy("ticker", "kind", "last_cum")
    reason = (
        F.when(~F.col("kind").isin(*SUPPORTED), F.concat(F.lit("unsupported corporate event "), "kind"))
        .when(share_ratio(F.col("kind"), F.col("factor")).isNull(), F.concat(F.lit("unreadable factor on "), "kind"))
        .when(F.count("*").over(Window.partitionBy("ticker", "kind", "last_cum", "factor")) > 1, F.concat(F.lit("ambiguous "), "kind", F.lit(" paid in two assets")))
        .when(F.count("*").over(one) > 1, F.concat(F.lit("ambiguous "), "kind", F.lit(" published with two factors")))
    )
    last = own.withColumn("_reason", reason).filter("_reason is not null").groupBy("ticker").agg(F.max(F.struct("last_cum")).alias("_m"), F.collect_set(F.struct("last_cum", "_reason")).alias("_all"))
    first = F.array_min(F.transform(F.filter("_all", lambda x: x["last_cum"] == F.col("_m.last_cum")), lambda x: x["_reason"]))
    return anchors.join(last.select("ticker", F.col("_m.last_cum").alias("block_through"), first.alias("block_reason")), "ticker", "left")


def spliced(bars: DataFrame, renames: DataFrame) -> DataFrame:
    """Bars under their newest name: rows of an earlier name before the day of its change count for the later one.
    renames: old, new, day; each name has one successor at most, and only one hop is taken by a call."""
    out = bars.join(renames, F.col("ticker") == F.col("old"), "left")
    earlier = F.col("new").isNotNull() & (bars["day"] < renames["day"])
    return out.select(F.when(earlier, F.col("new")).otherwise(bars["ticker"]).alias("ticker"), *[bars[c] for c in bars.columns if c != "ticker"])


def histories(bars: DataFrame, spec: str = "raw", share_events: DataFrame | None = None, cash: DataFrame | None = None, anchor: str | None = None) -> DataFrame:
    """All tickers' closes under a specification; adjusted ones are null on days up to their ticker's block."""
    guards.one_of(spec, SPECS, "spec")
    if spec == "raw":
        return bars
    anchors = bars.groupBy("ticker").agg(F.max("day").alias("anchor"))
    status = adjustment_status(share_events, anchors).select("ticker", "block_through")
    out = adjusted_close(bars, share_events.filter(F.col("kind").isin(*SUPPORTED)), anchor)
    if spec == "total_return":
        out = total_return(out, cash)
    value = "close_adj" if spec == "adjusted" else "close_tr"
    open_ = F.col("block_through").isNull() | (F.col("day") > F.col("block_through"))
    return out.join(status, "ticker", "left").withColumn(value, F.when(open_, F.col(value))).drop("block_through")


def history(bars: DataFrame, ticker, start: date, end: date, after: str | None = None, limit: int = guards.ROW_CAP, **how) -> DataFrame:
    """A page of one ticker's history in a window, after a date cursor. Refused: an empty window, a bad cursor, a session
    that occurs twice, more rows than the limit without a cursor, and an adjusted close of a blocked day."""
    guards.window(start, end)
    cursor = guards.date_cursor(after)
    own = bars.filter((F.col("ticker") == ticker) & F.col("day").between(F.lit(start), F.lit(end)))
    guards.unique(own, ["ticker", "day"], "history")
    out = histories(own, **how)
    if how.get("spec", "raw") != "raw":
        value = "close_adj" if how["spec"] == "adjusted" else "close_tr"
        blocked = out.filter(F.col(value).isNull()).agg(F.max("day").alias("day")).first()["day"]
        if blocked is not None:
            raise guards.Refused(f"no {how['spec']} close of {ticker} up to {blocked}")
    if cursor is None:
        guards.row_cap(out, "history", cap=limit)
    return keyset_after(out, ["day"], None if cursor is None else (cursor,), limit)


def unit_of(metric: Column) -> Column:
    """A metric's unit by its ending."""
    return F.when(metric.like("%\\_pct"), "percent").when(metric.like("n\\_%"), "count").otherwise("money")


def panel(sources: dict[str, DataFrame], ids: list[str] | None = None, metrics: list[str] | None = None, families: list[str] | None = None, window: tuple[date, date] | None = None, month_end: bool = False) -> DataFrame:
    """date, id, metric, class, value, unit, family: observations of all families as one long table.

    sources: family -> (id, class, day, metrics...), one column per metric; nulls aren't observations. With ``month_end``
    the last observation of each month stands on the month's last day. Filters on families drop whole sources, those on
    ids and the window go to every source's scan before anything is joined or grouped."""
    parts = []
    for family, rows in sources.items():
        if families and family not in families:
            continue
        own = [c for c in rows.columns if c not in ("id", "class", "day") and (not metrics or c in metrics)]
        if not own:
            continue
        rows = rows.select(F.col("id").cast("string").alias("id"), F.col("class").cast("string").alias("class"), F.col("day").alias("date"), *[F.col(c).cast("double").alias(c) for c in own])
        if ids:
            rows = rows.filter(F.col("id").isin(*ids))
        if window:
            rows = rows.filter(F.col("date").between(*map(F.lit, window)))
        parts.append(rows.unpivot(["id", "class", "date"], own, "metric", "value").filter("value is not null").withColumn("family", F.lit(family)))
    if not parts:
        raise guards.Refused("no source holds what is asked")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    if month_end:
        out = out.groupBy("family", "id", "metric", "class", F.last_day("date").alias("date")).agg(F.max_by("value", F.struct("date", "value")).alias("value"))
    return out.withColumn("unit", unit_of(F.col("metric")))


def universe(fact: DataFrame, metric: str, since: date, as_of: date, until: date | None = None, family: str | None = None, min_nav: float | None = None, min_months: int | None = None) -> DataFrame:
    """family, id, date, metric, value: a monthly metric of every fund of a family (or of all) that passes: its latest NAV in the
    window is ``min_nav`` or more, and it has ``min_months`` values of the metric.

    Without ``until`` a family's window ends with its own latest complete month (ended, and filed by 0.80 of the median of
    the six before), so that a month half filed isn't taken for the industry; with it, the window holds what there is.
    Refused: an unknown metric, and an empty window. fact: entity, family, period, nav and other metrics."""
    guards.one_of(metric, [c for c in fact.columns if c not in ("entity", "family", "period")], "metric")
    own = fact if family is None else fact.filter(F.col("family") == family)
    if until is None:
        guards.window(since, as_of)
        counts = own.groupBy("family", "period").agg(F.countDistinct("entity").alias("_n"))
        before = Window.partitionBy("family").orderBy("period").rowsBetween(-facts.TRAILING, -1)  # one row a family and month
        counts = counts.withColumn("_median", F.percentile("_n", F.lit(0.5)).over(before))
        done = (F.last_day("period") < F.lit(as_of)) & F.coalesce(F.col("_n") >= facts.COMPLETE * F.col("_median"), F.lit(True))
        ends = counts.filter(done).groupBy("family").agg(F.max("period").alias("_end"))
        own = own.join(ends, "family").filter(F.col("period") <= F.col("_end")).drop("_end")
    else:
        guards.window(since, until)
        own = own.filter(F.col("period") <= F.trunc(F.lit(until), "month"))
    own = own.filter(F.col("period") >= F.trunc(F.lit(since), "month"))
    held = own.groupBy("family", "entity").agg(F.max_by("nav", F.when(F.col("nav").isNotNull(), F.col("period"))).alias("_nav"), F.count(metric).alias("_months"))
    if min_nav is not None:
        held = held.filter(F.col("_nav") >= min_nav)
    if min_months is not None:
        held = held.filter(F.col("_months") >= min_months)
    kept = own.join(held.select("family", "entity"), ["family", "entity"], "left_semi").filter(F.col(metric).isNotNull())
    return kept.select("family", F.col("entity").alias("id"), F.col("period").alias("date"), F.lit(metric).alias("metric"), F.col(metric).cast("double").alias("value"))


def panel_page(observations: DataFrame, after: str | None, limit: int = guards.ROW_CAP) -> DataFrame:
    """The next page after a cursor date|id|metric|class."""
    return keyset_after(observations, ["date", "id", "metric", "class"], guards.panel_cursor(after), limit)
