"""Instruments through changes of name: every ticker's chain of (ticker, ISIN), and values as they were known at a time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.checkpoint import saved


def instruments(bars: DataFrame) -> DataFrame:
    """ticker, isin, first, last: the sessions each name printed under each ISIN. ``bars``: ticker, day, isin."""
    return bars.filter("isin is not null").groupBy("ticker", "isin").agg(F.min("day").alias("first"), F.max("day").alias("last"))


def predecessors(bars: DataFrame, companies: DataFrame, events: DataFrame) -> DataFrame:
    """ticker, isin, old_ticker, old_isin, old_last: the one instrument that each continues.

    An older instrument qualifies if it is of the same ticker or company, of the same class (ISIN characters 7 to 11), printed
    last on the session right before the newer one's first, its ISIN never printed from then on, and no stock event of either
    ISIN fell between the two. None or several: the chain stops. companies: ticker, company; events: isin, last_cum (stock
    events only). Only first and last sessions meet, joined on equal days, so prints themselves aren't joined.
    """
    own = instruments(bars)
    days = bars.select("day").distinct().select("day", F.lag("day").over(Window.orderBy("day")).alias("before"))  # one row a session
    starts = own.join(F.broadcast(days), F.col("first") == F.col("day")).filter("before is not null").select("ticker", "isin", "first", F.col("before").alias("seam"))
    ends = own.withColumn("_end", F.max("last").over(Window.partitionBy("isin"))).filter("last = _end").select(F.col("ticker").alias("old_ticker"), F.col("isin").alias("old_isin"), F.col("last").alias("seam"))
    firm = companies.filter("company is not null and ticker is not null").select("ticker", "company").distinct()
    by_name = starts.join(ends, (F.col("ticker") == F.col("old_ticker")) & (starts["seam"] == ends["seam"]))
    old = ends.join(firm.withColumnRenamed("ticker", "old_ticker"), "old_ticker")
    by_firm = starts.join(firm, "ticker").join(old, ["company", "seam"])
    columns = ["ticker", "isin", "first", "old_ticker", "old_isin", starts["seam"]]
    met = by_name.select(*columns).union(by_firm.select(*columns[:-1], "seam")).distinct()
    met = met.filter((F.col("isin") != F.col("old_isin")) & (F.substring("isin", 7, 5) == F.substring("old_isin", 7, 5)))
    seams = met.select("isin", "old_isin", "first", "seam", F.explode(F.array("isin", "old_isin")).alias("_isin"))
    broken = seams.join(events.select(F.col("isin").alias("_isin"), "last_cum"), "_isin").filter((F.col("last_cum") >= F.col("seam")) & (F.col("last_cum") < F.col("first")))
    met = met.join(broken.select("isin", "old_isin", "first").distinct(), ["isin", "old_isin", "first"], "left_anti")
    one = met.groupBy("ticker", "isin").agg(F.count("*").alias("_n"), F.first("old_ticker").alias("old_ticker"), F.first("old_isin").alias("old_isin"), F.first("seam").alias("old_last"))
    return one.filter("_n = 1").drop("_n")


def chains(bars: DataFrame, companies: DataFrame, events: DataFrame, hops: int = 10) -> DataFrame:
    """ticker, seq, name, isin, first_session, last_session: every ticker's instruments, oldest first, up to ``hops``.

    The last is the ticker's current one (of its newest print). Each round doubles how far paths reach: a path is extended by
    that of its end, so ten hops take four joins over all tickers. First sessions fall along a chain, so none is a circle.
    """
    own = instruments(bars)
    steps = saved(predecessors(bars, companies, events))
    node = lambda t, i: F.struct(F.col(t).alias("ticker"), F.col(i).alias("isin"))
    paths = steps.select(node("ticker", "isin").alias("at"), F.array(F.struct(F.col("old_ticker").alias("ticker"), F.col("old_isin").alias("isin"), F.col("old_last").alias("last"))).alias("path"))
    reach = 1
    while reach < hops - 1:
        paths = saved(paths)
        end = F.element_at("path", -1)
        more = paths.select(F.col("at").alias("_at"), F.col("path").alias("_more"))
        paths = paths.join(more, F.struct(end["ticker"].alias("ticker"), end["isin"].alias("isin")) == F.col("_at"), "left")
        paths = paths.select("at", F.when(F.col("_more").isNull(), F.col("path")).otherwise(F.concat("path", "_more")).alias("path"))
        reach *= 2
    newest = own.groupBy("ticker").agg(F.max(F.struct("last", "isin")).alias("_now")).select("ticker", F.col("_now.isin").alias("isin"), F.col("_now.last").alias("last"))
    now = F.array(F.struct("ticker", "isin", "last"))
    told = newest.join(paths, node("ticker", "isin") == F.col("at"), "left").select("ticker", F.slice(F.concat(now, F.coalesce("path", F.array().cast("array<struct<ticker:string,isin:string,last:date>>"))), 1, hops).alias("path"))
    rows = told.select("ticker", F.size("path").alias("_n"), F.posexplode("path").alias("_k", "_x")).select("ticker", (F.col("_n") - F.col("_k")).alias("seq"), F.col("_x.ticker").alias("name"), F.col("_x.isin").alias("isin"), F.col("_x.last").alias("last_session"))
    firsts = own.select(F.col("ticker").alias("name"), "isin", F.col("first").alias("first_session"))
    return rows.join(firsts, ["name", "isin"]).select("ticker", "seq", "name", "isin", "first_session", "last_session")


def histories(bars: DataFrame, companies: DataFrame, events: DataFrame, hops: int = 10) -> DataFrame:
    """Every ticker's bars through its chain: ``bars`` under ``ticker`` (the current name), with ``name`` as printed; each
    instrument's sessions only until the next one's first."""
    chain = chains(bars, companies, events, hops)
    own = bars.withColumnRenamed("ticker", "name").join(chain, ["name", "isin"]).filter((F.col("day") >= F.col("first_session")) & (F.col("day") <= F.col("last_session")))
    return own.select("ticker", "seq", "name", *[c for c in bars.columns if c != "ticker"])


def known_at(asked: DataFrame, observations: DataFrame, key: str, day: str, cutoff: str, columns: Sequence[str]) -> DataFrame:
    """``asked`` with valid, known and the columns of the observation that holds at ``day`` as known by ``cutoff``, and
    is_ambiguous: of those known by then and valid from that day or before, the latest valid; of its revisions the newest.

    observations: key, valid, known (dates or timestamps), columns. Different revisions of one value known at the same time
    can't be told apart: is_ambiguous is true and the columns are null. Days first find their month, then their day, by when
    each was known first: arrays of months and of a month's days, which calendars bound; a value's revisions are then one sorted
    pass. No task gets all rows of a key.
    """
    month = lambda c: F.trunc(F.col(c).cast("date"), "month")
    value = F.struct(*columns)
    times = observations.groupBy(key, "valid", "known").agg(F.min(value).alias("_value"), (F.min(value) != F.max(value)).alias("_odd"))
    firsts = times.groupBy(key, "valid").agg(F.min("known").alias("k"))
    days = saved(firsts.groupBy(key, month("valid").alias("_m")).agg(F.sort_array(F.collect_list(F.struct("valid", "k"))).alias("_days"), F.min("k").alias("k")))
    months = days.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("_m", "k"))).alias("_months"))
    here = days.select(key, F.col("_m").alias("_own"), F.col("_days").alias("_here"))
    there = days.select(key, F.col("_m").alias("_found"), F.col("_days").alias("_there"))
    last = lambda array, rule: F.try_element_at(F.filter(array, rule), F.lit(-1))
    own = asked.withColumn("_id", F.monotonically_increasing_id()).withColumn("_own", month(day)).join(here, [key, "_own"], "left")
    own = own.withColumn("_v", last("_here", lambda x: (x["valid"] <= F.col(day)) & (x["k"] <= F.col(cutoff)))["valid"])
    own = own.join(months, key, "left").withColumn("_found", F.when(F.col("_v").isNull(), last("_months", lambda x: (x["_m"] < F.col("_own")) & (x["k"] <= F.col(cutoff)))["_m"]))
    own = own.join(there, [key, "_found"], "left").withColumn("valid", F.coalesce("_v", last("_there", lambda x: x["k"] <= F.col(cutoff))["valid"]))
    own = own.select(*asked.columns, "valid", F.col(cutoff).alias("_at"), F.lit(1).alias("_kind"))
    seen = times.select(key, "valid", F.col("known").alias("_at"), F.lit(0).alias("_kind"), F.struct("known", "_odd", "_value").alias("_seen"))
    w = Window.partitionBy(key, "valid").orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    none = own.filter("valid is null").withColumn("_seen", F.lit(None).cast(seen.schema["_seen"].dataType))
    met = own.filter("valid is not null").unionByName(seen, allowMissingColumns=True).withColumn("_seen", F.last("_seen", ignorenulls=True).over(w)).filter("_kind = 1")
    sure = ~F.col("_seen._odd")
    return met.unionByName(none).select(*asked.columns, "valid", F.col("_seen.known").alias("known"), *[F.when(sure, F.col(f"_seen._value.{c}")).alias(c) for c in columns], F.col("_seen._odd").alias("is_ambiguous"))
