"""Holdings, credit portfolios and tranches of funds: kinds of positions, wide tables told long, ordered lists, group totals."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.checkpoint import saved
from tidemark.functions.core import exact, total
from tidemark.functions.ranges import joined_by


def labelled(c: Column, labels: Mapping[str, str]) -> Column:
    """The label of the first key that the text contains, in the given order; null if it contains none."""
    out = F.lit(None).cast("string")
    for key in reversed(list(labels)):
        out = F.when(F.instr(F.lower(c), key) > 0, labels[key]).otherwise(out)
    return out


def long_with_meta(rows: DataFrame, ids: Sequence[str], items: Mapping[str, tuple[str, ...]], names: Sequence[str]) -> DataFrame:
    """ids, item, value and the item's ``names`` (its metadata), one row per column of ``items``; nulls are kept. The
    metadata is a literal map, so nothing is joined."""
    out = rows.select(*ids, *[F.col(c).cast("double").alias(c) for c in items]).unpivot(list(ids), list(items), "item", "value")
    for k, name in enumerate(names):
        table = F.create_map(*[x for c, meta in items.items() for x in (F.lit(c), F.lit(meta[k]))])
        out = out.withColumn(name, F.element_at(table, F.col("item")))
    return out


def sorted_json(rows: DataFrame, by: Sequence[str], fields: Sequence[str], into: str) -> DataFrame:
    """One row per key with its rows as a JSON array of objects, in the order of the fields."""
    return rows.groupBy(*by).agg(F.to_json(F.sort_array(F.collect_list(F.struct(*fields)))).alias(into))


def tranche_series(tranches: DataFrame, flows: DataFrame, by: Sequence[str]) -> DataFrame:
    """Every key of either side once, with the tranche's columns and its flows as an ordered JSON array; either may be
    missing."""
    keys = tranches.select(*by).union(flows.select(*by)).distinct()
    lists = sorted_json(flows, by, [c for c in flows.columns if c not in by], "flows")
    return keys.join(tranches, list(by), "left").join(lists, list(by), "left")


def holdings_by_month(holdings: DataFrame) -> DataFrame:
    """Each month's totals by asset, by kind, and over all, from one row for each fund's asset: funds and assets (distinct),
    value, and value held of related parties. Columns month, fund, kind, asset, value, related."""
    # one shuffle of the holdings, combined before it: each fund's asset once a month
    once = saved(holdings.groupBy("month", "kind", "asset", "fund").agg(F.sum(exact("value")).alias("_v"), F.sum(F.when(F.col("related"), exact("value"))).alias("_r")))

    def level(keys: list[str], code: int) -> DataFrame:
        sums = lambda df: df.agg(F.sum("_v").alias("_v"), F.sum("_r").alias("_r"), F.count("fund").alias("n_funds"))
        by_fund = once if "asset" in keys else once.groupBy(*keys, "fund").agg(F.sum("_v").alias("_v"), F.sum("_r").alias("_r"))
        assets = once.filter("asset is not null").select(*keys, "asset").distinct().groupBy(*keys).agg(F.count("*").alias("n_assets")) if "asset" not in keys else None
        out = sums(by_fund.groupBy(*keys))
        out = out.withColumn("n_assets", F.col("asset").isNotNull().cast("long")) if assets is None else joined_by(out, assets, keys)
        blank = [F.lit(None).cast(once.schema[c].dataType).alias(c) for c in ("month", "kind", "asset") if c not in keys]
        return out.select(*keys, *blank, F.lit(code).alias("level"), "n_funds", F.coalesce("n_assets", F.lit(0)).alias("n_assets"), F.col("_v").cast("double").alias("value"), F.coalesce(F.col("_r").cast("double"), F.lit(0.0)).alias("related_value"))

    return level(["month", "kind", "asset"], 0).unionByName(level(["month", "kind"], 1)).unionByName(level(["month"], 3))


def by_exactly_one(rows: DataFrame, column: str, found: DataFrame, key: str) -> DataFrame:
    """``rows`` with ``column`` from ``found`` (key, column) where the key has exactly one different value of it."""
    one = found.filter(F.col(column).isNotNull()).groupBy(key).agg(F.min(column).alias(column), F.countDistinct(column).alias("_n")).filter("_n = 1").drop("_n")
    return rows.join(one, key, "left")


def account_summary(rows: DataFrame, by: Sequence[str], order: Sequence[str], accounts: Mapping[str, str]) -> DataFrame:
    """One row per fund and month: the last value filed of each selected account, and how many accounts were filed."""
    last = [F.max_by(F.when(F.col("account") == code, F.col("value")), F.when(F.col("account") == code, F.struct(*order))).alias(name) for name, code in accounts.items()]
    return rows.groupBy(*by).agg(*last, F.countDistinct("account").alias("n_accounts"))


def contributions(items: DataFrame, digits: int) -> DataFrame:
    """Items of a tree by number, with the parent's number (its first digits) and the contribution: weight times change."""
    parent = F.when(F.length("number") > digits, F.substring("number", 1, digits))
    return items.withColumns({"parent": parent, "contribution": F.col("weight") * F.col("change_pct") / 100})
