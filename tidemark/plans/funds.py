"""Queries on fund holdings, credit portfolios, tranches and price items.

A line item is a holding: the supplier is the fund, the part the asset, its return flag the kind, the ship month the month.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.core import total
from tidemark.operators import funds as U
from tidemark.plans.base import query, table

HELD = """held AS (SELECT l_suppkey AS fund, l_partkey AS asset, date_trunc('month', l_shipdate)::DATE AS month, l_returnflag AS kind, l_extendedprice AS value, l_discount > 0.05 AS related, l_quantity AS qty FROM lineitem)"""


def held(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(F.col("l_suppkey").alias("fund"), F.col("l_partkey").alias("asset"), F.trunc("l_shipdate", "month").alias("month"), F.col("l_returnflag").alias("kind"), F.col("l_extendedprice").alias("value"), (F.col("l_discount") > 0.05).alias("related"), F.col("l_quantity").alias("qty"))


KINDS = {"economy": "owned", "small": "lent", "promo": "borrowed", "large": "derivative"}


@query("SELECT p_partkey AS id, CASE WHEN contains(lower(p_type), 'economy') THEN 'owned' WHEN contains(lower(p_type), 'small') THEN 'lent' WHEN contains(lower(p_type), 'promo') THEN 'borrowed' WHEN contains(lower(p_type), 'large') THEN 'derivative' END AS kind FROM part")
def position_kind(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), U.labelled(F.col("p_type"), KINDS).alias("kind"))


@query(f"WITH {HELD} SELECT fund, s_name AS name, month, asset, p_name AS asset_name, sum(value::DECIMAL(18,2))::DOUBLE AS value, sum(qty) AS qty FROM held LEFT JOIN part ON p_partkey = asset LEFT JOIN supplier ON s_suppkey = fund GROUP BY ALL")
def fund_holdings(spark: SparkSession, d: str) -> DataFrame:
    names = table(spark, d, "supplier").select(F.col("s_suppkey").alias("fund"), F.col("s_name").alias("name"))
    assets = table(spark, d, "part").select(F.col("p_partkey").alias("asset"), F.col("p_name").alias("asset_name"))
    sums = held(spark, d).groupBy("fund", "month", "asset").agg(total("value").alias("value"), F.sum("qty").alias("qty"))
    return sums.join(names, "fund", "left").join(assets, "asset", "left")


@query(f"""WITH {HELD}, t AS (SELECT p_brand AS issuer, list(DISTINCT p_type ORDER BY p_type) AS types FROM part GROUP BY 1)
SELECT p_brand AS issuer, month, array_to_string(any_value(types), ',') AS types, count(DISTINCT fund) AS n_funds, sum(value::DECIMAL(18,2))::DOUBLE AS value FROM held JOIN part ON p_partkey = asset JOIN t ON issuer = p_brand GROUP BY 1, 2""")
def fund_debentures(spark: SparkSession, d: str) -> DataFrame:
    """Holdings by issuer and month, with the issuer's types as a sorted list."""
    part = table(spark, d, "part").select(F.col("p_partkey").alias("asset"), F.col("p_brand").alias("issuer"), "p_type")
    types = part.groupBy("issuer").agg(F.array_join(F.sort_array(F.collect_set("p_type")), ",").alias("types"))
    own = held(spark, d).join(part.drop("p_type"), "asset").groupBy("issuer", "month").agg(F.countDistinct("fund").alias("n_funds"), total("value").alias("value"))
    return own.join(types, "issuer")


@query("SELECT l_orderkey AS fund, l_suppkey AS originator, s_name AS name, array_to_string(list(p_brand ORDER BY p_brand), ',') AS tickers, count(*) AS n FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN part ON p_partkey = l_partkey GROUP BY ALL")
def fund_originators(spark: SparkSession, d: str) -> DataFrame:
    """Originators of each fund, with their tickers as a sorted list."""
    names = table(spark, d, "supplier").select(F.col("s_suppkey").alias("originator"), F.col("s_name").alias("name"))
    brands = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    own = table(spark, d, "lineitem").join(brands, "l_partkey").groupBy(F.col("l_orderkey").alias("fund"), F.col("l_suppkey").alias("originator")).agg(F.array_join(F.sort_array(F.collect_list("p_brand")), ",").alias("tickers"), F.count("*").alias("n"))
    return own.join(names, "originator")


@query("SELECT l_suppkey AS fund, l_partkey AS debtor, sum(l_extendedprice::DECIMAL(18,2))::DOUBLE AS value, rank() OVER (PARTITION BY l_suppkey ORDER BY sum(l_extendedprice::DECIMAL(18,2)) DESC) AS rank FROM lineitem GROUP BY 1, 2 QUALIFY rank <= 25")
def fund_debtors(spark: SparkSession, d: str) -> DataFrame:
    """The 25 largest debtors of each fund, ties kept."""
    from pyspark.sql import Window

    own = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("fund"), F.col("l_partkey").alias("debtor")).agg(F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).alias("value"))
    return own.withColumn("rank", F.rank().over(Window.partitionBy("fund").orderBy(F.desc("value")))).filter("rank <= 25")


#: Columns of the wide credit table, with kind, code and parent.
ITEMS = {"l_quantity": ("sector", "A", ""), "l_extendedprice": ("sector", "C", ""), "l_discount": ("rating", "C1", "C"), "l_tax": ("tax", "T", "")}


@query(
    """WITH u AS (SELECT l_orderkey AS fund, l_linenumber AS line, l_partkey AS part, item, value FROM (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem) UNPIVOT INCLUDE NULLS (value FOR item IN (l_quantity, l_extendedprice, l_discount, l_tax)))
SELECT fund, line, part, item, value, CASE item WHEN 'l_discount' THEN 'rating' WHEN 'l_tax' THEN 'tax' ELSE 'sector' END AS kind, CASE item WHEN 'l_quantity' THEN 'A' WHEN 'l_extendedprice' THEN 'C' WHEN 'l_discount' THEN 'C1' ELSE 'T' END AS code, CASE item WHEN 'l_discount' THEN 'C' ELSE '' END AS parent FROM u"""
)
def credit_portfolio(spark: SparkSession, d: str) -> DataFrame:
    """A wide table told long, each item with its kind, code and parent."""
    own = table(spark, d, "lineitem").withColumnsRenamed({"l_orderkey": "fund", "l_linenumber": "line", "l_partkey": "part"})
    return U.long_with_meta(own, ["fund", "line", "part"], ITEMS, ["kind", "code", "parent"])


@query(
    """WITH b AS (SELECT o_orderkey AS fund, CASE WHEN age <= 365 THEN 'to_1y' WHEN age <= 730 THEN 'to_2y' ELSE 'over_2y' END AS bucket, l_extendedprice AS value FROM (SELECT o_orderkey, l_extendedprice, datediff('day', l_shipdate, DATE '1998-12-31') AS age FROM orders JOIN lineitem ON l_orderkey = o_orderkey)),
w AS (SELECT fund, sum(value::DECIMAL(18,2)) FILTER (bucket = 'to_1y') AS to_1y, sum(value::DECIMAL(18,2)) FILTER (bucket = 'to_2y') AS to_2y, sum(value::DECIMAL(18,2)) FILTER (bucket = 'over_2y') AS over_2y FROM b GROUP BY 1)
SELECT fund, item, value::DOUBLE AS value, CASE item WHEN 'to_1y' THEN '0' WHEN 'to_2y' THEN '366' ELSE '731' END AS first_day FROM w UNPIVOT INCLUDE NULLS (value FOR item IN (to_1y, to_2y, over_2y))"""
)
def credit_aging(spark: SparkSession, d: str) -> DataFrame:
    """Buckets of age told long, each with its first day."""
    age = F.datediff(F.lit("1998-12-31").cast("date"), "l_shipdate")
    own = table(spark, d, "orders").select(F.col("o_orderkey").alias("fund")).join(table(spark, d, "lineitem"), F.col("fund") == F.col("l_orderkey"))
    bucket = F.when(age <= 365, "to_1y").when(age <= 730, "to_2y").otherwise("over_2y")
    money = F.col("l_extendedprice").cast("decimal(18,2)")
    wide = own.groupBy("fund").agg(*[F.sum(F.when(bucket == b, money)).alias(b) for b in ("to_1y", "to_2y", "over_2y")])
    return U.long_with_meta(wide, ["fund"], {"to_1y": ("0",), "to_2y": ("366",), "over_2y": ("731",)}, ["first_day"])


@query(
    """WITH t AS (SELECT o_orderkey AS fund, o_custkey % 3 AS series, o_totalprice AS value FROM orders WHERE o_orderstatus <> 'P'),
f AS (SELECT l_orderkey AS fund, l_orderkey % 3 AS series, l_linenumber AS op, l_extendedprice AS amount FROM lineitem),
k AS (SELECT fund, series FROM t UNION SELECT fund, series FROM f),
l AS (SELECT fund, series, count(*) AS n_flows, sum(amount::DECIMAL(18,2))::DOUBLE AS amount FROM f GROUP BY ALL)
SELECT k.fund, k.series, t.value, l.n_flows, l.amount FROM k LEFT JOIN t ON t.fund = k.fund AND t.series = k.series LEFT JOIN l ON l.fund = k.fund AND l.series = k.series"""
)
def fund_tranches(spark: SparkSession, d: str) -> DataFrame:
    """Every tranche that either side knows, with its flows as an ordered JSON array (here: how many, and their sum)."""
    t = table(spark, d, "orders").filter("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("fund"), (F.col("o_custkey") % 3).alias("series"), F.col("o_totalprice").alias("value"))
    f = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("fund"), (F.col("l_orderkey") % 3).alias("series"), F.col("l_linenumber").alias("op"), F.col("l_extendedprice").cast("decimal(18,2)").alias("amount"))
    both = U.tranche_series(t, f, ["fund", "series"])
    listed = F.from_json("flows", "array<struct<op:int,amount:decimal(18,2)>>")
    return both.select("fund", "series", "value", F.when(F.col("flows").isNotNull(), F.size(listed)).alias("n_flows"), F.aggregate(listed, F.lit(0).cast("decimal(28,2)"), lambda s, x: (s + x["amount"]).cast("decimal(28,2)")).alias("amount"))


@query(
    """WITH m AS (SELECT l_orderkey % 3 AS series, l_suppkey AS fund, date_trunc('month', l_shipdate)::DATE AS month, sum(l_extendedprice::DECIMAL(18,2))::DOUBLE AS value FROM lineitem GROUP BY ALL)
SELECT fund, series, month, value, round(value / nullif(lag(value) OVER (PARTITION BY fund, series ORDER BY month), 0) - 1, 6) AS change FROM m"""
)
def tranche_performance(spark: SparkSession, d: str) -> DataFrame:
    """Each tranche's value by month, and its change from its month before."""
    from pyspark.sql import Window

    own = table(spark, d, "lineitem").groupBy((F.col("l_orderkey") % 3).alias("series"), F.col("l_suppkey").alias("fund"), F.trunc("l_shipdate", "month").alias("month")).agg(total("l_extendedprice").alias("value"))
    before = F.lag("value").over(Window.partitionBy("fund", "series").orderBy("month"))
    return own.withColumn("change", F.col("value") / F.nullif(before, F.lit(0.0)) - 1)


@query(f"WITH {HELD} SELECT month, kind, asset, grouping(month, kind, asset)::BIGINT AS level, count(DISTINCT fund) AS n_funds, count(DISTINCT asset) AS n_assets, sum(value::DECIMAL(18,2))::DOUBLE AS value, coalesce(sum(value::DECIMAL(18,2)) FILTER (related), 0)::DOUBLE AS related_value FROM held GROUP BY GROUPING SETS ((month, kind, asset), (month, kind), (month))")
def holdings_monthly(spark: SparkSession, d: str) -> DataFrame:
    return U.holdings_by_month(held(spark, d))


@query(
    """WITH i AS (SELECT p_partkey AS id, lpad((p_partkey % 100000)::VARCHAR, 1 + (p_size % 5)::INT, '1') AS number, p_size / 50.0::DOUBLE AS weight, (p_retailprice - 1000) / 100 AS change_pct FROM part)
SELECT id, number, CASE WHEN length(number) > 2 THEN substr(number, 1, 2) END AS parent, round(weight * change_pct / 100, 6) AS contribution FROM i"""
)
def inflation_items(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.expr("lpad(cast(p_partkey % 100000 as string), 1 + p_size % 5, '1')").alias("number"), (F.col("p_size") / 50).alias("weight"), ((F.col("p_retailprice") - 1000) / 100).alias("change_pct"))
    return U.contributions(own, 2).select("id", "number", "parent", "contribution")


@query("SELECT o_custkey AS property, o_orderdate::DATE AS filed, o_orderstatus AS status, o_totalprice AS area FROM orders WHERE o_orderdate BETWEEN DATE '1994-01-01' AND DATE '1998-12-31'")
def property_history(spark: SparkSession, d: str) -> DataFrame:
    """All filed versions of each property in a window."""
    own = table(spark, d, "orders").filter(F.col("o_orderdate").between(F.lit("1994-01-01").cast("date"), F.lit("1998-12-31").cast("date")))
    return own.select(F.col("o_custkey").alias("property"), F.col("o_orderdate").cast("date").alias("filed"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("area"))


@query(
    """SELECT event_type AS category, metric, CASE WHEN metric LIKE '%_pct' THEN 'percent' WHEN metric LIKE '%_n' THEN 'count' ELSE 'money' END AS unit, day, value FROM (
  SELECT event_type, ts::DATE AS day, sum(value::DECIMAL(18,2))::DOUBLE AS nav, count(*)::DOUBLE AS events_n, round(100.0 * count(*) FILTER (value > 50) / count(*), 6)::DOUBLE AS high_pct FROM events GROUP BY 1, 2)
UNPIVOT (value FOR metric IN (nav, events_n, high_pct))"""
)
def class_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Metrics of each category long, with the unit that the metric's ending tells."""
    own = table(spark, d, "events").groupBy(F.col("event_type").alias("category"), F.col("ts").cast("date").alias("day"))
    wide = own.agg(total("value").alias("nav"), F.count("*").cast("double").alias("events_n"), (100 * F.count_if(F.col("value") > 50) / F.count("*")).alias("high_pct"))
    unit = F.when(F.col("metric").like("%\\_pct"), "percent").when(F.col("metric").like("%\\_n"), "count").otherwise("money")
    return wide.unpivot(["category", "day"], ["nav", "events_n", "high_pct"], "metric", "value").withColumn("unit", unit)


@query(
    """WITH r AS (SELECT o_custkey AS fund, date_trunc('month', o_orderdate)::DATE AS month, o_orderpriority AS account, o_totalprice AS value, o_orderdate AS filed, o_orderkey AS id FROM orders)
SELECT fund, month, arg_max(value, (filed, id)) FILTER (account = '1-URGENT') AS fees, arg_max(value, (filed, id)) FILTER (account = '5-LOW') AS cash, count(DISTINCT account) AS n_accounts FROM r GROUP BY 1, 2"""
)
def account_summary(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "orders").select(F.col("o_custkey").alias("fund"), F.trunc("o_orderdate", "month").alias("month"), F.col("o_orderpriority").alias("account"), F.col("o_totalprice").alias("value"), F.col("o_orderdate").alias("filed"), F.col("o_orderkey").alias("id"))
    return U.account_summary(own, ["fund", "month"], ["filed", "id"], {"fees": "1-URGENT", "cash": "5-LOW"})


@query(
    """WITH a AS (SELECT fam, count(*) AS n, sum(bal::DECIMAL(18,2))::DOUBLE AS bal FROM (SELECT c_mktsegment AS fam, c_acctbal AS bal FROM customer) GROUP BY 1)
SELECT x.n AS building_n, x.bal AS building_bal, y.n AS machinery_n, y.bal AS machinery_bal, round(x.bal / nullif(y.bal, 0), 6) AS ratio FROM a x, a y WHERE x.fam = 'BUILDING' AND y.fam = 'MACHINERY'"""
)
def family_against_family(spark: SparkSession, d: str) -> DataFrame:
    """Two families side by side, in one aggregation."""
    seg, bal = F.col("c_mktsegment"), F.col("c_acctbal")
    cells = [f(seg == fam).alias(f"{fam.lower()}_{name}") for fam in ("BUILDING", "MACHINERY") for name, f in (("n", F.count_if), ("bal", lambda w: total(F.when(w, bal))))]
    out = table(spark, d, "customer").agg(*cells)
    return out.withColumn("ratio", F.col("building_bal") / F.nullif(F.col("machinery_bal"), F.lit(0.0)))
