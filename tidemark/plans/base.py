"""Registration of queries, and the driver tables as the warehouse's entities.

An entity is a customer, its family the market segment, its manager the nation; orders are its daily filings. Users of
events are instruments with daily sessions. Line items are trades between two legs, parts are securities.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import facts

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def told(df: DataFrame) -> DataFrame:
    """A result's columns in the types that both engines share: whole numbers as long, decimals as double, doubles to six
    digits (sums of doubles depend on the order of rows beyond that)."""
    out = []
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        if kind in ("tinyint", "smallint", "int"):
            c = c.cast("long")
        elif kind in ("double", "float") or kind.startswith("decimal"):
            c = F.round(c.cast("double"), 6) + F.lit(0.0)  # no negative zeros
        out.append(c.alias(name))
    return df.select(*out)


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name, with SQL for comparison where SQL can say it."""

    def add(f: Query) -> Query:
        if f.__name__ in QUERIES:
            raise ValueError(f"two queries named {f.__name__}")
        QUERIES[f.__name__] = lambda spark, sf_dir: told(f(spark, sf_dir))
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def since_until(df: DataFrame, column: str, since: str | None = None, until: str | None = None) -> DataFrame:
    """Rows from the first day to before the last, filtered on the column as it is stored, so that Parquet can skip row
    groups; a filter on its month alone can't. All rows if there are no days."""
    if since is None or until is None:
        return df
    kind = df.schema[column].dataType
    return df.filter((F.col(column) >= F.lit(since).cast(kind)) & (F.col(column) < F.lit(until).cast(kind)))


def daily(spark: SparkSession, d: str) -> DataFrame:
    """Daily filings: entity, subclass, day, nav, quota, inflow, outflow, holders."""
    status, price = F.col("o_orderstatus"), F.col("o_totalprice")
    return table(spark, d, "orders").select(
        F.col("o_custkey").alias("entity"),
        F.col("o_orderpriority").alias("subclass"),
        F.col("o_orderdate").cast("date").alias("day"),
        F.when(status != "P", price).alias("nav"),
        F.when(status != "P", price / 1000).alias("quota"),
        F.when(status == "F", price).otherwise(0.0).alias("inflow"),
        F.when(status == "O", price).otherwise(0.0).alias("outflow"),
        (F.col("o_orderkey") % 97).alias("holders"),
    )


def entities(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select(F.col("c_custkey").alias("entity"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("family"), F.col("c_nationkey").alias("manager"), (F.col("c_acctbal") > 0).alias("active"))


def fact(spark: SparkSession, d: str) -> DataFrame:
    """The monthly fact with each entity's family and manager."""
    return facts.entity_month_fact(daily(spark, d)).join(entities(spark, d).select("entity", "family", "manager"), "entity")


def sessions(spark: SparkSession, d: str) -> DataFrame:
    """Daily bars: ticker, day, close (the last value), qty, volume, trades."""
    ev = table(spark, d, "events").withColumn("day", F.col("ts").cast("date"))
    return ev.groupBy(F.col("user_id").alias("ticker"), "day").agg(F.max_by("value", F.struct("ts", "event_id")).alias("close"), F.count("*").alias("trades"), F.sum(F.col("event_id") % 50 + 1).alias("qty"), F.sum(F.col("value").cast("decimal(18,2)")).cast("double").alias("volume"))


def lines(spark: SparkSession, d: str) -> DataFrame:
    """Trades between two legs: day, lender, borrower, qty, rate, value, kind."""
    return table(spark, d, "lineitem").select(F.col("l_shipdate").cast("date").alias("day"), F.col("l_suppkey").alias("lender"), (F.col("l_partkey") % 100).alias("borrower"), F.col("l_quantity").alias("qty"), F.col("l_discount").alias("rate"), F.col("l_extendedprice").alias("value"), F.col("l_returnflag").alias("kind"), F.col("l_orderkey").alias("trade"))


#: The same, as common table expressions.
DAILY = """daily AS (
  SELECT o_custkey AS entity, o_orderpriority AS subclass, o_orderdate::DATE AS day, date_trunc('month', o_orderdate)::DATE AS period,
         CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END AS nav, CASE WHEN o_orderstatus <> 'P' THEN o_totalprice / 1000 END AS quota,
         CASE WHEN o_orderstatus = 'F' THEN o_totalprice ELSE 0 END AS inflow, CASE WHEN o_orderstatus = 'O' THEN o_totalprice ELSE 0 END AS outflow,
         o_orderkey % 97 AS holders
  FROM orders)"""
FACT = DAILY + """,
flows AS (SELECT entity, period, sum(inflow::DECIMAL(18,2))::DOUBLE AS inflow, sum(outflow::DECIMAL(18,2))::DOUBLE AS outflow FROM daily GROUP BY 1, 2),
newest AS (SELECT * FROM daily WHERE nav IS NOT NULL QUALIFY row_number() OVER (PARTITION BY entity, period, subclass ORDER BY day DESC, nav DESC) = 1),
chosen AS (SELECT entity, subclass AS chosen FROM newest QUALIFY row_number() OVER (PARTITION BY entity ORDER BY coalesce(quota, 0) > 0 DESC, period DESC, nav DESC NULLS LAST, subclass) = 1),
fact AS (
  SELECT n.entity, n.period, sum(n.nav::DECIMAL(18,2))::DOUBLE AS nav, max(n.quota) FILTER (n.subclass = c.chosen AND n.quota > 0) AS quota,
         sum(n.holders)::BIGINT AS holders, max(f.inflow) AS inflow, max(f.outflow) AS outflow,
         any_value(k.c_mktsegment) AS family, any_value(k.c_nationkey) AS manager
  FROM newest n JOIN chosen c USING (entity) JOIN flows f USING (entity, period) JOIN customer k ON k.c_custkey = n.entity
  GROUP BY 1, 2)"""
SESSIONS = """sessions AS (
  SELECT user_id AS ticker, ts::DATE AS day, arg_max(value, (ts, event_id)) AS close, count(*) AS trades,
         sum(event_id % 50 + 1)::BIGINT AS qty, sum(value::DECIMAL(18,2))::DOUBLE AS volume
  FROM events GROUP BY 1, 2)"""
LINES = """lines AS (
  SELECT l_shipdate::DATE AS day, l_suppkey AS lender, l_partkey % 100 AS borrower, l_quantity AS qty, l_discount AS rate,
         l_extendedprice AS value, l_returnflag AS kind, l_orderkey AS trade FROM lineitem)"""
