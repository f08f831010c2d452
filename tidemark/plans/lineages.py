"""Queries on chains of instruments, and on values as they were known at a time.

A user is a company that trades under a name; its ISIN ends with the ten days' period of the month (shifted by the user), and
every third company takes a new name with each; every fifth one's third period is another class. Errors above 40 are stock
events. Line items are values of a part, valid from shipment and known ten days a line number earlier or later; orders ask for
the part of their customer's number.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import lineage as L
from tidemark.plans.base import query, table


def prints(spark: SparkSession, d: str) -> DataFrame:
    """Each user's events with ticker, isin and company."""
    u, day = F.col("user_id"), F.col("ts").cast("date")
    period = F.floor((F.dayofmonth(day) + u % 7) / 10)
    text = lambda n: F.lpad(n.cast("string"), 4, "0")
    ticker = F.concat(F.lit("T"), text(u), F.when(u % 3 == 0, period.cast("string")).otherwise(""))
    isin = F.concat(F.lit("BR"), text(u), F.when((u % 5 == 0) & (period == 2), "ACNPR").otherwise("ACNOR"), period.cast("string"))
    return table(spark, d, "events").select(ticker.alias("ticker"), day.alias("day"), isin.alias("isin"), u.alias("company"), "event_type", "value", "ts", "event_id")


def lineage_inputs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    own = prints(spark, d)
    bars = own.groupBy("ticker", "day", "isin").agg(F.max_by("value", F.struct("ts", "event_id")).alias("close"))
    events = own.filter("event_type = 'error' and value > 40").select("isin", F.col("day").alias("last_cum")).distinct()
    return bars, own.select("ticker", "company").distinct(), events


CHAINS = """p AS (
  SELECT *, ts::DATE AS day, (day(ts) + user_id % 7) // 10 AS period FROM events),
x AS (
  SELECT *, 'T' || lpad(user_id::VARCHAR, 4, '0') || CASE WHEN user_id % 3 = 0 THEN period::VARCHAR ELSE '' END AS ticker,
         'BR' || lpad(user_id::VARCHAR, 4, '0') || CASE WHEN user_id % 5 = 0 AND period = 2 THEN 'ACNPR' ELSE 'ACNOR' END || period AS isin FROM p),
bars AS (SELECT ticker, day, isin, arg_max(value, (ts, event_id)) AS close FROM x GROUP BY ALL),
ins AS (SELECT ticker, isin, min(day) AS first, max(day) AS last FROM bars GROUP BY ALL),
firm AS (SELECT DISTINCT ticker, user_id AS company FROM x),
ev AS (SELECT DISTINCT isin, day AS last_cum FROM x WHERE event_type = 'error' AND value > 40),
cand AS (
  SELECT n.ticker, n.isin, o.ticker AS old_ticker, o.isin AS old_isin, o.last AS old_last
  FROM ins n JOIN ins o ON o.isin <> n.isin AND substr(o.isin, 7, 5) = substr(n.isin, 7, 5) AND o.last < n.first
  WHERE (o.ticker = n.ticker OR EXISTS (SELECT 1 FROM firm a JOIN firm b USING (company) WHERE a.ticker = n.ticker AND b.ticker = o.ticker))
    AND o.last = (SELECT max(day) FROM bars WHERE day < n.first)
    AND NOT EXISTS (SELECT 1 FROM bars b WHERE b.isin = o.isin AND b.day >= n.first)
    AND NOT EXISTS (SELECT 1 FROM ev WHERE ev.isin IN (o.isin, n.isin) AND last_cum >= o.last AND last_cum < n.first)),
step AS (SELECT * FROM cand QUALIFY count(*) OVER (PARTITION BY ticker, isin) = 1),
walk AS (
  SELECT ticker, 1 AS k, ticker AS name, isin, last AS last_session FROM (SELECT * FROM ins QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY last DESC, isin DESC) = 1)
  UNION ALL SELECT w.ticker, k + 1, s.old_ticker, s.old_isin, s.old_last FROM walk w JOIN step s ON s.ticker = w.name AND s.isin = w.isin WHERE k < 10),
chain AS (SELECT w.ticker, max(k) OVER (PARTITION BY w.ticker) - k + 1 AS seq, name, w.isin, first AS first_session, last_session FROM walk w JOIN ins i ON i.ticker = w.name AND i.isin = w.isin)"""


@query(f"WITH RECURSIVE {CHAINS} SELECT * FROM chain")
def ticker_lineages(spark: SparkSession, d: str) -> DataFrame:
    """Every ticker's chain of instruments, oldest first."""
    return L.chains(*lineage_inputs(spark, d))


@query(f"WITH RECURSIVE {CHAINS} SELECT c.ticker, c.seq, c.name, b.day, b.isin, b.close FROM chain c JOIN bars b ON b.ticker = c.name AND b.isin = c.isin AND b.day BETWEEN first_session AND last_session")
def lineage_history(spark: SparkSession, d: str) -> DataFrame:
    """Every ticker's bars through all its earlier names."""
    return L.histories(*lineage_inputs(spark, d))


@query(
    """WITH o AS (SELECT l_partkey AS part, l_shipdate::DATE AS valid, l_shipdate::DATE + (l_linenumber * 10 - 30)::INT AS known, l_extendedprice AS price, l_quantity AS qty FROM lineitem),
t AS (SELECT part, valid, known, min((price, qty)) AS v, min((price, qty)) <> max((price, qty)) AS odd FROM o GROUP BY ALL),
q AS (SELECT o_orderkey AS id, o_custkey AS part, o_orderdate::DATE AS day, o_orderdate::DATE + (o_orderkey % 60 - 30)::INT AS cutoff FROM orders),
m AS (SELECT q.id, q.part, q.day, q.cutoff, t.valid, t.known, t.v, t.odd FROM q LEFT JOIN t ON t.part = q.part AND t.valid <= day AND t.known <= cutoff
      QUALIFY row_number() OVER (PARTITION BY id ORDER BY t.valid DESC NULLS LAST, t.known DESC) = 1)
SELECT id, part, day, cutoff, valid, known, CASE WHEN NOT odd THEN v[1] END AS price, CASE WHEN NOT odd THEN v[2] END AS qty, odd AS is_ambiguous FROM m"""
)
def known_values(spark: SparkSession, d: str) -> DataFrame:
    """For each order the value of its part that held on its day, as known at its cutoff."""
    ship = F.col("l_shipdate").cast("date")
    seen = table(spark, d, "lineitem").select(F.col("l_partkey").alias("part"), ship.alias("valid"), F.date_add(ship, (F.col("l_linenumber") * 10 - 30).cast("int")).alias("known"), F.col("l_extendedprice").alias("price"), F.col("l_quantity").alias("qty"))
    day = F.col("o_orderdate").cast("date")
    asked = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("part"), day.alias("day"), F.date_add(day, (F.col("o_orderkey") % 60 - 30).cast("int")).alias("cutoff"))
    return L.known_at(asked, seen, "part", "day", "cutoff", ["price", "qty"])
