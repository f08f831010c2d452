"""Queries on quote histories and the panel of all families."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import history as H
from tidemark.plans.base import DAILY, FACT, SESSIONS, daily, fact, query, sessions, table
from tidemark.plans.markets import ADJ, share_events

STATUS = """ev AS (SELECT DISTINCT user_id AS ticker, CASE event_id % 5 WHEN 0 THEN 'GRUPAMENTO' WHEN 1 THEN 'CISAO' ELSE 'DESDOBRAMENTO' END AS kind, ts::DATE AS last_cum, CASE WHEN event_id % 3 = 0 THEN NULL ELSE 10.0 + event_id % 2 END::DOUBLE AS factor, event_id % 2 AS asset FROM events WHERE event_type = 'signup'),
anchors AS (SELECT ticker, max(day) AS anchor FROM sessions GROUP BY 1),
bl AS (SELECT e.*, a.anchor, CASE WHEN kind NOT IN ('DESDOBRAMENTO', 'GRUPAMENTO', 'BONIFICACAO') THEN 'unsupported corporate event ' || kind WHEN factor IS NULL THEN 'unreadable factor on ' || kind
  WHEN count(*) OVER (PARTITION BY e.ticker, kind, last_cum, factor) > 1 THEN 'ambiguous ' || kind || ' paid in two assets' WHEN count(*) OVER (PARTITION BY e.ticker, kind, last_cum) > 1 THEN 'ambiguous ' || kind || ' published with two factors' END AS reason
  FROM ev e JOIN anchors a ON a.ticker = e.ticker WHERE last_cum < anchor),
st AS (SELECT ticker, max(last_cum) AS block_through, arg_min(reason, (-epoch(last_cum), reason)) AS block_reason FROM bl WHERE reason IS NOT NULL GROUP BY 1)"""


def doubtful_events(spark: SparkSession, d: str) -> DataFrame:
    """Share events of which some are of another kind, unreadable, or published twice."""
    k = F.col("event_id")
    kind = F.when(k % 5 == 0, "GRUPAMENTO").when(k % 5 == 1, "CISAO").otherwise("DESDOBRAMENTO")
    return table(spark, d, "events").filter("event_type = 'signup'").select(F.col("user_id").alias("ticker"), F.col("ts").cast("date").alias("last_cum"), kind.alias("kind"), F.when(k % 3 != 0, 10.0 + k % 2).alias("factor"), (k % 2).alias("asset"))


@query(f"WITH {SESSIONS}, {STATUS} SELECT ticker, anchor, block_through, block_reason FROM anchors LEFT JOIN st USING (ticker)")
def close_adj_status(spark: SparkSession, d: str) -> DataFrame:
    anchors = sessions(spark, d).groupBy("ticker").agg(F.max("day").alias("anchor"))
    return H.adjustment_status(doubtful_events(spark, d), anchors)


@query(f"""WITH {ADJ}, x AS (SELECT ticker, last_cum, kind, factor FROM share), an AS (SELECT ticker, max(day) AS anchor FROM sessions GROUP BY 1),
b AS (SELECT x.ticker, max(last_cum) AS block FROM (SELECT ticker, last_cum FROM (SELECT DISTINCT ticker, kind, last_cum, factor FROM share) GROUP BY ticker, kind, last_cum HAVING count(*) > 1) x JOIN an USING (ticker) WHERE last_cum < anchor GROUP BY 1)
SELECT a.ticker, a.day, a.close, CASE WHEN b.block IS NULL OR a.day > b.block THEN a.close_adj END AS close_adj FROM adj a LEFT JOIN b USING (ticker)""")
def quote_history(spark: SparkSession, d: str) -> DataFrame:
    """Adjusted histories of all tickers, without days that an ambiguous event blocks."""
    events = share_events(spark, d).withColumn("asset", F.lit(0))
    return H.histories(sessions(spark, d).select("ticker", "day", "close"), "adjusted", events, anchor="2024-01-30")


@query(f"""WITH {SESSIONS} SELECT CASE WHEN ticker % 10 = 3 AND day < DATE '2024-01-12' THEN ticker + 1 ELSE ticker END AS ticker, day, close FROM sessions""")
def lineage_splice(spark: SparkSession, d: str) -> DataFrame:
    """Histories under their newest name."""
    own = sessions(spark, d).select("ticker", "day", "close")
    renames = own.filter("ticker % 10 = 3").select(F.col("ticker").alias("old"), (F.col("ticker") + 1).alias("new"), F.lit("2024-01-12").cast("date").alias("day")).distinct()
    return H.spliced(own, renames)


PANEL = f"""{DAILY},
o AS (UNPIVOT (SELECT entity::VARCHAR AS id, subclass AS class, day AS date, nav::DOUBLE AS nav, inflow::DOUBLE AS inflow, holders::DOUBLE AS n_holders FROM daily) ON nav, inflow, n_holders INTO NAME metric VALUE value),
e AS (UNPIVOT (SELECT user_id::VARCHAR AS id, event_type AS class, ts::DATE AS date, max(value)::DOUBLE AS close, count(*)::DOUBLE AS n_trades FROM events GROUP BY 1, 2, 3) ON close, n_trades INTO NAME metric VALUE value),
l AS (UNPIVOT (SELECT l_partkey::VARCHAR AS id, l_returnflag AS class, l_shipdate::DATE AS date, max(l_discount * 100)::DOUBLE AS yield_pct FROM lineitem GROUP BY 1, 2, 3) ON yield_pct INTO NAME metric VALUE value),
p0 AS (SELECT 'fund' AS family, * FROM o UNION ALL SELECT 'market', * FROM e UNION ALL SELECT 'security', * FROM l),
p AS (SELECT *, CASE WHEN metric LIKE '%\\_pct' ESCAPE '\\' THEN 'percent' WHEN metric LIKE 'n\\_%' ESCAPE '\\' THEN 'count' ELSE 'money' END AS unit FROM p0)"""


def sources(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    fund = daily(spark, d).select(F.col("entity").alias("id"), F.col("subclass").alias("class"), "day", "nav", "inflow", F.col("holders").alias("n_holders"))
    market = table(spark, d, "events").groupBy(F.col("user_id").alias("id"), F.col("event_type").alias("class"), F.col("ts").cast("date").alias("day")).agg(F.max("value").alias("close"), F.count("*").alias("n_trades"))
    security = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("id"), F.col("l_returnflag").alias("class"), F.col("l_shipdate").cast("date").alias("day")).agg(F.max(F.col("l_discount") * 100).alias("yield_pct"))
    return {"fund": fund, "market": market, "security": security}


@query(f"WITH {PANEL} SELECT family, id, metric, class, last_day(date) AS date, round(arg_max(value, (date, value)), 6) AS value, any_value(unit) AS unit FROM p GROUP BY 1, 2, 3, 4, 5")
def panel_month_end(spark: SparkSession, d: str) -> DataFrame:
    """Every family's metrics at month ends."""
    return H.panel(sources(spark, d), month_end=True)


@query(f"WITH {PANEL}, w AS (SELECT * FROM p WHERE family IN ('fund', 'market') AND metric IN ('nav', 'close', 'n_trades') AND date BETWEEN DATE '1996-01-01' AND DATE '2024-01-20') SELECT * FROM w WHERE (date, id, metric, class) > (DATE '1997-03-01', '20', 'nav', '') ORDER BY date, id, metric, class LIMIT 500")
def panel_after(spark: SparkSession, d: str) -> DataFrame:
    """A page of chosen metrics of two families in a window, after a cursor."""
    window = (datetime.date(1996, 1, 1), datetime.date(2024, 1, 20))
    return H.panel_page(H.panel(sources(spark, d), metrics=["nav", "close", "n_trades"], families=["fund", "market"], window=window), "1997-03-01|20|nav|", 500)


@query(
    f"""WITH {FACT},
c AS (SELECT family, period, count(DISTINCT entity) AS n FROM fact GROUP BY ALL),
m AS (SELECT *, median(n) OVER (PARTITION BY family ORDER BY period ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING) AS med FROM c),
e AS (SELECT family, max(period) AS last FROM m WHERE last_day(period) < DATE '2001-07-15' AND coalesce(n >= 0.8::DOUBLE * med, true) GROUP BY family),
w AS (SELECT fact.* FROM fact JOIN e USING (family) WHERE period <= last AND period >= DATE '1997-01-01'),
k AS (SELECT family, entity FROM w GROUP BY ALL HAVING arg_max(nav, period) FILTER (nav IS NOT NULL) >= 50000 AND count(inflow) >= 5)
SELECT family, entity AS id, period AS date, 'inflow' AS metric, inflow AS value FROM w JOIN k USING (family, entity) WHERE inflow IS NOT NULL"""
)
def panel_universe(spark: SparkSession, d: str) -> DataFrame:
    """Inflows of every family's funds of some size and history, each family until its own latest complete month."""
    return H.universe(fact(spark, d), "inflow", datetime.date(1997, 1, 1), datetime.date(2001, 7, 15), min_nav=50000, min_months=5)
