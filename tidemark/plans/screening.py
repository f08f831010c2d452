"""Queries for performance and screens."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.core import month, safe_div
from tidemark.operators import performance as P
from tidemark.operators import screens as S
from tidemark.plans.base import FACT, LINES, SESSIONS, entities, fact, lines, query, sessions, since_until, table
from tidemark.plans.warehouse import AGING, aging

PERF = FACT + """,
lagged AS (SELECT *, lag(quota) OVER w AS lq, lag(nav) OVER w AS ln FROM fact WINDOW w AS (PARTITION BY entity ORDER BY period)),
rets AS (SELECT entity, family, period, CASE WHEN family = 'MACHINERY' THEN CASE WHEN quota > 0 AND lq > 0 THEN quota / lq - 1 END
  WHEN family = 'BUILDING' THEN inflow / nullif(nav, 0) / 100 ELSE CASE WHEN nav > 0 AND ln > 0 THEN nav / ln - 1 END END AS ret FROM lagged)"""


def returns(spark, d):
    basis = {"MACHINERY": ("ratio", F.col("quota")), "BUILDING": ("rate", safe_div("inflow", "nav") / 100), "": ("ratio", F.col("nav"))}
    return P.period_returns(fact(spark, d), ["entity"], "period", basis, "family").select("entity", "family", "period", "ret")


@query(f"""WITH {PERF} SELECT entity, family, period, round(ret, 6) AS ret,
  round(exp(sum(ln(1 + greatest(coalesce(ret, 0), -0.99::DOUBLE))) OVER (PARTITION BY entity ORDER BY period)) - 1, 6) AS cumulative FROM rets""")
def fund_performance_series(spark, d):
    return P.cumulative(returns(spark, d), ["entity"], "period")


@query(f"""WITH {FACT}, e AS (SELECT entity, family, arg_min(nav, period) AS first_value, arg_max(nav, period) AS last_value, count(nav) AS n_obs FROM fact GROUP BY 1, 2 HAVING count(nav) >= 4),
r AS (SELECT *, last_value / nullif(first_value, 0) - 1 AS ret FROM e),
x AS (SELECT *, rank() OVER (PARTITION BY family ORDER BY ret DESC NULLS LAST) AS rank, round(percent_rank() OVER (PARTITION BY family ORDER BY ret), 4) AS percent_rank FROM r)
SELECT * REPLACE (round(ret, 6) AS ret) FROM x WHERE rank <= 50""")
def fund_performance_ranking(spark, d):
    return P.performance_ranking(fact(spark, d), "entity", "period", "nav", "family", 4, 50)


@query(f"""WITH {SESSIONS}, s AS (SELECT *, first_value(close) OVER (PARTITION BY ticker ORDER BY day) AS f FROM sessions) SELECT ticker, day, close, round(close / nullif(f, 0) - 1, 6) AS since_first FROM s""")
def etf_performance_series(spark, d):
    return P.since_first(sessions(spark, d).select("ticker", "day", "close"), ["ticker"], "day", "close")


@query(f"""WITH {SESSIONS}, s AS (SELECT *, close / nullif(lag(close) OVER (PARTITION BY ticker ORDER BY day), 0) - 1 AS r FROM sessions),
g AS (SELECT ticker, arg_min(close, day) AS first_value, arg_max(close, day) AS last_value, count(*) AS n_obs, stddev_samp(r) AS v FROM s GROUP BY 1 HAVING count(*) >= 2)
SELECT ticker, first_value, last_value, n_obs, round(v, 6) AS volatility, round(last_value / nullif(first_value, 0) - 1, 6) AS "return", rank() OVER (ORDER BY last_value / nullif(first_value, 0) - 1 DESC NULLS LAST) AS rank FROM g""")
def etf_performance_ranking(spark, d):
    return P.daily_metric_ranking(sessions(spark, d), "ticker", "day", "close")


@query("""SELECT ts::DATE AS day, """ + ", ".join(f"max(value) FILTER (event_type = '{t}') AS {t}" for t in ("click", "error", "purchase", "signup", "view")) + " FROM events GROUP BY 1")
def etf_class_performance(spark, d):
    rows = table(spark, d, "events").withColumn("day", F.col("ts").cast("date"))
    return P.wide(rows, ["day"], "event_type", "value", ["click", "error", "purchase", "signup", "view"])


@query(f"""WITH {SESSIONS} SELECT ticker, day, close, c_mktsegment AS segment FROM (SELECT * FROM sessions QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY day DESC) = 1) LEFT JOIN customer ON c_custkey = ticker""")
def etf_market_latest(spark, d):
    registry = table(spark, d, "customer").select(F.col("c_custkey").alias("ticker"), F.col("c_mktsegment").alias("segment"))
    return P.latest_snapshot(sessions(spark, d).select("ticker", "day", "close"), "ticker", "day", registry)


@query(f"""WITH {SESSIONS}, s AS (SELECT *, close / nullif(max(close) OVER (PARTITION BY ticker ORDER BY day), 0) - 1 AS dd, close / nullif(lag(close) OVER (PARTITION BY ticker ORDER BY day), 0) - 1 AS r FROM sessions)
SELECT ticker, round(arg_max(close, day) / nullif(arg_min(close, day), 0) - 1, 6) AS net, round(stddev_samp(r) * sqrt(252.0::DOUBLE), 6) AS vol, round(min(dd), 6) AS max_drawdown, count(close) AS n FROM s GROUP BY 1""")
def window_metrics(spark, d):
    return P.window_metrics(sessions(spark, d), ["ticker"], "day", "close", 252)


@query(f"""WITH {SESSIONS} SELECT ticker, day, round(close / nullif(max(close) OVER (PARTITION BY ticker ORDER BY day), 0) - 1, 6) AS drawdown FROM sessions""")
def drawdown_series(spark, d):
    return P.drawdown(sessions(spark, d), ["ticker"], "day", "close").select("ticker", "day", "drawdown")


@query("""WITH m AS (SELECT l_returnflag, date_trunc('month', l_shipdate)::DATE AS period, round(avg(l_discount) * 10, 6) AS change FROM lineitem GROUP BY 1, 2)
SELECT *, CASE WHEN count(change) OVER w = 12 AND min(period) OVER w = period - INTERVAL 11 MONTH AND min(change) OVER w > -100 THEN round((exp(sum(ln(1 + change / 100)) OVER w) - 1) * 100, 2) END AS rolling
FROM m WINDOW w AS (PARTITION BY l_returnflag ORDER BY period ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)""")
def inflation_12m(spark, d):
    monthly = table(spark, d, "lineitem").groupBy("l_returnflag", month("l_shipdate").alias("period")).agg(F.round(F.avg("l_discount") * 10, 6).alias("change"))
    return P.rolling_change(monthly, ["l_returnflag"], "period", "change")


@query("""WITH r AS (SELECT o_custkey AS entity, o_orderkey AS line, o_totalprice AS value, (o_orderkey % 41 - 20) / 100.0::DOUBLE AS ret FROM orders),
s AS (SELECT *, value / (1 + ret) AS start_value FROM r), t AS (SELECT *, (sum(start_value::DECIMAL(28,6)) OVER (PARTITION BY entity))::DOUBLE AS total FROM s)
SELECT entity, line, round(start_value, 6) AS start_value, round(start_value / total, 6) AS weight, round(start_value / total * ret, 6) AS contribution FROM t""")
def portfolio_contribution(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("entity"), F.col("o_orderkey").alias("line"), F.col("o_totalprice").alias("value"), ((F.col("o_orderkey") % 41 - 20) / 100).alias("ret"))
    return P.contribution(rows, ["entity"], "value", "ret").select("entity", "line", "start_value", "weight", "contribution")


@query("""WITH r AS (SELECT l_returnflag, l_discount - 0.05::DOUBLE AS x, l_extendedprice AS w FROM lineitem)
SELECT l_returnflag, round(median(x), 6) AS median_excess, round(sum(x * w) / sum(w), 6) AS weighted_excess, round(avg((x > 0)::INT), 6) AS share_above, count(*) AS n FROM r GROUP BY 1""")
def equity_excess_summary(spark, d):
    return P.excess_summary(table(spark, d, "lineitem").withColumn("b", F.lit(0.05)), ["l_returnflag"], "l_discount", "b", "l_extendedprice")


@query(f"""WITH {PERF}, r AS (SELECT entity, family, ret FROM rets WHERE period = DATE '2000-06-01'),
e AS (SELECT family, quantile_cont(ret, 0.01) AS lo, quantile_cont(ret, 0.99) AS hi FROM r WHERE ret IS NOT NULL GROUP BY 1),
p AS (SELECT family, avg(least(greatest(ret, lo), hi)) AS m, stddev_samp(least(greatest(ret, lo), hi)) AS s, count(ret) AS n FROM r JOIN e USING (family) WHERE ret IS NOT NULL GROUP BY 1),
z AS (SELECT entity, family, CASE WHEN n >= 30 THEN (ret - m) / nullif(s, 0) END AS z, n AS n_peers FROM r LEFT JOIN p USING (family))
SELECT entity, family, n_peers, round(z, 6) AS z, CASE WHEN abs(z) > 3 THEN 'forte' WHEN abs(z) > 2 THEN 'atencao' WHEN z IS NOT NULL THEN 'normal' END AS level FROM z""")
def portfolio_movement(spark, d):
    own = returns(spark, d).filter("period = date'2000-06-01'")
    return P.movement(own, "family", "ret").select("entity", "family", "n_peers", "z", "level")


AG = AGING + ", ag AS (SELECT l_suppkey AS entity, * EXCLUDE (l_suppkey) FROM aging), navs AS (SELECT l_suppkey AS entity, date_trunc('month', l_shipdate)::DATE AS period, sum(l_extendedprice::DECIMAL(18,2))::DOUBLE AS nav, count(*) AS holders FROM lineitem GROUP BY 1, 2)"


JUNE = ("2000-06-01", "2000-07-01")


def aged(spark, d, *days):
    return aging(spark, d, *days).withColumnRenamed("l_suppkey", "entity")


def navs(spark, d, *days):
    return since_until(table(spark, d, "lineitem"), "l_shipdate", *days).groupBy(F.col("l_suppkey").alias("entity"), month("l_shipdate").alias("period")).agg(F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double").alias("nav"), F.count("*").alias("holders"))


@query(f"WITH {AG} SELECT entity, overdue, nav, round(overdue / nullif(nav, 0) * 100, 6) AS pct FROM ag JOIN navs USING (entity, period) WHERE period = DATE '2000-06-01' AND overdue / nullif(nav, 0) * 100 > 90 AND nav > 100000")
def screen_zombie_growth(spark, d):
    return S.growing_overdue(aged(spark, d, *JUNE), navs(spark, d, *JUNE), "2000-06-01", 90, 100000)


@query(f"""WITH {FACT}, g AS (SELECT entity, min(holders) AS min_holders, max(nav) AS max_nav, count(*) AS n_months FROM fact WHERE period > DATE '2000-03-01' AND period <= DATE '2000-06-01' GROUP BY 1)
SELECT *, '{{"max_investors":40,"min_aum":200000}}' AS parameters FROM g WHERE min_holders < 40 AND max_nav > 200000""")
def screen_captive_vehicles(spark, d):
    return S.with_parameters(S.captive(fact(spark, d), "2000-06-15", 3, 40, 200000), max_investors=40, min_aum=200000)


@query(f"""WITH {AG}, g AS (SELECT entity, max(pct_long) AS max_pct, min(pct_long) AS min_pct, count(*) AS n_months FROM ag WHERE period > DATE '1999-06-01' AND period <= DATE '2000-06-01' GROUP BY 1)
SELECT * FROM g WHERE max_pct > 60 AND max_pct - min_pct < 60""")
def screen_evergreen_aging(spark, d):
    return S.evergreen(aged(spark, d, "1999-07-01", "2000-07-01"), "2000-06-01", 12, 60, 60)


@query("""WITH r AS (SELECT l_partkey, l_suppkey, l_shipdate::DATE AS day, l_shipdate::DATE + 90 AS maturity, nullif(l_returnflag, 'R') AS status, l_extendedprice AS v FROM lineitem),
last AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY day DESC, v DESC, status NULLS LAST) = 1)
SELECT * FROM last WHERE maturity < DATE '2000-01-01' AND status NOT IN ('A') AND v >= 30000""")
def screen_overdue_series(spark, d):
    rows = table(spark, d, "lineitem").select("l_partkey", "l_suppkey", F.col("l_shipdate").cast("date").alias("day"), F.date_add(F.col("l_shipdate").cast("date"), 90).alias("maturity"), F.nullif("l_returnflag", F.lit("R")).alias("status"), F.col("l_extendedprice").alias("v"))
    return S.overdue_series(rows, ["l_partkey", "l_suppkey"], "day", "maturity", "status", ["A"], "2000-01-01", "v", 30000)


DORMANT = FACT + ", quiet AS (SELECT * REPLACE (CASE WHEN entity % 3 = 0 THEN 0 ELSE inflow END AS inflow, CASE WHEN entity % 3 = 0 THEN 0 ELSE outflow END AS outflow, CASE WHEN entity % 6 = 0 THEN 0 ELSE holders END AS holders) FROM fact)"


def quiet(spark, d):
    third = lambda c, k: F.when(F.col("entity") % k == 0, F.lit(0)).otherwise(F.col(c))
    return fact(spark, d).withColumns({"inflow": third("inflow", 3), "outflow": third("outflow", 3), "holders": third("holders", 6)})


@query(f"""WITH {DORMANT}, g AS (SELECT entity, count(DISTINCT period) AS n, bool_and(inflow IS NOT NULL AND outflow IS NOT NULL AND holders IS NOT NULL) AS w, sum(inflow::DECIMAL(18,2) + outflow::DECIMAL(18,2)) AS m, max(holders) AS max_holders, arg_max(nav, period) AS nav
  FROM quiet WHERE period > DATE '2000-04-01' AND period <= DATE '2000-06-01' GROUP BY 1)
SELECT entity, CASE WHEN max_holders = 0 THEN 'empty_shell' ELSE 'parked_capital' END AS dormancy, max_holders, nav FROM g WHERE n = 2 AND w AND m = 0""")
def screen_dormant_funds(spark, d):
    return S.dormant(quiet(spark, d), "2000-06-01", 2)


@query(f"""WITH {DORMANT}, r AS (SELECT entity, period, count(*) OVER w AS n, sum(inflow::DECIMAL(18,2) + outflow::DECIMAL(18,2)) OVER w AS m, max(holders) OVER w AS h FROM quiet
  WINDOW w AS (PARTITION BY entity ORDER BY period RANGE BETWEEN INTERVAL 1 MONTH PRECEDING AND CURRENT ROW))
SELECT period, count(*) FILTER (n = 2 AND m = 0 AND h = 0) AS empty_shells, count(*) FILTER (n = 2 AND m = 0 AND h <> 0) AS parked, count(*) AS n_entities FROM r GROUP BY 1""")
def screen_dormant_trend(spark, d):
    return S.dormant_trend(quiet(spark, d), 2)


@query(f"""WITH {FACT}, r AS (SELECT * FROM fact WHERE period BETWEEN DATE '1999-07-01' AND DATE '2000-06-01' AND nav > 0 AND outflow IS NOT NULL),
g AS (SELECT entity, arg_max(outflow, period) - arg_min(outflow, period) AS d_sum, arg_max(outflow / nav * 100, period) - arg_min(outflow / nav * 100, period) AS d_points, count(DISTINCT period) AS n_months, max(period) < DATE '2000-06-01' AS stopped_reporting FROM r GROUP BY 1 HAVING count(DISTINCT period) >= 2)
SELECT entity, round(d_sum, 6) AS d_sum, round(d_points, 6) AS d_points, n_months, stopped_reporting, CASE WHEN d_sum >= 10000 AND d_points >= 1 THEN 'consistent_worsening' WHEN d_sum >= 10000 THEN 'value_up_rate_masked' WHEN d_points >= 1 THEN 'denominator_only'
  WHEN d_sum <= -10000 AND d_points <= -1 THEN 'improvement' ELSE 'stable' END AS driver FROM g""")
def screen_delinquency_drivers(spark, d):
    return S.drivers(fact(spark, d), "outflow", "1999-07-01", "2000-06-01", 2, 10000.0, 1.0, earliest="1995-01-01")


@query("""WITH f AS (SELECT l_suppkey AS entity, date_trunc('month', o_orderdate)::DATE AS period, min(l_shipdate::DATE) AS delivered FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1, 2),
l AS (SELECT *, date_diff('day', last_day(period) + 15, delivered) AS lag FROM f)
SELECT entity, count(*) AS n_filed, count(*) FILTER (lag >= 5) AS n_late, round(median(lag), 6) AS median_lag, max(lag) AS max_lag FROM l GROUP BY 1 HAVING count(*) FILTER (lag >= 5) >= 2""")
def screen_late_filers(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), month("o_orderdate").alias("period"))
    rows = table(spark, d, "lineitem").select("l_orderkey", F.col("l_suppkey").alias("entity"), F.col("l_shipdate").cast("date").alias("delivered")).join(o, "l_orderkey")
    return S.late_filers(rows)


@query(f"""WITH {FACT} SELECT entity, max(period) AS last_period, date_diff('month', max(period), DATE '2001-07-01') AS silent_months FROM fact GROUP BY 1 HAVING date_diff('month', max(period), DATE '2001-07-01') BETWEEN 3 AND 24""")
def screen_silent_filers(spark, d):
    return S.silent_filers(fact(spark, d), "2001-07-01", 3, 24)


@query("""WITH p AS (SELECT l_suppkey, l_orderkey, l_returnflag, count(*) AS n FROM lineitem GROUP BY 1, 2, 3),
g AS (SELECT l_suppkey, count(*) AS n_docs, count(*) FILTER (n > 1) AS n_restated, coalesce(string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) FILTER (n > 1), '') AS kinds FROM p GROUP BY 1)
SELECT *, round(100 * n_restated / n_docs, 6) AS rate_pct FROM g WHERE n_restated >= 3 AND 100.0 * n_restated / n_docs >= 0.5""")
def screen_restatements(spark, d):
    return S.restatements(table(spark, d, "lineitem"), "l_suppkey", ["l_orderkey"], "l_linenumber", "l_returnflag", 3, 0.5)


@query(f"""WITH {FACT}, g AS (SELECT entity, sum(outflow::DECIMAL(18,2))::DOUBLE / nullif(sum(nav::DECIMAL(18,2))::DOUBLE, 0) AS r FROM fact GROUP BY 1)
SELECT entity, round(r, 6) AS rate, CASE WHEN r IS NULL THEN NULL WHEN r > 0.6 THEN 'atencao' WHEN r > 0.4 THEN 'moderado' ELSE 'baixo' END AS severity FROM g""")
def portfolio_risks(spark, d):
    money = lambda c: F.sum(F.col(c).cast("decimal(18,2)")).cast("double")
    out = fact(spark, d).groupBy("entity").agg(safe_div(money("outflow"), money("nav")).alias("rate"))
    return out.withColumn("severity", S.severity(F.col("rate"), 0.4, 0.6))


@query(f"""WITH {FACT}, {LINES} SELECT entity, period, nav FROM fact WHERE EXISTS (SELECT 1 FROM lines WHERE lender = entity AND kind = 'R' AND rate > 0.09)""")
def portfolio_signals(spark, d):
    hits = lines(spark, d).filter("kind = 'R' and rate > 0.09").select(F.col("lender").alias("entity"))
    return fact(spark, d).join(hits, "entity", "left_semi").select("entity", "period", "nav")


@query("""SELECT source, count(*) AS n, count(*) FILTER (quality = 0) AS n_low, count(*) FILTER (toxic = 1) AS n_toxic, round(count(*) FILTER (quality = 0) / count(*), 6) AS share_low FROM documents JOIN labels USING (doc_id) GROUP BY 1""")
def screen_labels(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "source").join(table(spark, d, "labels"), "doc_id")
    out = rows.groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.col("quality") == 0).alias("n_low"), F.count_if(F.col("toxic") == 1).alias("n_toxic"))
    return out.withColumn("share_low", F.col("n_low") / F.col("n"))


@query("""SELECT c_mktsegment AS family, count(*) AS n, count(*) FILTER (c_acctbal > 0) AS n_active FROM customer GROUP BY 1""")
def family_counts(spark, d):
    return entities(spark, d).groupBy("family").agg(F.count("*").alias("n"), F.count_if("active").alias("n_active"))
