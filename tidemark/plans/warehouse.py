"""Queries for facts, dimensions and analytical functions over the monthly fact."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.core import month, safe_div
from tidemark.operators import analytics as A
from tidemark.operators import facts
from tidemark.plans.base import DAILY, FACT, LINES, SESSIONS, daily, entities, fact, lines, query, sessions, since_until, table

AS_OF = "2001-08-15"


@query(f"WITH {FACT} SELECT entity, period, nav, round(quota, 6) AS quota, holders, inflow, outflow FROM fact")
def fact_entity_monthly(spark, d):
    return facts.entity_month_fact(daily(spark, d))


COMPLETE = FACT + f""",
counts AS (SELECT period, count(DISTINCT entity) AS n_entities FROM fact GROUP BY 1),
medians AS (SELECT *, median(n_entities) OVER (ORDER BY period ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING) AS trailing_median FROM counts),
complete AS (SELECT *, last_day(period) < DATE '{AS_OF}' AND coalesce(n_entities >= 0.8::DOUBLE * trailing_median, true) AS is_complete FROM medians)"""


@query(f"WITH {COMPLETE} SELECT * FROM complete")
def period_completeness(spark, d):
    return facts.period_completeness(fact(spark, d), AS_OF)


@query(f"WITH {COMPLETE} SELECT max(period) FILTER (is_complete) AS period FROM complete")
def latest_complete_period(spark, d):
    return facts.latest_complete_period(facts.period_completeness(fact(spark, d), AS_OF), AS_OF)


@query(f"""WITH {FACT}, long AS (UNPIVOT (SELECT family, period, nav::DOUBLE AS nav, quota::DOUBLE AS quota, inflow::DOUBLE AS inflow, outflow::DOUBLE AS outflow, holders::DOUBLE AS holders FROM fact) ON nav, quota, inflow, outflow, holders INTO NAME metric VALUE value),
all_rows AS (SELECT family, count(*) AS total_rows FROM fact GROUP BY 1)
SELECT family, metric, min(period) AS first_period, max(period) AS last_period, count(*) AS filed_rows, any_value(total_rows) AS total_rows FROM long JOIN all_rows USING (family) GROUP BY 1, 2""")
def metric_coverage(spark, d):
    return facts.metric_coverage(fact(spark, d), ["nav", "quota", "inflow", "outflow", "holders"])


@query("""WITH o AS (SELECT o_custkey AS entity, date_trunc('month', o_orderdate)::DATE AS period, o_orderstatus AS s FROM orders)
SELECT x.*, c_name AS name FROM (
  SELECT entity, min(period) AS first_period, max(period) AS last_period, count(DISTINCT period) AS n_periods, s AS family FROM o GROUP BY entity, s) x
LEFT JOIN customer ON c_custkey = entity WHERE entity NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < -900)""")
def dim_entity(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("entity"), month("o_orderdate").alias("period"), "o_orderstatus")
    families = {s: rows.filter(F.col("o_orderstatus") == s) for s in ("F", "O", "P")}
    known = entities(spark, d)
    return facts.dim_entity(families, known.select("entity", "name"), table(spark, d, "customer").filter("c_acctbal < -900").select(F.col("c_custkey").alias("entity")))


@query("""SELECT l_partkey, l_suppkey, min(l_shipdate::DATE) AS first_day, max(l_shipdate::DATE) AS last_day, max(l_returnflag) AS l_returnflag, max(l_linestatus) AS l_linestatus,
  count(DISTINCT l_shipdate::DATE) AS n_days FROM lineitem GROUP BY 1, 2""")
def dim_series(spark, d):
    rows = table(spark, d, "lineitem").withColumn("day", F.col("l_shipdate").cast("date"))
    return facts.dim_series(rows, ["l_partkey", "l_suppkey"], "day", ["l_returnflag", "l_linestatus"])


@query("""WITH r AS (SELECT l_partkey, l_suppkey, l_shipdate::DATE AS day, date_trunc('month', l_shipdate)::DATE AS period, l_extendedprice AS v FROM lineitem),
last AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY l_partkey, period ORDER BY day DESC, v DESC, l_suppkey) = 1),
f AS (SELECT l_suppkey, period, sum(v::DECIMAL(18,2))::DOUBLE AS flow FROM r GROUP BY 1, 2)
SELECT l_partkey, l_suppkey, period, v AS value, flow FROM last LEFT JOIN f USING (l_suppkey, period)""")
def fact_series_monthly(spark, d):
    rows = table(spark, d, "lineitem").withColumn("day", F.col("l_shipdate").cast("date"))
    return facts.series_month_fact(rows, rows, "l_partkey", "l_suppkey", "day", "l_extendedprice", "l_extendedprice")


@query("""SELECT conv_id, turn, role FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role, text) = 1""")
def latest_version(spark, d):
    return facts.latest_version(table(spark, d, "conversations"), ["conv_id"], "turn", ["role", "text"]).select("conv_id", "turn", "role")


@query(f"""WITH {DAILY} SELECT entity, subclass, day, date_diff('day', day, DATE '{AS_OF}') AS age_days FROM (SELECT entity, subclass, max(day) AS day FROM daily GROUP BY 1, 2)""")
def latest_with_age(spark, d):
    return facts.latest_with_age(daily(spark, d).select("entity", "subclass", "day"), ["entity", "subclass"], "day", AS_OF)


@query("""SELECT l_partkey, l_returnflag AS mode, n FROM (SELECT l_partkey, l_returnflag, count(*) AS n FROM lineitem GROUP BY 1, 2)
QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY n DESC, l_returnflag) = 1""")
def mode_subtype(spark, d):
    return facts.mode_by(table(spark, d, "lineitem"), "l_partkey", "l_returnflag")


@query("""WITH e AS (SELECT ts::DATE AS day, event_type, user_id, value FROM events)
SELECT concat_ws('+', CASE WHEN grouping(day) = 0 THEN 'day' END, CASE WHEN grouping(event_type) = 0 THEN 'event_type' END) AS grain, day, event_type, count(*) AS n_rows,
  sum(value::DECIMAL(18,2))::DOUBLE AS total, count(DISTINCT user_id) AS n_distinct, round(median(value), 6) AS median
FROM e GROUP BY GROUPING SETS ((day, event_type), (day), (event_type), ())""")
def activity_grouping_sets(spark, d):
    rows = table(spark, d, "events").withColumn("day", F.col("ts").cast("date"))
    return facts.activity_grains(rows, [["day", "event_type"], ["day"], ["event_type"], []], "value", "user_id")


@query(f"""WITH o AS (SELECT o_custkey AS entity, date_trunc('month', o_orderdate)::DATE AS period FROM orders),
y AS (SELECT l_suppkey AS entity, date_trunc('year', l_shipdate)::DATE AS period FROM lineitem)
SELECT entity, min(period) AS first_period, max(period) AS last_period, count(*) AS n_rows, 'orders' AS family, max(period) >= DATE '2001-05-01' AS is_active FROM o GROUP BY 1
UNION ALL SELECT entity, min(period), max(period), count(*), 'lines', max(period) >= DATE '2000-01-01' FROM y GROUP BY 1""")
def instrument_activity(spark, d):
    monthly = table(spark, d, "orders").select(F.col("o_custkey").alias("entity"), month("o_orderdate").alias("period"))
    yearly = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("entity"), F.trunc(F.col("l_shipdate").cast("date"), "YEAR").alias("period"))
    return facts.instrument_activity({"orders": (monthly, "month"), "lines": (yearly, "year")}, AS_OF)


@query(f"""WITH {FACT}, last AS (SELECT entity, nav FROM fact WHERE nav IS NOT NULL QUALIFY row_number() OVER (PARTITION BY entity ORDER BY period DESC) = 1)
SELECT c_nationkey AS manager, count(DISTINCT c_custkey) AS n_entities, count(DISTINCT c_custkey) FILTER (c_acctbal > 0) AS n_active,
  coalesce(sum(nav::DECIMAL(18,2))::DOUBLE, 0) AS aum FROM customer LEFT JOIN last ON c_custkey = entity GROUP BY 1""")
def dim_manager(spark, d):
    return facts.manager_dim(entities(spark, d), fact(spark, d), "manager")


CATEGORIES = (("%eco%", "Economy"), ("%promo%", "Promotion"), ("s%", "Small or standard"))


@query("""SELECT CASE WHEN p_type ILIKE '%eco%' THEN 'Economy' WHEN p_type ILIKE '%promo%' THEN 'Promotion' WHEN p_type ILIKE 's%' THEN 'Small or standard' ELSE 'Other' END AS category,
  count(*) AS n, sum(p_retailprice::DECIMAL(18,2))::DOUBLE AS total FROM part GROUP BY 1""")
def dim_category(spark, d):
    return table(spark, d, "part").groupBy(facts.category(F.col("p_type"), CATEGORIES, "Other").alias("category")).agg(F.count("*").alias("n"), F.sum(F.col("p_retailprice").cast("decimal(18,2)")).alias("total"))


@query(f"""WITH {DAILY}, f AS (SELECT k.c_mktsegment AS vehicle, entity, day, period, nav, inflow, outflow FROM daily JOIN customer k ON c_custkey = entity),
moved AS (SELECT vehicle, period, sum(inflow::DECIMAL(18,2))::DOUBLE AS inflow, sum(outflow::DECIMAL(18,2))::DOUBLE AS outflow FROM f GROUP BY 1, 2),
held AS (SELECT vehicle, period, nav FROM f WHERE nav IS NOT NULL QUALIFY row_number() OVER (PARTITION BY vehicle, entity, period ORDER BY day DESC, nav DESC) = 1),
stock AS (SELECT vehicle, period, sum(nav::DECIMAL(18,2))::DOUBLE AS aum FROM held GROUP BY 1, 2),
rates AS (SELECT date_trunc('month', l_shipdate)::DATE AS period, l_discount AS rate FROM lineitem QUALIFY row_number() OVER (PARTITION BY date_trunc('month', l_shipdate) ORDER BY l_shipdate::DATE DESC, l_discount DESC) = 1)
SELECT vehicle, period, aum, inflow, outflow, rate FROM stock FULL JOIN moved USING (vehicle, period) LEFT JOIN rates USING (period)""")
def savings_flow_monthly(spark, d):
    rows = daily(spark, d).join(entities(spark, d).select("entity", F.col("family").alias("vehicle")), "entity")
    rates = table(spark, d, "lineitem").select(F.col("l_shipdate").cast("date").alias("day"), F.col("l_discount").alias("rate"))
    return facts.monthly_savings(rows, rows.filter("nav is not null").withColumnRenamed("nav", "level"), rates)


@query(f"""WITH {DAILY}, last AS (SELECT entity, subclass, year(day) AS y, nav, holders FROM daily QUALIFY row_number() OVER (PARTITION BY entity, year(day), subclass ORDER BY day DESC, nav DESC NULLS LAST, holders DESC) = 1)
SELECT entity, make_date(y, 12, 31) AS period, sum(nav::DECIMAL(18,2))::DOUBLE AS nav, sum(holders)::BIGINT AS holders FROM last GROUP BY 1, 2""")
def yearly_filers(spark, d):
    return A.entity_years(daily(spark, d))


@query(f"""WITH {FACT} SELECT entity, min(period) AS first_period, max(period) AS last_period, max(nav) AS peak_nav, arg_max(nav, period) AS latest_nav, max(period) AS latest_nav_period,
  max(period) >= DATE '{AS_OF}' - 90 AS is_active FROM fact GROUP BY 1""")
def fund_profile(spark, d):
    return A.profile(fact(spark, d), AS_OF)


@query(f"""WITH {FACT} SELECT c_custkey AS entity, c_name AS name, c_mktsegment AS family, latest_nav FROM customer LEFT JOIN (SELECT entity, arg_max(nav, period) AS latest_nav FROM fact GROUP BY 1) ON c_custkey = entity
WHERE c_name ILIKE '%77%' OR c_custkey::VARCHAR ILIKE '%77%' ORDER BY latest_nav DESC NULLS LAST, entity LIMIT 50""")
def search_funds(spark, d):
    return A.search(entities(spark, d).select("entity", "name", "family"), fact(spark, d), "77")


@query("""WITH f AS (SELECT c_mktsegment AS family, min(date_trunc('month', o_orderdate)::DATE) AS period FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY c_custkey, c_mktsegment)
SELECT period, family, count(*) AS n_new FROM f WHERE period BETWEEN DATE '1995-03-01' AND DATE '1999-12-31' GROUP BY 1, 2""")
def new_funds_per_period(spark, d):
    first = daily(spark, d).join(entities(spark, d).select("entity", "family"), "entity").groupBy("entity", "family").agg(F.min(month("day")).alias("first_period"))
    return A.new_per_period(first, "1995-03-01", "1999-12-31")


@query(f"WITH {FACT} SELECT period, nav, inflow, outflow FROM fact WHERE entity = 7 AND period BETWEEN DATE '1996-01-01' AND DATE '2000-12-31'")
def fund_nav_series(spark, d):
    return fact(spark, d).filter("entity = 7 and period between date'1996-01-01' and date'2000-12-31'").select("period", "nav", "inflow", "outflow")


@query(f"""WITH {FACT} SELECT entity, period, (inflow::DECIMAL(18,2) - outflow::DECIMAL(18,2))::DOUBLE AS net_flow,
  (sum(inflow::DECIMAL(18,2) - outflow::DECIMAL(18,2)) OVER (PARTITION BY entity ORDER BY period))::DOUBLE AS cumulative, round(outflow / nullif(nav, 0), 6) AS pressure FROM fact""")
def fund_flow_trend(spark, d):
    return A.flow_trend(fact(spark, d))


@query(f"""WITH {FACT} SELECT period, family, sum(nav::DECIMAL(18,2))::DOUBLE AS aum, count(DISTINCT entity) AS n_entities, sum(inflow::DECIMAL(18,2) - outflow::DECIMAL(18,2))::DOUBLE AS net_flow FROM fact GROUP BY 1, 2""")
def industry_aum_trend(spark, d):
    return A.industry_trend(fact(spark, d))


@query("""SELECT l_returnflag, """ + ", ".join(f"round(quantile_cont(l_extendedprice, {p / 100}), 6) AS p{p}" for p in (10, 25, 50, 75, 90)) + """, round(avg(l_extendedprice), 6) AS mean, round(stddev_samp(l_extendedprice), 6) AS sd,
  count(*) AS n, count(*) FILTER (l_extendedprice > 40000) AS n_above, round(median(l_extendedprice) - 40000, 6) AS spread FROM lineitem GROUP BY 1""")
def yield_distribution(spark, d):
    return A.distribution(table(spark, d, "lineitem"), "l_extendedprice", 40000.0, ["l_returnflag"])


@query(f"WITH {FACT} SELECT entity, family, nav AS value, rank FROM (SELECT *, rank() OVER (PARTITION BY family ORDER BY nav DESC NULLS LAST) AS rank FROM fact WHERE period = DATE '2000-06-01') WHERE rank <= 20")
def fund_ranking(spark, d):
    own = fact(spark, d).filter("period = date'2000-06-01'")
    return A.ranking(own, {"aum": F.col("nav"), "flow": F.col("inflow") - F.col("outflow")}, "aum", 20, ["family"]).select("entity", "family", "value", "rank")


@query(f"""WITH {FACT}, r AS (SELECT *, rank() OVER (PARTITION BY period ORDER BY nav DESC) AS rk, (sum(nav::DECIMAL(18,2)) OVER (PARTITION BY period))::DOUBLE AS t FROM fact)
SELECT period, round(sum((nav / t) * (nav / t)) * 10000, 6) AS hhi, {", ".join(f"round(sum(nav::DECIMAL(18,2)) FILTER (rk <= {k})::DOUBLE / any_value(t), 6) AS top{k}" for k in (5, 10, 20))}, count(nav) AS n FROM r GROUP BY 1""")
def market_concentration(spark, d):
    return A.concentration(fact(spark, d), "nav", ["period"])


@query(f"""WITH {FACT} SELECT family, period, median(inflow / nullif(nav, 0)) AS value FROM fact GROUP BY 1, 2""".replace("median(inflow / nullif(nav, 0))", "round(median(inflow / nullif(nav, 0)), 6)"))
def cross_entity_comparison(spark, d):
    return A.cross_family(fact(spark, d), "yield")


@query(f"WITH {FACT} SELECT period, sum(holders)::BIGINT AS holders, round(avg(holders), 6) AS mean_holders, count(DISTINCT entity) FILTER (holders IS NOT NULL) AS n_entities FROM fact GROUP BY 1")
def quotaholder_trend(spark, d):
    return A.holders_trend(fact(spark, d))


@query(f"WITH {FACT} SELECT period, family, sum(holders)::BIGINT AS holders, round(avg(holders), 6) AS mean_holders, count(DISTINCT entity) FILTER (holders IS NOT NULL) AS n_entities FROM fact GROUP BY 1, 2")
def quotaholder_trend_by_class(spark, d):
    return A.holders_trend(fact(spark, d), ["period", "family"])


@query(f"""WITH {FACT}, g AS (SELECT period, avg(outflow / nullif(nav, 0)) AS mean_rate, sum(outflow::DECIMAL(18,2))::DOUBLE AS part, sum(nav::DECIMAL(18,2))::DOUBLE AS whole,
  avg(CASE WHEN outflow > 0 THEN 1.0::DOUBLE ELSE 0 END) AS share_any, avg(CASE WHEN outflow / nullif(nav, 0) > 0.05 THEN 1.0::DOUBLE ELSE 0 END) AS share_above FROM fact GROUP BY 1)
SELECT period, round(mean_rate, 6) AS mean_rate, part, whole, round(share_any, 6) AS share_any, round(share_above, 6) AS share_above, round(mean_rate - lag(mean_rate) OVER (ORDER BY period), 6) AS change FROM g""")
def fidc_delinquency_trend(spark, d):
    return A.rate_trend(fact(spark, d), "outflow", "nav")


@query(f"""WITH {DAILY}, g AS (SELECT entity, period, count(*) FILTER (subclass ILIKE '%urgent%' OR subclass ILIKE '2-%') AS n_named, count(*) AS n,
  coalesce(sum(nav::DECIMAL(18,2)) FILTER (subclass ILIKE '%urgent%' OR subclass ILIKE '2-%')::DOUBLE, 0) AS named, sum(nav::DECIMAL(18,2))::DOUBLE AS whole FROM daily GROUP BY 1, 2)
SELECT *, CASE WHEN named / nullif(whole, 0) BETWEEN 0 AND 1 THEN round(named / nullif(whole, 0), 6) END AS ratio FROM g""")
def fidc_subordination_trend(spark, d):
    return A.conditional_share(daily(spark, d).withColumn("period", month("day")), ["entity", "period"], "nav", "subclass", ["%urgent%", "2-%"])


@query("""SELECT date_trunc('month', o_orderdate)::DATE AS period, count(*) AS n, sum(o_totalprice::DECIMAL(18,2))::DOUBLE AS volume, count(*) FILTER (s = 'F') AS n_f, count(*) FILTER (s = 'O') AS n_o, count(*) FILTER (s IS NULL) AS n_none
FROM (SELECT *, nullif(o_orderstatus, 'P') AS s FROM orders) GROUP BY 1""")
def security_issuance_trend(spark, d):
    rows = table(spark, d, "orders").withColumn("s", F.nullif("o_orderstatus", F.lit("P")))
    return A.issuance_trend(rows, "o_orderdate", "o_totalprice", "s", ["F", "O"])


@query("""WITH r AS (SELECT CASE WHEN l_linestatus = 'O' OR l_returnflag <> 'N' THEN l_shipdate::DATE END AS m, l_extendedprice AS v FROM lineitem)
SELECT CASE WHEN m IS NULL THEN 'perpetual' WHEN m < DATE '1996-01-01' THEN 'matured' WHEN m < DATE '1997-01-01' THEN '0-1y' WHEN m < DATE '1999-01-01' THEN '1-3y' WHEN m < DATE '2001-01-01' THEN '3-5y' ELSE '5y+' END AS bucket,
  count(*) AS n, sum(v::DECIMAL(18,2))::DOUBLE AS total FROM r GROUP BY 1""")
def security_maturity_ladder(spark, d):
    rows = table(spark, d, "lineitem").withColumn("m", F.when((F.col("l_linestatus") == "O") | (F.col("l_returnflag") != "N"), F.col("l_shipdate").cast("date")))
    return A.maturity_ladder(rows, "m", "1996-01-01", "l_extendedprice")


@query("""WITH r AS (SELECT *, date_trunc('month', l_shipdate)::DATE AS period FROM lineitem),
c AS (SELECT period, count(*) AS n, lag(count(*)) OVER (ORDER BY period) AS b FROM r GROUP BY 1)
SELECT l_partkey, l_returnflag, period FROM r WHERE period = (SELECT max(period) FROM c WHERE n >= 0.5 * coalesce(b, 0)) AND l_returnflag IN ('R', 'A')""")
def distressed_securities(spark, d):
    rows = table(spark, d, "lineitem").withColumn("period", month("l_shipdate"))
    return A.distressed(rows, "l_returnflag", ["R", "A"]).select("l_partkey", "l_returnflag", "period")


#: Lines that a task sums up to series, about; tasks at least.
SERIES_ROWS, SERIES_PARTS = 1_000_000, 8


@query(f"""WITH {FACT}, f AS (SELECT entity || '|' || family AS id, period, 'entity' AS kind, inflow / nullif(nav, 0) AS rate FROM fact),
s AS (SELECT l_partkey || '|' || l_returnflag AS id, date_trunc('month', l_shipdate)::DATE AS period, 'series' AS kind, avg(l_discount) AS rate FROM lineitem GROUP BY 1, 2)
SELECT id, period, kind, round(rate, 6) AS rate, round(rate - 0.05, 6) AS spread FROM (FROM f UNION ALL FROM s)""")
def yield_universe(spark, d):
    funds = fact(spark, d).select(F.concat(F.col("entity").cast("string"), F.lit("|"), "family").alias("id"), "period", F.lit("entity").alias("kind"), safe_div("inflow", "nav").alias("rate"))
    lines = table(spark, d, "lineitem")
    keyed = lines.select(F.concat(F.col("l_partkey").cast("string"), F.lit("|"), "l_returnflag").alias("id"), month("l_shipdate").alias("period"), "l_discount")
    # most months of a series have one line: rows are dealt as they are, into parts of a million, so no task's table grows with the input
    parts = max(SERIES_PARTS, -(-lines.count() // SERIES_ROWS))
    series = keyed.repartition(parts, "id", "period").groupBy("id", "period").agg(F.avg("l_discount").alias("rate")).withColumn("kind", F.lit("series"))
    return funds.unionByName(series).withColumn("spread", F.col("rate") - 0.05)


@query(f"""WITH {FACT} SELECT family, count(DISTINCT entity) AS n_entities, min(period) AS first_period, max(period) AS last_period, (date_diff('month', max(period), DATE '{AS_OF}') % 12) AS months_since FROM fact GROUP BY 1""")
def data_coverage(spark, d):
    return A.data_coverage(fact(spark, d), "family", AS_OF)


@query("""SELECT user_id, count(*) FILTER (event_type = 'purchase') AS n_ok, count(*) FILTER (event_type = 'error') AS n_error, (sum(event_id % 50) FILTER (event_type = 'purchase'))::BIGINT AS rows,
  max(ts::DATE) AS last_at, max(ts::DATE) FILTER (event_type = 'error') AS last_error_at FROM events GROUP BY 1""")
def ingest_log_summary(spark, d):
    log = table(spark, d, "events").select("user_id", F.when(F.col("event_type") == "purchase", "ok").otherwise(F.col("event_type")).alias("status"), (F.col("event_id") % 50).alias("n"), F.col("ts").cast("date").alias("at"))
    return A.ingest_summary(log, "user_id", "status", "n", "at")


@query(f"""WITH {FACT} SELECT period, family, count(DISTINCT entity) AS n_entities, sum(nav::DECIMAL(18,2))::DOUBLE AS aum, round(median(inflow / nullif(nav, 0)), 6) AS median_rate,
  round(median(inflow / nullif(nav, 0)) - 0.3, 6) AS spread FROM fact GROUP BY 1, 2""")
def asset_class_performance(spark, d):
    return A.class_performance(fact(spark, d).withColumn("rate", safe_div("inflow", "nav")), "family", "rate", 0.3)


@query(f"""WITH {FACT}, g AS (SELECT manager, sum(nav::DECIMAL(18,2))::DOUBLE AS aum, count(DISTINCT entity) AS entities, sum(holders)::BIGINT AS holders FROM fact WHERE period = DATE '2000-06-01' GROUP BY 1)
SELECT *, rank() OVER (ORDER BY aum DESC) AS rank FROM g ORDER BY rank, manager LIMIT 10""")
def administrator_rankings(spark, d):
    return A.manager_ranking(fact(spark, d), "manager", "2000-06-01", "aum", 10)


@query(f"""WITH {FACT}, g AS (SELECT family, sum(nav::DECIMAL(18,2))::DOUBLE AS aum, count(DISTINCT entity) AS entities, sum(holders)::BIGINT AS holders FROM fact WHERE period = DATE '2000-06-01' GROUP BY 1)
SELECT *, rank() OVER (ORDER BY holders DESC) AS rank FROM g ORDER BY rank, family LIMIT 10""")
def gestor_rankings(spark, d):
    return A.manager_ranking(fact(spark, d), "family", "2000-06-01", "holders", 10)


AGING = """a AS (SELECT l_suppkey, date_trunc('month', l_shipdate)::DATE AS period, l_partkey % 400 - 30 AS days, l_extendedprice AS v FROM lineitem),
b AS (SELECT l_suppkey, period, sum(v::DECIMAL(18,2))::DOUBLE AS overdue, coalesce(sum(v::DECIMAL(18,2)) FILTER (days > 180)::DOUBLE, 0) AS long_tail,
  coalesce(sum(v::DECIMAL(18,2)) FILTER (days > 0 AND days <= 30)::DOUBLE, 0) AS d30, coalesce(sum(v::DECIMAL(18,2)) FILTER (days > 30 AND days <= 90)::DOUBLE, 0) AS d90, coalesce(sum(v::DECIMAL(18,2)) FILTER (days > 90 AND days <= 180)::DOUBLE, 0) AS d180
  FROM a WHERE days > 0 GROUP BY 1, 2),
aging AS (SELECT l_suppkey, period, overdue, long_tail, round(d30 / nullif(overdue, 0) * 100, 2) AS pct_d30, round(d90 / nullif(overdue, 0) * 100, 2) AS pct_d90, round(d180 / nullif(overdue, 0) * 100, 2) AS pct_d180, round(long_tail / nullif(overdue, 0) * 100, 2) AS pct_long FROM b)"""


def aging(spark, d, *days):
    rows = since_until(table(spark, d, "lineitem"), "l_shipdate", *days).select("l_suppkey", month("l_shipdate").alias("period"), (F.col("l_partkey") % 400 - 30).alias("days"), "l_extendedprice")
    return A.aging_buckets(rows, ["l_suppkey", "period"], "days", "l_extendedprice", [30, 90, 180])


@query(f"WITH {AGING} SELECT * FROM aging")
def fidc_aging_buckets(spark, d):
    return aging(spark, d)


@query(f"WITH {AGING} SELECT l_suppkey, pct_long, overdue FROM aging WHERE period = DATE '2000-06-01' ORDER BY pct_long DESC NULLS LAST, l_suppkey LIMIT 20")
def fidc_aging_universe(spark, d):
    return aging(spark, d, "2000-06-01", "2000-07-01").filter("period = date'2000-06-01'").select("l_suppkey", "pct_long", "overdue").orderBy(F.col("pct_long").desc_nulls_last(), "l_suppkey").limit(20)


@query(f"""WITH {AGING} SELECT l_suppkey AS entity, n.pct_long AS now, t.pct_long AS "then", round(n.pct_long - t.pct_long, 6) AS delta FROM aging n JOIN aging t USING (l_suppkey)
WHERE n.period = DATE '2000-06-01' AND t.period = DATE '2000-03-01' AND n.pct_long - t.pct_long >= 1""")
def fidc_delinquency_screen(spark, d):
    return A.acceleration_screen(aging(spark, d, "2000-03-01", "2000-07-01").withColumnRenamed("l_suppkey", "entity"), "pct_long", "2000-06-01", 3, 1.0)


@query(f"""WITH {LINES}, f AS (SELECT lender, date_trunc('month', day)::DATE AS period, coalesce(sum(value::DECIMAL(18,2)) FILTER (kind = 'A')::DOUBLE, 0) AS taken, coalesce(sum(value::DECIMAL(18,2)) FILTER (kind = 'R')::DOUBLE, 0) AS given FROM lines GROUP BY 1, 2),
b AS (SELECT s_suppkey AS lender, s_acctbal AS balance FROM supplier)
SELECT f.*, balance FROM f LEFT JOIN b USING (lender)""")
def fidc_flow_vs_delinquency(spark, d):
    money = lambda k: F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("value")).cast("decimal(18,2)")).cast("double"), F.lit(0.0))
    flows = lines(spark, d).groupBy("lender", month("day").alias("period")).agg(money("A").alias("taken"), money("R").alias("given"))
    return flows.join(table(spark, d, "supplier").select(F.col("s_suppkey").alias("lender"), F.col("s_acctbal").alias("balance")), "lender", "left")


@query("""WITH r AS (SELECT l_suppkey, l_partkey, l_tax * 100 AS y FROM lineitem)
SELECT l_suppkey, l_partkey, round((pow(1 + y / 100, 1.0::DOUBLE / 12) - 1) * 100, 6) AS monthly, round(round((pow(1 + y / 100, 1.0::DOUBLE / 12) - 1) * 100, 6) - 0.25, 6) AS spread FROM r""")
def fidc_senior_vs_benchmark(spark, d):
    out = table(spark, d, "lineitem").select("l_suppkey", "l_partkey", A.monthly_from_annual(F.col("l_tax") * 100).alias("monthly"))
    return out.withColumn("spread", F.col("monthly") - 0.25).filter(F.abs("spread") < 10)


@query(f"WITH {SESSIONS} SELECT * FROM sessions")
def quote_daily(spark, d):
    return sessions(spark, d)
