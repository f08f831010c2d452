"""Queries on document registers, versions, captures and macro series.

Orders are filed documents: the customer files, the priority is the type, the order of a customer's year the version.
Events are captures of a market: the user is the instrument, the event type the metric.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.core import latest_by, total
from tidemark.operators import filings as L
from tidemark.plans.base import query, since_until, table

DOCS = """docs AS (SELECT o_orderkey AS doc, o_custkey AS filer, o_orderpriority AS type, year(o_orderdate) AS y, o_orderstatus AS status, o_totalprice AS amount, o_orderdate AS filed,
  row_number() OVER (PARTITION BY o_custkey, o_orderpriority, year(o_orderdate) ORDER BY o_orderdate, o_orderkey)::INT AS version FROM orders)"""


def docs(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "orders").select(F.col("o_orderkey").alias("doc"), F.col("o_custkey").alias("filer"), F.col("o_orderpriority").alias("type"), F.year("o_orderdate").alias("y"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("amount"), F.col("o_orderdate").alias("filed"))
    return own.withColumn("version", F.row_number().over(Window.partitionBy("filer", "type", "y").orderBy("filed", "doc")))


def _day(text: str):
    return F.lit(text).cast("date")


@query(f"WITH {DOCS} SELECT doc, filer, type, version, filed::DATE AS day FROM docs WHERE filed >= DATE '1996-01-01' AND filed < DATE '1996-06-30' + 1")
def fund_documents(spark: SparkSession, d: str) -> DataFrame:
    return L.in_window(docs(spark, d), "filed", _day("1996-01-01"), _day("1996-06-30")).select("doc", "filer", "type", "version", F.col("filed").cast("date").alias("day"))


PAIRS = """pairs AS (SELECT *, lag(doc) OVER w AS previous, lag(version) OVER w AS previous_version, datediff('day', lag(filed) OVER w, filed) AS lag_days FROM docs WINDOW w AS (PARTITION BY filer, type, y ORDER BY version, doc))"""


def pairs(spark: SparkSession, d: str) -> DataFrame:
    return L.version_pairs(docs(spark, d), ["filer", "type", "y"], "version", "filed")


@query(f"WITH {DOCS}, {PAIRS} SELECT doc, filer, type, version, previous, previous_version, lag_days FROM pairs WHERE previous IS NOT NULL")
def fund_restatements(spark: SparkSession, d: str) -> DataFrame:
    return pairs(spark, d).select("doc", "filer", "type", "version", "previous", "previous_version", "lag_days")


@query(
    f"""WITH {DOCS}, {PAIRS},
both_ AS (
  SELECT n.doc, n.previous, unnest(['status', 'amount', 'large']) AS path,
         unnest([o.status, floor(o.amount)::BIGINT::VARCHAR, CASE WHEN o.amount > 200000 THEN 'yes' END]) AS old,
         unnest([n.status, floor(n.amount)::BIGINT::VARCHAR, CASE WHEN n.amount > 200000 THEN 'yes' END]) AS new
  FROM pairs n JOIN (SELECT o_orderkey AS doc, o_orderstatus AS status, o_totalprice AS amount FROM orders) o ON o.doc = n.previous)
SELECT doc, previous, path, CASE WHEN old IS NULL THEN 'added' WHEN new IS NULL THEN 'removed' ELSE 'changed' END AS kind, old, new, TRY_CAST(new AS DOUBLE) - TRY_CAST(old AS DOUBLE) AS delta
FROM both_ WHERE old IS DISTINCT FROM new"""
)
def restatement_diff(spark: SparkSession, d: str) -> DataFrame:
    """Fields that differ between each document and its version before."""
    own = docs(spark, d).select("doc", "status", F.floor("amount").cast("bigint").alias("amount"), F.when(F.col("amount") > 200000, "yes").alias("large"))
    return L.body_diff(pairs(spark, d), L.flat_fields(own, "doc", ["status", "amount", "large"]))


@query(f"WITH {DOCS} SELECT doc, filer, type, version, amount FROM docs QUALIFY version = max(version) OVER (PARTITION BY filer, type, y)")
def company_events(spark: SparkSession, d: str) -> DataFrame:
    """The newest version of each event of a company."""
    return latest_by(docs(spark, d), ["filer", "type", "y"], [F.col("version").desc()]).select("doc", "filer", "type", "version", "amount")


@query(f"WITH {DOCS} SELECT filer, y, 'yearly' AS kind, amount AS shares, version FROM docs WHERE type < '3' QUALIFY row_number() OVER (PARTITION BY filer, y ORDER BY version DESC, doc DESC) = 1 UNION ALL SELECT filer, y, 'quarterly', amount, version FROM docs WHERE type >= '3' QUALIFY row_number() OVER (PARTITION BY filer, y, type ORDER BY version DESC, doc DESC) = 1")
def share_counts(spark: SparkSession, d: str) -> DataFrame:
    """Yearly and quarterly counts, the newest version of each."""
    own, order = docs(spark, d), [F.col("version").desc(), F.col("doc").desc()]
    part = lambda rows, keys, kind: latest_by(rows, keys, order).select("filer", "y", F.lit(kind).alias("kind"), F.col("amount").alias("shares"), "version")
    return part(own.filter("type < '3'"), ["filer", "y"], "yearly").unionByName(part(own.filter("type >= '3'"), ["filer", "y", "type"], "quarterly"))


@query("SELECT l_suppkey AS company, l_shipdate::DATE AS day, l_linenumber AS version, l_orderkey AS doc, round(l_discount * 100, 6) AS free_float_pct FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_suppkey, l_shipdate::DATE ORDER BY l_linenumber DESC, l_orderkey DESC, l_discount DESC) = 1")
def free_float(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("company"), F.col("l_shipdate").cast("date").alias("day"), F.col("l_linenumber").alias("version"), F.col("l_orderkey").alias("doc"), (F.col("l_discount") * 100).alias("free_float_pct"))
    return latest_by(own, ["company", "day"], [F.col("version").desc(), F.col("doc").desc(), F.col("free_float_pct").desc()])


@query("""WITH v AS (SELECT l_suppkey AS issuer, l_partkey AS security, date_trunc('month', l_shipdate)::DATE AS ref, l_linenumber AS version, l_orderkey AS doc, l_extendedprice AS issued FROM lineitem),
n AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY issuer, security, ref ORDER BY version DESC, doc DESC, issued DESC) = 1)
SELECT issuer, s_name AS name, security, ref, version, issued FROM n LEFT JOIN supplier ON s_suppkey = issuer""")
def debt_issues(spark: SparkSession, d: str) -> DataFrame:
    """The newest version of each issue and reference month, with its issuer's name."""
    own = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("issuer"), F.col("l_partkey").alias("security"), F.trunc("l_shipdate", "month").alias("ref"), F.col("l_linenumber").alias("version"), F.col("l_orderkey").alias("doc"), F.col("l_extendedprice").alias("issued"))
    newest = latest_by(own, ["issuer", "security", "ref"], [F.col("version").desc(), F.col("doc").desc(), F.col("issued").desc()])
    names = table(spark, d, "supplier").select(F.col("s_suppkey").alias("issuer"), F.col("s_name").alias("name"))
    return newest.join(names, "issuer", "left").select("issuer", "name", "security", "ref", "version", "issued")


CAPTURES = """captures AS (SELECT event_id AS capture, user_id AS instrument, ts::DATE AS day, ts AS captured, event_type AS metric, value FROM events)"""


@query(
    f"""WITH {CAPTURES}, c AS (SELECT * FROM captures WHERE captured <= TIMESTAMP '2024-01-20 12:00:00' QUALIFY row_number() OVER (PARTITION BY instrument, day, metric ORDER BY captured DESC, capture DESC) = 1)
SELECT instrument, day, max(value) FILTER (metric = 'purchase') AS purchase, max(value) FILTER (metric = 'view') AS view, max(value) FILTER (metric = 'click') AS click FROM c GROUP BY ALL"""
)
def credit_market_history(spark: SparkSession, d: str) -> DataFrame:
    """What was known at a time: the newest capture of each metric and day by then, wide."""
    own = table(spark, d, "events").select(F.col("event_id").alias("capture"), F.col("user_id").alias("instrument"), F.col("ts").cast("date").alias("day"), F.col("ts").alias("captured"), F.col("event_type").alias("metric"), "value")
    known = L.captured_as_of(own, ["instrument", "day", "metric"], "captured", F.lit("2024-01-20 12:00:00").cast(own.schema["captured"].dataType))
    return L.wide(known, ["instrument", "day"], ["purchase", "view", "click"])


@query("""WITH f AS (SELECT conv_id, turn, role, text, regexp_matches(lower(text), '(erth|ntt)') AS flagged FROM conversations)
SELECT conv_id AS "case", turn AS version, role FROM f WHERE flagged QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role) = 1""")
def listed_documents(spark: SparkSession, d: str) -> DataFrame:
    """The newest document of each case whose text a pattern flags."""
    own = table(spark, d, "conversations").filter(F.lower("text").rlike("(erth|ntt)"))
    return latest_by(own, ["conv_id"], [F.col("turn").desc(), F.col("role")]).select(F.col("conv_id").alias("case"), F.col("turn").alias("version"), "role")


@query("SELECT event_id, user_id, (ts - INTERVAL 3 HOUR)::DATE AS local_day, c_name AS name FROM events LEFT JOIN customer ON c_custkey = user_id WHERE (ts - INTERVAL 3 HOUR)::DATE = DATE '2024-01-15'")
def documents_new(spark: SparkSession, d: str) -> DataFrame:
    """Documents first seen on a local day, with their case where there is one."""
    seen = L.first_seen_on(table(spark, d, "events"), "ts", "America/Sao_Paulo", _day("2024-01-15"))
    names = table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("name"))
    return seen.join(names, "user_id", "left").select("event_id", "user_id", F.from_utc_timestamp("ts", "America/Sao_Paulo").cast("date").alias("local_day"), "name")


@query("""WITH k AS (SELECT o_custkey AS "case", lpad((o_orderkey % 40)::VARCHAR, 2, '0') AS code, o_orderstatus = 'F' AS flag FROM orders)
SELECT CASE code WHEN '08' THEN 'east' WHEN '26' THEN 'west' WHEN '19' THEN 'north' ELSE '? ' || code END AS court, count(DISTINCT "case") AS n_cases, count(DISTINCT "case") FILTER (flag) AS n_flagged FROM k GROUP BY 1""")
def court_coverage(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "orders").select(F.col("o_custkey").alias("case"), F.lpad((F.col("o_orderkey") % 40).cast("string"), 2, "0").alias("code"), (F.col("o_orderstatus") == "F").alias("flag"))
    return L.coverage_by_code(own, F.col("code"), {"08": "east", "26": "west", "19": "north"}, F.col("flag"))


@query("""WITH i AS (SELECT l_partkey AS security, l_shipdate::DATE AS day, avg(l_discount::DECIMAL(9,4))::DOUBLE * 100 AS implied, count(*) AS trades FROM lineitem GROUP BY 1, 2), m AS (SELECT p_partkey AS security, p_size / 10.0::DOUBLE AS model FROM part)
SELECT security, day, round(implied, 6) AS implied, model, round(implied - model, 6) AS gap, CASE WHEN model IS NULL THEN 'none' WHEN abs(implied - model) > 3 THEN 'low' ELSE 'high' END AS confidence, trades < 2 AS thin FROM i LEFT JOIN m USING (security)""")
def implied_check(spark: SparkSession, d: str) -> DataFrame:
    """Implied rates beside a model's: the gap, how far to trust it, and whether trading was thin."""
    own = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("security"), F.col("l_shipdate").cast("date").alias("day")).agg((F.avg(F.col("l_discount").cast("decimal(9,4)")).cast("double") * 100).alias("implied"), F.count("*").alias("trades"))
    model = table(spark, d, "part").select(F.col("p_partkey").alias("security"), (F.col("p_size") / 10).alias("model"))
    gap = F.col("implied") - F.col("model")
    trust = F.when(F.col("model").isNull(), "none").when(F.abs(gap) > 3, "low").otherwise("high")
    return own.join(model, "security", "left").select("security", "day", "implied", "model", gap.alias("gap"), trust.alias("confidence"), (F.col("trades") < 2).alias("thin"))


@query("SELECT event_type AS series, ts::DATE AS day, max_by(value, (ts, event_id)) AS value FROM events WHERE event_type = 'purchase' AND ts::DATE BETWEEN DATE '2024-01-05' AND DATE '2024-01-25' GROUP BY ALL")
def macro_series(spark: SparkSession, d: str) -> DataFrame:
    """One series in a window, the last value of each day."""
    day = F.col("ts").cast("date")
    own = since_until(table(spark, d, "events"), "ts", "2024-01-05", "2024-01-26").filter(F.col("event_type") == "purchase")
    return own.groupBy(F.col("event_type").alias("series"), day.alias("day")).agg(F.max_by("value", F.struct("ts", "event_id")).alias("value"))


@query("SELECT user_id % 5 AS currency, ts::DATE AS day, round(avg(value::DECIMAL(18,2))::DOUBLE, 6) AS buy, max(value) AS sell, round((max(value) - avg(value::DECIMAL(18,2))::DOUBLE)::DECIMAL(38,9), 6)::DOUBLE AS spread FROM events GROUP BY 1, 2")
def fx_daily(spark: SparkSession, d: str) -> DataFrame:
    """Daily rates of each currency."""
    own = table(spark, d, "events").groupBy((F.col("user_id") % 5).alias("currency"), F.col("ts").cast("date").alias("day"))
    mean = total("value") / F.count("*")
    return own.agg(mean.alias("buy"), F.max("value").alias("sell"), F.round(F.max("value") - mean, 9).alias("spread"))


@query("SELECT event_type AS indicator, ts::DATE AS day, (json_extract(props, '$.k')::INT) % 4 AS horizon, round(median(value), 6) AS median, count(*) AS n, CASE WHEN json_extract(props, '$.k')::INT >= 20 THEN 'full' ELSE 'top' END AS base FROM events GROUP BY ALL")
def focus_expectations(spark: SparkSession, d: str) -> DataFrame:
    """Survey medians by horizon and base of forecasters, which the rows' JSON holds."""
    k = F.get_json_object("props", "$.k").cast("int")
    base = F.when(k >= 20, "full").otherwise("top")
    return table(spark, d, "events").groupBy(F.col("event_type").alias("indicator"), F.col("ts").cast("date").alias("day"), (k % 4).alias("horizon"), base.alias("base")).agg(F.percentile("value", F.lit(0.5)).alias("median"), F.count("*").alias("n"))


@query("SELECT p_type AS title, date_trunc('month', l_shipdate)::DATE AS base, DATE '2000-01-01' + (p_size * 30)::INT AS maturity, round(avg(l_extendedprice::DECIMAL(18,2))::DOUBLE, 6) AS price FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_shipdate BETWEEN DATE '1995-01-01' AND DATE '1997-12-31' GROUP BY ALL")
def treasury_direct(spark: SparkSession, d: str) -> DataFrame:
    """Prices of each title and maturity by month."""
    own = table(spark, d, "lineitem").filter(F.col("l_shipdate").between(F.lit("1995-01-01").cast("date"), F.lit("1997-12-31").cast("date")))
    part = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_type").alias("title"), F.date_add(F.lit("2000-01-01").cast("date"), F.col("p_size") * 30).alias("maturity"))
    return own.join(part, "l_partkey").groupBy("title", F.trunc("l_shipdate", "month").alias("base"), "maturity").agg(F.avg(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double").alias("price"))
