"""Queries on landing rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import ingest
from tidemark.plans.base import DAILY, daily, query, table


@query(
    f"""WITH {DAILY},
spans AS (SELECT entity, min(period) AS since, max(period) AS until FROM daily GROUP BY 1),
every AS (SELECT entity, unnest(generate_series(since::TIMESTAMP, until::TIMESTAMP, INTERVAL 1 MONTH))::DATE AS period FROM spans)
SELECT entity, period FROM every ANTI JOIN daily USING (entity, period)"""
)
def filing_gaps(spark: SparkSession, d: str) -> DataFrame:
    landed = daily(spark, d).select("entity", F.trunc("day", "month").alias("period"))
    spans = landed.groupBy("entity").agg(F.min("period").alias("since"), F.max("period").alias("until"))
    return ingest.missing_months(landed, spans, ["entity"])


_PRICES = "SELECT o_custkey AS entity, o_orderstatus AS status, o_orderkey AS seq, o_totalprice AS price FROM orders"


def _prices(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").selectExpr("o_custkey entity", "o_orderstatus status", "o_orderkey seq", "o_totalprice price")


@query(
    f"""WITH p AS ({_PRICES}),
b AS (SELECT *, 0 AS new FROM p WHERE status <> 'O' UNION ALL SELECT entity, 'F', seq, price * 2, 1 FROM p WHERE status = 'O')
SELECT entity, status, seq, price FROM b QUALIFY row_number() OVER (PARTITION BY entity, status ORDER BY new DESC, seq DESC) = 1"""
)
def upsert_last_write(spark: SparkSession, d: str) -> DataFrame:
    """Open orders, at twice the price, are written over filled ones; every order is on one of the sides."""
    p = _prices(spark, d)
    return ingest.upsert(p.filter("status <> 'O'"), p.filter("status = 'O'").withColumns({"price": F.col("price") * 2, "status": F.lit("F")}), ["entity", "status"], "seq")


@query(
    f"""WITH p AS ({_PRICES}), new AS (SELECT * FROM p WHERE status = 'P')
SELECT * FROM p WHERE status <> 'P' AND NOT EXISTS (FROM new n WHERE n.entity = p.entity) UNION ALL SELECT * FROM new"""
)
def replace_scopes(spark: SparkSession, d: str) -> DataFrame:
    """Pending orders replace all others of their customers."""
    p = _prices(spark, d)
    return ingest.replace_scoped(p.filter("status <> 'P'"), p.filter("status = 'P'"), ["entity"])


@query(
    f"""WITH p AS (SELECT o_orderkey AS seq, o_custkey AS entity, o_orderstatus AS status, o_totalprice AS price FROM orders), new AS (SELECT seq, entity, status, CASE WHEN status = 'O' THEN price * 2 ELSE price END AS price FROM p)
SELECT * FROM new n WHERE NOT EXISTS (FROM p WHERE p.seq = n.seq AND p.entity IS NOT DISTINCT FROM n.entity AND p.status IS NOT DISTINCT FROM n.status AND p.price IS NOT DISTINCT FROM n.price)"""
)
def upsert_changed(spark: SparkSession, d: str) -> DataFrame:
    """Rows that an upsert has to write, for they differ from what is there."""
    p = _prices(spark, d).select("seq", "entity", "status", "price")
    return ingest.changed(p, p.withColumn("price", F.when(F.col("status") == "O", F.col("price") * 2).otherwise(F.col("price"))), ["seq"])


@query()
def load_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """Each load of a slice judged against the slice's last good one."""
    loads = table(spark, d, "events").groupBy((F.col("user_id") % 20).alias("slice"), F.col("ts").cast("date").alias("at")).agg(F.count("*").alias("n"), F.max("event_type").alias("kind"))
    error = F.when(F.col("kind") == "signup", "unchanged")
    return ingest.load_verdict(loads.select("slice", "at", F.col("n").alias("fetched"), F.when(F.col("n") % 4 == 0, 0).otherwise(F.col("n")).cast("bigint").alias("rows"), error.alias("error")), least=2)


@query("SELECT DISTINCT o_custkey AS entity, unnest(generate_series(date_trunc('month', max(o_orderdate)) - INTERVAL 2 MONTH, date_trunc('month', max(o_orderdate)), INTERVAL 1 MONTH))::DATE AS month FROM orders GROUP BY 1")
def trailing_window(spark: SparkSession, d: str) -> DataFrame:
    """The last three months up to each entity's newest filing, to be read again."""
    last = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("entity")).agg(F.max("o_orderdate").cast("date").alias("day"))
    return last.select("entity", F.explode(ingest.months_to_read(F.col("day"), 3)).alias("month"))


@query(
    """WITH w AS (SELECT DISTINCT ts::DATE AS session FROM events ORDER BY 1 DESC LIMIT 21), h AS (SELECT DISTINCT ts::DATE AS session FROM events WHERE event_type = 'signup' AND value > 90),
m AS (SELECT session FROM w WHERE session NOT IN (SELECT session FROM h) UNION SELECT session FROM (SELECT session FROM w ORDER BY 1 DESC LIMIT 2)) SELECT session FROM m ORDER BY 1 DESC LIMIT 15"""
)
def sessions_to_fetch(spark: SparkSession, d: str) -> DataFrame:
    ev = table(spark, d, "events").withColumn("session", F.col("ts").cast("date"))
    return ingest.sessions_to_fetch(ev, ev.filter("event_type = 'signup' and value > 90"), 21, 2, 15)


@query(
    f"""WITH {DAILY}, docs AS (SELECT entity, subclass, year(day) AS y, count(*) AS n FROM daily GROUP BY 1, 2, 3)
SELECT entity, sum(n)::BIGINT AS n_docs, sum(n - 1)::BIGINT AS n_restated, round(100.0 * sum(n - 1)::DOUBLE / sum(n), 6) AS rate_pct,
       coalesce(string_agg(DISTINCT subclass, ',' ORDER BY subclass) FILTER (n > 1), '') AS types
FROM docs GROUP BY 1 HAVING sum(n - 1) >= 3 AND 100.0 * sum(n - 1) / sum(n) >= 20"""
)
def screen_versions(spark: SparkSession, d: str) -> DataFrame:
    return ingest.restatement_screen(daily(spark, d).withColumn("y", F.year("day")), ["y"])
