"""Queries on company statements.

A supplier is a company, a line item an account row: its return flag the statement, its part the label, line number
the version, quarter of shipping the reference date. Codes come from keys; each fifth order files top-level accounts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import statements as S
from tidemark.plans.base import query, table

ACCOUNTS = """accounts AS (
  SELECT l_suppkey AS company, l_linestatus AS doc, CASE l_returnflag WHEN 'A' THEN 'income' WHEN 'N' THEN 'balance' ELSE 'cash' END AS statement,
         'con' AS scope, date_trunc('quarter', l_shipdate)::DATE AS ref, l_linenumber AS version,
         date_trunc('quarter', l_shipdate)::DATE - to_months((l_partkey % 4)::INT * 3) AS start0, (date_trunc('quarter', l_shipdate) + INTERVAL 3 MONTH)::DATE - 1 AS "end",
         (l_partkey % 3 + 1)::VARCHAR || CASE WHEN l_orderkey % 5 = 0 THEN '' ELSE '.0' || (l_orderkey % 4 + 1)::VARCHAR END AS code, (['MAIL', 'SHIP', 'AIR', 'TRUCK', 'RAIL', 'FOB', 'REG AIR'])[(l_partkey % 7 + 1)::INT] AS label, l_extendedprice AS value
  FROM lineitem),
acc AS (SELECT * EXCLUDE (start0), start0::DATE AS start FROM accounts),
rows_ AS (SELECT *, (datediff('month', start, "end" + 1)) AS months FROM acc QUALIFY version = max(version) OVER (PARTITION BY company, doc, statement, scope, ref))"""
#: Labels of account rows, by key.
LABELS = ("MAIL", "SHIP", "AIR", "TRUCK", "RAIL", "FOB", "REG AIR")
BY = ["company", "doc", "scope", "ref", "start", "end", "version"]


def received():
    """When a filing was received: up to 200 days after the date it is of."""
    return F.date_add(F.col("l_shipdate").cast("date"), (F.col("l_orderkey") % 200).cast("int"))


def accounts(spark: SparkSession, d: str) -> DataFrame:
    quarter = F.trunc("l_shipdate", "quarter")
    code = F.concat((F.col("l_partkey") % 3 + 1).cast("string"), F.when(F.col("l_orderkey") % 5 == 0, "").otherwise(F.concat(F.lit(".0"), (F.col("l_orderkey") % 4 + 1).cast("string"))))
    return table(spark, d, "lineitem").select(
        F.col("l_suppkey").alias("company"),
        F.col("l_linestatus").alias("doc"),
        F.when(F.col("l_returnflag") == "A", "income").when(F.col("l_returnflag") == "N", "balance").otherwise("cash").alias("statement"),
        F.lit("con").alias("scope"),
        quarter.alias("ref"),
        F.add_months(quarter, -3 * (F.col("l_partkey") % 4).cast("int")).alias("start"),
        F.date_sub(F.add_months(quarter, 3), 1).alias("end"),
        F.col("l_linenumber").alias("version"),
        code.alias("code"),
        F.element_at(F.array(*map(F.lit, LABELS)), (F.col("l_partkey") % 7 + 1).cast("int")).alias("label"),
        F.col("l_extendedprice").alias("value"),
    )


def rows(spark: SparkSession, d: str) -> DataFrame:
    return S.newest_versions(accounts(spark, d), ["company", "doc", "statement", "scope", "ref"]).withColumn("months", S.span_months())


@query(f"WITH {ACCOUNTS} SELECT company, doc, statement, ref, start, \"end\", months, code, label, value, version FROM rows_")
def statement_rows(spark: SparkSession, d: str) -> DataFrame:
    return rows(spark, d).select("company", "doc", "statement", "ref", "start", "end", "months", "code", "label", "value", "version")


@query(
    f"""WITH {ACCOUNTS}, filings AS (SELECT DISTINCT l_suppkey AS company, l_linestatus AS doc, date_trunc('quarter', l_shipdate)::DATE AS ref, l_linenumber AS version, (l_shipdate::DATE + (l_orderkey % 200)::INT) AS received FROM lineitem),
known AS (SELECT * FROM acc a WHERE EXISTS (FROM filings f WHERE f.company = a.company AND f.doc = a.doc AND f.ref = a.ref AND f.version = a.version AND f.received < DATE '1996-01-01'))
SELECT company, doc, statement, ref, version, count(*) AS n, sum(value::DECIMAL(18,2))::DOUBLE AS value FROM known
  WHERE (company, doc, statement, ref, version) IN (SELECT company, doc, statement, ref, max(version) FROM known GROUP BY ALL) GROUP BY ALL"""
)
def statements_as_of(spark: SparkSession, d: str) -> DataFrame:
    """Each document's newest version among those received before a day."""
    filings = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("company"), F.col("l_linestatus").alias("doc"), F.trunc("l_shipdate", "quarter").alias("ref"), F.col("l_linenumber").alias("version"), received().alias("received"))
    known = S.received_before(accounts(spark, d), filings, ["company", "doc", "ref", "version"], F.lit("1996-01-01").cast("date"))
    return S.newest_versions(known, ["company", "doc", "statement", "ref"]).groupBy("company", "doc", "statement", "ref", "version").agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(18,2)")).alias("value"))


@query(
    f"""WITH {ACCOUNTS}, f AS (SELECT l_suppkey AS company, l_linestatus AS doc, date_trunc('quarter', l_shipdate)::DATE AS ref, l_linenumber AS version, min(l_shipdate::DATE + (l_orderkey % 200)::INT) AS received FROM lineitem GROUP BY ALL)
SELECT a.company, a.statement, a.ref, a.code, a.label, a.value, a.version, f.received FROM acc a LEFT JOIN f ON f.company = a.company AND f.doc = a.doc AND f.ref = a.ref AND f.version = a.version"""
)
def statement_history(spark: SparkSession, d: str) -> DataFrame:
    """All versions, with the day on which each was received."""
    filed = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("company"), F.col("l_linestatus").alias("doc"), F.trunc("l_shipdate", "quarter").alias("ref"), F.col("l_linenumber").alias("version")).agg(F.min(received()).alias("received"))
    return accounts(spark, d).join(filed, ["company", "doc", "ref", "version"], "left").select("company", "statement", "ref", "code", "label", "value", "version", "received")


INCOME = {"revenue": ("code", ("1",)), "gross_profit": ("code", ("1.03",)), "net_income": ("label", ("AIR", "REG AIR"))}
BY_SQL = 'company, doc, scope, ref, start, "end", version'


def _has(column: str, values: tuple[str, ...]):
    return F.col(column).isin(*values)


@query(
    f"""WITH {ACCOUNTS}, i AS (SELECT {BY_SQL}, any_value(months) AS months, max(value) FILTER (code = '1') AS revenue, max(value) FILTER (code = '1.03') AS gross_profit, max(value) FILTER (label IN ('AIR', 'REG AIR')) AS net_income FROM rows_ WHERE statement = 'income' GROUP BY ALL),
b AS (SELECT company, doc, ref, version, max(value) FILTER (code = '1') AS total_assets, max(value) FILTER (label IN ('SHIP', 'RAIL')) AS equity FROM rows_ WHERE statement = 'balance' GROUP BY ALL)
SELECT i.company, i.doc, i.ref, i.start, i.months, i.version, revenue, gross_profit, net_income, total_assets, equity, CASE WHEN revenue > 0 THEN round(100 * net_income / revenue, 2) END AS net_margin_pct,
  CASE WHEN equity > 0 THEN round(100 * net_income / equity, 2) END AS roe_pct, CASE months WHEN 3 THEN 'quarter' WHEN 6 THEN 'ytd' WHEN 9 THEN 'ytd' WHEN 12 THEN 'annual' END AS period_kind
FROM i LEFT JOIN b ON b.company = i.company AND b.doc = i.doc AND b.ref = i.ref AND b.version IS NOT DISTINCT FROM i.version"""
)
def company_financials(spark: SparkSession, d: str) -> DataFrame:
    """Headline figures: revenue and gross profit by code, net income and equity by label."""
    own = rows(spark, d)
    income = S.pivot_items(own.filter("statement = 'income'"), [*BY, "months"], {k: _has(c, v) for k, (c, v) in INCOME.items()})
    balance = S.pivot_items(own.filter("statement = 'balance'"), ["company", "doc", "ref", "version"], {"total_assets": F.col("code") == "1", "equity": _has("label", ("SHIP", "RAIL"))})
    return S.headline(income, balance, ["company", "doc", "ref", "version"]).withColumn("period_kind", S.period_kind()).drop("scope", "end")


@query(
    f"""WITH {ACCOUNTS} SELECT company, doc, ref, start, months, version, CASE WHEN bool_or(label = 'MAIL') THEN 'industrial' WHEN bool_or(label LIKE 'RA_L') THEN 'bank' WHEN bool_or(label = 'FOB') THEN 'insurer' END AS chart,
  max(value) FILTER (label IN ('MAIL', 'RAIL', 'FOB')) AS revenue, max(value) FILTER (label = 'SHIP') AS cost, max(value) FILTER (label IN ('AIR', 'REG AIR')) AS net_income FROM rows_ WHERE statement = 'income' GROUP BY company, doc, scope, ref, start, "end", months, version"""
)
def income_statements(spark: SparkSession, d: str) -> DataFrame:
    """One row per filed income statement, items by label; its chart of accounts by the labels that occur."""
    own = rows(spark, d).filter("statement = 'income'")
    label = F.col("label")
    items = {"revenue": label.isin("MAIL", "RAIL", "FOB"), "cost": label == "SHIP", "net_income": label.isin("AIR", "REG AIR")}
    kind = S.chart({"industrial": label == "MAIL", "bank": label.like("RA_L"), "insurer": label == "FOB"})
    return own.groupBy(*BY, "months").agg(kind.alias("chart"), *[F.max(F.when(w, F.col("value"))).alias(k) for k, w in items.items()]).drop("scope", "end")


PARENTS = """par AS (SELECT company, doc, statement, ref, version, code, min(label) AS parent FROM rows_ GROUP BY ALL),
kids AS (SELECT r.*, p.parent FROM rows_ r LEFT JOIN par p ON p.company = r.company AND p.doc = r.doc AND p.statement = r.statement AND p.ref = r.ref AND p.version IS NOT DISTINCT FROM r.version
  AND contains(r.code, '.') AND p.code = regexp_replace(r.code, '\\.[^.]*$', ''))"""
PARENT_BY = ["company", "doc", "statement", "ref", "version"]


@query(
    f"""WITH {ACCOUNTS}, {PARENTS} SELECT company, doc, ref, version, max(value) FILTER (code = '1') AS total_assets, max(value) FILTER (label IN ('SHIP', 'TRUCK') AND parent IN ('AIR', 'FOB')) AS current_assets,
  max(value) FILTER (label IN ('SHIP', 'TRUCK') AND parent IN ('MAIL', 'RAIL', 'SHIP')) AS noncurrent_assets, max(value) FILTER (label = 'REG AIR') AS equity FROM kids WHERE statement = 'balance' GROUP BY ALL"""
)
def balance_sheets(spark: SparkSession, d: str) -> DataFrame:
    """Items by label and by the label of the parent account: one label stands under several parents."""
    own = S.with_parent_label(rows(spark, d).filter("statement = 'balance'"), PARENT_BY)
    label, parent = F.col("label"), F.col("parent")
    items = {"total_assets": F.col("code") == "1", "current_assets": label.isin("SHIP", "TRUCK") & parent.isin("AIR", "FOB"), "noncurrent_assets": label.isin("SHIP", "TRUCK") & parent.isin("MAIL", "RAIL", "SHIP"), "equity": label == "REG AIR"}
    return S.pivot_items(own, ["company", "doc", "ref", "version"], items)


@query(
    f"""WITH {ACCOUNTS}, {PARENTS} SELECT company, doc, ref, version, CASE WHEN bool_or(code LIKE '1%') THEN 'direct' ELSE 'indirect' END AS method, max(value) FILTER (code IN ('1', '2')) AS operating, max(value) FILTER (code = '3') AS investing,
  max(value) FILTER (label IN ('MAIL', 'SHIP') AND parent IN ('AIR', 'REG AIR', 'TRUCK')) AS dividends FROM kids WHERE statement = 'cash' GROUP BY ALL"""
)
def cash_flow_statements(spark: SparkSession, d: str) -> DataFrame:
    """Both methods as one statement, items by code and by the parent's label."""
    own = S.with_parent_label(rows(spark, d).filter("statement = 'cash'"), PARENT_BY)
    items = {"operating": F.col("code").isin("1", "2"), "investing": F.col("code") == "3", "dividends": F.col("label").isin("MAIL", "SHIP") & F.col("parent").isin("AIR", "REG AIR", "TRUCK")}
    method = F.when(F.bool_or(F.col("code").like("1%")), "direct").otherwise("indirect")
    return own.groupBy("company", "doc", "ref", "version").agg(method.alias("method"), *[F.max(F.when(w, F.col("value"))).alias(k) for k, w in items.items()])


@query(
    """WITH n AS (SELECT s_suppkey AS company, s_name AS name, (s_suppkey * 1009)::VARCHAR AS number, lpad(s_suppkey::VARCHAR, 6, '0') AS code FROM supplier),
asked AS (SELECT s_name AS id FROM supplier UNION SELECT (s_suppkey * 1009)::VARCHAR FROM supplier UNION SELECT lpad(s_suppkey::VARCHAR, 6, '0') FROM supplier),
hits AS (SELECT id, company, 1 AS p FROM asked JOIN n ON n.name = id UNION ALL SELECT id, company, 2 FROM asked JOIN n ON n.number = id UNION ALL SELECT id, company, 3 FROM asked JOIN n ON n.code = id)
SELECT id, company, p AS matched_by FROM hits QUALIFY row_number() OVER (PARTITION BY id ORDER BY p, company) = 1"""
)
def company_ref(spark: SparkSession, d: str) -> DataFrame:
    """Ids resolved by name, by number, then by code; the first way that hits."""
    own = table(spark, d, "supplier").select(F.col("s_suppkey").alias("company"), F.explode(F.array(F.struct(F.col("s_name").alias("id"), F.lit(1).alias("matched_by")), F.struct((F.col("s_suppkey") * 1009).cast("string").alias("id"), F.lit(2).alias("matched_by")), F.struct(F.lpad(F.col("s_suppkey").cast("string"), 6, "0").alias("id"), F.lit(3).alias("matched_by")))).alias("x"))
    return own.groupBy("x.id").agg(F.min(F.struct("x.matched_by", "company")).alias("hit")).select("id", "hit.company", "hit.matched_by")
