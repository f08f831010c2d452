"""Queries on typed instruments, options, auctions, forwards, indices and the research universe.

A part is an instrument: its brand the ticker's stem, its type the specification. Line items are its prints: the return
flag is the market, the line number the lot.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.core import keyset_after, total
from tidemark.operators import funds as U
from tidemark.plans.base import query, table

TYPED = """typed AS (SELECT p_partkey AS id, p_brand AS stem, p_brand || '-' || (p_partkey % 40)::VARCHAR AS ticker, p_type AS spec, p_size AS size,
  CASE WHEN p_type LIKE 'PROMO%' THEN 'equity' WHEN p_type LIKE 'ECON%' THEN 'bdr' WHEN p_type LIKE 'STAND%' THEN 'unit' WHEN p_type LIKE 'SMALL%' THEN 'quota' ELSE 'cash' END AS kind,
  CASE WHEN p_size > 25 THEN 'round' ELSE 'odd' END AS lot FROM part)"""
PRINTS = """prints AS (SELECT l_partkey AS id, l_shipdate::DATE AS day, l_returnflag AS market, l_linenumber AS lot_no, l_extendedprice AS price, l_quantity AS qty, l_orderkey AS trade, l_discount AS rate FROM lineitem)"""


def typed(spark: SparkSession, d: str) -> DataFrame:
    spec = F.col("p_type")
    kind = F.when(spec.startswith("PROMO"), "equity").when(spec.startswith("ECON"), "bdr").when(spec.startswith("STAND"), "unit").when(spec.startswith("SMALL"), "quota").otherwise("cash")
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("stem"), F.concat("p_brand", F.lit("-"), (F.col("p_partkey") % 40).cast("string")).alias("ticker"), spec.alias("spec"), F.col("p_size").alias("size"), kind.alias("kind"), F.when(F.col("p_size") > 25, "round").otherwise("odd").alias("lot"))


def prints(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(F.col("l_partkey").alias("id"), F.col("l_shipdate").cast("date").alias("day"), F.col("l_returnflag").alias("market"), F.col("l_linenumber").alias("lot_no"), F.col("l_extendedprice").alias("price"), F.col("l_quantity").alias("qty"), F.col("l_orderkey").alias("trade"), F.col("l_discount").alias("rate"))


def _of_kind(spark: SparkSession, d: str, kind: str) -> DataFrame:
    """Prints of one kind of instrument: the kind is filtered on the small side, before the join."""
    return prints(spark, d).join(typed(spark, d).filter(F.col("kind") == kind), "id").select("ticker", "day", "price", "qty", "trade", "lot_no", "lot", "spec")


def _sql_of_kind(kind: str, columns: str) -> str:
    return f"WITH {TYPED}, {PRINTS} SELECT {columns} FROM prints JOIN typed USING (id) WHERE kind = '{kind}'"


@query(_sql_of_kind("equity", "ticker, day, price, qty, trade, lot_no, lot"))
def equities(spark: SparkSession, d: str) -> DataFrame:
    """Equity prints with the label of their lot."""
    return _of_kind(spark, d, "equity").drop("spec")


@query(_sql_of_kind("bdr", "ticker, day, price, qty, trade, lot_no"))
def receipts(spark: SparkSession, d: str) -> DataFrame:
    return _of_kind(spark, d, "bdr").drop("lot", "spec")


@query(_sql_of_kind("unit", "ticker, day, price, qty, trade, lot_no"))
def units(spark: SparkSession, d: str) -> DataFrame:
    return _of_kind(spark, d, "unit").drop("lot", "spec")


@query(_sql_of_kind("quota", "ticker, day, price, qty, trade, lot_no, CASE WHEN spec LIKE '%BRASS' THEN 'metal' WHEN contains(spec, 'PLATED') THEN 'plated' END AS subtype"))
def fund_quotas(spark: SparkSession, d: str) -> DataFrame:
    """Fund quotas with their subtype, null where none is known."""
    subtype = F.when(F.col("spec").endswith("BRASS"), "metal").when(F.contains("spec", F.lit("PLATED")), "plated")
    return _of_kind(spark, d, "quota").withColumn("subtype", subtype).drop("lot", "spec")


@query(_sql_of_kind("cash", "ticker, day, price, qty, trade, lot_no"))
def cash_securities(spark: SparkSession, d: str) -> DataFrame:
    return _of_kind(spark, d, "cash").drop("lot", "spec")


@query(f"WITH {PRINTS} SELECT id, day, trade, price, qty, lot_no FROM prints WHERE lot_no IN (1, 2) AND market = 'R'")
def auctions(spark: SparkSession, d: str) -> DataFrame:
    return prints(spark, d).filter(F.col("lot_no").isin(1, 2) & (F.col("market") == "R")).select("id", "day", "trade", "price", "qty", "lot_no")


@query(f"""WITH {TYPED}, {PRINTS} SELECT p.id, t.ticker, p.day, p.lot_no * 30 AS term, sum(p.qty) AS qty, round(sum(p.price::DECIMAL(18,2))::DOUBLE / sum(p.qty), 6) AS mean_price FROM prints p JOIN typed t USING (id) WHERE market = 'N' GROUP BY ALL""")
def forward_history(spark: SparkSession, d: str) -> DataFrame:
    """Forwards by term."""
    own = prints(spark, d).filter("market = 'N'").groupBy("id", "day", (F.col("lot_no") * 30).alias("term")).agg(F.sum("qty").alias("qty"), (total("price") / F.sum("qty")).alias("mean_price"))
    return own.join(typed(spark, d).select("id", "ticker"), "id")


@query(f"""WITH {TYPED}, {PRINTS} SELECT t.stem, p.id, p.day, p.trade, p.price, u.close AS underlying FROM prints p JOIN typed t USING (id)
LEFT JOIN (SELECT stem, day, arg_max(price, (trade, lot_no, price)) AS close FROM prints JOIN typed USING (id) WHERE kind = 'equity' GROUP BY 1, 2) u ON u.stem = t.stem AND u.day = p.day WHERE p.lot_no IN (6, 7)""")
def option_exercises(spark: SparkSession, d: str) -> DataFrame:
    """Exercise prints beside the underlying's last price of the day, found by the ticker's stem."""
    stems = typed(spark, d).select("id", "stem", "kind")
    both = prints(spark, d).join(stems, "id")
    under = both.filter("kind = 'equity'").groupBy("stem", "day").agg(F.max_by("price", F.struct("trade", "lot_no", "price")).alias("underlying"))
    return both.filter(F.col("lot_no").isin(6, 7)).join(under, ["stem", "day"], "left").select("stem", "id", "day", "trade", "price", "underlying")


@query(f"""WITH {PRINTS}, s AS (SELECT id, day, arg_max(price, (trade, lot_no, price)) AS premium, sum(qty) AS qty FROM prints WHERE market = 'A' GROUP BY 1, 2)
SELECT id, day, premium, qty, round(premium - lag(premium) OVER (PARTITION BY id ORDER BY day), 6) AS change FROM s""")
def option_history(spark: SparkSession, d: str) -> DataFrame:
    """Each series' premium by day, with its change from the day before."""
    own = prints(spark, d).filter("market = 'A'").groupBy("id", "day").agg(F.max_by("price", F.struct("trade", "lot_no", "price")).alias("premium"), F.sum("qty").alias("qty"))
    return own.withColumn("change", F.col("premium") - F.lag("premium").over(Window.partitionBy("id").orderBy("day")))


@query("""WITH v AS (SELECT o_orderpriority AS index_code, o_orderdate::DATE AS day, round(avg(o_totalprice::DECIMAL(18,2))::DOUBLE, 6) AS level FROM orders GROUP BY 1, 2)
SELECT * FROM v WHERE (day, index_code) > (DATE '1995-06-01', '3-MEDIUM') ORDER BY day, index_code LIMIT 100""")
def index_history(spark: SparkSession, d: str) -> DataFrame:
    """A page of index levels after a cursor."""
    own = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("index_code"), F.col("o_orderdate").cast("date").alias("day")).agg(F.avg(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("level"))
    return keyset_after(own, ["day", "index_code"], ("1995-06-01", "3-MEDIUM"), 100)


@query(f"""WITH {TYPED}, {PRINTS}, s AS (SELECT ticker, stem, min(day) AS first_observed, max(day) AS last_observed, count(DISTINCT day) AS n_sessions FROM prints JOIN typed USING (id) GROUP BY 1, 2),
f AS (SELECT ticker, min(l_suppkey) AS company FROM lineitem JOIN typed ON id = l_partkey WHERE l_linenumber = 7 GROUP BY 1 HAVING count(DISTINCT l_suppkey) = 1),
g AS (SELECT stem, min(l_suppkey) AS company FROM lineitem JOIN typed ON id = l_partkey WHERE l_quantity = 50 GROUP BY 1 HAVING count(DISTINCT l_suppkey) = 1)
SELECT s.*, coalesce(f.company, g.company) AS company, CASE WHEN f.company IS NOT NULL THEN 'ticker' WHEN g.company IS NOT NULL THEN 'stem' END AS basis FROM s LEFT JOIN f USING (ticker) LEFT JOIN g USING (stem)""")
def research_universe(spark: SparkSession, d: str) -> DataFrame:
    """Every ticker's first and last session, and its company by exact ticker, else by stem, only where exactly one fits."""
    names = typed(spark, d).select("id", "ticker", "stem")
    own = prints(spark, d).join(names, "id").groupBy("ticker", "stem").agg(F.min("day").alias("first_observed"), F.max("day").alias("last_observed"), F.countDistinct("day").alias("n_sessions"))
    filed = table(spark, d, "lineitem").join(names, F.col("id") == F.col("l_partkey"))
    exact = filed.filter("l_linenumber = 7").select("ticker", F.col("l_suppkey").alias("by_ticker"))
    loose = filed.filter("l_quantity = 50").select("stem", F.col("l_suppkey").alias("by_stem"))
    out = U.by_exactly_one(U.by_exactly_one(own, "by_ticker", exact, "ticker"), "by_stem", loose, "stem")
    basis = F.when(F.col("by_ticker").isNotNull(), "ticker").when(F.col("by_stem").isNotNull(), "stem")
    return out.select("ticker", "stem", "first_observed", "last_observed", "n_sessions", F.coalesce("by_ticker", "by_stem").alias("company"), basis.alias("basis"))


@query(f"""WITH {TYPED}, {PRINTS}, m AS (SELECT id, mode(market ORDER BY market) AS m FROM prints GROUP BY 1), c AS (SELECT id, market, count(*) AS n FROM prints GROUP BY 1, 2),
b AS (SELECT id, market FROM c QUALIFY row_number() OVER (PARTITION BY id ORDER BY n DESC, market) = 1)
SELECT t.id, t.ticker, b.market, round(sum(p.price::DECIMAL(18,2))::DOUBLE / sum(p.qty), 6) AS price, max(p.day) AS newest FROM prints p JOIN typed t USING (id) JOIN b ON b.id = p.id GROUP BY ALL""")
def portfolio_instruments(spark: SparkSession, d: str) -> DataFrame:
    """Codes matched to instruments: the most frequent market, weighted price, newest day."""
    own = prints(spark, d)
    most = own.groupBy("id", "market").agg(F.count("*").alias("n")).groupBy("id").agg(F.min_by("market", F.struct(-F.col("n"), "market")).alias("market"))
    sums = own.groupBy("id").agg((total("price") / F.sum("qty")).alias("price"), F.max("day").alias("newest"))
    return sums.join(most, "id").join(typed(spark, d).select("id", "ticker"), "id")


@query("""WITH a AS (SELECT o_custkey AS fund, 1 AS source, o_orderpriority AS terms, o_orderdate AS filed, o_orderkey AS id FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT o_custkey, 2, o_orderpriority, o_orderdate, o_orderkey FROM orders WHERE o_orderstatus = 'O'
  UNION ALL SELECT o_custkey, 3, o_orderpriority, o_orderdate, o_orderkey FROM orders WHERE o_orderstatus = 'P')
SELECT fund, source, terms, filed::DATE AS filed FROM a QUALIFY row_number() OVER (PARTITION BY fund ORDER BY source, filed DESC, id DESC) = 1""")
def fund_terms(spark: SparkSession, d: str) -> DataFrame:
    """Terms of each fund from the first source that has any, the newest filing of it."""
    source = F.when(F.col("o_orderstatus") == "F", 1).when(F.col("o_orderstatus") == "O", 2).otherwise(3)
    own = table(spark, d, "orders").select(F.col("o_custkey").alias("fund"), source.alias("source"), F.col("o_orderpriority").alias("terms"), F.col("o_orderdate").alias("filed"), F.col("o_orderkey").alias("id"))
    best = own.groupBy("fund").agg(F.max_by(F.struct("source", "terms", "filed"), F.struct(-F.col("source"), "filed", "id")).alias("x"))
    return best.select("fund", "x.source", "x.terms", F.col("x.filed").cast("date").alias("filed"))


@query("SELECT id, day, trade, price, qty FROM (SELECT l_partkey AS id, l_shipdate::DATE AS day, l_orderkey AS trade, l_extendedprice AS price, l_quantity AS qty FROM lineitem) ORDER BY day, id, trade, price LIMIT 200")
def trade_page(spark: SparkSession, d: str) -> DataFrame:
    """The first page of consolidated trades."""
    return keyset_after(prints(spark, d).select("id", "day", "trade", "price", "qty"), ["day", "id", "trade", "price"], None, 200)
