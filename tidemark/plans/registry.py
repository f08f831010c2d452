"""Queries on what there is: catalogues of series, portfolio fee summaries, identification."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.core import total
from tidemark.functions.text import name_norm
from tidemark.operators import forecast
from tidemark.plans.base import QUERIES, query, table
from tidemark.plans.portfolios import FEES, HELD, disclosed, held


def _registry(rows: DataFrame, series, day: str) -> DataFrame:
    at = F.col(day).cast("date")
    return rows.groupBy(series.alias("series")).agg(F.min(at).alias("first_day"), F.max(at).alias("last_day"), F.countDistinct(at).alias("n_days"), F.count("*").alias("n_rows"))


@query("SELECT event_type AS series, min(ts::DATE) AS first_day, max(ts::DATE) AS last_day, count(DISTINCT ts::DATE) AS n_days, count(*) AS n_rows FROM events GROUP BY 1")
def macro_registry(spark: SparkSession, d: str) -> DataFrame:
    return _registry(table(spark, d, "events"), F.col("event_type"), "ts")


@query("SELECT o_orderpriority AS series, min(o_orderdate::DATE) AS first_day, max(o_orderdate::DATE) AS last_day, count(DISTINCT o_orderdate::DATE) AS n_days, count(*) AS n_rows FROM orders GROUP BY 1")
def curve_registry(spark: SparkSession, d: str) -> DataFrame:
    return _registry(table(spark, d, "orders"), F.col("o_orderpriority"), "o_orderdate")


@query("SELECT l_returnflag || '/' || l_linestatus AS series, min(l_shipdate::DATE) AS first_day, max(l_shipdate::DATE) AS last_day, count(DISTINCT l_shipdate::DATE) AS n_days, count(*) AS n_rows FROM lineitem GROUP BY 1")
def inflation_registry(spark: SparkSession, d: str) -> DataFrame:
    return _registry(table(spark, d, "lineitem"), F.concat("l_returnflag", F.lit("/"), "l_linestatus"), "l_shipdate")


@query("""SELECT user_id AS ticker, max(ts) AS newest, count(*) AS n_rows,
  bit_xor(('0x' || substr(md5(concat_ws('|', event_id, epoch_us(ts), user_id, event_type, round(value * 100)::BIGINT, props)), 1, 15))::BIGINT) AS revision FROM events GROUP BY 1""")
def data_revision(spark: SparkSession, d: str) -> DataFrame:
    """For each ticker its newest row and a number of all its rows' values: hashes, combined so that order doesn't count."""
    fields = ("event_id", F.unix_micros(F.col("ts").cast("timestamp")), "user_id", "event_type", F.round(F.col("value") * 100).cast("bigint"), "props")
    whole = F.conv(F.substring(F.md5(F.concat_ws("|", *[(F.col(c) if isinstance(c, str) else c).cast("string") for c in fields])), 1, 15), 16, 10).cast("bigint")
    return table(spark, d, "events").groupBy(F.col("user_id").alias("ticker")).agg(F.max("ts").alias("newest"), F.count("*").alias("n_rows"), F.bit_xor(whole).alias("revision"))


@query("""WITH e AS (SELECT user_id AS isin, ts::DATE AS day, event_type AS kind, value AS factor, event_id FROM events WHERE event_type IN ('signup', 'purchase'))
SELECT isin, day, kind, count(*) AS n_published, count(DISTINCT factor) AS n_factors, arg_max(factor, event_id) AS factor FROM e GROUP BY 1, 2, 3""")
def share_count_events(spark: SparkSession, d: str) -> DataFrame:
    """Share events by instrument and day: how often published, and the last factor."""
    own = table(spark, d, "events").filter(F.col("event_type").isin("signup", "purchase"))
    return own.groupBy(F.col("user_id").alias("isin"), F.col("ts").cast("date").alias("day"), F.col("event_type").alias("kind")).agg(F.count("*").alias("n_published"), F.countDistinct("value").alias("n_factors"), F.max_by("value", "event_id").alias("factor"))


@query(f"""WITH {HELD}, {FEES}, x AS (SELECT portfolio, value, fee FROM held LEFT JOIN fees ON entity = line % 10)
SELECT portfolio, sum(value::DECIMAL(18,2))::DOUBLE AS total, coalesce(sum(value::DECIMAL(18,2)) FILTER (fee IS NOT NULL), 0)::DOUBLE AS covered, count(*) FILTER (fee IS NULL) AS n_without,
  round((sum(value::DECIMAL(18,2) * round(fee, 6)::DECIMAL(18,6))::DOUBLE / nullif(sum(value::DECIMAL(18,2)) FILTER (fee IS NOT NULL), 0)::DOUBLE)::DECIMAL(38,9), 6)::DOUBLE AS mean_fee FROM x GROUP BY 1""")
def fees_summary(spark: SparkSession, d: str) -> DataFrame:
    """Each portfolio's mean fee, weighted by value, and how much of it has a fee at all."""
    fees = disclosed(spark, d).select(F.col("entity").alias("_fund"), F.round("fee", 6).alias("fee"))
    own = held(spark, d).join(fees, F.col("line") % 10 == F.col("_fund"), "left")
    known = F.when(F.col("fee").isNotNull(), F.col("value"))
    weight = F.col("value").cast("decimal(18,2)")
    out = own.groupBy("portfolio").agg(total("value").alias("total"), F.coalesce(total(known), F.lit(0.0)).alias("covered"), F.count_if(F.col("fee").isNull()).alias("n_without"), F.sum(weight * F.col("fee").cast("decimal(18,6)")).cast("double").alias("_sum"))
    return out.withColumn("mean_fee", F.round(F.col("_sum") / F.nullif(F.col("covered"), F.lit(0.0)), 9)).drop("_sum")


@query(
    """WITH k AS (SELECT c_custkey AS company, c_name AS name, c_mktsegment || '/' || c_nationkey AS class FROM customer),
c AS (SELECT class, min(company) AS company, count(*) AS n FROM k GROUP BY class),
l AS (
  SELECT o_orderkey AS line, CASE WHEN o_orderpriority = '1-URGENT' THEN o_custkey END AS number, CASE WHEN o_orderpriority IN ('2-HIGH', '3-MEDIUM') THEN upper(replace(c_name, '#', '  #')) END AS printed,
         CASE WHEN o_orderpriority NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM') THEN c_mktsegment || '/' || c_nationkey END AS class
  FROM orders LEFT JOIN customer ON c_custkey = o_custkey)
SELECT line, CASE WHEN l.number IS NOT NULL THEN a.company WHEN printed IS NOT NULL THEN b.company WHEN c.n = 1 THEN c.company END AS company,
       CASE WHEN a.company IS NOT NULL THEN 'number' WHEN b.company IS NOT NULL THEN 'name' WHEN c.n = 1 THEN 'class' WHEN c.n > 1 THEN 'ambiguous' ELSE 'none' END AS matched, CASE WHEN c.n > 1 THEN c.n END AS n_candidates
FROM l LEFT JOIN k a ON a.company = l.number LEFT JOIN (SELECT company, lower(name) AS norm FROM k) b ON b.norm = lower(replace(l.printed, '  #', '#')) LEFT JOIN c ON c.class = l.class"""
)
def identify(spark: SparkSession, d: str) -> DataFrame:
    """Each order's company by what it prints: a number, a name in other case and spacing, or only a class, which tells one
    company apart only if it has no other."""
    companies = table(spark, d, "customer").select(F.col("c_custkey").alias("company"), "c_name", F.concat("c_mktsegment", F.lit("/"), F.col("c_nationkey").cast("string")).alias("class"))
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("line"), F.col("o_custkey").alias("company"), F.col("o_orderpriority").alias("kind")).join(companies, "company", "left")
    by_number, by_name = F.col("kind") == "1-URGENT", F.col("kind").isin("2-HIGH", "3-MEDIUM")
    printed = F.upper(F.replace("c_name", F.lit("#"), F.lit("  #")))
    lines = orders.select("line", F.when(by_number, F.col("company")).alias("number"), F.when(by_name, printed).alias("printed"), F.when(~by_number & ~by_name, F.col("class")).alias("class"))
    bare = lambda c: F.regexp_replace(name_norm(c), " *# *", "#")
    numbers = companies.select(F.col("company").alias("_a"))
    names = companies.select(bare("c_name").alias("_norm"), F.col("company").alias("_b"))
    classes = companies.groupBy("class").agg(F.min("company").alias("_c"), F.count("*").alias("_n"))
    met = lines.join(numbers, F.col("number") == F.col("_a"), "left").join(names, bare("printed") == F.col("_norm"), "left").join(classes, "class", "left")
    way = F.when(F.col("_a").isNotNull(), "number").when(F.col("_b").isNotNull(), "name").when(F.col("_n") == 1, "class").when(F.col("_n") > 1, "ambiguous").otherwise("none")
    return met.select("line", F.coalesce("_a", "_b", F.when(F.col("_n") == 1, F.col("_c"))).alias("company"), way.alias("matched"), F.when(F.col("_n") > 1, F.col("_n")).alias("n_candidates"))


def forecasts(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("series").orderBy("day")
    daily = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("series"), F.col("o_orderdate").cast("date").alias("day")).agg(total("o_totalprice").alias("amount"), F.count("*").cast("double").alias("n"))
    rows = daily.withColumns({"change": F.col("amount") - F.lag("amount").over(w), "_next": F.lead("amount").over(w)})
    rows = rows.withColumn("label", F.when(F.col("_next").isNotNull(), (F.col("_next") > F.col("amount")).cast("double")))
    return forecast.walk_forward(rows.withColumn("past", (F.col("change") > 0).cast("int")), "series", "day", ["amount", "n", "change"], "label", 2, 1996, least=50, past="past", grid=(0.01, 1.0, 100.0), held=1)


@query()
def walk_forward(spark: SparkSession, d: str) -> DataFrame:
    """Whether each priority's daily amount rises, told year by year from the days before."""
    up = lambda name: F.element_at(name, 2)
    return forecasts(spark, d).select("series", "day", "year", "label", up("p").alias("p_up"), up("clim").alias("clim_up"), up("markov").alias("markov_up"), up("nested").alias("nested_up"), "c_chosen")


@query()
def walk_forward_scores(spark: SparkSession, d: str) -> DataFrame:
    """Mean scores of each model by series and year."""
    told = forecasts(spark, d)
    parts = [forecast.scored(told, m).select("series", "year", F.lit(m).alias("model"), "log_loss", "brier", "hit") for m in ("p", "nested", "clim", "markov")]
    means = [F.avg(c).alias(c) for c in ("log_loss", "brier", "hit")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3]).groupBy("series", "year", "model").agg(F.count("*").alias("n"), *means)


@query()
def walk_forward_gain(spark: SparkSession, d: str) -> DataFrame:
    """How much less log loss the chosen model has than the shares by past state, with an interval over blocks of days."""
    told = forecasts(spark, d)
    ours = forecast.scored(told, "nested").select("series", "day", F.col("log_loss").alias("a"))
    theirs = forecast.scored(told, "markov").select("series", "day", F.col("log_loss").alias("b"))
    return forecast.paired_bootstrap(ours.join(theirs, ["series", "day"]).withColumn("diff", F.col("b") - F.col("a")), "series", "day", "diff", 21, 400)


@query()
def clustered_gain(spark: SparkSession, d: str) -> DataFrame:
    """What discount and tax add to quantity in telling a line's price, with intervals over suppliers."""
    return forecast.clustered_gain(table(spark, d, "lineitem"), "l_suppkey", "l_extendedprice", ["l_quantity"], ["l_discount", "l_tax"], 300)


#: Fixed values of the adaptation: which index stands for a class.
CLASS_INDEX = {"ECONOMY": "view", "PROMO": "click", "STANDARD": "purchase"}


@query("SELECT p_partkey AS id, p_type AS class, m.index_code FROM part LEFT JOIN (VALUES ('ECONOMY', 'view'), ('PROMO', 'click'), ('STANDARD', 'purchase')) m(class, index_code) ON m.class = p_type")
def class_index(spark: SparkSession, d: str) -> DataFrame:
    """The index that stands for each security's class, null where none does."""
    known = F.create_map(*[F.lit(x) for pair in CLASS_INDEX.items() for x in pair])
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_type").alias("class"), F.try_element_at(known, F.col("p_type")).alias("index_code"))


@query(r"SELECT page_id, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host, nullif(trim(regexp_extract(html, '<title>([^<]*)</title>', 1)), '') AS title, nullif(trim(regexp_extract(html, '<h1>([^<]*)</h1>', 1)), '') AS heading FROM pages")
def page_fields(spark: SparkSession, d: str) -> DataFrame:
    """Fields cut from pages: host, title, first heading."""
    part = lambda c, p: F.regexp_extract(c, p, 1)
    return table(spark, d, "pages").select("page_id", part("url", r"^https?://([^/?#]+)").alias("host"), F.nullif(F.trim(part("html", "<title>([^<]*)</title>")), F.lit("")).alias("title"), F.nullif(F.trim(part("html", "<h1>([^<]*)</h1>")), F.lit("")).alias("heading"))
