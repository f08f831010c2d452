"""Queries for sessions, lending, adjusted prices, dividends and contracts.

Share events of the adaptation: signups of an instrument, with its value as factor; cash events: purchases.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import market as M
from tidemark.plans.base import LINES, SESSIONS, lines, query, sessions, table

LAST = "date'2024-01-30'"


@query(f"""WITH {SESSIONS} SELECT ticker, day, round(avg(volume) OVER w, 6) AS adtv, round(avg(qty) OVER w, 6) AS adqty, count(*) OVER w AS n_sessions FROM sessions WINDOW w AS (PARTITION BY ticker ORDER BY day ROWS BETWEEN 20 PRECEDING AND CURRENT ROW)""")
def adtv_21(spark, d):
    return M.trailing_turnover(sessions(spark, d))


FLOATS = SESSIONS + """,
ins AS (SELECT ticker, day AS i_day, qty AS shares FROM sessions QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY day DESC) = 1),
wts AS (SELECT user_id AS ticker, ts::DATE AS day, event_type AS index_code, sum(event_id % 100 + 500)::BIGINT AS float_shares FROM events WHERE event_type IN ('view', 'click', 'error') GROUP BY 1, 2, 3),
wt AS (SELECT ticker, day AS w_day, index_code, float_shares FROM wts QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY day DESC, coalesce(list_position(['view', 'click', 'error'], index_code), 4), index_code) = 1),
floats AS (SELECT ticker, shares, index_code, float_shares, greatest(i_day, w_day) AS as_of FROM ins FULL JOIN wt USING (ticker))"""


def floats(spark, d):
    own = sessions(spark, d).withColumn("shares", F.col("qty"))
    weights = table(spark, d, "events").filter(F.col("event_type").isin("view", "click", "error")).groupBy(F.col("user_id").alias("ticker"), F.col("ts").cast("date").alias("day"), F.col("event_type").alias("index_code")).agg(F.sum(F.col("event_id") % 100 + 500).alias("float_shares"))
    return M.newest_float(own, weights, ["view", "click", "error"])


@query(f"WITH {FLOATS} SELECT * FROM floats")
def dim_ticker_float(spark, d):
    return floats(spark, d)


POSITIONS = "positions AS (SELECT user_id AS ticker, ts::DATE AS day, event_id % 50 + 1 AS qty, value / 100 AS rate FROM events WHERE event_type IN ('error', 'view'))"


def positions(spark, d):
    return table(spark, d, "events").filter(F.col("event_type").isin("error", "view")).select(F.col("user_id").alias("ticker"), F.col("ts").cast("date").alias("day"), (F.col("event_id") % 50 + 1).alias("qty"), (F.col("value") / 100).alias("rate"))


SHORT = FLOATS + ", " + POSITIONS + """,
adq AS (SELECT ticker, day, avg(qty) OVER (PARTITION BY ticker ORDER BY day ROWS BETWEEN 20 PRECEDING AND CURRENT ROW) AS adqty FROM sessions),
own AS (SELECT ticker, day, sum(qty)::BIGINT AS short_qty, sum(qty::DECIMAL(18,2) * rate::DECIMAL(18,6))::DOUBLE / nullif(sum(qty), 0) AS rate FROM positions GROUP BY 1, 2),
short AS (SELECT ticker, day, short_qty, round(rate::DECIMAL(38,9), 6)::DOUBLE AS rate, round(short_qty / nullif(float_shares, 0) * 100, 6) AS pct_float, round(short_qty / nullif(adqty, 0), 6) AS days_to_cover
  FROM own LEFT JOIN floats USING (ticker) LEFT JOIN adq USING (ticker, day))"""


def short(spark, d):
    return M.short_interest(positions(spark, d), floats(spark, d), M.trailing_turnover(sessions(spark, d)))


@query(f"WITH {SHORT} SELECT * FROM short")
def short_interest_daily(spark, d):
    return short(spark, d)


@query(f"""WITH {SHORT} SELECT c_mktsegment AS sector, sum(short_qty)::BIGINT AS qty, sum(short_qty)::DOUBLE AS value, median(short_qty) AS median_value, count(*) AS n
FROM short LEFT JOIN customer ON c_custkey = ticker GROUP BY 1""")
def short_interest_by_sector(spark, d):
    rows = short(spark, d).join(table(spark, d, "customer").select(F.col("c_custkey").alias("ticker"), "c_mktsegment"), "ticker", "left")
    return M.by_sector(rows, F.col("c_mktsegment"), "short_qty", "short_qty")


@query("""WITH e AS (SELECT event_type, ts::DATE AS day, value FROM events WHERE NOT (event_type = 'view' AND ts::DATE < DATE '2024-01-04')),
per AS (SELECT event_type, day, sum(value::DECIMAL(18,2)) AS v FROM e GROUP BY 1, 2),
mtd AS (SELECT event_type, day, (sum(v) OVER (PARTITION BY event_type ORDER BY day))::DOUBLE AS v FROM per),
l AS (SELECT *, lag(v) OVER (PARTITION BY event_type, date_trunc('month', day) ORDER BY day) AS b FROM mtd)
SELECT event_type, day, round(CASE WHEN b IS NOT NULL THEN v - b WHEN day = DATE '2024-01-01' THEN v END, 6) AS amount, CASE WHEN b IS NOT NULL THEN 'delta' WHEN day = DATE '2024-01-01' THEN 'month_open' ELSE 'unknown' END AS basis FROM l""")
def investor_flow_daily(spark, d):
    from pyspark.sql import Window

    ev = table(spark, d, "events").select("event_type", F.col("ts").cast("date").alias("day"), "value")
    own = ev.filter("not (event_type = 'view' and day < date'2024-01-04')")
    per = own.groupBy("event_type", "day").agg(F.sum(F.col("value").cast("decimal(18,2)")).alias("v"))
    mtd = per.withColumn("v", F.sum("v").over(Window.partitionBy("event_type").orderBy("day")).cast("double"))
    return M.month_deltas(mtd, ["event_type"], "day", "v", ev.select("day"))


@query(f"""WITH {LINES} SELECT day, kind, count(*) AS n_trades, sum(qty) AS qty, round((sum(qty::DECIMAL(18,2) * rate::DECIMAL(18,6))::DOUBLE / nullif(sum(qty), 0))::DECIMAL(38,9), 6)::DOUBLE AS mean_rate, min(rate) AS min_rate, max(rate) AS max_rate,
  count(DISTINCT lender) AS n_lenders, count(DISTINCT borrower) AS n_borrowers, count(*) FILTER (lender IS NOT DISTINCT FROM borrower) AS n_internal FROM lines GROUP BY 1, 2""")
def lending_trade_daily(spark, d):
    return M.lending_trades(lines(spark, d), ["day", "kind"])


@query(f"""WITH {LINES}, legs AS (SELECT day, lender AS participant, 'l' AS side, qty, rate FROM lines UNION ALL SELECT day, borrower, 'b', qty, rate FROM lines)
SELECT day, participant, coalesce(sum(qty) FILTER (side = 'l'), 0) AS lent_qty, round((sum(qty::DECIMAL(18,2) * rate::DECIMAL(18,6)) FILTER (side = 'l')::DOUBLE / nullif(sum(qty) FILTER (side = 'l'), 0))::DECIMAL(38,9), 6)::DOUBLE AS lent_rate,
  coalesce(sum(qty) FILTER (side = 'b'), 0) AS borrowed_qty, round((sum(qty::DECIMAL(18,2) * rate::DECIMAL(18,6)) FILTER (side = 'b')::DOUBLE / nullif(sum(qty) FILTER (side = 'b'), 0))::DECIMAL(38,9), 6)::DOUBLE AS borrowed_rate,
  coalesce(sum(qty) FILTER (side = 'l'), 0) - coalesce(sum(qty) FILTER (side = 'b'), 0) AS net_qty FROM legs GROUP BY 1, 2""")
def lending_participant_daily(spark, d):
    return M.participant_legs(lines(spark, d), ["day"])


SHARE = """share AS (SELECT user_id AS ticker, ts::DATE AS last_cum, CASE WHEN event_id % 2 = 0 THEN 'GRUPAMENTO' ELSE 'DESDOBRAMENTO' END AS kind, CASE WHEN event_id % 2 = 0 THEN 0.5 ELSE 10.0 END::DOUBLE AS factor FROM events WHERE event_type = 'signup'),
ratios AS (SELECT DISTINCT ticker, last_cum, CASE WHEN kind = 'GRUPAMENTO' THEN factor ELSE 1 + factor / 100 END AS ratio FROM share WHERE last_cum < DATE '2024-01-30')"""
ADJ = SESSIONS + ", " + SHARE + """,
adj AS (SELECT s.ticker, s.day, s.close, round(s.close / exp(coalesce(sum(ln(r.ratio)), 0)), 6) AS close_adj FROM sessions s LEFT JOIN ratios r ON r.ticker = s.ticker AND r.last_cum >= s.day GROUP BY s.ticker, s.day, s.close)"""


def share_events(spark, d):
    even = F.col("event_id") % 2 == 0
    return table(spark, d, "events").filter("event_type = 'signup'").select(F.col("user_id").alias("ticker"), F.col("ts").cast("date").alias("last_cum"), F.when(even, "GRUPAMENTO").otherwise("DESDOBRAMENTO").alias("kind"), F.when(even, 0.5).otherwise(10.0).alias("factor"))


def adjusted(spark, d):
    return M.adjusted_close(sessions(spark, d).select("ticker", "day", "close"), share_events(spark, d), "2024-01-30")


@query(f"WITH {ADJ} SELECT * FROM adj")
def close_adjusted(spark, d):
    return adjusted(spark, d)


CASH = """cash0 AS (SELECT user_id AS ticker, ts::DATE AS last_cum, value / 100 AS amount FROM events WHERE event_type = 'purchase'),
cash AS (SELECT c.*, min(s.day) AS ex_day FROM cash0 c LEFT JOIN (SELECT DISTINCT user_id AS ticker, ts::DATE AS day FROM events) s ON s.ticker = c.ticker AND s.day > c.last_cum AND s.day <= c.last_cum + 7 GROUP BY ALL)"""


def cash_events(spark, d):
    own = table(spark, d, "events").filter("event_type = 'purchase'").select(F.col("user_id").alias("ticker"), F.col("ts").cast("date").alias("last_cum"), (F.col("value") / 100).alias("amount"))
    return M.next_session(own, sessions(spark, d), "ticker", "last_cum", 7)


@query(f"""WITH {CASH} SELECT * REPLACE (round(amount, 6) AS amount), CASE WHEN ex_day IS NOT NULL THEN 'cash' WHEN last_cum >= DATE '2024-01-24' THEN 'pending' ELSE 'unresolved' END AS kind FROM cash""")
def cash_event_resolution(spark, d):
    kind = F.when(F.col("ex_day").isNotNull(), "cash").when(F.col("last_cum") >= F.lit("2024-01-24").cast("date"), "pending").otherwise("unresolved")
    return cash_events(spark, d).dropDuplicates().withColumn("kind", kind)


@query(f"""WITH {ADJ}, {CASH}, c AS (SELECT cash.ticker, last_cum, ln(1 + amount / nullif(close, 0)) AS ln FROM cash LEFT JOIN sessions x ON x.ticker = cash.ticker AND x.day = cash.ex_day)
SELECT a.ticker, a.day, a.close, a.close_adj, CASE WHEN count(*) FILTER (c.last_cum IS NOT NULL AND c.ln IS NULL) = 0 THEN round(a.close_adj / exp(coalesce(sum(c.ln), 0)), 6) END AS close_tr
FROM adj a LEFT JOIN c ON c.ticker = a.ticker AND c.last_cum >= a.day GROUP BY a.ticker, a.day, a.close, a.close_adj""")
def close_total_return(spark, d):
    closes = sessions(spark, d).select("ticker", F.col("day").alias("ex_day"), F.col("close").alias("ex_close"))
    cash = cash_events(spark, d).dropDuplicates().join(closes, ["ticker", "ex_day"], "left")
    return M.total_return(adjusted(spark, d), cash)


@query(f"""WITH {SESSIONS}, {SHARE}, l AS (SELECT ticker, day, close, lag(close) OVER w AS pc, lag(day) OVER w AS pd, ticker % 3 AS unit FROM sessions WINDOW w AS (PARTITION BY ticker ORDER BY day)),
allr AS (SELECT ticker, last_cum, CASE WHEN kind = 'GRUPAMENTO' THEN factor ELSE 1 + factor / 100 END AS ratio FROM share)
SELECT l.ticker, l.day, round(CASE WHEN date_diff('day', pd, day) <= 7 THEN close * exp(coalesce(sum(ln(ratio)), 0)) / pc - 1 END, 6) AS ret
FROM l LEFT JOIN allr r ON r.ticker = l.ticker AND r.last_cum >= pd AND r.last_cum < day GROUP BY l.ticker, l.day, close, pc, pd""")
def panel_close_return(spark, d):
    bars = sessions(spark, d).select("ticker", "day", "close", (F.col("ticker") % 3).alias("unit"))
    return M.event_return(bars, share_events(spark, d)).select("ticker", "day", "ret")


@query("""WITH o AS (SELECT l_orderkey, l_partkey, l_extendedprice / l_quantity AS price FROM lineitem), c AS (SELECT l_orderkey, count(DISTINCT l_suppkey) AS n_candidates, min(l_suppkey) AS s, min(l_extendedprice / l_quantity) AS cl FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1)
SELECT l_orderkey, l_partkey, round(price::DECIMAL(38,9), 6)::DOUBLE AS price, n_candidates, CASE WHEN n_candidates = 1 AND abs(price - cl) <= 0.005::DOUBLE * cl THEN s END AS l_suppkey FROM o LEFT JOIN c USING (l_orderkey)""")
def isin_resolution(spark, d):
    rows = table(spark, d, "lineitem").withColumn("price", F.col("l_extendedprice") / F.col("l_quantity"))
    known = rows.filter("l_returnflag = 'R'").select("l_orderkey", "l_suppkey", F.col("price").alias("close"))
    return M.resolve_unique(rows.select("l_orderkey", "l_partkey", "price"), known, ["l_orderkey"], "l_suppkey", "price", "close")


@query("""WITH h AS (SELECT DISTINCT o_custkey AS id, o_orderkey AS installment, round((o_custkey % 9) / 7.0::DOUBLE, 10) AS amount FROM orders WHERE o_orderstatus = 'F'),
n AS (SELECT *, row_number() OVER (PARTITION BY id, amount ORDER BY installment) AS nth, count(*) OVER (PARTITION BY id, amount) AS alln FROM h),
s AS (SELECT o_custkey AS id, round((o_custkey % 9) / 7.0::DOUBLE, 10) + 2e-9::DOUBLE AS a2, o_orderdate::DATE AS pay_day FROM orders WHERE o_orderstatus = 'P'),
m AS (SELECT n.*, (SELECT list_sort(list_distinct(list(pay_day))) FROM s WHERE s.id = n.id AND abs(n.amount - a2) < 1e-8) AS days FROM n)
SELECT id, installment, amount, CASE WHEN len(days) = 1 THEN days[1] WHEN len(days) = alln THEN days[nth] END AS pay_day FROM m""".replace("SELECT id, installment, amount, CASE", "SELECT id, installment, round(amount, 6) AS amount, CASE"))
def dividend_payments(spark, d):
    amount = F.round((F.col("o_custkey") % 9) / 7.0, 10)
    o = table(spark, d, "orders")
    history = o.filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("installment"), amount.alias("amount")).distinct()
    extra = o.filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("id"), (amount + 2e-9).alias("amount"), F.col("o_orderdate").cast("date").alias("pay_day"))
    return M.payment_dates(history, extra, ["id"], "amount")


FUT = """fut AS (SELECT DISTINCT ts::DATE AS day, 'DI1' || substr('FGHJKMNQUVXZ', (user_id % 12 + 1)::INT, 1) || (24 + user_id % 4)::VARCHAR AS ticker, make_date(2024 + user_id % 4, user_id % 12 + 1, 1) AS maturity FROM events)"""


def futures(spark, d):
    letters = F.array(*[F.lit(x) for x in M.MONTH_LETTERS])
    rows = table(spark, d, "events").select(F.col("ts").cast("date").alias("day"), F.concat(F.lit("DI1"), F.get(letters, (F.col("user_id") % 12).cast("int")), (24 + F.col("user_id") % 4).cast("string")).alias("ticker")).distinct()
    return rows.withColumn("maturity", M.contract_maturity(F.col("ticker")))


@query(f"WITH {FUT} SELECT * FROM fut WHERE day = (SELECT max(day) FROM fut)")
def future_curve(spark, d):
    rows = futures(spark, d)
    return rows.join(F.broadcast(rows.agg(F.max("day").alias("day"))), "day", "left_semi")  # one row


@query(f"WITH {FUT}, r AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY maturity, ticker) AS rank FROM fut WHERE maturity > last_day(day)) SELECT * FROM r WHERE rank = 2")
def future_nth_series(spark, d):
    return M.nth_contract(futures(spark, d), 2)


@query(f"""WITH {SESSIONS}, o AS (SELECT event_id, user_id AS isin, ts::DATE AS day, value AS premium FROM events WHERE event_type = 'view'),
c AS (SELECT ticker % 10 AS isin, day, ticker, close, CASE WHEN ticker % 2 = 0 THEN 0 ELSE 1 END AS p FROM sessions),
b AS (SELECT isin, day, ticker AS underlying, close AS underlying_close FROM c QUALIFY row_number() OVER (PARTITION BY isin, day ORDER BY p, ticker, close) = 1)
SELECT o.*, underlying, underlying_close FROM o LEFT JOIN b ON b.isin = o.isin AND b.day = o.day""")
def option_chain(spark, d):
    options = table(spark, d, "events").filter("event_type = 'view'").select("event_id", F.col("user_id").alias("isin"), F.col("ts").cast("date").alias("day"), F.col("value").alias("premium"))
    cash = sessions(spark, d).select((F.col("ticker") % 10).alias("isin"), "day", "ticker", "close")
    return M.best_underlying(options, cash, ["isin", "day"], F.when(F.col("ticker") % 2 == 0, 0).otherwise(1))


@query(f"""WITH {SESSIONS}, r AS (SELECT ticker, day, close, close / nullif(lag(close) OVER (PARTITION BY ticker ORDER BY day), 0) AS ratio FROM sessions) SELECT ticker, day, close, round(ratio, 6) AS ratio, coalesce(NOT (ratio BETWEEN 0.5 AND 2), false) AS is_step FROM r""")
def index_divisor_steps(spark, d):
    return M.divisor_steps(sessions(spark, d).select("ticker", "day", "close"), ["ticker"], "day", "close")


@query("""WITH RECURSIVE p AS (SELECT 1 AS hop, c_custkey // 2 AS name FROM customer WHERE c_custkey = 1000 UNION ALL SELECT hop + 1, name // 2 FROM p WHERE name >= 2 AND hop < 10) SELECT hop, name, DATE '2024-01-01' AS day FROM p""")
def ticker_lineage(spark, d):
    changes = table(spark, d, "customer").select(F.floor(F.col("c_custkey") / 2).alias("old"), F.col("c_custkey").alias("new"), F.lit("2024-01-01").cast("date").alias("day")).filter("new > 1")
    return M.lineage(changes.filter("old > 0"), 1000)


@query(f"""WITH {SESSIONS}, f AS (SELECT user_id AS ticker, event_type AS company, ts::DATE AS filed, event_id FROM events), last AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY company, ticker ORDER BY filed DESC, event_id DESC) = 1),
n AS (SELECT ticker, count(DISTINCT day) AS n_sessions FROM sessions WHERE day > DATE '2024-01-20' - 15 AND day <= DATE '2024-01-20' GROUP BY 1)
SELECT last.*, n_sessions, coalesce(n_sessions, 0) >= 13 AS is_active FROM last LEFT JOIN n USING (ticker)""")
def company_ticker(spark, d):
    filings = table(spark, d, "events").select(F.col("user_id").alias("ticker"), F.col("event_type").alias("company"), F.col("ts").cast("date").alias("filed"), "event_id")
    return M.active_tickers(filings, sessions(spark, d), ["company", "ticker"], [F.col("filed").desc(), F.col("event_id").desc()], "2024-01-20", 15, 13)


@query(f"WITH {SESSIONS} SELECT ticker, day, close, qty FROM sessions WHERE ticker = 7 AND (day, ticker) > (DATE '2024-01-10', 0) ORDER BY day, ticker LIMIT 10")
def quote_history_page(spark, d):
    from tidemark.functions.core import keyset_after

    return keyset_after(sessions(spark, d).filter("ticker = 7").select("ticker", "day", "close", "qty"), ["day", "ticker"], ("2024-01-10", 0), 10)


@query(f"WITH {SESSIONS} SELECT * FROM sessions QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY day DESC) = 1")
def quote_latest(spark, d):
    from tidemark.functions.core import latest_by

    return latest_by(sessions(spark, d), ["ticker"], [F.col("day").desc()])


@query("""SELECT event_id, user_id AS ticker, ts::DATE AS day, value / nullif(event_id % 3, 0) AS close_unit, CAST(json_extract(props, '$.k') AS BIGINT) AS points FROM events WHERE event_type = 'purchase'""".replace("value / nullif(event_id % 3, 0)", "round(value / nullif(event_id % 3, 0), 6)"))
def quotes_typed(spark, d):
    from tidemark.functions.core import safe_div
    from tidemark.functions.text import json_field

    rows = table(spark, d, "events").filter("event_type = 'purchase'")
    return rows.select("event_id", F.col("user_id").alias("ticker"), F.col("ts").cast("date").alias("day"), safe_div("value", F.col("event_id") % 3).alias("close_unit"), json_field("props", "k").try_cast("long").alias("points"))
