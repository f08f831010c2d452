"""Returns over a close of 0."""

import datetime
import math

from pyspark.sql import functions as F

from tidemark.operators import market as M


def test_a_close_of_zero_before_is_no_error(spark):
    day = lambda n: datetime.date(2024, 1, n)
    bars = spark.createDataFrame([("a", day(1), 2.0, 1), ("a", day(2), 0.0, 1), ("a", day(3), 0.0, 1), ("a", day(4), 3.0, 1), ("a", day(5), 6.0, 1), ("a", day(25), 6.0, 1)], "ticker string, day date, close double, unit int")
    events = spark.createDataFrame([], "ticker string, last_cum date, kind string, factor double")
    got = {r.day.day: r.ret for r in M.event_return(bars, events).collect()}
    assert got[1] is None and got[2] == -1 and math.isnan(got[3]) and got[4] == math.inf and got[5] == 1 and got[25] is None


def test_returns_dont_depend_on_the_order_of_events(spark):
    day = lambda n: datetime.date(2024, 1, n)
    bars = spark.createDataFrame([("a", day(1), 3.0, 1), ("a", day(7), 7.0, 1)], "ticker string, day date, close double, unit int")
    own = [("a", day(1 + i % 5), *(("GRUPAMENTO", 0.5) if i % 8 == 0 else ("DESDOBRAMENTO", 10.0))) for i in range(120)]
    cash = [("a", day(1 + i % 5), 0.1 * (1 + i % 7), 3.0) for i in range(120)]
    rets, grown = set(), set()
    for turned in (list, lambda x: x[::-1], lambda x: x[60:] + x[:60], lambda x: sorted(x, key=str), lambda x: x[::2] + x[1::2]):
        rets.add(M.event_return(bars, spark.createDataFrame(turned(own), "ticker string, last_cum date, kind string, factor double").coalesce(1)).filter("ret is not null").first().ret)
        paid = spark.createDataFrame(turned(cash), "ticker string, last_cum date, amount double, ex_close double").coalesce(1)
        grown.add(M.total_return(bars.select("ticker", "day", (F.col("close") * 1e15).alias("close_adj")), paid).agg({"close_tr": "min"}).first()[0])
    assert len(rets) == 1 and len(grown) == 1
