import datetime

from tidemark.sources.fields import by_rule
from tidemark.streaming import bars_stream, land, typed_stream
from tidemark.streaming.landing import newest

SCHEMA = "CNPJ_FUNDO string, DT_COMPTC string, ID_SUBCLASSE string, VL_TOTAL string"


def test_files_land_once_and_the_last_write_wins(spark, tmp_path):
    src, table, check = tmp_path / "in", str(tmp_path / "table"), str(tmp_path / "check")
    src.mkdir()
    fields = by_rule("fi_diario", [c.split()[0] for c in SCHEMA.split(", ")])

    def run():
        rows = typed_stream(spark, str(src), SCHEMA, fields, "fi_diario", ["cnpj"])
        land(rows, table, ["cnpj", "dt_comptc", "id_subclasse"], "vl_total", check).awaitTermination(120)
        return sorted((r.cnpj, str(r.dt_comptc), float(r.vl_total)) for r in spark.read.parquet(newest(spark, table)).collect())

    head = "CNPJ_FUNDO;DT_COMPTC;ID_SUBCLASSE;VL_TOTAL\n"
    (src / "a.csv").write_text(head + "1;2026-09-01;s;1,5\n2;2026-09-01;s;2,5\n")
    first = run()
    assert first == [("00000000000001", "2026-09-01", 1.5), ("00000000000002", "2026-09-01", 2.5)]
    assert run() == first  # nothing new
    (src / "b.csv").write_text(head + "2;2026-09-01;s;9\n3;2026-09-02;s;4\n")
    assert run() == [first[0], ("00000000000002", "2026-09-01", 9.0), ("00000000000003", "2026-09-02", 4.0)]


def test_bars_of_a_stream_are_those_of_the_table(spark, tmp_path):
    start = datetime.datetime(2026, 1, 1)
    rows = [(k % 3, start + datetime.timedelta(hours=5 * k), k, float(k)) for k in range(60)]
    schema = "ticker long, ts timestamp, event_id long, value double"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "events"))
    stream = bars_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "events")))
    stream.writeStream.format("memory").queryName("bars_of_stream").outputMode("complete").trigger(availableNow=True).start().awaitTermination(120)
    got = {(r.ticker, r.day): (r.close, r.trades, r.volume) for r in spark.table("bars_of_stream").collect()}
    want = {}
    for t, ts, k, v in rows:
        c, n, s = want.get((t, ts.date()), (None, 0, 0.0))
        want[t, ts.date()] = (v, n + 1, s + v)
    assert got == want
