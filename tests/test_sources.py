import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tidemark import sources as S
from tidemark.functions import text as T
from tidemark.sources import delimited, fixed


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "v string").select(f("v").alias("x")).first().x


@pytest.mark.parametrize(
    ("f", "value", "want"),
    [
        (T.to_int, "1.234", 1234),
        (T.to_int, "1.234,9", 1234),
        (T.to_int, "x", None),
        (T.to_decimal, "R$ 1.234,56", Decimal("1234.56")),
        (T.to_decimal, "-0,5", Decimal("-0.5")),
        (T.to_decimal, "12.5", Decimal("12.5")),
        (T.to_decimal, "N/A", None),
        (T.is_active, "CANCELADA", False),
        (T.is_active, " Em funcionamento normal", True),
        (T.is_active, "", None),
        (T.is_active, None, None),
        (T.to_bool, "Sim", True),
        (T.to_bool, "no", False),
        (T.to_bool, "-", None),
        (T.to_date, "2026-09-01", datetime.date(2026, 9, 1)),
        (T.to_date, "01/09/2026", datetime.date(2026, 9, 1)),
        (T.to_date, "20260901", datetime.date(2026, 9, 1)),
        (T.to_date, "01/09/26", datetime.date(2026, 9, 1)),
        (T.to_date, "2026-13-01", None),
        (T.company_number, "1.234/5-6", "00000000123456"),
        (T.company_code, "001023", "1023"),
        (T.company_code, "000", None),
        (T.company_number_ok, "11.222.333/0001-81", True),
        (T.company_number_ok, "11.222.333/0001-82", False),
        (T.name_norm, "  ÁGUA  Çã  ", "agua ca"),
        (T.clean, "NÃO INFORMADO", None),
    ],
)
def test_values_from_text(spark, f, value, want):
    assert one(spark, value, f) == want


def test_row_hash_and_similarity(spark):
    df = spark.createDataFrame([("x", None), ("x", "")], "b string, a string")
    assert df.select(T.row_hash(["b", "a"]).alias("h")).distinct().count() == 1
    pair = spark.createDataFrame([("abc def", "abc deg")], "p string, q string")
    got = pair.select(T.similarity(T.trigrams("p"), T.trigrams("q")).alias("s")).first().s
    assert abs(got - 6 / 10) < 1e-9


def test_field_maps(spark):
    rows = spark.createDataFrame([("11.222.333/0001-81", "", "2026-09-01", "1.000,50", "3", "left"), (None, "22", "x", "NULL", None, None)], "`CNPJ_FUNDO_CLASSE` string, `CNPJ_FUNDO` string, ` DT_COMPTC` string, VL_TOTAL string, NR_COTST string, OTHER string")
    fields = {k: v for k, v in S.by_rule("fi_diario", rows.columns).items() if k != "other"}
    assert fields["vl_total"].type == "numeric" and fields["nr_cotst"].type == "int" and fields["dt_comptc"].type == "date"
    a, b = S.mapped(rows, fields, "fi_diario", ["cnpj"]).collect()
    assert (a.cnpj, a.dt_comptc, a.vl_total, a.nr_cotst, a.id_subclasse) == ("11222333000181", datetime.date(2026, 9, 1), Decimal("1000.5"), 3, None)
    assert a.raw == {"CNPJ_FUNDO": "", "OTHER": "left"}
    assert (b.cnpj, b.dt_comptc, b.vl_total) == ("00000000000022", None, None) and b.raw == {"CNPJ_FUNDO_CLASSE": None, "VL_TOTAL": "NULL", "NR_COTST": None, "OTHER": None}
    with pytest.raises(S.SourceChanged):
        S.mapped(rows.select("OTHER"), fields, "fi_diario", ["cnpj"])
    assert S.coverage(["cnpj_fundo"], fields)[0] == ["cnpj"]


def test_maps_of_recreated_headers():
    aging = S.by_rule("fidc_aging", ["CNPJ_FUNDO_CLASSE", "DT_COMPTC"])
    assert len(aging) == 23 and aging["vl_prazo_maior_1080"].candidates == ("TAB_VI_A10_VL_PRAZO_VENC_MAIOR_1080", "TAB_VI_A_VL_10", "TAB_VI_VL_PRAZO_MAIS_1080")
    assert aging["vl_inad_360"].candidates == ("TAB_VI_B7_VL_INAD_360", "TAB_VI_B_VL_7", "TAB_VI_VL_INAD_181_360")
    assert len(S.by_rule("fidc_scr", [])) == 21 and len(S.by_rule("securit_fluxo", [])) == 16
    old = S.by_rule("fund_registry", ["CNPJ_FUNDO", "DENOM_SOCIAL", "SIT", "ADMIN", "Extra_Coluna"])
    assert S.coverage(["CNPJ_Fundo", "Denominacao_Social", "Situacao", "Administrador"], old)[0] == ["cnpj", "fund_name", "status", "admin_name"]
    assert old["extra_coluna"].candidates == ("Extra_Coluna",) and S.by_rule("fii_complemento", [])["pct_dividend_yield_mes"].type == "pct"


def test_a_poor_fit_warns(spark):
    fields = {"a": S.Field(("A",)), "b": S.Field(("B",)), "c": S.Field(("C",))}
    with pytest.warns(UserWarning, match="only 1 of 3"):
        S.mapped(spark.createDataFrame([("1",)], "A string"), fields, "x")


def test_tab_columns_by_rule():
    fields = S.by_rule("fidc_setor", ["CNPJ_FUNDO", "DT_COMPTC", "TAB_II_A_VL_INDUST", "TAB_II_VL_CARTEIRA", "TAB_X_PR_GARANTIA_DIRCRED"])
    assert {"vl_a_indust", "vl_carteira", "pr_garantia_dircred"} < set(fields) and fields["vl_carteira"].type == "numeric"


def quote(**own):
    line = list(" " * 245)
    values = {"codneg": "PETR4", "trade_date": "20260901", "tpmerc": "010", "codbdi": "02", "preco_fechamento": "0000000001234", "data_vencimento": "99991231", "negocios": "00012"} | own
    line[:2] = "01"
    for k, v in values.items():
        first, last, _ = fixed.QUOTES[k]
        line[first - 1 : first - 1 + len(v)] = v
    return "".join(line)


def test_quotes_tape(spark, tmp_path):
    (tmp_path / "t.txt").write_text("\n".join(["00HEADER", quote(), quote(preco_fechamento="00000000 1234"), quote(codneg="     "), quote()[:200], "99TRAILER", quote(prazot="030", isin="BRPETRACNPR6")]), encoding="latin-1")
    a, b = sorted(S.read_quotes(spark, str(tmp_path / "t.txt")).collect(), key=lambda r: r.prazot)
    assert (a.codneg, a.trade_date, a.preco_fechamento, a.negocios, a.data_vencimento, a.prazot, a.preco_abertura) == ("PETR4", datetime.date(2026, 9, 1), Decimal("12.34"), 12, None, "", None)
    assert (b.prazot, b.isin) == ("030", "BRPETRACNPR6")


def vertex(curve="PRE", day="20260925", days=30, business=21, sign="+", rate=149000000, kind="F"):
    return f"{'000001':<11}{day}{'T1'}{curve:<5}{'DIxPRE':<15}{days:05d}{business:05d}{sign}{rate:014d}{kind}{days:05d}"


def test_reference_curves(spark, tmp_path):
    path = str(tmp_path / "c.txt")
    write = lambda *lines: (tmp_path / "c.txt").write_text("\n".join(lines))
    write(vertex(), vertex(days=60, business=41, sign="-"), vertex(curve="XXX"), vertex(days=90, business=99), vertex(days=91, kind="Z"), "")
    rows = sorted(S.read_curves(spark, path, "2026-09-25", ("PRE",)).collect(), key=lambda r: r.calendar_days)
    assert [(r.calendar_days, r.rate) for r in rows] == [(30, Decimal("14.9")), (60, Decimal("-14.9"))]
    for broken in ([vertex()[:70]], [vertex(), vertex()], [vertex(day="20260924")], [vertex(sign="?")], [""]):
        write(*broken)
        with pytest.raises(fixed.BadLayout):
            S.read_curves(spark, path, "2026-09-25", ("PRE",))


def test_preamble_and_wide(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Report of the day\n﻿RptDt;TckrSymb;MinPric\n2026-09-29;\"A;B\";1,5\n2026-09-29;C11;\nbroken;line\n", encoding="utf-8")
    rows = S.read_delimited(spark, str(tmp_path / "a.csv"), ["RptDt", "TckrSymb"]).collect()
    assert [(r.RptDt, r.TckrSymb, r.MinPric) for r in rows] == [("2026-09-29", "A;B", "1,5"), ("2026-09-29", "C11", None)]
    wide = spark.createDataFrame([("09/01/2026", "4.1", ""), ("09/02/2026", "4.2", "4.9")], "Date string, `1 Mo` string, `10 Yr` string")
    got = sorted(tuple(r) for r in S.wide_to_long(wide, "Date", {"1 Mo": "m1", "10 Yr": "y10"}).select("observation_date", "series_id", F.col("value").cast("double")).collect())
    assert got == [(datetime.date(2026, 9, 1), "m1", 4.1), (datetime.date(2026, 9, 2), "m1", 4.2), (datetime.date(2026, 9, 2), "y10", 4.9)]
    with pytest.raises(delimited.BadTable):
        S.wide_to_long(wide, "Date", {"1 Mo": "m1"})
    with pytest.raises(delimited.BadTable):
        S.read_delimited(spark, str(tmp_path / "a.csv"), ["Nothing"])


def test_price_report(spark, tmp_path):
    one = lambda t, a: f'<PricRpt><TradDt><Dt>2018-01-02</Dt></TradDt><SctyId><TckrSymb>{t}</TckrSymb></SctyId><FinInstrmAttrbts><AdjstdQt Ccy="BRL">{a}</AdjstdQt></FinInstrmAttrbts></PricRpt>'
    (tmp_path / "r.xml").write_text(f'<?xml version="1.0"?><Document xmlns="urn:x"><PricRptg>{one("DI1F19", "99.5")}{one("DOLG18", "3.2")}{one("", "1")}</PricRptg></Document>')
    rows = S.read_report(spark, str(tmp_path / "r.xml"), roots=("DI1",)).collect()
    assert [(r.ticker, float(r.settlement), r.open_interest, r.trade_date) for r in rows] == [("DI1F19", 99.5, None, datetime.date(2018, 1, 2))]
    assert S.read_report(spark, str(tmp_path / "r.xml")).count() == 2


def test_records_as_facts_and_labelled_values(spark):
    rows = spark.createDataFrame([("AB", "1.234,5", ""), ("CD", None, "7")], "code string, Min string, Max string")
    got = sorted((r.code, r.metric, float(r.value)) for r in S.long_facts(rows, ["code"], {"Min": "low", "Max": "high"}).collect())
    assert got == [("AB", "low", 1234.5), ("CD", "high", 7.0)]
    page = spark.createDataFrame([("<td>Emissor:</td><td> <b>ACME SA</b></td><p>Taxa 7,5 %</p><td>Data:</td>",)], "html string")
    r = S.labelled_values(page, "html", {"issuer": "Emissor", "rate": "taxa", "day": "Data", "none": "Nada"}).first()
    assert (r.issuer, r.rate, r.day, r.none) == ("ACME SA", "7,5 %", None, None)
