"""Fixed-width files: the quotes tape and reference curves. Lines are cut in the JVM; no row goes through Python."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The tape's record length and its fields as first and last position, kind; prices have two implied decimals.
QUOTE_LENGTH = 245
QUOTES: dict[str, tuple[int, int, str]] = {
    "trade_date": (3, 10, "date"),
    "codbdi": (11, 12, "text"),
    "codneg": (13, 24, "text"),
    "tpmerc": (25, 27, "text"),
    "nome_resumido": (28, 39, "text"),
    "especi": (40, 49, "text"),
    "prazot": (50, 52, "text"),
    "moeda": (53, 56, "text"),
    "preco_abertura": (57, 69, "price"),
    "preco_maximo": (70, 82, "price"),
    "preco_minimo": (83, 95, "price"),
    "preco_medio": (96, 108, "price"),
    "preco_fechamento": (109, 121, "price"),
    "oferta_compra": (122, 134, "price"),
    "oferta_venda": (135, 147, "price"),
    "negocios": (148, 152, "int"),
    "quantidade": (153, 170, "int"),
    "volume": (171, 188, "price"),
    "preco_exercicio": (189, 201, "price"),
    "data_vencimento": (203, 210, "date"),
    "fator_cotacao": (211, 217, "int"),
    "isin": (231, 242, "text"),
}
#: A date that stands for no expiry; the curve file's line length and its fields.
NO_EXPIRY, CURVE_LENGTH = "99991231", 72
CURVES: dict[str, tuple[int, int, str]] = {
    "trade_date": (12, 19, "date"),
    "curve": (22, 26, "text"),
    "curve_desc": (27, 41, "text"),
    "calendar_days": (42, 46, "int"),
    "business_days": (47, 51, "int"),
    "sign": (52, 52, "text"),
    "magnitude": (53, 66, "int"),
    "vertex_type": (67, 67, "text"),
    "vertex_code": (68, 72, "text"),
}


class BadLayout(ValueError):
    """A file isn't in its documented layout."""


def field(line: Column, first: int, last: int, kind: str) -> Column:
    """One field of a line; null where it is blank or unreadable, never a guess."""
    raw = F.trim(F.substring(line, first, last - first + 1))
    held = F.when(raw != "", raw)
    number = F.when(held.rlike("^[0-9]+$"), held)
    if kind == "price":
        return (number.cast("decimal(20,0)") / 100).cast("decimal(20,2)")
    if kind == "int":
        return number.try_cast("bigint")
    if kind == "date":
        return F.when((held != NO_EXPIRY) & held.rlike("^[0-9]{8}$"), F.try_to_timestamp(held, F.lit("yyyyMMdd")).cast("date"))
    return held


def cut(lines: DataFrame, layout: dict[str, tuple[int, int, str]]) -> DataFrame:
    return lines.select(*[field(F.col("value"), *where).alias(name) for name, where in layout.items()])


def quotes(lines: DataFrame) -> DataFrame:
    """Quotes from the tape's lines (``value``): records 01 of full length with code, date, market, board and a readable
    close; everything else is left out. An empty term is part of the key, and stays empty."""
    own = lines.filter((F.length("value") >= QUOTE_LENGTH) & F.startswith("value", F.lit("01")))
    out = cut(own, QUOTES).withColumn("prazot", F.coalesce("prazot", F.lit("")))
    return out.dropna(subset=["codneg", "trade_date", "tpmerc", "codbdi", "preco_fechamento"])


def read_quotes(spark: SparkSession, path: str) -> DataFrame:
    return quotes(spark.read.option("encoding", "ISO-8859-1").option("charset", "ISO-8859-1").text(path))


def curves(lines: DataFrame, session: str, wanted: tuple[str, ...]) -> DataFrame:
    """Vertices of the wanted curves on a session. Lines of another length, dates other than the session's, unreadable
    numbers or signs, and repeated vertices raise; implausible vertices (no days, more business than calendar days, rates
    of 1000 per cent or more, unknown types) are left out."""
    own = lines.filter(F.trim("value") != "")
    parts = own.select(F.length("value").alias("_length"), *[field(F.col("value"), *where).alias(name) for name, where in CURVES.items()])
    parts = parts.filter((F.col("_length") != CURVE_LENGTH) | F.col("curve").isin(*wanted))
    known = F.col("trade_date").isNotNull() & F.col("calendar_days").isNotNull() & F.col("business_days").isNotNull() & F.col("magnitude").isNotNull() & F.col("sign").isin("+", "-")
    checks = parts.agg(
        F.count_if(F.col("_length") != CURVE_LENGTH).alias("length"),
        F.count_if((F.col("_length") == CURVE_LENGTH) & ~F.coalesce(known, F.lit(False))).alias("unreadable"),
        F.count_if(F.col("trade_date") != F.lit(session).cast("date")).alias("dated"),
        (F.count("curve") - F.countDistinct("curve", "calendar_days")).alias("repeated"),
        F.count("*").alias("lines"),
    ).first()
    if not checks["lines"] or any(checks[c] for c in ("length", "unreadable", "dated", "repeated")):
        raise BadLayout(f"curves of {session}: {checks.asDict()}")
    rate = (F.col("magnitude").cast("decimal(20,0)") / 10_000_000).cast("decimal(20,7)")
    out = parts.withColumn("rate", F.when(F.col("sign") == "-", -rate).otherwise(rate))
    sound = (F.col("calendar_days") > 0) & (F.col("business_days") <= F.col("calendar_days")) & (F.abs("rate") < 1000) & F.col("vertex_type").isin("F", "M")
    return out.filter(sound).drop("_length", "sign", "magnitude")


def read_curves(spark: SparkSession, path: str, session: str, wanted: tuple[str, ...]) -> DataFrame:
    return curves(spark.read.text(path), session, wanted)
