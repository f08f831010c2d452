"""XML price reports, by Spark's own XML reader."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The element of one instrument, and its fields by path.
ROW = "PricRpt"
FIELDS: dict[str, str] = {
    "trade_date": "TradDt.Dt",
    "ticker": "SctyId.TckrSymb",
    "settlement": "FinInstrmAttrbts.AdjstdQt",
    "open_interest": "FinInstrmAttrbts.OpnIntrst",
    "volume": "FinInstrmAttrbts.NtlFinVol",
}


def _schema(paths: Sequence[str]) -> str:
    """A schema of text leaves for dotted paths."""
    tree: dict[str, dict] = {}
    for p in paths:
        node = tree
        for part in p.split("."):
            node = node.setdefault(part, {})
    told = lambda node: ", ".join(f"{k}: {'struct<' + told(v) + '>' if v else 'string'}" for k, v in node.items())
    return ", ".join(f"{k} {'struct<' + told(v) + '>' if v else 'string'}" for k, v in tree.items())


def read_report(spark: SparkSession, path: str, roots: Sequence[str] = (), row: str = ROW, fields: Mapping[str, str] = FIELDS) -> DataFrame:
    """One row per instrument of a report; of the given roots (leading letters of the ticker) only, if any. Namespaces are
    ignored; numbers that aren't filed are null; instruments without ticker or date are left out."""
    rows = spark.read.format("xml").option("rowTag", row).option("ignoreNamespace", "true").schema(_schema(list(fields.values()))).load(path)
    names = {"trade_date": "date", "ticker": "string"}
    out = rows.select(*[F.nullif(F.trim(F.col(p)), F.lit("")).try_cast(names.get(k, "decimal(28,8)")).alias(k) for k, p in fields.items()])
    if roots:
        out = out.filter(F.regexp_extract("ticker", "^([A-Z0-9]{3})", 1).isin(*roots))
    return out.dropna(subset=["trade_date", "ticker"])
