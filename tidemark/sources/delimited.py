"""Delimited text: files with lines before their header, and wide tables told long."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import text as T


class BadTable(ValueError):
    """A table without the columns that it should have."""


def header_of(spark: SparkSession, path: str, marks: Sequence[str], sep: str = ";", most: int = 20) -> list[str]:
    """The columns of the first of the ``most`` leading lines that holds all marks, without a byte-order mark."""
    for row in spark.read.text(path).limit(most).collect():
        names = [x.strip().strip('"').lstrip("\ufeff") for x in row["value"].split(sep)]
        if all(m in names for m in marks):
            return names
    raise BadTable(f"{path}: no header with {', '.join(marks)}")


def read_delimited(spark: SparkSession, path: str, marks: Sequence[str], sep: str = ";", encoding: str = "UTF-8") -> DataFrame:
    """A delimited file as text columns; lines before the header (found by ``marks``) and the header itself are left out,
    and so are lines with other numbers of fields. Quoted fields may hold the separator."""
    names = header_of(spark, path, marks, sep)
    schema = ", ".join([*[f"`{n}` string" for n in names], "_bad string"])
    rows = spark.read.csv(path, schema=schema, sep=sep, encoding=encoding, mode="PERMISSIVE", columnNameOfCorruptRecord="_bad")
    first = F.regexp_replace(F.trim(f"`{names[0]}`"), "\ufeff", "")
    return rows.filter(F.col("_bad").isNull() & ~first.eqNullSafe(F.lit(names[0]))).drop("_bad")


def wide_to_long(rows: DataFrame, date: str, tenors: Mapping[str, str], date_format: str = "MM/dd/yyyy") -> DataFrame:
    """series_id, observation_date, value: a row per date and tenor that holds a number. Columns that no tenor names raise
    (layouts change over time; what is unknown isn't skipped in silence)."""
    strange = [c for c in rows.columns if c != date and c not in tenors]
    if date not in rows.columns or strange:
        raise BadTable(f"unknown columns {', '.join(strange) or 'without ' + date}")
    columns = [c for c in rows.columns if c != date]
    own = rows.select(F.try_to_timestamp(F.trim(date), F.lit(date_format)).cast("date").alias("observation_date"), *[F.col(f"`{c}`").alias(tenors[c]) for c in columns])
    long = own.unpivot(["observation_date"], [tenors[c] for c in columns], "series_id", "value")
    return long.withColumn("value", T.to_decimal("value")).dropna()


def long_facts(rows: DataFrame, keys: Sequence[str], metrics: Mapping[str, str]) -> DataFrame:
    """Records told as facts: the keys, metric and value (a number with decimal comma or point), one row per record and
    metric that holds a number. metrics: source column -> metric."""
    own = rows.select(*keys, *[F.col(f"`{c}`").cast("string").alias(m) for c, m in metrics.items()])
    return own.unpivot(list(keys), list(metrics.values()), "metric", "value").withColumn("value", T.to_decimal("value")).dropna(subset=["value"])


def labelled_values(pages: DataFrame, text: str, labels: Mapping[str, str]) -> DataFrame:
    """``pages`` with a column per label: what stands between the label and the end of its line or element, tags and blanks
    around it left out; null where the label isn't found or nothing follows."""
    from re import escape

    value = lambda mark: F.trim(F.regexp_extract(text, rf"(?i){escape(mark)}\s*+:?+\s*+(?:<[^>]*>\s*)*+([^<\r\n]+)", 1))
    return pages.withColumns({name: F.nullif(value(mark), F.lit("")) for name, mark in labels.items()})
