"""Company statements: versions, points in time, spans, and items pivoted out of account rows by code, label or parent.

An account row: company, doc, statement, scope, ref (date), start, end, version, code, label, value.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.core import safe_div

KEYS = ("company", "doc", "scope", "ref")
#: Spans of a period, in months, and their names.
PERIOD_KINDS = {3: "quarter", 6: "ytd", 9: "ytd", 12: "annual"}


def newest_versions(rows: DataFrame, by: Sequence[str], version: str = "version") -> DataFrame:
    """The rows of the highest version of each document (``by``): all of its rows, not one."""
    top = rows.groupBy(*by).agg(F.max(version).alias("_top"))
    same: Column = F.lit(True)
    for c in by:
        same = same & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    return rows.alias("a").join(top.alias("b"), same & (F.col(f"a.{version}") == F.col("b._top"))).select("a.*")


def received_before(rows: DataFrame, filings: DataFrame, by: Sequence[str], as_of: Column) -> DataFrame:
    """Rows of documents that had been received before a date; rows without a filing don't count as known."""
    known = filings.filter(F.col("received") < as_of).select(*by).distinct()
    return rows.join(known, list(by), "left_semi")


def span_months(start: str = "start", end: str = "end") -> Column:
    """Whole months from the first day to the day after the last; null where either is."""
    return F.floor(F.months_between(F.date_add(F.col(end), 1), F.col(start))).cast("int")


def period_kind(months: str = "months") -> Column:
    out = F.lit(None).cast("string")
    for n, name in PERIOD_KINDS.items():
        out = F.when(F.col(months) == n, name).otherwise(out)
    return out


def parent_code(code: str = "code") -> Column:
    """An account code without its last segment; null for a top-level account."""
    return F.when(F.instr(code, ".") > 0, F.regexp_replace(code, r"\.[^.]*$", ""))


def with_parent_label(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """Adds ``parent``: the label of the account whose code is this one's without its last segment, in the same document
    (nulls in ``by`` match nulls); of several such rows the smallest label."""
    parents = rows.groupBy(*by, F.col("code").alias("_code")).agg(F.min("label").alias("parent"))
    same = parent_code("a.code") == F.col("b._code")
    for c in by:
        same = same & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    return rows.alias("a").join(parents.alias("b"), same, "left").select("a.*", "b.parent")


def pivot_items(rows: DataFrame, by: Sequence[str], items: Mapping[str, Column]) -> DataFrame:
    """One row per document with, for each item, the largest value of the rows that its condition names (never a sum: one
    item is filed under several synonyms)."""
    return rows.groupBy(*by).agg(*[F.max(F.when(where, F.col("value"))).alias(name) for name, where in items.items()])


def chart(kinds: Mapping[str, Column]) -> Column:
    """The first kind of which any row of the group has the mark."""
    out: Column | None = None
    for name, mark in kinds.items():
        out = F.when(F.bool_or(mark), name) if out is None else out.when(F.bool_or(mark), name)
    return out if out is not None else F.lit(None).cast("string")


def headline(income: DataFrame, balance: DataFrame, by: Sequence[str]) -> DataFrame:
    """Income beside the balance of the same document and version, with net margin and return on equity in per cent; both
    only over positive denominators."""
    same: Column = F.lit(True)
    for c in by:
        same = same & F.col(f"i.{c}").eqNullSafe(F.col(f"b.{c}"))
    more = [c for c in balance.columns if c not in by]
    out = income.alias("i").join(balance.alias("b"), same, "left").select("i.*", *[F.col(f"b.{c}") for c in more])
    ratio = lambda c: F.when(F.col(c) > 0, F.round(100 * safe_div("net_income", c), 2))
    return out.withColumns({"net_margin_pct": ratio("revenue"), "roe_pct": ratio("equity")})
