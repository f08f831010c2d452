"""Building blocks with the warehouse's semantics: nulls stay null, null order is spelled out, ties are broken."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Name = str | Column


def as_column(c: Name) -> Column:
    return F.col(c) if isinstance(c, str) else c


def safe_div(a: Name, b: Name) -> Column:
    """a / b as double; null where b is 0 or either is null."""
    return as_column(a).cast("double") / F.nullif(as_column(b).cast("double"), F.lit(0.0))


def latest_by(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in the given order (all of DISTINCT ON). The order should break every tie."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def exact(c: Name, scale: int = 2) -> Column:
    """A money column as decimal, so that sums don't depend on the order of rows."""
    return as_column(c).cast(f"decimal(18,{scale})")


def total(c: Name, scale: int = 2) -> Column:
    """An exact sum, told as double."""
    return F.sum(exact(c, scale)).cast("double")


def weighted(value: Name, weight: Name) -> Column:
    """Mean weighted by a quantity, from exact sums and to nine digits; null where the weights sum to 0."""
    product = as_column(weight).cast("decimal(18,2)") * as_column(value).cast("decimal(18,6)")
    return F.round(safe_div(F.sum(product), F.sum(F.when(as_column(value).isNotNull(), as_column(weight).cast("decimal(18,2)")))), 9)


def pct_cont(c: Name, p: float) -> Column:
    """Linear-interpolated percentile."""
    return F.percentile(as_column(c), F.lit(p))


def compound(rate: Name) -> Column:
    """Aggregate of 1 + rate over rows, less 1: exp(sum(ln)). Rates below -0.99 count as -0.99, nulls as 0."""
    return F.exp(F.sum(F.log1p(F.greatest(F.coalesce(as_column(rate), F.lit(0.0)), F.lit(-0.99))))) - 1


def month(c: Name) -> Column:
    """First day of the month."""
    return F.trunc(as_column(c).cast("date"), "MM")


def months_mod_12(later: Name, earlier: Name) -> Column:
    """The months part of an age: whole months between two dates, modulo 12."""
    return (F.floor(F.months_between(as_column(later), as_column(earlier))) % 12).cast("int")


def unpivot(df: DataFrame, ids: Sequence[str], values: Sequence[str], name: str = "metric", value: str = "value") -> DataFrame:
    """Wide to long, one row per id and column, nulls kept."""
    return df.unpivot(list(ids), list(values), name, value)


def share_of_total(df: DataFrame, value: str, into: str, by: Sequence[str] = ()) -> DataFrame:
    """Adds value / sum(value), over all rows or per group. The total is aggregated apart (partial sums), never a window
    over all rows in one task."""
    if by:
        totals = df.groupBy(*by).agg(total(value).alias("_total"))
        return df.join(totals, list(by)).withColumn(into, safe_div(value, "_total")).drop("_total")
    totals = df.agg(total(value).alias("_total"))
    return df.crossJoin(F.broadcast(totals)).withColumn(into, safe_div(value, "_total")).drop("_total")  # one row


def rank_top(df: DataFrame, by: str, n: int, into: str = "rank", within: Sequence[str] = ()) -> DataFrame:
    """RANK by a column, largest first and nulls last; rows of rank n or less, ties kept.

    Over all rows, the n largest are found by a distributed top-n first, and only rows with one of their values are
    ranked: the unpartitioned window sees about n rows.
    """
    order = F.col(by).desc_nulls_last()
    if within:
        return df.withColumn(into, F.rank().over(Window.partitionBy(*within).orderBy(order))).filter(F.col(into) <= n)
    held = df.select(by).orderBy(order).limit(n).distinct().withColumnRenamed(by, "_held")
    kept = df.join(F.broadcast(held), F.col(by).eqNullSafe(F.col("_held")), "left_semi")  # at most n values
    return kept.withColumn(into, F.rank().over(Window.orderBy(order))).filter(F.col(into) <= n)


def keyset_after(df: DataFrame, keys: Sequence[str], after: Sequence | None, limit: int) -> DataFrame:
    """A page of rows whose keys come after a cursor, in key order. Values of the cursor are cast to the keys' types."""
    if after is not None:
        left = F.struct(*[F.col(k) for k in keys])
        right = F.struct(*[F.lit(v).cast(df.schema[k].dataType).alias(k) for k, v in zip(keys, after, strict=True)])
        df = df.filter(left > right)
    return df.orderBy(*keys).limit(limit)


def months_between_dates(df: DataFrame, start: str, end: str, into: str = "period") -> DataFrame:
    """A row per month from start to end, inclusive."""
    return df.withColumn(into, F.explode(F.sequence(month(start), month(end), F.expr("interval 1 month"))))


def listing(values: Iterable[Column], sep: str = "|") -> Column:
    """Concatenation that is null if any part is."""
    out: list[Column] = []
    for v in values:
        if out:
            out.append(F.lit(sep))
        out.append(v)
    return F.concat(*out)
