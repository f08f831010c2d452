"""Landing rows: months that are missing, upserts where the last write wins, scopes replaced whole, restated filings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def missing_months(landed: DataFrame, spans: DataFrame, keys: list[str], unpublished: DataFrame | None = None) -> DataFrame:
    """keys, period: months of ``spans`` (keys, since, until) without a row in ``landed`` (keys, period), less those known
    to be ``unpublished``. A span without an end or a beginning has no months."""
    every = spans.select(*keys, F.explode(F.sequence(F.trunc("since", "month"), F.trunc("until", "month"), F.expr("interval 1 month"))).alias("period"))
    out = every.join(landed.select(*keys, "period").distinct(), [*keys, "period"], "left_anti")
    return out if unpublished is None else out.join(unpublished, [*keys, "period"], "left_anti")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """``old`` with the rows of ``new``; of rows of one key the last of ``new`` by ``order`` counts. Rows with a null in
    their key are kept as they are. One aggregation by key, partial before the shuffle. (What is written again unchanged
    is found by ``changed``.)"""
    rest = [c for c in old.columns if c not in keys]
    known = F.lit(True)
    for k in keys:
        known = known & F.col(k).isNotNull()
    both = old.withColumn("_at", F.struct(F.lit(0).alias("new"), F.col(order).alias("by"))).unionByName(new.withColumn("_at", F.struct(F.lit(1).alias("new"), F.col(order).alias("by"))))
    last = both.filter(known).groupBy(*keys).agg(F.max_by(F.struct(*rest), "_at").alias("_row")).select(*keys, "_row.*")
    return last.unionByName(both.filter(~known).drop("_at")).select(*old.columns)


def replace_scoped(old: DataFrame, new: DataFrame, scope: list[str]) -> DataFrame:
    """``old`` with every scope that ``new`` has a row of replaced by the rows of ``new``; nulls count as a value."""
    a, b = old.alias("a"), new.select(*scope).distinct().alias("b")
    same: Column = F.lit(True)
    for c in scope:
        same = same & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    return a.join(b, same, "left_anti").unionByName(new)


def restatement_screen(filings: DataFrame, document: list[str], least: int = 3, rate: float = 20.0) -> DataFrame:
    """entity, n_docs, n_restated, rate_pct and types (of restated documents, comma-joined) of entities with at least
    ``least`` versions after a first one, and ``rate`` per cent of all."""
    docs = filings.groupBy("entity", "subclass", *document).agg(F.count("*").alias("n"))
    per = docs.groupBy("entity").agg(
        F.sum("n").alias("n_docs"),
        F.sum(F.col("n") - 1).alias("n_restated"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("n") > 1, F.col("subclass")))), ",").alias("types"),
    )
    return per.withColumn("rate_pct", 100.0 * F.col("n_restated") / F.col("n_docs")).filter((F.col("n_restated") >= least) & (F.col("rate_pct") >= rate))


def changed(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new`` that no row of ``old`` with their key equals in every other column (nulls equal nulls): those that
    an upsert has to write."""
    same: Column = F.lit(True)
    for c in new.columns:
        same = same & (F.col(f"n.{c}") == F.col(f"o.{c}") if c in keys else F.col(f"n.{c}").eqNullSafe(F.col(f"o.{c}")))
    return new.alias("n").join(old.select(*new.columns).alias("o"), same, "left_anti")


def load_verdict(loads: DataFrame, ratio: float = 0.5, least: int = 100, days: int = 30) -> DataFrame:
    """``loads`` (slice, at, fetched, rows, error) with the rows of the slice's last ok load of the ``days`` before, and a
    verdict: skipped (not published, or unchanged), error (an error; rows fetched but none kept; fewer than ``ratio`` of
    at least ``least`` rows before), or ok.

    Whether a load is ok depends on those before it, so a slice's loads are folded in order; a slice has a few loads a
    day."""
    fields = F.struct("at", "fetched", "rows", "error")
    per = loads.groupBy("slice").agg(F.sort_array(F.collect_list(fields)).alias("l"))

    def step(acc: Column, x: Column) -> Column:
        recent = F.when(acc["ok_at"] >= F.date_sub(x["at"], days), acc["ok_rows"])
        skipped = F.coalesce(x["error"].rlike("^(unchanged|not published)"), F.lit(False))
        failed = x["error"].isNotNull() | ((x["fetched"] > 0) & (x["rows"] == 0)) | F.coalesce((recent >= least) & (x["rows"] < recent * ratio), F.lit(False))
        status = F.when(skipped, "skipped").when(failed, "error").otherwise("ok")
        told = F.struct(x["at"].alias("at"), x["rows"].alias("rows"), recent.alias("previous"), status.alias("status"))
        ok = status == "ok"
        return F.struct(F.when(ok, x["at"]).otherwise(acc["ok_at"]).alias("ok_at"), F.when(ok, x["rows"]).otherwise(acc["ok_rows"]).alias("ok_rows"), F.concat(acc["out"], F.array(told)).alias("out"))

    start = F.expr("struct(cast(null as date) as ok_at, cast(null as bigint) as ok_rows, cast(array() as array<struct<at: date, rows: bigint, previous: bigint, status: string>>) as out)")
    folded = per.select("slice", F.explode(F.aggregate("l", start, step, lambda acc: acc["out"])).alias("x"))
    return folded.select("slice", "x.*")


def months_to_read(today: Column, lookback: int) -> Column:
    """The first days of the last ``lookback`` months up to a day, the oldest first."""
    return F.sequence(F.add_months(F.trunc(today, "month"), 1 - lookback), F.trunc(today, "month"), F.expr("interval 1 month"))


def sessions_to_fetch(known: DataFrame, have: DataFrame, keep: int, refresh: int, most: int) -> DataFrame:
    """session: of the newest ``keep`` known sessions, those without rows and the newest ``refresh`` in any case; the newest
    ``most`` of them."""
    window = known.select("session").distinct().orderBy(F.desc("session")).limit(keep)
    fresh = window.orderBy(F.desc("session")).limit(refresh)
    missing = window.join(have.select("session").distinct(), "session", "left_anti")
    return missing.union(fresh).distinct().orderBy(F.desc("session")).limit(most)
