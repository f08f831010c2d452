"""The long panel (id, day, metric, value), its pivot and its reducers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.core import latest_by, month, unpivot
from tidemark.functions.ranges import joined_by, percentiles

DESCRIBED = ("n", "null_rate", "mean", "sd", "min", "p50", "max")


def long(rows: DataFrame, ids: str, day: str, metrics: Sequence[str], source: str) -> DataFrame:
    """id, day, metric, value, source; values that are null aren't observations and drop out."""
    flat = rows.select(F.col(ids).cast("string").alias("id"), F.col(day).alias("day"), *[F.col(m).cast("double").alias(m) for m in metrics])
    return unpivot(flat, ["id", "day"], metrics).filter("value is not null").withColumn("source", F.lit(source))


def monthly(panel: DataFrame) -> DataFrame:
    """The last observation of each id, metric and month."""
    own = panel.withColumn("period", month("day"))
    return latest_by(own, ["id", "metric", "source", "period"], [F.col("day").desc(), F.col("value").desc()])


def wide(panel: DataFrame, metrics: Sequence[str], day: str = "day") -> DataFrame:
    """A row per id and day, a column per metric (null where not observed)."""
    return panel.groupBy("id", day).pivot("metric", list(metrics)).agg(F.first("value"))


def describe(rows: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """A row per column: n, null_rate, mean, sample deviation, extremes, and the median by ranges of values."""
    flat = unpivot(rows.select(*[F.col(m).cast("double").alias(m) for m in metrics]), [], metrics)
    v = F.col("value")
    out = flat.groupBy("metric").agg(F.count(v).alias("n"), (1 - F.count(v) / F.count("*")).alias("null_rate"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("sd"), F.min(v).alias("min"), F.max(v).alias("max"))
    return joined_by(out, percentiles(flat, ["metric"], "value", {"p50": 0.5}), ["metric"])


def correlations(rows: DataFrame, metrics: Sequence[str], least: int = 3) -> DataFrame:
    """A row per pair of columns: Pearson's r over rows where both are there; null below ``least`` rows or without variance.
    All pairs are aggregates of one pass."""
    pairs = [(a, b) for i, a in enumerate(metrics) for b in metrics[i + 1 :]]
    aggs = []
    for a, b in pairs:
        both = F.col(a).isNotNull() & F.col(b).isNotNull()
        x, y = F.when(both, F.col(a).cast("double")), F.when(both, F.col(b).cast("double"))
        sound = (F.count(x) >= least) & (F.min(x) < F.max(x)) & (F.min(y) < F.max(y))
        aggs.append(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.count(x).alias("n"), F.when(sound, F.corr(x, y)).alias("r")).alias(f"{a}|{b}"))
    one = rows.agg(*aggs)
    return one.select(F.explode(F.array(*[F.col(f"`{a}|{b}`") for a, b in pairs])).alias("x")).select("x.*")


def ranks(rows: DataFrame, metric: str, within: Sequence[str]) -> DataFrame:
    """Rank within a day, largest first, nulls without rank."""
    order = Window.partitionBy(*within).orderBy(F.col(metric).desc_nulls_last())
    return rows.withColumn("rank", F.when(F.col(metric).isNotNull(), F.rank().over(order)))


def spread(rows: DataFrame, first: str, second: str) -> DataFrame:
    return rows.withColumn("spread", F.col(first) - F.col(second))


def asof(sessions: DataFrame, frame: DataFrame, key: str, day: str, columns: Sequence[str], most_sessions: int) -> DataFrame:
    """Each session with the latest row of ``frame`` at or before it; values older than ``most_sessions`` sessions drop to
    null. One window over both tables together, partitioned by key: no range join."""
    obs = frame.select(key, F.col(day).alias("_at"), F.lit(0).alias("_kind"), F.struct(F.col(day).alias("obs_day"), *columns).alias("_obs"))
    own = sessions.select("*", F.col(day).alias("_at"), F.lit(1).alias("_kind"))
    w = Window.partitionBy(key).orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    both = own.unionByName(obs, allowMissingColumns=True).withColumn("_n", F.sum("_kind").over(w))
    # a session's number is compared with how many sessions had passed when the observation came
    both = both.withColumn("_held", F.last(F.when(F.col("_kind") == 0, F.struct("_n", "_obs")), ignorenulls=True).over(w)).filter("_kind = 1")
    age = F.col("_n") - F.col("_held._n") - 1
    fresh = age <= most_sessions
    return both.select(*sessions.columns, *[F.when(fresh, F.col(f"_held._obs.{c}")).alias(c) for c in ("obs_day", *columns)])


def features(bars: DataFrame, key: str, day: str, value: str, lags: Sequence[int], windows: Sequence[int]) -> DataFrame:
    """Momentum over each lag and deviation of returns over each window, only where the window is full."""
    w = Window.partitionBy(key).orderBy(day)
    v = F.col(value)
    out = bars.withColumn("_ret", F.when(F.lag(v).over(w) > 0, v / F.lag(v).over(w) - 1))
    for n in lags:
        out = out.withColumn(f"mom_{n}", F.when(F.lag(v, n).over(w) > 0, v / F.lag(v, n).over(w) - 1))
    for n in windows:
        rolling = w.rowsBetween(-(n - 1), 0)
        out = out.withColumn(f"vol_{n}", F.when(F.count("_ret").over(rolling) == n, F.stddev_samp("_ret").over(rolling)))
    return out.drop("_ret")


def rolling_correlation(a: DataFrame, b: DataFrame, day: str, x: str, y: str, n: int, by: Sequence[str] = ()) -> DataFrame:
    """Correlation of two columns over the last ``n`` days that both have; null before."""
    both = a.select(*by, day, x).join(b.select(*by, day, y), [*by, day])
    w = Window.partitionBy(*by).orderBy(day).rowsBetween(-(n - 1), 0)
    return both.withColumn("corr", F.when(F.count("*").over(w) == n, F.corr(x, y).over(w)))


def ridge(rows: DataFrame, target: str, features_: Sequence[str], alpha: float) -> DataFrame:
    """feature, coefficient of a ridge regression on centred columns. Products are summed where rows stand; one row, as wide as
    the list of features, is solved in a task."""
    import numpy as np
    import pandas as pd

    names = [*features_, target]
    means = rows.agg(*[F.avg(c).alias(f"_{c}") for c in names])
    centred = rows.crossJoin(F.broadcast(means)).select(*[(F.col(c) - F.col(f"_{c}")).alias(c) for c in names])  # one row
    sums = centred.agg(*[F.sum(F.col(a) * F.col(b)).alias(f"s{i}_{j}") for i, a in enumerate(names) for j, b in enumerate(names) if i <= j])
    k = len(features_)

    def solve(it):
        for batch in it:
            for row in batch.to_dict("records"):
                gram = np.array([[row[f"s{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)], float)
                found = np.linalg.solve(gram + alpha * np.eye(k), np.array([row[f"s{i}_{k}"] for i in range(k)], float))
                yield pd.DataFrame({"feature": list(features_), "coefficient": found})

    return sums.mapInPandas(solve, "feature string, coefficient double")


def block_bootstrap(rows: DataFrame, by: str, day: str, value: str, block: int, draws: int, seed: int = 0, level: float = 0.95) -> DataFrame:
    """Mean of each group's series with a moving-block bootstrap interval. A group's series (one number a day) is one task's."""
    import numpy as np
    import pandas as pd

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values(day)[value].dropna().to_numpy(float)
        if not len(x):
            return pd.DataFrame([(pdf[by].iloc[0], 0, None, None, None)], columns=[by, "n", "mean", "low", "high"])
        size = min(block, len(x))
        g = np.random.default_rng(seed)
        starts = g.integers(0, len(x) - size + 1, (draws, -(-len(x) // size)))
        means = x[(starts[:, :, None] + np.arange(size)).reshape(draws, -1)[:, : len(x)]].mean(axis=1)
        low, high = np.quantile(means, [(1 - level) / 2, (1 + level) / 2])
        return pd.DataFrame([(pdf[by].iloc[0], len(x), x.mean(), low, high)], columns=[by, "n", "mean", "low", "high"])

    kind = rows.schema[by].dataType.simpleString()
    return rows.select(by, day, value).groupBy(by).applyInPandas(one, f"{by} {kind}, n long, mean double, low double, high double")
