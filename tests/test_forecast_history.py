import datetime

import numpy as np
import pytest

from tidemark.functions import guards
from tidemark.operators import forecast, history


def series(n=900, seed=1):
    g = np.random.default_rng(seed)
    x = g.normal(size=(n, 2))
    y = (x[:, 0] + 0.3 * g.normal(size=n) > 0).astype(float)
    days = [datetime.date(2020, 1, 1) + datetime.timedelta(days=i) for i in range(n)]
    return [("a", d, float(a), float(b), float(v)) for d, (a, b), v in zip(days, x, y, strict=True)]


SCHEMA = "k string, day date, x double, z double, label double"


def test_walk_forward_beats_climatology_and_never_looks_ahead(spark):
    rows = series()
    told = lambda r: {x.day: x for x in forecast.walk_forward(spark.createDataFrame(r, SCHEMA), "k", "day", ["x", "z"], "label", 2, 2021, horizon=3).collect()}
    got = told(rows)
    assert min(got) == datetime.date(2021, 1, 1) and len(got) == 900 - 366
    loss = lambda c: -np.mean([np.log(getattr(x, c)[x.label]) for x in got.values()])
    assert loss("p") < 0.5 * loss("clim")
    assert all(abs(sum(x.p) - 1) < 1e-9 for x in got.values())
    other = told([r if r[1] < datetime.date(2021, 6, 1) else (*r[:4], 1 - r[4]) for r in rows])
    assert all(np.allclose(got[d].p, other[d].p) for d in got if d.year == 2021)
    assert not all(np.allclose(got[d].p, other[d].p) for d in got if d.year == 2022)


def test_walk_forward_without_enough_rows(spark):
    short = [("a", datetime.date(2021, 1, 1), 1.0, None, None), ("b", datetime.date(2021, 1, 2), None, 1.0, 1.0)]
    assert forecast.walk_forward(spark.createDataFrame(short, SCHEMA), "k", "day", ["x", "z"], "label", 2, 2021).count() == 0
    assert forecast.walk_forward(spark.createDataFrame([], SCHEMA), "k", "day", ["x", "z"], "label", 2, 2021).count() == 0


def test_the_model_is_at_its_optimum():
    g = np.random.default_rng(2)
    x, y = g.normal(size=(300, 3)), g.integers(0, 3, 300)
    w, mean, sd = forecast.fit(x, y, 3, 0.7)
    z = np.column_stack([(x - mean) / sd, np.ones(300)])
    penalty = np.full(w.shape, 1 / 0.7)
    penalty[-1] = 1e-8
    assert np.abs(z.T @ (forecast.probabilities(z, w) - np.eye(3)[y]) + penalty * w).max() < 1e-3


def day(n):
    return datetime.date(2026, 1, n)


def test_history_is_refused_where_it_cannot_be_told(spark):
    bars = spark.createDataFrame([("a", day(n), 10.0 * n) for n in range(1, 9)] + [("b", day(1), 1.0), ("b", day(1), 2.0)], "ticker string, day date, close double")
    events = lambda *rows: spark.createDataFrame([("a", *r) for r in rows], "ticker string, last_cum date, kind string, factor double, asset int")
    cash = spark.createDataFrame([("a", day(3), 1.0, 40.0)], "ticker string, last_cum date, amount double, ex_close double")
    assert history.history(bars, "a", day(2), day(4)).count() == 3
    assert [r.day for r in history.history(bars, "a", day(2), day(8), after="2026-01-06").collect()] == [day(7), day(8)]
    split = events((day(3), "DESDOBRAMENTO", 100.0, 1))
    rows = history.history(bars, "a", day(1), day(8), spec="adjusted", share_events=split, anchor="2026-01-08").collect()
    assert [r.close_adj for r in rows][:5] == [5.0, 10.0, 15.0, 40.0, 50.0]
    rows = history.history(bars, "a", day(1), day(8), spec="total_return", share_events=split, cash=cash, anchor="2026-01-08").collect()
    assert abs(rows[0].close_tr - 5.0 / (1 + 1 / 40)) < 1e-6 and rows[4].close_tr == 50.0
    for bad in (events((day(3), "CISAO", 1.0, 1)), events((day(3), "GRUPAMENTO", None, 1)), events((day(3), "GRUPAMENTO", 0.5, 1), (day(3), "GRUPAMENTO", 0.5, 2)), events((day(3), "GRUPAMENTO", 0.5, 1), (day(3), "GRUPAMENTO", 0.6, 1))):
        with pytest.raises(guards.Refused):
            history.history(bars, "a", day(1), day(8), spec="adjusted", share_events=bad, anchor="2026-01-08")
        assert history.history(bars, "a", day(4), day(8), spec="adjusted", share_events=bad, anchor="2026-01-08").count() == 5
    for call in (lambda: history.history(bars, "b", day(1), day(2)), lambda: history.history(bars, "a", day(5), day(2)), lambda: history.history(bars, "a", day(1), day(8), limit=3), lambda: history.history(bars, "a", day(1), day(8), after="x"), lambda: history.histories(bars, "other"), lambda: history.panel({})):
        with pytest.raises(guards.Refused):
            call()


def test_nested_penalties_and_past_states(spark):
    rows = [(*r[:4], r[4], int(i % 3) if i % 7 else None) for i, r in enumerate(series(900))]
    df = spark.createDataFrame(rows, SCHEMA + ", past int")
    got = forecast.walk_forward(df, "k", "day", ["x", "z"], "label", 2, 2021, horizon=3, past="past", grid=(1e-4, 1.0), held=1).collect()
    y = np.array([r[4] for r in rows])
    first = {2021: 366, 2022: 731}
    for r in got:
        i = (r.day - datetime.date(2020, 1, 1)).days
        known = [j for j in range(len(rows)) if j + 3 < first[r.year]]
        same = [j for j in known if rows[i][5] is None or rows[j][5] == rows[i][5]]
        assert np.allclose(r.markov[1], (y[same].sum() + 1) / (len(same) + 2)) and r.c_chosen in (1.0, 1e-4, None)
    assert {r.c_chosen for r in got if r.year == 2022} == {1.0}
    own = forecast.scored(spark.createDataFrame([(1, [0.25, 0.75]), (0, [0.5, 0.5]), (None, [1.0, 0.0])], "label int, p array<double>"), "p").collect()
    assert [round(x.log_loss, 6) for x in own] == [0.287682, 0.693147] and [x.brier for x in own] == [0.125, 0.5] and [x.hit for x in own] == [1.0, 0.0] or own[1].hit == 1.0


def test_paired_blocks_by_their_numbers(spark):
    g = np.random.default_rng(1)
    x = g.normal(0.2, 1, 200)
    df = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(x)] + [("b", 0, 1.0), ("b", 1, None)], "k string, day int, diff double")
    run = lambda: {r.k: (r.n, r.mean, r.low, r.high) for r in forecast.paired_bootstrap(df.repartition(3), "k", "day", "diff", 10, 500).collect()}
    got = run()
    assert got == run() and got["b"] == (1, 1.0, 1.0, 1.0)
    n, mean, low, high = got["a"]
    starts = np.random.default_rng(2).integers(0, 191, (4000, 20))
    other = np.quantile(x[starts[:, :, None] + np.arange(10)].mean(axis=(1, 2)), [0.05, 0.95])
    assert n == 200 and abs(mean - x.mean()) < 1e-12 and np.allclose([low, high], other, atol=0.03)


def test_clustered_intervals_are_those_of_the_same_draws(spark):
    from pyspark.sql import functions as F

    g = np.random.default_rng(4)
    c = g.integers(0, 30, 400)
    a, b = g.normal(size=400), g.normal(size=400) + c / 30
    y = a + 0.5 * b + g.normal(size=400)
    df = spark.createDataFrame([(int(k), float(p), float(q), float(r)) for k, p, q, r in zip(c, a, b, y)] + [(1, None, 1.0, 1.0)], "c int, a double, b double, y double")
    got = {r.model: r for r in forecast.clustered_gain(df, "c", "y", ["a"], ["b"], 40).collect()}
    draws = spark.range(0, 41).withColumnRenamed("id", "draw").crossJoin(spark.range(0, 30)).select(F.col("draw").cast("int").alias("draw"), F.col("id").cast("int").alias("c"), F.xxhash64(F.col("draw").cast("int"), F.col("id").cast("int")).alias("h")).collect()
    w = np.ones((41, 30))
    for r in draws:
        if r.draw:
            w[r.draw, r.c] = sum(r.h / 2.0**64 + 0.5 > s for s in forecast.poisson_steps())

    def told(weights, x):
        x = np.column_stack([np.ones(400), x])
        beta = np.linalg.lstsq(x * np.sqrt(weights)[:, None], y * np.sqrt(weights), rcond=None)[0]
        mean = (weights * y).sum() / weights.sum()
        return 1 - (weights * (y - x @ beta) ** 2).sum() / (weights * (y - mean) ** 2).sum()

    gains = [told(w[k][c], np.column_stack([a, b])) - told(w[k][c], a) for k in range(41)]
    assert np.allclose([got["gain"].value, got["gain"].low, got["gain"].high], [gains[0], *np.quantile(gains[1:], [0.025, 0.975])], atol=1e-6)
    assert got["full"].n_clusters == 30 and got["gain"].low > 0


def test_a_universe_ends_with_each_familys_complete_month(spark):
    rows = [(f"{fam}{i}", fam, datetime.date(2024, m, 1), 100.0 * i, 1.0 if m != 3 else None) for fam in "ab" for m in range(1, 8) for i in range(10) if not (fam == "b" and m == 7 and i > 2)]
    fact = spark.createDataFrame(rows, "entity string, family string, period date, nav double, x double")
    run = lambda **how: history.universe(fact, "x", datetime.date(2024, 2, 10), datetime.date(2024, 8, 2), **how)
    assert {(r.family, r.date.month) for r in run().collect()} == {("a", m) for m in (2, 4, 5, 6, 7)} | {("b", m) for m in (2, 4, 5, 6)}
    assert {r.date.month for r in run(family="b", until=datetime.date(2024, 7, 31)).collect()} == {2, 4, 5, 6, 7}
    assert {r.id for r in run(family="a", min_nav=700.0).collect()} == {"a7", "a8", "a9"}
    assert run(family="b", min_months=5).count() == 0 and run(family="a", min_months=5).count() == 50
    for bad in (lambda: history.universe(fact, "y", datetime.date(2024, 2, 1), datetime.date(2024, 8, 2)), lambda: run(until=datetime.date(2023, 1, 1))):
        with pytest.raises(guards.Refused):
            bad()
