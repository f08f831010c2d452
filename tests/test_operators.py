"""Operators that SQL can't hold against the driver tables, on small inputs."""

import datetime
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import guards
from tidemark.operators import filings, graph, ingest, panel, rates, statements


def day(text):
    return datetime.date.fromisoformat(text)


def test_implied_rate_of_several_flows(spark):
    flows = [("a", 950.0, 126, 60.0), ("a", 950.0, 252, 1060.0), ("b", 0.0, 252, 100.0), ("c", 1e9, 252, 100.0), ("d", 100.0, 252, 100.0)]
    got = {r.id: r.rate for r in rates.implied_rate(spark.createDataFrame(flows, "id string, price double, du int, cash double")).collect()}
    assert got["b"] is None and got["c"] is None and abs(got["d"]) < 1e-9
    assert abs(60 / (1 + got["a"] / 100) ** 0.5 + 1060 / (1 + got["a"] / 100) - 950) < 1e-6


def test_flat_forward_keeps_a_constant_forward_rate(spark):
    v = spark.createDataFrame([("x", day("2026-01-02"), 252, 10.0), ("x", day("2026-01-02"), 504, 12.0)], "curve string, day date, du int, rate double")
    got = {r.du: r.rate for r in rates.flat_forward(v, [100, 252, 378, 504, 505]).collect()}
    assert got[100] is None and got[505] is None
    assert math.isclose(got[252], 10, rel_tol=1e-12) and math.isclose(got[504], 12, rel_tol=1e-12)
    forward = (1.12**2 / 1.10) ** 0.5
    assert math.isclose((1 + got[378] / 100) ** 1.5, 1.10 * forward, rel_tol=1e-12)


def brute_tail(points):
    points = sorted(points)
    x, y, t = (np.array(c, float) for c in zip(*points, strict=True))
    t = t * 1.5 + 1e-12
    best = len(x) - 2
    for s in range(len(x) - 3, -1, -1):
        b, a = np.polyfit(x[s:], y[s:], 1)
        if not np.all(np.abs(y[s:] - a - b * x[s:]) <= t[s:]):
            break
        best = s
    return int(x[max(best, 0)]) if len(x) >= 3 else int(x[0])


def test_tail_of_a_curve(spark):
    g = np.random.default_rng(1)
    rows = []
    for c in range(12):
        n, bend = int(g.integers(1, 12)), int(g.integers(0, 9))
        y = 0.0
        for i in range(n):
            y += 0.01 if i >= bend else float(g.uniform(0.01, 0.05))
            rows.append((f"c{c}", day("2026-01-02"), 21 * (i + 1), y, 1e-4))
    v = spark.createDataFrame(rows, "curve string, day date, du int, log_factor double, tolerance double")
    got = {r.curve: r.tail_from for r in rates.tail_start(v).collect()}
    assert got == {c: brute_tail([r[2:] for r in rows if r[0] == c]) for c in got}


def test_tail_of_long_curves_takes_no_square_of_their_vertices(spark):
    g = np.random.default_rng(2)
    for n in (3, 40, 400):
        for noise in (0.0, 0.5, 0.9, 1.1):
            x = 21.0 * np.arange(1, n + 1)
            y = 1e-4 * x + np.where(np.arange(n) < n // 3, 0.05 * (n // 3 - np.arange(n)), 0.0) + noise * 1e-3 * g.uniform(-1.5, 1.5, n)
            t = np.full(n, 1.5e-3)
            assert x[rates.tail_from(x.tolist(), y.tolist(), t.tolist())] == brute_tail(list(zip(x, y, t / 1.5, strict=True)))
    # all vertices on a line: every cut fits, and slices of all of them would be 400 million points
    v = spark.range(20_000).select(F.lit("x").alias("curve"), F.lit("2026-01-02").cast("date").alias("day"), (21 * (F.col("id") + 1)).alias("du"), (F.col("id") * 0.01).alias("log_factor"), F.lit(1e-4).alias("tolerance"))
    assert [tuple(r) for r in rates.tail_start(v).collect()] == [("x", day("2026-01-02"), 21)]


def test_load_verdicts(spark):
    rows = [(1, "2026-01-01", 200, 200, None), (1, "2026-01-02", 90, 90, None), (1, "2026-01-03", 150, 150, None), (1, "2026-01-04", 0, 0, "not published yet"), (1, "2026-01-05", 50, 0, None), (1, "2026-01-06", 5, 5, "broken"), (1, "2026-03-01", 10, 10, None), (2, "2026-01-01", 0, 0, None), (2, "2026-01-02", 9, 9, None), (2, "2026-01-03", 1, 1, None)]
    df = spark.createDataFrame([(s, day(d), f, r, e) for s, d, f, r, e in rows], "slice int, at date, fetched long, rows long, error string")
    got = {(r.slice, str(r.at)): (r.status, r.previous) for r in ingest.load_verdict(df).collect()}
    assert [got[1, d] for _, d, *_ in rows[:7]] == [("ok", None), ("error", 200), ("ok", 200), ("skipped", 150), ("error", 150), ("error", 150), ("ok", None)]
    assert [got[2, d] for _, d, *_ in rows[7:]] == [("ok", None), ("ok", 0), ("ok", 9)]


def test_versions_with_null_keys_and_equal_versions(spark):
    rows = [(1, None, 1, "2026-01-01"), (2, None, 2, "2026-01-11"), (3, "k", 1, "2026-01-01"), (4, "k", 1, "2026-01-04"), (5, "z", 7, "2026-01-01")]
    docs = spark.createDataFrame([(a, b, c, day(d)) for a, b, c, d in rows], "doc int, key string, version int, filed date")
    got = {r.doc: (r.previous, r.lag_days) for r in filings.version_pairs(docs, ["key"], "version", "filed").collect()}
    assert got == {2: (1, 10), 4: (3, 3)}
    newest = statements.newest_versions(docs, ["key"]).select("doc").collect()
    assert sorted(r.doc for r in newest) == [2, 3, 4, 5]


def test_parents_and_spans(spark):
    rows = [("1", "assets"), ("1.01", "current"), ("1.01.02", "cash"), ("9.9", "orphan")]
    df = spark.createDataFrame([(None, c, n) for c, n in rows], "ref string, code string, label string")
    assert {r.code: r.parent for r in statements.with_parent_label(df, ["ref"]).collect()} == {"1": None, "1.01": "assets", "1.01.02": "current", "9.9": None}
    spans = spark.createDataFrame([(day("2026-01-01"), day("2026-03-31")), (day("2026-01-01"), day("2026-12-31")), (None, day("2026-12-31"))], "start date, end date")
    assert [r.m for r in spans.select(statements.span_months().alias("m")).collect()] == [3, 12, None]


def test_refusals(spark):
    with pytest.raises(guards.Refused):
        guards.row_cap(spark.range(1001), "x")
    assert guards.row_cap(spark.range(1000), "x").count() == 1000
    assert guards.row_cap(spark.range(1001), "x", paging=True).count() == 1001
    for f, args in ((guards.panel_ids, (["a"] * 4,)), (guards.panel_universe, (0, "x", ["y"], True)), (guards.panel_universe, (0, None, ["y"], True)), (guards.one_of, ("x", ["a"], "kind")), (guards.between, (5, 1, 3, "n")), (guards.date_cursor, ("2026-1-1",)), (guards.date_cursor, ("2026-02-31",)), (guards.panel_cursor, ("a|b",)), (guards.window, (day("2026-02-01"), day("2026-01-01")))):
        with pytest.raises(guards.Refused):
            f(*args)
    with pytest.raises(guards.Refused):
        guards.exactly_one(a=1, b=2)
    with pytest.raises(guards.Refused):
        guards.unique(spark.createDataFrame([(1,), (1,)], "k int"), ["k"], "x")
    assert guards.panel_cursor("2026-01-31|a|nav|") == (day("2026-01-31"), "a", "nav", "")
    guards.panel_ids(["a"] * 50, signed_in=True)
    assert guards.nav_cursor("2026-01-31|x", ["a"]) == (day("2026-01-31"), "x") and guards.nav_cursor(None, []) is None
    for ids, text in ((["a", "b"], "2026-01-31|x"), (["a"], "2026-01-31"), (["a"], "x|y")):
        with pytest.raises(guards.Refused):
            guards.nav_cursor(text, ids)


def test_block_bootstrap_is_what_numpy_gives(spark):
    values = np.random.default_rng(3).normal(0.5, 1.0, 100)
    df = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(values)] + [("b", 0, None), ("c", 0, 2.0)], "k string, t long, v double").repartition(3)
    got = {r.k: r for r in panel.block_bootstrap(df, "k", "t", "v", 12, 200, 7).collect()}
    starts = np.random.default_rng(7).integers(0, 100 - 12 + 1, (200, 9))
    means = [np.concatenate([values[s : s + 12] for s in row])[:100].mean() for row in starts]
    assert got["a"].n == 100 and math.isclose(got["a"].mean, values.mean())
    assert np.allclose([got["a"].low, got["a"].high], np.quantile(means, [0.025, 0.975]))
    assert got["a"].low < values.mean() < got["a"].high
    assert got["b"].n == 0 and got["b"].mean is None
    assert (got["c"].n, got["c"].low, got["c"].high) == (1, 2.0, 2.0)


def test_percent_of_nothing(spark):
    from tidemark.functions.core import weighted

    df = spark.createDataFrame([(1, 2.0, 0.5), (1, 2.0, None), (2, 0.0, 1.0)], "k int, q double, r double")
    assert {r.k: r.x for r in df.groupBy("k").agg(weighted("r", "q").alias("x")).collect()} == {1: 0.5, 2: None}
    assert df.agg(F.sum("q")).first()[0] == 4.0


@pytest.mark.parametrize("small", [0, 10**6])
def test_components_in_one_task_and_in_rounds(spark, monkeypatch, small):
    monkeypatch.setattr(graph, "SMALL", small)
    r = random.Random(3)
    pairs = [(i, i + 1) for i in range(40)] + [(r.randint(100, 180), r.randint(100, 180)) for _ in range(45)] + [(7, 7), (None, 3)]
    root = {x: x for p in pairs for x in p if x is not None}
    for _ in range(200):
        for a, b in pairs:
            if a is not None:
                root[a] = root[b] = min(root[a], root[b])
    want = {x: y for x, y in root.items() if any(x in p and None not in p and p[0] != p[1] for p in pairs)}
    got = graph.components(spark.createDataFrame(pairs, "a long, b long"))
    assert {x.node: x.root for x in got.collect()} == want
    named = graph.components(spark.createDataFrame([("b", "c"), ("c", "a"), ("y", "z")], "a string, b string"))
    assert {x.node: x.root for x in named.collect()} == {"a": "a", "b": "a", "c": "a", "y": "y", "z": "y"}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_groups_are_found_without_copies_of_tables(spark, monkeypatch):
    monkeypatch.setattr(graph, "SMALL", 0)
    plans, keep = [], graph.saved
    monkeypatch.setattr(graph, "saved", lambda df, **k: (plans.append(df), keep(df, **k))[1])
    lines = spark.createDataFrame([(i, f"k{(i + j) // 2}") for i in range(40) if i % 10 < 8 for j in (0, 1)], "line int, key string")
    found = graph.overlap_groups(lines, "line", "key")
    assert {(r.line, r.component) for r in found.collect()} == {(i, i // 10 * 10) for i in range(40) if i % 10 < 8}
    rounds = [p for p in plans[2:]] + [found]
    assert all("BroadcastHashJoin" not in p._jdf.queryExecution().executedPlan().toString() for p in rounds)
