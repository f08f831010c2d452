import os
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.functions import guards
from tidemark.functions.core import month
from tidemark.operators import store as S


def raw(spark, months=range(1, 7), each=150, value=1.0):
    return spark.createDataFrame([(date(2024, m, 1) + timedelta(days=i % 28), i, value) for m in months for i in range(each)], "day date, entity int, v double")


def build(df):
    return df.groupBy("entity", month("day").alias("period")).agg(F.sum("v").alias("v"))


def times(path):
    return {d: sorted((f, os.stat(f"{path}/{d}/{f}").st_mtime_ns) for f in os.listdir(f"{path}/{d}")) for d in os.listdir(path) if d.startswith("period=")}


def test_late_rows_rewrite_their_month_alone(spark, tmp_path):
    path = str(tmp_path / "fact")
    first = raw(spark)
    S.written(build(first), path)
    before = times(path)
    late = spark.createDataFrame([(date(2024, 3, 5), 7, 10.0), (date(2024, 8, 1), 1, 1.0), (None, 1, 1.0)], "day date, entity int, v double")
    all_ = first.unionByName(late)
    out = {r.period: (r.rows_before, r.rows_after, r.status) for r in S.refreshed(all_, late, "day", build, path).collect()}
    assert out == {date(2024, 3, 1): (150, 150, "replaced"), date(2024, 8, 1): (0, 1, "new")}
    after = times(path)
    assert {d for d in after if before.get(d) != after[d]} == {"period=2024-03-01", "period=2024-08-01"}
    whole = sorted(map(tuple, build(all_.filter("day is not null")).select("entity", "v", "period").collect()))
    assert sorted(map(tuple, S.stored(spark, path).select("entity", "v", "period").collect())) == whole


def test_a_month_that_shrinks_is_refused(spark, tmp_path):
    path = str(tmp_path / "fact")
    S.written(build(raw(spark)), path)
    small = raw(spark, months=[2], each=20, value=5.0)
    out = S.refreshed(small, small, "day", build, path).collect()
    assert [(r.rows_before, r.rows_after, r.status) for r in out] == [(150, 20, "refused")]
    assert S.stored(spark, path).filter("v = 5").count() == 0
    assert S.refreshed(small, small.limit(0), "day", build, path).count() == 0


def test_a_first_load_and_pruned_reads(spark, tmp_path):
    path = str(tmp_path / "fact")
    own = raw(spark)
    assert {r.status for r in S.refreshed(own, own, "day", build, path).collect()} == {"new"}
    read = S.stored(spark, path, "2024-02-01", "2024-04-01")
    assert read.count() == 300 and len(read.inputFiles()) >= 6
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(period" in plan and "2024-02-01" in plan
    scan = read.filter("v > 0")
    scan.collect()
    assert {r.f.rsplit("/", 2)[-2] for r in read.select(F.input_file_name().alias("f")).distinct().collect()} == {"period=2024-02-01", "period=2024-03-01"}


def test_too_many_periods_are_refused(spark, monkeypatch):
    monkeypatch.setattr(S, "MOST", 3)
    with pytest.raises(guards.Refused):
        S.touched(raw(spark), "day")
