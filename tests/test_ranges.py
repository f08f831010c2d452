import random

import numpy as np
import pytest

from tidemark.functions import ranges as R


def rows(seed):
    r = random.Random(seed)
    out = []
    for _ in range(600):
        g = r.choice(["a", "a", "a", "b", None])
        v = r.choice([None, 1.0, 1.0, 1.0, 2.5, round(r.gauss(0, 5), 1)])
        out.append((g, r.randint(0, 1), v))
    return out + [("only nulls", 0, None), ("one", 1, 3.0)]


@pytest.mark.parametrize("by", [[], ["g"], ["g", "h"]])
def test_percentiles_match_numpy(spark, by):
    own = rows(1)
    df = spark.createDataFrame(own, "g string, h int, v double").repartition(5)
    got = {tuple(x[c] for c in by): (x.low, x.mid, x.high) for x in R.percentiles(df, by, "v", {"low": 0.1, "mid": 0.5, "high": 0.9}).collect()}
    groups = {}
    for g, h, v in own:
        if v is not None:
            groups.setdefault(tuple({"g": g, "h": h}[c] for c in by), []).append(v)
    want = {k: tuple(np.quantile(v, (0.1, 0.5, 0.9))) for k, v in groups.items()}
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k]) for k in want)


@pytest.mark.parametrize("by", [[], ["g"]])
def test_ranks_match_counting(spark, by):
    own = rows(2)
    df = spark.createDataFrame(own, "g string, h int, v double").repartition(7)
    got = sorted((str(x.g), x.h, str(x.v), x.rank, round(x.pr, 9)) for x in R.ranked(df, by, "v", percent_rank="pr").collect())
    want = []
    for g, h, v in own:
        peers = [x[2] for x in own if not by or x[0] == g]
        there = [x for x in peers if x is not None]
        above = sum(x > v for x in there) if v is not None else len(there)
        below = sum(x < v for x in there) if v is not None else len(there)
        want.append((str(g), h, str(v), above + 1, round(below / (len(peers) - 1), 9) if len(peers) > 1 else 0.0))
    assert got == sorted(want)


def test_a_value_that_most_rows_share_is_one_row(spark):
    df = spark.range(1000).selectExpr("if(id < 900, 5.0D, cast(id as double)) as v")
    own = R.placed(R.counted(df, [], df.v)).orderBy("_value").collect()
    assert len(own) == 101 and (own[0].below, own[0]._n, own[1].below, own[0].total) == (0, 900, 900, 1000)


def test_no_rows(spark):
    df = spark.createDataFrame([], "g string, v double")
    assert R.percentiles(df, ["g"], "v", {"p": 0.5}).count() == 0 and R.ranked(df, ["g"], "v").count() == 0
