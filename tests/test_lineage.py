import random
from datetime import date, timedelta

import pytest

from tidemark.operators import lineage as L

D = [date(2024, 1, 1) + timedelta(i) for i in range(60)]
A, B, C, P = "BRAAAAACNOR1", "BRBBBBACNOR2", "BRCCCCACNOR3", "BRBBBBACNPR2"


def inputs(spark, bars, firms=(), events=()):
    rows = [(t, D[k], i) for t, i, days in bars for k in days]
    rows += [("ZZZ", d, "BRZZZZACNOR9") for d in D[:30]]  # the market is open
    return (
        spark.createDataFrame(rows, "ticker string, day date, isin string"),
        spark.createDataFrame(list(firms), "ticker string, company string"),
        spark.createDataFrame([(i, D[k]) for i, k in events], "isin string, last_cum date"),
    )


def chain(spark, ticker, *given, **how):
    return [(r.name, r.isin, D.index(r.first_session), D.index(r.last_session)) for r in sorted(L.chains(*inputs(spark, *given), **how).filter(f"ticker = '{ticker}'").collect(), key=lambda r: r.seq)]


OLD, NEW = ("OLD", A, range(0, 10)), ("NEW", B, range(10, 20))
FIRM = [("OLD", "x"), ("NEW", "x"), ("OTHER", "x"), (None, "x"), ("LONE", None)]


@pytest.mark.parametrize(
    ("bars", "firms", "events", "length"),
    [
        ([OLD, NEW], FIRM, [], 2),
        ([OLD, NEW], [("OLD", "x"), ("NEW", "y")], [], 1),  # another company
        ([OLD, ("NEW", P, range(10, 20))], FIRM, [], 1),  # another class
        ([("OLD", A, range(0, 9)), NEW], FIRM, [], 1),  # a session in between
        ([OLD, NEW, ("OTHER", A, [15])], FIRM, [], 1),  # the old ISIN prints on
        ([OLD, NEW], FIRM, [(A, 9)], 1),  # an event at the seam
        ([OLD, NEW], FIRM, [(B, 9)], 1),
        ([OLD, NEW], FIRM, [(A, 8), (B, 10)], 2),  # events beside it
        ([OLD, NEW, ("OTHER", C, range(0, 10))], FIRM, [], 1),  # two candidates
        ([("NEW", A, range(0, 10)), NEW], [], [], 2),  # the same name, a new ISIN
    ],
)
def test_each_condition(spark, bars, firms, events, length):
    assert len(chain(spark, "NEW", bars, firms, events)) == length


def test_long_chains_by_doubling_and_their_limit(spark):
    names = [(f"T{k:02}", f"BR{k:04}ACNOR1", [2 * k, 2 * k + 1]) for k in range(13)]
    firms = [(f"T{k:02}", "x") for k in range(13)]
    got = chain(spark, "T12", names, firms)
    assert got == [(f"T{k:02}", f"BR{k:04}ACNOR1", 2 * k, 2 * k + 1) for k in range(3, 13)]
    assert len(chain(spark, "T12", names, firms, hops=20)) == 13
    bars, *rest = inputs(spark, names, firms)
    told = L.histories(bars, *rest, hops=20).filter("ticker = 'T12'").collect()
    assert sorted((r.day, r.name) for r in told) == sorted((D[k], t) for t, _, days in names for k in days)


def test_known_at_matches_a_search(spark):
    r = random.Random(3)
    seen = [(r.choice("abb"), D[r.randint(0, 59)], D[r.randint(0, 59)], r.randint(0, 3), r.choice([1.0, None])) for _ in range(150)]
    asked = [(i, r.choice("abc"), D[r.randint(0, 59)], D[r.randint(0, 59)]) for i in range(300)]
    got = {
        x.id: (x.valid, x.known, x.v, x.w, x.is_ambiguous)
        for x in L.known_at(spark.createDataFrame(asked, "id int, key string, day date, cutoff date"), spark.createDataFrame(seen, "key string, valid date, known date, v int, w double"), "key", "day", "cutoff", ["v", "w"]).collect()
    }
    for i, k, day, cutoff in asked:
        own = [o for o in seen if o[0] == k and o[1] <= day and o[2] <= cutoff]
        if not own:
            assert got[i] == (None,) * 5
            continue
        valid = max(o[1] for o in own)
        known = max(o[2] for o in own if o[1] == valid)
        ties = {o[3:] for o in own if o[1:3] == (valid, known)}
        assert got[i] == (valid, known, *(next(iter(ties)) if len(ties) == 1 else (None, None)), len(ties) > 1)


def test_nothing_known(spark):
    none = spark.createDataFrame([], "key string, valid date, known date, v int")
    asked = spark.createDataFrame([(1, None, D[3], D[3])], "id int, key string, day date, cutoff date")
    assert L.known_at(asked, none, "key", "day", "cutoff", ["v"]).collect()[0].valid is None
