import random
from datetime import date

import pytest
from pyspark.sql import functions as F

from tidemark.operators import resolve as R


def grams(name):
    out = []
    for w in "".join(c if c.isalnum() else " " for c in name).split():
        p = f"  {w} "
        out += [p[i : i + 3] for i in range(len(w) + 1)]
    return out


def extent(a, b):
    own, name = set(grams(a)), grams(b)
    return max((len(own & set(name[i:j])) / len(own | set(name[i:j])) for i in range(len(name)) for j in range(i + 1, len(name) + 1)), default=0.0)


def plain(a, b):
    x, y = set(grams(a)), set(grams(b))
    return len(x & y) / len(x | y)


def score(a, b):
    return max(plain(a, b), extent(a, b)) if len(a.split()) <= 4 else plain(a, b)


def names(seed, n):
    r = random.Random(seed)
    words = ["alfa", "beta", "banco", "bancos", "plus", "credito", "fundo", "multi", "real", "xp", "a1"]
    return sorted({" ".join(r.choice(words) for _ in range(r.randint(1, 6))) for _ in range(n)})


def test_best_extent_matches_all_extents():
    for a in names(1, 25):
        for b in names(2, 25):
            assert abs(R.best_extent(list(dict.fromkeys(grams(a))), grams(b)) - extent(a, b)) < 1e-12


def test_scores_are_those_of_all_pairs(spark):
    a, b = [*names(3, 60), "zzz", "!!"], names(4, 80)
    got = {(x.asked, x.name): round(x.score, 9) for x in R.scores(spark.createDataFrame([(x,) for x in a], "asked string"), spark.createDataFrame([(x,) for x in b], "name string")).collect()}
    want = {(x, y): round(s, 9) for x in a for y in b if grams(x) and (s := score(x, y)) >= 0.25}
    assert got == want


@pytest.fixture(scope="module")
def told(spark):
    known = [
        ("00000000000001", "Banco Alfa Crédito Fundo", True, date(2024, 5, 1)),
        ("00000000000001", "Alfa Antigo", False, date(2020, 1, 1)),
        ("00000000000002", "Banco Alfa Credito Plus", True, None),
        ("00000000000003", "Gama Delta Renda", True, None),
        ("00000000000004", "Investimentos Gama Epsilon Omega Corporativo Renda Longo Prazo", True, None),
        ("00000000000005", "Kappa Um", True, None),
        ("00000000000006", "Kappa Um", True, None),
    ]
    quotas = [("00000000000005", date(2024, 1, 2), 10.0), ("00000000000006", date(2024, 1, 2), 20.0), ("00000000000006", date(2024, 1, 3), 10.0)]
    d = date(2024, 1, 2)
    lines = [
        (1, "anything", "1", None, None),
        (2, " kapp11 ", None, None, None),
        (3, "BANCO  alfa credito fundo", None, None, None),
        (4, "alfa antigo", None, None, None),
        (5, "Banco Alfa Cred", None, None, None),
        (6, "Gama Delta", None, None, None),
        (7, "qqqq wwww", None, None, None),
        (8, None, None, None, None),
        (9, "Kappa Um", None, None, None),
        (10, "Kappa Um", None, 20.05, d),
        (11, "", "99", None, None),
        (12, "firf crpr fic fia fidc mm Omega Corporativo", None, None, None),
    ]
    out = R.resolved(
        spark.createDataFrame(lines, "line int, name string, number string, quota double, quota_day date"),
        spark.createDataFrame(known, "id string, name string, is_current boolean, last_period date"),
        spark.createDataFrame(quotas, "id string, day date, quota double"),
        spark.createDataFrame([("KAPP11", "00000000000005")], "ticker string, id string"),
        ("firf", "crpr", "fic", "fia", "fidc", "mm"),
    )
    rows: dict[int, list] = {}
    for r in sorted(out.collect(), key=lambda r: (r.line, r.rank or 0)):
        rows.setdefault(r.line, []).append(r)
    return rows


def test_routes(told):
    first = {k: (v[0].id and int(v[0].id), v[0].kind) for k, v in told.items()}
    assert first == {1: (1, "number"), 2: (5, "ticker"), 3: (1, "exact_current"), 4: (1, "exact_history"), 5: (1, "trigram"), 6: (3, "trigram"), 7: (None, None), 8: (None, None), 9: (5, "exact_current"), 10: (6, "exact_current"), 11: (99, "number"), 12: (4, "trigram")}


def test_ambiguity(told):
    assert {k for k, v in told.items() if v[0].is_ambiguous} == {5, 9, 12}  # alike names; equal names without a quota; a hint
    assert told[12][0].score <= 0.5 and abs(told[10][0].quota_diff - 0.002494) < 1e-6 and not told[10][1].is_ambiguous


def test_candidates_are_five_at_most(spark):
    known = spark.createDataFrame([(f"{i:014}", f"alfa beta {c}", True, None) for i, c in enumerate("abcdefgh")], "id string, name string, is_current boolean, last_period date")
    lines = spark.createDataFrame([(1, "alfa beta x", None, None, None)], "line int, name string, number string, quota double, quota_day date")
    none = spark.createDataFrame([], "id string, day date, quota double"), spark.createDataFrame([], "ticker string, id string")
    assert [int(r.id) for r in R.resolved(lines, known, *none).orderBy("rank").collect()] == [0, 1, 2, 3, 4]
    assert R.resolved(lines.limit(0), known, *none).count() == 0 and R.resolved(lines, known.limit(0), *none).filter(F.col("id").isNull()).count() == 1


def test_names_of_a_number_that_are_too_unlike_count_as_equally_unlike(spark):
    known = spark.createDataFrame([("00000000000001", "fim abcdef ghijkl mnopqr stuvwx", False, date(2020, 1, 1)), ("00000000000001", "zzzzzz", True, date(2020, 1, 1))], "id string, name string, is_current boolean, last_period date")
    lines = spark.createDataFrame([(1, "fim o um dois tres quatro cinco", "1", None, None)], "line int, name string, number string, quota double, quota_day date")
    empty = spark.createDataFrame([], "id string, day date, quota double"), spark.createDataFrame([], "ticker string, id string")
    likest, current = (R.resolved(lines, known, *empty, number_least=n).first() for n in (0.0, R.LEAST))
    assert likest.matched.startswith("fim") and current.matched == "zzzzzz" and 0 < likest.score < R.LEAST
