import random

import pytest

from tidemark.operators import bodies as B

XSI = 'xmlns:xsi="http://www.w3.org/2001/XMLSchema-instance"'


def body(inner, head="<VERSAO>1</VERSAO>"):
    return f"<?xml version='1.0' encoding='utf-8'?><DOC_ARQ {XSI}><CAB>{head}</CAB><LISTA>{inner}</LISTA></DOC_ARQ>"


def senior(serie, n):
    return f"<CLASSE_SENIOR><SERIE>{serie}</SERIE><QT_COTAS>{n}</QT_COTAS></CLASSE_SENIOR>"


def diff(spark, old, new):
    told = B.leaves(spark.createDataFrame([(1, old), (2, new)], "id int, content string")).cache()
    hashes = {r.id: r.sha256 for r in B.canonical(told).collect()}
    rows = B.differences(spark.createDataFrame([("p", 1, 2)], "pair string, old int, new int"), told).collect()
    return sorted((r.path, r.kind, r.old, r.new, r.basis) for r in rows), hashes[1] == hashes[2]


def test_order_of_keyed_blocks_and_white_space_do_not_count(spark):
    a = body(senior("1", 5) + senior("2", 7))
    b = body("\n " + senior(" 2 ", 7) + senior("1", 5), "\n<VERSAO> 1 </VERSAO>")
    assert diff(spark, a, b) == ([], True)


def test_blocks_match_by_key_and_new_ones_are_added(spark):
    rows, same = diff(spark, body(senior("1", 5) + senior("2", 7)), body(senior("3", 1) + senior("2", 8) + senior("1", 5)))
    assert not same and rows == [
        ("LISTA/CLASSE_SENIOR[SERIE=2]/QT_COTAS", "changed", "7", "8", "key"),
        ("LISTA/CLASSE_SENIOR[SERIE=3]/QT_COTAS", "added", None, "1", "key"),
        ("LISTA/CLASSE_SENIOR[SERIE=3]/SERIE", "added", None, "3", "key"),
    ]


def test_repeats_and_unknown_blocks_fall_back_to_position(spark):
    twice, _ = diff(spark, body(senior("1", 5) + senior("1", 6)), body(senior("1", 5)))
    assert twice == [("LISTA/CLASSE_SENIOR[#2]/QT_COTAS", "removed", "6", None, "position"), ("LISTA/CLASSE_SENIOR[#2]/SERIE", "removed", "1", None, "position")]
    other, _ = diff(spark, body("<X><Y>1</Y></X><X><Y>2</Y></X>"), body("<X><Y>2</Y></X><X><Y>1</Y></X>"))
    assert other == [("LISTA/X[#1]/Y", "changed", "1", "2", "position"), ("LISTA/X[#2]/Y", "changed", "2", "1", "position")]
    # once on one side, twice on the other: place decides on both
    grown, _ = diff(spark, body("<X>1</X>"), body("<X>1</X><X>2</X>"))
    assert grown == [("LISTA/X[#2]", "added", None, "2", "position")]


def test_value_nil_and_absent_are_three_states(spark):
    a = body('<A></A><B xsi:nil="true"/><C>1</C><D>x</D><E/><F xsi:nil="true"/>')
    b = body('<A xsi:nil="true"/><B>2</B><D>y</D><E></E><F xsi:nil="1"/><G/>')
    assert diff(spark, a, b)[0] == [("LISTA/A", "value_to_nil", "", None, "path"), ("LISTA/B", "nil_to_value", None, "2", "path"), ("LISTA/C", "removed", "1", None, "path"), ("LISTA/D", "changed", "x", "y", "path"), ("LISTA/G", "added", None, "", "path")]


def test_only_numeric_leaves_compare_as_numbers(spark):
    a = body("<VL_A>0,00</VL_A><NR_B>013</NR_B><PR_C>1.50</PR_C><CLS_SENIOR><PF>01</PF></CLS_SENIOR><VL_D>a</VL_D>")
    b = body("<VL_A>0</VL_A><NR_B>13</NR_B><PR_C>1,51</PR_C><CLS_SENIOR><PF>1</PF></CLS_SENIOR><VL_D>b</VL_D>")
    assert diff(spark, a, b)[0] == [("LISTA/NR_B", "changed", "013", "13", "path"), ("LISTA/PR_C", "changed", "1.50", "1,51", "path"), ("LISTA/VL_D", "changed", "a", "b", "path")]


def test_attributes_mixed_text_and_marks_in_keys(spark):
    a = body('<X u="1">text<Y>1</Y></X>' + senior("a/b,c]", 1))
    b = body('<X u="2">other<Y>1</Y></X>' + senior("a/b,c]", 2))
    assert diff(spark, a, b)[0] == [("LISTA/CLASSE_SENIOR[SERIE=a\\/b\\,c\\]]/QT_COTAS", "changed", "1", "2", "key"), ("LISTA/X", "changed", "text", "other", "path"), ("LISTA/X@u", "changed", "1", "2", "path")]


@pytest.mark.parametrize(("content", "status"), [(None, "not_xml"), ("%PDF-1.4", "not_xml"), ("<a><b></a>", "parse_error"), ("<!DOCTYPE x [<!ENTITY e 'y'>]><DOC_ARQ>&e;</DOC_ARQ>", "parse_error"), ("<OTHER/>", "unsupported_root"), ("<DOC_ARQ/>", "ok")])
def test_bodies_that_cannot_be_read_say_why(spark, content, status):
    told = B.leaves(spark.createDataFrame([(1, content), (2, body("<A>1</A>"))], "id int, content string"), roots=("DOC_ARQ",))
    assert {r.id: r.status for r in B.canonical(told).collect()} == {1: status, 2: "ok"}
    rows = B.differences(spark.createDataFrame([("p", 1, 2)], "pair string, old int, new int"), told)
    assert rows.count() == (2 if status == "ok" else 0)


def test_many_pairs_agree_with_a_walk_of_both_trees(spark):
    r = random.Random(4)

    def made():
        return [(r.choice("123"), r.randint(0, 2), r.choice(["", "<Z>1</Z>", "<Z/><Z>2</Z>"])) for _ in range(r.randint(0, 3))]

    def text(blocks):
        return body("".join(f"<CLASSE_SENIOR><SERIE>{s}</SERIE><QT_A>{q}</QT_A><IN>{z}</IN></CLASSE_SENIOR>" for s, q, z in blocks))

    def flat(blocks, other):
        both = [blocks, other]
        keyed = all(len({s for s, *_ in x}) == len(x) for x in both)
        out = {}
        for i, (s, q, z) in enumerate(blocks):
            at = f"[SERIE={s}]" if keyed else "" if max(map(len, both)) <= 1 else f"[#{i + 1}]"
            mate = next((zo for j, (so, _, zo) in enumerate(other) if (so == s if keyed else j == i)), "")
            top = f"LISTA/CLASSE_SENIOR{at}"
            out |= {f"{top}/SERIE": s, f"{top}/QT_A": str(q)}
            n = {"": 0, "<Z>1</Z>": 1}.get(z, 2)
            if not n:
                out[f"{top}/IN"] = ""
            for k in range(n):
                many = max(n, {"": 0, "<Z>1</Z>": 1}.get(mate, 2)) > 1
                out[f"{top}/IN/Z" + (f"[#{k + 1}]" if many else "")] = "1" if n == 1 else ["", "2"][k]
        return out or {"LISTA": ""}

    pairs = [(made(), made()) for _ in range(60)]
    told = B.leaves(spark.createDataFrame([(2 * i + k, text(p[k])) for i, p in enumerate(pairs) for k in (0, 1)], "id int, content string"))
    got = {(x.pair, x.path, x.old, x.new) for x in B.differences(spark.createDataFrame([(i, 2 * i, 2 * i + 1) for i in range(60)], "pair int, old int, new int"), told).collect()}
    want = set()
    for i, (a, b) in enumerate(pairs):
        x, y = flat(a, b), flat(b, a)
        want |= {(i, k, x.get(k), y.get(k)) for k in x.keys() | y.keys() if x.get(k) != y.get(k)}
    assert got == want


def test_bodies_longer_than_what_a_task_hands_over_are_whole(spark):
    n = 2 * B.ROWS + 5
    texts = [(1, "<R>" + "".join(f"<A><B>{i}</B></A>" for i in range(n)) + "</R>"), (2, "no xml"), (3, "<R/>"), (4, None)]
    told = B.leaves(spark.createDataFrame(texts, "id int, content string"))
    assert [(r.id, r.status, r.n, r.most) for r in told.selectExpr("*", "steps[0].at as at").groupBy("id", "status").agg({"*": "count", "at": "max"}).toDF("id", "status", "n", "most").orderBy("id").collect()] == [(1, "ok", n, n), (2, "not_xml", 1, None), (3, "ok", 1, None), (4, "not_xml", 1, None)]


def test_both_trees_at_once_tell_what_leaf_by_leaf_does(spark):
    r = random.Random(9)

    def element(depth):
        tag = r.choice(["A", "VL_B", "n:A", "CLS_SENIOR", "CEDENT"])
        attributes = "".join(f' {a}="{r.choice("12")}"' for a in r.sample(["u", "n:u", "v"], r.randint(0, 2))) + r.choice(["", "", ' xsi:nil="true"'])
        inner = r.choice(["", " ", "1", "1,0", "1.0", "0,50", "0.5", "x", "9" * 30]) + "".join(element(depth - 1) for _ in range(r.randint(0, 3) if depth else 0))
        if tag == "CEDENT":
            inner += r.choice(["", f"<NR_PF_PJ_CEDENT>{r.randint(1, 3)}</NR_PF_PJ_CEDENT>", '<NR_PF_PJ_CEDENT xsi:nil="1"/>'])
        return f"<{tag}{attributes}>{inner}</{tag}>"

    def whole():
        return r.choice([None, "no xml", "<R/>", '<R u="1">text</R>'] + [f'<R {XSI} xmlns:n="n">{"".join(element(3) for _ in range(r.randint(1, 4)))}</R>' for _ in range(12)])

    pairs = [(i, whole(), whole()) for i in range(150)]
    versions = spark.createDataFrame(pairs, "pair int, old string, new string")
    told = B.leaves(spark.createDataFrame([(2 * i + k, p[k]) for i, *p in pairs for k in (0, 1)], "id int, content string"))
    want = B.differences(spark.createDataFrame([(i, 2 * i, 2 * i + 1) for i, *_ in pairs], "pair int, old int, new int"), told)
    got = B.compared(versions)
    assert got.columns == want.columns and got.dtypes == want.dtypes
    got, want = (sorted(map(tuple, x.collect()), key=str) for x in (got, want))
    assert got == want and {x[3] for x in got} == {"added", "removed", "changed", "nil_to_value", "value_to_nil"} and {x[-1] for x in got} == {"path", "key", "position"}


def test_only_the_lines_of_a_pair_are_shuffled(spark):
    from tidemark import plans

    told = plans.QUERIES["body_differences"](spark, "/root/testdata/sf0.001")
    assert told._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1


def test_deep_bodies_are_compared(spark):
    deep = lambda x: "<R>" + "<A>" * 3000 + x + "</A>" * 3000 + "</R>"
    rows = B.compared(spark.createDataFrame([(1, deep("1"), deep("2"))], "pair int, old string, new string")).collect()
    assert [(len(r.path), r.old, r.new) for r in rows] == [(5999, "1", "2")]
