import re

import pandas as pd
import pytest
from pyspark.sql import functions as F

from lectern.functions import labels, udfs
from lectern.functions import text as fn
from lectern.operators import search
from lectern.plans import parse


def one(spark, expression, **columns):
    rows = spark.createDataFrame([tuple(columns.values()) or (0,)], list(columns) or ["x"])
    return rows.select(expression.alias("v")).first()["v"]


@pytest.mark.parametrize(("text", "query"), [("aaaa", "aa"), ("甲\U00105001乙甲\U00105001", "甲\U00105001"), ("a.b.a.b", "a.b"), ("", "x"), ("xyz", "xyz"), ("ababab", "bab"), ("(x)(x)", "(x)"), ("a b  a", " ")])
def test_positions_overlap_and_count_codepoints(spark, text, query):
    want = [i for i in range(len(text)) if text.startswith(query, i)]
    assert one(spark, fn.positions("t", query), t=text) == want


@pytest.mark.parametrize("n", [1, 2, 3, 4, 6, 7, 12])
def test_grams(spark, n):
    texts = ["", "ab", "甲\U00105001乙丙丁戊己庚辛壬癸子丑", "abcdefg" * 3]
    rows = fn.exploded_grams(spark.createDataFrame(list(enumerate(texts)), "k int, text string"), n, ["k"]).collect()
    assert sorted((r["k"], r["position"], r["gram"]) for r in rows) == sorted((k, i, t[i : i + n]) for k, t in enumerate(texts) for i in range(len(t) - n + 1))


@pytest.mark.parametrize(
    ("raw", "want"),
    [("- 390; - 245", [-390, -245]), ("980-1001", [980, 1001]), ("", []), ("c. 12", [12]), ("-5", [-5])],
)
def test_years(spark, raw, want):
    assert one(spark, fn.years("t"), t=raw) == want


@pytest.mark.parametrize(
    ("bounds", "want"),
    [((-390, -245, None, None), (-390, "not_before_wide_range")), ((390, 413, None, None), (401, "midpoint")), ((1, 9, 5, 5), (5, "dzt_date")), ((1, 9, 5, None), (5, "midpoint")), ((None, 9, None, None), None), ((9, 9, 200, 20), (20, "dzt_date_not_before_wide_range")), ((-3, -2, None, None), (-3, "midpoint")), ((10, 20, 30, 33), (31, "dzt_date_midpoint"))],
)
def test_index_date(spark, bounds, want):
    rows = spark.createDataFrame([bounds], "a int, b int, c int, d int")
    got = rows.select(fn.index_date("a", "b", "c", "d").alias("v")).first()["v"]
    assert (None if got is None else tuple(got)) == want


@pytest.mark.parametrize(("year", "key", "label", "start", "end"), [(1, "ce-01", "1st c. CE", 1, 100), (100, "ce-01", "1st c. CE", 1, 100), (101, "ce-02", "2nd c. CE", 101, 200), (0, "bce-01", "1st c. BCE", -100, 0), (-100, "bce-01", "1st c. BCE", -100, 0), (-101, "bce-02", "2nd c. BCE", -200, -101), (1150, "ce-12", "12th c. CE", 1101, 1200), (2050, "ce-21", "21st c. CE", 2001, 2100)])
def test_century(spark, year, key, label, start, end):
    assert tuple(one(spark, fn.century("y"), y=year)) == (key, label, start, end)


@pytest.mark.parametrize(
    ("ref", "want"),
    [("1h4/1/@0+86", ("KR1h0004", 1, "body", 0, 86)), ("KR1h0004/2", ("KR1h0004", 2, "body", None, None)), ("1h4/1/front", ("KR1h0004", 1, "front", None, None)), ("1h4/1/back@3+4", ("KR1h0004", 1, "back", 3, 4)), ("1h4/1/", None), ("nothing", None)],
)
def test_references(spark, ref, want):
    got = one(spark, fn.parsed_ref("r"), r=ref)
    assert (None if got is None else tuple(got)) == want


def test_reference_round_trip(spark):
    rows = spark.createDataFrame([("KR1h0004", 1, "body", 0, 86), ("KR6q0053", 12, "front", 5, 1), ("X1", 1, "body", 0, 1)], "t string, s int, b string, o int, n int")
    refs = [r["v"] for r in rows.select(fn.short_ref("t", "s", "b", "o", "n").alias("v")).collect()]
    assert refs == ["1h4/1/@0+86", "6q53/12/front@5+1", None]


@pytest.mark.parametrize(("value", "want"), [("1h4", "KR1h0004"), ("KR1h4", "KR1h0004"), ("KR1h0004", "KR1h0004"), ("J01nA001", "J01nA001"), (" 6q53 ", "KR6q0053")])
def test_text_ids(spark, value, want):
    assert one(spark, fn.normal_text_id("v"), v=value) == want


def test_small_expressions(spark):
    assert one(spark, fn.numeric_prefix("v"), v=" -12x") == -12
    assert one(spark, fn.numeric_prefix("v"), v="x12") == 0
    assert one(spark, fn.bare_uuid("v"), v="uuid-abc#1 rest") == "abc"
    assert one(spark, fn.relative_marker("v"), v="a_tls_b_tls_c") == "c"
    assert one(spark, fn.section_code("v"), v="KR3ea0012") == "KR3ea"
    assert one(spark, fn.period_year("v"), v="前 221") == -221
    assert one(spark, fn.period_year("v"), v="none") is None
    assert one(spark, fn.iso_micros("v"), v="1970-01-01T00:00:01Z") == 1_000_000
    assert one(spark, fn.iso_micros("v"), v="soon") == 0
    assert [one(spark, fn.body_char("v"), v=c) for c in ("甲", "\U00105001", "a", "，")] == [True, True, False, False]
    assert one(spark, fn.is_ai("t", F.array(F.lit("An AI"))), t="x") is True
    assert one(spark, fn.is_ai("t", F.array(F.lit("MAIL"))), t="PAID") is False


def test_arrow_functions(spark):
    texts = spark.createDataFrame([("  Lùnyǔ ",), ("",), ("é",), ("&KR0012;甲",)], "t string")
    assert [r["v"] for r in texts.select(udfs.fold_search("t").alias("v")).collect()] == ["lunyu", None, "e", "&kr0012;甲"]
    assert texts.select(udfs.nfc("t").alias("v")).collect()[2]["v"] == "é"
    there = texts.select(udfs.expand_entities("t").alias("v")).collect()[3]["v"]
    assert there == chr(0x105000 + 12) + "甲"
    assert one(spark, udfs.entities("v"), v=there) == "&KR0012;甲"
    assert one(spark, udfs.jcs_hash("v"), v='{"b":1, "a":[2]}') == one(spark, fn.text_hash("v"), v='{"a":[2],"b":1}')
    udfs.register(spark)
    assert spark.sql("select fold_search('Á') as v").first()["v"] == "a"


@pytest.mark.parametrize(("a", "b"), [("kitten", "sitting"), ("", "ab"), ("abc", ""), ("甲乙丙丁", "甲丙丁戊"), ("same", "same"), ("abcdef", "azced")])
def test_align_ops_turn_one_text_into_the_other(a, b):
    at, out, cost = 0, "", 0
    for op in udfs.align(a, b):
        if op["op"] == "=":
            out += a[at : at + op["n"]]
            at += op["n"]
        else:
            cost += 1
            assert op["a"] in ("", a[at : at + 1])
            out += op["b"]
            at += len(op["a"])
    assert out == b and at == len(a)
    rows = [[max(i, j) if not i or not j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            rows[i][j] = min(rows[i - 1][j - 1] + (a[i - 1] != b[j - 1]), rows[i - 1][j] + 1, rows[i][j - 1] + 1)
    assert cost == rows[-1][-1]


def test_query_modes():
    assert parse.parse("abc").mode == "literal"
    assert parse.parse("a NEAR b") == parse.Query("near", "a", right="b")
    assert parse.parse("a NOT b").mode == "not"
    assert parse.parse("/ab+c/is").flags == re.IGNORECASE | re.DOTALL
    for bad, code in (("a NEAR", "invalid_compound_query"), ("a NEAR b c", "invalid_compound_query"), ("/ab", "invalid_regex"), ("/a/x", "invalid_regex"), ("/(/", "invalid_regex"), ("/a*/", "zero_length_regex"), ("/x?/", "zero_length_regex")):
        with pytest.raises(parse.QueryError) as error:
            parse.parse(bad)
        assert error.value.code == code


@pytest.mark.parametrize(("pattern", "want"), [("abc|de", None), ("(abc)?de", "de"), ("ab[cd]efg", "efg"), (r"a\.bc\d", "a.bc"), ("abc+d", "abc"), ("abc*d", "ab"), ("x", None), ("(ab)cd", "cd")])
def test_anchors_are_in_every_match(pattern, want):
    assert parse.anchor(pattern) == want
    assert parse.anchor(pattern, re.IGNORECASE) is None


def test_expressions_that_ignore_case_have_no_anchor(spark):
    """A letter after the slash and a flag in the expression are one; no text is passed over for its spelling."""
    assert parse.parse("/(?i)hello/").anchor is None and parse.parse("/hello/i").anchor is None
    assert parse.parse("/(?s)hello/").anchor == "hello"
    assert parse.parse("/(?i:he)llo/").anchor == "llo"
    rows = spark.createDataFrame([(1, "a", "x", "Hello there"), (2, "a", "x", "hello"), (3, "a", "x", "no")], "bucket_id long, textid string, kind string, text string")
    found = search.search(rows, "/(?i)hello/", scope=["a"]).collect()
    assert sorted((r["bucket_id"], r["match"]) for r in found) == [(1, "Hello"), (2, "hello")]


@pytest.mark.parametrize("text", ["/a/b/", r"/a\/b/i", r"/\\/", "/a/i", "/[/]x/", "/a\nb/s"])
def test_expressions_end_at_the_last_slash_left(text):
    end = max(i for i, c in enumerate(text) if c == "/" and not parse.is_escaped(text, i))
    assert parse.parse(text).pattern == text[1:end]


def test_escapes_and_scope():
    assert parse.is_escaped(r"a\/", 2) and not parse.is_escaped(r"a\\/", 3)
    with pytest.raises(parse.QueryError):
        parse.check_scope(parse.parse("/a|b/"), False)
    parse.check_scope(parse.parse("/a|b/"), True)


def test_positions_of_many_occurrences(spark):
    """More occurrences than one running sum takes, overlapping ones too."""
    text = "aab" * 700 + "é" + "aa" * 400
    rows = spark.createDataFrame([(text,), ("",), (None,), ("a",)], "text string")
    for query in ("a", "aa", "b", "ba", "é"):
        want = [i for i in range(len(text)) if text.startswith(query, i)]
        got = [r[0] for r in rows.select(fn.positions("text", query)).collect()]
        assert got[0] == want and got[1] == [] and got[3] == ([0] if query == "a" else [])


def test_near_offsets_against_brute_force():
    import random

    rng = random.Random(8)
    for _ in range(200):
        n, m, d = rng.randrange(1, 4), rng.randrange(1, 4), rng.randrange(6)
        own, other = (sorted(rng.sample(range(60), rng.randrange(8))) for _ in range(2))
        for negate in (False, True):
            want = [p for p in own if any(max(p - (q + m), q - (p + n), 0) <= d for q in other) != negate]
            got = udfs.near_offsets(n, m, d, negate).func(pd.Series([own]), pd.Series([other]))[0]
            assert got.tolist() == want


def test_chain_of_shared_characters_against_brute_force():
    import random

    rng = random.Random(6)
    for _ in range(40):
        contexts = ["".join(rng.choice("abcdefg") for _ in range(rng.randrange(8))) for _ in range(rng.randrange(1, 12))]
        sets = [frozenset(c) - {"a"} for c in contexts]
        totals = [sum(len(x & y) for j, y in enumerate(sets) if j != i) for i, x in enumerate(sets)]
        order, left = [], set(range(len(sets)))
        while left:
            last = sets[order[-1]] if order else frozenset()
            order.append(min(left, key=lambda i: (-len(last & sets[i]), -totals[i], i)))
            left.discard(order[-1])
        assert search._chain(contexts, {"a"}) == order


def test_trees_of_odd_labels():
    known = frozenset({"V", "N"})
    assert labels.tree("", known) == [(0, None, "label", "", 0, 0)]
    assert labels.tree("V(N]", known) == [(0, None, "label", "V(N]", 0, 4), (1, 0, "atom", "V", 0, 1), (2, 0, "group", "(N]", 1, 4), (3, 2, "atom", "N", 2, 3), (4, 2, "close", "]", 3, 4)]
    for label in ("[V(N)]{N}", "((V)", "V)N", "[(])"):
        nodes = labels.tree(label, known)
        assert all(p is None or nodes[p][4] <= s and e <= nodes[p][5] and p < n for n, p, _, _, s, e in nodes)
        leaves = [(s, e, t) for _, _, k, t, s, e in nodes if k not in ("label", "group")]
        assert all(label[s:e] == t for s, e, t in leaves) and all(x[1] <= y[0] for x, y in zip(leaves, leaves[1:], strict=False))
