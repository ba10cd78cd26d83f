import random
import re

import pytest
from pyspark.sql import functions as F

from lectern.operators import annotations, chars, intervals, order, search, slices, voices, witness
from lectern.plans.parse import QueryError, parse

SOURCE = "bucket_id long, textid string, kind string, text string"


def sources(spark, *texts):
    return spark.createDataFrame([(i, f"T{i}", "body", t) for i, t in enumerate(texts)], SOURCE)


def test_kwic_of_a_master_hit(spark):
    row = search.search(sources(spark, "ABCDEFGHIJ"), "CDE", context=2).first()
    assert (row["master_offset"], row["left"], row["match"], row["right"]) == (2, "AB", "CDE", "FG")


def test_hits_overlap_and_context_is_clipped(spark):
    rows = search.search(sources(spark, "aaaa"), "aa", context=1).orderBy("master_offset").collect()
    assert [(r["left"], r["match"], r["right"]) for r in rows] == [("", "aa", "a"), ("a", "aa", "a"), ("a", "aa", "")]


@pytest.mark.parametrize(("query", "texts"), [(r"/b[ac]+d/", ["abacd", "bd", "xbad bcd"]), ("/甲.丙/", ["甲\U00105001丙甲乙丙"]), ("/AB/i", ["xabAB"]), ("/a.b/s", ["a\nb"])])
def test_regex_hits_are_those_of_python(spark, query, texts):
    parsed = parse(query)
    rows = search.search(sources(spark, *texts), query, scope=["T0", "T1", "T2"]).collect()
    want = {(i, m.start(), m[0]) for i, t in enumerate(texts) for m in re.finditer(parsed.pattern, t, parsed.flags)}
    assert {(r["bucket_id"], r["master_offset"], r["match"]) for r in rows} == want


def test_alternatives_are_not_narrowed_by_a_run(spark):
    rows = search.search(sources(spark, "abc", "de", "xde"), "/abc|de/", scope=["T0", "T1", "T2"]).collect()
    assert len(rows) == 3
    with pytest.raises(QueryError):
        search.search(sources(spark, "abc"), "/abc|de/")


@pytest.mark.parametrize("negate", [False, True])
@pytest.mark.parametrize("distance", [0, 1, 5])
def test_proximity_against_all_pairs(spark, distance, negate):
    rng = random.Random(distance)
    texts = ["".join(rng.choice("abx ") for _ in range(rng.randrange(30))) for _ in range(20)]
    got = {(r["bucket_id"], r["master_offset"]) for r in search.near(sources(spark, *texts), "ab", "xx", distance, negate).collect()}
    want = set()
    for i, t in enumerate(texts):
        left, right = ([p for p in range(len(t)) if t.startswith(q, p)] for q in ("ab", "xx"))
        for p in left:
            close = any(max(p - (q + 2), q - (p + 2), 0) <= distance for q in right)
            if close != negate:
                want.add((i, p))
    assert got == want


def test_postings_spell_the_query(spark):
    rng = random.Random(1)
    rows = sources(spark, *["".join(rng.choice("abc") for _ in range(rng.randrange(40))) for _ in range(15)])
    index = search.postings(rows)
    for query in ("abc", "abca", "aaaaa", "bcbcb"):
        got = {(r["bucket_id"], r["start"]) for r in search.intersect(index, query).collect()}
        assert got == {(r["bucket_id"], r["master_offset"]) for r in search.hits_of(rows, query).collect()}
    with pytest.raises(ValueError, match="three"):
        search.intersect(index, "ab")


def test_closeness_chain(spark):
    hits = spark.createDataFrame([(0, "T0", 0, "甲乙", "x", "丙"), (1, "T1", 0, "戊己", "x", "庚"), (2, "T2", 0, "甲乙", "x", "丁"), (3, "T3", 0, "甲", "x", "丁")], "bucket_id long, textid string, master_offset int, left string, match string, right string")
    chain = [r["bucket_id"] for r in search.closeness(hits, "x").orderBy("position").collect()]
    assert chain == [2, 0, 3, 1]
    with pytest.raises(ValueError, match="more than"):
        search.closeness(hits, "x", cap=3)


def test_filters_on_missing_dates_and_sections(spark):
    rows = spark.createDataFrame([(1, 100, "KR3ea"), (2, None, "KR3e"), (3, 300, None)], "id int, index_date int, section string")
    assert [r["id"] for r in search.filtered(rows, after=99).collect()] == [1, 3]
    assert [r["id"] for r in search.filtered(rows, before=300).collect()] == [1]
    assert [r["id"] for r in rows.where(search.matches_section(F.col("section"), ["KR3e"])).collect()] == [1, 2]
    assert [r["id"] for r in rows.where(search.matches_section(F.col("section"), ["KR3e"], False)).collect()] == [2]
    assert rows.where(search.matches_section(F.col("section"), [])).count() == 3


# -- intervals -------------------------------------------------------------------


@pytest.mark.parametrize(("spans", "want"), [([(0, 10), (10, 20)], [(0, 20)]), ([(20, 30), (0, 10)], [(0, 10), (20, 30)]), ([(0, 5), (3, 4)], [(0, 5)]), ([(0, 9), (1, 2), (8, 12), (13, 14)], [(0, 12), (13, 14)])])
def test_merge(spark, spans, want):
    rows = spark.createDataFrame([("k", *s) for s in spans], "k string, start int, end int")
    assert sorted((r["start"], r["end"]) for r in intervals.merged(rows, ["k"]).collect()) == want


def test_voices_contain_touch_or_miss(spark):
    ranges = spark.createDataFrame([(1, 0, 5, "root"), (1, 5, 10, "commentary"), (1, 10, 15, "root"), (1, 15, 20, "commentary"), (1, 0, 20, "all"), (2, 0, 3, "root")], "b int, r_start int, r_end int, name string")
    hits = spark.createDataFrame([(1, 1, 3), (1, 4, 6), (2, 2, 5), (2, 7, 8)], "b int, start int, end int")
    got = {(r["b"], r["start"]): (r["voice"], r["voice_stack"]) for r in intervals.classify(hits, ranges, ["b"]).collect()}
    assert got == {(1, 1): ("root", ["all", "root"]), (1, 4): ("all", ["all"]), (2, 2): ("mixed", []), (2, 7): ("none", [])}


def test_numbers_are_global_and_pages_follow(spark):
    rows = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v")).repartition(7)
    got = sorted((r["v"], r["position"]) for r in order.numbered(rows, "v").collect())
    assert got == [(i, i + 1) for i in range(1000)]
    assert [r["v"] for r in order.page(rows, ["v"], 20, 5).collect()] == [20, 21, 22, 23, 24]
    assert order.over_cap(rows, 999) and not order.over_cap(rows, 1000)


def test_stratified_sample_meets_its_quotas(spark):
    rows = spark.range(1000).select("id", F.when(F.col("id") < 900, "a").when(F.col("id") < 995, "b").otherwise("c").alias("s"))
    counts = {r["s"]: r["n"] for r in order.stratified(rows, "s", "id", 50, 1).groupBy("s").agg(F.count("*").alias("n")).collect()}
    assert counts == {"a": 44, "b": 4, "c": 1} or sum(counts.values()) == 50
    assert counts["c"] >= 1


# -- witnesses -------------------------------------------------------------------


def test_witness_reading_and_span(spark):
    master = sources(spark, "專然未嘗不盡天下之議", "alpha beta")
    readings = spark.createDataFrame([(0, 3, 1, "SBCK", "甞"), (1, 0, 2, "X", "A"), (1, 1, 3, "X", "skipped"), (1, 6, 1, "X", "BB")], "bucket_id long, offset int, length int, witness string, form string")
    made = witness.derive(master, readings)
    texts = {r["witness"]: r["text"] for r in made.collect()}
    assert texts == {"SBCK": "專然未甞不盡天下之議", "X": "Apha BBeta"}
    hit = witness.hits(made.where("witness = 'SBCK'"), master, "甞不盡").first()
    assert (hit["master_offset"], hit["master_length"], hit["match"], hit["matched_text"]) == (3, 3, "嘗不盡", "甞不盡")
    assert witness.hits(made, master, "天下").count() == 0
    spans = made.where("witness = 'X'").select(*[witness.to_master(F.col("segments"), F.lit(a), F.lit(b)).alias(f"s{a}_{b}") for a, b in ((0, 1), (1, 3), (5, 6), (6, 8), (3, 3), (99, 100))]).first()
    assert [tuple(s) for s in spans] == [(0, 2), (2, 2), (6, 1), (6, 2), (4, 0), (0, 0)]


# -- slices and edits ------------------------------------------------------------

MARKED = "k int, text string, markers array<struct<offset:int,length:int,type:string,id:string,content:string>>"


def marked(spark, text, *at):
    return spark.createDataFrame([(1, text, [(o, 1, "m", f"m{o}", f"<{o}>") for o in at])], MARKED)


def test_slices_rebase_markers(spark):
    row = slices.by_offset(marked(spark, "0123456789", 2, 5, 8), F.lit(2), F.lit(6)).first()
    assert row["slice"] == "234567"
    assert [(m["id"], m["offset"]) for m in row["slice_markers"]] == [("m2", 0), ("m5", 3)]
    assert slices.by_offset(marked(spark, "0123"), F.lit(2), F.lit(6)).first()["slice"] is None
    for first, second in (("m2", "m5"), ("m5", "m2")):
        assert slices.between_markers(marked(spark, "0123456789", 2, 5), first, second).first()["slice"] == "234"


EDITS = "array<struct<start:int,delete:int,insert:string>>"


@pytest.mark.parametrize(
    ("span", "edit", "want"),
    [((2, 3), (2, 0, "XY"), (4, 3, False)), ((2, 3), (5, 0, "XY"), (2, 3, False)), ((5, 2), (1, 3, ""), (2, 2, False)), ((2, 3), (3, 0, "X"), (2, 3, True)), ((2, 3), (4, 3, ""), None), ((2, 3), (0, 0, "\U00020000新"), (4, 3, False))],
)
def test_content_spans_move_or_conflict(spark, span, edit, want):
    row = spark.createDataFrame([(*span, [edit])], f"s int, n int, e {EDITS}").select(slices.rebase(F.col("s"), F.col("n"), F.col("e")).alias("v")).first()["v"]
    assert row["conflict"] if want is None else tuple(row) == want


@pytest.mark.parametrize("seed", range(6))
def test_deletion_against_brute_force(spark, seed):
    rng = random.Random(seed)
    text = "".join(rng.choice("abcdefgh甲\U00020000") for _ in range(40))
    at = sorted(rng.sample(range(41), 8))
    spans = [tuple(sorted(rng.sample(range(41), 2))) for _ in range(3)]
    rows = marked(spark, text, *at).withColumn("spans", F.array(*[F.struct(F.lit(a).alias("start"), F.lit(b).alias("end")) for a, b in spans]))
    got = slices.delete_spans(rows).first()
    gone = {i for a, b in spans for i in range(a, b)}
    assert got["text"] == "".join(c for i, c in enumerate(text) if i not in gone)
    assert [(m["id"], m["offset"]) for m in got["markers"]] == [(f"m{o}", sum(i not in gone for i in range(o))) for o in at if o not in gone]


def test_replay_split_merge_and_punctuation(spark):
    row = spark.createDataFrame([("abcdef", [(1, 2, "XYZ"), (0, 1, "")])], f"t string, e {EDITS}").select(slices.replay(F.col("t"), F.col("e")).alias("v")).first()
    assert row["v"] == "XYZdef"
    rows = marked(spark, "0123456789", 2, 5, 8)
    halves = slices.split_at(rows, F.lit(5)).orderBy("part").collect()
    assert [(h["text"], [m["offset"] for m in h["markers"]]) for h in halves] == [("01234", [2]), ("56789", [0, 3])]
    whole = slices.merge_sections(slices.split_at(rows, F.lit(5)), ["k"], "part").first()
    assert whole["text"] == "0123456789" and [m["offset"] for m in whole["markers"]] == [2, 5, 8]
    assert slices.with_punctuation(rows, ("m",)).first()["punctuated"] == "01<2>234<5>567<8>89"


def test_pins_fail_alone(spark):
    corpus = spark.createDataFrame([("A", "甲乙丙丁", "h1")], "textid string, text string, hash string")
    pins = spark.createDataFrame([(1, "A", "h1", 1, 2), (2, "A", "old", None, None), (3, "A", None, 3, 9), (4, "B", "h", None, None)], "pin int, textid string, hash string, offset int, length int")
    got = {r["pin"]: (r["text"], r["verified"], r["error"]) for r in slices.fulfil(pins, corpus).collect()}
    assert got == {1: ("乙丙", True, None), 2: ("甲乙丙丁", False, None), 3: (None, True, "out_of_range"), 4: (None, None, "not_found")}


def test_selection_kinds(spark):
    rows = spark.createDataFrame([("T", 1, "body", "0123456789", []), ("T", 2, "body", "xyz", [])], "textid string, juan_seq int, bucket string, " + MARKED.split(", ", 1)[1])
    assert slices.select(rows, {"juan": 1, "offset": 2, "length": 3}).first()["slice"] == "234"
    assert slices.select(rows, {"juan": 2}).first()["slice"] == "xyz"
    toc = spark.createDataFrame([("T", 1, "body", "h1", 4, 6)], "textid string, juan_seq int, bucket string, marker_id string, span_start int, span_end int")
    assert slices.select(rows, {"toc": "h1"}, toc).first()["slice"] == "45"
    with pytest.raises(ValueError, match="not several"):
        slices.select(rows, {"toc": "h1", "offset": 1, "length": 2})


def test_marker_ids_fill_blanks(spark):
    rows = spark.createDataFrame([(1, "p", "x-p-4", 0), (1, "p", "", 1), (1, "p", None, 2), (1, "q", "", 3)], "k int, type string, id string, offset int")
    got = [r["id"] for r in slices.assign_ids(rows, ["k"], F.lit("x"), ["offset"]).orderBy("offset").collect()]
    assert got == ["x-p-4", "x-p-5", "x-p-6", "x-q-1"]


# -- characters, voices, annotations ------------------------------------------------


def test_canonical_and_back(spark):
    rows = sources(spark, "説甞説", "plain").withColumnRenamed("bucket_id", "k")
    mapping = {"説": "說", "甞": "嘗"}
    marks = chars.substitutions(rows, "k", mapping).groupBy("k").agg(F.sort_array(F.collect_list(F.struct("offset", "content", "replacement"))).alias("marks"))
    changed = rows.join(marks, "k").withColumn("now", chars.canonical(F.col("text"), mapping))
    row = changed.select("text", "now", chars.reverted(F.col("now"), F.col("marks")).alias("back"), chars.reverted(F.col("text"), F.col("marks")).alias("bad")).first()
    assert (row["now"], row["back"], row["bad"]) == ("說嘗說", "説甞説", None)
    charset = spark.createDataFrame([(c,) for c in "說嘗plain"], "char string")
    assert chars.unmapped(rows, charset, mapping).count() == 0
    with pytest.raises(ValueError, match="no canonical form"):
        chars.strict(rows, charset.where("char <> 'p'"), mapping)
    problems = chars.check_mapping(spark.createDataFrame([("嘗", "說"), ("x", "y"), ("x", "說")], "source string, replacement string"), charset)
    assert {(r["char"], r["problem"]) for r in problems.collect()} == {("嘗", "source is canonical"), ("y", "replacement is not canonical"), ("x", "repeated source")}


def test_lemma_repeats_go_round(spark):
    rows = spark.createDataFrame([("v1", "甲乙", 10, "丨x丨丨")], "voice string, lemma string, start int, text string")
    assert sorted((r["position"], r["replacement"]) for r in chars.lemma_repeats(rows).collect()) == [(10, "甲"), (12, "乙"), (13, "甲")]


def test_survey_is_linear_and_right(spark):
    text = "甲乙丙丁戊" * 40_000
    rows = {r["char"]: (r["n"], r["codepoint"]) for r in chars.survey(sources(spark, text, "甲\U00105001", "")).collect()}
    assert rows["甲"] == (40_001, ord("甲")) and rows["\U00105001"] == (1, 0x105001)
    assert chars.private_use(sources(spark, "甲\U00105001"), "bucket_id").first()["n"] == 1


MARKS = "bucket_id long, offset int, ord int, sign string, text_length int"


def test_paren_voices(spark):
    def derive(*marks, length=20):
        rows = voices.from_parens(spark.createDataFrame([(1, o, i, s, length) for i, (o, s) in enumerate(marks)], MARKS)).collect()
        return sorted(((r["start"], r["end"], r["name"] or r["problem"]) for r in rows))

    assert derive((2, "("), (8, ")")) == [(2, 8, "note")]
    assert derive((2, "("), (8, ")"), (8, "("), (9, ")")) == [(2, 9, "note")]
    assert derive((2, "("), (4, "("), (8, ")"), (9, ")")) == [(2, 8, "note"), (4, 4, "nested"), (9, 9, "stray")]
    assert derive((2, "("), (30, ")")) == [(2, 2, "unmatched")]


def test_indent_voices_respond(spark):
    lines = [(1, 0, 0, 5, 0, False), (1, 1, 5, 10, 2, False), (1, 2, 10, 12, 2, False), (1, 3, 12, 15, 0, False), (1, 4, 15, 20, 2, False)]
    rows = voices.from_indent(spark.createDataFrame(lines, "bucket_id long, line int, start int, end int, depth int, listing boolean"), {2: "commentary"}).orderBy("start").collect()
    assert [(r["start"], r["end"], r["name"], r["id"], r["responds_to"]) for r in rows] == [(0, 5, "root", "r1", None), (5, 12, "commentary", "c1", "r1"), (12, 15, "root", "r2", None), (15, 20, "commentary", "c2", "r2")]


def test_voice_problems(spark):
    ranges = spark.createDataFrame([(1, 0, 5, "a", "1", None), (1, 4, 8, "a", "2", "9"), (1, 0, 99, "b", "3", "1"), (1, 0, 1, "", "4", None)], "bucket_id long, start int, end int, name string, id string, responds_to string")
    found = voices.problems(ranges, spark.createDataFrame([(1, 20)], "bucket_id long, chars int"))
    assert {(r["id"], r["rule"]) for r in found.collect()} == {("1", "overlap"), ("2", "dangling"), ("3", "bounds"), ("4", "name")}


def test_dictionary_voices(spark):
    rows = voices.from_dictionary(spark.createDataFrame([(1, "甲曰第一乙丙云第二丁第三", [0, 4, 9])], "bucket_id long, text string, heads array<int>")).collect()
    assert [(r["start"], r["end"], r["name"], r["problem"]) for r in rows] == [(0, 1, "lemma", None), (1, 4, "gloss", None), (4, 6, "lemma", None), (6, 9, "gloss", None), (9, 10, "lemma", None), (10, 12, "gloss", "no cue")]


def test_translation_rows(spark):
    texts = spark.createDataFrame([("T", "子曰學而時習之")], "textid string, text string")
    marks = spark.createDataFrame([("T", 0, "s1"), ("T", 2, "s2"), ("T", 7, "s3")], "textid string, offset int, corresp string")
    segments = annotations.source_segments(texts, marks, ["textid"])
    assert sorted((r["start"], r["end"]) for r in segments.collect()) == [(0, 2), (2, 7), (7, 7)]
    said = spark.createDataFrame([("T", ["s1"], 0, "The master said"), ("T", ["s2", "s3"], 1, "to learn")], "textid string, corresp array<string>, ord int, text string")
    rows = {r["corresp"]: (r["translation"], r["continued"]) for r in annotations.aligned(segments, said, ["textid"]).collect()}
    assert rows == {"s1": ("The master said", False), "s2": ("to learn", False), "s3": ("", True)}


def test_annotation_listing(spark):
    raw = spark.createDataFrame([("a", "T", 1, "m", "s1", None, "5", None, "2"), ("b", "T", 1, "m", "s1", None, "x", None, None), ("c", "T", 1, "m", None, None, "5", None, None), ("d", "T", 1, "m", "s1", None, "5", "rejected", None), ("e", "T", 1, "m", None, "d", "-1", "accepted", "x")], "id string, textid string, seq int, marker_id string, sense_id string, device_id string, offset string, curation_state string, rating string")
    assert {(r["id"], r["offset"], r["rating"]) for r in annotations.located(raw).collect()} == {("a", 5, 2), ("e", -1, None)}
    old = spark.createDataFrame([("c1", 1), ("c2", 2), ("c3", 3)], "cid string, v int")
    new = spark.createDataFrame([("c2", 9, None), ("c4", 4, "c3")], "cid string, v int, supersedes string")
    assert {(r["cid"], r["v"]) for r in annotations.merged_by_content(old, new).collect()} == {("c1", 1), ("c2", 9), ("c4", 4)}
