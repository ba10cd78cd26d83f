from pyspark.sql import functions as F

from lectern.functions import labels
from lectern.operators import bundles

BUCKET = "textid string, juan_seq int, bucket string, text string, markers array<struct<offset:int,type:string,id:string,content:string>>"


def buckets(spark, *rows):
    return spark.createDataFrame([(*r[:4], [(o, t, i, c) for o, t, i, c in r[4]]) for r in rows], BUCKET)


def test_contents_and_sections(spark):
    rows = buckets(spark, ("T", 1, "body", "0123456789", [(0, "head", "h1", "one"), (2, "x", "m", ""), (4, "head", "h2", "two"), (5, "x", "n", "")]), ("T", 2, "body", "abc", []))
    toc = bundles.contents(rows)
    assert [(r["marker_id"], r["span_start"], r["span_end"]) for r in toc.orderBy("span_start").collect()] == [("h1", 0, 4), ("h2", 4, 10)]
    cut = bundles.sections(rows, toc).orderBy("juan_seq", "start").collect()
    assert [(r["label"], r["text"], [(m["id"], m["offset"]) for m in r["markers"]]) for r in cut] == [("one", "0123", [("h1", 0), ("m", 2)]), ("two", "456789", [("h2", 0), ("n", 1)]), ("", "abc", [])]


def test_front_moves_to_an_empty_body(spark):
    rows = buckets(spark, ("T", 1, "front", "abc", [(1, "x", "f", "")]), ("T", 1, "body", "", [(0, "x", "b", "")]), ("T", 2, "front", "abc", []), ("T", 2, "body", "def", []))
    got = {(r["juan_seq"], r["bucket"]): (r["text"], [(m["id"], m["offset"]) for m in r["markers"]]) for r in bundles.front_to_empty_body(rows).collect()}
    assert got == {(1, "body"): ("abc", [("f", 1), ("b", 3)]), (2, "front"): ("abc", []), (2, "body"): ("def", [])}


def test_a_section_moves(spark):
    rows = buckets(spark, ("T", 1, "body", "0123456789", [(1, "x", "a", ""), (4, "x", "b", ""), (8, "x", "c", "")]))
    got = {r["part"]: (r["text"], [(m["id"], m["offset"]) for m in r["markers"]]) for r in bundles.moved_section(rows, 3, 6).collect()}
    assert got == {"stays": ("0126789", [("a", 1), ("c", 5)]), "moves": ("345", [("b", 1)])}


def test_variants_by_alignment(spark):
    rows = spark.createDataFrame([(1, "甲乙丙丁戊", "甲己庚丁戊辛")], "k int, master string, witness string")
    assert [tuple(r)[1:] for r in bundles.aligned_variants(rows, "k").orderBy("offset").collect()] == [(1, 1, "乙", "己"), (2, 1, "丙", "庚"), (5, 0, "", "辛")]
    mapped = bundles.mapped_offsets(rows.withColumn("at", F.array(*[F.lit(i) for i in (0, 2, 3, 5, 9)])), "at").first()["mapped"]
    assert mapped == [0, 1, 3, 5, 5]


def test_identifiers_editions_and_ids(spark):
    manifests = spark.createDataFrame([("T", {"alt": ["a"]}), ("U", None)], "textid string, identifiers map<string,array<string>>")
    more = spark.createDataFrame([("T", "alt", "a"), ("T", "alt", "b"), ("T", "new", "n")], "textid string, kind string, value string")
    got = {r["textid"]: r["identifiers"] for r in bundles.with_identifiers(manifests, more).collect()}
    assert got == {"T": {"alt": ["a", "b"], "new": ["n"]}, "U": {}}
    have = spark.createDataFrame([("A", "old")], "short string, label string")
    assert {tuple(r) for r in bundles.added_editions(have, spark.createDataFrame([("A", "new"), ("B", "x")], "short string, label string"), ["short"]).collect()} == {("A", "old"), ("B", "x")}
    ids = spark.createDataFrame([("T_SBCK_003-1a",), ("none",)], "marker_id string").select(bundles.marker_parts().alias("p")).collect()
    assert [None if r["p"] is None else tuple(r["p"]) for r in ids] == [("SBCK", 3), None]


def test_parallels_page(spark):
    rows = spark.createDataFrame([("body", 0, 10, "R", 5, 15), ("body", 20, 24, "R", 10, 14), ("body", 30, 60, "S", 0, 30), ("front", 0, 5, "R", 0, 5)], "bucket string, start int, end int, remote_textid string, remote_start int, remote_end int")
    page, bounds = bundles.parallels_page(rows, "body", (0, 50), (5, None))
    assert tuple(bounds.first()) == (4, 30)
    assert {(r["remote_textid"], r["start"]) for r in page.collect()} == {("R", 0), ("S", 30)}
    page, _ = bundles.parallels_page(rows, "body", remote="R")
    assert [(r["local_gap"], r["remote_gap"], r["overlap_length"]) for r in page.orderBy("start").collect()] == [(None, None, 14), (10, 0, 14)]
    assert {tuple(r) for r in bundles.remote_options(rows).collect()} == {("R", 3, 19), ("S", 1, 30)}


def test_links_after_edits(spark):
    links = spark.createDataFrame([("A", 5, 2), ("A", 1, 3), ("B", 1, 1)], "textid string, offset int, length int")
    edits = spark.createDataFrame([("A", [(2, 1, "xyz")])], "textid string, splices array<struct<start:int,delete:int,insert:string>>")
    assert sorted((r["textid"], r["offset"]) for r in bundles.rebased_links(links, edits).collect()) == [("A", 7), ("B", 1)]
    meta = spark.createDataFrame([("min_length", "24")], "key string, value string")
    assert bundles.reusable(meta, {"min_length": "24"}) and not bundles.reusable(meta, {"min_length": "30"})


KNOWN = frozenset({"N", "NP", "V", "vt", "OBJ"})


def test_label_tokens():
    assert [t[:2] for t in labels.tokens("vt+N{OBJ}...NPx2", KNOWN)] == [("atom", "vt"), ("connector", "+"), ("atom", "N"), ("open", "{"), ("atom", "OBJ"), ("close", "}"), ("ellipsis", "..."), ("atom", "NP"), ("unknown", "x"), ("number", "2")]


def test_label_diagnostics(spark):
    kinds = lambda label: [d[1] for d in labels.diagnose(label, KNOWN)]
    assert kinds("vt+N") == [] and kinds("vt＋N") == ["fullwidth-punctuation", "non-ascii"]
    assert kinds("(N") == ["unmatched-open"] and kinds("N]") == ["unmatched-close"] and kinds("N _") == ["whitespace", "underscore"]
    records = spark.createDataFrame([("1", "N", None), ("2", "N", None), ("3", "q", ["unknown-token"]), ("4", None, None)], "uuid string, code string, accept array<string>")
    assert {(r["uuid"], r["kind"]) for r in labels.lint(records, KNOWN).collect()} == {("2", "duplicate-code"), ("4", "missing-code")}


def test_display_labels(spark):
    rows = spark.createDataFrame(
        [("word", {"orth": ["乞"]}, "BEG", None, None), ("word", {}, "BEG", None, None), ("sense", {"definition": ["ask"]}, None, "乞: BEG", 2), ("sense", {"definition": [" ", "ask"]}, None, None, None), ("graph", {"standardised": ["x"]}, None, None, None), ("word-relation", {"rel_type": ["Conv"], "left": ["a"], "right": ["b"]}, None, None, None), ("other", {}, None, None, None)],
        "kind string, fields map<string,array<string>>, concept string, word string, n int",
    )
    got = [r[0] for r in rows.select(labels.display(F.col("kind"), F.col("fields"), F.col("concept"), F.col("word"), F.col("n"))).collect()]
    assert got == ["乞: BEG", "BEG", "乞: BEG (sense 2)", "ask", "x (standardised)", "Conv: a ↔ b", None]


def test_info_and_opening(spark):
    have = spark.createDataFrame([("KR1a0001",), ("KR1a0002",), ("X",)], "textid string")
    juans = spark.createDataFrame([("KR1a0001",), ("KR1a0001",)], "textid string")
    assert {tuple(r) for r in bundles.corpus_info(have, {"juan": juans}).collect()} == {("section", "KR1a", 2), ("section", "other", 1), ("table", "juan", 2)}
    assert {tuple(r) for r in bundles.bundle_counts(have, {"juans": juans}).collect()} == {("KR1a0001", 2), ("KR1a0002", 0), ("X", 0)}
    marked = "k int, text string, markers array<struct<offset:int,type:string,extras:map<string,string>>>"
    rows = spark.createDataFrame([(1, "abcdef", [(0, "head", {"level": "1"}), (2, "head", {"level": "2"}), (4, "indent", {})]), (2, "abc", [])], marked)
    assert [(r["k"], r["part"], r["text"]) for r in bundles.split_front(rows).orderBy("k", "part").collect()] == [(1, 0, "ab"), (1, 1, "cdef"), (2, 0, "abc"), (2, 1, "")]


def test_harvest(spark):
    import json

    from lectern.operators import curation

    record = lambda offset, old=None: json.dumps({"text_id": "T", "anchor": {"marker_id": "T_X_002-m", "offset": offset}, "supersedes": old})
    listing = spark.createDataFrame([("d", "u1", "c1", record(1)), ("d", "u2", "c2", record(2, "c0")), ("d", "u3", "c3", record("x")), ("d", "u4", "c4", record(4))], "did string, uri string, cid string, record string")
    markers = spark.createDataFrame([("T", 2, "T_X_002-m", "body", 10), ("T", 2, "T_X_002-m", "back", 0)], "textid string, seq int, marker_id string, bucket string, marker_offset int")
    judged = spark.createDataFrame([("u1", "me", "e", "accepted", 2, 1), ("u4", "me", "e", "rejected", 0, 1)], "target string, author string, did string, state string, rating int, created long")
    archive = spark.createDataFrame([("u0", "c0", "T", 2, "body", 0, "proposed", 0, None), ("u9", "c9", "T", 2, "body", 0, "proposed", 0, None)], "uri string, cid string, textid string, seq int, bucket string, bucket_offset int, state string, rating int, supersedes string")
    got = {(r["cid"], r["bucket"], r["bucket_offset"], r["state"], r["rating"]) for r in curation.harvested(listing, markers, judged, archive, ["e"]).collect()}
    assert got == {("c9", "body", 0, "proposed", 0), ("c1", "body", 11, "accepted", 2), ("c2", "body", 12, "proposed", 0)}
