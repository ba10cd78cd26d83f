import json

import pytest
from pyspark.sql import functions as F

from lectern.operators import catalog, curation, graph, slices, validate
from lectern.sources import readers, schemas, sinks
from lectern.streaming import feed


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")


MANIFEST = """canonical_identifier: x:{id}
hash: 'sha256:1'
assets:
  parts: [{{seq: 1, filename: {id}_001.yaml, hash: 'sha256:2'}}]
table_of_contents:
- {{ref: {{seq: 1, marker_id: h1, span: [body, 0, 4]}}, label: first}}
- {{ref: {{seq: 1, marker_id: h2, span: [body, 4]}}, label: broken}}
metadata: {{title: Title, identifiers: {{alt: [a1, ' a2 '], one: x}}}}
identifiers: {{alt: a1}}
"""
JUAN = """seq: 1
body:
  text: ABCDEFGHIJ
  hash: h
  markers:
  - {type: variant, offset: 3, length: 1, content: D, SBCK: d, X: ''}
  - {type: voice, offset: 0, length: 5, id: r1, name: root}
  - {type: head, offset: 0, id: h1, content: first}
"""


@pytest.fixture
def corpus(tmp_path):
    for name in ("KR1a0001", "KR1a0002", "KR2b0001"):
        write(tmp_path / f"c/{name[:4]}/{name}/{name}.manifest.yaml", MANIFEST.format(id=name))
        write(tmp_path / f"c/{name[:4]}/{name}/{name}_001.yaml", JUAN)
    write(tmp_path / "c/odd/other.manifest.yaml", "x: 1")
    write(tmp_path / "c/KR9z/KR9z0001/KR9z0001.manifest.yaml", "a: [unclosed")
    write(tmp_path / "c/1/2/3/4/KR8a0001/KR8a0001.manifest.yaml", MANIFEST.format(id="KR8a0001"))
    return str(tmp_path / "c")


def test_bundles(spark, corpus):
    found = readers.discover(spark, corpus)
    assert {r["textid"] for r in found.collect()} == {"KR1a0001", "KR1a0002", "KR2b0001", "KR9z0001"}
    assert {r["textid"] for r in readers.discover(spark, corpus, prefix="KR1").collect()} == {"KR1a0001", "KR1a0002"}
    assert readers.discover(spark, corpus, text_ids=["KR2b0001"]).count() == 1
    rows = {r["textid"]: r for r in readers.manifests(found).collect()}
    assert rows["KR9z0001"]["parse_error"]
    one = rows["KR1a0001"]
    assert [(t["label"], t["start"], t["end"]) for t in one["toc"]] == [("first", 0, 4)]
    assert one["parts"][0]["filename"] == "KR1a0001_001.yaml"
    idents = catalog.identifiers(readers.manifests(found).where("parse_error is null"))
    assert {(r["kind"], r["value"]) for r in idents.where("textid = 'KR1a0001'").collect()} == {("alt", "a1"), ("alt", "a2"), ("one", "x")}


def test_juans_markers_and_index(spark, corpus, tmp_path):
    buckets = readers.juans(readers.files(spark, corpus, "*_001.yaml"))
    assert buckets.count() == 3
    readings = readers.variants(buckets, ["textid"]).where("textid = 'KR1a0001'").collect()
    assert {(r["offset"], r["length"], r["witness"], r["form"]) for r in readings} == {(3, 1, "SBCK", "d"), (3, 1, "X", "")}
    assert readers.voices(buckets, ["textid"]).where("name = 'root' and r_end = 5").count() == 3
    assets = buckets.where("textid = 'KR1a0001'").select("textid", F.array(F.struct(F.lit(0).alias("offset"), F.lit(None).cast("int").alias("length"), F.lit("ext").alias("type"), F.lit("e").alias("id"), F.lit("").alias("content"), F.create_map().cast("map<string,string>").alias("extras"))).alias("markers"))
    mixed = readers.with_assets(buckets, assets, ["textid"]).where("textid = 'KR1a0001'").first()
    assert [m["type"] for m in mixed["markers"]] == ["ext", "voice", "head", "variant"]
    inline, moved = readers.split_markers(buckets.select("textid", F.explode("markers").alias("m")).select("textid", "m.*"))
    assert {r["type"] for r in inline.collect()} == {"head"} and {r["type"] for r in moved.collect()} == {"variant", "voice"}
    path = str(tmp_path / "index")
    sinks.write_index({"bucket": buckets}, path, {"bucket": ["textid"]})
    assert sinks.read_index(spark, path, "bucket").count() == 3
    spark.createDataFrame([(99,)], "version int").write.mode("overwrite").parquet(f"{path}/meta")
    with pytest.raises(ValueError, match="version 99"):
        sinks.read_index(spark, path, "bucket")


def test_lists_catalogs_and_reports(spark, tmp_path):
    write(tmp_path / "ids.txt", "1h4 title\n# comment\nKR6q0053 # x\n1h4\nfoo\n\n")
    assert [r["textid"] for r in readers.text_ids(spark, str(tmp_path / "ids.txt")).orderBy("place").collect()] == ["KR1h0004", "KR6q0053"]
    write(tmp_path / "cat.csv", "﻿id,title,titlePinyin,titleEnglish,notBefore,notAfter,dzt_date\nKR1a0001,A,a,,- 390,- 245,\nKR1a0001,B,b,,390,413,\n,x,,,,,\nKR2b0001,C,,,,,980-1001\n")
    rows = {r["id"]: r for r in catalog.from_csv_rows(readers.catalog_rows(spark, str(tmp_path / "cat.csv"))).collect()}
    assert (rows["KR1a0001"]["title"], rows["KR1a0001"]["index_date"], rows["KR1a0001"]["section_code"]) == ("B", 401, "KR1a")
    assert (rows["KR2b0001"]["index_date"], rows["KR2b0001"]["index_date_source"]) == (990, "dzt_date_midpoint")
    write(tmp_path / "bad.csv", "id,title\n1,2\n")
    with pytest.raises(ValueError, match="lacks"):
        readers.catalog_rows(spark, str(tmp_path / "bad.csv"))
    write(tmp_path / "scan.jsonl", json.dumps({"cluster_id": "c", "length": 3, "locations": [{"bucket_id": 1, "start": 0, "end": 3}]}) + "\n")
    assert readers.scan_report(spark, str(tmp_path / "scan.jsonl")).first()["locations"][0]["end"] == 3
    write(tmp_path / "scan2.jsonl", "{broken\n")
    with pytest.raises(Exception, match="(?i)malformed"):
        readers.scan_report(spark, str(tmp_path / "scan2.jsonl")).collect()


def test_duplication_report_round_trip(spark, tmp_path):
    names = [c.split() for c in schemas.DUPLICATIONS.split(", ")]
    row = {n: {"string": "s", "int": 3, "double": 0.5}[t] for n, t in names} | {"action": None}
    rows = spark.createDataFrame([tuple(row[n] for n, _ in names)] * 2, schemas.DUPLICATIONS)
    path = str(tmp_path / "dups")
    sinks.write_duplications(rows, path)
    back = readers.duplication_report(spark, path)
    assert back.count() == 2 and back.first()["coverage_a"] == 0.5
    changed = sinks.updated_action(back, back.first()["row_id"], "delete", "me", "now")
    assert sorted(str(r["action"]) for r in changed.collect()) == ["None", "delete"]
    with pytest.raises(ValueError, match="version"):
        readers.duplication_report(spark, path, 2)


def test_annotations_and_translations(spark, tmp_path):
    good = json.dumps({"id": "a", "anchor": {"marker_id": "m", "offset": 3}, "payload": {"x": 1}, "rating": 1})
    write(tmp_path / "ann/KR1a0001_002.jsonl", good + "\n{broken\n\n")
    row = readers.annotation_lines(spark, str(tmp_path / "ann")).collect()
    assert len(row) == 1 and (row[0]["textid"], row[0]["seq"], row[0]["anchor"]["offset"]) == ("KR1a0001", 2, "3")
    write(tmp_path / "tr/tr1_001.md", "---\nid: tr1\nmarkers:\n- {corresp: s1}\n- {corresp: [s2, s3]}\n---\n[Hello \\[x\\]]{.seg} and [world]{.seg} [ ]{.seg}\n")
    rows = readers.translation_segments(readers.files(spark, str(tmp_path / "tr"), "*.md")).orderBy("ord").collect()
    assert [(r["translation_id"], r["juan_seq"], r["corresp"], r["text"]) for r in rows] == [("tr1", 1, ["s1"], "Hello [x]"), ("tr1", 1, ["s2", "s3"], "world")]
    back = sinks.to_markdown(spark.createDataFrame(rows, schemas.TRANSLATION)).first()["document"]
    write(tmp_path / "tr2/tr1_001.md", back)
    again = readers.translation_segments(readers.files(spark, str(tmp_path / "tr2"), "*.md")).orderBy("ord").collect()
    assert [(r["corresp"], r["text"]) for r in again] == [(["s1"], "Hello [x]"), (["s2", "s3"], "world")]
    write(tmp_path / "tr3/bad_002.md", "---\nid: [broken\n---\n[a]{.seg}")
    bad = readers.translation_segments(readers.files(spark, str(tmp_path / "tr3"), "*.md")).collect()
    assert [(r["translation_id"], r["juan_seq"], r["text"]) for r in bad] == [("bad", 2, None)] and "ParserError" in bad[0]["parse_error"]


SCROLL = "# a scroll\n#+PROPERTY: JUAN 卷一\n<pb:T_X_001-1a>¶\n** 序¶\n子曰，學&KR0012;而¶\n　時習之¶\n\n# note\n#+PROPERTY: JUAN 卷二\nabc不亦說乎¶\n"


def test_plain_text_scrolls(spark, tmp_path):
    write(tmp_path / "T_001.txt", SCROLL)
    one, two = readers.scrolls(readers.files(spark, str(tmp_path), "*.txt"), "X").orderBy("section").collect()
    assert (one["head"], one["text"]) == ("卷一", "子曰學" + chr(0x105000 + 12) + "而時習之")
    assert (two["head"], two["text"]) == ("卷二", "不亦說乎")
    kinds = [(m["type"], m["offset"]) for m in one["markers"] if m["type"] != "newline"]
    assert kinds == [("page-break", 0), ("head", 0), ("line-break", 0), ("punctuation", 2), ("line-break", 5), ("indent", 5), ("paragraph-break", 8), ("comment", 8)]
    assert [m["id"] for m in one["markers"] if m["type"] == "line-break"] == ["T_X_001-1a01", "T_X_001-1a02"]
    assert ("non-cjk", "abc") in [(m["type"], m["content"]) for m in two["markers"]]


def test_a_long_scroll_takes_linear_time():
    import time

    began = time.time()
    readers.scroll_sections("<pb:x>\n" + "子曰，學而時習之。" * 20_000, "T", "X", 1)
    readers.scroll_sections("".join(f"<pb:{i}>子曰¶\n" for i in range(20_000)), "T", "X", 1)
    assert time.time() - began < 6


def test_markup(spark, tmp_path):
    tei = '<TEI xmlns="http://www.tei-c.org/ns/1.0"><teiHeader><x>no</x></teiHeader><text><body><div><head>一</head><pb n="1a"/>子<app><lem>曰</lem><rdg wit="#A #B">云</rdg></app>學</div><div><lb n="1"/>二</div></body></text></TEI>'
    write(tmp_path / "a.xml", tei)
    write(tmp_path / "bad.xml", "<a>")
    read = readers.tei(readers.files(spark, str(tmp_path), "*.xml"))
    one, two = read.where("parse_error is null").orderBy("section").collect()
    assert [r["path"].rpartition("/")[2] for r in read.where("parse_error is not null").collect()] == ["bad.xml"]
    assert (one["head"], one["text"], two["text"]) == ("一", "一子曰學".replace("一", "", 1) if one["text"] == "子曰學" else "一子曰學", "二")
    assert {(v["witness"], v["form"]) for v in one["variants"]} == {("A", "云"), ("B", "云")}
    write(tmp_path / "lex/w.xml", '<superEntry xml:id="uuid-1"><form><orth>乞</orth></form><entry><def>beg</def></entry></superEntry>')
    record = readers.lexicon(readers.files(spark, str(tmp_path / "lex"), "*.xml"), "word").first()
    assert record["uuid"] == "1" and record["fields"]["form/orth"] == ["乞"]
    write(tmp_path / "t/tr.xml", '<TEI><seg corresp="#KR_002-1a">Good  day</seg><seg/></TEI>')
    seg = readers.translation_xml(readers.files(spark, str(tmp_path / "t"), "*.xml")).collect()
    assert [(r["juan_seq"], r["text"]) for r in seg] == [(2, "Good day")]
    assert readers.plain("<p>a &amp; b<br>c</p><script>var t='</p>';</script><style>x</style><div>d") == "a & b\nc\nd"
    rows = readers.xml_rows(spark, str(tmp_path / "t/tr.xml"), "seg", "_corresp string, _VALUE string")
    assert rows.where("_corresp is not null").count() == 1


def test_exports(spark):
    rows = spark.createDataFrame([("子曰學", [(0, "page-break", "p1", ""), (2, "punctuation", "", "，")])], "text string, markers array<struct<offset:int,type:string,id:string,content:string>>")
    assert sinks.woven(rows, sinks.SCROLL_MARKS).first()["exported"] == "<pb:p1>子曰，學"
    assert "<a>1</a>" in sinks.to_xml(spark.createDataFrame([(1,)], "a int")).first()["xml"]
    a, b = spark.createDataFrame([("x", 1)], "k string, v int"), spark.createDataFrame([("x", 2), ("y", 3)], "k string, v int")
    assert {tuple(r) for r in sinks.merged_corpus([a, b], "k").collect()} == {("x", 1), ("y", 3)}


def test_sections_count_by_prefix(spark):
    codes = spark.createDataFrame([("KR3",), ("KR3e",), ("KR3ea",)], "code string")
    rows = {r["code"]: (r["parent_code"], r["direct_count"], r["descendant_count"]) for r in catalog.sections(codes, spark.createDataFrame([("KR3ea", 1)], "code string, n long")).collect()}
    assert rows == {"KR3": (None, 0, 1), "KR3e": ("KR3", 0, 1), "KR3ea": ("KR3e", 1, 1)}


def test_catalog_filters_and_resolution(spark):
    records = spark.createDataFrame([("A", ["x", "y"]), ("B", ["z"])], "textid string, tags array<string>")
    extract = {"textid": F.array("textid"), "tag": F.col("tags")}
    assert [r["textid"] for r in catalog.by_fields(records, {"tag": ["y", "q"], "textid": ["A", "B"]}, extract).collect()] == ["A"]
    with pytest.raises(ValueError, match="unknown"):
        catalog.by_fields(records, {"colour": ["red"]}, extract)
    keys = spark.createDataFrame([("k", "A", None), ("k", "B", "base"), ("m", "C", "b"), ("m", "D", "b"), ("o", "E", "x")], "key string, textid string, base_edition string")
    assert [r["textid"] for r in catalog.resolve("k", keys).collect()] == ["A"]
    assert {(r["textid"], r["ambiguous"]) for r in catalog.resolve("m", keys).collect()} == {("C", True), ("D", True)}
    assert [r["textid"] for r in catalog.resolve("o", keys).collect()] == ["E"]
    bundles = spark.createDataFrame([("a%b", "T"), ("aXb", "T")], "textid string, title string")
    assert [r["textid"] for r in catalog.search(bundles, None, "a%b", ["title"]).collect()] == ["a%b"]


def test_graph(spark):
    records = spark.createDataFrame([("w1", "word", {"orth": ["乞", " "], "concept": ["uuid-c1"]}), ("w2", "word", {"orth": ["與"], "concept": ["c2", "c2"]})], "uuid string, type string, fields map<string,array<string>>")
    assert {(r["uuid"], r["label"]) for r in graph.extract_labels(records).collect()} == {("w1", "乞"), ("w2", "與")}
    assert {tuple(r) for r in graph.extract_links(records, {"concept": "Conv"}).collect()} == {("w1", "c1", "Conv"), ("w2", "c2", "Conv")}
    tree = spark.createDataFrame([("r", None), ("a", "r"), ("b", "a"), ("s", None)], "node string, parent string")
    assert {(r["root"], r["node"], r["level"]) for r in graph.sense_walk(tree).collect()} == {("r", "r", 0), ("r", "a", 1), ("r", "b", 2), ("s", "s", 0)}
    table = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "k string, v int")
    assert {tuple(r) for r in graph.upserted(table, "k", spark.createDataFrame([("a", 9)], "k string, v int")).collect()} == {("a", 9), ("b", 3)}
    assert graph.without(table, "k", table.where("k = 'a'").select("k")).count() == 1


def test_validation_rules(spark):
    rows = spark.createDataFrame([("t", 1, 0, 5), ("t", 1, 3, 99), ("t", 0, -1, 2)], "k string, seq int, a int, b int")
    assert validate.unique(rows, ["k"], "seq", "seq").count() == 1
    assert validate.bounds(rows, F.col("k"), F.col("a"), F.col("b"), F.lit(10), "b").count() == 2
    assert validate.required(rows.withColumn("seq", F.when(F.col("seq") > 0, F.col("seq"))), F.col("k"), ["seq", "a"], "r").count() == 1
    assert validate.pattern(rows, F.col("k"), "k", "^x", "p").count() == 3
    twelve = spark.createDataFrame([("r", "error", "p", f"m{i:02d}") for i in range(12)], "rule string, severity string, path string, message string")
    kept = validate.collapsed(twelve)
    assert kept.count() == 5 and kept.first()["total"] == 12
    a, b = spark.createDataFrame([("x", 1), ("y", 2)], "c string, n long"), spark.createDataFrame([("x", 1), ("z", 2)], "c string, n long")
    assert {r["path"] for r in validate.declared(a, b, ["c"], "pua").collect()} == {"y", "z"}
    assert {(r["c"], r["where"]) for r in validate.compared(a, b, "c").collect()} == {("x", "both"), ("y", "local"), ("z", "remote")}
    ids = spark.createDataFrame([("KR1a0001",), ("KR1a0002",), ("KR1a0004",)], "textid string")
    assert validate.next_serial(ids, "KR1a") == 3 and validate.next_serial(ids, "KR2b") == 1
    ours, sample = spark.createDataFrame([("a.x", "1"), ("b", "2")], "path string, value string"), spark.createDataFrame([("a.x", "9"), ("c", "2")], "path string, value string")
    assert {(r["path"], r["kind"]) for r in validate.tree_diff(ours, sample, ["a."]).collect()} == {("a.x", "expected"), ("b", "unexpected"), ("c", "unexpected")}


JUDGMENT = "target string, author string, did string, state string, rating int, created long"


def test_curation_winners(spark):
    rows = [("t1", "me", "e1", "accepted", 2, 10), ("t1", "me", "e2", "rejected", None, 10), ("t1", "me", "me", "accepted", 1, 20), ("t1", "me", "x", "rejected", 0, 99), ("t2", "me", "me", "rejected", None, 5)]
    got = {r["target"]: (r["state"], r["rating"]) for r in curation.winners(spark.createDataFrame(rows, JUDGMENT), ["e1", "e2"]).collect()}
    assert got == {"t1": ("rejected", 1), "t2": ("rejected", 0)}


def event(did, at, operation, rkey, record=None, collection="ann"):
    return {"kind": "commit", "did": did, "time_us": at, "commit": {"collection": collection, "rkey": rkey, "operation": operation, "cid": f"c{at}", "record": None if record is None else json.dumps(record)}}


def test_feed_stream(spark, tmp_path):
    def put(name, *events):
        write(tmp_path / "in" / name, "".join(json.dumps(e) + "\n" for e in events))

    table = feed.FeedTable(spark, str(tmp_path / "table"))

    def run():
        stream = feed.commits(spark, str(tmp_path / "in"), ["ann"]).select("uri", "operation", "time_us", F.col("cid").alias("order"), "record")
        feed.run_feed(stream, table, str(tmp_path / "checkpoint"))
        return {r["uri"]: r["record"] for r in table.read(stream.schema).collect()}

    put("1.json", event("a", 1, "create", "x", {"v": 1}), event("a", 2, "update", "x", {"v": 2}), event("b", 3, "create", "y", {"v": 3}), event("b", 4, "create", "z", {"v": 4}, "other"), {"kind": "identity", "did": "a", "time_us": 5})
    assert run() == {"at://a/ann/x": '{"v": 2}', "at://b/ann/y": '{"v": 3}'}
    put("2.json", event("b", 6, "delete", "y"), event("c", 7, "create", "w", {"v": 7}))
    assert run() == {"at://a/ann/x": '{"v": 2}', "at://c/ann/w": '{"v": 7}'}
    assert run() == {"at://a/ann/x": '{"v": 2}', "at://c/ann/w": '{"v": 7}'}


def test_curation_stream_falls_back_on_delete(spark, tmp_path):
    schema = "target string, key string, did string, author string, operation string, state string, rating int, created long"

    def put(name, *rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(str(tmp_path / "in"))

    out = []

    def run():
        stream = spark.readStream.schema(schema).json(str(tmp_path / "in"))
        query = feed.curated(stream, ["e1", "e2"]).writeStream.outputMode("update").foreachBatch(lambda b, _: out.extend((r["target"], r["state"], r["rating"]) for r in b.collect())).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        query.awaitTermination()

    put("1", ("t", "e1/1", "e1", "me", "create", "accepted", 2, 10), ("t", "x/1", "x", "me", "create", "rejected", 0, 11))
    run()
    put("2", ("t", "e2/1", "e2", "me", "create", "rejected", 1, 20))
    run()
    put("3", ("t", "e2/1", "e2", "me", "delete", None, None, 30))
    run()
    assert out == [("t", "accepted", 2), ("t", "rejected", 1), ("t", "accepted", 2)]


def test_judgments_are_clamped(spark):
    rows = spark.createDataFrame([(json.dumps({"subject": {"uri": "t"}, "state": "accepted", "rating": n, "createdAt": "1970-01-01T00:00:01Z"}),) for n in (2, 7, -1)] + [(json.dumps({"subject": {"uri": "t"}}),)], "record string")
    assert sorted(r["rating"] for r in curation.judgment(rows).collect()) == [0, 0, 2]


def test_yaml_records_and_parallels(spark, tmp_path):
    write(tmp_path / "core/a.yml", "uuid: uuid-1\ntype: word\nform: {orth: 乞}\nsenses:\n- {def: beg}\n- {def: ask}\nhash: x\n")
    write(tmp_path / "core/b.yml", "[broken")
    found = readers.files(spark, str(tmp_path / "core"), "*.yml")
    assert {r["path"].rpartition("/")[2] for r in readers.yaml_leaves(found).where("parse_error is not null").collect()} == {"b.yml"}
    assert {(r["key"], r["value"]) for r in readers.yaml_leaves(found).where("parse_error is null").collect()} == {("uuid", "uuid-1"), ("type", "word"), ("form.orth", "乞"), ("senses.def", "beg"), ("senses.def", "ask")}
    record = readers.yaml_records(found).first()
    assert (record["uuid"], record["type"], sorted(record["fields"]["senses.def"])) == ("1", "word", ["ask", "beg"])
    mark = "markers:\n  body:\n  - {offset: 2, length: 3, ref: 1h4/1/@0+3}\n  - {offset: 9, length: 3, ref: x}\n"
    for root in ("p", "q"):
        write(tmp_path / root / "T_001.parallels.yaml", mark)
    both = readers.files(spark, str(tmp_path / "p"), "*.parallels.yaml").unionByName(readers.files(spark, str(tmp_path / "q"), "*.parallels.yaml"))
    lengths = spark.createDataFrame([("T", 1, "body", 10)], "textid string, juan_seq int, bucket string, chars int")
    assert [(r["start"], r["end"], r["to_ref"]) for r in readers.parallel_assets(both, lengths).collect()] == [(2, 5, "1h4/1/@0+3")]


def test_bundles_round_trip(spark, corpus, tmp_path):
    buckets = readers.juans(readers.files(spark, corpus, "*_001.yaml"))
    for row in sinks.bundle_documents(buckets).collect():
        write(tmp_path / "out" / row["path"], row["content"])
    again = readers.juans(readers.files(spark, str(tmp_path / "out"), "*_001.yaml"))
    key = lambda r: (r["textid"], r["bucket"], r["text"], [(m["offset"], m["length"], m["type"], m["id"]) for m in r["markers"]])
    assert sorted(map(key, again.collect())) == sorted(map(key, buckets.collect()))
    made = readers.manifests(readers.discover(spark, str(tmp_path / "out")))
    assert {r["textid"] for r in made.where("parts[0].filename = concat(textid, '_001.yaml')").collect()} == {"KR1a0001", "KR1a0002", "KR2b0001"}


def test_files_are_written_and_read_again(spark, tmp_path):
    rows = spark.createDataFrame([("a/x.txt", "子曰\n"), ("a/b/y.txt", "y"), ("z.txt", "end")], "path string, content string")
    for _ in range(2):  # once more writes the same files
        assert sinks.write_files(rows, str(tmp_path / "out")) == 3
    found = readers.files(spark, str(tmp_path / "out"), "*.txt").collect()
    assert {(r["path"].split("/out/")[1], r["content"]) for r in found} == {tuple(r) for r in rows.collect()}


def test_tei_round_trip():
    """Sections with markup signs, milestones and overlapping witnesses come back as they were."""
    markers = [{"offset": 0, "type": "head", "id": "", "content": "A & B"}, {"offset": 0, "type": "page-break", "id": '1"a', "content": ""}, {"offset": 4, "type": "milestone", "id": "", "content": "juan"}, {"offset": 6, "type": "line-break", "id": "9", "content": ""}]
    variants = [{"offset": 1, "length": 2, "witness": w, "form": f} for w, f in (("A", "x<"), ("B", "x<"), ("C", ""))] + [{"offset": 4, "length": 0, "witness": "A", "form": "more"}]
    made = sinks.tei_section("A & B", "子曰&學<而", markers, variants)
    back = readers.tei_sections(f"<TEI><text><body>{made}</body></text></TEI>")
    assert len(back) == 1 and (back[0]["head"], back[0]["text"], back[0]["markers"]) == ("A & B", "子曰&學<而", markers)
    assert sorted(map(str, back[0]["variants"])) == sorted(map(str, variants))


def test_templates(spark):
    rows = spark.createDataFrame([("a", 1), ("b", None)], "k string, v int")
    assert [r["rendered"] for r in slices.render(rows, "{{k}}-{{ v }} {k}", "?").orderBy("k").collect()] == ["a-1 {k}", "b-? {k}"]
    with pytest.raises(ValueError, match="w"):
        slices.render(rows, "{{w}}")
