"""Queries on bundles, edits, annotations, curation, records and checks, each over a whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators import annotations, bundles, catalog, curation, graph, order, passages, slices, validate, voices
from lectern.plans.passage_queries import _occurrences
from lectern.plans.reader_queries import BUCKETS, KEYS, _buckets, _text, _wide
from lectern.plans.text_queries import MARKED, _events, _marked, _micros
from lectern.storage import table


def _part(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part")


def _bundle_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as one scroll each, with a marker at each turn, named by its role."""
    rows = _marked(spark, sf_dir)
    return rows.select(F.col("bucket_id").cast("string").alias("textid"), F.lit(1).alias("juan_seq"), F.lit("body").alias("bucket"), "text", F.transform("markers", lambda m: m.withField("content", m["id"])).alias("markers"))


def _shown(markers: Column | str) -> Column:
    """Markers as id@offset, in order."""
    return F.array_join(F.transform(markers, lambda m: F.concat(m["id"], F.lit("@"), m["offset"].cast("string"))), ",")


# -- contents, sections, editions, moves -----------------------------------------------------


def toc_rebuild(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contents made anew from the assistant's turns."""
    found = bundles.contents(_bundle_rows(spark, sf_dir), "assistant")
    return _wide(found.select("textid", "marker_id", "label", "span_start", "span_end"), "span_start", "span_end")


TOC = "with " + MARKED + """ select t.bucket_id::varchar as textid, 't' || turn as marker_id, 't' || turn as label, o as span_start, coalesce(lead(o) over (partition by t.bucket_id order by turn), length(x.text)) as span_end from t join x using (bucket_id) where role = 'assistant'"""


def alternative_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers' identifiers with those of other catalogs joined in."""
    key = F.col("s_suppkey").cast("string")
    rows = table(spark, sf_dir, "supplier").select(_text("S", key).alias("textid"), F.create_map(F.lit("viaf"), F.array(key)).alias("identifiers"))
    more = table(spark, sf_dir, "supplier").where("s_suppkey % 3 = 0").select(_text("S", key).alias("textid"), F.explode(F.array(F.struct(F.lit("viaf").alias("kind"), key.alias("value")), F.struct(F.lit("viaf").alias("kind"), _text("y", key).alias("value")), F.struct(F.lit("lccn").alias("kind"), _text("z", key).alias("value")))).alias("a")).select("textid", "a.*")
    found = bundles.with_identifiers(rows, more)
    return found.select("textid", F.array_join(F.transform(F.array_sort(F.map_entries("identifiers")), lambda e: F.concat(e["key"], F.lit("="), F.array_join(e["value"], "+"))), ",").alias("identifiers"))


def section_move(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters 40 to 240 of each conversation moved out, with their markers."""
    found = bundles.moved_section(_bundle_rows(spark, sf_dir).select("textid", "text", "markers"), 40, 240)
    return found.select("textid", "part", F.md5("text").alias("digest"), _shown("markers").alias("markers"))


MOVE = "with " + MARKED + """ select bucket_id::varchar as textid, 'stays' as part, md5(left(text, 40) || substring(text, 241)) as digest, coalesce((select string_agg('t' || turn || '@' || if(o >= 240, o - 200, o), ',' order by turn) from t where t.bucket_id = x.bucket_id and not (o >= 40 and o < 240)), '') as markers from x
  union all select bucket_id::varchar, 'moves', md5(substring(text, 41, 200)), coalesce((select string_agg('t' || turn || '@' || o - 40, ',' order by turn) from t where t.bucket_id = x.bucket_id and o >= 40 and o < 240), '') from x"""


def attestation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of part names after an insertion at 3 and a deletion of 2 at 8."""
    edits = F.array(F.struct(F.lit(3).alias("start"), F.lit(0).alias("delete"), F.lit("XYZ").alias("insert")), F.struct(F.lit(8).alias("start"), F.lit(2).alias("delete"), F.lit("").alias("insert")))
    rows = _part(spark, sf_dir).select("p_partkey", (F.col("p_partkey") % 12).cast("int").alias("offset"), F.lit(2).alias("length"))
    return _wide(bundles.repaired_attestations(rows, edits).select("p_partkey", "offset", "conflict"), "offset")


REPAIR = """with r as (select p_partkey, p_partkey % 12 as o from part), a as (select p_partkey, o < 3 and o + 2 > 3 as c, if(3 <= o, o + 3, o) as o from r)
  select p_partkey, if(10 <= o, o - 2, o) as "offset", c or (8 < o + 2 and 10 > o) as conflict from a"""


def front_to_body(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scrolls whose body is empty get their front as the body."""
    rows = _buckets(spark, sf_dir).withColumn("text", F.when((F.col("bucket") == "body") & (F.col("juan_seq") == 2), F.lit("")).otherwise(F.col("text"))).drop("turn")
    found = bundles.front_to_empty_body(rows)
    return _wide(found.select(*KEYS, F.md5("text").alias("digest"), _shown("markers").alias("markers")), "juan_seq")


FRONT = "with " + BUCKETS + """, e as (select textid, juan_seq, bucket, if(bucket = 'body' and juan_seq = 2, '', text) as text, turn from b), f as (select textid, juan_seq, text as front, turn as front_turn from e where bucket = 'front'),
  j as (select e.*, front, front_turn, bucket = 'body' and e.text = '' and coalesce(front, '') <> '' as moves from e left join f using (textid, juan_seq)), g as (select textid, juan_seq from j where moves)
  select textid, juan_seq, bucket, md5(if(moves, front, text)) as digest, if(moves, 'p' || front_turn || '@0,p' || turn || '@' || length(front), 'p' || turn || '@0') as markers from j
  where not (bucket = 'front' and exists (select 1 from g where g.textid = j.textid and g.juan_seq = j.juan_seq))"""


def front_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations cut into front and body where the assistant first speaks."""
    rows = _bundle_rows(spark, sf_dir).select("textid", "text", F.transform("markers", lambda m: m.withField("extras", F.create_map(F.lit("level"), F.lit("1")))).alias("markers"))
    found = bundles.split_front(rows, ("assistant",))
    return _wide(found.select("textid", "part", F.md5("text").alias("digest"), F.size("markers").alias("markers")), "part", "markers")


SPLIT = "with " + MARKED + """, a as (select x.bucket_id, x.text, coalesce((select min(o) from t where t.bucket_id = x.bucket_id and role = 'assistant'), length(x.text)) as cut from x)
  select bucket_id::varchar as textid, 0::bigint as part, md5(left(text, cut)) as digest, (select count(*) from t where t.bucket_id = a.bucket_id and o < cut) as markers from a
  union all select bucket_id::varchar, 1, md5(substring(text, cut + 1)), (select count(*) from t where t.bucket_id = a.bucket_id and o >= cut) from a"""


def heading_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Buckets by words of their headings."""
    head = F.element_at(F.array(F.lit("卷一"), F.lit("序文"), F.lit("後序"), F.lit("目錄"), F.lit("跋")), (F.col("p_size") % 5 + 1).cast("int"))
    return slices.classified(_part(spark, sf_dir).select("p_partkey", head.alias("head")), "head")


# -- witnesses by alignment --------------------------------------------------------------------


def aligned_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names against spellings with a one for every i and two signs more."""
    rows = _part(spark, sf_dir).select("p_partkey", F.col("p_name").alias("master"), _text(F.translate("p_name", "i", "1"), "##").alias("witness"))
    return _wide(bundles.aligned_variants(rows, "p_partkey"), "offset", "length")


VARIANTS = """with c as (select p_partkey, unnest(string_split(p_name, '')) as ch, unnest(range(length(p_name))) as o from part)
  select p_partkey, o as "offset", 1::bigint as length, 'i' as content, '1' as form from c where ch = 'i' union all select p_partkey, length(p_name), 0, '', '##' from part"""


def mapped_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places in a spelling with two signs before the name, in the name."""
    rows = _part(spark, sf_dir).select("p_partkey", F.col("p_name").alias("master"), _text("##", F.col("p_name")).alias("witness"), F.array(*[F.lit(n) for n in (0, 1, 2, 5, 99)]).alias("at"))
    return bundles.mapped_offsets(rows, "at").select("p_partkey", F.array_join(F.transform("mapped", lambda m: m.cast("string")), ",").alias("mapped"))


# -- pins and markers ----------------------------------------------------------------------------


def recipe_fulfil(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pins into part names, some beyond their end, some of no text, some of another version."""
    key, n = F.col("p_partkey"), F.col("p_size")
    pins = _part(spark, sf_dir).select(key.alias("pin"), F.when(n % 6 == 0, -key - 1).otherwise(key).cast("string").alias("textid"), F.when(n % 4 == 0, F.lit("old")).when(n % 4 == 1, F.md5("p_name")).alias("hash"), F.when(n % 5 != 0, n % 8).alias("offset"), F.when(n % 7 != 0, F.lit(4)).alias("length"))
    corpus = _part(spark, sf_dir).select(key.cast("string").alias("textid"), F.col("p_name").alias("text"), F.md5("p_name").alias("hash"))
    return slices.fulfil(pins, corpus)


FULFIL = """with r as (select p_partkey, p_name, p_size as n, p_size % 6 = 0 and p_partkey >= 0 as gone, if(p_size % 5 <> 0, p_size % 8, 0) as o, if(p_size % 7 <> 0, 4, length(p_name) - if(p_size % 5 <> 0, p_size % 8, 0)) as l from part)
  select p_partkey as pin, if(n % 6 = 0, -p_partkey - 1, p_partkey)::varchar as textid, if(gone or l < 0 or o + l > length(p_name), null, substring(p_name, o + 1, l)) as text, if(gone, null, n % 4 <> 0) as verified, if(gone, 'not_found', if(l < 0 or o + l > length(p_name), 'out_of_range', null)) as error from r"""


def recipe_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations with their customers, by a template for each row."""
    rows = table(spark, sf_dir, "customer").where("c_acctbal > 9000").select("c_nationkey", "c_custkey", "c_name", F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")).alias("segment"))
    return slices.dataset(rows, ["c_nationkey"], "{{c_custkey}}: {{ c_name }} {of {{segment}}}", ["c_custkey"])


def marker_collect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All turns of the user with what stands around them."""
    found = slices.collect_markers(_bundle_rows(spark, sf_dir).select("textid", "text", "markers"), "user", 5)
    return _wide(found.select("textid", "offset", "id", F.md5("marked").alias("marked"), "left", "right"), "offset")


COLLECT = "with " + MARKED + """ select t.bucket_id::varchar as textid, o as "offset", 't' || turn as id, md5(t.text) as marked, substring(x.text, greatest(o - 5, 0) + 1, least(o, 5)) as "left", substring(x.text, o + length(t.text) + 1, 5) as "right" from t join x using (bucket_id) where role = 'user'"""


def marker_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blank ids of line items' markers filled after those in use."""
    item = table(spark, sf_dir, "lineitem")
    rows = item.where("l_partkey % 20 = 0").select(F.col("l_partkey").alias("key"), F.col("l_returnflag").alias("type"), F.when(F.col("l_orderkey") % 3 == 0, _text("old-", F.col("l_linenumber"))).when(F.col("l_orderkey") % 3 == 1, F.lit(" ")).alias("id"), F.col("l_orderkey").alias("item"), F.col("l_linenumber").alias("line"), "l_extendedprice")
    return slices.assign_ids(rows, ["key"], _text("m", F.col("key")), ["item", "line", "l_extendedprice"]).select("key", "type", "item", "line", "id")


MARKER_IDS = """with r as (select l_partkey as key, l_returnflag as type, case l_orderkey % 3 when 0 then 'old-' || l_linenumber when 1 then ' ' end as id, l_orderkey as item, l_linenumber as line, l_extendedprice as p from lineitem where l_partkey % 20 = 0),
  n as (select *, coalesce(max(try_cast(regexp_extract(id, '(\\d+)$', 1) as int)) over (partition by key, type), 0) as top, coalesce(trim(id) = '', true) as blank from r),
  c as (select *, sum(blank::int) over (partition by key, type order by item, line, p rows between unbounded preceding and current row) as rank from n)
  select key, type, item, line, if(blank, 'm' || key || '-' || type || '-' || (top + rank), id) as id from c"""


def link_rebase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parallel links after edits of every third text; links into the edited place are dropped."""
    rows = _part(spark, sf_dir).select(F.col("p_brand").alias("textid"), "p_partkey", (F.col("p_partkey") % 20).cast("int").alias("offset"), F.lit(3).alias("length"))
    splice = F.array(F.struct(F.lit(10).alias("start"), F.lit(4).alias("delete"), F.lit("ab").alias("insert")))
    edits = rows.select("textid").distinct().where(F.col("textid").rlike("[147]$")).withColumn("splices", splice)
    return _wide(bundles.rebased_links(rows, edits).select("textid", "p_partkey", "offset"), "offset")


def parallels_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items of one part as a scroll's parallels, with gaps and weights by remote text."""
    return _wide(bundles.parallels_page(_parallels(spark, sf_dir), "A", (100, 2000), (5, 40))[0].drop("bucket"), "start", "end", "length", "local_gap", "remote_gap", "overlap_length")


def _parallels(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.datediff(F.to_date("l_shipdate"), F.lit("1995-01-01"))
    rows = table(spark, sf_dir, "lineitem").where("l_suppkey % 10 = 7")
    at = F.col("l_orderkey") * 8 + F.col("l_linenumber")
    return rows.select(F.col("l_returnflag").alias("bucket"), day.alias("start"), (day + F.col("l_quantity").cast("int")).alias("end"), F.col("l_suppkey").cast("string").alias("remote_textid"), at.alias("remote_start"), (at + 5).alias("remote_end"))


PARALLELS = "r as (select l_returnflag as bucket, date_diff('day', date '1995-01-01', l_shipdate::date)::bigint as \"start\", date_diff('day', date '1995-01-01', l_shipdate::date)::bigint + l_quantity::int as \"end\", l_suppkey::varchar as remote_textid, l_orderkey * 8 + l_linenumber as remote_start, l_orderkey * 8 + l_linenumber + 5 as remote_end from lineitem where l_suppkey % 10 = 7)"
PAGE = "with " + PARALLELS + """, k as (select "start", "end", remote_textid, remote_start, remote_end, "end" - "start" as length from r where bucket = 'A' and "start" < 2000 and "end" > 100 and "end" - "start" between 5 and 40)
  select *, case when lag("end") over w is not null then greatest("start" - lag("end") over w, 0) end as local_gap, case when lag(remote_end) over w is not null then greatest(remote_start - lag(remote_end) over w, 0) end as remote_gap, (sum(length) over (partition by remote_textid))::bigint as overlap_length
  from k window w as (partition by remote_textid order by "start", "end", remote_start)"""


def parallel_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lengths there are to choose from, before they are chosen from."""
    return _wide(bundles.parallels_page(_parallels(spark, sf_dir), "A", (100, 2000), (5, 40))[1], "min_length", "max_length")


def remote_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Remote texts of a scroll's parallels, in order."""
    return order.numbered(bundles.remote_options(_parallels(spark, sf_dir)), F.desc("overlap_length"), "remote_textid")


# -- corpus -----------------------------------------------------------------------------------------


def _corpus(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Customers as bundles, in sections by nation; their orders and the large ones as tables."""
    textid = lambda key: _text("KR", F.col("c_nationkey") % 7, "a", F.lpad(F.col(key).cast("string"), 4, "0"))
    rows = table(spark, sf_dir, "customer").select(F.when(F.col("c_custkey") % 11 == 0, _text("X", F.col("c_custkey"))).otherwise(textid("c_custkey")).alias("textid"), F.col("c_custkey").alias("key"))
    orders = table(spark, sf_dir, "orders").join(rows, F.col("o_custkey") == F.col("key")).select("textid", "o_totalprice")
    return rows.select("textid"), {"orders": orders, "large": orders.where("o_totalprice > 300000")}


CORPUS = "b as (select c_custkey, if(c_custkey % 11 = 0, 'X' || c_custkey, 'KR' || c_nationkey % 7 || 'a' || lpad(c_custkey::varchar, 4, '0')) as textid, if(c_custkey % 11 = 0, 'other', 'KR' || c_nationkey % 7 || 'a') as section from customer)"


def corpus_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bundles.corpus_info(*_corpus(spark, sf_dir))


def bundle_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bundles.bundle_counts(*_corpus(spark, sf_dir))


def catalog_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers by segment and by the digits of their key; filters that are not known are refused."""
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    extract = {"section": F.array("c_mktsegment"), "tag": F.array((F.col("c_custkey") % 10).cast("string"), (F.col("c_custkey") % 7).cast("string"))}
    return catalog.by_fields(rows, {"section": ["BUILDING", "MACHINERY", "none"], "tag": ["3", "6"]}, extract)


def identifier_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers by their segment as an identifier that several have, and by one that a single one has."""
    rows = table(spark, sf_dir, "customer")
    base = F.when(F.col("c_custkey") != 42, F.lit("base"))
    keys = rows.select(F.lit("all").alias("key"), F.col("c_custkey").alias("textid"), base.alias("base_edition")).unionByName(rows.where("c_custkey in (7, 8)").select(F.lit("two").alias("key"), F.col("c_custkey").alias("textid"), F.lit("base").alias("base_edition")))
    return catalog.resolve("all", keys).unionByName(catalog.resolve("two", keys)).unionByName(catalog.resolve("none", keys))


def missing_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers without an order: sources to import."""
    return catalog.missing(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


def local_remote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and labels: here, there, or both."""
    return validate.compared(table(spark, sf_dir, "documents").where("doc_id % 3 <> 1"), table(spark, sf_dir, "labels"), "doc_id")


def stale_indexes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers whose last order is later than their index, or whose index is of another version or missing."""
    sources = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("key")).agg(F.max("o_totalprice").alias("modified"))
    built = table(spark, sf_dir, "customer").where("c_custkey % 9 <> 0").select(F.col("c_custkey").alias("key"), (F.col("c_acctbal") * 50).alias("built"), F.when(F.col("c_nationkey") == 3, 0).otherwise(1).alias("version"))
    return validate.stale(sources, built, "key", 1)


def next_serials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The least free serial number of each section, where each has a gap of its own."""
    rows = _part(spark, sf_dir).select(F.when(F.col("p_partkey") % 7 != 5, _text("KR1a", F.col("p_partkey") % 50)).alias("textid")).where("textid is not null and textid <> 'KR1a17'")
    found = [(prefix, validate.next_serial(rows, prefix)) for prefix in ("KR1a", "KR2b")]
    return spark.createDataFrame(found, "prefix string, serial long")


SERIALS = """with n as (select distinct p_partkey % 50 as n from part where p_partkey % 7 <> 5 and p_partkey % 50 <> 17)
  select 'KR1a' as prefix, if((select count(*) from n where n = 1) = 0, 1, (select min(n + 1) from n where n + 1 not in (select n from n))) as serial union all select 'KR2b', 1"""


# -- annotations --------------------------------------------------------------------------------------


def rejected_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels").withColumn("curation_state", F.when(F.col("toxic") == 1, "rejected").when(F.col("quality") == 1, "accepted"))
    return annotations.rejected(rows).select("doc_id", "curation_state")


def marker_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items placed by the marker they name; of a marker in two buckets the first counts."""
    item = table(spark, sf_dir, "lineitem").where("l_partkey % 10 = 3")
    rows = item.select("l_orderkey", "l_linenumber", "l_extendedprice", F.col("l_returnflag").alias("textid"), F.col("l_linenumber").alias("seq"), _text("m", F.col("l_orderkey") % 4).alias("marker_id"), F.col("l_quantity").cast("int").alias("offset"))
    markers = spark.createDataFrame([(t, s, f"m{m}", b, 1000 * m + 10 * s) for t in "ANR" for s in range(1, 8) for m, b in ((0, "front"), (1, "body"), (1, "back"), (2, "back")) if (t, s) != ("A", 2)], "textid string, seq int, marker_id string, bucket string, marker_offset int")
    return _wide(annotations.marker_positions(rows, markers).select("l_orderkey", "l_linenumber", "l_extendedprice", "bucket", "bucket_offset"), "bucket_offset")


RESOLUTION = """with r as (select *, l_orderkey % 4 as m, l_returnflag || l_linenumber <> 'A2' and l_linenumber between 1 and 7 and l_returnflag in ('A', 'N', 'R') as known from lineitem where l_partkey % 10 = 3)
  select l_orderkey, l_linenumber, l_extendedprice, if(known, (['front', 'body', 'back', null])[m + 1], null) as bucket, if(known and m < 3, 1000 * m + 10 * l_linenumber + l_quantity::int, null)::bigint as bucket_offset from r"""


def annotation_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels with the characters around their place in the document."""
    rows = table(spark, sf_dir, "labels").select("doc_id", (F.col("doc_id") % 90).cast("int").alias("offset"), F.lit(6).alias("length"))
    return annotations.with_context(rows, table(spark, sf_dir, "documents").where("doc_id % 5 <> 0"), ["doc_id"]).select("doc_id", "left", "match", "right")


CONTEXT = """select l.doc_id, substring(text, greatest(o - 7, 0) + 1, least(o, 7)) as "left", substring(text, o + 1, 6) as "match", substring(text, o + 7, 7) as "right" from (select doc_id, doc_id % 90 as o from labels) l left join (select * from documents where doc_id % 5 <> 0) d on d.doc_id = l.doc_id"""


def merge_by_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An archive without what is incoming or superseded by it, and all that is incoming."""
    rows = lambda where, origin, older: table(spark, sf_dir, "orders").where(where).select(F.col("o_orderkey").cast("string").alias("cid"), F.lit(origin).alias("origin"), older.cast("string").alias("supersedes"))
    old = rows("o_orderkey % 3 <> 0", "old", F.lit(None))
    new = rows("o_orderkey % 5 = 0", "new", F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderkey") + 1))
    return annotations.merged_by_content(old, new)


BY_CONTENT = """with n as (select o_orderkey as k, if(o_orderkey % 2 = 0, o_orderkey + 1, null) as s from orders where o_orderkey % 5 = 0)
  select o_orderkey::varchar as cid, 'old' as origin, null::varchar as supersedes from orders where o_orderkey % 3 <> 0 and o_orderkey not in (select k from n) and o_orderkey not in (select s from n where s is not null) union all select k::varchar, 'new', s::varchar from n"""


def archive_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An archive and the rows whose content it lacks."""
    rows = table(spark, sf_dir, "orders").select((F.col("o_orderkey") % 500).alias("cid"), F.lit("new").alias("origin"))
    return curation.materialised(rows.where("cid < 100").distinct().withColumn("origin", F.lit("old")), rows)


# -- curation --------------------------------------------------------------------------------------------


def _commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("event_id")
    record = F.to_json(F.struct(F.struct(_text("at://", F.col("user_id")).alias("uri")).alias("subject"), F.when(key % 4 != 0, "accepted").alias("state"), F.when(key % 5 != 0, (key % 6 - 1).cast("string")).alias("rating"), F.lit("2024-01-02T03:04:05Z").alias("createdAt")))
    commit = F.struct(F.col("event_type").alias("collection"), key.cast("string").alias("rkey"), F.when(key % 9 == 0, "delete").otherwise("create").alias("operation"), _text("c", key).alias("cid"), F.when(key % 8 != 0, record).alias("record"))
    return _events(spark, sf_dir).select(F.when(key % 10 == 0, "identity").otherwise("commit").alias("kind"), F.when(key % 11 != 0, _text("did", F.col("user_id"))).alias("did"), _micros("ts").alias("time_us"), commit.alias("commit"))


COMMITS = """c as (select event_id as k, user_id, 'at://did' || user_id || '/' || event_type || '/' || event_id as uri, if(event_id % 9 = 0, 'delete', 'create') as operation, epoch_us(ts) as time_us from events
  where event_id % 10 <> 0 and event_id % 11 <> 0 and event_type in ('click', 'error') and (event_id % 9 = 0 or event_id % 8 <> 0))"""


def commit_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curation.commits(_commits(spark, sf_dir), ["click", "error"]).select("uri", "operation", "time_us")


def judgment_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judgments with their state; a rating out of 0 to 2 is 0."""
    found = curation.judgment(curation.commits(_commits(spark, sf_dir), ["click", "error"]))
    return _wide(found.select("uri", "target", "state", "rating", "created"), "rating")


def feed_enrichment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as feed rows with the titles of their texts, the names of their authors, and their curation."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("uri"), (F.col("o_orderkey") % 30).alias("textid"), F.col("o_custkey").alias("did"))
    titles = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("bigint").alias("textid"), F.col("n_name").alias("title"))
    names = table(spark, sf_dir, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("did"), F.col("c_name").alias("name"))
    judged = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").cast("string").alias("target"), F.lit("accepted").alias("state"), F.lit(2).alias("rating"))
    return _wide(curation.stamped(curation.enriched(rows, titles, names), judged).select("uri", "title", "name", "state", "rating"), "rating")


# -- records -----------------------------------------------------------------------------------------------


def core_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of orders replaced for every tenth order and removed for every eleventh."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("source"), F.col("l_partkey").alias("target"), F.lit("old").alias("relation"))
    changed = table(spark, sf_dir, "orders").where("o_orderkey % 10 = 0").select(F.col("o_orderkey").alias("source"), F.col("o_custkey").alias("target"), F.lit("new").alias("relation"))
    return graph.without(graph.upserted(rows, "source", changed), "source", table(spark, sf_dir, "orders").where("o_orderkey % 11 = 0").select("o_orderkey"))


def entries_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as entries, suppliers as their words, customers of the nation and balance as senses."""
    entries = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("entry"), F.col("n_name").alias("orth"))
    words = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("entry"), F.col("s_suppkey").alias("word"), (F.col("s_suppkey") % 4).alias("concept"))
    senses = table(spark, sf_dir, "customer").select((F.col("c_custkey") % 200).alias("word"), F.col("c_custkey").alias("ordinal"), F.col("c_custkey").alias("uuid"), F.col("c_name").alias("definition"))
    full = graph.entries_full(entries, words, senses)
    shown = F.array_join(F.transform("words", lambda w: F.concat(w["word"].cast("string"), F.lit("/"), w["concept"].cast("string"), F.lit(":"), F.coalesce(F.array_join(F.transform(w["senses"], lambda s: s["uuid"].cast("string")), "+"), F.lit("")))), ",")
    return full.select("entry", "orth", shown.alias("words"))


ENTRIES = """with s as (select c_custkey % 200 as word, string_agg(c_custkey::varchar, '+' order by c_custkey) as senses from customer group by 1),
  w as (select s_nationkey as entry, string_agg(s_suppkey || '/' || s_suppkey % 4 || ':' || coalesce(senses, ''), ',' order by s_suppkey) as words from supplier left join s on word = s_suppkey group by 1)
  select n_nationkey as entry, n_name as orth, words from nation left join w on entry = n_nationkey"""


def concept_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries with a word of one concept."""
    words = table(spark, sf_dir, "supplier").select((F.col("s_nationkey") + 5).alias("entry"), F.col("s_suppkey").alias("word"), (F.col("s_suppkey") % 4).alias("concept"))
    return graph.concept_words(2, words, table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("entry"), F.col("n_name").alias("orth")))


def sense_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as nested senses: a seventh of the key is the parent."""
    rows = _part(spark, sf_dir).select(F.col("p_partkey").alias("node"), F.when(F.col("p_partkey") >= 7, F.floor(F.col("p_partkey") / 7)).cast("bigint").alias("parent"))
    return _wide(graph.sense_walk(rows), "level")


WALK = """with recursive t as (select p_partkey as node, case when p_partkey >= 7 then p_partkey // 7 end as parent from part), w as (select node as root, null::bigint as parent, node, 0::bigint as level from t where parent is null
  union all select w.root, w.node, t.node, w.level + 1 from w join t on t.parent = w.node) select * from w"""


# -- checks -------------------------------------------------------------------------------------------------


def tree_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaves of two versions of the parts that differ, and whether that is expected of their path."""
    rows = lambda value, where: _part(spark, sf_dir).where(where).select(F.concat_ws("/", "p_brand", F.col("p_partkey").cast("string")).alias("path"), value.alias("value"))
    return validate.tree_diff(rows(F.col("p_name"), "p_size % 7 <> 0"), rows(F.when(F.col("p_size") % 5 == 0, F.upper("p_name")).otherwise(F.col("p_name")), "p_size % 6 <> 0"), ["Brand#1/", "Brand#2/"])


TREE = """with o as (select p_brand || '/' || p_partkey as path, p_name as v from part where p_size % 7 <> 0), s as (select p_brand || '/' || p_partkey as path, if(p_size % 5 = 0, upper(p_name), p_name) as v from part where p_size % 6 <> 0)
  select coalesce(o.path, s.path) as path, o.v as ours, s.v as sample, if(starts_with(coalesce(o.path, s.path), 'Brand#1/') or starts_with(coalesce(o.path, s.path), 'Brand#2/'), 'expected', 'unexpected') as kind from o full join s on o.path = s.path where o.v is distinct from s.v"""


def _ranges(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Conversations' turns as voices, some too long, without a name, over the next, or answering nothing."""
    rows = _bundle_rows(spark, sf_dir).select(F.col("textid").cast("bigint").alias("bucket_id"), F.length("text").alias("chars"), F.posexplode("markers").alias("place", "m"))
    end = F.col("m.offset") + F.col("m.length") + F.when(F.col("place") == 0, 3).otherwise(0)
    ranges = rows.select("bucket_id", F.col("m.offset").alias("start"), end.alias("end"), F.when((F.col("bucket_id") % 4 == 0) & (F.col("place") == 1), " ").otherwise(F.lit("turn")).alias("name"), F.col("m.id").alias("id"), F.when(F.col("place") == 2, F.lit("t0")).when(F.col("place") == 3, F.lit("nobody")).alias("responds_to"))
    return ranges, rows.select("bucket_id", "chars").distinct()


RANGES = "with " + MARKED + """, r as (select t.bucket_id, length(x.text) as chars, o as "start", o + length(t.text) + if(row_number() over w = 1, 3, 0) as "end", if(t.bucket_id % 4 = 0 and row_number() over w = 2, ' ', 'turn') as name, 't' || turn as id,
    case row_number() over w when 3 then 't0' when 4 then 'nobody' end as responds_to from t join x using (bucket_id) window w as (partition by t.bucket_id order by turn)),
  n as (select *, lead("start") over (partition by bucket_id, name order by "start", "end") as after from r),
  p as (select bucket_id, id, 'bounds' as rule from r where "end" > chars union select bucket_id, id, 'name' from r where trim(name) = '' union select bucket_id, id, 'overlap' from n where after < "end"
    union select bucket_id, id, 'dangling' from r where responds_to is not null and not exists (select 1 from r q where q.bucket_id = r.bucket_id and q.id = r.responds_to))"""


def voice_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an index would refuse, as a report with ids in a fixed order."""
    return voices.numbered(voices.problems(*_ranges(spark, sf_dir)), ["bucket_id", "id", "rule"])


def voice_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranges of one derivation replaced, those by hand kept."""
    ranges = _ranges(spark, sf_dir)[0].select("bucket_id", "start", "id").withColumn("source", F.when(F.col("id").isin("t0", "t1"), "parens").otherwise("hand"))
    derived = _part(spark, sf_dir).select(F.col("p_partkey").alias("bucket_id"), F.col("p_size").alias("start"), F.lit("n1").alias("id"))
    return _wide(voices.replaced(ranges, derived, "parens"), "start")


def negative_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _part(spark, sf_dir).select("p_partkey", (F.col("p_size") - 10).cast("bigint").alias("offset"))
    return validate.negative_offsets(rows)


def duplicate_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a report by coverage, length and kind: a filter on its columns."""
    rows = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("bucket_a"), F.col("s_nationkey").alias("bucket_b"), (F.col("s_acctbal") / 10000).alias("coverage_a"), F.col("s_suppkey").alias("longest_span"), (F.col("s_suppkey") % 9 == 0).alias("intra"))
    return rows.where((F.col("coverage_a") >= 0.5) & (F.col("longest_span") >= 20) & ~F.col("intra")).select("bucket_a", "bucket_b", "longest_span")


def first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first line item of each order."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    return order.first_wins(rows, ["l_orderkey"], ["l_linenumber", "l_partkey", "l_extendedprice"])


def nocase_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels in an order that ignores case, numbered."""
    label = F.when(F.col("p_partkey") % 2 == 0, F.upper("p_name")).otherwise(F.col("p_name"))
    return order.numbered(_part(spark, sf_dir).select("p_partkey", label.alias("label")), F.lower("label"), "p_partkey")


def group_tops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three largest orders of each customer."""
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return order.top(rows, ["o_custkey"], [F.desc("o_totalprice"), F.col("o_orderkey")], 3)


def point_occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All occurrences of the clusters at a place, the place included."""
    return passages.lookup(_occurrences(spark, sf_dir), 7, 900, "cover", True)


_NAMES = (
    toc_rebuild, alternative_ids, section_move, attestation_repair, front_to_body, front_split, heading_classes, aligned_variants, mapped_offsets, recipe_fulfil, recipe_render, marker_collect, marker_ids, link_rebase, parallels_page, parallel_lengths,
    remote_options, corpus_info, bundle_counts, catalog_filter, identifier_resolution, missing_imports, local_remote, stale_indexes, next_serials, rejected_rows, marker_resolution, annotation_context, merge_by_content, archive_rows,
    commit_parse, judgment_parse, feed_enrichment, core_upsert, entries_full, concept_words, sense_walk, tree_differences, voice_problems, voice_replace, negative_offsets, duplicate_filter, first_wins, nocase_order, group_tops, point_occurrences,
)
QUERIES = {f.__name__: f for f in _NAMES}
OCC = "o as (select o_custkey as cluster, o_custkey % 50 as bucket_id, date_diff('day', date '1995-01-01', o_orderdate::date)::bigint as \"start\", date_diff('day', date '1995-01-01', o_orderdate::date)::bigint + 30 as \"end\" from orders)"
ORACLE = {
    "toc_rebuild": TOC,
    "alternative_ids": "select 'S' || s_suppkey as textid, if(s_suppkey % 3 = 0, 'lccn=z' || s_suppkey || ',viaf=' || s_suppkey || '+y' || s_suppkey, 'viaf=' || s_suppkey) as identifiers from supplier",
    "section_move": MOVE,
    "attestation_repair": REPAIR,
    "front_to_body": FRONT,
    "front_split": SPLIT,
    "heading_classes": "select p_partkey, (['卷一', '序文', '後序', '目錄', '跋'])[p_size % 5 + 1] as head, (['body', 'front', 'back', 'front', 'back'])[p_size % 5 + 1] as bucket from part",
    "aligned_variants": VARIANTS,
    "mapped_offsets": "select p_partkey, '0,0,0,3,' || length(p_name) as mapped from part",
    "recipe_fulfil": FULFIL,
    "recipe_render": "select c_nationkey, string_agg(c_custkey || ': ' || c_name || ' {of ' || if(c_custkey % 2 = 0, c_mktsegment, '') || '}', chr(10) order by c_custkey) as rendered from customer where c_acctbal > 9000 group by c_nationkey",
    "marker_collect": COLLECT,
    "marker_ids": MARKER_IDS,
    "link_rebase": """with r as (select p_brand as textid, p_partkey, p_partkey % 20 as o, regexp_matches(p_brand, '[147]$') as edited from part)
  select textid, p_partkey, if(edited and o >= 14, o - 2, o) as "offset" from r where not (edited and o < 14 and o + 3 > 10)""",
    "parallels_page": PAGE,
    "parallel_lengths": "with " + PARALLELS + " select min(\"end\" - \"start\") as min_length, max(\"end\" - \"start\") as max_length from r where bucket = 'A' and \"start\" < 2000 and \"end\" > 100",
    "remote_options": "with " + PARALLELS + ", g as (select remote_textid, count(*) as n, sum(\"end\" - \"start\")::bigint as overlap_length from r group by remote_textid) select *, row_number() over (order by overlap_length desc, remote_textid) as position from g",
    "corpus_info": "with " + CORPUS + " select 'section' as dim, section as value, count(*) as n from b group by section union all select 'table', 'orders', count(*) from orders join b on c_custkey = o_custkey union all select 'table', 'large', count(*) from orders join b on c_custkey = o_custkey where o_totalprice > 300000",
    "bundle_counts": "with " + CORPUS + " select textid, count(o_orderkey) as orders, count(o_orderkey) filter (where o_totalprice > 300000) as large from b left join orders on c_custkey = o_custkey group by textid",
    "catalog_filter": "select c_custkey, c_mktsegment from customer where c_mktsegment in ('BUILDING', 'MACHINERY') and (c_custkey % 10 in (3, 6) or c_custkey % 7 in (3, 6))",
    "identifier_resolution": "select 'all' as key, 42::bigint as textid, null::varchar as base_edition, false as ambiguous from customer where c_custkey = 42 union all select 'two', c_custkey, 'base', true from customer where c_custkey in (7, 8)",
    "missing_imports": "select c_custkey, c_name from customer where c_custkey not in (select o_custkey from orders)",
    "local_remote": "with l as (select distinct doc_id from documents where doc_id % 3 <> 1), r as (select distinct doc_id from labels) select coalesce(l.doc_id, r.doc_id) as doc_id, if(r.doc_id is null, 'local', if(l.doc_id is null, 'remote', 'both')) as \"where\" from l full join r on l.doc_id = r.doc_id",
    "stale_indexes": "with s as (select o_custkey as key, max(o_totalprice) as modified from orders group by 1) select key from s left join (select * from customer where c_custkey % 9 <> 0) on c_custkey = key where c_custkey is null or c_nationkey = 3 or modified > c_acctbal * 50",
    "next_serials": SERIALS,
    "rejected_rows": "select doc_id, 'rejected' as curation_state from labels where toxic = 1",
    "marker_resolution": RESOLUTION,
    "annotation_context": CONTEXT,
    "merge_by_content": BY_CONTENT,
    "archive_rows": "select distinct o_orderkey % 500 as cid, if(o_orderkey % 500 < 100, 'old', 'new') as origin from orders",
    "commit_parse": "with " + COMMITS + " select uri, operation, time_us from c",
    "judgment_parse": "with " + COMMITS + " select uri, 'at://' || user_id as target, 'accepted' as state, (case when k % 5 <> 0 and k % 6 - 1 between 0 and 2 then k % 6 - 1 else 0 end)::bigint as rating, 1704164645000000::bigint as created from c where k % 8 <> 0 and k % 4 <> 0",
    "feed_enrichment": "select o_orderkey::varchar as uri, n_name as title, c_name as name, if(o_orderstatus = 'F', 'accepted', 'proposed') as state, if(o_orderstatus = 'F', 2, 0)::bigint as rating from orders left join nation on n_nationkey = o_orderkey % 30 left join (select * from customer where c_custkey % 2 = 0) on c_custkey = o_custkey",
    "core_upsert": "select l_orderkey as source, l_partkey as target, 'old' as relation from lineitem where l_orderkey not in (select o_orderkey from orders where o_orderkey % 10 = 0 or o_orderkey % 11 = 0) union all select o_orderkey, o_custkey, 'new' from orders where o_orderkey % 10 = 0 and o_orderkey % 11 <> 0",
    "entries_full": ENTRIES,
    "concept_words": "select distinct s_nationkey + 5 as entry, n_name as orth, s_suppkey as word from supplier left join nation on n_nationkey = s_nationkey + 5 where s_suppkey % 4 = 2",
    "sense_walk": WALK,
    "tree_differences": TREE,
    "voice_problems": RANGES + " select bucket_id, id, rule, row_number() over (order by bucket_id, id, rule) as report_id from p",
    "voice_replace": "with " + MARKED + " select bucket_id, o as \"start\", 't' || turn as id, 'hand' as source from t where turn > 1 union all select p_partkey, p_size, 'n1', 'parens' from part",
    "negative_offsets": "select p_partkey, (p_size - 10)::bigint as \"offset\" from part where p_size < 10",
    "duplicate_filter": "select s_suppkey as bucket_a, s_nationkey as bucket_b, s_suppkey as longest_span from supplier where s_acctbal / 10000 >= 0.5 and s_suppkey >= 20 and s_suppkey % 9 <> 0",
    "first_wins": "select l_orderkey, l_linenumber, l_partkey, l_extendedprice from (select *, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_extendedprice) as n from lineitem) where n = 1",
    "nocase_order": "select p_partkey, if(p_partkey % 2 = 0, upper(p_name), p_name) as label, row_number() over (order by lower(p_name), p_partkey) as position from part",
    "group_tops": "select * from (select o_custkey, o_orderkey, o_totalprice, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as rank from orders) where rank <= 3",
    "point_occurrences": "with " + OCC + " select * from o where cluster in (select cluster from o where bucket_id = 7 and \"start\" <= 900 and \"end\" >= 900)",
}
