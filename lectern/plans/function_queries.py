"""Queries on column functions, query syntax, labels and passages, each over a whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import labels, udfs
from lectern.functions import text as fn
from lectern.operators import bundles, chars, order, passages, search, slices
from lectern.operators.components import components
from lectern.plans import parse
from lectern.plans.catalog_queries import YEARS, _years
from lectern.plans.passage_queries import OCC, WINNOW, _occurrences
from lectern.plans.reader_queries import _text, _wide
from lectern.plans.search_queries import HIT, KWIC, kwic_sql, sources
from lectern.sources import sinks
from lectern.storage import scratch, table


def _part(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part")


# -- normal forms, references, hashes, ids ------------------------------------------------


def text_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts in NFC, from NFD, and folded for search."""
    docs = sources(spark, sf_dir)
    return docs.select("bucket_id", F.md5(udfs.nfc("text")).alias("nfc"), F.md5(udfs.fold_search("text")).alias("fold"))


def entity_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities of private characters expanded, and turned back again."""
    given = _text(F.col("p_name"), "&KR", F.lpad((F.col("p_partkey") % 3000).cast("string"), 4, "0"), ";&KRx;")
    made = _part(spark, sf_dir).select("p_partkey", udfs.expand_entities(given).alias("expanded"))
    return made.withColumn("back", udfs.entities("expanded"))


def _reference(kind: str | Column) -> Column:
    letter = F.element_at(F.array(F.lit("a"), F.lit("b"), F.lit("h")), (F.col("p_partkey") % 3 + 1).cast("int"))
    return _text(kind, F.col("p_size") % 10, letter, F.col("p_partkey") % 10000)


REF = "r as (select p_partkey, p_size, (p_size % 10)::varchar || (['a', 'b', 'h'])[p_partkey % 3 + 1] as section, p_partkey % 10000 as serial from part)"


def text_id_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short ids with and without their prefix, made whole; names pass as they are."""
    given = F.when(F.col("p_size") % 3 == 0, _text(" ", _reference(""))).when(F.col("p_size") % 3 == 1, _reference("KR")).otherwise(F.col("p_name"))
    return _part(spark, sf_dir).select("p_partkey", fn.normal_text_id(given).alias("textid"))


def short_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short references to places of texts, and what they are parsed to."""
    bucket = F.when(F.col("p_size") % 2 == 0, "body").otherwise("front")
    made = _part(spark, sf_dir).select("p_partkey", fn.short_ref(fn.normal_text_id(_reference("")), F.col("p_size"), bucket, F.col("p_partkey") * 3, F.lit(12)).alias("ref"))
    parsed = made.withColumn("r", fn.parsed_ref("ref"))
    return _wide(parsed.select("p_partkey", "ref", "r.textid", "r.seq", "r.bucket", "r.offset", "r.length"), "seq", "offset", "length")


def section_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Section codes of ids, numbered in their natural order."""
    from lectern.operators.catalog import natural_order

    codes = _part(spark, sf_dir).select(fn.section_code(_text(F.when(F.col("p_size") == 7, F.lit("XX")).otherwise("KR"), F.col("p_size"), F.lower(F.left("p_type", F.lit(2))), F.col("p_partkey"))).alias("code")).where("code is not null").distinct()
    return order.numbered(codes, *natural_order(), name="position")


def centuries(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _years(spark, sf_dir).select("p_partkey", fn.century("a").alias("c"))
    return _wide(found.select("p_partkey", "c.key", "c.label", "c.start", "c.end"), "start", "end")


CENTURIES = "with " + YEARS + """, c as (select p_partkey, a, if(a > 0, (a - 1) // 100 + 1, greatest((abs(a) - 1) // 100 + 1, 1)) as n from y)
  select p_partkey, if(a > 0, 'ce-', 'bce-') || lpad(n::varchar, 2, '0') as key, n || case when n % 100 between 10 and 20 then 'th' when n % 10 = 1 then 'st' when n % 10 = 2 then 'nd' when n % 10 = 3 then 'rd' else 'th' end || if(a > 0, ' c. CE', ' c. BCE') as label,
    (if(a > 0, (n - 1) * 100 + 1, -(n * 100)))::bigint as "start", (if(a > 0, n * 100, if(n = 1, 0, -((n - 1) * 100 + 1))))::bigint as "end" from c"""


def content_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hashes of texts, of JSON in canonical form, and of objects that carry their own hash."""
    document = _text('{ "b": ', F.col("p_size"), ', "hash": "old", "a": "', F.col("p_name"), ' é"}')
    rows = _part(spark, sf_dir)
    return rows.select("p_partkey", fn.text_hash("p_name").alias("text"), udfs.jcs_hash(document).alias("json"), udfs.self_hash(document).alias("own"))


def id_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bare uuids, relative marker ids, editions and scrolls of marker ids, and titles made by machines."""
    key = F.col("p_partkey")
    rows = _part(spark, sf_dir).select(
        "p_partkey", fn.bare_uuid(_text(" uuid-w", key, "#frag  more")).alias("uuid"), fn.relative_marker(_text("x_tls_", key)).alias("relative"), bundles.marker_parts(_text("KR1a0001_X_", F.lpad((F.col("p_size") % 1000).cast("string"), 3, "0"), "-", key)).alias("m"),
        fn.is_ai(F.col("p_name"), F.array(F.lit("someone"), F.when(F.col("p_size") % 5 == 0, _text("AI of ", F.col("p_brand"))).otherwise("SAINT"))).alias("machine"), bundles.marker_parts("p_name").isNull().alias("none"),
    )
    return _wide(rows.select("p_partkey", "uuid", "relative", "m.edition", "m.seq", "machine", "none"), "seq")


def body_chars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which characters of the basic plane may stand in a text's body."""
    points = spark.range(0x2000, 0xD800).select(F.col("id").alias("codepoint"))
    return points.select("codepoint", fn.body_char(F.decode(F.unhex(F.lpad(F.hex("codepoint"), 4, "0")), "UTF-16BE")).alias("body"))


def range_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether ranges lie in their text."""
    at, n = (F.col("p_size") - 5).cast("int"), (F.col("p_partkey") % 9 - 1).cast("int")
    return _part(spark, sf_dir).select("p_partkey", slices.checked(F.col("p_name"), at, n).alias("valid"))


# -- characters ------------------------------------------------------------------------------


def private_use(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters of the private plane in each brand's texts."""
    rows = _part(spark, sf_dir).select(F.col("p_brand").alias("textid"), udfs.expand_entities(_text(F.col("p_name"), "&KR", F.lpad((F.col("p_size") % 7).cast("string"), 4, "0"), ";")).alias("text"))
    return _wide(chars.private_use(rows, "textid"), "codepoint")


def charset_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mapping held against its charset."""
    entries = spark.createDataFrame([("é", "e"), ("è", "e"), ("é", "ê"), ("a", "b"), ("x", "☃")], "source string, replacement string")
    charset = chars.survey(_part(spark, sf_dir).select(F.col("p_name").alias("text"))).select("char")
    return chars.check_mapping(entries, charset)


def lemma_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _part(spark, sf_dir).select(F.col("p_partkey").alias("voice"), F.col("p_name").alias("lemma"), F.col("p_size").alias("start"), F.lit("丨a丨丨").alias("text"))
    return _wide(chars.lemma_repeats(rows), "position")


def punctuation_weave(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names with their punctuation put back."""
    mark = lambda at, kind, content: F.struct(at.cast("int").alias("offset"), F.lit(kind).alias("type"), F.lit(content).alias("content"))
    rows = _part(spark, sf_dir).select("p_partkey", F.col("p_name").alias("text"), F.array(mark(F.length("p_name"), "punctuation", "。"), mark(F.lit(1), "punctuation", "，"), mark(F.lit(2), "note", "no")).alias("markers"))
    return slices.with_punctuation(rows).select("p_partkey", "punctuated")


# -- queries as text ------------------------------------------------------------------------

_MODES = ("abc", "a NEAR b", "a NOT b", "a NEAR", "/ab+c/is", r"/a\/b/", "/ab", "/a/x", "/(/", "/x?/", r"/a\.bc\d/", "/(?i)hello/", "/(ab)?cd/", "/a/b/i", "plain /slash/")


def query_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How queries are read: mode, literal run, or the code of the refusal."""
    rows = []
    for text in _MODES:
        try:
            query = parse.parse(text)
            rows.append((text, query.mode, query.anchor, None))
        except parse.QueryError as error:
            rows.append((text, None, None, error.code))
    return spark.createDataFrame(rows, "query string, mode string, anchor string, error string")


MODES = r"""select * from (values ('abc', 'literal', null, null), ('a NEAR b', 'near', null, null), ('a NOT b', 'not', null, null), ('a NEAR', null, null, 'invalid_compound_query'), ('/ab+c/is', 'regex', null, null), ('/a\/b/', 'regex', 'a/b', null),
  ('/ab', null, null, 'invalid_regex'), ('/a/x', null, null, 'invalid_regex'), ('/(/', null, null, 'invalid_regex'), ('/x?/', null, null, 'zero_length_regex'), ('/a\.bc\d/', 'regex', 'a.bc', null), ('/(?i)hello/', 'regex', null, null),
  ('/(ab)?cd/', 'regex', 'cd', null), ('/a/b/i', 'regex', null, null), ('plain /slash/', 'literal', null, null)) t(query, mode, anchor, error)"""


def kwic_regex_ignore_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An expression that ignores case by itself: no text is passed over for its spelling."""
    scope = [f"src{n}" for n in range(20)]
    return _wide(search.search(sources(spark, sf_dir), '/(?i)TOKEN = "[0-9A-F]{8}/', scope=scope), "master_offset").select(HIT)


IGNORE_CASE = """with h as (select doc_id as bucket_id, source as textid, lang as kind, text, o as master_offset
  from (select *, unnest(range(0, length(text) - 16)) as o from documents where contains(lower(text), 'token = "') and source in (select 'src' || i from range(20) t(i))) where regexp_matches(substring(text, o + 1, 17), '^(?i)token = "[0-9a-f]{8}$'))
""" + ", " + KWIC.format(n=17) + " select * from k"


def hit_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The characters around each hit."""
    found = search.neighbours(search.search(sources(spark, sf_dir), "tionth"))
    return _wide(found.select("bucket_id", "master_offset", "left_char", "right_char", "left_bigram", "right_bigram", "around"), "master_offset")


NEIGHBOURS = kwic_sql("tionth") + """ select bucket_id, master_offset, right("left", 1) as left_char, substring("right", 1, 1) as right_char, if(length("left") >= 2, right("left", 2), '') as left_bigram, if(length("right") >= 2, left("right", 2), '') as right_bigram,
  if("left" <> '' and "right" <> '', right("left", 1) || left("right", 1), '') as around from k"""


def hit_recipes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each hit as a pin."""
    pins = search.recipe(search.search(sources(spark, sf_dir), "555-5"))
    return _wide(pins.select("pin.id", "pin.role", "pin.selection.bucket", "pin.selection.offset", "pin.selection.length"), "offset", "length")


def overview_switch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a query has more hits than a page of results holds."""
    hits = search.search(sources(spark, sf_dir), "the ")
    return spark.createDataFrame([(cap, order.over_cap(hits, cap)) for cap in (100, 1_000_000_000)], "cap long, over boolean")


# -- labels of syntactic functions ---------------------------------------------------------------


def _functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types of parts as labels; some are spelled wrongly, and one brand accepts that."""
    kind, size = F.col("p_type"), F.col("p_size") % 5
    code = F.when(size == 0, kind).when(size == 1, _text("(", kind)).when(size == 2, _text(kind, ")")).when(size == 3, _text(kind, " ?")).otherwise("")
    return _part(spark, sf_dir).select(F.lpad(F.col("p_partkey").cast("string"), 9, "0").alias("uuid"), code.alias("code"), F.when(F.col("p_brand") == "Brand#2", F.array(F.lit("unmatched-open"), F.lit("whitespace"))).otherwise(F.array().cast("array<string>")).alias("accept"))


def _morphemes(spark: SparkSession, sf_dir: str) -> frozenset[str]:
    """The types there are: a closed list of a few."""
    return frozenset(r["p_type"] for r in _part(spark, sf_dir).select("p_type").distinct().limit(1000).collect())


def label_lint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _wide(labels.lint(_functions(spark, sf_dir), _morphemes(spark, sf_dir)), "start", "end")


LINT = """with f as (select lpad(p_partkey::varchar, 9, '0') as uuid, case p_size % 5 when 0 then p_type when 1 then '(' || p_type when 2 then p_type || ')' when 3 then p_type || ' ?' else '' end as code, p_size % 5 as k, p_brand = 'Brand#2' as mild, length(p_type) as n from part),
  d as (select *, row_number() over (partition by code order by uuid) as place from f)
  select uuid, code, 'error' as severity, 'unmatched-open' as kind, 0::bigint as "start", 1::bigint as "end" from f where k = 1 and not mild
  union all select uuid, code, 'error', 'unmatched-close', n, n + 1 from f where k = 2
  union all select uuid, code, 'warning', 'whitespace', n, n + 1 from f where k = 3 and not mild
  union all select uuid, code, 'warning', 'unknown-token', n + 1, n + 2 from f where k = 3
  union all select uuid, '', 'error', 'missing-code', 0, 0 from f where k = 4
  union all select uuid, code, 'warning', 'duplicate-code', 0, 0 from d where place > 1 and code <> ''"""


def label_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Syntax trees of labels with nested brackets, as nodes with their parents."""
    label = _text("[", F.col("p_type"), "(", F.col("p_size"), ")]+", F.when(F.col("p_size") % 2 == 0, ")").otherwise("("))
    rows = _part(spark, sf_dir).select("p_partkey", F.explode(labels.trees(label, _morphemes(spark, sf_dir))).alias("t"))
    return _wide(rows.select("p_partkey", "t.*"), "node", "parent", "start", "end")


TREES = """with p as (select p_partkey, p_type as k, p_size::varchar as s, p_size % 2 = 0 as even, length(p_type) as n, length(p_size::varchar) as m, '[' || p_type || '(' || p_size || ')]+' || if(p_size % 2 = 0, ')', '(') as label from part)
  select p_partkey, 0::bigint as node, null::bigint as parent, 'label' as kind, label as text, 0::bigint as "start", length(label) as "end" from p union all select p_partkey, 1, 0, 'group', '[' || k || '(' || s || ')]', 0, n + m + 4 from p
  union all select p_partkey, 2, 1, 'atom', k, 1, n + 1 from p union all select p_partkey, 3, 1, 'group', '(' || s || ')', n + 1, n + m + 3 from p union all select p_partkey, 4, 3, 'number', s, n + 2, n + m + 2 from p
  union all select p_partkey, 5, 0, 'connector', '+', n + m + 4, n + m + 5 from p union all select p_partkey, 6, 0, if(even, 'close', 'group'), if(even, ')', '('), n + m + 5, n + m + 6 from p"""


def label_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels split into tokens: morphemes, connectors, brackets and numbers."""
    label = _text("(", F.col("p_type"), " + ", F.col("p_size"), ")...zz")
    rows = _part(spark, sf_dir).select("p_partkey", F.explode(labels.tokenised(label, _morphemes(spark, sf_dir))).alias("t"))
    return _wide(rows.select("p_partkey", "t.kind", "t.text", "t.start", "t.end"), "start", "end")


TOKENS = """with p as (select p_partkey, p_type, p_size::varchar as size, length(p_type) as n, length(p_size::varchar) as m from part)
  select p_partkey, 'open' as kind, '(' as text, 0::bigint as "start", 1::bigint as "end" from p union all select p_partkey, 'atom', p_type, 1, n + 1 from p union all select p_partkey, 'connector', '+', n + 2, n + 3 from p
  union all select p_partkey, 'number', size, n + 4, n + 4 + m from p union all select p_partkey, 'close', ')', n + 4 + m, n + 5 + m from p union all select p_partkey, 'ellipsis', '...', n + 5 + m, n + 8 + m from p
  union all select p_partkey, 'unknown', 'zz', n + 8 + m, n + 10 + m from p"""


# -- passages --------------------------------------------------------------------------------------


def located_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A passage of each document with what stands around it."""
    docs = sources(spark, sf_dir)
    found = docs.where(F.length("text") >= 100).select(F.md5("text").alias("cluster"), "bucket_id", F.lit(50).alias("start"), F.lit(80).alias("end"))
    return passages.located(found, docs).select("cluster", "bucket_id", "left", "passage", "right")


def duplication_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbouring documents with what stands before and after a span of each."""
    docs = sources(spark, sf_dir).where(F.length("text") >= 100)
    pairs = docs.select(F.col("bucket_id").alias("bucket_a"), (F.col("bucket_id") + 1).alias("bucket_b"), F.lit(5).alias("longest_a"), F.lit(60).alias("longest_b"), F.lit(30).alias("longest_span"))
    return bundles.detail(pairs, docs, 25).select("bucket_a", "bucket_b", "head_a", "span_a", "tail_a", "head_b", "span_b", "tail_b")


def directed_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For the occurrences in one source, markers to all others of their clusters."""
    return passages.directed(_occurrences(spark, sf_dir), [7])


DIRECTED = "with " + OCC + """ select distinct t.bucket_id, t."start" as "offset", t."end" - t."start" as length, o.bucket_id as to_bucket, o."start" as to_start, o."end" as to_end
  from o t join o on o.cluster = t.cluster and (o.bucket_id <> t.bucket_id or o."start" <> t."start" or o."end" <> t."end") where t.bucket_id = 7"""


def cluster_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters numbered by length, occurrences and place."""
    found = _occurrences(spark, sf_dir).withColumn("length", F.col("end") - F.col("start") + F.col("cluster") % 9)
    return order.numbered(passages.listed(found), F.desc("length"), F.desc("occurrence_count"), "first_bucket", "first_start", "cluster")


CLUSTER_ORDER = "with " + OCC + """, l as (select cluster, max("end" - "start" + cluster % 9) as length, count(*) as occurrence_count, min({'b': bucket_id, 's': "start", 'e': "end"}) as least from o group by cluster)
  select cluster, length, occurrence_count, least.b as first_bucket, least.s as first_start, row_number() over (order by length desc, occurrence_count desc, least.b, least.s, cluster) as position from l"""


def scan_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a scan will cost, from a sample that is the whole table."""
    found = passages.estimate(sources(spark, sf_dir), 12, 24, 1.0)
    return spark.createDataFrame([(found["sources"], found["chars"], float(found["anchors"]), float(found["pairs"]))], "sources long, chars long, anchors double, pairs double")


def stored_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Occurrences of clusters stored as an index with its parameters, and looked up in it if they still hold."""
    path = scratch(spark, "lookup")
    meta = {"anchor": "12", "passage": "24"}
    sinks.write_index({"occurrences": _occurrences(spark, sf_dir), "parameters": spark.createDataFrame(list(meta.items()), "key string, value string")}, path, {"occurrences": ["bucket_id"]})
    stale = bundles.reusable(sinks.read_index(spark, path, "parameters"), meta | {"passage": "80"})
    fresh = bundles.reusable(sinks.read_index(spark, path, "parameters"), meta)
    found = passages.lookup(_wide(sinks.read_index(spark, path, "occurrences"), "bucket_id"), 7, 900)
    return found.select("cluster", "bucket_id", "start", "end", F.lit(fresh and not stale).alias("reusable"))


def connected_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts linked to the tenth after them within fifty: the components of the links."""
    key = F.col("p_partkey")
    edges = _part(spark, sf_dir).where(key % 50 < 40).select(key.alias("a"), (key + 10).alias("b"))
    return components(edges)


def covered_chars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters of each source inside any passage."""
    return bundles.covered(_occurrences(spark, sf_dir))


COVERED = "with " + OCC + """, m as (select *, max("end") over (partition by bucket_id order by "start", "end" rows between unbounded preceding and 1 preceding) as b from (select distinct bucket_id, "start", "end" from o)),
  i as (select *, sum(case when b is null or "start" > b then 1 else 0 end) over (partition by bucket_id order by "start", "end" rows between unbounded preceding and current row) as n from m),
  k as (select bucket_id, n, max("end") - min("start") as chars from i group by bucket_id, n) select bucket_id, sum(chars)::bigint as chars from k group by bucket_id"""

QUERIES = {
    f.__name__: f
    for f in (
        text_folds, entity_round_trip, text_id_forms, short_refs, section_codes, centuries, content_hashes, id_parts, body_chars, range_checks, private_use, charset_check, lemma_repeats, punctuation_weave, query_modes,
        kwic_regex_ignore_case, hit_neighbours, hit_recipes, overview_switch, label_lint, label_trees, label_tokens, located_passages, duplication_detail, directed_markers, cluster_order, scan_estimate, stored_lookup, connected_sources, covered_chars,
    )
}
ORACLE = {
    "text_folds": r"select doc_id as bucket_id, md5(nfc_normalize(text)) as nfc, md5(strip_accents(lower(nullif(regexp_replace(text, '^\s+|\s+$', '', 'g'), '')))) as fold from documents",
    "entity_round_trip": "select p_partkey, p_name || chr((1069056 + p_partkey % 3000)::int) || '&KRx;' as expanded, p_name || '&KR' || lpad((p_partkey % 3000)::varchar, 4, '0') || ';&KRx;' as back from part",
    "text_id_forms": "with " + REF + " select p_partkey, if(p_size % 3 = 2, (select p_name from part where part.p_partkey = r.p_partkey), 'KR' || section || lpad(serial::varchar, 4, '0')) as textid from r",
    "short_refs": "with " + REF + """ select p_partkey, section || serial || '/' || p_size || '/' || if(p_size % 2 = 0, '', 'front') || '@' || p_partkey * 3 || '+12' as ref, 'KR' || section || lpad(serial::varchar, 4, '0') as textid, p_size::bigint as seq,
  if(p_size % 2 = 0, 'body', 'front') as bucket, p_partkey * 3 as "offset", 12::bigint as length from r""",
    "section_codes": "with c as (select distinct p_size as n, lower(left(p_type, 2)) as s from part where p_size <> 7) select 'KR' || n || s as code, row_number() over (order by n, s) as position from c",
    "centuries": CENTURIES,
    "content_hashes": """select p_partkey, 'sha256:' || sha256(p_name) as text, 'sha256:' || sha256('{"a":"' || p_name || ' é","b":' || p_size || ',"hash":"old"}') as json, 'sha256:' || sha256('{"a":"' || p_name || ' é","b":' || p_size || ',"hash":""}') as own from part""",
    "id_parts": "select p_partkey, 'w' || p_partkey as uuid, p_partkey::varchar as relative, 'X' as edition, (p_size % 1000)::bigint as seq, p_size % 5 = 0 as machine, true as none from part",
    "body_chars": "select i as codepoint, i between 13312 and 19903 or i between 19968 and 40959 as body from range(8192, 55296) t(i)",
    "range_checks": "select p_partkey, p_size - 5 >= 0 and p_partkey % 9 - 1 >= 0 and p_size - 5 + p_partkey % 9 - 1 <= length(p_name) as valid from part",
    "private_use": "select p_brand as textid, chr(1069056 + p_size % 7) as char, (1069056 + p_size % 7)::bigint as codepoint, count(*) as n from part group by p_brand, p_size % 7",
    "charset_check": """with e as (select * from (values ('é', 'e'), ('è', 'e'), ('é', 'ê'), ('a', 'b'), ('x', '☃')) t(source, replacement)), c as (select distinct unnest(string_split(p_name, '')) as char from part)
  select distinct source as char, 'source is canonical' as problem from e where source in (select char from c) union all select distinct replacement, 'replacement is not canonical' from e where replacement not in (select char from c)
  union all select source, 'repeated source' from e group by source having count(*) > 1""",
    "lemma_repeats": "select p_partkey as voice, (p_size + o)::bigint as position, substring(p_name, (i % length(p_name) + 1)::int, 1) as replacement from part, (values (0, 0), (1, 2), (2, 3)) t(i, o)",
    "punctuation_weave": "select p_partkey, left(p_name, 1) || '，' || substring(p_name, 2) || '。' as punctuated from part",
    "query_modes": MODES,
    "kwic_regex_ignore_case": IGNORE_CASE,
    "hit_neighbours": NEIGHBOURS,
    "hit_recipes": kwic_sql("555-5") + " select textid as id, 'match' as role, bucket_id as bucket, master_offset as \"offset\", 5::bigint as length from k",
    "overview_switch": kwic_sql("the ") + " select cap, (select count(*) from h) > cap as over from (values (100::bigint), (1000000000::bigint)) t(cap)",
    "label_lint": LINT,
    "label_trees": TREES,
    "label_tokens": TOKENS,
    "located_passages": "select md5(text) as cluster, doc_id as bucket_id, substring(text, 31, 20) as \"left\", substring(text, 51, 30) as passage, substring(text, 81, 20) as \"right\" from documents where length(text) >= 100",
    "duplication_detail": """with d as (select doc_id, text from documents where length(text) >= 100) select x.doc_id as bucket_a, y.doc_id as bucket_b, left(x.text, 5) as head_a, substring(x.text, 6, 30) as span_a, substring(x.text, 36, 25) as tail_a,
  substring(y.text, 36, 25) as head_b, substring(y.text, 61, 30) as span_b, substring(y.text, 91, 25) as tail_b from d x join d y on y.doc_id = x.doc_id + 1""",
    "directed_markers": DIRECTED,
    "cluster_order": CLUSTER_ORDER,
    "scan_estimate": "with " + WINNOW + """, u as (select count(*) as n from a group by hash having count(*) > 1)
  select (select count(*) from documents) as sources, (select sum(length(text)) from documents)::bigint as chars, (select count(*) from a)::double as anchors, (select coalesce(sum(n * (n - 1) / 2), 0) from u)::double as pairs""",
    "stored_lookup": "with " + OCC + """, h as (select * from o where bucket_id = 7 and "start" <= 900 and "end" > 900) select *, true as reusable from o where cluster in (select cluster from h)
  and not exists (select 1 from h where h.cluster = o.cluster and h.bucket_id = o.bucket_id and h."start" = o."start" and h."end" = o."end")""",
    "connected_sources": """with e as (select p_partkey as a, p_partkey + 10 as b from part where p_partkey % 50 < 40), n as (select a as node from e union select b from e)
  select node, (select min(m.node) from n m where m.node // 50 = n.node // 50 and m.node % 10 = n.node % 10) as component from n""",
    "covered_chars": COVERED,
}
