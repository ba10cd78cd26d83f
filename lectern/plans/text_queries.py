"""Queries on intervals, slices, characters, voices, validation, annotations and translations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.functions import text as fn
from lectern.functions.udfs import align_ops as align
from lectern.operators import annotations, chars, curation, intervals, order, slices, validate, voices, witness
from lectern.plans.search_queries import _turns, sources
from lectern.storage import table

# -- intervals over line items: shipping days of a part ----------------------------


def _days(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.datediff(F.to_date("l_shipdate"), F.lit("1995-01-01")).cast("bigint")
    return table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("part"), day.alias("start"), (day + F.col("l_quantity").cast("int")).alias("end"), F.col("l_orderkey").alias("item"), F.col("l_linenumber").alias("line"))


DAYS = "d as (select l_partkey as part, date_diff('day', date '1995-01-01', l_shipdate::date)::bigint as \"start\", date_diff('day', date '1995-01-01', l_shipdate::date)::bigint + l_quantity::int as \"end\", l_orderkey as item, l_linenumber as line from lineitem)"


def interval_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.merged(_days(spark, sf_dir), ["part"])


MERGE = "with " + DAYS + """, m as (select *, max("end") over (partition by part order by "start", "end" rows between unbounded preceding and 1 preceding) as b from d),
  i as (select *, sum(case when b is null or "start" > b then 1 else 0 end) over (partition by part order by "start", "end" rows between unbounded preceding and current row) as n from m)
  select part, min("start") as "start", max("end") as "end", count(*) as pieces from i group by part, n"""


def gap_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = intervals.merged(_days(spark, sf_dir), ["part"])
    return intervals.gaps(merged, ["part"]).select("part", "start", "gap")


GAP = f'select part, "start", "start" - lag("end") over (partition by part order by "start", "end") as gap from ({MERGE})'


def seg_lead(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = intervals.merged(_days(spark, sf_dir), ["part"]).select("part", "start")
    return intervals.ends(merged, ["part"], "start", F.lit(4000).cast("bigint"))


def _micros(column: str) -> Column:
    """Microseconds since 1970 of a time without zone, whatever the session's zone."""
    return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', {column})")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "ts", "value", "props")


def run_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of one event type of a user."""
    return intervals.runs(_events(spark, sf_dir), ["user_id"], "event_id", "event_type")


RUNS = """with c as (select *, case when lag(event_type) over w is not distinct from event_type and lag(event_id) over w is not null then 0 else 1 end as changed from events window w as (partition by user_id order by event_id)),
  r as (select *, sum(changed) over (partition by user_id order by event_id rows between unbounded preceding and current row) as run from c)
  select user_id, event_type, min(event_id) as "first", max(event_id) as "last", count(*) as n from r group by user_id, run, event_type"""


def last_anchor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last signup of a user before each event."""
    found = intervals.carried(_events(spark, sf_dir), ["user_id"], "event_id", F.when(F.col("event_type") == "signup", F.col("event_id")), "after")
    return found.select("user_id", "event_id", "after")


def paren_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running depth of a user's purchases (open) and errors (close)."""
    marks = _events(spark, sf_dir).where("event_type in ('purchase', 'error')")
    step = F.when(F.col("event_type") == "purchase", 1).otherwise(-1)
    return intervals.depth(marks, ["user_id"], ["event_id"], step).select("user_id", "event_id", "depth")


def gap_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of a user's clicks with up to 500 other events between them."""
    found = intervals.clustered(_events(spark, sf_dir).where("event_type = 'click'"), ["user_id"], "event_id", 500)
    return found.groupBy("user_id", "cluster").agg(F.min("event_id").alias("first"), F.count(F.lit(1)).alias("n"))


CLUSTERS = """with a as (select user_id, event_id, case when event_id - lag(event_id) over (partition by user_id order by event_id) - 1 > 500 then 1 else 0 end as apart from events where event_type = 'click'),
  c as (select *, sum(apart) over (partition by user_id order by event_id rows between unbounded preceding and current row) as cluster from a)
  select user_id, cluster::bigint as cluster, min(event_id) as "first", count(*) as n from c group by user_id, cluster"""


def running_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = intervals.counter(_events(spark, sf_dir), ["user_id"], F.left("event_type", F.lit(1)), ["event_id"])
    return found.select("event_id", "id")


def nearest_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each part the merged interval nearest to day 1200."""
    merged = intervals.merged(_days(spark, sf_dir), ["part"])
    return intervals.nearest(merged, ["part"], F.lit(1200)).select("part", "start", "end")


NEAREST = f"""select part, r."start" as "start", r."end" as "end" from (select part, arg_min({{'start': "start", 'end': "end"}}, {{'d': case when 1200 < "start" then "start" - 1200 when 1200 >= "end" then 1200 - "end" + 1 else 0 end, 's': "start", 'e': "end"}}) as r from ({MERGE}) group by part)"""

# -- characters --------------------------------------------------------------------


def char_survey(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chars.survey(sources(spark, sf_dir)).withColumn("codepoint", F.col("codepoint").cast("bigint"))


CHARS = "c as (select ch as char, count(*) as n, unicode(ch)::bigint as codepoint from (select unnest(string_split(text, '')) as ch from documents) where ch <> '' group by ch)"
BLOCKS = [("basic latin", 0, 0x7F), ("latin-1", 0x80, 0xFF), ("latin extended", 0x100, 0x24F)]


def block_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chars.rollup(chars.survey(sources(spark, sf_dir)), BLOCKS)


def char_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chars.findings(sources(spark, sf_dir), "textid", F.col("char").rlike("^[A-Za-z .,]$"))


MAPPING = {"é": "e", "è": "e", "ñ": "n", "ü": "u", "ß": "s", "ç": "c"}


def canonicalise_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sources(spark, sf_dir).select("bucket_id", F.md5(chars.canonical(F.col("text"), MAPPING)).alias("digest"))


def subst_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = chars.substitutions(sources(spark, sf_dir), "bucket_id", MAPPING)
    return found.withColumn("offset", F.col("offset").cast("bigint"))


def subst_revert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of parts made canonical and turned back again."""
    mapping = {"i": "1", "o": "0", "e": "3"}
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("bucket_id"), F.col("p_name").alias("text"))
    marks = chars.substitutions(part, "bucket_id", mapping).groupBy("bucket_id").agg(F.sort_array(F.collect_list(F.struct("offset", "content", "replacement"))).alias("marks"))
    made = part.join(marks, "bucket_id").withColumn("text", chars.canonical(F.col("text"), mapping))
    return made.select("bucket_id", chars.reverted(F.col("text"), F.col("marks")).alias("text"))


def char_unmapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    charset = spark.createDataFrame([(c,) for c in "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ .,\n"], "char string")
    return chars.unmapped(sources(spark, sf_dir), charset, MAPPING)


def variant_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accented letters and their bases as variants, with their counts in documents."""
    rows = [("é", "e", "accent"), ("e", "è", "accent"), ("é", "e", "acute"), ("ñ", "n", "tilde"), ("ß", "s", "ligature"), ("ü", "u", "umlaut"), ("q", "☃", "none")]
    found = chars.variant_pairs(spark.createDataFrame(rows, "a string, b string, type string"), chars.survey(sources(spark, sf_dir)))
    return found.select("major", "count_major", "minor", "count_minor", F.round("ratio", 9).alias("ratio"), F.array_join("types", ",").alias("types"))


VARIANTS = "with " + CHARS + """, p as (select * from (values ('é', 'e', 'accent'), ('e', 'è', 'accent'), ('é', 'e', 'acute'), ('ñ', 'n', 'tilde'), ('ß', 's', 'ligature'), ('ü', 'u', 'umlaut'), ('q', '☃', 'none')) t(a, b, type)),
  u as (select least(a, b) as x, greatest(a, b) as y, string_agg(distinct type, ',' order by type) as types from p group by 1, 2)
  select if(cy.n > cx.n, y, x) as major, greatest(cx.n, cy.n) as count_major, if(cy.n > cx.n, x, y) as minor, least(cx.n, cy.n) as count_minor, round(least(cx.n, cy.n) / greatest(cx.n, cy.n), 9) as ratio, types
  from u join c cx on cx.char = x join c cy on cy.char = y"""


def text_dossier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chars.dossier(sources(spark, sf_dir), "textid")


# -- slices and edits ---------------------------------------------------------------


def slice_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sources(spark, sf_dir).withColumn("markers", F.array().cast("array<struct<offset:int,length:int,type:string,id:string>>"))
    cut = slices.by_offset(rows, F.lit(300), F.lit(120))
    return cut.select("bucket_id", "slice")


def _marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as texts with a marker at the start of each turn."""
    turns = _turns(spark, sf_dir).join(table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("bucket_id"), "turn", "text"), ["bucket_id", "turn"])
    each = F.struct("turn", "text", F.col("r_start").cast("int").alias("offset"), F.col("name").alias("type"))
    grouped = turns.groupBy("bucket_id").agg(F.sort_array(F.collect_list(each)).alias("t"))
    marker = lambda x: F.struct(x["offset"].alias("offset"), F.length(x["text"]).alias("length"), x["type"].alias("type"), F.concat(F.lit("t"), x["turn"].cast("string")).alias("id"))
    return grouped.select("bucket_id", F.array_join(F.transform("t", lambda x: x["text"]), "").alias("text"), F.transform("t", marker).alias("markers"))


MARKED = """t as (select conv_id as bucket_id, turn, role, text, coalesce(sum(length(text)) over (partition by conv_id order by turn rows between unbounded preceding and 1 preceding), 0)::bigint as o from conversations),
  x as (select bucket_id, string_agg(text, '' order by turn) as text from t group by bucket_id)"""


def slice_rebase_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = slices.by_offset(_marked(spark, sf_dir), F.lit(100), F.least(F.length("text") - 100, F.lit(900)))
    return cut.select("bucket_id", F.explode("slice_markers").alias("m")).select("bucket_id", F.col("m.id").alias("id"), F.col("m.offset").cast("bigint").alias("offset"))


def slice_between_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = slices.between_markers(_marked(spark, sf_dir), "t2", "t1")
    return cut.select("bucket_id", F.col("slice").alias("text"))


def section_merge_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns joined to one text, with the offset at which each begins."""
    rows = table(spark, sf_dir, "conversations").withColumn("markers", F.array(F.struct(F.lit(0).alias("offset"), F.col("turn").alias("id"))))
    merged = slices.merge_sections(rows.select("conv_id", "turn", "text", "markers"), ["conv_id"], "turn")
    return merged.select("conv_id", F.length("text").cast("bigint").alias("chars"), F.array_join(F.transform("markers", lambda m: m["offset"].cast("string")), ",").alias("offsets"))


def multi_delete_rebase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations without three spans, two of which overlap; each span ends where its text does."""
    span = lambda a, b: F.struct(F.least(F.lit(a), F.length("text")).cast("int").alias("start"), F.least(F.lit(b), F.length("text")).cast("int").alias("end"))
    rows = _marked(spark, sf_dir).withColumn("spans", F.array(span(400, 450), span(50, 90), span(80, 200)))
    cut = slices.delete_spans(rows)
    return cut.select("bucket_id", F.md5("text").alias("digest"), F.array_join(F.transform("markers", lambda m: F.concat(m["id"], F.lit("@"), m["offset"].cast("string"))), ",").alias("markers"))


DELETE = "with " + MARKED + """, k as (select bucket_id, md5(substring(text, 1, 50) || substring(text, 201, 200) || substring(text, 451)) as digest, least(50, length(text)) as a, least(200, length(text)) as b, least(400, length(text)) as c, least(450, length(text)) as d from x),
  m as (select bucket_id, turn, 't' || turn || '@' || (o - if(b <= o, b - a, 0) - if(d <= o, d - c, 0)) as id from t join k using (bucket_id) where not (o >= a and o < b) and not (o >= c and o < d)),
  r as (select bucket_id, string_agg(id, ',' order by turn) as markers from m group by bucket_id)
  select bucket_id, digest, coalesce(markers, '') as markers from k left join r using (bucket_id)"""


def align_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Least-edit scripts between the names of neighbouring parts: what they make of the first, and their edits."""
    part = table(spark, sf_dir, "part")
    pairs = part.select("p_partkey", F.col("p_name").alias("a")).join(part.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("b")), "p_partkey")
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    kept = lambda acc, op: F.struct((acc["at"] + op["n"]).alias("at"), F.concat(acc["out"], fn.slice_text("a", acc["at"], op["n"])).alias("out"))
    changed = lambda acc, op: F.struct((acc["at"] + F.length(op["a"])).alias("at"), F.concat(acc["out"], op["b"]).alias("out"))
    ops = pairs.withColumn("ops", align("a", "b"))
    made = F.aggregate("ops", start, lambda acc, op: F.when(op["op"] == "=", kept(acc, op)).otherwise(changed(acc, op)), lambda acc: acc["out"])
    return ops.select("p_partkey", made.alias("made"), F.size(F.filter("ops", lambda op: op["op"] != "=")).cast("bigint").alias("edits"))


def splice_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions, content spans and texts of part names after an insertion and a deletion."""
    edits = F.array(F.struct(F.lit(3).alias("start"), F.lit(0).alias("delete"), F.lit("XY").alias("insert")), F.struct(F.lit(0).alias("start"), F.lit(2).alias("delete"), F.lit("").alias("insert")))
    moved = slices.rebase(F.lit(4), F.lit(2), edits)
    return table(spark, sf_dir, "part").select("p_partkey", slices.replay(F.col("p_name"), edits).alias("text"), slices.map_position(F.lit(5), edits, True).cast("bigint").alias("position"), moved["start"].cast("bigint").alias("start"), moved["conflict"].alias("conflict"))


# -- witnesses ------------------------------------------------------------------------


def witness_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names with readings of two witnesses, and where a span of each lies in the master."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("bucket_id"), F.col("p_name").alias("text"))
    a = part.select("bucket_id", F.lit(1).alias("offset"), F.lit(2).alias("length"), F.lit("A").alias("witness"), F.lit("___").alias("form"))
    b = part.where("bucket_id % 2 = 0").select("bucket_id", F.lit(0).alias("offset"), F.lit(1).alias("length"), F.lit("B").alias("witness"), F.lit("").alias("form"))
    made = witness.derive(part, a.unionByName(b))
    span = witness.to_master(F.col("segments"), F.lit(2), F.lit(5))
    return made.select("bucket_id", "witness", "text", span["offset"].cast("bigint").alias("offset"), span["length"].cast("bigint").alias("length"))


WITNESS = """select p_partkey as bucket_id, 'A' as witness, left(p_name, 1) || '___' || substring(p_name, 4) as text, 1::bigint as "offset", 3::bigint as length from part
  union all select p_partkey, 'B', substring(p_name, 2), 3::bigint, 3::bigint from part where p_partkey % 2 = 0"""

# -- voices -----------------------------------------------------------------------------


def voice_parens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases open and errors close a note on the line of a user's events."""
    events = _events(spark, sf_dir).where("event_type in ('purchase', 'error')")
    marks = events.select(F.col("user_id").alias("bucket_id"), F.col("event_id").cast("int").alias("offset"), F.lit(0).alias("ord"), F.when(F.col("event_type") == "purchase", "(").otherwise(")").alias("sign"), F.lit(1 << 30).alias("text_length"))
    found = voices.from_parens(marks)
    return found.select("bucket_id", F.col("start").cast("bigint").alias("start"), F.col("end").cast("bigint").alias("end"), "name", "problem")


PARENS = """with m as (select user_id as bucket_id, event_id as o, if(event_type = 'purchase', '(', ')') as sign, lag(if(event_type = 'purchase', '(', ')')) over (partition by user_id order by event_id) as before from events where event_type in ('purchase', 'error')),
  k as (select *, case when sign = '(' and before = '(' then 'nested' when sign = ')' and before is distinct from '(' then 'stray' else sign end as kind from m),
  p as (select bucket_id, o, kind, lead(o) over w as close, lead(kind) over w as close_kind from k where kind in ('(', ')') window w as (partition by bucket_id order by o))
  select bucket_id, o as "start", close as "end", 'note' as name, null::varchar as problem from p where kind = '(' and close_kind = ')'
  union all select bucket_id, o, o, null, kind from k where kind in ('nested', 'stray')
  union all select bucket_id, o, o, null, 'unmatched' from p where kind = '(' and close_kind is distinct from ')'"""

# -- annotations and translations ----------------------------------------------------------


def ann_counts_with_zeros(spark: SparkSession, sf_dir: str) -> DataFrame:
    requested = table(spark, sf_dir, "documents").select(F.concat(F.lit("uuid-"), F.col("doc_id").cast("string")).alias("sense"))
    rows = table(spark, sf_dir, "labels").where("quality = 1").select(F.concat(F.when(F.col("doc_id") % 2 == 0, "uuid-").otherwise(""), F.col("doc_id").cast("string"), F.lit("#x")).alias("sense"))
    return annotations.counts(requested, rows, "sense")


def ann_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = table(spark, sf_dir, "labels")
    raw = label.select(
        F.col("doc_id").cast("string").alias("id"), F.lit("t").alias("textid"), F.col("doc_id").alias("seq"), F.when(F.col("doc_id") % 3 == 0, "s").alias("sense_id"), F.when(F.col("toxic") == 1, "d").alias("device_id"),
        F.when(F.col("doc_id") % 7 == 0, "none").otherwise((F.col("doc_id") * 2).cast("string")).alias("offset"), F.when(F.col("quality") == 0, "rejected").alias("curation_state"), F.lit("1").alias("rating"),
    )
    return annotations.located(raw).select("id", F.col("offset").cast("bigint").alias("offset"))


def _anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten characters of each document as anchors, the text since moved by a few characters."""
    docs = table(spark, sf_dir, "documents")
    rows = docs.select("doc_id", (F.col("doc_id") % 100).cast("int").alias("offset"), F.substring("text", F.col("doc_id") % 100 + 1, F.lit(10)).alias("orth"), F.col("source").alias("marker"))
    texts = docs.select("doc_id", F.concat(F.lit("x").substr(F.lit(1), (F.col("doc_id") % 3 > 0).cast("int")), F.col("text")).alias("text"))
    return annotations.checked(rows, texts, ["doc_id"], 30)


ANCHORS = """a as (select doc_id, (doc_id % 100)::int as "offset", substring(text, doc_id % 100 + 1, 10) as orth, source as marker, if(doc_id % 3 > 0, 'x', '') || text as now from documents),
  n as (select doc_id, "offset", orth, marker, substring(now, "offset" + 1, length(orth)) = orth as here, list_filter(range(greatest("offset" - 30, 0), "offset" + 31), lambda p: substring(now, p + 1, length(orth)) = orth) as near from a),
  s as (select doc_id, "offset", marker, case when here then 'ok' when len(near) = 1 then 'moved' when len(near) > 1 then 'ambiguous' else 'missing' end as status, case when here then "offset"::bigint when len(near) = 1 then near[1] end as new_offset from n)"""


def anchor_unique_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _anchors(spark, sf_dir).select("doc_id", "status", F.col("new_offset").cast("bigint").alias("new_offset"))


def consensus_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return annotations.consensus(_anchors(spark, sf_dir), "marker").withColumn("delta", F.col("delta").cast("bigint"))


def anchor_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return annotations.summary(_anchors(spark, sf_dir))


def translation_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as source segments; an order's clerk text covers two lines, of which the first has it."""
    item = table(spark, sf_dir, "lineitem")
    segments = item.select(F.col("l_orderkey").alias("text"), F.col("l_linenumber").cast("string").alias("corresp")).distinct()
    orders = table(spark, sf_dir, "orders").where("o_orderkey % 2 = 0")
    translated = orders.select(F.col("o_orderkey").alias("text_key"), F.array(F.lit("1"), F.lit("2")).alias("corresp"), F.lit(0).alias("ord"), F.col("o_orderpriority").alias("said"))
    found = annotations.aligned(segments.withColumnRenamed("text", "key"), translated.select(F.col("text_key").alias("key"), "corresp", "ord", F.col("said").alias("text")), ["key"])
    return found.select("key", "corresp", F.coalesce("translation", F.lit("")).alias("translation"), "continued")


ALIGN = """with s as (select distinct l_orderkey as key, l_linenumber::varchar as corresp from lineitem)
  select key, corresp, case when corresp = '1' and o_orderkey is not null then o_orderpriority else '' end as translation, corresp = '2' and o_orderkey is not null as continued
  from s left join (select * from orders where o_orderkey % 2 = 0) on o_orderkey = key"""


def translation_search_facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    segments = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("translation_id"), F.lower("text").alias("text_search"), "role")
    bundles = segments.select("translation_id").distinct().select("translation_id", F.when(F.col("translation_id") % 2 == 0, "AI draft").otherwise("by hand").alias("title"), F.array(F.lit("MAIL")).alias("names"), F.lit("en").alias("language"), (F.col("translation_id") % 90).alias("index_date"))
    found = annotations.search(segments, bundles, "the ", low=10, high=60)
    return annotations.facets(found, {"role": F.col("role"), "ai": fn.is_ai("title", "names"), "date": F.col("index_date")})


FACETS = """with h as (select conv_id, role from conversations where contains(lower(text), 'the ') and conv_id % 90 between 10 and 60)
  select dim, value, count(*) as n from (select unnest([{'dim': 'role', 'value': role}, {'dim': 'ai', 'value': (conv_id % 2 = 0)::varchar}, {'dim': 'date', 'value': (conv_id % 90)::varchar}], recursive := true) from h) group by dim, value"""

# -- validation -------------------------------------------------------------------------------


def validate_seq_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    item = table(spark, sf_dir, "lineitem")
    return validate.all_of(validate.unique(item, ["l_orderkey"], "l_linenumber", "seq"), validate.increasing(table(spark, sf_dir, "conversations"), ["conv_id"], "turn", "turn", "order"))


def validate_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = _days(spark, sf_dir)
    return validate.bounds(days, F.concat_ws("/", "item", "line"), F.col("start"), F.col("end"), F.lit(2000), "bounds")


BOUNDS = "with " + DAYS + """ select 'bounds' as rule, 'error' as severity, item || '/' || line as path, "start" || '..' || "end" || ' of 2000' as message from d where "start" < 0 or "end" < "start" or "end" > 2000"""


def validate_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return validate.orphans(orders, table(spark, sf_dir, "customer").where("c_acctbal > 0"), "c_custkey", "orphan")


def validate_idset_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    frozen = part.where("p_partkey % 5 <> 0").select("p_partkey", "p_size")
    now = part.where("p_partkey % 7 <> 0").select("p_partkey", (F.col("p_size") + (F.col("p_partkey") % 11 == 0).cast("int")).alias("p_size"))
    return validate.id_drift(frozen, now, ["p_partkey"], "p_size")


IDSET = """select coalesce(f.p_partkey, n.p_partkey) as p_partkey, case when n.p_partkey is null then 'missing' when f.p_partkey is null then 'extra' else 'repurposed' end as kind
  from (select p_partkey, p_size from part where p_partkey % 5 <> 0) f full join (select p_partkey, p_size + (p_partkey % 11 = 0)::int as p_size from part where p_partkey % 7 <> 0) n on f.p_partkey = n.p_partkey
  where n.p_partkey is null or f.p_partkey is null or f.p_size <> n.p_size"""


def validate_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.summary(validate.collapsed(validate_bounds(spark, sf_dir).withColumn("path", F.substring("path", 1, 2)), 5))


REPORT = f"""with f as (select rule, severity, left(path, 2) as path, message from ({BOUNDS})), c as (select * from (select *, row_number() over (partition by rule, path order by message) as p from f) where p <= 5)
  select dim, value, count(*) as n from (select unnest([{{'dim': 'severity', 'value': severity}}, {{'dim': 'rule', 'value': rule}}, {{'dim': 'path', 'value': path}}], recursive := true) from c) group by dim, value"""


def index_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    disk = part.where("p_partkey % 3 <> 0").select("p_partkey", F.md5("p_name").alias("digest"))
    index = part.where("p_partkey % 4 <> 0").select("p_partkey", F.md5(F.when(F.col("p_partkey") % 5 == 0, "old").otherwise(F.col("p_name"))).alias("digest"))
    return validate.drift(disk, index, "p_partkey", "digest")


DRIFT = """select coalesce(d.p_partkey, i.p_partkey) as p_partkey, case when i.h is null then 'added' when d.h is null then 'removed' else 'changed' end as state
  from (select p_partkey, md5(p_name) as h from part where p_partkey % 3 <> 0) d full join (select p_partkey, md5(if(p_partkey % 5 = 0, 'old', p_name)) as h from part where p_partkey % 4 <> 0) i on d.p_partkey = i.p_partkey where d.h is distinct from i.h"""


def stratified_sample_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of 120 sampled documents each source gives."""
    sample = order.stratified(table(spark, sf_dir, "documents").where("n_chars > 2000"), "source", "doc_id", 120)
    return sample.groupBy("source").agg(F.count(F.lit(1)).alias("n"))


QUOTA = """with c as (select source, count(*) as n from documents where n_chars > 2000 group by source), e as (select *, n * 120 / sum(n) over () as x from c),
  b as (select *, least(greatest(floor(x), 1), n) as base from e), r as (select *, greatest(120 - sum(base) over (), 0) as rest, row_number() over (order by x - floor(x) desc, source) as rk from b)
  select source, (base + if(rk <= rest and base < n, 1, 0))::bigint as n from r"""

# -- curation and feed on events -----------------------------------------------------------------


def _judgments(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    states = F.array(F.lit("accepted"), F.lit("rejected"), F.lit("proposed"), F.lit(None))
    return _events(spark, sf_dir).select(k.alias("target"), F.lit("u7").alias("author"), F.concat(F.lit("u"), (F.col("user_id") % 13).cast("string")).alias("did"), F.element_at(states, (F.col("event_id") % 4 + 1).cast("int")).alias("state"), F.when(F.col("event_id") % 5 < 3, (F.col("event_id") % 5).cast("int")).alias("rating"), _micros("ts").alias("created"), "event_id")


def curation_winner(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curation.winners(_judgments(spark, sf_dir), [f"u{i}" for i in range(0, 13, 2)])


WINNER = """with c as (select target, did, rating, epoch_us(ts0) as created, s from (select (props->>'k')::int as target, 'u' || user_id % 13 as did, (['accepted', 'rejected', 'proposed', null])[event_id % 4 + 1] as s, if(event_id % 5 < 3, (event_id % 5)::int, null) as rating, ts as ts0 from events)),
  v as (select target, did, rating, created, case when did = 'u7' and s = 'accepted' then null else s end as state from c where did in ('u0', 'u2', 'u4', 'u6', 'u8', 'u10', 'u12', 'u7'))
  select target, coalesce(arg_max(state, {'c': created, 'd': did}) filter (where state is not null), 'proposed') as state, coalesce(arg_max(rating, {'c': created, 'd': did}) filter (where rating is not null), 0) as rating from v group by target"""


def _feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    operation = F.when(F.col("event_type") == "error", "delete").when(F.col("event_type") == "signup", "create").otherwise("update")
    return _events(spark, sf_dir).select(F.concat(F.lit("at://"), F.col("user_id").cast("string")).alias("uri"), operation.alias("operation"), _micros("ts").alias("time_us"), "event_id", "value")


FEED = "f as (select 'at://' || user_id as uri, case event_type when 'error' then 'delete' when 'signup' then 'create' else 'update' end as operation, epoch_us(ts) as time_us, event_id, value from events)"
LATEST = FEED + ", l as (select * from (select *, row_number() over (partition by uri order by time_us desc, event_id desc) as rn from f) where rn = 1 and operation <> 'delete')"


def feed_upsert_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curation.latest(_feed(spark, sf_dir), "uri", ["time_us", "event_id"])


def feed_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest 50 records of the feed."""
    return curation.snapshot(feed_upsert_delete(spark, sf_dir), 50).select("uri", "time_us")


_NAMES = (
    interval_merge, gap_lag, seg_lead, run_length, last_anchor, paren_depth, gap_clusters, running_ids, nearest_row, char_survey, block_rollup, char_findings, canonicalise_query, subst_markers, subst_revert, char_unmapped, variant_pairs,
    text_dossier, slice_offset, slice_rebase_markers, slice_between_markers, section_merge_offsets, multi_delete_rebase, align_ops, splice_positions, witness_texts, voice_parens, ann_counts_with_zeros, ann_locations, anchor_unique_match,
    consensus_delta, anchor_status, translation_align, translation_search_facets, validate_seq_unique, validate_bounds, validate_orphans, validate_idset_diff, validate_report, index_drift, stratified_sample_quota, curation_winner,
    feed_upsert_delete, feed_snapshot,
)
QUERIES = {f.__name__: f for f in _NAMES}
ORACLE = {
    "interval_merge": MERGE,
    "gap_lag": GAP,
    "seg_lead": f'select part, "start", coalesce(lead("start") over (partition by part order by "start"), 4000) as "end" from ({MERGE})',
    "run_length": RUNS,
    "last_anchor": "select user_id, event_id, last_value(case when event_type = 'signup' then event_id end ignore nulls) over (partition by user_id order by event_id rows between unbounded preceding and 1 preceding) as after from events",
    "paren_depth": "select user_id, event_id, sum(if(event_type = 'purchase', 1, -1)) over (partition by user_id order by event_id rows between unbounded preceding and current row)::bigint as depth from events where event_type in ('purchase', 'error')",
    "gap_clusters": CLUSTERS,
    "running_ids": "select event_id, left(event_type, 1) || row_number() over (partition by user_id, left(event_type, 1) order by event_id) as id from events",
    "nearest_row": NEAREST,
    "char_survey": "with " + CHARS + " select * from c",
    "block_rollup": "with " + CHARS + " select case when codepoint <= 127 then 'basic latin' when codepoint <= 255 then 'latin-1' when codepoint <= 591 then 'latin extended' else 'other' end as block, count(*) as distinct_chars, sum(n)::bigint as total from c group by 1",
    "char_findings": "select textid, ch as char, if(unicode(ch) < 32, 'error', 'warning') as severity, count(*) as n from (select source as textid, unnest(string_split(text, '')) as ch from documents) where ch <> '' and not regexp_matches(ch, '^[A-Za-z .,]$') group by all",
    "canonicalise_query": "select doc_id as bucket_id, md5(translate(text, 'éèñüßç', 'eenusc')) as digest from documents",
    "subst_markers": "select doc_id as bucket_id, o - 1 as \"offset\", ch as content, translate(ch, 'éèñüßç', 'eenusc') as replacement from (select doc_id, unnest(string_split(text, '')) as ch, unnest(range(1, length(text) + 1)) as o from documents) where ch in ('é', 'è', 'ñ', 'ü', 'ß', 'ç')",
    "subst_revert": "select p_partkey as bucket_id, p_name as text from part where regexp_matches(p_name, '[ioe]')",
    "char_unmapped": "with " + CHARS + " select char, n from c where not regexp_matches(char, '^[A-Za-z .,\\n]$') and char not in ('é', 'è', 'ñ', 'ü', 'ß', 'ç')",
    "variant_pairs": VARIANTS,
    "text_dossier": "select source as textid, sum(n)::bigint as chars, count(*) as unique_chars from (select source, ch, count(*) as n from (select source, unnest(string_split(text, '')) as ch from documents) where ch <> '' group by all) group by source",
    "slice_offset": "select doc_id as bucket_id, case when length(text) >= 420 then substring(text, 301, 120) end as slice from documents",
    "slice_rebase_markers": "with " + MARKED + " select t.bucket_id, 't' || turn as id, o - 100 as \"offset\" from t join x using (bucket_id) where length(x.text) >= 100 and o >= 100 and o < 100 + least(length(x.text) - 100, 900)",
    "slice_between_markers": "with " + MARKED + " select x.bucket_id, string_agg(t.text, '' order by turn) filter (where turn = 1 and exists (select 1 from t t2 where t2.bucket_id = t.bucket_id and t2.turn = 2)) as text from x join t using (bucket_id) group by x.bucket_id",
    "section_merge_offsets": "with t as (select conv_id, turn, text, coalesce(sum(length(text)) over (partition by conv_id order by turn rows between unbounded preceding and 1 preceding), 0)::bigint as o from conversations) select conv_id, sum(length(text))::bigint as chars, string_agg(o::varchar, ',' order by turn) as offsets from t group by conv_id",
    "multi_delete_rebase": DELETE,
    "align_ops": "select a.p_partkey, b.p_name as made, levenshtein(a.p_name, b.p_name) as edits from part a join part b on b.p_partkey = a.p_partkey + 1",
    "splice_positions": "select p_partkey, substring(left(p_name, 3) || 'XY' || substring(p_name, 4), 3) as text, 5::bigint as position, 4::bigint as \"start\", false as conflict from part",
    "witness_texts": WITNESS,
    "voice_parens": PARENS,
    "ann_counts_with_zeros": "select 'uuid-' || d.doc_id as sense, count(l.doc_id) as n from documents d left join (select * from labels where quality = 1) l on l.doc_id = d.doc_id group by d.doc_id",
    "ann_locations": "select doc_id::varchar as id, doc_id * 2 as \"offset\" from labels where quality <> 0 and (doc_id % 3 = 0 or toxic = 1) and doc_id % 7 <> 0",
    "anchor_unique_match": "with " + ANCHORS + " select doc_id, status, new_offset from s",
    "consensus_delta": "with " + ANCHORS + ' select marker, min(new_offset - "offset") as delta from s where status = \'moved\' group by marker having count(distinct new_offset - "offset") = 1',
    "anchor_status": "with " + ANCHORS + " select status, count(*) as n from s group by status",
    "translation_align": ALIGN,
    "translation_search_facets": FACETS,
    "validate_seq_unique": "select 'seq' as rule, 'error' as severity, l_orderkey::varchar as path, 'repeated ' || l_linenumber as message from lineitem group by l_orderkey, l_linenumber having count(*) > 1",
    "validate_bounds": BOUNDS,
    "validate_orphans": "select 'orphan' as rule, 'error' as severity, o_custkey::varchar as path, 'points to nothing' as message from orders where o_custkey not in (select c_custkey from customer where c_acctbal > 0)",
    "validate_idset_diff": IDSET,
    "validate_report": REPORT,
    "index_drift": DRIFT,
    "stratified_sample_quota": QUOTA,
    "curation_winner": WINNER,
    "feed_upsert_delete": "with " + LATEST + " select uri, operation, time_us, event_id, value from l",
    "feed_snapshot": "with " + LATEST + " select uri, time_us from l order by time_us desc, uri desc limit 50",
}
