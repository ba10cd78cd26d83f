"""Search queries on the driver's tables: documents are sources, their source the text id."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.operators import intervals, order, search
from lectern.storage import spread, table

CONTEXT = 20


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("bucket_id"), F.col("source").alias("textid"), F.col("lang").alias("kind"), "text"))


def _long(rows: DataFrame, *columns: str) -> DataFrame:
    return rows.withColumns({c: F.col(c).cast("bigint") for c in columns})


HIT = ["bucket_id", "textid", "kind", "master_offset", "left", "match", "right"]

#: All occurrences of {q}: a window at every offset.
HITS = """h as (select doc_id as bucket_id, source as textid, lang as kind, text, o as master_offset
  from (select *, unnest(range(0, length(text) - {n} + 1)) as o from documents where contains(text, '{q}')) where substring(text, o + 1, {n}) = '{q}')"""
KWIC = """k as (select bucket_id, textid, kind, master_offset, substring(text, greatest(master_offset - 20, 0) + 1, least(master_offset, 20)) as "left",
  substring(text, master_offset + 1, {n}) as "match", substring(text, master_offset + {n} + 1, 20) as "right" from h)"""


def hits_sql(q: str) -> str:
    return "with " + HITS.format(q=q, n=len(q))


def kwic_sql(q: str) -> str:
    return hits_sql(q) + ", " + KWIC.format(n=len(q))


def kwic_literal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(search.search(sources(spark, sf_dir), "the "), "master_offset").select(HIT)


def kwic_short_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(search.search(sources(spark, sf_dir), "ßu"), "master_offset").select(HIT)


def kwic_textid_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(search.search(sources(spark, sf_dir), "tion", scope=["src1", "src7"]), "master_offset").select(HIT)


def _sorted(spark: SparkSession, sf_dir: str, sort: str) -> DataFrame:
    hits = search.search(sources(spark, sf_dir), "tionth")
    if sort == "date":
        # the smallest document of a source stands in for its date; sources without one are last
        dates = table(spark, sf_dir, "documents").where("n_chars < 400").groupBy(F.col("source").alias("textid")).agg(F.min("n_chars").alias("index_date"))
        hits = hits.join(dates, "textid", "left")
    return _long(order.numbered(hits, *search.order_keys(sort)), "master_offset", "position").select(*HIT, "position")


def kwic_sort_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sorted(spark, sf_dir, "match")


def kwic_sort_textid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sorted(spark, sf_dir, "textid")


def kwic_sort_reverse_prematch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sorted(spark, sf_dir, "reverse_prematch")


def kwic_sort_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sorted(spark, sf_dir, "date")


def sorted_sql(keys: str, dates: bool = False) -> str:
    join = " left join (select source as textid, min(n_chars) as index_date from documents where n_chars < 400 group by source) using (textid)" if dates else ""
    return kwic_sql("tionth") + f' select bucket_id, textid, kind, master_offset, "left", "match", "right", row_number() over (order by {keys} textid, bucket_id, master_offset) as position from k{join}'


def kwic_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(search.search(sources(spark, sf_dir), "with NEAR from", distance=30), "master_offset").select(HIT)


def kwic_not(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(search.search(sources(spark, sf_dir), "with NOT the", distance=10), "master_offset").select(HIT)


def near_sql(left: str, right: str, distance: int, negate: bool) -> str:
    n, m = len(left), len(right)
    other = f"r as (select doc_id as bucket_id, o as p from (select doc_id, text, unnest(range(0, length(text) - {m} + 1)) as o from documents) where substring(text, o + 1, {m}) = '{right}')"
    test = f"exists (select 1 from r where r.bucket_id = k.bucket_id and greatest(k.master_offset - (r.p + {m}), r.p - (k.master_offset + {n}), 0) <= {distance})"
    return kwic_sql(left) + ", " + other + f" select * from k where {'not ' if negate else ''}{test}"


def kwic_regex_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(search.search(sources(spark, sf_dir), r"/token = \"[0-9a-f]{8}/"), "master_offset").select(HIT)


REGEX_SQL = """with h as (select doc_id as bucket_id, source as textid, lang as kind, text, o as master_offset
  from (select *, unnest(range(0, length(text) - 16)) as o from documents where contains(text, 'token = "')) where regexp_matches(substring(text, o + 1, 17), '^token = "[0-9a-f]{8}$'))
""" + ", " + KWIC.format(n=17) + " select * from k"


def kwic_closeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = search.search(sources(spark, sf_dir), "555-5")
    return _long(search.closeness(hits, "555-5"), "master_offset").select(*HIT, "position")


def trigram_postings_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hundred most frequent trigrams: a top-k report."""
    counts = search.postings(sources(spark, sf_dir)).groupBy("gram").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("bucket_id").alias("sources"))
    return counts.orderBy(F.desc("n"), "gram").limit(100)


GRAMS = "g as (select doc_id as bucket_id, substring(text, i, 3) as gram, i - 1 as position from (select doc_id, text, unnest(range(1, length(text) - 1)) as i from documents where length(text) >= 3))"


def gram_frequency_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = search.postings(sources(spark, sf_dir)).groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    return counts.where(F.col("n").between(2, 200))


def posting_intersection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(search.by_postings(sources(spark, sf_dir), "tionth"), "start")


def candidate_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.hits_of(sources(spark, sf_dir), "tion").agg(F.count(F.lit(1)).alias("candidates"))


def extensions_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.extensions(search.hits_of(sources(spark, sf_dir), "tion"), "left", 20)


def extensions_right(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.extensions(search.hits_of(sources(spark, sf_dir), "tion"), "right", 20)


def _faceted(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = search.neighbours(search.search(sources(spark, sf_dir), "tion"))
    return search.facets(hits, ["textid", "kind", "left_char", "right_char", "left_bigram", "right_bigram", "around"])


FACETS = """f as (select unnest([{'dim': 'textid', 'value': textid}, {'dim': 'kind', 'value': kind},
  {'dim': 'left_char', 'value': right("left", 1)}, {'dim': 'right_char', 'value': substring("right", 1, 1)},
  {'dim': 'left_bigram', 'value': case when length("left") >= 2 then right("left", 2) else '' end},
  {'dim': 'right_bigram', 'value': case when length("right") >= 2 then substring("right", 1, 2) else '' end},
  {'dim': 'around', 'value': case when length("left") > 0 and length("right") > 0 then right("left", 1) || substring("right", 1, 1) else '' end}], recursive := true) from k),
  c as (select dim, value, count(*) as n from f where value is not null and value <> '' group by dim, value)"""


def facets_all_dims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _faceted(spark, sf_dir)


def facets_forced(spark: SparkSession, sf_dir: str) -> DataFrame:
    forced = spark.createDataFrame([("textid", "src3", True, False), ("textid", "nowhere", True, False), ("kind", "de", False, True), ("left_char", "zz", False, True)], "dim string, value string, selected boolean, excluded boolean")
    return search.ranked_facets(_faceted(spark, sf_dir), forced, 12)


FORCED = """p as (select * from (values ('textid', 'src3', true, false), ('textid', 'nowhere', true, false), ('kind', 'de', false, true), ('left_char', 'zz', false, true)) t(dim, value, selected, excluded)),
  j as (select coalesce(c.dim, p.dim) as dim, coalesce(c.value, p.value) as value, coalesce(n, 0) as n, coalesce(selected, false) as selected, coalesce(excluded, false) as excluded
        from c full join p on c.dim = p.dim and c.value = p.value)
  select * from (select *, row_number() over (partition by dim order by case when (selected or excluded) and n = 0 then 0 when selected or excluded then 1 else 2 end, n desc, value) as rank from j) where rank <= 12"""


def overview_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.summary(search.hits_of(sources(spark, sf_dir), "tion"))


def search_textids(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search.textids(search.hits_of(sources(spark, sf_dir), "tion"))
    return found.withColumn("position", F.row_number().over(Window.orderBy(F.desc("n"), "textid")).cast("bigint"))  # a row for each text


def hit_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = search.neighbours(search.search(sources(spark, sf_dir), "tion"))
    kept = search.filtered(hits, {"kind": ["en", "fr"], "left_char": ["a", "e", " "]}, {"textid": ["src0", "src2"], "right_char": ["s"]})
    return _long(kept.where(search.matches_section(F.col("textid"), ["src1"])), "master_offset").select(HIT)


def kwic_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second page of fifty hits."""
    hits = search.search(sources(spark, sf_dir), "tionth")
    return _long(order.page(hits, search.order_keys("textid"), 50, 50), "master_offset").select(HIT)


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of a conversation as voice ranges over its running text."""
    turns = table(spark, sf_dir, "conversations")
    before = F.coalesce(F.sum(F.length("text")).over(Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return turns.select(F.col("conv_id").alias("bucket_id"), F.col("role").alias("name"), before.alias("r_start"), (before + F.length("text")).alias("r_end"), "turn")


TURNS = """t as (select conv_id as bucket_id, role as name, turn, coalesce(sum(length(text)) over (partition by conv_id order by turn rows between unbounded preceding and 1 preceding), 0)::bigint as r_start, length(text) as n from conversations),
  r as (select bucket_id, name, turn, r_start, r_start + n as r_end from t), e as (select bucket_id, max(r_end) as n from r group by bucket_id),
  h as (select bucket_id, s as "start", s + 120 as "end" from (select bucket_id, unnest(range(0, n, 90)) as s from e))"""


def _probes(turns: DataFrame) -> DataFrame:
    """Hits to classify: a span of 120 characters at every 90th, up to a conversation's end."""
    size = turns.groupBy("bucket_id").agg(F.max("r_end").alias("n")).where("n > 0")
    return size.select("bucket_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(90).cast("long"))).alias("start")).withColumn("end", F.col("start") + 120)


def voice_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _turns(spark, sf_dir)
    whole = turns.groupBy("bucket_id").agg(F.min("r_start").alias("r_start"), F.max("r_end").alias("r_end")).withColumn("name", F.lit("talk"))
    ranges = turns.select("bucket_id", "r_start", "r_end", "name").unionByName(whole.where(F.col("bucket_id") % 3 == 0))
    found = intervals.classify(_probes(turns), ranges, ["bucket_id"])
    return found.select("bucket_id", "start", "end", "voice", F.array_join("voice_stack", ">").alias("stack"))


VOICE_SQL = "with " + TURNS + """,
  a as (select bucket_id, r_start, r_end, name from r union all select bucket_id, min(r_start), max(r_end), 'talk' from r where bucket_id % 3 = 0 group by bucket_id),
  j as (select h.bucket_id, h."start", h."end", a.name, a.r_start, a.r_end, a.r_start <= h."start" and a.r_end >= h."end" as inside
        from h left join a on a.bucket_id = h.bucket_id and a.r_start < h."end" and a.r_end > h."start")
  select bucket_id, "start", "end",
    case when count(*) filter (where inside) > 0 then last(name order by r_end - r_start desc, r_start desc, name desc) filter (where inside) when count(name) > 0 then 'mixed' else 'none' end as voice,
    coalesce(string_agg(name, '>' order by r_end - r_start desc, r_start desc, name desc) filter (where inside), '') as stack
  from j group by bucket_id, "start", "end" """


def toc_label_innermost(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _turns(spark, sf_dir)
    spans = turns.select("bucket_id", F.col("r_start").alias("span_start"), F.col("r_end").alias("span_end"), F.concat(F.lit("turn "), F.col("turn").cast("string")).alias("label"))
    whole = spans.groupBy("bucket_id").agg(F.min("span_start").alias("span_start"), F.max("span_end").alias("span_end")).withColumn("label", F.lit("all"))
    probes = _probes(turns).select("bucket_id", F.col("start").alias("at"))
    return intervals.innermost(probes, spans.unionByName(whole), ["bucket_id"], "at")


TOC_SQL = "with " + TURNS + """,
  a as (select bucket_id, r_start, r_end, 'turn ' || turn as label from r union all select bucket_id, min(r_start), max(r_end), 'all' from r group by bucket_id)
  select h.bucket_id, h."start" as at, arg_min(label, {'w': r_end - r_start, 's': r_start, 'l': label}) as toc_label
  from h left join a on a.bucket_id = h.bucket_id and r_start <= h."start" and r_end > h."start" group by h.bucket_id, h."start" """


def overlay_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns that fall into a window around each probe."""
    turns = _turns(spark, sf_dir).withColumns({"i_start": F.col("r_start"), "i_end": F.col("r_end")})
    windows = _probes(_turns(spark, sf_dir)).withColumns({"lo": F.greatest(F.col("start") - 50, F.lit(0)), "hi": F.col("end") + 50})
    entry = F.concat(F.col("i.name"), F.lit("@"), F.col("i.i_start").cast("string"))
    return intervals.overlapping(windows, turns, ["bucket_id"]).groupBy("w.bucket_id", "w.start").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i.i_start", entry.alias("e")))), lambda x: x["e"]), ",").alias("overlays"))


OVERLAY_SQL = "with " + TURNS + """ select h.bucket_id, h."start", string_agg(name || '@' || r_start, ',' order by r_start, name || '@' || r_start) as overlays
  from h join r on r.bucket_id = h.bucket_id and r.r_start < h."end" + 50 and r.r_end > greatest(h."start" - 50, 0) group by h.bucket_id, h."start" """

HIT_SQL = 'bucket_id, textid, kind, master_offset, "left", "match", "right"'
QUERIES = {f.__name__: f for f in (kwic_literal, kwic_short_query, kwic_textid_scope, kwic_sort_match, kwic_sort_textid, kwic_sort_reverse_prematch, kwic_sort_date, kwic_near, kwic_not, kwic_regex_spans, kwic_closeness, trigram_postings_top, gram_frequency_band, posting_intersection, candidate_count, extensions_left, extensions_right, facets_all_dims, facets_forced, overview_summary, search_textids, hit_filters, kwic_page, voice_classify, toc_label_innermost, overlay_window)}
ORACLE = {
    "kwic_literal": kwic_sql("the ") + " select * from k",
    "kwic_short_query": kwic_sql("ßu") + " select * from k",
    "kwic_textid_scope": kwic_sql("tion") + " select * from k where textid in ('src1', 'src7')",
    "kwic_sort_match": sorted_sql('"match" || "right",'),
    "kwic_sort_textid": sorted_sql(""),
    "kwic_sort_reverse_prematch": sorted_sql('reverse("left"), "match",'),
    "kwic_sort_date": sorted_sql("index_date nulls last,", True),
    "kwic_near": near_sql("with", "from", 30, False),
    "kwic_not": near_sql("with", "the", 10, True),
    "kwic_regex_spans": REGEX_SQL,
    "trigram_postings_top": "with " + GRAMS + " select gram, count(*) as n, count(distinct bucket_id) as sources from g group by gram order by n desc, gram limit 100",
    "gram_frequency_band": "with " + GRAMS + " select gram, count(*) as n from g group by gram having count(*) between 2 and 200",
    "posting_intersection": hits_sql("tionth") + ' select bucket_id, master_offset as "start" from h',
    "candidate_count": hits_sql("tion") + " select count(*) as candidates from h",
    "extensions_left": hits_sql("tion") + " select substring(text, master_offset, 5) as gram, count(*) as n from h where master_offset > 0 group by gram order by n desc, gram limit 20",
    "extensions_right": hits_sql("tion") + " select substring(text, master_offset + 1, 5) as gram, count(*) as n from h where master_offset + 4 < length(text) group by gram order by n desc, gram limit 20",
    "facets_all_dims": kwic_sql("tion") + ", " + FACETS + " select * from c",
    "facets_forced": kwic_sql("tion") + ", " + FACETS + ", " + FORCED,
    "overview_summary": hits_sql("tion") + " select textid, count(*) as hits, count(distinct bucket_id) as sources from h group by textid",
    "search_textids": hits_sql("tion") + " select textid, count(*) as n, row_number() over (order by count(*) desc, textid) as position from h group by textid",
    "hit_filters": kwic_sql("tion") + """ select * from k where kind in ('en', 'fr') and right("left", 1) in ('a', 'e', ' ') and textid not in ('src0', 'src2') and substring("right", 1, 1) <> 's' and starts_with(textid, 'src1')""",
    "kwic_page": kwic_sql("tionth") + " select * from k order by textid, bucket_id, master_offset limit 50 offset 50",
    "voice_classify": VOICE_SQL,
    "toc_label_innermost": TOC_SQL,
    "overlay_window": OVERLAY_SQL,
}
