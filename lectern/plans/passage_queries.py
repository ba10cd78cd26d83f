"""Repeated passages on the driver's tables: documents and benchmark passages are sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators import passages
from lectern.plans.search_queries import sources
from lectern.storage import stored, table


#: What a scan takes unless told otherwise: characters of an anchor and of a passage, and places of an anchor at most.
ANCHOR, PASSAGE, MOST = 12, 24, 200


def _spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.exact_spans(sources(spark, sf_dir), ANCHOR, PASSAGE, MOST)


def _wide(rows: DataFrame, *columns: str) -> DataFrame:
    return rows.withColumns({c: F.col(c).cast("bigint") for c in columns})


def winnow_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.winnow(sources(spark, sf_dir), ANCHOR, PASSAGE).withColumn("position", F.col("position").cast("bigint"))


def winnow_sql(texts: str) -> str:
    """Anchors ``a`` of a relation of (bucket_id, text)."""
    return f"""s as (select * from ({texts})),
  g as (select bucket_id, i - 1 as position, md5(substring(text, i, 12)) as hash from (select bucket_id, text, unnest(range(1, length(text) - 10)) as i from s where length(text) >= 24)),
  b as (select bucket_id, position, min({{'hash': hash, 'place': -position}}) over (partition by bucket_id order by position rows between 12 preceding and current row) as best from g),
  c as (select *, lag(best.place) over (partition by bucket_id order by position) as before from b where position >= 12),
  a as materialized (select bucket_id, -best.place as position, best.hash as hash from c where before is null or before <> best.place)"""


WINNOW = winnow_sql("select doc_id as bucket_id, text from documents")


def pairs_sql(winnowed: str) -> str:
    """Pairs of places ``p`` that share an anchor of 2 to 200 places."""
    return winnowed + """, k as (select hash from a group by hash having count(*) between 2 and 200), u as materialized (select a.* from a join k using (hash)),
  p as (select x.bucket_id as bucket_a, x.position as pos_a, y.bucket_id as bucket_b, y.position as pos_b from u x join u y on x.hash = y.hash and (x.bucket_id < y.bucket_id or (x.bucket_id = y.bucket_id and x.position < y.position)))"""


def spans_sql(winnowed: str, where: str = "true") -> str:
    """Maximal spans ``f`` around the pairs' places: how far both sides agree is found bit by bit, from 2**17 characters down.

    Of places on one diagonal that touch, the first stands for all.
    """
    steps = []
    last = "n"
    for bit in range(17, -1, -1):
        n, name = 1 << bit, f"n{bit}"
        test = "far_l and " if bit > 5 else ""
        left = f"{test}length(la) >= {n} and length(lb) >= {n} and right(la, {n}) = right(lb, {n})"
        test = "far_r and " if bit > 5 else ""
        right = f"{test}length(ra) >= {n} and length(rb) >= {n} and left(ra, {n}) = left(rb, {n})"
        steps.append(
            f"""{name} as (select bucket_a, pos_a, bucket_b, pos_b, far_l, far_r, l + if(ok_l, {n}, 0) as l, r + if(ok_r, {n}, 0) as r, if(ok_l, left(la, length(la) - {n}), la) as la, if(ok_l, left(lb, length(lb) - {n}), lb) as lb,
    if(ok_r, substring(ra, {n + 1}), ra) as ra, if(ok_r, substring(rb, {n + 1}), rb) as rb from (select *, {left} as ok_l, {right} as ok_r from {last}))"""
        )
        last = name
    return (
        pairs_sql(winnowed)
        + f""", d as (select *, pos_a - lag(pos_a) over (partition by bucket_a, bucket_b, pos_a - pos_b order by pos_a) as gap from p where {where}),
  n0x as (select d.bucket_a, d.pos_a, d.bucket_b, d.pos_b, left(x.text, d.pos_a) as la, left(y.text, d.pos_b) as lb, substring(x.text, d.pos_a + 13) as ra, substring(y.text, d.pos_b + 13) as rb
    from d join s x on x.bucket_id = d.bucket_a join s y on y.bucket_id = d.bucket_b where gap is null or gap > 12),
  n as (select *, 0 as l, 0 as r, length(la) >= 64 and length(lb) >= 64 and right(la, 64) = right(lb, 64) as far_l, length(ra) >= 64 and length(rb) >= 64 and left(ra, 64) = left(rb, 64) as far_r from n0x),
  """
        + ",\n  ".join(steps)
        + f""",
  f0 as (select distinct bucket_a, pos_a - l as start_a, pos_a + 12 + r as end_a, bucket_b, pos_b - l as start_b, pos_b + 12 + r as end_b from {last}),
  f as materialized (select * from f0 where end_a - start_a >= 24 and not (bucket_a = bucket_b and start_a < end_b and start_b < end_a))"""
    )


SPANS = spans_sql(WINNOW)
CLUSTERS = """, o as (select distinct bucket_id, "start", "end" from (select bucket_a as bucket_id, start_a as "start", end_a as "end" from f union all select bucket_b, start_b, end_b from f)),
  cl as (select o.*, sha256(substring(s.text, "start" + 1, "end" - "start")) as cluster from o join s using (bucket_id))
  select cluster, max("end" - "start") as length, count(*) as occurrence_count, min({'b': bucket_id, 's': "start"}).b as first_bucket, min({'b': bucket_id, 's': "start"}).s as first_start from cl group by cluster having count(*) >= 2"""
BOTH = "select doc_id as bucket_id, text from documents union all select -item_id - 1, text from benchmark"


def side_sql(side: str) -> str:
    """Merged characters and pieces of one side of each pair; two places of one source count for both."""
    other = "b" if side == "a" else "a"
    return f"""{side}1 as (select bucket_a, bucket_b, start_{side} as "start", end_{side} as "end" from f union select bucket_a, bucket_b, start_{other}, end_{other} from f where bucket_a = bucket_b),
  {side}2 as (select *, max("end") over (partition by bucket_a, bucket_b order by "start", "end" rows between unbounded preceding and 1 preceding) as b from {side}1),
  {side}3 as (select *, sum(case when b is null or "start" > b then 1 else 0 end) over (partition by bucket_a, bucket_b order by "start", "end" rows between unbounded preceding and current row) as n from {side}2),
  {side}4 as (select bucket_a, bucket_b, max("end") - min("start") as chars from {side}3 group by bucket_a, bucket_b, n),
  {side}5 as (select bucket_a, bucket_b, sum(chars)::bigint as chars_{side}, count(*) as spans_{side} from {side}4 group by bucket_a, bucket_b)"""


PAIRS = (
    SPANS
    + ", "
    + side_sql("a")
    + ", "
    + side_sql("b")
    + """, l as (select bucket_a, bucket_b, max(end_a - start_a) as longest_span, min({'n': start_a - end_a, 'a': start_a, 'b': start_b}) as best from f group by bucket_a, bucket_b)
  select bucket_a, bucket_b, chars_a, spans_a, chars_b, spans_b, longest_span, length(x.text) as length_a, length(y.text) as length_b, best.a as longest_a, best.b as longest_b,
    if(length(x.text) > 0, chars_a / length(x.text), 0.0) as coverage_a, if(length(y.text) > 0, chars_b / length(y.text), 0.0) as coverage_b, bucket_a = bucket_b as intra
  from a5 join b5 using (bucket_a, bucket_b) join l using (bucket_a, bucket_b) join s x on x.bucket_id = bucket_a join s y on y.bucket_id = bucket_b where least(chars_a, chars_b) >= 100"""
)


def anchor_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.usable(passages.winnow(sources(spark, sf_dir), ANCHOR, PASSAGE), MOST)


def anchor_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    anchors = stored(passages.winnow(sources(spark, sf_dir), ANCHOR, PASSAGE, True), "anchors")
    pairs = passages.anchor_pairs(anchors, MOST)
    return _wide(pairs, *pairs.columns)


def parallel_exact_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _wide(_spans(spark, sf_dir).select(passages.SPAN), *passages.SPAN)


def _clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.exact_occurrences(sources(spark, sf_dir), _spans(spark, sf_dir))


def parallel_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _wide(passages.listed(_clusters(spark, sf_dir)), "length", "first_start")


def parallel_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.listed(passages.uncontained(_clusters(spark, sf_dir)))


def parallel_targeted_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where passages of the benchmark (negative bucket ids) occur in documents."""
    own = table(spark, sf_dir, "benchmark").select((-F.col("item_id") - 1).alias("bucket_id"), "text")
    both = sources(spark, sf_dir).select("bucket_id", "text").unionByName(own)
    return _wide(passages.scan(both, ANCHOR, PASSAGE, MOST, target=own).select(passages.SPAN), *passages.SPAN)


def fuzzy_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.fuzzy_occurrences(sources(spark, sf_dir), stored(passages.scan(sources(spark, sf_dir), ANCHOR, PASSAGE, MOST, 1), "spans"), 1)


def minhash_lsh_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    sketches = stored(passages.minhash(sources(spark, sf_dir)), "sketches")
    return passages.similar_pairs(sketches)


def dup_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    lengths = sources(spark, sf_dir).select("bucket_id", F.length("text").cast("bigint").alias("chars"))
    found = passages.pair_rows(_spans(spark, sf_dir), lengths)
    return _wide(found, "chars_a", "chars_b", "longest_span", "longest_a", "longest_b")


def bounded_edit_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances of part names that share brand and type, up to 6."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), F.col("p_name").alias("text"), "p_brand", "p_type")
    found = passages.distances(part, ["p_brand", "p_type"], 6)
    return _wide(found.select("key_a", "key_b", "distance"), "distance")


def _occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders' life on a line of days, as occurrences of their customer."""
    first = F.datediff(F.to_date("o_orderdate"), F.lit("1995-01-01"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("cluster"), F.pmod("o_custkey", F.lit(50)).alias("bucket_id"), first.cast("bigint").alias("start"))
    return orders.withColumn("end", F.col("start") + 30)


OCC = "o as (select o_custkey as cluster, o_custkey % 50 as bucket_id, date_diff('day', date '1995-01-01', o_orderdate::date)::bigint as \"start\", date_diff('day', date '1995-01-01', o_orderdate::date)::bigint + 30 as \"end\" from orders)"


def parallel_point_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.at_offset(_occurrences(spark, sf_dir), 7, 900)


def parallel_point_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.at_offset(_occurrences(spark, sf_dir), 7, 900, "cover")


def parallel_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.lookup(_occurrences(spark, sf_dir), 7, 900)


HERE = "h as (select * from o where bucket_id = 7 and \"start\" <= 900 and \"end\" > 900)"
QUERIES = {f.__name__: f for f in (winnow_anchors, anchor_groups, anchor_pairs, parallel_exact_spans, parallel_clusters, parallel_containment, parallel_targeted_benchmark, fuzzy_clusters, minhash_lsh_pairs, dup_pairs, bounded_edit_distance, parallel_point_overlap, parallel_point_cover, parallel_lookup)}
ORACLE = {
    "winnow_anchors": "with " + WINNOW + " select * from a",
    "anchor_groups": "with " + WINNOW + " select hash, count(*) as n from a group by hash having count(*) between 2 and 200",
    "anchor_pairs": "with " + pairs_sql(WINNOW) + " select * from p",
    "parallel_exact_spans": "with " + SPANS + " select * from f",
    "parallel_clusters": "with " + SPANS + CLUSTERS,
    "parallel_targeted_benchmark": "with " + spans_sql(winnow_sql(BOTH), "bucket_a < 0 or bucket_b < 0") + " select * from f",
    "dup_pairs": "with " + PAIRS,
    "bounded_edit_distance": "select a.p_partkey as key_a, b.p_partkey as key_b, least(levenshtein(a.p_name, b.p_name), 7) as distance from part a join part b on a.p_brand = b.p_brand and a.p_type = b.p_type and a.p_partkey < b.p_partkey",
    "parallel_point_overlap": "with " + OCC + ' select * from o where bucket_id = 7 and "start" <= 900 and "end" > 900',
    "parallel_point_cover": "with " + OCC + ' select * from o where bucket_id = 7 and "start" <= 900 and "end" >= 900',
    "parallel_lookup": "with " + OCC + ", " + HERE + " select * from o where cluster in (select cluster from h) and not exists (select 1 from h where h.cluster = o.cluster and h.bucket_id = o.bucket_id and h.\"start\" = o.\"start\" and h.\"end\" = o.\"end\")",
}
