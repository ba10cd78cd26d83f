"""Catalog and graph queries: nations are sections, customers bundles, line items links."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import text as fn
from lectern.operators import catalog, graph
from lectern.storage import table


def _years(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bounds of made-up years, before and after 0, from part keys and sizes."""
    part = table(spark, sf_dir, "part")
    low = F.col("p_partkey") % 1500 - 700
    return part.select(
        "p_partkey", low.cast("int").alias("a"), (low + F.col("p_size") * 4 - 20).cast("int").alias("b"), F.when(F.col("p_partkey") % 3 == 0, low + 7).cast("int").alias("c"), F.when(F.col("p_partkey") % 6 == 0, low + 60).cast("int").alias("d")
    )


YEARS = "y as (select p_partkey, (p_partkey % 1500 - 700)::int as a, (p_partkey % 1500 - 700 + p_size * 4 - 20)::int as b, case when p_partkey % 3 = 0 then (p_partkey % 1500 - 693)::int end as c, case when p_partkey % 6 = 0 then (p_partkey % 1500 - 640)::int end as d from part)"
DATES = YEARS + """, w as (select p_partkey, c is not null and d is not null as dzt, case when c is not null and d is not null then least(c, d) else least(a, b) end as lo, case when c is not null and d is not null then greatest(c, d) else greatest(a, b) end as hi from y),
  i as (select p_partkey, (case when hi - lo > 100 then lo else floor((lo + hi) / 2.0) end)::bigint as value,
    case when lo = hi then if(dzt, 'dzt_date', 'midpoint') when hi - lo > 100 then if(dzt, 'dzt_date_not_before_wide_range', 'not_before_wide_range') else if(dzt, 'dzt_date_midpoint', 'midpoint') end as source from w)"""


def index_date_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _years(spark, sf_dir).withColumn("d", fn.index_date("a", "b", "c", "d"))
    return found.select("p_partkey", F.col("d.value").cast("bigint").alias("value"), F.col("d.source").alias("source"))


def century_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    dated = _years(spark, sf_dir).withColumn("index_date", fn.index_date("a", "b", "c", "d")["value"])
    return catalog.timeline(dated).withColumns({"start": F.col("start").cast("bigint"), "end": F.col("end").cast("bigint")})


CENTURY = "with " + DATES + """, c as (select value, if(value > 0, (value - 1) // 100 + 1, greatest((abs(value) - 1) // 100 + 1, 1)) as n from i),
  k as (select if(value > 0, 'ce-', 'bce-') || lpad(n::varchar, 2, '0') as key,
    n || case when n % 100 between 10 and 20 then 'th' when n % 10 = 1 then 'st' when n % 10 = 2 then 'nd' when n % 10 = 3 then 'rd' else 'th' end || if(value > 0, ' c. CE', ' c. BCE') as label,
    (if(value > 0, (n - 1) * 100 + 1, -(n * 100)))::bigint as "start", (if(value > 0, n * 100, if(n = 1, 0, -((n - 1) * 100 + 1))))::bigint as "end" from c)
  select key, label, "start", "end", count(*) as n from k group by all"""


def _codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A taxonomy of customers: segment letter, nation, and a letter of the key, as nested codes."""
    return table(spark, sf_dir, "customer").select(F.concat(F.lower(F.left("c_mktsegment", F.lit(1))), F.col("c_nationkey").cast("string"), F.element_at(F.split(F.lit("a,b,c"), ","), (F.col("c_custkey") % 3 + 1).cast("int"))).alias("code"))


CODES = "d as (select lower(left(c_mktsegment, 1)) || c_nationkey || (['a', 'b', 'c'])[c_custkey % 3 + 1] as code from customer)"


def taxonomy_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = _codes(spark, sf_dir)
    tops = codes.select(F.explode(F.array(F.left("code", F.lit(1)), F.left("code", F.lit(2)), F.col("code"))).alias("code")).distinct()
    return catalog.sections(tops, codes.groupBy("code").agg(F.count(F.lit(1)).alias("n")))


TAXONOMY = "with " + CODES + """, s as (select distinct unnest([left(code, 1), left(code, 2), code]) as code from d)
  select s.code, (select arg_max(o.code, length(o.code)) from s o where o.code <> s.code and starts_with(s.code, o.code)) as parent_code,
    (select count(*) from d where d.code = s.code) as direct_count, (select count(*) from d where starts_with(d.code, s.code)) as descendant_count from s"""


def parent_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taxonomy_rollup(spark, sf_dir).select("code", "parent_code")


def catalog_rank_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = table(spark, sf_dir, "customer")
    bundles = customer.select(F.col("c_custkey").cast("string").alias("textid"), F.col("c_name").alias("title"), F.col("c_mktsegment").alias("title_english"))
    idents = table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("textid"), F.col("o_orderkey").cast("string").alias("value"))
    return catalog.search(bundles, idents, "12", ["title", "title_english"]).select("textid", "title", "rank")


RANK = """select c_custkey::varchar as textid, c_name as title, case when c_custkey::varchar = '12' then 0 when starts_with(c_custkey::varchar, '12') then 1 when contains(lower(c_name), '12') or contains(lower(c_mktsegment), '12') then 2 else 3 end as rank
  from customer where contains(c_custkey::varchar, '12') or contains(lower(c_name), '12') or contains(lower(c_mktsegment), '12') or c_custkey in (select o_custkey from orders where contains(o_orderkey::varchar, '12'))"""


def _notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    return orders.select(F.col("o_orderkey").alias("uuid"), F.col("o_orderpriority").alias("collection"), F.col("o_orderkey").cast("string").alias("label"))


def _links(spark: SparkSession, sf_dir: str) -> DataFrame:
    relation = F.when(F.col("l_returnflag") == "A", "body").when(F.col("l_returnflag") == "N", F.lower("l_linestatus")).otherwise("body-wikilink")
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("source"), F.col("l_partkey").alias("target"), relation.alias("relation"))


LINKS = "l as (select l_orderkey as source, l_partkey as target, case l_returnflag when 'A' then 'body' when 'N' then lower(l_linestatus) else 'body-wikilink' end as relation from lineitem)"


def backlinks_grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders that link to part 7: three items of each collection listed."""
    return graph.backlinks(_links(spark, sf_dir), _notes(spark, sf_dir), 7, 3)


BACKLINKS = "with " + LINKS + """, o as (select source, coalesce(min(relation) filter (where relation not in ('body', 'body-wikilink')), min(relation)) as relation from l where target = 7 group by source),
  j as (select source, relation, o_orderpriority as collection, o_orderkey::varchar as label from o join orders on o_orderkey = source)
  select * from (select *, count(*) over (partition by collection) as total, row_number() over (partition by collection order by label, source) as place from j) where place <= 3"""


def out_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    notes = table(spark, sf_dir, "part").where("p_size < 40").select(F.col("p_partkey").alias("uuid"), F.col("p_brand").alias("collection"), F.col("p_name").alias("label"))
    return graph.out_links(_links(spark, sf_dir), notes, 33)


def usage_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often suppliers are used, and the sum of the quantities as texts like "17.0"."""
    item = table(spark, sf_dir, "lineitem")
    senses = item.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("uuid"), F.concat(F.lit(" "), F.col("l_quantity").cast("int").cast("string"), F.lit("x")).alias("n"))
    links = item.where("l_suppkey % 4 <> 1").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("source"), F.col("l_suppkey").alias("target"))
    # a line number may repeat within an order
    senses = senses.groupBy("uuid").agg(F.min("n").alias("n"))
    return graph.usage(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("uuid")), senses, links)


USAGE = """with s as (select l_orderkey * 10 + l_linenumber as uuid, min(' ' || l_quantity::int || 'x') as n from lineitem group by 1), l as (select l_orderkey * 10 + l_linenumber as source, l_suppkey as target from lineitem where l_suppkey % 4 <> 1),
  u as (select target, count(*) as sense_count, sum(regexp_extract(n, '^\\s*([-+]?\\d+)', 1)::bigint)::bigint as usage from l join s on s.uuid = l.source group by target)
  select s_suppkey as uuid, coalesce(sense_count, 0) as sense_count, coalesce(usage, 0) as usage from supplier left join u on target = s_suppkey"""


def rel_type_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("uuid"), F.col("o_orderstatus").alias("label"))
    return graph.relation_types(_links(spark, sf_dir), labels)


def collection_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.collection_counts(_notes(spark, sf_dir))


def wikilink_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders that name a part as [[name]]; the first part of a name counts."""
    part = table(spark, sf_dir, "part")
    prose = part.select(F.col("p_partkey").alias("uuid"), F.concat(F.lit("see [["), F.col("p_name"), F.lit("]] and [["), F.lower("p_type"), F.lit(" | x]] or [[small ring|it]]")).alias("text"))
    entries = part.select(F.col("p_partkey").alias("uuid"), F.col("p_name").alias("orth"), F.col("p_partkey").alias("ordinal"))
    return graph.wikilinks(prose, entries)


WIKILINK = """with f as (select p_name as orth, min(p_partkey) as target from part group by p_name), n as (select p_partkey as source, unnest([p_name, lower(p_type), 'small ring']) as orth from part)
  select distinct source, target from n join f using (orth) where source <> target"""


def graph_browse(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    notes = part.select(F.col("p_partkey").alias("uuid"), F.col("p_type").alias("collection"), F.col("p_name").alias("label"))
    return graph.browse(notes, part.select(F.col("p_partkey").alias("uuid"), F.lower("p_name").alias("folded")), "SMALL", "ring")


def label_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The names of an order's parts in line order; large parts are unknown."""
    item = table(spark, sf_dir, "lineitem")
    lists = item.groupBy("l_orderkey").agg(F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda x: x["l_partkey"]).alias("ids"))
    lookup = table(spark, sf_dir, "part").where("p_size < 25").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("label"))
    return graph.label_lists(lists, lookup, "l_orderkey", "ids")


LISTS = """select l_orderkey, case when count(p_name) > 0 then string_agg(coalesce(p_name, ''), ', ' order by l_linenumber, l_partkey) end as labels
  from lineitem left join (select * from part where p_size < 25) on p_partkey = l_partkey group by l_orderkey"""

QUERIES = {f.__name__: f for f in (index_date_rule, century_timeline, taxonomy_rollup, parent_prefix, catalog_rank_search, backlinks_grouped, out_links, usage_counts, rel_type_counts, collection_topk, wikilink_join, graph_browse, label_lists)}
ORACLE = {
    "index_date_rule": "with " + DATES + " select * from i",
    "century_timeline": CENTURY,
    "taxonomy_rollup": TAXONOMY,
    "parent_prefix": f"select code, parent_code from ({TAXONOMY})",
    "catalog_rank_search": RANK,
    "backlinks_grouped": BACKLINKS,
    "out_links": "with " + LINKS + " select target, source, relation, p_brand as collection, p_name as label from l left join (select * from part where p_size < 40) on p_partkey = target where source = 33",
    "usage_counts": USAGE,
    "rel_type_counts": "with " + LINKS + " select o_orderstatus as label, count(distinct source) as records from l join orders on o_orderkey = source group by 1",
    "collection_topk": "select o_orderpriority as collection, count(*) as n from orders group by 1",
    "wikilink_join": WIKILINK,
    "graph_browse": "select p_partkey as uuid, p_type as collection, p_name as label from part where p_type = 'SMALL' and contains(lower(p_name), 'ring')",
    "label_lists": LISTS,
}
