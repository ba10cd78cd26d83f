"""The registered queries of this subpackage: one for each operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import decontaminate, jaccard, langid, licenses, merkle, packing, pii, quality, secret_scan, substrings
from lectern.llm.storage import documents, table

VOCABULARY = "byte_bpe_50k.json"


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return pii.find(docs, pii.train(docs))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), vocabulary_path(), 2048)


def _fold(parts: int, part: int) -> Column:
    """Whether crc32(doc_id as text) leaves this remainder."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(parts)) == part, F.lit(False))


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = langid.train(docs, ~_fold(4, 2))
    return langid.predict(docs, model).select("doc_id", _fold(4, 2).alias("held_out"), "lang_pred", "score", "spans")


def op4_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.deduplicate(documents(spark, sf_dir), 50)


OP4_SQL = r"""
with w as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words from documents),
s as (select doc_id, unnest(range(1, len(words) - 48)) as i, words from w where len(words) >= 50),
h as (select doc_id, i, md5(array_to_string(words[i:i + 49], ' ')) as h from s),
r as (select doc_id, i from (select doc_id, i, min(doc_id) over (partition by h) as least from h) where least < doc_id),
p as (select doc_id, unnest(range(1, len(words) + 1)) as i, unnest(words) as word from w),
c as (select p.doc_id, p.i, p.word, max(r.i) over (partition by p.doc_id order by p.i rows between unbounded preceding and current row) as last
      from p left join r on r.doc_id = p.doc_id and r.i = p.i),
k as (select doc_id, count(*) filter (where last is not null and last > i - 50) as n_removed,
      string_agg(word, ' ' order by i) filter (where last is null or last <= i - 50) as kept from c group by doc_id)
select w.doc_id, len(w.words)::bigint as n_words, coalesce(k.n_removed, 0)::bigint as n_removed, sha256(coalesce(k.kept, '')) as kept_sha256
from w left join k on k.doc_id = w.doc_id
"""


def repeated_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How long each document's repeats are, by doubling from 50 words on until no candidate survives."""
    return substrings.longest(documents(spark, sf_dir), 50)


def _lengths_sql(levels: int = 12) -> str:
    """Windows of 50 words and of twice as many at each level, made from the hashes of their halves."""
    made = ["""w0 as (select doc_id, i, md5(array_to_string(words[i:i + 49], ' ')) as h from (select doc_id, words, unnest(range(1, len(words) - 48)) as i from
  (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as words from documents where doc_id is not null) where len(words) >= 50))"""]
    found = []
    for level in range(levels):
        made.append(f"r{level} as materialized (select doc_id, i, h from (select *, min(doc_id) over (partition by h) as low, max(doc_id) over (partition by h) as high from w{level}) where low < high)")
        found.append(f"select distinct doc_id, {50 << level}::bigint as n from r{level}")
        made.append(f"w{level + 1} as (select a.doc_id, a.i, md5(a.h || b.h) as h from r{level} a join r{level} b on b.doc_id = a.doc_id and b.i = a.i + {50 << level})")
    return "with " + ",\n".join(made) + " select doc_id, max(n) as repeated from (" + " union all ".join(found) + ") group by doc_id"


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    ranker = quality.train(docs, table(spark, sf_dir, "labels"), ~_fold(3, 1))
    return quality.score(docs, ranker).select("doc_id", _fold(3, 1).alias("held_out"), "score", "predicted")


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return secret_scan.scan(docs, secret_scan.train(docs))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


def op8_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(documents(spark, sf_dir), 5, 0.8)


OP8_SQL = r"""
with recursive w as (select doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9\x{80}-\x{10FFFF}]+') as words from documents),
g as (select distinct doc_id, array_to_string(words[i:i + least(5, len(words)) - 1], ' ') as gram
      from (select doc_id, words, unnest(range(1, greatest(len(words) - 4, least(len(words), 1)) + 1)) as i from w)),
k as (select doc_id, md5(string_agg(gram, '|' order by gram)) as key, count(*) as n from g group by doc_id),
r as (select key, min(doc_id) as rep, count(*) as copies, min(n) as n from k group by key),
rg as (select r.rep, g.gram from r join g on g.doc_id = r.rep),
i as (select x.rep as a, y.rep as b, count(*) as common from rg x join rg y on x.gram = y.gram and x.rep < y.rep group by x.rep, y.rep),
l as (select a, b from i join r ra on ra.rep = a join r rb on rb.rep = b where common * 10 >= 8 * (ra.n + rb.n - common)),
e as (select a, b from l union all select b, a from l),
c(node, label) as (select rep, rep from r union select e.b, c.label from c join e on e.a = c.node),
m as (select node, min(label) as class_id from c group by node),
d as (select e.a as rep, count(*) as text_links, sum(r.copies) as doc_links from e join r on r.rep = e.b group by e.a)
select w.doc_id, coalesce(m.class_id, w.doc_id) as class_id, coalesce(r.rep, w.doc_id) as representative, coalesce(r.copies, 1)::bigint as n_copies,
  coalesce(d.text_links, 0)::bigint as n_text_links, (coalesce(d.doc_links, 0) + coalesce(r.copies, 1) - 1)::bigint as n_links
from w left join k on k.doc_id = w.doc_id left join r on r.key = k.key left join m on m.node = r.rep left join d on d.rep = r.rep
"""


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files ``source/doc_id``."""
    files = documents(spark, sf_dir).select(F.col("doc_id").alias("file_id"), F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("path"), "text")
    return licenses.resolve(files).withColumnRenamed("file_id", "doc_id")


def op10_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.fingerprints(documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii": op1_pii,
    "op2_packing": op2_packing,
    "op3_language": op3_language,
    "op4_substrings": op4_substrings,
    "repeated_lengths": repeated_lengths,
    "op5_quality": op5_quality,
    "op6_secrets": op6_secrets,
    "op7_decontamination": op7_decontamination,
    "op8_jaccard": op8_jaccard,
    "op9_licenses": op9_licenses,
    "op10_merkle": op10_merkle,
}
ORACLE: dict[str, str] = {"op4_substrings": OP4_SQL, "repeated_lengths": _lengths_sql(), "op8_jaccard": OP8_SQL}
