"""Catalog: bundles, sections, identifiers, timelines and ranked browsing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions import text as fn

MISSING_DATE = 9999
REQUIRED = ("id", "title", "titlePinyin", "titleEnglish", "notBefore", "notAfter", "dzt_date")


def from_csv_rows(rows: DataFrame) -> DataFrame:
    """Catalog rows of a frontmatter table: blank ids skipped, years read, the last row of an id wins.

    ``rows`` has the required columns and ``ordinal``.
    """
    missing = [c for c in REQUIRED if c not in rows.columns]
    if missing:
        raise ValueError(f"the catalog table lacks {missing}")
    clean = rows.withColumn("id", F.trim("id")).where("id <> ''")
    latest = clean.groupBy("id").agg(F.max_by(F.struct(*[c for c in clean.columns if c != "id"]), "ordinal").alias("r")).select("id", "r.*")
    first, dzt = (lambda c: F.get(fn.years(c), F.lit(0))), fn.years("dzt_date")
    date = fn.index_date(first("notBefore"), first("notAfter"), F.get(dzt, F.lit(0)), F.coalesce(F.get(dzt, F.lit(1)), F.get(dzt, F.lit(0))))
    return latest.select(
        "id",
        *[F.when(F.trim(c) != "", F.trim(c)).alias(c) for c in ("title", "titlePinyin", "titleEnglish")],
        first("notBefore").alias("not_before"),
        first("notAfter").alias("not_after"),
        F.coalesce(date["value"], F.lit(MISSING_DATE)).alias("index_date"),
        date["source"].alias("index_date_source"),
        fn.section_code("id").alias("section_code"),
    )


def identifiers(manifests: DataFrame) -> DataFrame:
    """(textid, kind, value): identifier maps flattened, blanks and repeats dropped.

    ``manifests`` has textid and identifiers map<string, array<string>>.
    """
    pairs = manifests.select("textid", F.explode("identifiers").alias("kind", "values")).select("textid", "kind", F.explode("values").alias("value"))
    return pairs.withColumn("value", F.trim("value")).where("value <> ''").dropDuplicates()


def prefixes(codes: DataFrame, code: str) -> DataFrame:
    """(code, prefix) for every non-empty prefix of a code, itself included."""
    return codes.select(code, F.explode(F.transform(F.sequence(F.lit(1), F.length(code)), lambda n: F.left(F.col(code), n))).alias("prefix"))


def sections(codes: DataFrame, direct: DataFrame) -> DataFrame:
    """(code, parent_code, direct_count, descendant_count) of a taxonomy whose parents are prefixes.

    ``codes`` (code); ``direct`` (code, n) also of codes outside the taxonomy,
    which count for the prefixes they have in it.
    """
    codes = codes.select("code").distinct()
    under = prefixes(direct.select("code", "n"), "code").join(direct, "code").join(codes.withColumnRenamed("code", "prefix"), "prefix").groupBy("prefix").agg(F.sum("n").alias("descendant_count"))
    parents = prefixes(codes, "code").where("prefix <> code").join(codes.withColumnRenamed("code", "prefix"), "prefix").groupBy("code").agg(F.max_by("prefix", F.length("prefix")).alias("parent_code"))
    joined = codes.join(parents, "code", "left").join(direct.withColumnRenamed("n", "direct_count"), "code", "left").join(under.withColumnRenamed("prefix", "code"), "code", "left")
    return joined.select("code", "parent_code", F.coalesce("direct_count", F.lit(0)).cast("bigint").alias("direct_count"), F.coalesce("descendant_count", F.lit(0)).cast("bigint").alias("descendant_count"))


def timeline(dated: DataFrame, year: str = "index_date") -> DataFrame:
    """Rows by century: key, label, start, end, n; rows without a date are left out."""
    known = dated.where(F.col(year).isNotNull() & (F.col(year) != MISSING_DATE)).withColumn("c", fn.century(year))
    return known.groupBy(F.col("c.key").alias("key"), F.col("c.label").alias("label"), F.col("c.start").alias("start"), F.col("c.end").alias("end")).agg(F.count(F.lit(1)).alias("n"))


def rank(query: str, code: Column, *titles: Column) -> Column:
    """0 for the id itself, 1 for a prefix of it, 2 for part of a title, 3 for other matches."""
    query = query.lower()
    part = F.lit(False)
    for title in titles:
        part = part | F.coalesce(F.lower(title).contains(query), F.lit(False))
    return F.when(F.lower(code) == query, 0).when(F.lower(code).startswith(query), 1).when(part, 2).otherwise(3)


def search(bundles: DataFrame, identifiers_: DataFrame | None, query: str, columns: list[str]) -> DataFrame:
    """Bundles whose id, titles or any identifier hold the query, by rank, date and id.

    Wildcards in the query are plain characters.
    """
    low = query.lower()
    test = F.lower("textid").contains(low)
    for column in columns:
        test = test | F.coalesce(F.lower(column).contains(low), F.lit(False))
    found = bundles.withColumn("__own", test)
    if identifiers_ is not None:
        hits = identifiers_.where(F.lower("value").contains(low)).select("textid").distinct().withColumn("__hit", F.lit(True))
        found = found.join(hits, "textid", "left").where(F.col("__own") | F.coalesce("__hit", F.lit(False))).drop("__hit")
    else:
        found = found.where("__own")
    return found.drop("__own").withColumn("rank", rank(query, F.col("textid"), *[F.col(c) for c in columns]))


FILTER_KEYS = frozenset({"textid", "section", "title", "identifier", "edition", "tag", "date"})


def check_keys(keys: list[str], allowed: frozenset[str] = FILTER_KEYS) -> None:
    unknown = sorted(set(keys) - allowed)
    if unknown:
        raise ValueError(f"unknown filters: {unknown}")


def by_fields(records: DataFrame, filters: dict[str, list[str]], extract: dict[str, Column]) -> DataFrame:
    """Records that have one of the values of every filter; ``extract`` gives a filter's values of a record as an array."""
    check_keys(list(filters), frozenset(extract))
    test = F.lit(True)
    for key, values in filters.items():
        test = test & F.coalesce(F.arrays_overlap(extract[key], F.array(*[F.lit(v) for v in values])), F.lit(False))
    return records.where(test)


def resolve(identifier: str, keys: DataFrame) -> DataFrame:
    """Candidates for an identifier; of several, the only one without a base edition wins.

    ``keys`` has key, textid and base_edition.
    """
    found = keys.where(F.col("key") == identifier).dropDuplicates(["textid"])
    from pyspark.sql import Window

    whole = Window.partitionBy("key")
    n, plain = F.count(F.lit(1)).over(whole), F.sum(F.when(F.col("base_edition").isNull(), 1).otherwise(0)).over(whole)
    return found.withColumns({"__n": n, "__plain": plain}).where("__n = 1 or (__plain = 1 and base_edition is null) or __plain <> 1").withColumn("ambiguous", (F.col("__n") > 1) & (F.col("__plain") != 1)).drop("__n", "__plain")


def missing(expected: DataFrame, have: DataFrame, key: str) -> DataFrame:
    """Rows of ``expected`` without a row in ``have``: stubs to fill in, sources to import."""
    return expected.join(have.select(key).distinct(), key, "left_anti")


def natural_order(code: str = "code") -> list[Column]:
    """Number, then letters, of a section code."""
    return [F.regexp_extract(code, r"^KR(\d+)", 1).try_cast("int"), F.regexp_extract(code, r"^KR\d+(.*)$", 1)]


def tabulated(manifests: DataFrame, keys: str = "keys", ident: str = "textid", samples: int = 3) -> DataFrame:
    """How many manifests have each key, with the first few ids that do."""
    rows = manifests.select(ident, F.explode(keys).alias("key"))
    # a bounded set of least ids for each key: per task, then overall
    from pyspark.sql import Window

    rank_ = F.row_number().over(Window.partitionBy("key").orderBy(ident))
    counts = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    first = rows.withColumn("__r", rank_).where(F.col("__r") <= samples).groupBy("key").agg(F.array_sort(F.collect_list(ident)).alias("samples"))
    return counts.join(first, "key")
