"""Validation: rules as queries, each giving (rule, path, message) rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def finding(rows: DataFrame, rule: str, path: Column, message: Column | str, severity: str = "error") -> DataFrame:
    text = F.lit(message) if isinstance(message, str) else message
    return rows.select(F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), path.cast("string").alias("path"), text.alias("message"))


def unique(rows: DataFrame, keys: list[str], value: str, rule: str) -> DataFrame:
    """Values that a key has more than once."""
    twice = rows.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return finding(twice, rule, F.concat_ws("/", *keys), F.concat(F.lit("repeated "), F.col(value).cast("string")))


def increasing(rows: DataFrame, keys: list[str], order: str, value: str, rule: str) -> DataFrame:
    """Rows whose value is not above the one before."""
    before = F.lag(value).over(Window.partitionBy(*keys).orderBy(order))
    bad = rows.withColumn("__before", before).where(F.col(value) <= F.col("__before"))
    return finding(bad, rule, F.concat_ws("/", *keys), F.concat(F.col(value).cast("string"), F.lit(" after "), F.col("__before").cast("string")))


def bounds(rows: DataFrame, path: Column, low: Column, high: Column, limit: Column, rule: str) -> DataFrame:
    bad = rows.where((low < 0) | (high < low) | (high > limit))
    return finding(bad, rule, path, F.concat(low.cast("string"), F.lit(".."), high.cast("string"), F.lit(" of "), limit.cast("string")))


def orphans(children: DataFrame, parents: DataFrame, key: str, rule: str) -> DataFrame:
    """Rows that point to nothing."""
    return finding(children.join(parents.select(key).distinct(), key, "left_anti"), rule, F.col(key), "points to nothing")


def required(rows: DataFrame, path: Column, columns: list[str], rule: str) -> DataFrame:
    blanks = F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in columns]))
    return finding(rows.withColumn("__m", F.explode(blanks)), rule, path, F.concat(F.lit("lacks "), F.col("__m")))


def pattern(rows: DataFrame, path: Column, column: str, regex: str, rule: str) -> DataFrame:
    return finding(rows.where(~F.coalesce(F.col(column).rlike(regex), F.lit(False))), rule, path, F.coalesce(F.col(column), F.lit("null")))


def known_types(markers: DataFrame, path: Column, types: list[str], rule: str = "marker_type") -> DataFrame:
    return finding(markers.where(~F.coalesce(F.col("type").isin(types), F.lit(False))), rule, path, F.coalesce("type", F.lit("null")))


def parity(measured: DataFrame, path: Column, ours: str, theirs: str, tolerance: float = 0.05, rule: str = "char_count") -> DataFrame:
    """Counts that differ by more than a share of the source's."""
    off = F.abs(F.col(ours) - F.col(theirs)) > F.lit(tolerance) * F.col(theirs)
    return finding(measured.where(off), rule, path, F.concat(F.col(ours).cast("string"), F.lit(" against "), F.col(theirs).cast("string")), "warning")


def declared(actual: DataFrame, stated: DataFrame, keys: list[str], rule: str) -> DataFrame:
    """Counts declared and found that do not agree, also where either is missing."""
    both = actual.withColumnRenamed("n", "__a").join(stated.withColumnRenamed("n", "__s"), keys, "full").where(~F.col("__a").eqNullSafe(F.col("__s")))
    return finding(both, rule, F.concat_ws("/", *keys), F.concat(F.lit("declared "), F.coalesce(F.col("__s").cast("string"), F.lit("nothing")), F.lit(", found "), F.coalesce(F.col("__a").cast("string"), F.lit("nothing"))))


def id_drift(frozen: DataFrame, now: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, kind): ids missing, added, or meaning something else than when they were frozen."""
    both = frozen.withColumnRenamed(value, "__was").withColumn("__f", F.lit(True)).join(now.withColumnRenamed(value, "__is").withColumn("__n", F.lit(True)), keys, "full")
    kind = F.when(F.col("__n").isNull(), "missing").when(F.col("__f").isNull(), "extra").when(~F.col("__was").eqNullSafe(F.col("__is")), "repurposed")
    return both.withColumn("kind", kind).where("kind is not null").select(*keys, "kind")


def tree_diff(ours: DataFrame, sample: DataFrame, expected: list[str]) -> DataFrame:
    """(path, ours, sample, kind): leaves that differ, and whether their path is one where that is expected."""
    both = ours.withColumnRenamed("value", "ours").join(sample.withColumnRenamed("value", "sample"), "path", "full").where(~F.col("ours").eqNullSafe(F.col("sample")))
    test = F.lit(False)
    for prefix in expected:
        test = test | F.col("path").startswith(prefix)
    return both.withColumn("kind", F.when(test, "expected").otherwise("unexpected"))


def drift(disk: DataFrame, index: DataFrame, key: str, digest: str) -> DataFrame:
    """(key, state): added, removed or changed since the index was built."""
    both = disk.select(key, F.col(digest).alias("__d")).join(index.select(key, F.col(digest).alias("__i")), key, "full")
    state = F.when(F.col("__i").isNull(), "added").when(F.col("__d").isNull(), "removed").when(F.col("__d") != F.col("__i"), "changed")
    return both.withColumn("state", state).where("state is not null").select(key, "state")


def stale(sources: DataFrame, built: DataFrame, key: str, version: int) -> DataFrame:
    """Keys to build anew: never built, built by another version, or changed since."""
    joined = sources.select(key, "modified").join(built.select(key, "built", "version"), key, "left")
    return joined.where((F.col("built").isNull()) | (F.col("version") != version) | (F.col("modified") > F.col("built"))).select(key)


def compared(local: DataFrame, remote: DataFrame, key: str) -> DataFrame:
    """(key, where): here only, there only, or both."""
    both = local.select(key).distinct().withColumn("__l", F.lit(True)).join(remote.select(key).distinct().withColumn("__r", F.lit(True)), key, "full")
    return both.select(key, F.when(F.col("__r").isNull(), "local").when(F.col("__l").isNull(), "remote").otherwise("both").alias("where"))


def collapsed(findings: DataFrame, most: int = 5) -> DataFrame:
    """The first findings of each rule and path, with how many there are: the report's own limit."""
    by = Window.partitionBy("rule", "path")
    return findings.withColumns({"total": F.count(F.lit(1)).over(by), "place": F.row_number().over(by.orderBy("message"))}).where(F.col("place") <= most).drop("place")


def summary(findings: DataFrame) -> DataFrame:
    """(dim, value, n) of findings by severity, rule and path."""
    pairs = F.array(*[F.struct(F.lit(d).alias("dim"), F.col(d).alias("value")) for d in ("severity", "rule", "path")])
    return findings.select(F.explode(pairs).alias("p")).groupBy("p.dim", "p.value").agg(F.count(F.lit(1)).alias("n"))


def all_of(*found: DataFrame) -> DataFrame:
    """All rules' findings as one table."""
    whole = found[0]
    for part in found[1:]:
        whole = whole.unionByName(part)
    return whole


def negative_offsets(markers: DataFrame) -> DataFrame:
    return markers.where(F.col("offset") < 0)


def next_serial(ids: DataFrame, prefix: str) -> int:
    """The least number from 1 that no id of a prefix has."""
    numbers = ids.where(F.col("textid").startswith(prefix)).select(F.regexp_extract("textid", r"(\d+)$", 1).try_cast("int").alias("n")).where("n is not null").distinct()
    gap = numbers.join(numbers.select((F.col("n") - 1).alias("n")), "n", "left_anti").agg(F.min(F.col("n") + 1)).first()[0]
    first = numbers.where("n = 1").isEmpty()
    return 1 if first or gap is None else gap
