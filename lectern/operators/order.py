"""Global order at scale: row numbers, pages, samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.storage import stored


def numbered(rows: DataFrame, *order: Column | str, name: str = "position") -> DataFrame:
    """``rows`` with their number, from 1, in a total order.

    Rows are range partitioned and sorted, numbered within their partition, and
    moved up by the sizes of the partitions before: no task has all rows.
    """
    placed = stored(rows.orderBy(*order).withColumn("__id", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("__id", 33)
    sizes = placed.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("__n"))
    # one row for each partition
    before = sizes.withColumn("__before", F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__n")
    own = F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.withColumn("__part", part).join(F.broadcast(before), "__part").withColumn(name, own + F.col("__before") + 1).drop("__part", "__before", "__id")


def page(rows: DataFrame, order: list[Column | str], offset: int, limit: int) -> DataFrame:
    """One page in order; the number of all rows is a count of its own."""
    return rows.orderBy(*order).offset(offset).limit(limit)


def over_cap(rows: DataFrame, cap: int) -> bool:
    """Whether there are more rows than ``cap``, without counting them all."""
    return rows.limit(cap + 1).count() > cap


def quotas(counts: DataFrame, stratum: str, target: int) -> DataFrame:
    """How many rows each stratum gives of ``target``: one at least, the rest by largest remainder.

    ``counts`` has a row for each stratum (stratum, n).
    """
    total = Window.partitionBy()
    share = counts.withColumn("__exact", F.col("n") * F.lit(target) / F.sum("n").over(total))
    share = share.withColumn("__base", F.least(F.greatest(F.floor("__exact"), F.lit(1)), F.col("n")))
    left = F.greatest(F.lit(target) - F.sum("__base").over(total), F.lit(0))
    rank = F.row_number().over(Window.orderBy(F.desc(F.col("__exact") - F.floor("__exact")), stratum))
    share = share.withColumn("__left", left).withColumn("__rank", rank)
    quota = F.col("__base") + F.when((F.col("__rank") <= F.col("__left")) & (F.col("__base") < F.col("n")), 1).otherwise(0)
    return share.withColumn("quota", quota.cast("long")).select(stratum, "n", "quota")


def stratified(rows: DataFrame, stratum: str, key: str, target: int, seed: int = 0) -> DataFrame:
    """An exact stratified sample: within a stratum by the hash of the key and the seed."""
    counts = rows.groupBy(stratum).agg(F.count(F.lit(1)).alias("n"))
    chosen = F.row_number().over(Window.partitionBy(stratum).orderBy(F.xxhash64(F.lit(seed), F.col(key)), key))
    return rows.withColumn("__rank", chosen).join(quotas(counts, stratum, target).drop("n"), stratum).where("__rank <= quota").drop("__rank", "quota")


def first_wins(rows: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """The first row of each key."""
    return rows.withColumn("__rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__rank = 1").drop("__rank")


def top(rows: DataFrame, keys: list[str], order: list[Column], limit: int) -> DataFrame:
    """The first ``limit`` rows of each key, with their rank."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long")).where(F.col("rank") <= limit)
