"""Half-open intervals: joins by containment and overlap, merging, gaps, depth.

Every join has an equality key (a text bucket) beside the range condition, so it
is an ordinary distributed join whose residual filter is the range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def classify(hits: DataFrame, ranges: DataFrame, keys: list[str], start: str = "start", end: str = "end", order: list[str] | None = None) -> DataFrame:
    """``hits`` with ``voice`` and ``voice_stack``.

    Ranges (keys, r_start, r_end, name) that contain the hit, widest first, are
    the stack and the innermost is the voice; ranges that only touch it make it
    ``mixed``, no range ``none``.
    """
    touching = (F.col("r.r_start") < F.col(f"h.{end}")) & (F.col("r.r_end") > F.col(f"h.{start}"))
    on = [F.col(f"h.{k}") == F.col(f"r.{k}") for k in keys]
    inside = (F.col("r.r_start") <= F.col(f"h.{start}")) & (F.col("r.r_end") >= F.col(f"h.{end}"))
    entry = F.struct((F.col("r.r_end") - F.col("r.r_start")).alias("width"), F.col("r.r_start").alias("r_start"), F.col("r.name").alias("name"))
    joined = hits.alias("h").join(ranges.alias("r"), [*on, touching], "left")
    grouped = joined.groupBy([F.col(f"h.{c}").alias(c) for c in hits.columns]).agg(
        F.sort_array(F.collect_list(F.when(inside, entry)), asc=False).alias("found"), F.count("r.name").alias("touched")
    )
    stack = F.transform("found", lambda x: x["name"])
    voice = F.when(F.size("found") > 0, F.element_at(stack, -1)).when(F.col("touched") > 0, "mixed").otherwise("none")
    return grouped.select(*hits.columns, voice.alias("voice"), stack.alias("voice_stack"))


def innermost(hits: DataFrame, spans: DataFrame, keys: list[str], offset: str, label: str = "label") -> DataFrame:
    """``hits`` with the label of the shortest span (keys, span_start, span_end) that holds the offset."""
    on = [F.col(f"h.{k}") == F.col(f"s.{k}") for k in keys]
    holds = (F.col("s.span_start") <= F.col(f"h.{offset}")) & (F.col("s.span_end") > F.col(f"h.{offset}"))
    rank = F.struct(F.col("s.span_end") - F.col("s.span_start"), F.col("s.span_start"), F.col(f"s.{label}"))
    joined = hits.alias("h").join(spans.alias("s"), [*on, holds], "left")
    return joined.groupBy([F.col(f"h.{c}").alias(c) for c in hits.columns]).agg(F.min_by(F.col(f"s.{label}"), rank).alias("toc_label"))


def overlapping(windows: DataFrame, items: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs of a window (lo, hi) and an item (i_start, i_end) of the same keys that overlap."""
    on = [F.col(f"w.{k}") == F.col(f"i.{k}") for k in keys]
    return windows.alias("w").join(items.alias("i"), [*on, F.col("i.i_start") < F.col("w.hi"), F.col("i.i_end") > F.col("w.lo")])


def merged(spans: DataFrame, keys: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """Overlapping and touching spans of each key as one: keys, start, end, pieces."""
    by = Window.partitionBy(*keys).orderBy(start, end)
    before = F.max(end).over(by.rowsBetween(Window.unboundedPreceding, -1))
    island = F.sum(F.when(before.isNull() | (F.col(start) > before), 1).otherwise(0)).over(by)
    return spans.withColumn("__island", island).groupBy(*keys, "__island").agg(F.min(start).alias(start), F.max(end).alias(end), F.count(F.lit(1)).alias("pieces")).drop("__island")


def gaps(rows: DataFrame, keys: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """``rows`` with ``gap``: how far a row starts after the one before it ends, 0 at least; first null."""
    by = Window.partitionBy(*keys).orderBy(start, end)
    previous = F.lag(end).over(by)
    return rows.withColumn("gap", F.when(previous.isNotNull(), F.greatest(F.col(start) - previous, F.lit(0))))


def ends(rows: DataFrame, keys: list[str], start: str, length: Column) -> DataFrame:
    """``rows`` with ``end``: the next row's start, or the text's length."""
    return rows.withColumn("end", F.lead(start).over(Window.partitionBy(*keys).orderBy(start))).withColumn("end", F.coalesce("end", length))


def runs(rows: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """Consecutive rows with the same value as one: keys, value, first and last place, count."""
    by = Window.partitionBy(*keys).orderBy(order)
    changed = F.when(F.lag(value).over(by).eqNullSafe(F.col(value)) & F.lag(order).over(by).isNotNull(), 0).otherwise(1)
    return rows.withColumn("__changed", changed).withColumn("__run", F.sum("__changed").over(by)).groupBy(*keys, "__run", value).agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count(F.lit(1)).alias("n")).drop("__run")


def clustered(rows: DataFrame, keys: list[str], order: str, tolerance: int) -> DataFrame:
    """``rows`` with the number of their cluster; more than ``tolerance`` places between two rows part clusters."""
    by = Window.partitionBy(*keys).orderBy(order)
    apart = F.when(F.col(order) - F.lag(order).over(by) - 1 > tolerance, 1).otherwise(0)
    return rows.withColumn("__apart", apart).withColumn("cluster", F.sum("__apart").over(by)).drop("__apart")


def carried(rows: DataFrame, keys: list[str], order: str, value: Column, name: str) -> DataFrame:
    """``rows`` with the last non-null ``value`` before each row."""
    by = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn(name, F.last(value, ignorenulls=True).over(by))


def depth(marks: DataFrame, keys: list[str], order: list[str], step: Column) -> DataFrame:
    """``marks`` with the running sum of ``step`` (+1 opens, -1 closes) after each row."""
    return marks.withColumn("depth", F.sum(step).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))


def counter(rows: DataFrame, keys: list[str], prefix: Column, order: list[str]) -> DataFrame:
    """``rows`` with ids that count up within a prefix: r1, r2, c1."""
    named = rows.withColumn("__prefix", prefix)
    number = F.row_number().over(Window.partitionBy(*keys, "__prefix").orderBy(*order))
    return named.withColumn("id", F.concat("__prefix", number.cast("string"))).drop("__prefix")


def nearest(rows: DataFrame, keys: list[str], focus: Column, start: str = "start", end: str = "end") -> DataFrame:
    """For each key the row that lies closest to a place: 0 inside, else the distance to its nearer end."""
    distance = F.when(focus < F.col(start), F.col(start) - focus).when(focus >= F.col(end), focus - F.col(end) + 1).otherwise(0)
    everything = F.struct(*[F.col(c) for c in rows.columns])
    return rows.withColumn("__d", distance).groupBy(*keys).agg(F.min_by(everything, F.struct("__d", start, end)).alias("r")).select("r.*")
