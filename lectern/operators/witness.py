"""Witness texts: readings of one edition laid over the master text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEGMENT = "struct<w_start:int,w_end:int,m_start:int,m_end:int,is_variant:boolean>"


def derive(buckets: DataFrame, variants: DataFrame) -> DataFrame:
    """(bucket_id, witness, text, segments) for every witness that has a reading in a bucket.

    ``variants`` has (bucket_id, offset, length, witness, form). Readings apply
    in offset order; one that starts inside the last is skipped. One fold over
    a bucket's own readings carries the cursors, the text and the segments.
    """
    entry = F.struct("offset", "length", "form")
    own = variants.groupBy("bucket_id", "witness").agg(F.sort_array(F.collect_list(entry)).alias("readings"))
    joined = own.join(buckets.select("bucket_id", F.col("text").alias("master")), "bucket_id")
    state = F.struct(F.lit(0).alias("m"), F.lit(0).alias("w"), F.lit("").alias("text"), F.array().cast(f"array<{SEGMENT}>").alias("segments"))

    def segment(w: Column, w_end: Column, m: Column, m_end: Column, variant: bool) -> Column:
        return F.struct(w.alias("w_start"), w_end.alias("w_end"), m.alias("m_start"), m_end.alias("m_end"), F.lit(variant).alias("is_variant"))

    def step(acc: Column, r: Column) -> Column:
        m, w, at = acc["m"], acc["w"], r["offset"]
        plain = F.substring(F.col("master"), m + 1, at - m)
        w_at = w + (at - m)
        same = F.when(at > m, F.array(segment(w, w_at, m, at, False))).otherwise(F.array().cast(f"array<{SEGMENT}>"))
        other = F.array(segment(w_at, w_at + F.length(r["form"]), at, at + r["length"], True))
        applied = F.struct(
            (at + r["length"]).alias("m"), (w_at + F.length(r["form"])).alias("w"), F.concat(acc["text"], plain, r["form"]).alias("text"), F.concat(acc["segments"], same, other).alias("segments")
        )
        return F.when(at < m, acc).otherwise(applied)

    def finish(acc: Column) -> Column:
        m, w, n = acc["m"], acc["w"], F.length("master")
        rest = F.when(m < n, F.array(segment(w, w + n - m, m, n, False))).otherwise(F.array().cast(f"array<{SEGMENT}>"))
        return F.struct(F.concat(acc["text"], F.substring(F.col("master"), m + 1, n)).alias("text"), F.concat(acc["segments"], rest).alias("segments"))

    made = joined.withColumn("made", F.aggregate("readings", state, step, finish))
    return made.select("bucket_id", "witness", "made.text", "made.segments")


def to_master(segments: Column, start: Column, end: Column) -> Column:
    """struct(offset, length) of a witness span in the master; a touched variant counts as a whole."""
    at = lambda p: F.get(F.filter(segments, lambda s: (s["w_start"] <= p) & (p < s["w_end"])), F.lit(0))
    first, last = at(start), at(end - 1)
    low = F.when(first["is_variant"], first["m_start"]).otherwise(first["m_start"] + start - first["w_start"])
    high = F.when(last["is_variant"], last["m_end"]).otherwise(last["m_start"] + end - last["w_start"])
    empty = F.struct(F.when(first.isNotNull(), low).otherwise(F.coalesce(F.element_at(segments, -1)["m_end"], F.lit(0))).alias("offset"), F.lit(0).alias("length"))
    missing = F.struct(F.lit(0).alias("offset"), F.lit(0).alias("length"))
    return F.when(end <= start, empty).when(first.isNull() | last.isNull(), missing).otherwise(F.struct(low.alias("offset"), (high - low).alias("length")))


def hits(witnesses: DataFrame, buckets: DataFrame, query: str) -> DataFrame:
    """Hits in witness texts, in master coordinates, without those that the master text has as well."""
    from lectern.operators.search import hits_of

    found = hits_of(witnesses, query).withColumn("span", to_master(F.col("segments"), F.col("master_offset"), F.col("master_offset") + F.col("master_length")))
    joined = found.select("bucket_id", "witness", F.col("span.offset").alias("offset"), F.col("span.length").alias("length")).join(buckets.select("bucket_id", "text"), "bucket_id")
    match = F.substring(F.col("text"), F.col("offset") + 1, F.col("length"))
    return joined.withColumn("match", match).where(F.col("match") != query).select("bucket_id", "witness", F.col("offset").alias("master_offset"), F.col("length").alias("master_length"), "match", F.lit(query).alias("matched_text"))


def window(segments: Column, text: Column, start: Column, end: Column, context: int, pad: int = 6) -> Column:
    """struct(left, right, left_variant_offset, right_variant_end) around a witness hit.

    The window grows to the nearest variant on each side and a few characters
    beyond it, so that a reading is not cut in two.
    """
    left_variants = F.filter(segments, lambda s: s["is_variant"] & (s["w_start"] < start) & (s["w_end"] > start - context))
    right_variants = F.filter(segments, lambda s: s["is_variant"] & (s["w_end"] > end) & (s["w_start"] < end + context))
    low = F.greatest(F.least(start - context, F.coalesce(F.array_min(F.transform(left_variants, lambda s: s["w_start"])) - pad, start - context)), F.lit(0))
    high = F.greatest(end + context, F.coalesce(F.array_max(F.transform(right_variants, lambda s: s["w_end"])) + pad, end + context))
    return F.struct(
        F.substring(text, low + 1, start - low).alias("left"),
        F.substring(text, end + 1, high - end).alias("right"),
        F.coalesce(F.array_min(F.transform(left_variants, lambda s: s["w_start"])) - low, F.lit(0)).alias("left_variant_offset"),
        F.coalesce(F.array_max(F.transform(right_variants, lambda s: s["w_end"])) - end, F.lit(0)).alias("right_variant_end"),
    )
