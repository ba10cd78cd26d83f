"""Annotations and translations: projection, counting, checking, alignment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import text as fn

DROPPED = ("rejected", "superseded")


def located(raw: DataFrame) -> DataFrame:
    """Rows of parsed annotations that can be found again.

    Rejected and superseded ones go, and so do those without a sense or device
    id or without a whole-number offset. ``raw`` has id, textid, seq, marker_id,
    sense_id, device_id, offset (text), curation_state and rating (text).
    """
    offset = F.when(F.col("offset").rlike(r"^-?\d+$"), F.col("offset").cast("int"))
    rating = F.when(F.col("rating").rlike(r"^\d+$"), F.col("rating").cast("int"))
    kept = raw.where(~F.coalesce(F.col("curation_state").isin(*DROPPED), F.lit(False)))
    return kept.withColumns({"offset": offset, "rating": rating}).where((F.col("sense_id").isNotNull() | F.col("device_id").isNotNull()) & F.col("offset").isNotNull())


def counts(requested: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """(key, n) for every requested id, zeros included; ids with and without ``uuid-`` are one."""
    bare = rows.select(fn.bare_uuid(F.col(key)).alias("__k")).groupBy("__k").agg(F.count(F.lit(1)).alias("n"))
    return requested.withColumn("__k", fn.bare_uuid(F.col(key))).join(bare, "__k", "left").select(key, F.coalesce("n", F.lit(0)).alias("n"))


def listing(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Places of one sense or device in the order of the texts."""
    return rows.where(fn.bare_uuid(F.col(key)) == value).orderBy("textid", "seq", "offset", "id")


def with_context(rows: DataFrame, texts: DataFrame, keys: list[str], width: int = 7) -> DataFrame:
    """``rows`` (offset, length) with the characters around them; no text, no context."""
    joined = rows.join(texts.select(*keys, "text"), keys, "left")
    at, n = F.col("offset"), F.col("length")
    return joined.withColumns({"left": fn.left_context("text", at, width), "match": fn.slice_text("text", at, n), "right": fn.slice_text("text", at + n, F.lit(width))}).drop("text")


def checked(rows: DataFrame, texts: DataFrame, keys: list[str], window: int = 50) -> DataFrame:
    """``rows`` (offset, orth) with status ok, moved, ambiguous or missing, and the offset to move to.

    An anchor whose text is not at its offset is looked for within ``window``
    characters; a single find moves it.
    """
    joined = rows.join(texts.select(*keys, "text"), keys, "left")
    at, n = F.col("offset"), F.length("orth")
    here = F.coalesce(fn.slice_text("text", at, n) == F.col("orth"), F.lit(False)) & (at >= 0)
    low = F.greatest(at - window, F.lit(0))
    near = F.filter(F.sequence(low, F.greatest(at + window, low)), lambda p: F.substring(F.col("text"), p + 1, n) == F.col("orth"))
    joined = joined.withColumns({"__here": here, "__near": F.coalesce(near, F.array().cast("array<int>"))})
    status = F.when(F.col("__here"), "ok").when(F.size("__near") == 1, "moved").when(F.size("__near") > 1, "ambiguous").otherwise("missing")
    return joined.withColumns({"status": status, "new_offset": F.when(F.col("__here"), at).when(F.size("__near") == 1, F.get("__near", F.lit(0)))}).drop("text", "__here", "__near")


def consensus(checked_rows: DataFrame, marker: str) -> DataFrame:
    """(marker, delta) of markers all of whose moved anchors moved alike."""
    delta = F.col("new_offset") - F.col("offset")
    return checked_rows.where("status = 'moved'").groupBy(marker).agg(F.countDistinct(delta).alias("n"), F.min(delta).alias("delta")).where("n = 1").select(marker, "delta")


def summary(checked_rows: DataFrame) -> DataFrame:
    return checked_rows.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def marker_positions(rows: DataFrame, markers: DataFrame) -> DataFrame:
    """``rows`` (textid, seq, marker_id, offset) with the bucket and the place in it, first bucket by order."""
    order = F.when(F.col("bucket") == "front", 0).when(F.col("bucket") == "body", 1).otherwise(2)
    first = markers.groupBy("textid", "seq", "marker_id").agg(F.min_by(F.struct("bucket", "marker_offset"), F.struct(order, "marker_offset")).alias("m"))
    joined = rows.join(first, ["textid", "seq", "marker_id"], "left")
    return joined.withColumns({"bucket": F.col("m.bucket"), "bucket_offset": F.col("m.marker_offset") + F.col("offset")}).drop("m")


def merged_by_content(existing: DataFrame, incoming: DataFrame, cid: str = "cid") -> DataFrame:
    """``existing`` without what is incoming or superseded by it, and all that is incoming."""
    gone = incoming.select(cid).unionByName(incoming.where("supersedes is not null").select(F.col("supersedes").alias(cid))).distinct()
    return existing.join(gone, cid, "left_anti").unionByName(incoming.select(existing.columns))


def rejected(rows: DataFrame) -> DataFrame:
    return rows.where("curation_state = 'rejected'")


# -- translations -----------------------------------------------------------------


def source_segments(texts: DataFrame, marks: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, corresp, start, end): a segment runs to the next mark or the text's end."""
    joined = marks.join(texts.select(*keys, F.length("text").alias("__n")), keys)
    end = F.lead("offset").over(Window.partitionBy(*keys).orderBy("offset", "corresp"))
    return joined.select(*keys, "corresp", F.col("offset").alias("start"), F.coalesce(end, F.col("__n")).alias("end"))


def aligned(segments: DataFrame, translated: DataFrame, keys: list[str]) -> DataFrame:
    """Source segments with their translation; of a text for several segments the first has it, the others continue it.

    ``translated`` has keys, corresp array, ord and text.
    """
    each = translated.select(*keys, F.posexplode("corresp").alias("place", "corresp"), "ord", "text")
    entry = F.struct("ord", F.when(F.col("place") == 0, F.col("text")).otherwise("").alias("text"), (F.col("place") > 0).alias("continued"))
    grouped = each.groupBy(*keys, "corresp").agg(F.sort_array(F.collect_list(entry)).alias("t"))
    joined = segments.join(grouped, [*keys, "corresp"], "left")
    return joined.select(*segments.columns, F.array_join(F.transform(F.filter("t", lambda x: ~x["continued"]), lambda x: x["text"]), " ").alias("translation"), F.coalesce(F.exists("t", lambda x: x["continued"]), F.lit(False)).alias("continued"))


def search(segments: DataFrame, bundles: DataFrame, query: str, lang: str | None = None, ai: bool | None = None, low: int | None = None, high: int | None = None) -> DataFrame:
    """Segments that hold a folded query, with their bundle; date bounds are inclusive."""
    found = segments.where(F.col("text_search").contains(query)).join(bundles, "translation_id")
    if lang is not None:
        found = found.where(F.col("language") == lang)
    if ai is not None:
        found = found.where(fn.is_ai("title", "names") == F.lit(ai))
    if low is not None:
        found = found.where(F.coalesce(F.col("index_date") >= low, F.lit(False)))
    if high is not None:
        found = found.where(F.coalesce(F.col("index_date") <= high, F.lit(False)))
    return found


def facets(found: DataFrame, dimensions: dict[str, Column]) -> DataFrame:
    """(dim, value, n) of hits."""
    pairs = F.array(*[F.struct(F.lit(d).alias("dim"), c.cast("string").alias("value")) for d, c in dimensions.items()])
    return found.select(F.explode(pairs).alias("f")).groupBy("f.dim", "f.value").agg(F.count(F.lit(1)).alias("n")).where("value is not null")


def listing_of(bundles: DataFrame, segments: DataFrame, query: str, columns: list[str]) -> DataFrame:
    """Bundles whose metadata or any segment hold the query."""
    test = F.lit(False)
    for column in columns:
        test = test | F.coalesce(F.lower(column).contains(query.lower()), F.lit(False))
    hits = segments.where(F.col("text_search").contains(query.lower())).select("translation_id").distinct().withColumn("__hit", F.lit(True))
    return bundles.join(hits, "translation_id", "left").where(test | F.coalesce("__hit", F.lit(False))).drop("__hit")


def translator(responsibility: Column) -> Column:
    """The first contributor with a name."""
    return F.get(F.filter(responsibility, lambda r: F.coalesce(r["name"] != "", F.lit(False))), F.lit(0))["name"]
