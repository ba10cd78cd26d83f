"""Selection, slicing and the algebra of edits on codepoint-addressed text.

Markers are arrays of struct(offset, length, type, id, ...) beside their text,
so slicing and rebasing are array expressions on one row.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import text as fn


def checked(text: Column, offset: Column, length: Column) -> Column:
    """Whether a range lies in a text."""
    return (offset >= 0) & (length >= 0) & (offset + length <= F.length(text))


def slice_markers(markers: Column, offset: Column, length: Column) -> Column:
    """Markers with offset in [offset, offset + length), moved to the slice's start."""
    inside = F.filter(markers, lambda m: (m["offset"] >= offset) & (m["offset"] < offset + length))
    return F.transform(inside, lambda m: m.withField("offset", m["offset"] - offset))


def by_offset(rows: DataFrame, offset: Column, length: Column) -> DataFrame:
    """``rows`` cut to a range; a range outside the text is null, not an error."""
    valid = checked(F.col("text"), offset, length)
    return rows.withColumns({"slice": F.when(valid, fn.slice_text("text", offset, length)), "slice_markers": F.when(valid, slice_markers(F.col("markers"), offset, length))})


def between_markers(rows: DataFrame, first: str, second: str) -> DataFrame:
    """``rows`` cut from one marker to another, the first of each id, either way round."""
    at = lambda name: F.get(F.filter("markers", lambda m: m["id"] == name), F.lit(0))["offset"]
    low, high = F.least(at(first), at(second)), F.greatest(at(first), at(second))
    known = at(first).isNotNull() & at(second).isNotNull()
    cut = by_offset(rows, low, high - low)
    return cut.withColumns({"slice": F.when(known, F.col("slice")), "slice_markers": F.when(known, F.col("slice_markers"))})


def by_toc(rows: DataFrame, toc: DataFrame, label_id: str, keys: list[str]) -> DataFrame:
    """``rows`` cut to the span of an entry of their table of contents."""
    span = toc.where(F.col("marker_id") == label_id).select(*keys, "span_start", "span_end")
    joined = rows.join(span, keys)
    return by_offset(joined, F.col("span_start"), F.col("span_end") - F.col("span_start")).drop("span_start", "span_end")


def select(rows: DataFrame, selection: dict, toc: DataFrame | None = None) -> DataFrame:
    """Run a selection: juan, bucket, from and to, offset and length, or toc; none is the whole text."""
    kinds = [k for k in (("offset", "length"), ("from", "to"), ("toc",)) if any(x in selection for x in k)]
    if len(kinds) > 1:
        raise ValueError("a selection is by offset, by markers or by contents, not several of them")
    if "juan" in selection:
        rows = rows.where(F.col("juan_seq") == selection["juan"])
    if "toc" not in selection:
        rows = rows.where(F.col("bucket") == selection.get("bucket", "body"))
    if "offset" in selection:
        return by_offset(rows, F.lit(selection["offset"]), F.lit(selection["length"]))
    if "from" in selection:
        return between_markers(rows, selection["from"], selection["to"])
    if "toc" in selection:
        return by_toc(rows, toc, selection["toc"], ["textid", "juan_seq", "bucket"])
    return by_offset(rows, F.lit(0), F.length("text"))


def fulfil(pins: DataFrame, corpus: DataFrame) -> DataFrame:
    """Pins (pin, textid, hash, offset, length) with their text, whether the hash still holds, and an error if any.

    A pin that cannot be met has its error in its row; the others are met.
    """
    joined = pins.join(corpus.select("textid", "text", F.col("hash").alias("current")), "textid", "left")
    offset, length = F.coalesce("offset", F.lit(0)), F.coalesce("length", F.length("text") - F.coalesce("offset", F.lit(0)))
    error = F.when(F.col("text").isNull(), "not_found").when(~checked(F.col("text"), offset, length), "out_of_range")
    return joined.withColumns({"error": error, "verified": F.when(F.col("text").isNotNull(), F.coalesce(F.col("hash") == F.col("current"), F.lit(True)))}).select(
        "pin", "textid", F.when(F.col("error").isNull(), fn.slice_text("text", offset, length)).alias("text"), "verified", "error"
    )


def render(rows: DataFrame, template: str, missing: str = "") -> DataFrame:
    """``rows`` with ``rendered``: a template whose ``{{ name }}`` are columns of the row, all others as it stands.

    The template becomes one expression, so rows are rendered where they lie. An
    unknown name is refused; a null is ``missing``.
    """
    parts = re.split(r"\{\{\s*([A-Za-z_]\w*)\s*\}\}", template)
    unknown = sorted(set(parts[1::2]) - set(rows.columns))
    if unknown:
        raise ValueError(f"the template names {unknown}, which are no columns")
    shown = [F.coalesce(F.col(part).cast("string"), F.lit(missing)) if i % 2 else F.lit(part) for i, part in enumerate(parts)]
    return rows.withColumn("rendered", F.concat(*shown))


def dataset(rows: DataFrame, keys: list[str], template: str, order: list[str], between: str = "\n") -> DataFrame:
    """(keys, rendered): rows of each key rendered and joined in order."""
    entry = F.struct(*order, F.col("rendered").alias("__r"))
    grouped = render(rows, template).groupBy(*keys).agg(F.sort_array(F.collect_list(entry)).alias("parts"))
    return grouped.select(*keys, F.array_join(F.transform("parts", lambda p: p["__r"]), between).alias("rendered"))


def collect_markers(rows: DataFrame, kind: str, context: int = 10) -> DataFrame:
    """(keys, offset, id, text, left, right) of all markers of a type, in order."""
    found = rows.withColumn("m", F.explode(F.filter("markers", lambda m: m["type"] == kind)))
    at, n = F.col("m.offset"), F.coalesce("m.length", F.lit(0))
    keep = [c for c in rows.columns if c not in ("text", "markers")]
    return found.select(*keep, at.alias("offset"), F.col("m.id").alias("id"), fn.slice_text("text", at, n).alias("marked"), fn.left_context("text", at, context).alias("left"), fn.slice_text("text", at + n, F.lit(context)).alias("right"))


# -- edits: array<struct<start, delete, insert>> --------------------------------


def map_position(position: Column, edits: Column, right: bool) -> Column:
    """Where a position lies after edits, made one after the other.

    At an insertion a position stays left of it or moves right; inside a
    deletion it goes to its start, with the insertion to its right or left.
    """

    def step(at: Column, e: Column) -> Column:
        start, end, grown = e["start"], e["start"] + e["delete"], F.length(e["insert"])
        inside = start + (grown if right else F.lit(0))
        at_start = inside if right else start
        return F.when(at < start, at).when(at == start, F.when((e["delete"] == 0), at_start).otherwise(start if not right else F.when(e["delete"] > 0, start))).when(at < end, inside).otherwise(at + grown - e["delete"])

    return F.aggregate(edits, position.cast("int"), step)


def rebase(start: Column, length: Column, edits: Column) -> Column:
    """struct(start, length, conflict) of content after edits; an edit inside it is a conflict."""
    zero = F.struct(start.cast("int").alias("start"), length.cast("int").alias("length"), F.lit(False).alias("conflict"))

    def step(acc: Column, e: Column) -> Column:
        low, high = acc["start"], acc["start"] + acc["length"]
        e_low, e_high = e["start"], e["start"] + e["delete"]
        inserts_inside = (e["delete"] == 0) & (e_low > low) & (e_low < high)
        overlaps = (e["delete"] > 0) & (e_low < high) & (e_high > low)
        before = F.when(e["delete"] == 0, e_low <= low).otherwise(e_high <= low)
        shift = F.when(before, F.length(e["insert"]) - e["delete"]).otherwise(0)
        return F.struct((low + shift).alias("start"), acc["length"].alias("length"), (acc["conflict"] | inserts_inside | overlaps).alias("conflict"))

    return F.aggregate(edits, zero, step)


def replay(text: Column, edits: Column) -> Column:
    """A text after edits, one after the other."""
    return F.aggregate(edits, text, lambda t, e: F.concat(F.substring(t, F.lit(1), e["start"]), e["insert"], F.substring(t, e["start"] + e["delete"] + 1, F.length(t))))


def delete_spans(rows: DataFrame) -> DataFrame:
    """``rows`` (text, markers, spans array<struct<start, end>>) without the spans.

    Spans are merged first. Markers inside one vanish, one at its end stays, and
    the others move by what was deleted before them.
    """
    ordered = F.sort_array("spans")
    merged = F.aggregate(
        ordered,
        F.array().cast("array<struct<start:int,end:int>>"),
        lambda acc, s: F.when(
            (F.size(acc) > 0) & (F.element_at(acc, -1)["end"] >= s["start"]),
            F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["start"].alias("start"), F.greatest(F.element_at(acc, -1)["end"], s["end"]).cast("int").alias("end")))),
        ).otherwise(F.concat(acc, F.array(F.struct(s["start"].cast("int").alias("start"), s["end"].cast("int").alias("end"))))),
    )
    rows = rows.withColumn("__gone", F.when(F.size("spans") > 0, merged).otherwise(F.array().cast("array<struct<start:int,end:int>>")))
    starts = F.concat(F.array(F.lit(0)), F.transform("__gone", lambda s: s["end"]))
    stops = F.concat(F.transform("__gone", lambda s: s["start"]), F.array(F.length("text")))
    kept = F.array_join(F.transform(F.arrays_zip(starts.alias("a"), stops.alias("b")), lambda p: F.substring(F.col("text"), p["a"] + 1, F.greatest(p["b"] - p["a"], F.lit(0)))), "")
    outside = F.filter("markers", lambda m: ~F.exists("__gone", lambda s: (s["start"] <= m["offset"]) & (m["offset"] < s["end"])))
    before = lambda at: F.aggregate("__gone", F.lit(0), lambda acc, s: acc + F.when(s["end"] <= at, s["end"] - s["start"]).otherwise(0))
    return rows.withColumns({"text": kept, "markers": F.transform(outside, lambda m: m.withField("offset", m["offset"] - before(m["offset"])))}).drop("__gone")


def merge_sections(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Sections joined to one text per key: (keys, text, markers), offsets moved by what comes before."""
    by = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    moved = rows.withColumn("__shift", F.coalesce(F.sum(F.length("text")).over(by), F.lit(0)).cast("int"))
    moved = moved.withColumn("markers", F.transform("markers", lambda m: m.withField("offset", m["offset"] + F.col("__shift"))))
    parts = moved.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), "text", "markers"))).alias("parts"))
    return parts.select(*keys, F.array_join(F.transform("parts", lambda p: p["text"]), "").alias("text"), F.flatten(F.transform("parts", lambda p: p["markers"])).alias("markers"))


def split_at(rows: DataFrame, at: Column) -> DataFrame:
    """Each text as two: what is before a place and what is after, markers with their side."""
    side = lambda n, text, keep, shift: F.struct(F.lit(n).alias("part"), text.alias("text"), F.transform(F.filter("markers", keep), lambda m: m.withField("offset", m["offset"] - shift)).alias("markers"))
    both = F.array(side(0, F.substring(F.col("text"), F.lit(1), at), lambda m: m["offset"] < at, F.lit(0)), side(1, F.substring(F.col("text"), at + 1, F.length("text")), lambda m: m["offset"] >= at, at))
    keep = [c for c in rows.columns if c not in ("text", "markers")]
    return rows.withColumn("__p", F.explode(both)).select(*keep, "__p.part", "__p.text", "__p.markers")


def classified(rows: DataFrame, head: str, front: tuple[str, ...] = ("序", "目錄", "凡例"), back: tuple[str, ...] = ("跋", "後序")) -> DataFrame:
    """``rows`` with a bucket by words in their heading; one that is set already stays."""
    has = lambda words: F.coalesce(F.col(head).rlike("|".join(words)), F.lit(False))
    made = F.when(has(back), "back").when(has(front), "front").otherwise("body")
    return rows.withColumn("bucket", F.coalesce("bucket", made) if "bucket" in rows.columns else made)


def with_punctuation(rows: DataFrame, kinds: tuple[str, ...] = ("punctuation",)) -> DataFrame:
    """``rows`` with their punctuation markers woven back into the text."""
    marks = F.sort_array(F.transform(F.filter("markers", lambda m: m["type"].isin(*kinds)), lambda m: F.struct(m["offset"].alias("offset"), m["content"].alias("content"))))
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    woven = F.aggregate(marks, zero, lambda acc, m: F.struct(m["offset"].alias("at"), F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, m["offset"] - acc["at"]), m["content"]).alias("out")), lambda acc: F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, F.length("text"))))
    return rows.withColumn("punctuated", woven)


def assign_ids(markers: DataFrame, keys: list[str], prefix: Column, order: list[str]) -> DataFrame:
    """Blank marker ids filled by a counter for each key and type, after the greatest number in use."""
    number = F.regexp_extract("id", r"(\d+)$", 1).try_cast("int")
    top = F.coalesce(F.max(number).over(Window.partitionBy(*keys, "type")), F.lit(0))
    blank = F.coalesce(F.trim("id") == "", F.lit(True))
    rank = F.sum(F.when(blank, 1).otherwise(0)).over(Window.partitionBy(*keys, "type").orderBy(*order))
    return markers.withColumn("id", F.when(blank, F.concat(prefix, F.lit("-"), F.col("type"), F.lit("-"), (top + rank).cast("string"))).otherwise(F.col("id")))
