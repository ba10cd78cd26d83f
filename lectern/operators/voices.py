"""Voices: named ranges derived from parentheses, indentation and dictionary entries."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.operators import intervals

DERIVED = "bucket_id long, start int, end int, name string, id string, problem string"


def from_parens(marks: DataFrame) -> DataFrame:
    """Note ranges between opening and closing marks, and coded problems.

    ``marks`` has bucket_id, offset, ord, sign ("(" or ")") and text_length.
    Marks outside the text are ignored. An opening inside a note is ``nested``
    (and ignored), a closing without one ``stray``, one left open ``unmatched``.
    Notes that touch are one.
    """
    inside = marks.where((F.col("offset") >= 0) & (F.col("offset") <= F.col("text_length")))
    by = Window.partitionBy("bucket_id").orderBy("offset", "ord")
    # Openings inside a note do nothing, so what is open before a mark is whether the last mark was an opening.
    before = F.lag("sign").over(by)
    tagged = inside.withColumn("kind", F.when((F.col("sign") == "(") & F.coalesce(before == "(", F.lit(False)), "nested").when((F.col("sign") == ")") & F.coalesce(before != "(", F.lit(True)), "stray").otherwise(F.col("sign")))
    kept = tagged.where(F.col("kind").isin("(", ")"))
    pair = kept.withColumns({"close": F.lead("offset").over(by), "close_sign": F.lead("kind").over(by)}).where("kind = '('")
    notes = pair.where("close_sign = ')'").select("bucket_id", F.col("offset").alias("start"), F.col("close").alias("end"))
    merged = intervals.merged(notes, ["bucket_id"])
    ids = F.concat(F.lit("n"), F.row_number().over(Window.partitionBy("bucket_id").orderBy("start")).cast("string"))
    ranges = merged.select("bucket_id", "start", "end", F.lit("note").alias("name"), ids.alias("id"), F.lit(None).cast("string").alias("problem"))
    bad = tagged.where(F.col("kind").isin("nested", "stray")).select("bucket_id", F.col("offset").alias("start"), F.col("offset").alias("end"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("id"), F.col("kind").alias("problem"))
    left_open = pair.where("close_sign is null or close_sign <> ')'").select("bucket_id", F.col("offset").alias("start"), F.col("offset").alias("end"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("id"), F.lit("unmatched").alias("problem"))
    return ranges.unionByName(bad).unionByName(left_open)


def depth_problems(marks: DataFrame) -> DataFrame:
    """Marks where parentheses nest deeper than one or close what is not open, by running depth."""
    step = F.when(F.col("sign") == "(", 1).otherwise(-1)
    depth = intervals.depth(marks, ["bucket_id"], ["offset", "ord"], step)
    return depth.withColumn("problem", F.when(F.col("depth") > 1, "nested").when(F.col("depth") < 0, "stray")).where("problem is not null")


def from_indent(lines: DataFrame, names: dict[int, str], low: int = 2, tolerance: int = 4) -> DataFrame:
    """Ranges of lines with the same voice by indentation, with ids and what they respond to.

    ``lines`` has bucket_id, line, start, end, depth and listing (in a table of
    contents, strictly). Clusters of listed lines, plain ones up to
    ``tolerance`` between them, are no voices. Commentary responds to the last
    range before it that is none.
    """
    voice = F.coalesce(F.create_map(*[x for d, n in names.items() for x in (F.lit(d), F.lit(n))])[F.col("depth")], F.lit("root"))
    listed = intervals.clustered(lines.where("listing"), ["bucket_id"], "line", tolerance).groupBy("bucket_id", "cluster").agg(F.min("line").alias("lo"), F.max("line").alias("hi"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= low)
    plain = lines.alias("l").join(listed.alias("t"), [F.col("l.bucket_id") == F.col("t.bucket_id"), F.col("l.line").between(F.col("t.lo"), F.col("t.hi"))], "left_anti")
    runs = intervals.runs(plain.withColumn("name", voice), ["bucket_id"], "line", "name")
    joined = runs.alias("r").join(lines.alias("l"), [F.col("r.bucket_id") == F.col("l.bucket_id"), F.col("l.line").between(F.col("r.first"), F.col("r.last"))])
    ranges = joined.groupBy(F.col("r.bucket_id").alias("bucket_id"), F.col("r.first").alias("line"), F.col("r.name").alias("name")).agg(F.min("l.start").alias("start"), F.max("l.end").alias("end"))
    numbered = intervals.counter(ranges, ["bucket_id"], F.left("name", F.lit(1)), ["start"])
    answered = intervals.carried(numbered, ["bucket_id"], "start", F.when(F.col("name") != "commentary", F.col("id")), "__last")
    return answered.withColumn("responds_to", F.when(F.col("name") == "commentary", F.col("__last"))).drop("__last")


def from_dictionary(rows: DataFrame, cues: tuple[str, ...] = ("曰", "云", "注"), longest: int = 4) -> DataFrame:
    """Lemma, source and gloss ranges of dictionary entries.

    ``rows`` has bucket_id, text and heads (array of entry starts). An entry's
    lemma runs to its first cue or, without one near, its first character; text
    after the cue is the gloss. One text is read at a time.
    """

    def derive(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for bucket_id, text, heads in zip(frame["bucket_id"], frame["text"], frame["heads"], strict=True):
                starts = sorted(h for h in heads if 0 <= h < len(text))
                for n, (start, end) in enumerate(zip(starts, [*starts[1:], len(text)], strict=True), 1):
                    near = [i for i in range(start + 1, min(end, start + longest + 1)) if text[i] in cues]
                    lemma_end = near[0] if near else start + 1
                    out.append((bucket_id, start, lemma_end, "lemma", f"l{n}", None))
                    if lemma_end < end:
                        out.append((bucket_id, lemma_end, end, "gloss", f"g{n}", None if near else "no cue"))
            if out:
                yield pd.DataFrame(out, columns=["bucket_id", "start", "end", "name", "id", "problem"])

    return rows.select(F.col("bucket_id").cast("long"), "text", "heads").mapInPandas(derive, DERIVED)


def replaced(existing: DataFrame, derived: DataFrame, source: str) -> DataFrame:
    """``existing`` with the ranges of one derivation replaced, those by hand kept."""
    return existing.where(F.col("source") != source).unionByName(derived.withColumn("source", F.lit(source)).select(existing.columns))


def overlaps(ranges: DataFrame) -> DataFrame:
    """(bucket_id, name, start, end, next_start): ranges of one name that run into the next."""
    by = Window.partitionBy("bucket_id", "name").orderBy("start", "end")
    return ranges.withColumn("next_start", F.lead("start").over(by)).where("next_start < end").select("bucket_id", "name", "start", "end", "next_start")


def problems(ranges: DataFrame, lengths: DataFrame) -> DataFrame:
    """(bucket_id, id, rule) of ranges that an index refuses.

    Out of the text, without a name or id, overlapping their own kind, or
    answering what does not exist. ``lengths`` (bucket_id, chars).
    """
    joined = ranges.join(lengths, "bucket_id", "left")
    bounds = joined.where((F.col("start") < 0) | (F.col("end") < F.col("start")) | (F.col("end") > F.coalesce("chars", F.lit(-1)))).select("bucket_id", "id", F.lit("bounds").alias("rule"))
    blank = ranges.where("name is null or trim(name) = '' or id is null or trim(id) = ''").select("bucket_id", "id", F.lit("name").alias("rule"))
    crossing = overlaps(ranges).join(ranges, ["bucket_id", "name", "start", "end"]).select("bucket_id", "id", F.lit("overlap").alias("rule"))
    known = ranges.select("bucket_id", F.col("id").alias("responds_to")).distinct()
    dangling = ranges.where("responds_to is not null").join(known, ["bucket_id", "responds_to"], "left_anti").select("bucket_id", "id", F.lit("dangling").alias("rule"))
    return bounds.unionByName(blank).unionByName(crossing).unionByName(dangling).distinct()


def numbered(found: DataFrame, order: list[str | Column]) -> DataFrame:
    """A report's rows with ids from 1 in a fixed order."""
    from lectern.operators.order import numbered as place

    return place(found, *order, name="report_id")
