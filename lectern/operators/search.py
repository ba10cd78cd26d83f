"""Concordance search: literal, short, regular expression and proximity queries.

A *source* is a row of text: (bucket_id, textid, kind, text). Hits carry their
offset in it; postings are an index of trigrams that can be kept sorted by gram.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions import text as fn
from lectern.functions.udfs import near_offsets, regex_spans
from lectern.operators import intervals
from lectern.plans.parse import Query, check_scope, parse

KEYS = ["bucket_id", "textid", "kind"]


def hits_of(sources: DataFrame, query: str) -> DataFrame:
    """Every occurrence of a literal, also overlapping: the source's columns and master_offset."""
    found = sources.where(F.col("text").contains(query)).withColumn("master_offset", F.explode(fn.positions("text", query)))
    return found.withColumn("master_length", F.lit(len(query)))


def regex_hits(sources: DataFrame, query: Query) -> DataFrame:
    """Every match of an expression; its literal run, if it has one, narrows the scan first."""
    if query.anchor:
        sources = sources.where(F.col("text").contains(query.anchor))
    found = sources.withColumn("span", F.explode(regex_spans(query.pattern, query.flags)("text")))
    return found.withColumns({"master_offset": F.col("span.s"), "master_length": F.col("span.e") - F.col("span.s")}).drop("span")


def _context(text: Column, at: Column, length: Column, context: int) -> dict[str, Column]:
    return {"left": fn.left_context(text, at, context), "match": fn.slice_text(text, at, length), "right": fn.slice_text(text, at + length, F.lit(context))}


def kwic(hits: DataFrame, context: int = 20) -> DataFrame:
    """``hits`` with left, match and right in place of their text."""
    return hits.withColumns(_context(F.col("text"), F.col("master_offset"), F.col("master_length"), context)).drop("text")


def concordance(sources: DataFrame, offsets: Column, length: int, context: int = 20) -> DataFrame:
    """``kwic`` of hits of one length, given as arrays of offsets beside the texts.

    Contexts are cut where the text lies, before its hits become rows, so no
    row carries a text.
    """
    text = F.col("text")
    entry = lambda at: F.struct(at.alias("master_offset"), F.lit(length).alias("master_length"), *[c.alias(n) for n, c in _context(text, at, F.lit(length), context).items()])
    rest = [c for c in sources.columns if c != "text"]
    return sources.select(*rest, F.explode(F.transform(offsets, entry)).alias("__hit")).select(*rest, "__hit.*")


def _near(sources: DataFrame, left: str, right: str, distance: int, negate: bool) -> DataFrame:
    """Sources with the offsets (``__at``) of left hits with or without a right hit nearby."""
    held = sources.where(F.col("text").contains(left))
    if not negate:
        held = held.where(F.col("text").contains(right))
    close = near_offsets(len(left), len(right), distance, negate)
    return held.withColumn("__at", close(fn.positions("text", left), fn.positions("text", right)))


def near(sources: DataFrame, left: str, right: str, distance: int, negate: bool = False) -> DataFrame:
    """Left hits with (or without) a right hit in the same source within ``distance``, either way round.

    The gap of spans that touch or overlap is 0. Right hits are looked up in the
    source's own sorted offsets, so rows are neither joined nor shuffled.
    """
    found = _near(sources, left, right, distance, negate)
    return found.withColumn("master_offset", F.explode("__at")).drop("__at").withColumn("master_length", F.lit(len(left)))


def search(sources: DataFrame, text: str, context: int = 20, distance: int = 20, scope: list[str] | None = None) -> DataFrame:
    """Parse and run a query; ``scope`` limits it to some texts."""
    query = parse(text)
    check_scope(query, scope is not None)
    if scope is not None:
        sources = sources.where(F.col("textid").isin(scope))
    if query.mode == "regex":
        return kwic(regex_hits(sources, query), context)
    if query.mode in ("near", "not"):
        found = _near(sources, query.literal, query.right, distance, query.mode == "not")
        return concordance(found, F.col("__at"), len(query.literal), context).drop("__at")
    held = sources.where(F.col("text").contains(query.literal))
    return concordance(held, fn.positions("text", query.literal), len(query.literal), context)


def postings(sources: DataFrame, n: int = 3) -> DataFrame:
    """(gram, bucket_id, position) of every window of n characters."""
    return fn.exploded_grams(sources, n, ["bucket_id"]).select("gram", "bucket_id", "position")


def write_postings(sources: DataFrame, path: str, partitions: int) -> None:
    """A posting index in gram order, so that a lookup reads few files and row groups."""
    postings(sources).repartitionByRange(partitions, "gram").sortWithinPartitions("gram", "bucket_id", "position").write.parquet(path)


def intersect(index: DataFrame, query: str) -> DataFrame:
    """(bucket_id, start) where consecutive grams spell the query: an aggregation of shifted postings."""
    wanted = [query[i : i + 3] for i in range(len(query) - 2)]
    if not wanted:
        raise ValueError("a posting lookup takes three characters or more")
    shifts: dict[str, list[int]] = {}
    for i, gram in enumerate(wanted):
        shifts.setdefault(gram, []).append(i)
    table = F.create_map(*[x for gram, at in shifts.items() for x in (F.lit(gram), F.array(*[F.lit(i) for i in at]))])
    shifted = index.where(F.col("gram").isin(list(shifts))).select("bucket_id", "position", F.explode(table[F.col("gram")]).alias("i"))
    starts = shifted.groupBy("bucket_id", (F.col("position") - F.col("i")).alias("start")).agg(F.count(F.lit(1)).alias("n"))
    return starts.where((F.col("n") == len(wanted)) & (F.col("start") >= 0)).select("bucket_id", "start")


def by_postings(sources: DataFrame, query: str) -> DataFrame:
    """``intersect`` without an index at hand: postings of the query's own grams, from sources that have them all."""
    wanted = sorted({query[i : i + 3] for i in range(len(query) - 2)})
    for gram in wanted:
        sources = sources.where(F.col("text").contains(gram))
    places = F.array(*[F.struct(F.lit(gram).alias("gram"), fn.positions("text", gram).alias("at")) for gram in wanted])
    each = sources.select("bucket_id", F.explode(places).alias("g")).select("bucket_id", F.col("g.gram").alias("gram"), F.explode("g.at").alias("position"))
    return intersect(each, query)


def summary(hits: DataFrame) -> DataFrame:
    """Hits and sources by text: the overview of a query too large to list."""
    return hits.groupBy("textid").agg(F.count(F.lit(1)).alias("hits"), F.countDistinct("bucket_id").alias("sources"))


def extensions(hits: DataFrame, side: str, limit: int) -> DataFrame:
    """The most frequent one-character extensions of the query to a side, ties by gram."""
    text = F.col("text")
    if side == "left":
        chosen = hits.where("master_offset > 0").withColumn("gram", fn.slice_text(text, F.col("master_offset") - 1, F.col("master_length") + 1))
    else:
        chosen = hits.where(F.col("master_offset") + F.col("master_length") < F.length(text)).withColumn("gram", fn.slice_text(text, F.col("master_offset"), F.col("master_length") + 1))
    return chosen.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "gram").limit(limit)


def textids(hits: DataFrame) -> DataFrame:
    """Matching texts with their number of hits and their place in the list by -count, text."""
    return hits.groupBy("textid").agg(F.count(F.lit(1)).alias("n"))


def order_keys(sort: str) -> list[Column]:
    """Sort columns of a hit list; the natural order parts ties."""
    natural = [F.col("textid"), F.col("bucket_id"), F.col("master_offset")]
    if sort == "textid":
        return natural
    if sort == "match":
        return [F.concat("match", "right"), *natural]
    if sort == "reverse_prematch":
        return [F.reverse("left"), F.col("match"), *natural]
    if sort == "date":
        return [F.col("index_date").asc_nulls_last(), *natural]
    raise ValueError(f"no such sort: {sort}")


def _chain(contexts: list[str], drop: set[str]) -> list[int]:
    """The order of a chain of hits by shared context characters.

    Each character has the hits that it occurs around as one row of a matrix of
    bytes; what a hit shares with all others is the sum of its characters' rows,
    made when the hit is reached. The first is the one that shares most with all
    others; of equals the earlier counts.
    """
    sets = [sorted(set(context) - drop) for context in contexts]
    number = {c: i for i, c in enumerate(sorted({c for own in sets for c in own}))}
    around = np.zeros((len(number), len(sets)), dtype=np.uint8)
    for hit, own in enumerate(sets):
        around[[number[c] for c in own], hit] = 1
    frequent = around.sum(axis=1, dtype=np.int64)
    totals = np.array([int(frequent[[number[c] for c in own]].sum()) - len(own) for own in sets])
    scale = int(totals.max(initial=0)) + 1
    rank, order = totals.copy(), []
    taken = np.zeros(len(sets), dtype=bool)
    for _ in sets:
        hit = int(np.where(taken, -1, rank).argmax())
        taken[hit] = True
        order.append(hit)
        rank = around[[number[c] for c in sets[hit]]].sum(axis=0, dtype=np.int64) * scale + totals
    return order


def closeness(hits: DataFrame, query: str, cap: int = 20_000) -> DataFrame:
    """``hits`` with their place in a chain of most shared context characters.

    The chain is one sequence by definition: each hit is followed by the unseen
    hit that shares most characters with it. It is defined for a list of at most
    ``cap`` hits, what one page of results may hold; more are refused.
    """
    if hits.limit(cap + 1).count() > cap:
        raise ValueError(f"more than {cap} hits: narrow the query, or sort by another order")
    columns = hits.columns
    schema = hits.withColumn("position", F.lit(0).cast("long")).schema
    drop = set(query)

    def chain(frame):
        frame = frame[columns].sort_values(["textid", "bucket_id", "master_offset"]).reset_index(drop=True)
        frame = frame.iloc[_chain([a + b for a, b in zip(frame["left"], frame["right"], strict=True)], drop)].reset_index(drop=True)
        frame["position"] = range(1, len(frame) + 1)
        return frame

    return hits.withColumn("__all", F.lit(0)).groupBy("__all").applyInPandas(chain, schema)


def matches_section(section: Column, wanted: list[str], descendants: bool = True) -> Column:
    """A section in a set of categories, by prefix or exactly; no set passes all, no section fails."""
    if not wanted:
        return F.lit(True)
    test = F.lit(False)
    for code in wanted:
        test = test | (section.startswith(code) if descendants else section == code)
    return F.coalesce(test, F.lit(False))


def filtered(hits: DataFrame, include: dict[str, list] | None = None, exclude: dict[str, list] | None = None, after: int | None = None, before: int | None = None) -> DataFrame:
    """Hits by values of their columns, in and not in; date bounds are strict, and no date fails them."""
    test = F.lit(True)
    for column, values in (include or {}).items():
        test = test & F.coalesce(F.col(column).isin(values), F.lit(False))
    for column, values in (exclude or {}).items():
        test = test & F.coalesce(~F.col(column).isin(values), F.lit(True))
    if after is not None:
        test = test & F.coalesce(F.col("index_date") > after, F.lit(False))
    if before is not None:
        test = test & F.coalesce(F.col("index_date") < before, F.lit(False))
    return hits.where(test)


def by_voice(hits: DataFrame, names: list[str]) -> DataFrame:
    """Hits that some range of these names contains."""
    return hits.where(F.arrays_overlap("voice_stack", F.array(*[F.lit(n) for n in names])))


def overlays(hits: DataFrame, variants: DataFrame, context: int) -> DataFrame:
    """Variant readings that fall into a hit's window, in order."""
    windows = hits.withColumns({"lo": F.greatest(F.col("master_offset") - context, F.lit(0)), "hi": F.col("master_offset") + F.col("master_length") + context})
    found = variants.withColumns({"i_start": F.col("offset"), "i_end": F.col("offset") + F.col("length")})
    entry = F.struct("i.offset", "i.witness", "i.length", "i.content", "i.form")
    return intervals.overlapping(windows, found, ["bucket_id"]).groupBy("w.bucket_id", "w.master_offset").agg(F.sort_array(F.collect_list(entry)).alias("overlays"))


DIMENSIONS = ("textid", "category", "witness", "voice", "left_char", "right_char", "left_bigram", "right_bigram", "around")


def neighbours(hits: DataFrame) -> DataFrame:
    """``hits`` with the five context features."""
    return hits.withColumns(
        {"left_char": fn.left_char("left"), "right_char": fn.right_char("right"), "left_bigram": fn.left_bigram("left"), "right_bigram": fn.right_bigram("right"), "around": fn.around("left", "right")}
    )


def facets(hits: DataFrame, dimensions: list[str], skip: dict[str, str] | None = None) -> DataFrame:
    """(dim, value, n) for all dimensions in one aggregation; empty values and ``skip`` are left out."""
    pairs = F.array(*[F.struct(F.lit(d).alias("dim"), F.col(d).cast("string").alias("value")) for d in dimensions])
    rows = hits.select(F.explode(pairs).alias("f")).select("f.dim", "f.value").where("value is not null and value <> ''")
    for dim, value in (skip or {}).items():
        rows = rows.where(~((F.col("dim") == dim) & (F.col("value") == value)))
    return rows.groupBy("dim", "value").agg(F.count(F.lit(1)).alias("n"))


def ranked_facets(counts: DataFrame, forced: DataFrame, limit: int) -> DataFrame:
    """Facet lists: chosen values first, also those without hits, then by count and value.

    ``forced`` has (dim, value, selected, excluded).
    """
    from pyspark.sql import Window

    joined = counts.join(forced, ["dim", "value"], "full").select(
        "dim", "value", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("selected", F.lit(False)).alias("selected"), F.coalesce("excluded", F.lit(False)).alias("excluded")
    )
    chosen = F.col("selected") | F.col("excluded")
    kind = F.when(chosen & (F.col("n") == 0), 0).when(chosen, 1).otherwise(2)
    rank = F.row_number().over(Window.partitionBy("dim").orderBy(kind, F.desc("n"), "value"))
    return joined.withColumn("rank", rank.cast("long")).where(F.col("rank") <= limit)


def recipe(hits: DataFrame) -> DataFrame:
    """Each hit as a pin: what to slice to see it again."""
    selection = F.struct(F.col("bucket_id").alias("bucket"), F.col("master_offset").alias("offset"), F.col("master_length").alias("length"))
    return hits.select(F.struct(F.col("textid").alias("id"), F.lit("match").alias("role"), selection.alias("selection")).alias("pin"))
