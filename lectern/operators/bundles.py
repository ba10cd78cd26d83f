"""Bundles as a whole: contents, sections, editions, moves, witnesses by alignment, parallel pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import text as fn
from lectern.functions.udfs import opcodes
from lectern.operators import intervals

ORDER = {"front": 0, "body": 1, "back": 2}


def bucket_order(bucket: str = "bucket") -> Column:
    return F.create_map(*[F.lit(x) for pair in ORDER.items() for x in pair])[F.col(bucket)]


def assets_of(manifests: DataFrame, found: DataFrame) -> DataFrame:
    """(textid, seq, content): each marker asset a manifest names, with its file beside the manifest."""
    named = manifests.select("textid", F.regexp_replace("path", "[^/]+$", "").alias("folder"), F.explode("marker_assets").alias("a"))
    wanted = named.select("textid", F.col("a.seq").alias("seq"), F.concat("folder", "a.filename").alias("path"))
    return wanted.join(found.select("path", "content"), "path").drop("path")


def contents(buckets: DataFrame, head: str = "head") -> DataFrame:
    """(textid, juan_seq, bucket, marker_id, label, span_start, span_end): contents made anew from heading markers."""
    keys = ["textid", "juan_seq", "bucket"]
    heads = buckets.select(*keys, F.length("text").alias("__n"), F.posexplode(F.filter("markers", lambda m: m["type"] == head)).alias("place", "m"))
    after = F.lead("m.offset").over(Window.partitionBy(*keys).orderBy("m.offset", "place"))
    return heads.select(*keys, F.col("m.id").alias("marker_id"), F.coalesce("m.content", F.lit("")).alias("label"), F.col("m.offset").alias("span_start"), F.coalesce(after, F.col("__n")).alias("span_end"))


def sections(buckets: DataFrame, toc: DataFrame) -> DataFrame:
    """Texts cut at their contents: (textid, juan_seq, bucket, label, text, markers), offsets from each section's start.

    A bucket without contents is one section.
    """
    keys = ["textid", "juan_seq", "bucket"]
    joined = buckets.join(toc.select(*keys, "label", "span_start", "span_end"), keys, "left")
    start, end = F.coalesce("span_start", F.lit(0)), F.coalesce("span_end", F.length("text"))
    inside = F.filter("markers", lambda m: (m["offset"] >= start) & (m["offset"] < end))
    return joined.select(*keys, F.coalesce("label", F.lit("")).alias("label"), start.alias("start"), fn.slice_text("text", start, end - start).alias("text"), F.transform(inside, lambda m: m.withField("offset", m["offset"] - start)).alias("markers"))


def editions(master: DataFrame, others: dict[str, DataFrame]) -> DataFrame:
    """Rows of all editions with their name; the master's is blank."""
    whole = master.withColumn("edition", F.lit(""))
    for name, rows in others.items():
        whole = whole.unionByName(rows.withColumn("edition", F.lit(name)))
    return whole


def added_editions(existing: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Existing editions as they are, and the incoming ones that are new."""
    return existing.unionByName(incoming.join(existing.select(*keys).distinct(), keys, "left_anti").dropDuplicates(keys).select(existing.columns))


def with_identifiers(manifests: DataFrame, alternatives: DataFrame) -> DataFrame:
    """Manifests (textid, identifiers) with alternative ones (textid, kind, value) joined in, without repeats."""
    added = alternatives.groupBy("textid", "kind").agg(F.array_sort(F.collect_set("value")).alias("values")).groupBy("textid").agg(F.map_from_entries(F.collect_list(F.struct("kind", "values"))).alias("__more"))
    joined = manifests.join(added, "textid", "left")
    empty = F.create_map().cast("map<string,array<string>>")
    both = F.map_zip_with(F.coalesce("identifiers", empty), F.coalesce("__more", empty), lambda k, a, b: F.array_union(F.coalesce(a, F.array().cast("array<string>")), F.coalesce(b, F.array().cast("array<string>"))))
    return joined.withColumn("identifiers", both).drop("__more")


def front_to_empty_body(buckets: DataFrame) -> DataFrame:
    """Scrolls whose body is empty get their front as the body; the body's markers move behind it."""
    keys = ["textid", "juan_seq"]
    front = buckets.where("bucket = 'front'").select(*keys, F.col("text").alias("__t"), F.col("markers").alias("__m"))
    body = buckets.where("bucket = 'body'").join(front, keys, "left")
    moves = (F.col("text") == "") & (F.coalesce("__t", F.lit("")) != "")
    later = F.transform("markers", lambda m: m.withField("offset", m["offset"] + F.length("__t")))
    moved = body.withColumns({"markers": F.when(moves, F.concat("__m", later)).otherwise(F.col("markers")), "text": F.when(moves, F.col("__t")).otherwise(F.col("text")), "__moved": moves}).drop("__t", "__m")
    gone = moved.where("__moved").select(*keys).withColumn("bucket", F.lit("front"))
    return buckets.where("bucket <> 'body'").join(gone, [*keys, "bucket"], "left_anti").unionByName(moved.drop("__moved").select(buckets.columns))


def moved_section(rows: DataFrame, start: int, end: int) -> DataFrame:
    """``rows`` (text, markers) as what stays and what moves to another bucket: (part, text, markers).

    Markers in the span go with it, those behind it close up.
    """
    inside = lambda m: (m["offset"] >= start) & (m["offset"] < end)
    stays = F.struct(F.lit("stays").alias("part"), F.concat(F.substring("text", 1, start), F.substring(F.col("text"), F.lit(end + 1), F.length("text"))).alias("text"), F.transform(F.filter("markers", lambda m: ~inside(m)), lambda m: m.withField("offset", F.when(m["offset"] >= end, m["offset"] - (end - start)).otherwise(m["offset"]))).alias("markers"))
    goes = F.struct(F.lit("moves").alias("part"), F.substring("text", start + 1, end - start).alias("text"), F.transform(F.filter("markers", inside), lambda m: m.withField("offset", m["offset"] - start)).alias("markers"))
    keep = [c for c in rows.columns if c not in ("text", "markers")]
    return rows.withColumn("__p", F.explode(F.array(stays, goes))).select(*keep, "__p.*")


def aligned_variants(rows: DataFrame, key: str) -> DataFrame:
    """(key, offset, length, content, form): where a witness text differs from its master.

    ``rows`` has master and witness. Replacements of equal length are one row
    for each character, so that every variation can be found by itself.
    """
    blocks = rows.withColumn("b", F.explode(opcodes("master", "witness"))).where("b.tag <> 'equal'")
    n, m = F.col("b.a_end") - F.col("b.a_start"), F.col("b.b_end") - F.col("b.b_start")
    each = F.when((F.col("b.tag") == "replace") & (n == m), F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct((F.col("b.a_start") + i).alias("a"), F.lit(1).alias("n"), (F.col("b.b_start") + i).alias("b"), F.lit(1).alias("m")))).otherwise(
        F.array(F.struct(F.col("b.a_start").alias("a"), n.alias("n"), F.col("b.b_start").alias("b"), m.alias("m")))
    )
    parts = blocks.withColumn("p", F.explode(each))
    return parts.select(key, F.col("p.a").alias("offset"), F.col("p.n").alias("length"), fn.slice_text("master", F.col("p.a"), F.col("p.n")).alias("content"), fn.slice_text("witness", F.col("p.b"), F.col("p.m")).alias("form"))


def mapped_offsets(rows: DataFrame, offsets: str) -> DataFrame:
    """``rows`` (master, witness, an array of witness offsets) with the offsets in the master.

    Exact where the texts agree, else the start of the differing block; beyond
    the witness, the master's end.
    """
    blocks = rows.withColumn("__b", opcodes("master", "witness"))
    of = lambda j: F.get(F.filter("__b", lambda b: (b["b_start"] <= j) & (j < b["b_end"])), F.lit(0))
    place = lambda j: F.when(of(j).isNull(), F.length("master")).when(of(j)["tag"] == "equal", of(j)["a_start"] + (j - of(j)["b_start"])).otherwise(of(j)["a_start"])
    return blocks.withColumn("mapped", F.transform(offsets, place)).drop("__b")


def marker_parts(marker_id: Column | str = "marker_id") -> Column:
    """struct(edition, seq) of a marker id ``text_edition_001-rest``; null when it is none."""
    pattern = r"_([^_]+)_(\d{3})-"
    marker_id = F.col(marker_id) if isinstance(marker_id, str) else marker_id
    return F.when(marker_id.rlike(pattern), F.struct(F.regexp_extract(marker_id, pattern, 1).alias("edition"), F.regexp_extract(marker_id, pattern, 2).cast("int").alias("seq")))


def repaired_attestations(rows: DataFrame, edits: Column) -> DataFrame:
    """Attestations (offset, length) after an edit of their text, with a conflict where it changed what they name."""
    from lectern.operators.slices import rebase

    return rows.withColumn("__r", rebase(F.col("offset"), F.col("length"), edits)).withColumns({"offset": F.col("__r.start"), "conflict": F.col("__r.conflict")}).drop("__r")


def parallels_page(rows: DataFrame, bucket: str | None = None, span: tuple[int, int] | None = None, lengths: tuple[int | None, int | None] = (None, None), remote: str | None = None) -> tuple[DataFrame, DataFrame]:
    """A scroll's parallels and the lengths there are to choose from.

    ``rows`` has bucket, start, end, remote_textid, remote_start and remote_end.
    The bounds of lengths are taken before the length filter; gaps on both sides
    are to the row before of the same remote text.
    """
    if bucket is not None:
        rows = rows.where(F.col("bucket") == bucket)
    if span is not None:
        rows = rows.where((F.col("start") < span[1]) & (F.col("end") > span[0]))
    rows = rows.withColumn("length", F.col("end") - F.col("start"))
    bounds = rows.agg(F.min("length").alias("min_length"), F.max("length").alias("max_length"))
    low, high = lengths
    if low is not None:
        rows = rows.where(F.col("length") >= low)
    if high is not None:
        rows = rows.where(F.col("length") <= high)
    if remote is not None:
        rows = rows.where(F.col("remote_textid") == remote)
    by = Window.partitionBy("remote_textid").orderBy("start", "end", "remote_start")
    gap = lambda a, b: F.when(F.lag(b).over(by).isNotNull(), F.greatest(F.col(a) - F.lag(b).over(by), F.lit(0)))
    weight = F.sum("length").over(Window.partitionBy("remote_textid"))
    return rows.withColumns({"local_gap": gap("start", "end"), "remote_gap": gap("remote_start", "remote_end"), "overlap_length": weight}), bounds


def remote_options(rows: DataFrame) -> DataFrame:
    """(remote_textid, n, overlap_length) of a scroll's parallels."""
    return rows.groupBy("remote_textid").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("end") - F.col("start")).alias("overlap_length"))


def detail(rows: DataFrame, texts: DataFrame, window: int = 250) -> DataFrame:
    """Duplicated pairs with what stands before and after the longest span of each side."""
    for side in "ab":
        own = texts.select(F.col("bucket_id").alias(f"bucket_{side}"), F.col("text").alias("__t"))
        start = F.col(f"longest_{side}")
        end = start + F.col("longest_span")
        rows = rows.join(own, f"bucket_{side}").withColumns({f"head_{side}": fn.left_context("__t", start, window), f"span_{side}": fn.slice_text("__t", start, F.col("longest_span")), f"tail_{side}": fn.slice_text("__t", end, F.lit(window))}).drop("__t")
    return rows


def rebased_links(links: DataFrame, edits: DataFrame) -> DataFrame:
    """Parallel links (textid, offset, length) after edits of their texts; links into edited places are dropped.

    ``edits`` has textid and splices.
    """
    from lectern.operators.slices import rebase

    joined = links.join(edits, "textid", "left")
    moved = joined.withColumn("__r", F.when(F.col("splices").isNotNull(), rebase(F.col("offset"), F.col("length"), F.col("splices"))))
    kept = moved.where("__r is null or not __r.conflict")
    return kept.withColumn("offset", F.coalesce("__r.start", "offset")).drop("__r", "splices")


def reusable(meta: DataFrame, wanted: dict[str, str]) -> bool:
    """Whether a stored table was made with exactly these parameters."""
    have = {r["key"]: r["value"] for r in meta.select("key", "value").limit(1000).collect()}
    return have == wanted


def covered(found: DataFrame) -> DataFrame:
    """(bucket_id, chars): characters of each source inside any passage."""
    return intervals.merged(found.select("bucket_id", "start", "end"), ["bucket_id"]).groupBy("bucket_id").agg(F.sum(F.col("end") - F.col("start")).alias("chars"))


def corpus_info(bundles: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """(dim, value, n): bundles by section, and the rows of each table of an index."""
    found = bundles.groupBy(F.lit("section").alias("dim"), F.coalesce(fn.section_code("textid"), F.lit("other")).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    for name, rows in tables.items():
        found = found.unionByName(rows.agg(F.count(F.lit(1)).alias("n")).select(F.lit("table").alias("dim"), F.lit(name).alias("value"), "n"))
    return found


def bundle_counts(bundles: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """The texts of ``bundles`` (textid), each once, with the number of rows that each table (textid) has of them."""
    bundles = bundles.select("textid").distinct()
    for name, rows in tables.items():
        counts = rows.groupBy("textid").agg(F.count(F.lit(1)).alias(name))
        bundles = bundles.join(counts, "textid", "left").na.fill(0, [name])
    return bundles


def split_front(rows: DataFrame, kinds: tuple[str, ...] = ("indent",), head: str = "head") -> DataFrame:
    """Sections as front (part 0) and body (part 1): the body opens at the first indented line or second-level heading.

    Headings have their level in ``extras``; a section without either is all
    front. ``rows`` has text and markers.
    """
    from lectern.operators.slices import split_at

    opens = F.filter("markers", lambda m: m["type"].isin(*kinds) | ((m["type"] == head) & (m["extras"]["level"] == "2")))
    at = F.coalesce(F.array_min(F.transform(opens, lambda m: m["offset"])), F.length("text"))
    return split_at(rows.withColumn("__at", at), F.col("__at")).drop("__at")
