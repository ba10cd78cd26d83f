"""Curation: judgments on records, and the feed of contributions, as tables.

The stream keeps the same state record by record; these are its batch twins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import text as fn

SELF_STATES = ("rejected", "proposed")
COMMIT = "struct<kind:string,did:string,time_us:bigint,commit:struct<collection:string,rkey:string,operation:string,cid:string,record:string>>"


def uri(did: Column, collection: Column, rkey: Column) -> Column:
    return F.concat(F.lit("at://"), did, F.lit("/"), collection, F.lit("/"), rkey)


def commits(events: DataFrame, collections: list[str]) -> DataFrame:
    """Commit events of some collections as flat rows; incomplete ones are dropped."""
    rows = events.where("kind = 'commit'").select("did", "time_us", "commit.*").where(F.col("collection").isin(collections))
    whole = F.col("did").isNotNull() & F.col("rkey").isNotNull() & ((F.col("operation") == "delete") | F.col("record").isNotNull())
    return rows.where(whole).withColumn("uri", uri(F.col("did"), F.col("collection"), F.col("rkey")))


def from_listing(records: DataFrame) -> DataFrame:
    """Listed records in the shape of commits; their time is when they were made."""
    return records.withColumns({"time_us": fn.iso_micros(F.get_json_object("record", "$.createdAt")), "operation": F.lit("create")})


def judgment(rows: DataFrame) -> DataFrame:
    """Commits of judgments with their target, state and rating; a rating out of 0 to 2 is 0, no state no judgment."""
    get = lambda p: F.get_json_object("record", p)
    rating = F.coalesce(get("$.rating").try_cast("int"), F.lit(0))
    parsed = rows.withColumns(
        {"target": get("$.subject.uri"), "state": get("$.state"), "rating": F.when(rating.between(0, 2), rating).otherwise(0), "created": fn.iso_micros(get("$.createdAt"))}
    )
    return parsed.where("target is not null and state is not null")


def latest(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last row of each key; a deletion as the last removes the key."""
    everything = F.struct(*[F.col(c) for c in rows.columns])
    return rows.groupBy(key).agg(F.max_by(everything, F.struct(*order)).alias("r")).select("r.*").where("operation <> 'delete'")


def winners(judgments: DataFrame, editors: list[str] | None = None) -> DataFrame:
    """(target, state, rating): the latest state and, apart from it, the latest rating; ties go to the greater did.

    Only editors' judgments count, and an author's own where they withdraw or
    propose (another state of their own is void, the rating counts). ``judgments``
    has target, author, did, state, rating and created.
    """
    own = F.col("did") == F.col("author")
    state = F.when(own & ~F.col("state").isin(*SELF_STATES), None).otherwise(F.col("state"))
    counted = judgments if editors is None else judgments.where(F.col("did").isin(editors) | own)
    order = F.struct("created", "did")
    voided = counted.withColumn("state", state)
    found = voided.groupBy("target").agg(
        F.max_by("state", F.when(F.col("state").isNotNull(), order)).alias("state"), F.max_by("rating", F.when(F.col("rating").isNotNull(), order)).alias("rating")
    )
    return found.select("target", F.coalesce("state", F.lit("proposed")).alias("state"), F.coalesce("rating", F.lit(0)).alias("rating"))


def buffered(rows: DataFrame, size: int = 500) -> DataFrame:
    """The rows touched last; the size is the buffer's own."""
    return rows.orderBy(F.desc("touched"), F.desc("uri")).limit(size)


def snapshot(rows: DataFrame, limit: int) -> DataFrame:
    """The newest rows by time."""
    return rows.orderBy(F.desc("time_us"), F.desc("uri")).limit(limit)


def stamped(rows: DataFrame, judged: DataFrame) -> DataFrame:
    """Feed rows with their curation; what nobody judged is proposed."""
    joined = rows.join(judged.withColumnRenamed("target", "uri"), "uri", "left")
    return joined.withColumns({"state": F.coalesce("state", F.lit("proposed")), "rating": F.coalesce("rating", F.lit(0))})


def enriched(rows: DataFrame, titles: DataFrame, profiles: DataFrame) -> DataFrame:
    """Feed rows with the title of their text and the name of their author."""
    return rows.join(titles, "textid", "left").join(profiles, "did", "left")


def materialised(archive: DataFrame, rows: DataFrame) -> DataFrame:
    """``archive`` and the rows whose content it lacks."""
    new = rows.join(archive.select("cid").distinct(), "cid", "left_anti").dropDuplicates(["cid"])
    return archive.unionByName(new.select(archive.columns))


def touched(rows: DataFrame) -> DataFrame:
    """``rows`` with the order in which they were last touched."""
    return rows.withColumn("touched", F.max("time_us").over(Window.partitionBy("uri")))


def harvested(listing: DataFrame, markers: DataFrame, judgments: DataFrame, archive: DataFrame, editors: list[str] | None = None) -> DataFrame:
    """An archive brought up to date with listed annotations.

    Records (did, uri, cid, record) get their place from the marker they name
    and their curation from the judgments; what is rejected stays out, and rows
    with the same or a superseded content are replaced. ``archive`` has uri, cid,
    textid, seq, bucket, bucket_offset, state, rating and supersedes.
    """
    from lectern.operators.annotations import marker_positions, merged_by_content

    get = lambda p: F.get_json_object("record", p)
    rows = listing.select(
        "uri", "cid", get("$.anchor.marker_id").alias("marker_id"), get("$.anchor.offset").try_cast("int").alias("offset"), get("$.text_id").alias("textid"), get("$.supersedes").alias("supersedes")
    ).where("marker_id is not null and offset is not null")
    rows = rows.withColumn("seq", F.regexp_extract("marker_id", r"_(\d{3})-", 1).try_cast("int"))
    placed = stamped(marker_positions(rows, markers), winners(judgments, editors)).where("state <> 'rejected'")
    return merged_by_content(archive, placed.select(archive.columns))
