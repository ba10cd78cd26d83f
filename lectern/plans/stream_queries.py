"""Streams over the driver's events, run to their end, and markup over its pages."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators import chars
from lectern.plans.text_queries import FEED, _feed
from lectern.sources import readers
from lectern.storage import shared_dir, table
from lectern.streaming.feed import FeedTable, run_feed


def feed_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feed as a stream of all events, merged by micro-batches into its table."""
    events = table(spark, sf_dir, "events")
    stream = spark.readStream.schema(events.schema).parquet(f"{sf_dir}/events.parquet*")
    operation = F.when(F.col("event_type") == "error", "delete").when(F.col("event_type") == "signup", "create").otherwise("update")
    micros = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts)")
    rows = stream.select(F.concat(F.lit("at://"), F.col("user_id").cast("string")).alias("uri"), operation.alias("operation"), micros.alias("time_us"), F.col("event_id").alias("order"), "value")
    place = f"{shared_dir(spark)}/lectern-feed-{uuid.uuid4().hex}"
    feed = FeedTable(spark, f"{place}/table")
    run_feed(rows, feed, f"{place}/checkpoint")
    return feed.read(_feed(spark, sf_dir).select("uri", "operation", "time_us", F.col("event_id").alias("order"), "value").schema).withColumnRenamed("order", "event_id")


def page_text_survey(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters of the pages' texts, without their markup."""
    pages = readers.plain_text(table(spark, sf_dir, "pages"), "html")
    return chars.survey(pages.select("page_id", "text")).select("char", "n")


QUERIES = {f.__name__: f for f in (feed_stream, page_text_survey)}
ORACLE = {"feed_stream": "with " + FEED + ", l as (select * from (select *, row_number() over (partition by uri order by time_us desc, event_id desc) as rn from f) where rn = 1 and operation <> 'delete') select uri, operation, time_us, event_id, value from l"}
