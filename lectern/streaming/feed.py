"""The live feed: commits as a stream, records by uri, judgments by target.

The feed table is kept by micro-batches: each one merges its last record of
every uri into a new version of the table, so a batch that is run again changes
nothing. Judgments are keyed state; a change of a target's winner is an event.
There is no watermark: a judgment counts whenever it comes.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lectern.operators import curation
from lectern.sources import schemas


def commits(spark: SparkSession, path: str, collections: list[str]) -> DataFrame:
    """A stream of commit events from JSON files."""
    return curation.commits(spark.readStream.schema(schemas.EVENT).json(path), collections)


class FeedTable:
    """Versions of the feed below a folder; the newest one is the feed."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        return root, root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        root, fs = self._fs()
        if not fs.exists(root):
            return []
        jvm_path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        names = [s.getPath().getName() for s in fs.listStatus(root)]
        return sorted(int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit() and fs.exists(jvm_path(f"{self.path}/{n}/_SUCCESS")))

    def read(self, schema) -> DataFrame:
        found = self.versions()
        return self.spark.read.schema(schema).parquet(f"{self.path}/v{found[-1]}") if found else self.spark.createDataFrame([], schema)

    def merge(self, batch: DataFrame, epoch: int) -> None:
        """The feed with a batch's records upserted and deleted; ``batch`` has uri, operation, time_us and order.

        A version is written anew if its epoch is run again, from the version
        before it.
        """
        before = [v for v in self.versions() if v < epoch]
        old = self.spark.read.schema(batch.schema).parquet(f"{self.path}/v{before[-1]}") if before else self.spark.createDataFrame([], batch.schema)
        everything = F.struct(*[F.col(c) for c in batch.columns])
        last = batch.groupBy("uri").agg(F.max_by(everything, F.struct("time_us", "order")).alias("r")).select("r.*")
        kept = old.join(last.select("uri"), "uri", "left_anti").unionByName(last.where("operation <> 'delete'"))
        kept.write.mode("overwrite").parquet(f"{self.path}/v{epoch}")
        for version in before[:-1]:  # the one before stays for readers
            jvm_path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
            self._fs()[1].delete(jvm_path(f"{self.path}/v{version}"), True)


def run_feed(stream: DataFrame, table: FeedTable, checkpoint: str) -> None:
    """Bring a feed table up to date with all that a stream has, then stop."""
    stream.writeStream.foreachBatch(lambda batch, epoch: table.merge(batch, epoch + 1)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


WINNER = "target string, state string, rating int, judgments int"
STATE = "rows array<struct<key:string,did:string,state:string,rating:int,created:bigint,own:boolean>>"


def winner(rows: list[tuple], editors: list[str] | None) -> tuple[str, int]:
    """State and rating of a target's judgments (key, did, state, rating, created, own)."""
    counted = [r for r in rows if editors is None or r[1] in editors or r[5]]
    states = [(r[4], r[1], r[2]) for r in counted if r[2] is not None and (not r[5] or r[2] in curation.SELF_STATES)]
    ratings = [(r[4], r[1], r[3]) for r in counted if r[3] is not None]
    return max(states)[2] if states else "proposed", max(ratings)[2] if ratings else 0


def curated(judgments: DataFrame, editors: list[str] | None = None) -> DataFrame:
    """A stream of changes of targets' winners.

    ``judgments`` has target, key (did and rkey), did, author, operation, state,
    rating and created. A deletion takes its judgment back, and the next latest
    counts again.
    """

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = {row[0]: tuple(row) for row in (state.get[0] if state.exists else [])}
        before = winner(list(held.values()), editors) if held else None
        for frame in frames:
            for row in frame.sort_values(["created", "key"]).itertuples(index=False):
                if row.operation == "delete":
                    held.pop(row.key, None)
                else:
                    held[row.key] = (row.key, row.did, row.state if isinstance(row.state, str) else None, None if pd.isna(row.rating) else int(row.rating), int(row.created), row.did == row.author)
        state.update((list(held.values()),))
        after = winner(list(held.values()), editors)
        if after != before:
            yield pd.DataFrame({"target": [key[0]], "state": [after[0]], "rating": [after[1]], "judgments": [len(held)]})

    return judgments.groupBy("target").applyInPandasWithState(update, WINNER, STATE, "update", GroupStateTimeout.NoTimeout)


def event_counts(stream: DataFrame, width: str = "1 day", lateness: str = "2 days") -> DataFrame:
    """Events by type in windows of event time, for streams that can be late by a bound."""
    return stream.withWatermark("ts", lateness).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")


def sessions(stream: DataFrame, gap: str = "30 minutes", lateness: str = "2 days") -> DataFrame:
    """A user's events in sessions parted by a gap."""
    return stream.withWatermark("ts", lateness).groupBy("user_id", F.session_window("ts", gap)).agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")
