"""Record sources: paged listings as a batch, live events as a stream.

Both read recorded JSON: a folder with a file for each page, or each burst of
events. A client for a live service has the same methods, ``page``, ``bursts``
and ``events``; it is passed by name, so executors make their own.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

LISTING = "did string, uri string, cid string, record string"
EVENTS = "kind string, did string, time_us bigint, commit string"


class Recorded:
    """Recorded pages ``did/0.json``, ``did/1.json``… and events ``events/*.json``, one JSON object to a line."""

    def __init__(self, root: str):
        self.root = root

    def page(self, did: str, cursor: str | None) -> tuple[list[dict], str | None]:
        """The records of a page, and the cursor of the next one."""
        number = int(cursor or 0)
        path = os.path.join(self.root, did, f"{number}.json")
        if not os.path.exists(path):
            return [], None
        with open(path, encoding="utf-8") as file:
            return [json.loads(line) for line in file if line.strip()], str(number + 1)

    def bursts(self) -> Iterator[tuple[str, tuple]]:
        """The bursts that there are, each with a stamp that changes when it does."""
        folder = os.path.join(self.root, "events")
        for entry in sorted(os.scandir(folder), key=lambda e: e.name) if os.path.isdir(folder) else []:
            yield entry.name, (entry.stat().st_size, entry.stat().st_mtime_ns)

    def events(self, burst: str, after: int) -> Iterator[dict]:
        """Events of a burst later than a time, as they were recorded, one at a time: a burst may be of any size."""
        with open(os.path.join(self.root, "events", burst), encoding="utf-8") as file:
            for line in file:
                if line.strip() and (event := json.loads(line))["time_us"] > after:
                    yield event


class Listing(DataSource):
    """``format("record_listing")``: options path and dids; a partition for each did, paged by cursor."""

    @classmethod
    def name(cls) -> str:
        return "record_listing"

    def schema(self) -> str:
        return LISTING

    def reader(self, schema) -> DataSourceReader:
        return _ListingReader(self.options["path"], [d for d in self.options["dids"].split(",") if d])


class _ListingReader(DataSourceReader):
    def __init__(self, path: str, dids: list[str]):
        self.path, self.dids = path, dids

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(did) for did in self.dids]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        client, cursor = Recorded(self.path), "0"
        while cursor is not None:
            rows, cursor = client.page(partition.value, cursor)
            for row in rows:
                yield partition.value, row.get("uri"), row.get("cid"), json.dumps(row.get("value"))


class Live(DataSource):
    """``format("record_events")``: a stream whose offset is the time of the last event seen."""

    @classmethod
    def name(cls) -> str:
        return "record_events"

    def schema(self) -> str:
        return EVENTS

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _LiveReader(self.options["path"], int(self.options.get("cursor", "0")))


class _LiveReader(DataSourceStreamReader):
    """A partition for each burst, in order of time; the driver keeps the last time of each and none of its events."""

    def __init__(self, path: str, cursor: int):
        self.path, self.cursor = path, cursor
        self.last: dict[str, tuple[tuple, int]] = {}

    def initialOffset(self) -> dict:
        return {"time_us": self.cursor}

    def latestOffset(self) -> dict:
        client = Recorded(self.path)
        for burst, stamp in client.bursts():
            if self.last.get(burst, (None,))[0] != stamp:
                self.last[burst] = stamp, max((e["time_us"] for e in client.events(burst, self.cursor)), default=self.cursor)
        return {"time_us": max((last for _, last in self.last.values()), default=self.cursor)}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [InputPartition((start["time_us"], end["time_us"], burst)) for burst, _ in Recorded(self.path).bursts()]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        low, high, burst = partition.value
        found = [(e.get("kind"), e.get("did"), e["time_us"], json.dumps(e.get("commit"))) for e in Recorded(self.path).events(burst, low) if e["time_us"] <= high]
        yield from sorted(found, key=lambda row: row[2])


def backoff(attempt: int, first: float = 1.0, most: float = 60.0) -> float:
    """Seconds to wait before a reconnection: doubling, up to a minute."""
    return min(most, first * 2**attempt)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Listing)
    spark.dataSource.register(Live)
