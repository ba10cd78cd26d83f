"""Sequence packing: shortest-pack-first over the length histogram.

Documents are tokenised once, in the pass that also cuts them into pieces; only
piece lengths and checksums leave that pass. The histogram of piece lengths (at
most ``capacity`` rows) is packed on the driver, lengths longest first, into
pattern counts; pieces then find their pattern and slot by their rank among the
pieces of their length.

Defined results: null text is empty; an empty text is the end-of-document id
alone; repeated rows and repeated or null doc_ids are packed as documents of
their own; an empty table gives no pieces. Further input columns are not read.
"""

from __future__ import annotations

import base64
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.storage import stored

#: The id that ends each document.
END_ID = 1
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, row_key long"
PACKED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"

_coders: dict[str, object] = {}


class Coder:
    """Ids of a vocabulary as ``tokenizers`` gives them, without ids added around a text.

    The ``.json`` vocabulary is the authority; a special string in a text has its
    own id there. The rank file of the same vocabulary gives the same ids several
    times faster and is used where it stands beside the ``.json`` file, for texts
    without a special string; texts that its library refuses go to the other.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(path)
        self.special = [re.escape(token.content) for token in self.slow.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(self.special)) if self.special else None
        self.fast = None
        try:
            import public_tokenizers
            import tiktoken

            with open(path.removesuffix(".json") + ".tiktoken", "rb") as lines:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        except (ImportError, FileNotFoundError):
            pass

    def ids(self, text: str) -> np.ndarray:
        if self.fast is not None and not (self.special and self.special.search(text)):
            try:
                return np.array(self.fast.encode_ordinary(text), dtype="<u4")
            except BaseException as error:  # a panic in its regular expressions, on some extreme texts, is no Exception
                if type(error).__name__ != "PanicException" and not isinstance(error, ValueError):
                    raise
        return np.array(self.slow.encode(text, add_special_tokens=False).ids, dtype="<u4")


def coder(path: str) -> Coder:
    if path not in _coders:
        _coders[path] = Coder(path)
    return _coders[path]


def pieces(docs: DataFrame, vocabulary: str, capacity: int = 2048) -> DataFrame:
    """Cut each document's ids into pieces of ``capacity`` ids and a rest."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = coder(vocabulary).ids
        for batch in batches:
            columns: list[list[int]] = [[] for _ in range(6)]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.append(encode(text or ""), np.uint32(END_ID)).astype("<u4")
                for start in range(0, len(ids), capacity):
                    part = ids[start : start + capacity]
                    crc = zlib.crc32(part.tobytes())
                    key = zlib.crc32(struct.pack("<qq", doc_id or 0, start), crc)
                    for column, value in zip(columns, (doc_id, start, len(part), crc, len(ids), key), strict=True):
                        column.append(value)
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "row_key"]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(cut, PIECES)


def shortest_pack_first(histogram: dict[int, int], capacity: int = 2048) -> list[tuple[int, tuple[int, ...]]]:
    """Patterns as (count, lengths): lengths longest first, each into the shortest open packs it fits.

    Packs with the same room left and the same lengths are one entry with a
    count, so the work depends on the number of distinct lengths alone. Each
    step uses up either a length or an entry, which bounds the patterns by
    about twice the distinct lengths.
    """
    open_packs: dict[int, list[list]] = {}  # room left -> [count, lengths]
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left > 0:
            room = max((r for r, entries in open_packs.items() if entries and r >= length), default=None)
            if room is None:
                # as many copies of this length as go into one pack
                times = max(1, min(left, capacity // length))
                count = left // times
                open_packs.setdefault(capacity - times * length, []).append([count, (length,) * times])
                left -= count * times
                continue
            entry = open_packs[room][-1]
            times = max(1, min(left, room // length)) if left < entry[0] else 1
            count = min(left // times, entry[0])
            if count == entry[0]:
                open_packs[room].pop()
            else:
                entry[0] -= count
            open_packs.setdefault(room - times * length, []).append([count, entry[1] + (length,) * times])
            left -= count * times
    return [(count, lengths) for room in sorted(open_packs) for count, lengths in open_packs[room]]


def slots(patterns: list[tuple[int, tuple[int, ...]]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length: first rank, first sequence and offset of every run of ranks."""
    found: dict[int, list[tuple[int, int, int]]] = {}
    taken: dict[int, int] = {}
    first = 0
    for count, lengths in patterns:
        offset = 0
        for length in lengths:
            rank = taken.get(length, 0)
            found.setdefault(length, []).append((rank, first, offset))
            taken[length] = rank + count
            offset += length
        first += count
    return {length: tuple(np.array(x, dtype=np.int64) for x in zip(*runs, strict=True)) for length, runs in found.items()}


def pack(docs: DataFrame, vocabulary: str, capacity: int = 2048) -> DataFrame:
    """One row per piece: ``PACKED``.

    Sequences hold at most ``capacity`` ids; full pieces are sequences of their
    own. Offsets within a sequence are gapless from 0.
    """
    spark = docs.sparkSession
    cut = stored(pieces(docs, vocabulary, capacity), "pieces")
    # Ranks within a length: a count for each (length, share), then a running sum of at most
    # `shares` rows for each length, so that no task holds all pieces of a common length.
    shares = max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))) * 4
    cut = cut.withColumn("share", F.pmod("row_key", F.lit(shares)))
    counts = cut.groupBy("length", "share").agg(F.count(F.lit(1)).alias("n"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    places = slots(shortest_pack_first(histogram, capacity))
    before = counts.select("length", "share", (F.sum("n").over(Window.partitionBy("length").orderBy("share").rowsBetween(Window.unboundedPreceding, -1))).alias("before")).na.fill(0, ["before"])
    order = Window.partitionBy("length", "share").orderBy("doc_id", "start", "row_key")
    ranked = (
        cut.withColumn("own", F.row_number().over(order) - 1)
        .join(before, ["length", "share"])
        .select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("own") + F.col("before")).alias("rank"))
    )

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(i).to_numpy() for i in (2, 5))
            sequence, offset = np.zeros(len(rank), dtype=np.int64), np.zeros(len(rank), dtype=np.int64)
            for one in np.unique(length):
                at = np.flatnonzero(length == one)
                ranks, firsts, offsets = places[int(one)]
                run = np.searchsorted(ranks, rank[at], side="right") - 1
                sequence[at] = firsts[run] + rank[at] - ranks[run]
                offset[at] = offsets[run]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], [*batch.schema.names[:5], "sequence_id", "offset"])

    return ranked.mapInArrow(place, PACKED)
