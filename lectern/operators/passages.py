"""Repeated passages: winnowed anchors, maximal spans of pairs, clusters, duplicated pairs.

A source is (bucket_id, text). Anchors are hashes of short windows; two sources
that share one are extended to the longest common span around it, exactly or
within a number of edits; spans of the same text, or connected spans, make a
cluster.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import md5, sha256

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import text as fn
from lectern.functions.digests import window_numbers
from lectern.functions.udfs import align
from lectern.operators import exact_scan, intervals
from lectern.operators.components import components
from lectern.operators.exact_scan import chosen
from lectern.storage import stored

SPAN = ["bucket_a", "start_a", "end_a", "bucket_b", "start_b", "end_b"]


def winnow(sources: DataFrame, anchor_length: int = 12, min_length: int = 24, numbers: bool = False) -> DataFrame:
    """(bucket_id, position, hash) of the anchors: the least hash of each run of windows, rightmost of equals.

    Any passage of ``min_length`` characters holds one. Sources shorter than
    that have none; an anchor is listed when the choice moves to it. A text is
    read where it lies and gives its anchors alone: as window expressions every
    position would be a row to hash, sort and look back on, which takes ten
    times as long. ``numbers``: the first half of the hash as a number, for
    those who compare the texts themselves afterwards.
    """
    width = min_length - anchor_length + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, places, hashes = [], [np.zeros(0, dtype=np.int64)], []
            for bucket_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                # equal windows have equal hashes, and others differ in their first half
                values = window_numbers(text.encode(), anchor_length)
                moved = chosen(values, width)
                ids += [bucket_id] * len(moved)
                places.append(moved)
                hashes += values[moved].view(np.int64).tolist() if numbers else [md5(text[i : i + anchor_length].encode()).hexdigest() for i in moved.tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(np.concatenate(places), pa.int32()), pa.array(hashes, pa.int64() if numbers else pa.string())], ["bucket_id", "position", "hash"])

    long_enough = sources.where(F.length("text") >= min_length).select(F.col("bucket_id").cast("long"), "text")
    return long_enough.mapInArrow(run, f"bucket_id long, position int, hash {'long' if numbers else 'string'}")


def usable(anchors: DataFrame, most: int) -> DataFrame:
    """Hashes that occur twice at least and ``most`` times at most, with their count."""
    return anchors.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).where(F.col("n").between(2, most))


def anchor_pairs(anchors: DataFrame, most: int = 200, target: DataFrame | None = None, seed: int | None = None) -> DataFrame:
    """Pairs of places that share an anchor, each once.

    Anchors more frequent than ``most`` are left out; that bound is the
    operator's own parameter and is what keeps the pairs of a group bounded. A
    greater one leaves out less, and one above all frequencies nothing.
    ``target`` (bucket_id): only pairs with such a source on one side. ``seed``:
    of anchors of that length, a pair that another one leads up to without a gap
    is left out, as both lie in one common passage.
    """
    # written, so that both sides are shuffled as they are and an anchor of very many places can be split
    kept = anchors.join(stored(usable(anchors, most).select("hash"), "usable").hint("merge"), "hash")
    if target is not None:
        kept = kept.join(target.select("bucket_id").distinct().withColumn("aimed", F.lit(True)), "bucket_id", "left")
    else:
        kept = kept.withColumn("aimed", F.lit(True))
    if seed is not None:
        by = Window.partitionBy("bucket_id").orderBy("position")
        gap = F.col("position") - F.lag("position").over(by)
        kept = kept.withColumns({"gap": F.when(gap <= seed, gap), "before": F.when(gap <= seed, F.lag("hash").over(by))})
    a, b = kept.alias("a"), kept.alias("b")
    later = (F.col("a.bucket_id") < F.col("b.bucket_id")) | ((F.col("a.bucket_id") == F.col("b.bucket_id")) & (F.col("a.position") < F.col("b.position")))
    if seed is not None:
        later = later & ~F.coalesce((F.col("a.gap") == F.col("b.gap")) & (F.col("a.before") == F.col("b.before")), F.lit(False))
    joined = a.join(b, [F.col("a.hash") == F.col("b.hash"), later, F.coalesce(F.col("a.aimed"), F.col("b.aimed"), F.lit(False))])
    return joined.select(F.col("a.bucket_id").alias("bucket_a"), F.col("a.position").alias("pos_a"), F.col("b.bucket_id").alias("bucket_b"), F.col("b.position").alias("pos_b"))


def seed_pairs(sources: DataFrame, seed: str, most: int = 500) -> DataFrame:
    """Pairs of occurrences of a short literal; more occurrences than ``most`` are refused."""
    places = sources.where(F.col("text").contains(seed)).select("bucket_id", F.explode(fn.positions("text", seed)).alias("position")).withColumn("hash", F.lit(seed))
    if places.limit(most + 1).count() > most:
        raise ValueError(f"the seed occurs more than {most} times")
    return anchor_pairs(places, most)


def _common(a: np.ndarray, b: np.ndarray) -> int:
    """The length of the common start, looked for in growing blocks."""
    n, at, step = min(len(a), len(b)), 0, 64
    while at < n:
        differ = np.flatnonzero(a[at : min(n, at + step)] != b[at : min(n, at + step)])
        if len(differ):
            return at + int(differ[0])
        at, step = at + step, step * 4
    return n


#: What no frontier can reach, far enough from zero to stay so after steps.
_NEVER = -(1 << 40)


def reach(a: np.ndarray, b: np.ndarray, edits: int) -> list[tuple[int, int, int]]:
    """For each budget up to ``edits``: how far a and b agree from their start, and the edits used.

    ``far[d]`` is the farthest place in a that a number of edits gets to on the
    diagonal d (places in a minus places in b); one more edit is a step from it
    (both texts go on), from d - 1 (a alone) or from d + 1 (b alone), after which
    the texts are followed as long as they agree. All diagonals step at once. A
    span ends on agreement or where a text ends.
    """
    n, m = len(a), len(b)
    start = _common(a, b)
    ends = [(start, start, 0)]
    if not n or not m:
        return ends * (edits + 1)
    diagonals = np.arange(-edits, edits + 1)
    far = np.full(len(diagonals) + 2, _NEVER)
    far[edits + 1] = start
    for used in range(1, edits + 1):
        steps = np.stack((far[1:-1] + 1, far[:-2] + 1, far[2:]))
        steps[(steps < 0) | (steps > n) | (steps < diagonals) | (steps - diagonals > m)] = _NEVER
        at = steps.max(axis=0)
        to = np.array([i + _common(a[i:], b[i - d :]) if i >= 0 else _NEVER for i, d in zip(at.tolist(), diagonals.tolist(), strict=True)])
        far[1:-1] = to
        total = np.where((to > at) | (to == n) | (to - diagonals == m), 2 * to - diagonals, _NEVER)
        best = int(total.argmax())
        longer = total[best] > ends[-1][0] + ends[-1][1]
        ends.append((int(to[best]), int(to[best] - diagonals[best]), used) if longer else ends[-1])
    return ends


def extended(a: np.ndarray, at_a: int, b: np.ndarray, at_b: int, seed: int, edits: int) -> tuple[int, int, int, int, int]:
    """(start_a, end_a, start_b, end_b, edits) of the longest span around a shared seed."""
    right = reach(a[at_a + seed :], b[at_b + seed :], edits)
    left = reach(a[:at_a][::-1], b[:at_b][::-1], edits)
    # the budget is shared out in every way; the longest span counts, then the one with fewer edits
    shared = [(sum(before[:2]) + sum(after[:2]), -before[2] - after[2], -i) for i, (before, after) in enumerate(zip(left, reversed(right), strict=True))]
    split = -max(shared)[2]
    (back_a, back_b, used), (on_a, on_b, more) = left[split], right[edits - split]
    return at_a - back_a, at_a + seed + on_a, at_b - back_b, at_b + seed + on_b, used + more


#: Characters of text that a block of sources has, about (a task holds two blocks), and blocks at least.
BLOCK, LEAST_BLOCKS = 12_000_000, 8
_FOUND = "bucket_a long, start_a int, end_a int, bucket_b long, start_b int, end_b int, edits int, passage binary"


#: Characters that two texts are compared by at a time: at first, and at most; and comparisons made at once.
_STEP, _WIDEST, _AT_ONCE = 16, 1024, 1 << 21


def _agreement(flat: np.ndarray, a: np.ndarray, b: np.ndarray, way: int) -> np.ndarray:
    """For each pair of places: how many characters agree from them on (``way`` 1) or before them (-1).

    All pairs are followed together, in wider and wider steps as fewer of them go on.
    """
    found = np.zeros(len(a), dtype=np.int64)
    live, width = np.arange(len(a)), _STEP
    while len(live):
        ahead = way * np.arange(width) if way > 0 else -1 - np.arange(width)
        on = []
        for low in range(0, len(live), max(1, _AT_ONCE // width)):
            part = live[low : low + max(1, _AT_ONCE // width)]
            gone = way * found[part]
            same = flat[(a[part] + gone)[:, None] + ahead] == flat[(b[part] + gone)[:, None] + ahead]
            whole = same.all(axis=1)
            found[part] += np.where(whole, width, same.argmin(axis=1))
            on.append(part[whole])
        live, width = np.concatenate(on), min(_WIDEST, width * 4)
    return found


class _Exact:
    """Exact spans of one task's places, all at once: its texts stand in one array, each ended by a sign of its own."""

    def __init__(self, seed: int, least: int):
        self.seed, self.least = seed, least
        self.texts: dict[int, str] = {}
        self.flat = None
        self.last = None  # the run of the last place, which the next batch may begin in

    def add(self, bucket: int, text: str) -> None:
        self.texts[bucket] = text

    def _laid_out(self) -> None:
        self.ids = np.array(sorted(self.texts), dtype=np.int64)
        parts = [np.full(_WIDEST, 0x200000, dtype=np.uint32)]
        for n, bucket in enumerate(self.ids.tolist()):
            parts += [np.frombuffer(self.texts[bucket].encode("utf-32-le"), dtype="<u4"), np.array([0x200001 + n], dtype=np.uint32)]
        self.starts = np.cumsum([0] + [len(x) for x in parts])[1 : 2 * len(self.ids) + 1 : 2]
        self.flat = np.concatenate([*parts, np.full(_WIDEST, 0x200000, dtype=np.uint32)])

    def rows(self, a: np.ndarray, b: np.ndarray, place: np.ndarray, shift: np.ndarray) -> list:
        """Columns of ``_FOUND``; places come in order of sources, diagonal and place."""
        if self.flat is None:
            self._laid_out()
        same = (a[1:] == a[:-1]) & (b[1:] == b[:-1]) & (shift[1:] == shift[:-1])
        # an anchor that touches the one before on its diagonal is in its run
        first = np.concatenate(([True], ~(same & (place[1:] - place[:-1] <= self.seed))))
        a, b, place, shift = (v[first].astype(np.int64) for v in (a, b, place, shift))
        known = np.isin(a, self.ids) & np.isin(b, self.ids)
        a, b, place, shift = (v[known] for v in (a, b, place, shift))
        base_a, base_b = self.starts[np.searchsorted(self.ids, a)], self.starts[np.searchsorted(self.ids, b)]
        at_a, at_b = base_a + place, base_b + place - shift
        right = _agreement(self.flat, at_a, at_b, 1)
        left = _agreement(self.flat, at_a, at_b, -1)
        sa, ea, sb, eb = place - left, place + right, place - shift - left, place - shift + right
        # of a run that several places are in the first counts
        run = np.stack((a, b, shift, sa))
        new = np.ones(len(a), dtype=bool)
        new[1:] = (run[:, 1:] != run[:, :-1]).any(axis=0)
        if len(a):
            new[0] = self.last is None or (run[:, 0] != self.last).any()
            self.last = run[:, -1]
        keep = new & (right >= self.seed) & (ea - sa >= self.least) & ~((a == b) & (sa < eb) & (sb < ea))
        columns = [v[keep] for v in (a, sa, ea, b, sb, eb)]
        passages = [sha256(self.texts[x][s:e].encode()).digest() for x, s, e in zip(*(c.tolist() for c in columns[:3]), strict=True)]
        return [*columns, np.zeros(len(passages), dtype=np.int64), passages]

    def close(self) -> list:
        return [[] for _ in range(8)]


class _Edited:
    """Spans within a number of edits of one task's places, in order of sources, diagonal and place.

    Places in one run of equal characters have the same span, so of each run
    the first is followed and the others are passed over.
    """

    def __init__(self, seed: int, least: int, edits: int):
        self.texts: dict[int, np.ndarray] = {}
        self.seed, self.least, self.edits = seed, least, edits
        self.line, self.end = None, -1  # a diagonal of two sources, and how far its last run goes
        self.pair, self.found = None, {}

    def add(self, bucket: int, text: str) -> None:
        self.texts[bucket] = np.frombuffer(text.encode("utf-32-le"), dtype="<u4")

    def rows(self, a: np.ndarray, b: np.ndarray, place: np.ndarray, shift: np.ndarray) -> list:
        out: list[tuple] = []
        for x, y, at, d in zip(*(v.tolist() for v in (a, b, place, shift)), strict=True):
            if (x, y) != self.pair:
                out += self._pair()
                self.pair = (x, y)
            if self.line == (x, y, d) and at + self.seed <= self.end:
                continue
            one, other = self.texts.get(x), self.texts.get(y)
            if one is None or other is None or not np.array_equal(one[at : at + self.seed], other[at - d : at - d + self.seed]):
                continue
            self.line, self.end = (x, y, d), at + self.seed + _common(one[at + self.seed :], other[at - d + self.seed :])
            sa, ea, sb, eb, used = extended(one, at, other, at - d, self.seed, self.edits)
            if min(ea - sa, eb - sb) < self.least or x == y and sa < eb and sb < ea:
                continue
            if x == y and (sb, eb) < (sa, ea):
                sa, ea, sb, eb = sb, eb, sa, ea
            self.found[sa, ea, sb, eb] = min(used, self.found.get((sa, ea, sb, eb), used))
        return self._columns(out)

    def _pair(self) -> list[tuple]:
        found, self.found = self.found, {}
        return [(self.pair[0], sa, ea, self.pair[1], sb, eb, used, None) for (sa, ea, sb, eb), used in found.items()]

    @staticmethod
    def _columns(rows: list[tuple]) -> list:
        return [list(c) for c in zip(*rows, strict=True)] if rows else [[] for _ in range(8)]

    def close(self) -> list:
        return self._columns(self._pair())


def spans(sources: DataFrame, pairs: DataFrame, seed: int, min_length: int, edits: int = 0) -> DataFrame:
    """Maximal spans of pairs: ``SPAN``, edits, and the hash of the passage (exact spans), each once.

    Sources are dealt to blocks by their id. A task is two blocks, and gets the
    texts of those sources alone that share an anchor across them, once however
    many pairs and places they have, and then its places one after the other, so
    nothing is gathered by pair.
    """
    texts = sources.select(F.col("bucket_id").cast("long").alias("bucket_id"), "text").where("text is not null")
    blocks = max(LEAST_BLOCKS, -(-(texts.agg(F.sum(F.length("text"))).first()[0] or 0) // BLOCK))
    block = lambda c: F.pmod(F.xxhash64(c), F.lit(blocks))
    own, other = block(F.col("bucket_a")), block(F.col("bucket_b"))
    places = pairs.select(F.least(own, other).alias("low"), F.greatest(own, other).alias("high"), "bucket_a", "bucket_b", (F.col("pos_a") - F.col("pos_b")).cast("int").alias("shift"), F.col("pos_a").cast("int").alias("place"))
    places = stored(places, "places")
    wanted = places.select("low", "high", F.explode(F.array_distinct(F.array("bucket_a", "bucket_b"))).alias("bucket_id")).distinct()
    empty = {"bucket_b": F.lit(None).cast("long"), "shift": F.lit(None).cast("int"), "place": F.lit(None).cast("int")}
    needed = texts.join(wanted, "bucket_id").select("low", "high", F.lit(0).alias("kind"), F.col("bucket_id").alias("bucket_a"), *[c.alias(n) for n, c in empty.items()], "text")
    rows = needed.unionByName(places.withColumns({"kind": F.lit(1), "text": F.lit(None).cast("string")}))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [field.split()[0] for field in _FOUND.split(", ")]
        types = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary()]
        task, made = None, None

        def batch_of(columns: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c).cast(t) if isinstance(c, np.ndarray) else pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

        for batch in batches:
            if not batch.num_rows:
                continue
            low, high, kind, a = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            b, shift, place = (batch.column(i).fill_null(0).to_numpy(zero_copy_only=False) for i in range(4, 7))
            cuts = np.flatnonzero((low[1:] != low[:-1]) | (high[1:] != high[:-1]) | (kind[1:] != kind[:-1])) + 1
            for start, end in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
                if (low[start], high[start]) != task:
                    if made:
                        yield batch_of(made.close())
                    task, made = (low[start], high[start]), _Edited(seed, min_length, edits) if edits else _Exact(seed, min_length)
                if kind[start] == 0:
                    for bucket, text in zip(a[start:end].tolist(), batch.column(7).slice(start, end - start).to_pylist(), strict=True):
                        made.add(bucket, text)
                else:
                    yield batch_of(made.rows(a[start:end], b[start:end], place[start:end], shift[start:end]))
        if made:
            yield batch_of(made.close())

    # tasks differ much in size, so that there are four shares for each of the session's
    shares = 4 * int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["low", "high"]
    dealt = rows.select(*order, "kind", "bucket_a", "bucket_b", "shift", "place", "text").repartition(shares, *order)
    found = dealt.sortWithinPartitions(*order, "kind", "bucket_a", "bucket_b", "shift", "place").mapInArrow(run, _FOUND)
    return found.select(*SPAN, "edits", "passage")


def _occurrences(found: DataFrame, *more: str) -> DataFrame:
    a = found.select(F.col("bucket_a").alias("bucket_id"), F.col("start_a").alias("start"), F.col("end_a").alias("end"), *more)
    return a.unionByName(found.select(F.col("bucket_b").alias("bucket_id"), F.col("start_b").alias("start"), F.col("end_b").alias("end"), *more)).distinct()


def _hashed(sources: DataFrame, places: DataFrame) -> DataFrame:
    """``places`` (bucket_id, start, end) with ``passage``, the hash of their text.

    A text goes to the task of its source and its places come after it one by
    one, so that none of them has the text in its row.
    """
    texts = sources.select(F.col("bucket_id").cast("long").alias("bucket_id"), F.lit(-1).alias("start"), F.lit(0).alias("end"), "text").where("text is not null")
    rows = texts.unionByName(places.select(F.col("bucket_id").cast("long").alias("bucket_id"), "start", "end", F.lit(None).cast("string").alias("text")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, points, cuts = None, b"", None
        for batch in batches:
            ids, starts, ends = (batch.column(i).to_pylist() for i in range(3))
            texts = batch.column(3)
            kept, hashes = [], []
            for i, (own, start, end) in enumerate(zip(ids, starts, ends, strict=True)):
                if start < 0:
                    points, bucket = texts[i].as_py().encode(), own
                    raw = np.frombuffer(points, dtype=np.uint8)
                    cuts = None if (raw < 0x80).all() else np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw)).tolist()
                elif own == bucket:
                    kept.append(i)
                    hashes.append(sha256(points[start:end] if cuts is None else points[cuts[start] : cuts[end]]).digest())
            yield pa.RecordBatch.from_arrays([*(batch.column(i).take(pa.array(kept, pa.int64())) for i in range(3)), pa.array(hashes, pa.binary())], ["bucket_id", "start", "end", "passage"])

    shares = 4 * int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(shares, "bucket_id").sortWithinPartitions("bucket_id", "start", "end").mapInArrow(run, "bucket_id long, start int, end int, passage binary")


def exact_occurrences(sources: DataFrame, found: DataFrame, min_occurrences: int = 2) -> DataFrame:
    """(cluster, length, bucket_id, start, end): spans grouped by the hash of their text.

    ``spans`` gives exact ones with that hash; only spans from elsewhere are cut from their texts here.
    """
    if "passage" in found.columns:
        cut = _occurrences(found, "passage")
    else:
        cut = _hashed(sources, _occurrences(found))
    many = cut.groupBy("passage").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_occurrences).select("passage")
    rows = cut.join(many, "passage")
    return rows.select(F.lower(F.hex("passage")).alias("cluster"), (F.col("end") - F.col("start")).alias("length"), "bucket_id", "start", "end")


#: Characters of a cell in which spans meet those that may contain them.
CELL = 64


def uncontained(occurrences: DataFrame, min_occurrences: int = 2) -> DataFrame:
    """``occurrences`` without clusters that a kept cluster of no less length contains.

    A cluster is contained if ``min_occurrences`` of its spans lie in spans of
    that one cluster. What contains what is one range join; which of them are
    kept is settled in rounds, longest first: a cluster goes as soon as a kept
    one contains it, and stays as soon as all that contain it are gone.
    """
    occurrences = stored(occurrences, "occurrences")
    first = occurrences.groupBy("cluster").agg(F.max("length").alias("length"), F.min(F.struct("bucket_id", "start", "end")).alias("least"))
    # of clusters of one length the one that comes first in order may contain the other; numbers follow that order and are short
    numbers = stored(first.orderBy(F.desc("length"), "cluster", "least").select("cluster", F.monotonically_increasing_id().alias("number")), "numbers")
    spans_ = stored(occurrences.join(numbers, "cluster").select("number", "length", "bucket_id", "start", "end"), "numbered")
    # a span lies in one cell of its text, and what contains it covers that cell; else all spans of a text would meet
    cell = lambda c: F.floor(c / CELL)
    inner = spans_.withColumns({"cell": cell(F.col("start")), "place": F.xxhash64("bucket_id", "start", "end")}).alias("i")
    outer = spans_.withColumn("cell", F.explode(F.sequence(cell(F.col("start")), cell(F.col("end") - 1)))).alias("o")
    inside = [
        F.col("i.bucket_id") == F.col("o.bucket_id"),
        F.col("i.cell") == F.col("o.cell"),
        F.col("i.start") >= F.col("o.start"),
        F.col("i.end") <= F.col("o.end"),
        F.col("o.number") < F.col("i.number"),
        F.col("o.length") >= F.col("i.length"),
    ]
    held = inner.join(outer, inside).groupBy(F.col("i.number").alias("cluster"), F.col("o.number").alias("container"))
    if min_occurrences <= 2:  # two places differ in their least and greatest
        held = held.agg(F.min("i.place").alias("low"), F.max("i.place").alias("high")).where(F.lit(min_occurrences < 2) | (F.col("low") < F.col("high")))
    else:
        held = held.agg(F.countDistinct("i.place").alias("n")).where(F.col("n") >= min_occurrences)
    relation = stored(held.select("cluster", "container"), "containment")
    gone = None
    while not relation.isEmpty():
        undecided = relation.select("cluster").distinct()
        settled = relation.join(undecided.select(F.col("cluster").alias("container")), "container", "left_anti")
        now = stored(settled.select("cluster").distinct(), "contained")  # held by a cluster that stays
        gone = now if gone is None else gone.unionByName(now)
        relation = stored(relation.join(now, "cluster", "left_anti").join(now.select(F.col("cluster").alias("container")), "container", "left_anti"), "containment")
    if gone is None:
        return occurrences
    names = numbers.join(gone.withColumnRenamed("cluster", "number"), "number", "left_semi").select("cluster")
    return occurrences.join(names, "cluster", "left_anti")


def listed(occurrences: DataFrame) -> DataFrame:
    """(cluster, length, occurrence_count, first_bucket, first_start) of clusters."""
    least = F.min(F.struct("bucket_id", "start", "end")).alias("least")
    return occurrences.groupBy("cluster").agg(F.max("length").alias("length"), F.count(F.lit(1)).alias("occurrence_count"), least).select("cluster", "length", "occurrence_count", F.col("least.bucket_id").alias("first_bucket"), F.col("least.start").alias("first_start"))


def scan(sources: DataFrame, anchor_length: int = 12, min_length: int = 24, most: int = 200, edits: int = 0, target: DataFrame | None = None) -> DataFrame:
    """Spans of all pairs that winnowed anchors find."""
    anchors = stored(winnow(sources, anchor_length, min_length, True), "anchors")
    return spans(sources, anchor_pairs(anchors, most, target, anchor_length), anchor_length, min_length, edits)


def exact_spans(sources: DataFrame, anchor_length: int = 12, min_length: int = 24, most: int = 200) -> DataFrame:
    """The spans (``SPAN``) that ``scan`` finds without edits, and not their hashes.

    They are found from what anchors carry (``exact_scan``); texts are compared
    for those alone that have an end which is not seen so.
    """
    seen, unseen = exact_scan.scanned(sources, anchor_length, min_length, most)
    count = unseen.count()
    if not count:
        return seen.select(SPAN)
    ids = unseen.select(F.explode(F.array("bucket_a", "bucket_b")).alias("bucket_id")).distinct()
    few = sources.join(F.broadcast(ids) if count <= 10_000 else ids, "bucket_id", "left_semi")
    return seen.select(SPAN).unionByName(spans(few, unseen, anchor_length, min_length).select(SPAN))


def fuzzy_occurrences(sources: DataFrame, found: DataFrame, max_edits: int, min_occurrences: int = 2) -> DataFrame:
    """(cluster, bucket_id, start, end, length, edits, ops) of connected spans.

    The representative is the longest span (ties: least bucket, then start).
    Spans more than twice ``max_edits`` away from it are dropped, and so are
    clusters left with too few.
    """
    name = lambda side: F.concat_ws(":", *[F.col(f"{c}_{side}").cast("string") for c in ("bucket", "start", "end")])
    edges = found.select(name("a").alias("a"), name("b").alias("b"))
    grouped = components(edges)
    parts = F.split("node", ":")
    spans_ = grouped.select(F.col("component").alias("cluster"), parts[0].cast("long").alias("bucket_id"), parts[1].cast("int").alias("start"), parts[2].cast("int").alias("end"))
    texts = spans_.join(sources.select("bucket_id", "text"), "bucket_id").withColumn("own", fn.slice_text("text", F.col("start"), F.col("end") - F.col("start"))).drop("text")
    texts = texts.withColumn("length", F.col("end") - F.col("start"))
    rep = texts.groupBy("cluster").agg(F.min_by("own", F.struct(-F.col("length"), "bucket_id", "start")).alias("rep"))
    scored = texts.join(rep, "cluster").withColumn("edits", F.levenshtein("rep", "own", 2 * max_edits)).where("edits >= 0")
    many = scored.groupBy("cluster").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_occurrences).select("cluster")
    kept = scored.join(many, "cluster")

    @F.pandas_udf("string")
    def ops(a: pd.Series, b: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series(["" if not k else " ".join(f"{o['op']}{o['n'] if o['op'] == '=' else o['a'] + o['b']}" for o in align(x, y)) for x, y, k in zip(a, b, n, strict=True)])

    return kept.select("cluster", "bucket_id", "start", "end", "length", "edits", ops("rep", "own", "edits").alias("ops"))


def edit_distance(a: Column, b: Column, cap: int) -> Column:
    """The Levenshtein distance, and cap + 1 for all that is more."""
    found = F.levenshtein(a, b, cap)
    return F.when(found < 0, cap + 1).otherwise(found)


#: Shares of a group's rows that are paired by tasks of their own; different texts of a group up to which their distances are listed.
SHARES, LISTED = 4, 256


def distances(rows: DataFrame, keys: list[str], cap: int) -> DataFrame:
    """(keys, key_a, key_b, distance) of all pairs of ``rows`` (key, text) that share ``keys``, as ``edit_distance`` has it.

    Pairs are many where rows are few, so rows are dealt to tasks by their group
    and by shares of it: a file of a few megabytes would else be paired by one
    task. Where a group has few different texts these are compared once, and a
    pair looks its distance up by the number of its second text.
    """
    different = rows.select(*keys, "text").where("text is not null").distinct()
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("text"))
    numbered = stored(different.withColumn("__n", place), "texts")
    few = numbered.groupBy(*keys).agg(F.max("__n").alias("most")).where(F.col("most") <= LISTED).select(*keys)
    lists = numbered.join(few, keys).groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("__n", "text"))).alias("__all"))
    far = F.transform("__all", lambda x: edit_distance(F.col("text"), x["text"], cap).cast("int"))
    known = stored(numbered.join(lists, keys).select(*keys, "text", "__n", far.alias("__far")), "distances")
    own = rows.join(known, [*keys, "text"], "left")
    share = F.pmod(F.xxhash64("key"), F.lit(SHARES)).cast("int")
    a = own.select(*keys, share.alias("__share"), F.col("key").alias("key_a"), F.col("text").alias("__a"), "__far")
    b = own.select(*keys, F.explode(F.array(*[F.lit(i) for i in range(SHARES)])).alias("__share"), F.col("key").alias("key_b"), F.col("text").alias("__b"), "__n")
    # dealt to a number of tasks, which adaptive execution would else merge by their few megabytes
    tasks = 4 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    a, b = (side.repartition(tasks, *keys, "__share") for side in (a, b))
    pairs = a.join(b.hint("merge"), [*keys, "__share"]).where("key_a < key_b")
    at = F.when(F.col("__far").isNull() | F.col("__n").isNull(), edit_distance(F.col("__a"), F.col("__b"), cap)).otherwise(F.get("__far", F.col("__n") - 1))
    return pairs.select(*keys, "key_a", "key_b", at.alias("distance"))


def located(occurrences: DataFrame, sources: DataFrame, toc: DataFrame | None = None, context: int = 20) -> DataFrame:
    """``occurrences`` with their text, context and the label of their place."""
    joined = occurrences.join(sources.select("bucket_id", "text"), "bucket_id")
    start, length = F.col("start"), F.col("end") - F.col("start")
    shown = joined.withColumns({"left": fn.left_context("text", start, context), "passage": fn.slice_text("text", start, length), "right": fn.slice_text("text", F.col("end"), F.lit(context))}).drop("text")
    return shown if toc is None else intervals.innermost(shown, toc, ["bucket_id"], "start")


def pair_rows(found: DataFrame, lengths: DataFrame, min_chars: int = 100) -> DataFrame:
    """Duplicated pairs of sources: merged characters of each side, the longest span, coverage.

    ``found`` has spans of pairs; ``lengths`` (bucket_id, chars).
    """
    pair = ["bucket_a", "bucket_b"]
    place = lambda name, side: F.struct(F.lit(name).alias("side"), F.col(f"start_{side}").alias("start"), F.col(f"end_{side}").alias("end"))
    one, intra = [place("a", "a"), place("b", "b")], [place("a", "b"), place("b", "a")]  # two places of one source count for both sides
    own = found.select(*pair, F.explode(F.when(F.col("bucket_a") == F.col("bucket_b"), F.array(*one, *intra)).otherwise(F.array(*one))).alias("p")).select(*pair, "p.*")
    chars = F.col("end") - F.col("start")
    of = lambda side: [F.sum(F.when(F.col("side") == side, chars)).alias(f"chars_{side}"), F.count_if(F.col("side") == side).alias(f"spans_{side}")]
    sides = intervals.merged(own, [*pair, "side"]).groupBy(*pair).agg(*of("a"), *of("b"))
    longest = found.groupBy(*pair).agg(
        F.max(F.col("end_a") - F.col("start_a")).alias("longest_span"), F.min_by(F.struct("start_a", "start_b"), F.struct(F.col("start_a") - F.col("end_a"), "start_a", "start_b")).alias("at")
    )
    rows = sides.join(longest, pair).where(F.least("chars_a", "chars_b") >= min_chars)
    rows = rows.join(lengths.select(F.col("bucket_id").alias("bucket_a"), F.col("chars").alias("length_a")), "bucket_a").join(lengths.select(F.col("bucket_id").alias("bucket_b"), F.col("chars").alias("length_b")), "bucket_b")
    ratio = lambda s: F.when(F.col(f"length_{s}") > 0, F.col(f"chars_{s}") / F.col(f"length_{s}")).otherwise(0.0)
    return rows.withColumns({"longest_a": F.col("at.start_a"), "longest_b": F.col("at.start_b"), "coverage_a": ratio("a"), "coverage_b": ratio("b"), "intra": F.col("bucket_a") == F.col("bucket_b")}).drop("at")


def at_offset(occurrences: DataFrame, bucket_id: int, offset: int, mode: str = "overlap") -> DataFrame:
    """Occurrences at a place: ``overlap`` is start <= offset < end, ``cover`` also takes the end."""
    end = F.col("end") > offset if mode == "overlap" else F.col("end") >= offset
    return occurrences.where((F.col("bucket_id") == bucket_id) & (F.col("start") <= offset) & end)


def lookup(occurrences: DataFrame, bucket_id: int, offset: int, mode: str = "overlap", include_self: bool = False) -> DataFrame:
    """All occurrences of the clusters at a place, without the place itself."""
    here = at_offset(occurrences, bucket_id, offset, mode)
    all_ = occurrences.join(here.select("cluster").distinct(), "cluster")
    return all_ if include_self else all_.join(here.select("cluster", "bucket_id", "start", "end"), ["cluster", "bucket_id", "start", "end"], "left_anti")


_rng = np.random.Generator(np.random.PCG64(77))
_BASES = _rng.integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mixed(x: np.ndarray, by: int) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(by)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(by)
    return x ^ (x >> np.uint64(32))


def minhash(sources: DataFrame, k: int = 5, size: int = 128) -> DataFrame:
    """(bucket_id, sketch): least values of ``size`` hash functions a + i * b over the source's k-grams (k up to 64)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = np.arange(size, dtype=np.uint64)[:, None]
        for batch in batches:
            ids, sketches = [], []
            for bucket_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                points = np.frombuffer(text.encode("utf-32-le"), dtype="<u4").astype(np.uint64)
                n = len(points) - k + 1
                if n <= 0:
                    continue
                grams = np.unique(_mixed(sum(points[i : i + n] * _BASES[i] for i in range(k)), 0xD6E8FEB86659FD93))
                a, b = _mixed(grams, 0x9E3779B97F4A7C15 | 1), _mixed(grams, 0xA0761D6478BD642F) | np.uint64(1)
                least = np.full(size, np.iinfo(np.uint64).max, dtype=np.uint64)
                for at in range(0, len(grams), 4096):
                    least = np.minimum(least, (a[at : at + 4096] + order * b[at : at + 4096]).min(axis=1))
                ids.append(bucket_id)
                sketches.append(least.view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sketches, pa.list_(pa.int64()))], ["bucket_id", "sketch"])

    return sources.select(F.col("bucket_id").cast("long"), "text").where("text is not null").mapInArrow(run, "bucket_id long, sketch array<long>")


def sketch_classes(sketches: DataFrame) -> DataFrame:
    """(class_id, sketch): one row for each distinct sketch, under the least source that has it."""
    return sketches.groupBy("sketch").agg(F.min("bucket_id").alias("class_id")).select("class_id", "sketch")


def band_pairs(sketches: DataFrame, bands: int = 16, size: int = 128) -> DataFrame:
    """All distinct pairs of sources that agree in a band of their sketches."""
    rows = size // bands
    band = F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda i: F.xxhash64(i, F.slice("sketch", i * rows + 1, rows)))
    buckets = sketches.select("bucket_id", F.explode(band).alias("band"))
    a, b = buckets.alias("a"), buckets.alias("b")
    pairs = a.join(b, [F.col("a.band") == F.col("b.band"), F.col("a.bucket_id") < F.col("b.bucket_id")])
    return pairs.select(F.col("a.bucket_id").alias("bucket_a"), F.col("b.bucket_id").alias("bucket_b")).distinct()


def similar_pairs(sketches: DataFrame, bands: int = 16, size: int = 128) -> DataFrame:
    """All pairs of ``band_pairs`` with their ``similarity``.

    Sources with equal sketches are one class: classes are paired and compared,
    and their members listed after that, so copies cost no comparisons.
    """
    classes = stored(sketch_classes(sketches), "classes").withColumnRenamed("class_id", "bucket_id")
    links = similarity(band_pairs(classes, bands, size), classes)
    members = stored(sketches.join(classes.withColumnRenamed("bucket_id", "class_id"), "sketch").select("class_id", "bucket_id").distinct(), "members")
    copied = members.groupBy("class_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    links = links.unionByName(copied.select(F.col("class_id").alias("bucket_a"), F.col("class_id").alias("bucket_b"), F.lit(1.0).alias("similarity")))
    a = members.select(F.col("class_id").alias("bucket_a"), F.col("bucket_id").alias("x"))
    b = members.select(F.col("class_id").alias("bucket_b"), F.col("bucket_id").alias("y"))
    found = links.join(a, "bucket_a").join(b, "bucket_b").where((F.col("bucket_a") != F.col("bucket_b")) | (F.col("x") < F.col("y")))
    return found.select(F.least("x", "y").alias("bucket_a"), F.greatest("x", "y").alias("bucket_b"), "similarity")


def similarity(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """``pairs`` with the share of equal sketch values: an estimate of Jaccard similarity."""
    a = sketches.select(F.col("bucket_id").alias("bucket_a"), F.col("sketch").alias("x"))
    b = sketches.select(F.col("bucket_id").alias("bucket_b"), F.col("sketch").alias("y"))
    same = F.size(F.filter(F.zip_with("x", "y", lambda p, q: p == q), lambda s: s))
    return pairs.join(a, "bucket_a").join(b, "bucket_b").select("bucket_a", "bucket_b", (same / F.size("x")).alias("similarity"))


def directed(occurrences: DataFrame, target: list[int]) -> DataFrame:
    """For each occurrence in a target source, a marker to every other occurrence of its cluster."""
    own = occurrences.where(F.col("bucket_id").isin(target)).alias("t")
    other = occurrences.alias("o")
    apart = (F.col("t.bucket_id") != F.col("o.bucket_id")) | (F.col("t.start") != F.col("o.start")) | (F.col("t.end") != F.col("o.end"))
    return own.join(other, [F.col("t.cluster") == F.col("o.cluster"), apart]).select(
        F.col("t.bucket_id").alias("bucket_id"), F.col("t.start").alias("offset"), (F.col("t.end") - F.col("t.start")).alias("length"), F.col("o.bucket_id").alias("to_bucket"), F.col("o.start").alias("to_start"), F.col("o.end").alias("to_end")
    ).distinct()


def estimate(sources: DataFrame, anchor_length: int, min_length: int, share: float, seed: int = 1) -> dict[str, float]:
    """What a scan will cost, from a sample of sources: characters, anchors and pairs, scaled up.

    Anchors grow with the sample and pairs with its square.
    """
    total = sources.agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars")).first()
    sample = stored(winnow(sources.where(F.pmod(F.xxhash64("bucket_id", F.lit(seed)), F.lit(10_000)) < int(share * 10_000)), anchor_length, min_length), "estimate")
    n = sample.count()
    pairs = usable(sample, 1 << 30).agg(F.sum(F.col("n") * (F.col("n") - 1) / 2)).first()[0] or 0
    return {"sources": total["n"], "chars": total["chars"] or 0, "anchors": n / share, "pairs": pairs / share**2}
