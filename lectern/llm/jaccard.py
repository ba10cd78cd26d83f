"""N-gram Jaccard self-join: MinHash banding, then verification on full n-gram sets.

Texts with the same n-gram set are one class, with the least doc_id as its
representative; only representatives are joined. Bands and rows are the cheapest
that find a pair at the threshold with the target recall. Representatives are
shuffled on band hashes, and a bucket gives one edge from its least member to
each other member, never all pairs. Documents that buckets connect are compared
with each other on their whole n-gram sets, in tasks of bounded size: a
connected group above the bound is split into blocks, and two blocks are a task
of the members that share a bucket across them. A task counts links by matrix products and emits, instead of pairs, each
document's number of links and a spanning forest of the links it found.

Words are runs of ASCII letters and digits and other characters, lower case, so
punctuation and case do not matter. A text of fewer words than n has them all as
its one n-gram.

Defined results: null text is empty; a text without words is alone in its class
and has no links; rows without a doc_id are no part of any class (class_id is
null); of rows that repeat a doc_id with other texts, all share the doc_id's
classes; an empty table returns no rows. Further input columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm import kernels
from lectern.llm.storage import stored
from lectern.operators.components import components

SIGNED = "doc_id long, key binary, n_grams long, bands array<long>"
FOUND = "a long, b long, text_links long, doc_links long"
#: n-grams that a block of documents has together, about; a task holds two blocks.
BLOCK = 150_000
_rng = np.random.Generator(np.random.PCG64(5489))
_MULTIPLY = _rng.integers(0, 2**31, 1024, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_ADD = _rng.integers(0, 2**32, 1024, dtype=np.uint32)
_COMBINE = _rng.integers(0, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def banding(threshold: float, recall: float, noise: float = 0.15, most: int = 1024) -> tuple[int, int]:
    """(bands, rows): the fewest hashes with ``recall`` at the threshold and at most
    ``noise`` candidates at five eighths of it, else the most selective that fit."""
    best = None
    for rows in range(1, 33):
        chance = threshold**rows
        bands = 1 if chance >= recall else int(np.ceil(np.log1p(-recall) / np.log1p(-chance)))
        if bands * rows > most:
            break
        false = 1 - (1 - (threshold * 0.625) ** rows) ** bands
        if best is None or best[2] > noise:
            best = (bands, rows, false)
    return best[0], best[1]


def grams(text: str, n: int) -> np.ndarray:
    """The sorted distinct hashes of a text's n-grams."""
    words, _, _ = kernels.hashed_words(text.lower().encode(), kernels.PLAIN)
    if not len(words):
        return words
    return np.unique(kernels.window_hashes(words, min(n, len(words))))


def key_of(own: np.ndarray) -> bytes:
    return hashlib.blake2b(own.tobytes(), digest_size=16).digest()


def bands_of(own: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A hash for each band of a MinHash signature."""
    short = (own >> np.uint64(32)).astype(np.uint32)
    count = bands * rows
    least = np.empty(count, dtype=np.uint32)
    step = max(1, (1 << 17) // max(1, len(short)))
    for at in range(0, count, step):
        to = min(count, at + step)
        least[at:to] = (short[None, :] * _MULTIPLY[at:to, None] + _ADD[at:to, None]).min(axis=1)
    mixed = (least.reshape(bands, rows).astype(np.uint64) * _COMBINE[:rows]).sum(axis=1, dtype=np.uint64)
    return kernels.mix(mixed + np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def _signed(docs: DataFrame, n: int, bands: int, rows: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, counts, signatures = [], [], []
            for text in batch.column(1).to_pylist():
                own = grams(text, n)
                keys.append(key_of(own))
                counts.append(len(own))
                signatures.append(bands_of(own, bands, rows).view(np.int64) if len(own) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.binary()), pa.array(counts, pa.int64()), pa.array(signatures, pa.list_(pa.int64()))], ["doc_id", "key", "n_grams", "bands"])

    return _texts(docs).mapInArrow(run, SIGNED)


def _linked(left: list[np.ndarray], right: list[np.ndarray] | None, threshold: float) -> np.ndarray:
    """Which texts of ``left`` and ``right`` (None: the same) reach the threshold, as a matrix."""
    both = left if right is None else left + right
    sizes = np.array([len(x) for x in both])
    joined = np.concatenate(both)
    owner = np.repeat(np.arange(len(both)), sizes)
    order = np.argsort(joined, kind="stable")
    joined, owner = joined[order], owner[order]
    new = np.concatenate(([True], joined[1:] != joined[:-1]))
    number = np.cumsum(new) - 1
    shared = np.bincount(number) > 1  # n-grams of one text alone are in no intersection
    column = np.cumsum(shared) - 1
    keep = shared[number]
    owner, column = owner[keep], column[number[keep]]
    n_left = len(left)
    common = np.zeros((n_left, len(both) - (0 if right is None else n_left)), dtype=np.float32)
    width = max(64, (1 << 22) // len(both))
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        a, b = np.searchsorted(column, (low, low + width))
        dense = np.zeros((len(both), width), dtype=np.float32)
        dense[owner[a:b], column[a:b] - low] = 1
        common += dense[:n_left] @ (dense if right is None else dense[n_left:]).T
    union = sizes[:n_left, None] + (sizes if right is None else sizes[n_left:])[None, :] - common
    linked = common >= threshold * union - 1e-6
    if right is None:
        np.fill_diagonal(linked, False)
    return linked


def _compare(left: list[tuple], right: list[tuple] | None, threshold: float) -> list[tuple]:
    """Rows of ``FOUND`` for one task; members are (doc_id, copies, grams, key)."""
    linked = _linked([m[2] for m in left], None if right is None else [m[2] for m in right], threshold)
    others = left if right is None else right
    copies_left, copies_right = np.array([m[1] for m in left]), np.array([m[1] for m in others])
    out = []
    for members, texts, documents in ((left, linked.sum(axis=1), linked @ copies_right), (others, linked.sum(axis=0), copies_left @ linked)):
        out += [(m[0], None, int(t), int(d)) for m, t, d in zip(members, texts, documents, strict=True) if t]
        if right is None:
            break
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i, j in zip(*np.nonzero(linked), strict=True):
        a, b = left[i][0], others[j][0]
        x, y = root(a), root(b)
        if x != y:
            parent[max(x, y)] = min(x, y)
            out.append((a, b, 0, 0))
    return out


def _verified(members: DataFrame, n: int, threshold: float) -> DataFrame:
    """``members``: (task, low, high, block, doc_id, key, copies, text), grouped by task here."""
    names = ["a", "b", "text_links", "doc_links"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, left, right = None, [], []

        def close() -> list[tuple]:
            if task is None:
                return []
            if task[1] == task[2]:
                return _compare(left, None, threshold) if len(left) > 1 else []
            return _compare(left, right, threshold) if left and right else []

        for batch in batches:
            out = []
            for component, low, high, block, doc_id, key, copies, text in zip(*(batch.column(i).to_pylist() for i in range(8)), strict=True):
                if (component, low, high) != task:
                    out += close()
                    task, left, right = (component, low, high), [], []
                own = grams(text, n)
                if key_of(own) == key:  # else another text with the same doc_id
                    side = left if block == low else right
                    if not side or (side[-1][0], side[-1][3]) != (doc_id, key):  # a repeated row
                        side.append((doc_id, copies, own, key))
            yield _rows(out)
        yield _rows(close())

    def _rows(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out, strict=True) if out else [()] * 4)], names)

    order = ["component", "low", "high"]
    # as many tasks as the session sets, not as few as the bytes would do: comparing costs more than reading
    shares = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = members.select(*order, "block", "doc_id", "key", "copies", "text").repartition(shares, *order).sortWithinPartitions(*order, "doc_id", "key")
    return dealt.mapInArrow(run, FOUND)


def _tasks(classes: DataFrame, slots: DataFrame, connected: DataFrame) -> DataFrame:
    """Who is compared with whom: (component, low, high, block, doc_id, key, copies).

    Every member goes to the task of its own block. A component of several
    blocks has a task for two of them too, and that gets only the members that
    share a bucket with the other block, so what is shipped grows with the
    candidates and not with the square of a component.
    """
    nodes = classes.select("key", F.col("representative").alias("node"), "copies", "n_grams").join(connected, "node")
    sizes = nodes.groupBy("component").agg(F.ceil(F.sum("n_grams") / BLOCK).alias("blocks"))
    nodes = stored(nodes.join(sizes, "component").withColumn("block", F.pmod(F.xxhash64("node"), "blocks")), "members")
    own = nodes.select("component", F.col("block").alias("low"), F.col("block").alias("high"), "block", F.col("node").alias("doc_id"), "key", "copies")
    several = nodes.where("blocks > 1").select("node", "component", "block")
    if several.isEmpty():
        return own
    split = stored(slots.withColumnRenamed("representative", "node").join(several, "node"), "split")
    # a bucket lies in one component and has each of its blocks once
    reached = stored(split.groupBy("band").agg(F.collect_set("block").alias("others")).where(F.size("others") > 1), "reached")
    shared = split.join(reached.hint("merge"), "band").groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("others"))).alias("others"))
    across = nodes.join(shared, "node").withColumn("other", F.explode("others")).where("other <> block")
    return own.unionByName(across.select("component", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", F.col("node").alias("doc_id"), "key", "copies"))


def _classed(docs: DataFrame, n: int, threshold: float, recall: float) -> DataFrame:
    """One row per row of ``docs``: the columns of ``join``, with the key of its n-gram set and their number."""
    bands, rows = banding(threshold, recall)
    signed = stored(_signed(docs, n, bands, rows), "signed")
    classes = signed.where("n_grams > 0 and doc_id is not null").groupBy("key").agg(
        F.min("doc_id").alias("representative"), F.count(F.lit(1)).alias("copies"), F.first("n_grams").alias("n_grams"), F.first("bands").alias("bands")
    )
    classes = stored(classes, "classes")
    slots = classes.select("representative", F.explode("bands").alias("band"))
    # written, so that the join's sides are both shuffled as they are and a bucket of many can be split; merged at
    # every size, so that a small run has the plan of a large one
    buckets = stored(slots.groupBy("band").agg(F.min("representative").alias("hub"), F.max("representative").alias("last")).where("hub < last").select("band", "hub"), "buckets")
    candidates = slots.join(buckets.hint("merge"), "band").select(F.col("hub").alias("a"), F.col("representative").alias("b"))
    connected = stored(components(candidates), "candidates")
    members = _texts(docs).join(_tasks(classes, slots, connected).hint("merge"), "doc_id")
    found = stored(_verified(members, n, threshold), "links")
    links = found.where("b is null").groupBy(F.col("a").alias("representative")).agg(F.sum("text_links").alias("text_links"), F.sum("doc_links").alias("doc_links"))
    grouped = components(found.where("b is not null")).select(F.col("node").alias("representative"), F.col("component").alias("class_id"))
    per_class = classes.select("key", "representative", "copies").join(links, "representative", "left").join(grouped, "representative", "left")
    joined = signed.select("doc_id", F.when(F.col("doc_id").isNotNull(), F.col("key")).alias("key"), "n_grams").join(stored(per_class, "by_key").hint("merge"), "key", "left")
    return joined.select(
        "doc_id",
        F.coalesce("class_id", "representative", "doc_id").alias("class_id"),
        F.coalesce("representative", "doc_id").alias("representative"),
        F.when(F.col("doc_id").isNotNull(), F.coalesce("copies", F.lit(1))).alias("n_copies"),
        F.coalesce("text_links", F.lit(0)).alias("n_text_links"),
        (F.coalesce("doc_links", F.lit(0)) + F.coalesce("copies", F.lit(1)) - 1).alias("n_links"),
        "key",
        "n_grams",
    )


def join(docs: DataFrame, n: int = 5, threshold: float = 0.8, recall: float = 0.999) -> DataFrame:
    """One row per document: doc_id, class_id, representative, n_copies, n_text_links, n_links.

    class_id: least doc_id of the documents that links connect. n_text_links:
    other n-gram sets that reach the threshold; n_links: other documents, copies
    included.
    """
    return _classed(docs, n, threshold, recall).drop("key", "n_grams")


def keep(docs: DataFrame, n: int = 5, threshold: float = 0.8, recall: float = 0.999) -> DataFrame:
    """``docs`` with one row of each class: that of its least doc_id.

    All columns are kept. Rows that repeat a doc_id count by their own text: of
    the class's least doc_id the rows stay whose text is in the class and in no
    smaller document, one for each n-gram set, the first by text. Texts without
    a word stay once for each doc_id. Rows without a doc_id stay, as they are in
    no class.
    """
    rows = stored(_classed(docs, n, threshold, recall).select("doc_id", "class_id", "representative", "key", "n_grams"), "kept")
    # doc_ids with several n-gram sets: only their rows are looked at again
    many = rows.groupBy("doc_id").agg((F.min("key") != F.max("key")).alias("__kept_many"))
    least = rows.where("doc_id = class_id and doc_id = representative").select("doc_id", F.col("key").alias("__kept_key"), (F.col("n_grams") == 0).alias("__kept_plain")).distinct()
    least = least.join(many, "doc_id").withColumnRenamed("doc_id", "__kept_id")

    @F.pandas_udf("binary")
    def key(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else key_of(grams(t, n)))

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    joined = docs.join(least, docs["doc_id"].cast("long") == least["__kept_id"]).withColumn("__kept_own", key(F.when(F.col("__kept_many"), text)))
    own = joined.where("not __kept_many or __kept_own = __kept_key")
    number = F.row_number().over(Window.partitionBy("__kept_id", "__kept_key", F.when(F.col("__kept_plain"), text)).orderBy("text"))
    kept = own.withColumn("__kept_number", number).where("__kept_number = 1").select([F.col(f"`{c}`") for c in docs.columns])
    return kept.unionByName(docs.where("doc_id is null"))
