"""Substring deduplication by level-wise doubling.

Windows repeated at one length alone are extended to twice that length. The
first level looks at windows of half the target length and, of those, at the
winnowed ones: every window of the target length has one, the least hash in it,
and equal windows have equal ones, so nothing repeated is missed. Only the
target's windows whose own winnowed window occurs in two texts are made; those
that occur in two documents are the repeats. ``longest`` doubles on from there, until
no candidates survive.

Copies of a whole text are one class: its least doc_id stands for it, and every
other copy of at least the target's length goes as a whole.

Words are maximal runs of anything but the six ASCII white space characters,
unchanged. Windows are compared by 128 bits of hash.

Defined results: null text has no words; texts shorter than a window keep all;
rows without a doc_id lose nothing and take nothing; rows that repeat a doc_id
are documents of their own that never take words from each other; an empty table
returns no rows. Further input columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm import kernels
from lectern.llm.storage import stored

WORD = ~kernels.SPACE
EMPTY = hashlib.sha256(b"").hexdigest()
SCANNED = "doc_id long, key binary, n_words long, sha256 string, text_class long, anchors array<long>, places array<int>"
#: Bits of the filter that spares the shuffle of texts without candidates: 8 MB at every size.
FILTER_BITS = 1 << 26
WINDOWS = "doc_id long, text string, text_class long, starts array<int>, first array<long>, second array<long>"
CUT = "doc_id long, key binary, n_removed long, kept_sha256 string"


def _lists(parts: list[np.ndarray], kind) -> pa.ListArray:
    offsets = np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype(np.int32)
    values = np.concatenate(parts) if parts else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.astype(kind)))


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def _digest(data: bytes):
    """The hash of a text's words, and the first half of it as a number: texts with equal words are one class."""
    digest = hashlib.sha256(b" ".join(data.split()))
    return digest, int.from_bytes(digest.digest()[:8], "little", signed=True)


def _scan(docs: DataFrame, length: int) -> DataFrame:
    """Each document's words in brief, and its winnowed windows of half the length."""
    half = (length + 1) // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, counts, digests, classes, anchors, places = [], [], [], [], [], []
            for data in kernels.texts(batch.column(1)):
                words, _, _ = kernels.hashed_words(data, WORD)
                digest, text_class = _digest(data)
                hashes = kernels.window_hashes(words, half)
                at = kernels.winnowed(hashes, length - half + 1)
                keys.append(digest.digest()[:16])
                classes.append(text_class)
                counts.append(len(words))
                digests.append(digest.hexdigest())
                anchors.append(hashes[at].view(np.int64))
                places.append(at)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(keys, pa.binary()), pa.array(counts, pa.int64()), pa.array(digests, pa.string()), pa.array(classes, pa.int64()), _lists(anchors, np.int64), _lists(places, np.int32)],
                ["doc_id", "key", "n_words", "sha256", "text_class", "anchors", "places"],
            )

    return _texts(docs).mapInArrow(run, SCANNED)


def _repeated(rows: DataFrame, keys: list[str], of: str = "doc_id") -> DataFrame:
    """The keys that two documents have, with the least of them; aggregated before they are shuffled."""
    return rows.groupBy(*keys).agg(F.min(of).alias("least"), F.max(of).alias("most")).where("least < most").select(*keys, "least")


def _among(ids: DataFrame):
    """A column function: false only for doc_ids that are not in ``ids``.

    A bit array of fixed size, made by one aggregation; it is there to keep
    texts out of a shuffle, and the join after it is what decides.
    """
    bit = F.pmod(F.xxhash64("doc_id"), F.lit(FILTER_BITS))
    rows = ids.select(bit.alias("bit")).selectExpr("shiftright(bit, 6) as word", "shiftleft(1L, cast(bit & 63 as int)) as bit")
    found = rows.groupBy("word").agg(F.bit_or("bit").alias("bits")).toPandas()  # FILTER_BITS / 64 rows at most
    filled = np.zeros(FILTER_BITS // 64, dtype=np.int64)
    filled[found["word"].to_numpy(dtype=np.int64)] = found["bits"].to_numpy(dtype=np.int64)

    @F.pandas_udf("boolean")
    def among(bits: pd.Series) -> pd.Series:
        at = bits.to_numpy(dtype=np.int64)
        return pd.Series((filled[at >> 6] >> (at & 63)) & 1 == 1)

    return among(bit)


def _extended(candidates: DataFrame, length: int) -> DataFrame:
    """The windows of ``length`` whose winnowed window of half the length is repeated."""
    half = (length + 1) // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            classes, starts, first, second = [], [], [], []
            for data, at in zip(kernels.texts(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                words, _, _ = kernels.hashed_words(data, WORD)
                own = np.zeros(0, dtype=np.int64)
                if len(words) >= length:
                    halves = kernels.window_hashes(words, half)
                    at = np.array(at, dtype=np.int64)
                    at = at[at < len(halves)]
                    repeated = np.full(len(halves), np.iinfo(np.uint64).max, dtype=np.uint64)
                    repeated[at] = halves[at]
                    width = length - half + 1
                    own = np.flatnonzero(kernels.sliding(repeated, width, np.minimum) == kernels.sliding(halves, width, np.minimum))
                classes.append(_digest(data)[1])
                starts.append(own)
                first.append(kernels.window_hashes(words, length)[own].view(np.int64) if len(own) else own)
                second.append(kernels.window_hashes(words, length, other=True)[own].view(np.int64) if len(own) else own)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(classes, pa.int64()), _lists(starts, np.int32), _lists(first, np.int64), _lists(second, np.int64)], ["doc_id", "text", "text_class", "starts", "first", "second"]
            )

    return candidates.select("doc_id", "text", "places").mapInArrow(run, WINDOWS)


def _cut(rows: DataFrame, length: int) -> DataFrame:
    """What is left of each text without the words of its windows at ``starts``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, removed, digests = [], [], []
            for data, starts in zip(kernels.texts(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                words = data.split()
                cover = np.zeros(len(words) + 1, dtype=np.int64)
                starts = np.array(starts, dtype=np.int64)
                np.add.at(cover, starts[starts < len(words)], 1)
                ends = starts + length
                np.add.at(cover, np.minimum(ends, len(words)), -1)
                gone = np.cumsum(cover)[: len(words)] > 0
                kept = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                keys.append(hashlib.sha256(b" ".join(words)).digest()[:16])
                removed.append(int(gone.sum()))
                digests.append(hashlib.sha256(b" ".join(kept)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.binary()), pa.array(removed, pa.int64()), pa.array(digests, pa.string())], ["doc_id", "key", "n_removed", "kept_sha256"])

    return rows.select("doc_id", "text", "starts").mapInArrow(run, CUT)


def _windows(docs: DataFrame, scanned: DataFrame, length: int, of: str = "text_class") -> DataFrame:
    """Windows of ``length`` around the repeated windows of half the length, by document.

    Half windows count as repeated if two different texts have them, so copies
    of a whole text make no candidates of each other; of copies, the
    representative alone goes on. With ``of`` doc_id, copies are documents like
    any others.
    """
    anchors = scanned.select("doc_id", "text_class", F.explode(F.arrays_zip("anchors", "places")).alias("a"))
    anchors = anchors.select("doc_id", "text_class", F.col("a.anchors").alias("anchor"), F.col("a.places").alias("place"))
    # repeated keys are written before they are joined: then both sides of the join are shuffled as they are,
    # and adaptive execution can split a passage that very many documents share
    repeated = stored(_repeated(anchors.select("anchor", of), ["anchor"], of).select("anchor"), "anchors").hint("merge")
    places = anchors.select("anchor", "doc_id", "place").join(repeated, "anchor").groupBy("doc_id").agg(F.collect_list("place").alias("places"))  # a document's own
    single = scanned.where("least is null or least = doc_id").select("doc_id").distinct()
    places = stored(places.join(single, "doc_id"), "places")
    return stored(_extended(_texts(docs).where(_among(places)).join(places, "doc_id"), length), "windows")


def _classes(scanned: DataFrame) -> DataFrame:
    """``scanned`` with the least doc_id of copies of the whole text (null: no copies)."""
    copies = stored(scanned.groupBy("key").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1").select("key", "least"), "copies").hint("merge")
    return scanned.join(copies, "key", "left")


def deduplicate(docs: DataFrame, length: int = 50) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256.

    A word goes if it lies in a window whose words also start in a document with
    a smaller doc_id.
    """
    scanned = _classes(stored(_scan(docs, length), "substrings"))
    windows = _windows(docs, scanned, length)
    each = windows.select("doc_id", "text_class", F.explode(F.arrays_zip("starts", "first", "second")).alias("w")).select("doc_id", "text_class", "w.*")
    repeats = stored(_repeated(each, ["first", "second"]), "repeats").hint("merge")
    later = each.join(repeats, ["first", "second"]).where("doc_id > least")
    starts = later.groupBy("doc_id", "text_class").agg(F.collect_set("starts").alias("starts"))
    cut = _cut(windows.select("doc_id", "text_class", "text").join(starts, ["doc_id", "text_class"]), length).dropDuplicates(["doc_id", "key"])
    whole = (F.col("least") < F.col("doc_id")) & (F.col("n_words") >= length)
    return scanned.join(cut, ["doc_id", "key"], "left").select(
        "doc_id",
        "n_words",
        F.when(whole, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(whole, F.lit(EMPTY)).otherwise(F.coalesce("kept_sha256", "sha256")).alias("kept_sha256"),
    )


def longest(docs: DataFrame, length: int = 50) -> DataFrame:
    """One row per document with a repeat: doc_id and the greatest ``length`` * 2**k of its repeated windows.

    From ``length`` on, a window of twice a length is a candidate only if both
    its halves are repeated, and its hash is made from theirs; the loop ends
    when no candidate survives.
    """
    scanned = stored(_scan(docs, length), "substrings").withColumn("least", F.lit(None).cast("long"))
    windows = _windows(docs, scanned, length, "doc_id")
    level = windows.select("doc_id", F.explode(F.arrays_zip("starts", "first", "second")).alias("w")).select("doc_id", F.col("w.starts").alias("start"), F.col("w.first").alias("first"), F.col("w.second").alias("second"))
    found = None
    while True:
        repeats = stored(_repeated(level, ["first", "second"]).select("first", "second"), "repeats").hint("merge")
        level = stored(level.join(repeats, ["first", "second"]), "level")
        best = level.select("doc_id").distinct().withColumn("repeated", F.lit(length).cast("long"))
        if level.isEmpty():
            break
        found = best if found is None else found.unionByName(best)
        after = level.select("doc_id", (F.col("start") - length).alias("start"), F.col("first").alias("f"), F.col("second").alias("s"))
        level = level.join(after, ["doc_id", "start"]).select("doc_id", "start", F.xxhash64("first", "f").alias("first"), F.xxhash64("s", "second").alias("second"))
        length *= 2
    found = best if found is None else found
    return found.groupBy("doc_id").agg(F.max("repeated").alias("repeated"))
