"""Document fingerprints: a Merkle tree over sections and paragraphs.

A text is cut into sections (at blank lines), paragraphs (lines) and leaves
(sentences, long ones at every 16th word); each inner node hashes its children.
Equal roots mean equal texts. Where roots differ, only differing branches are
opened, and their leaves locate the edit. Likeness is the share of text in
common leaves, counted with repeats: 2 * common / (length a + length b).

Defined results: null text is empty; an empty text has one empty section, and
two empty texts are alike (1.0). Repeated rows are documents of their own;
neighbours go by doc_id descending, then text; null doc_ids come last. A single
document is its own neighbour. Further input columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.storage import stored

_SECTION = re.compile(r"(?<=\n)(?=\n)")


def _hash(kind: bytes, data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16, person=kind).digest()


@dataclass
class Tree:
    """A node: its hash, where it lies in the text, and its children (none: a leaf)."""

    digest: bytes
    start: int
    end: int
    children: list[Tree] = field(default_factory=list)

    def leaves(self) -> Iterator[Tree]:
        if not self.children:
            yield self
        for child in self.children:
            yield from child.leaves()


def _leaves(paragraph: str) -> list[str]:
    """Runs of words up to a sentence's end, 16 words at most; they join to the paragraph."""
    parts, at, count = [], 0, 0
    words = paragraph.split(" ")
    for i, word in enumerate(words):
        count += 1
        if count == 16 or word[-1:] in ".!?":
            parts.append(" ".join(words[at : i + 1]) + (" " if i + 1 < len(words) else ""))
            at, count = i + 1, 0
    if at < len(words):
        parts.append(" ".join(words[at:]))
    return parts


def tree(text: str) -> Tree:
    sections, at = [], 0
    for section in _SECTION.split(text):
        paragraphs, section_start = [], at
        for paragraph in section.splitlines(keepends=True) if section else [""]:
            leaves, start = [], at
            for leaf in _leaves(paragraph):
                leaves.append(Tree(_hash(b"leaf", leaf.encode()), at, at + len(leaf)))
                at += len(leaf)
            paragraphs.append(Tree(_hash(b"paragraph", b"".join(x.digest for x in leaves)), start, at, leaves))
        sections.append(Tree(_hash(b"section", b"".join(x.digest for x in paragraphs)), section_start, at, paragraphs))
    return Tree(_hash(b"text", b"".join(x.digest for x in sections)), 0, at, sections)


def differences(a: Tree, b: Tree) -> tuple[list[Tree], list[Tree]]:
    """Leaves of ``a`` and of ``b`` that the other lacks, opening differing branches alone."""
    if a.digest == b.digest:
        return [], []
    if not a.children or not b.children:
        return list(a.leaves()), list(b.leaves())
    have_a, have_b = Counter(x.digest for x in a.children), Counter(x.digest for x in b.children)
    only_a, only_b = _surplus(a.children, have_b), _surplus(b.children, have_a)
    leaves_a, leaves_b = [y for x in only_a for y in x.leaves()], [y for x in only_b for y in x.leaves()]
    return _surplus(leaves_a, Counter(x.digest for x in leaves_b)), _surplus(leaves_b, Counter(x.digest for x in leaves_a))


def _surplus(nodes: list[Tree], other: Counter) -> list[Tree]:
    left, out = Counter(other), []
    for node in nodes:
        if left[node.digest] > 0:
            left[node.digest] -= 1
        else:
            out.append(node)
    return out


def compared(a: Tree, b: Tree) -> tuple[float, list[Tree]]:
    """Likeness (1 for equal texts, 0 for texts without a common leaf), and the leaves of ``a`` that differ."""
    only_a, only_b = differences(a, b)
    size = a.end + b.end
    if a.digest == b.digest or not size:
        return 1.0, []
    return (size - sum(x.end - x.start for x in only_a) - sum(x.end - x.start for x in only_b)) / size, only_a


def likeness(a: Tree, b: Tree) -> float:
    return compared(a, b)[0]


def edited(text: str, following: str) -> str:
    """The last floor(n/2) characters replaced by the first as many of the next text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


NAMES = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "differs_from", "differs_to"]
TYPES = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64(), pa.int64()]
RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, differs_from long, differs_to long"


def _row(doc_id, text: str, own: Tree, following: str, next_tree: Tree) -> tuple:
    changed = edited(text, following)
    changed_tree = tree(changed)
    near, places = compared(own, changed_tree)
    located = (min(x.start for x in places), max(x.end for x in places)) if places else (None, None)
    return (doc_id, len(text), hashlib.sha256(changed.encode()).hexdigest(), own.digest.hex(), changed_tree.digest.hex(), near, likeness(own, next_tree), *located)


def _open(doc_id, text: str, own: Tree) -> tuple:
    """The row of a document whose neighbour is not at hand yet."""
    return (doc_id, len(text), "", own.digest.hex(), "", 0.0, 0.0, None, None)


def _batch(rows: list[tuple], more: list[tuple] | None = None) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(NAMES)
    arrays = [pa.array(c, t) for c, t in zip(columns, TYPES, strict=True)]
    if more is None:
        return pa.RecordBatch.from_arrays(arrays, NAMES)
    extra = list(zip(*more, strict=True)) or [(), ()]
    return pa.RecordBatch.from_arrays([*arrays, pa.array(extra[0], pa.string()), pa.array(extra[1], pa.string())], [*NAMES, "edge", "edge_text"])


#: Characters of a text that order rows with the same doc_id between partitions.
PREFIX = 64


def fingerprints(docs: DataFrame) -> DataFrame:
    """One row per document: ``RESULT``.

    ``fingerprint`` is the tree's root, so it tests equality; likeness and the
    place of the edit (``differs_from``, ``differs_to``: the code points from the
    first to the last leaf that the edited text lacks, null if none) come from
    the two trees, whose differing branches are opened.

    Texts are range partitioned by doc_id (rows that share one, by the text's
    first characters), the one shuffle of texts; each task walks its documents
    in order with two of them in hand. The first and last document of each
    partition are kept aside, and pairs that span partitions are made from
    those, two rows for each partition; their ids are put in order without
    their texts.
    """
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    down = F.col("doc_id").desc_nulls_last()
    ordered = ordered.repartitionByRange(down, F.left("text", F.lit(PREFIX))).sortWithinPartitions(down, "text")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None
        for batch in batches:
            rows, edges = [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = tree(text)
                if before is None:
                    rows.append(_open(doc_id, text, own))
                    edges.append(("head", text))
                else:
                    rows.append(_row(*before, text, own))
                    edges.append(("", ""))
                before = (doc_id, text, own)
            yield _batch(rows, edges)
        if before is not None:
            yield _batch([_open(*before)], [("tail", before[1])])

    walked = stored(ordered.mapInArrow(walk, RESULT + ", edge string, edge_text string"), "fingerprints")
    begins = F.left("edge_text", F.lit(PREFIX)).alias("begins")
    heads, tails = (walked.where(F.col("edge") == kind).select("doc_id", begins, F.col("edge_text").alias("text")) for kind in ("head", "tail"))
    # Partitions in order: the head of the next one follows each tail; the first head follows the last tail.
    order = [down, F.col("begins")]
    by = Window.orderBy(*order)
    head_ids, tail_ids = (x.drop("text").withColumn("part", F.row_number().over(by)) for x in (heads, tails))
    parts = F.count(F.lit(1)).over(Window.partitionBy())
    before_head = F.when(F.col("part") == 1, F.col("parts")).otherwise(F.col("part") - 1)
    after = head_ids.withColumn("parts", parts).select(before_head.alias("part"), F.col("doc_id").alias("next_id"), F.col("begins").alias("next_begins"))
    places = tail_ids.join(after, "part").select(F.col("doc_id").alias("tail_id"), F.col("begins").alias("tail_begins"), "next_id", "next_begins")
    pairs = tails.join(places, F.col("doc_id").eqNullSafe(F.col("tail_id")) & (F.col("begins") == F.col("tail_begins"))).select("doc_id", "text", "next_id", "next_begins")
    following = heads.select(F.col("doc_id").alias("head_id"), F.col("begins").alias("head_begins"), F.col("text").alias("following"))
    pairs = pairs.join(following, F.col("next_id").eqNullSafe(F.col("head_id")) & (F.col("next_begins") == F.col("head_begins"))).select("doc_id", "text", "following")

    def span(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text, following in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                rows.append(_row(doc_id, text, tree(text), following, tree(following)))
            yield _batch(rows)

    return walked.where("edge = ''").select(*NAMES).unionByName(pairs.mapInArrow(span, RESULT))
