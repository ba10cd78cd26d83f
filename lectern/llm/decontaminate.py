"""Benchmark decontamination by latent semantic retrieval.

Benchmark passages become TF-IDF vectors over their own terms, with document
frequencies from the whole corpus. A distributed randomised SVD of these
passages gives a latent basis; every window of every document is projected on
it and compared with all passages by cosine and by how much of a passage's
latent weight it holds. Candidates are then read: the longest common subsequence
of words must cover enough of the passage, or, for a paraphrase, less of the
passage but nearly all of its answer (a column ``answer`` if there is one, else
what follows "Answer:", else the last of several sentences, else the last third
of the words of a passage of ``PLAIN`` words or more).

The benchmark is taken in blocks of a bounded number of passages and bytes, and a
block in rounds of ``GROUPS`` groups of ``RANK`` units, a round held by every task,
so its size bounds no memory. Each group has a basis of its own with as many
dimensions as it has units, so cosines and weights are exact at any size. Document
frequencies are counted once, in a pass for every ``TERMS`` distinct words of the
benchmark, and a round reads the documents once. Passages longer than ``UNIT`` words are searched for by parts of at most so many, as a window holds no more of
them, and read as a whole wherever one part is a candidate. Passages shorter than
``SHORT`` words must occur whole and unbroken.

Defined results: null or empty passages and texts match nothing; rows that
repeat an item_id or a doc_id are matched each, and reported once for a pair;
null ids are kept as they are; an empty table on either side gives no rows.
Further input columns are not read.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import kernels
from lectern.llm.storage import stored

#: Passages and bytes of text in a block of the benchmark.
BLOCK_ITEMS, BLOCK_BYTES = 2048, 1 << 19
SHORT = 8
STEP = 32  # words; a window has two steps
UNIT = 60  # words that are searched for as one; a window has more than half of them
RANK = 256  # dimensions of a basis, and units that share it
GROUPS = 8  # bases that a task holds at once
TERMS = 1 << 20  # distinct words that are counted in one pass over the documents
PLAIN = 24  # words that a passage of one sentence has at least for its last third to be an answer

FOUND = "doc_id long, item_id long, cosine double, lcs_ratio double, answer_ratio double, first_word long, end_word long"


def words_of(text: str) -> np.ndarray:
    return kernels.hashed_words(text.lower().encode(), kernels.PLAIN)[0]


def answer_of(text: str) -> str:
    """What follows "Answer:" or "A:", else the last of several sentences, else the last third of a long one."""
    marked = re.search(r"(?:^|\n)\s*(?:answer|a)\s*:\s*(.+)\Z", text, re.IGNORECASE | re.DOTALL)
    if marked:
        return marked[1]
    sentences = [s for s in re.split(r"(?<=[.!?])\s+", text.strip()) if s]
    if len(sentences) != 1:
        return sentences[-1] if sentences else ""
    words = text.split()
    return " ".join(words[-(len(words) // 3) :]) if len(words) >= PLAIN else text


class Pattern:
    """A passage's words as bit masks, for longest common subsequences in whole-word steps."""

    def __init__(self, words: np.ndarray):
        self.length = len(words)
        self.masks: dict[int, int] = {}
        for i, word in enumerate(words.tolist()):
            self.masks[word] = self.masks.get(word, 0) | 1 << i

    def lcs(self, other: list[int]) -> int:
        full = (1 << self.length) - 1
        rest = full
        get = self.masks.get
        for word in other:
            mask = get(word)
            if mask:
                hit = rest & mask
                rest = ((rest + hit) | (rest - hit)) & full
        return self.length - rest.bit_count()


@dataclass
class Passage:
    number: int
    item_id: int
    words: np.ndarray
    answer: np.ndarray

    def units(self) -> list[np.ndarray]:
        """Its words in parts of much the same length, ``UNIT`` at most."""
        return np.array_split(self.words, -(-len(self.words) // UNIT))


@dataclass
class Index:
    """A group of passages' units in latent space, with what a task needs to search it."""

    vocabulary: np.ndarray  # sorted word hashes
    basis: np.ndarray  # terms x rank, scaled by idf
    latent: np.ndarray  # units x rank
    passages: list[Passage]  # of each unit

    def __post_init__(self):
        self.norms = np.maximum(np.linalg.norm(self.latent, axis=1), 1e-9).astype(np.float32)
        self.maybe = np.zeros(1 << 16, dtype=bool)
        self.maybe[(self.vocabulary >> np.uint64(48)).astype(np.int64)] = True

    def __getstate__(self):
        return (self.vocabulary, self.basis, self.latent, self.passages)

    def __setstate__(self, state):
        self.vocabulary, self.basis, self.latent, self.passages = state
        self.__post_init__()

    def known(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the words that are terms, and their term numbers."""
        at = np.flatnonzero(self.maybe[(words >> np.uint64(48)).astype(np.int64)])
        term = np.searchsorted(self.vocabulary, words[at])
        term[term == len(self.vocabulary)] = 0
        same = self.vocabulary[term] == words[at]
        return at[same], term[same]

    def windows(self, words: np.ndarray) -> np.ndarray:
        """Latent vectors of a text's windows of two steps, one at each step."""
        steps = max(1, -(-len(words) // STEP))
        total = np.zeros((steps, self.basis.shape[1]), dtype=np.float32)
        at, term = self.known(words)
        for low in range(0, len(at), 1 << 14):  # a bounded part of the text at a time
            part, terms = at[low : low + (1 << 14)] // STEP, term[low : low + (1 << 14)]
            first = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
            total[part[first]] += np.add.reduceat(self.basis[terms], first, axis=0)
        return total if steps == 1 else total[:-1] + total[1:]


def _batches(benchmark: DataFrame) -> Iterator[list]:
    """The benchmark's rows in blocks: (item_id, text, answer)."""
    answer = F.col("answer").cast("string") if "answer" in benchmark.columns else F.lit(None).cast("string")
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"), answer.alias("answer")).where("text is not null and text <> ''")
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("bytes")).first()
    blocks = max(-(-size["n"] // BLOCK_ITEMS), -(-(size["bytes"] or 0) // BLOCK_BYTES))
    for block in range(blocks):
        own = rows if blocks == 1 else rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block)
        yield sorted(map(tuple, own.collect()), key=lambda r: (r[0] is None, r[0], r[1]))


def document_counts(docs: DataFrame, vocabulary: np.ndarray) -> DataFrame:
    """(term, n): how many documents have each word of a sorted vocabulary, and as ``term`` null how many there are."""
    finder = Index(vocabulary, np.zeros((0, 0)), np.zeros((0, 0)), [])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(len(vocabulary), dtype=np.int64), 0
        for batch in batches:
            n += batch.num_rows
            for text in batch.column(0).to_pylist():
                if text:
                    total[np.unique(finder.known(words_of(text))[1])] += 1
        at = np.flatnonzero(total)
        terms = vocabulary[at].view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.concat_arrays([pa.array(terms), pa.nulls(1, pa.int64())]), pa.array(np.append(total[at], n), pa.int64())], ["term", "n"])

    return docs.select(F.col("text").cast("string")).mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))


@dataclass
class Frequencies:
    """Document frequencies of a benchmark's words, as a written table, and the number of documents."""

    table: DataFrame
    documents: int

    @classmethod
    def of(cls, docs: DataFrame, benchmark: DataFrame) -> Frequencies:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = [words_of(text) for text in batch.column(0).to_pylist() if text]
                terms = np.unique(np.concatenate(found)) if found else np.zeros(0, dtype=np.uint64)
                yield pa.RecordBatch.from_arrays([pa.array(terms.view(np.int64))], ["term"])

        terms = stored(benchmark.select(F.col("text").cast("string")).mapInArrow(run, "term long").distinct(), "terms")
        passes = -(-terms.count() // TERMS)
        table = None
        for part in range(passes):
            own = terms if passes == 1 else terms.where(F.pmod(F.xxhash64("term"), F.lit(passes)) == part)
            counted = document_counts(docs, np.sort(own.toArrow().column(0).to_numpy().view(np.uint64)))
            table = counted if table is None else table.unionByName(counted)
        if table is None:
            return cls(terms.withColumn("n", F.lit(0).cast("long")), 0)
        table = stored(table, "frequencies")
        return cls(table, table.where("term is null").agg(F.max("n")).first()[0] or 0)

    def idf(self, vocabulary: np.ndarray) -> np.ndarray:
        """The weights of a round's words, at most ``GROUPS * RANK * UNIT`` of them."""
        own = self.table.sparkSession.createDataFrame(pa.table({"term": pa.array(vocabulary.view(np.int64))}))
        found = self.table.join(F.broadcast(own), "term").select("term", "n").toArrow()
        having = np.zeros(len(vocabulary), dtype=np.int64)
        having[np.searchsorted(vocabulary, found.column(0).to_numpy().view(np.uint64))] = found.column(1).to_numpy()
        return np.maximum(np.log((self.documents + 1) / (having + 0.5)), 0.01)


def randomised_svd(rows: DataFrame, width: int, rank: int, power: int = 2, seed: int = 11) -> np.ndarray:
    """The leading right singular vectors (width x rank) of a matrix of sparse rows.

    ``rows`` has terms array<int> and weights array<float>, each term once. A
    round multiplies a thin random matrix by the matrix and its transpose, row
    by row on the executors; the driver adds up one width x rank table for each
    task and makes it orthonormal.
    """
    rng = np.random.default_rng(seed)
    rank = min(rank, width)
    span = np.linalg.qr(rng.standard_normal((width, rank)))[0]
    for _ in range(power + 1):
        now = span.astype(np.float32)

        def run(batches: Iterator[pa.RecordBatch], now=now) -> Iterator[pa.RecordBatch]:
            total = np.zeros((width, now.shape[1]), dtype=np.float64)
            for batch in batches:
                for terms, weights in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    terms, weights = np.array(terms, dtype=np.int64), np.array(weights, dtype=np.float32)
                    total[terms] += weights[:, None] * (weights @ now[terms])
            yield pa.RecordBatch.from_arrays([pa.array([total.astype(np.float32).tobytes()], pa.binary())], ["part"])

        product = np.zeros((width, rank))
        for part in rows.select("terms", "weights").mapInArrow(run, "part binary").toLocalIterator():
            product += np.frombuffer(part["part"], dtype=np.float32).reshape(width, rank)
        span, upper = np.linalg.qr(product)
        # directions that the matrix does not reach are noise
        span = span[:, np.abs(np.diag(upper)) > 1e-6 * max(1e-12, np.abs(np.diag(upper)).max())]
        rank = span.shape[1]
    return span


def rounds(docs: DataFrame, benchmark: DataFrame, rank: int = RANK) -> Iterator[list[Index]]:
    """Fit the benchmark, block by block, in rounds of ``GROUPS`` groups of ``rank`` units."""
    frequencies = None
    for block in _batches(benchmark):
        frequencies = frequencies or Frequencies.of(docs, benchmark)
        passages = [Passage(n, i, words_of(t), words_of(a if a else answer_of(t))) for n, (i, t, a) in enumerate(block)]
        units = [(p, words) for p in passages if len(p.words) for words in p.units()]
        for low in range(0, len(units), GROUPS * rank):
            own = units[low : low + GROUPS * rank]
            vocabulary = np.unique(np.concatenate([words for _, words in own]))
            idf = frequencies.idf(vocabulary)
            yield [_group(docs.sparkSession, own[at : at + rank], vocabulary, idf) for at in range(0, len(own), rank)]


def _group(spark: SparkSession, units: list[tuple[Passage, np.ndarray]], vocabulary: np.ndarray, idf: np.ndarray) -> Index:
    """Some units' terms with their idf over all documents, and the latent basis that they span."""
    own = np.unique(np.concatenate([words for _, words in units]))
    idf = idf[np.searchsorted(vocabulary, own)]
    rows = []
    for _, words in units:
        terms, counts = np.unique(np.searchsorted(own, words), return_counts=True)
        rows.append((terms, counts * idf[terms]))
    table = spark.createDataFrame([(t.tolist(), w.tolist()) for t, w in rows], "terms array<int>, weights array<float>")
    basis = randomised_svd(table, len(own), len(units))
    latent = np.stack([w @ basis[t] for t, w in rows])
    return Index(own, (basis * idf[:, None]).astype(np.float32), latent.astype(np.float32), [p for p, _ in units])


@dataclass
class Rules:
    """Candidates by ``cosine`` and ``weight``; matches by ``lcs``, or by ``paraphrase`` and ``answer``."""

    cosine: float = 0.25
    weight: float = 0.35
    lcs: float = 0.8
    paraphrase: float = 0.55
    answer: float = 0.8


def _contains(text: list[int], words: list[int]) -> bool:
    first = words[0]
    return any(text[i : i + len(words)] == words for i, w in enumerate(text) if w == first)


def _search(texts: list[tuple], groups: list[Index], rules: Rules) -> list[tuple]:
    """Rows of ``FOUND`` for some texts: (doc_id, word hashes)."""
    best: dict[tuple[int, int], tuple] = {}
    seen: set[tuple[int, int]] = set()  # windows read for a passage, which may be candidates by several units
    if texts:
        for own in groups:
            _search_group(texts, own, rules, best, seen)
    return list(best.values())


def _search_group(texts: list[tuple], own: Index, rules: Rules, best: dict, seen: set) -> None:
    latents = [own.windows(words) for _, words in texts]
    joined = np.concatenate(latents)
    owner = np.repeat(np.arange(len(texts)), [len(x) for x in latents])
    first = np.cumsum([0] + [len(x) for x in latents])
    dots = joined @ own.latent.T
    length = np.maximum(np.linalg.norm(joined, axis=1), 1e-9)
    # dot >= weight * |passage|^2 and dot >= cosine * |passage| * |window|
    need = np.maximum(rules.weight * own.norms[None, :], rules.cosine * length[:, None]) * own.norms[None, :]
    for window, item in zip(*np.nonzero(dots >= need), strict=True):
        text, passage = int(owner[window]), own.passages[item]
        key = (text, passage.number)
        if (int(window), passage.number) in seen or key in best and best[key][3:5] == (1.0, 1.0):  # nothing is better
            continue
        seen.add((int(window), passage.number))
        words = texts[text][1]
        at = (int(window) - int(first[text])) * STEP
        long = len(passage.words) > UNIT
        margin = len(passage.words) if long else max(SHORT, len(passage.words) - STEP // 2)
        low, high = max(0, at - margin), min(len(words), at + 2 * STEP + margin)
        # a common subsequence has no more words than the two share
        if long and np.isin(passage.words, words[low:high]).sum() < rules.paraphrase * len(passage.words):
            continue
        near = words[low:high].tolist()
        if len(passage.words) < SHORT:
            if not _contains(near, passage.words.tolist()):
                continue
            ratio = answer = 1.0
        else:
            ratio = Pattern(passage.words).lcs(near) / len(passage.words)
            if ratio < rules.paraphrase:
                continue
            answer = Pattern(passage.answer).lcs(near) / len(passage.answer) if len(passage.answer) else ratio
            if ratio < rules.lcs and answer < rules.answer:
                continue
        cosine = float(dots[window, item] / (own.norms[item] * length[window]))
        row = (texts[text][0], passage.item_id, min(1.0, cosine), ratio, answer, low, high)
        if key not in best or best[key][3:5] < (ratio, answer):
            best[key] = row


def leaks(docs: DataFrame, benchmark: DataFrame, rules: Rules | None = None, rank: int = RANK) -> DataFrame:
    """One row per document and benchmark item that it holds: ``FOUND``."""
    rules = rules or Rules()
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = None
    for groups in rounds(docs, benchmark, rank):
        part = texts.mapInArrow(_searcher(groups, rules), FOUND)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return docs.sparkSession.createDataFrame([], FOUND)
    best = F.max(F.struct("lcs_ratio", "answer_ratio", "cosine", (-F.col("first_word")).alias("place"), "end_word")).alias("best")
    return found.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "best.cosine", "best.lcs_ratio", "best.answer_ratio", (-F.col("best.place")).alias("first_word"), "best.end_word")


def _searcher(groups: list[Index], rules: Rules):
    names = [field.split()[0] for field in FOUND.split(", ")]
    types = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(some: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*_search(some, groups, rules), strict=True)) or [()] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

        some, size = [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = words_of(text or "")
                if len(words):
                    some.append((doc_id, words))
                    size += len(words)
                if size >= 16_000:
                    yield rows(some)
                    some, size = [], 0
        if some:
            yield rows(some)

    return run


def clean(docs: DataFrame, benchmark: DataFrame, rules: Rules | None = None, rank: int = RANK) -> DataFrame:
    """``docs`` without the documents that hold a benchmark passage.

    All columns are kept. Where the benchmark is one round, rows are judged where
    they lie, without a shuffle. Each further round would be a Python worker more
    in every task, so several rounds write the texts that go by their digests,
    and those are joined: broadcast as long as they are few.
    """
    rules = rules or Rules()
    text_at = docs.columns.index("text")
    found = rounds(docs, benchmark, rank)
    first, second = next(found, None), next(found, None)
    if second is None:
        return docs if first is None else docs.mapInArrow(_filter(first, rules, text_at), docs.schema)
    text = F.col("text").cast("string")
    gone = None
    for groups in itertools.chain([first, second], found):
        part = stored(docs.select(F.md5(text).alias("__gone"), text.alias("text")).mapInArrow(_filter(groups, rules, 1, False), "__gone string, text string").select("__gone").distinct(), "gone")
        gone = part if gone is None else gone.unionByName(part)
    return docs.join(gone.distinct(), F.md5(text) == F.col("__gone"), "left_anti")


def _filter(groups: list[Index], rules: Rules, text_at: int, keep: bool = True):
    """Rows without a passage, or (not ``keep``) those with one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted, some, size = np.full(batch.num_rows, keep), [], 0
            for at, text in enumerate(batch.column(text_at).to_pylist()):
                words = words_of(text or "")
                if len(words):
                    some.append((at, words))
                    size += len(words)
                if size >= 16_000 or at + 1 == batch.num_rows:
                    wanted[[row[0] for row in _search(some, groups, rules)]] = not keep
                    some, size = [], 0
            yield batch.filter(pa.array(wanted))

    return run
