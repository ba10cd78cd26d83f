"""Secret scans: base rules, and a log-likelihood ratio of two character Markov models.

One model describes random strings, the other ordinary identifiers and words.
Both are order-1 chains over the characters of keys, trained
from samples that the base rules label: what a rule captured is a random string,
other tokens are ordinary. A token whose mean ratio and length pass is reported
as ``random`` beside the base spans.

Defined results: null text is empty and has no spans; repeated rows are scanned
each; an empty table trains on the built-in uniform prior and returns no rows.
Further input columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.storage import hash_sample

# The base rules.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # maximal runs, so the same as runs that are tested afterwards
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
KINDS = ("assign", "access", "hex", "random")

#: Tokens that the models judge: long enough, of the alphabet of keys, with a digit in them.
TOKEN = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
_CODE = np.full(256, len(ALPHABET), dtype=np.int64)
_CODE[[ord(c) for c in ALPHABET]] = np.arange(len(ALPHABET))
STATES = len(ALPHABET) + 1

Span = tuple[str, int, int]


def base_spans(text: str) -> list[Span]:
    """Spans of the base rules, sorted by start, then kind."""
    found: list[Span] = []
    low = text.lower()
    if any(word in low for word in ASSIGN_WORDS):
        found += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def merged(spans: list[Span]) -> list[tuple[int, int]]:
    """The places that sorted spans cover, without overlaps."""
    places: list[tuple[int, int]] = []
    for _, start, end in spans:
        if places and start <= places[-1][1]:
            places[-1] = (places[-1][0], max(end, places[-1][1]))
        else:
            places.append((start, end))
    return places


def without(text: str, spans: list[Span]) -> str:
    """The text with a space for every place that spans cover."""
    parts, at = [], 0
    for start, end in merged(spans):
        parts += [text[at:start], " "]
        at = end
    return "".join(parts) + text[at:]


def captured(text: str, spans: list[Span]) -> list[str]:
    """The random strings inside base spans: a rule's value without its keyword."""
    out = []
    for kind, start, end in spans:
        if kind == "assign":
            out.append(ASSIGN.match(text, start)[2])
        else:
            out.append(text[start:end])
    return out


class Markov:
    """An order-1 chain over ``ALPHABET``; what a character was seldom followed by leans on how frequent that is at all."""

    def __init__(self, counts: np.ndarray, lean: float = 5.0):
        plain = counts.sum(axis=0) + 0.5
        plain /= plain.sum()
        self.log = np.log((counts + lean * plain) / (counts.sum(axis=1, keepdims=True) + lean))

    @staticmethod
    def counts(tokens: list[str]) -> np.ndarray:
        total = np.zeros((STATES, STATES))
        for token in tokens:
            code = _CODE[np.frombuffer(token.encode("latin-1", "replace"), dtype=np.uint8)]
            np.add.at(total, (code[:-1], code[1:]), 1)
        return total


class Judge:
    """Random against ordinary, by mean log-likelihood ratio per character."""

    def __init__(self, random: np.ndarray, ordinary: np.ndarray, threshold: float = 0.5):
        self.ratio = Markov(random).log - Markov(ordinary).log
        self.threshold = threshold

    def score(self, token: str) -> float:
        code = _CODE[np.frombuffer(token.encode("latin-1", "replace"), dtype=np.uint8)]
        return float(self.ratio[code[:-1], code[1:]].mean()) if len(code) > 1 else 0.0

    def spans(self, text: str, base: list[Span]) -> list[Span]:
        found, taken, at = [], merged(base), 0
        for m in TOKEN.finditer(text):
            while at < len(taken) and taken[at][1] <= m.start():
                at += 1
            if at < len(taken) and taken[at][0] < m.end():
                continue
            if re.search("[0-9]", m[0]) and re.search("[A-Za-z]", m[0]) and self.score(m[0]) >= self.threshold:
                found.append(("random", m.start(), m.end()))
        return found


def _uniform_prior() -> np.ndarray:
    """A weak prior: keys are near uniform over letters and digits."""
    prior = np.zeros((STATES, STATES))
    prior[:62, :62] = 2.0
    return prior


def train(docs: DataFrame, documents: int = 4000) -> Judge:
    """Fit both chains on about ``documents`` texts at most, chosen by hash.

    The labels come from the base rules. Transition counts are added up on the
    executors; the driver gets one 68 x 68 table for each model.
    """
    texts = docs.select(F.col("text").cast("string").alias("text"), F.col("doc_id").alias("doc_id")).where("text is not null and text <> ''")
    sample = hash_sample(texts, documents, "doc_id", "text").select("text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        random, ordinary = np.zeros((STATES, STATES)), np.zeros((STATES, STATES))
        for batch in batches:
            for text in batch.column(0).to_pylist():
                spans = base_spans(text)
                random += Markov.counts(captured(text, spans))
                ordinary += Markov.counts(re.findall(r"[A-Za-z0-9+/_=-]{4,}", without(text, spans)))
        flat = np.concatenate((random.ravel(), ordinary.ravel()))
        at = np.flatnonzero(flat)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(flat[at])], ["cell", "n"])

    cells = sample.mapInArrow(count, "cell long, n double").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    flat = np.zeros(2 * STATES * STATES)
    for row in cells:
        flat[row["cell"]] = row["n"]
    random, ordinary = flat.reshape(2, STATES, STATES)
    return Judge(random + _uniform_prior(), ordinary)


SCANNED = "doc_id long, n_assign long, n_access long, n_hex long, n_random long, base_sha256 string, spans string"


def digest(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def scan(docs: DataFrame, judge: Judge) -> DataFrame:
    """One row per document: counts by kind, the digest of the base spans, all spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                text = text or ""
                base = base_spans(text)
                more = judge.spans(text, base)
                both = sorted(base + more, key=lambda s: (s[1], KINDS.index(s[0])))
                kinds = [s[0] for s in both]
                rows.append((doc_id, *(kinds.count(k) for k in KINDS), hashlib.sha256(digest(base).encode()).hexdigest(), digest(both)))
            columns = list(zip(*rows, strict=True)) or [()] * 7
            types = [pa.int64()] * 5 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["doc_id", "n_assign", "n_access", "n_hex", "n_random", "base_sha256", "spans"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SCANNED)
