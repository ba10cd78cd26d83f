"""Language ID: script ranges, per-word scores, Viterbi with a switching penalty.

Scripts of a word's first letter narrow the languages it may be in; character
trigrams score it in each of those; Viterbi, paying a penalty for every change
of language, labels spans of mixed text. The document's language is the label of
most of its letters.

Defined results: null texts and texts without a letter are ``und`` with score 0
and no spans; rows without a lang are predicted but never learned from; with
nothing to learn from every document is ``und``; words in a script that no
learned language uses have no language: their spans are ``und``, they count in the
score's letters, and a text of them alone is ``und`` with score 0; repeated rows are predicted
each; an empty table returns no rows. Only doc_id, text and, for learning, lang
are read.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNKNOWN = "und"
# Code point ranges of scripts.
SCRIPTS = {
    "latin": ((0x41, 0x24F), (0x1E00, 0x1EFF)),
    "greek": ((0x370, 0x3FF), (0x1F00, 0x1FFF)),
    "cyrillic": ((0x400, 0x52F),),
    "armenian": ((0x530, 0x58F),),
    "hebrew": ((0x590, 0x5FF),),
    "arabic": ((0x600, 0x6FF), (0x750, 0x77F)),
    "devanagari": ((0x900, 0x97F),),
    "bengali": ((0x980, 0x9FF),),
    "tamil": ((0xB80, 0xBFF),),
    "thai": ((0xE00, 0xE7F),),
    "georgian": ((0x10A0, 0x10FF),),
    "hangul": ((0x1100, 0x11FF), (0xAC00, 0xD7AF)),
    "kana": ((0x3040, 0x30FF),),
    "han": ((0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0x20000, 0x3FFFF)),
}
OTHER_SCRIPT = len(SCRIPTS)
#: Planes 0 to 3 hold all letters. Of the others, the supplement of variation selectors is marks.
_TABLE = 0x40000
_SELECTORS = (0xE0100, 0xE01EF)
_BUCKETS = 1 << 16
#: The most that one word can speak against a language.
FLOOR = np.float32(-8.0)


@functools.cache
def _code_points() -> tuple[np.ndarray, np.ndarray]:
    """For each code point: is it part of a word (0, 1 mark, 2 letter), and its script."""
    kind = np.zeros(_TABLE, dtype=np.uint8)
    for cp in range(_TABLE):
        c = chr(cp)
        kind[cp] = 2 if c.isalpha() else unicodedata.category(c)[0] == "M"
    script = np.full(_TABLE, OTHER_SCRIPT, dtype=np.uint8)
    for number, ranges in enumerate(SCRIPTS.values()):
        for low, high in ranges:
            script[low : high + 1] = number
    return kind, script


@dataclass
class Words:
    """The words of one text: code point starts and ends, scripts, and trigram buckets of their characters."""

    starts: np.ndarray
    ends: np.ndarray
    script: np.ndarray
    grams: np.ndarray
    first: np.ndarray
    letters: bool


def words(text: str) -> Words:
    kind, scripts = _code_points()
    cps = np.frombuffer(text.encode("utf-32-le"), dtype="<u4")
    cps = np.where(cps < _TABLE, cps, np.where((cps >= _SELECTORS[0]) & (cps <= _SELECTORS[1]), 0xFE00, 32))
    kinds = kind[cps]
    inside = kinds > 0
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if len(inside) and inside[0]:
        edge = np.concatenate(([0], edge))
    if len(inside) and inside[-1]:
        edge = np.concatenate((edge, [len(inside)]))
    starts, ends = edge[::2], edge[1::2]
    padded = np.full(len(cps) + 2, 32, dtype=np.uint32)
    padded[1:-1] = np.where(inside, cps, 32)
    grams = (padded[:-2] * np.uint32(0x9E3779B1)) ^ (padded[1:-1] * np.uint32(0x85EBCA6B)) ^ (padded[2:] * np.uint32(0xC2B2AE35))
    grams = ((grams ^ (grams >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> np.uint32(16)) & np.uint32(_BUCKETS - 1)
    lengths = ends - starts
    return Words(starts, ends, scripts[cps[starts]], grams[inside], np.cumsum(lengths) - lengths, bool((kinds == 2).any()))


def lowered(text: str) -> str:
    """Lower case without a change of length."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


@dataclass
class Model:
    """Log probabilities of trigram buckets and allowed scripts, by language."""

    languages: list[str]
    grams: np.ndarray  # buckets x languages
    scripts: np.ndarray  # scripts x languages, bool

    def candidates(self, found: Words) -> np.ndarray:
        """Per word: has it a language at all?"""
        return self.scripts.any(axis=1)[found.script]

    def shares(self, found: Words, labels: np.ndarray) -> np.ndarray:
        """Per language: the share of the letters that have its label; words without a candidate add to none."""
        lengths = found.ends - found.starts
        return np.bincount(labels, weights=lengths * self.candidates(found), minlength=len(self.languages)) / lengths.sum()

    def scores(self, found: Words) -> np.ndarray:
        """Per word and language: 0 for the best candidate, less for others, ``FLOOR`` at least."""
        if not len(found.starts):
            return np.zeros((0, len(self.languages)), dtype=np.float32)
        total = np.add.reduceat(self.grams[found.grams], found.first, axis=0)
        allowed = self.scripts[found.script]
        total = np.where(allowed, total, -np.inf)
        best = total.max(axis=1, keepdims=True)
        known = np.isfinite(best)
        return np.where(known, np.maximum(total - np.where(known, best, 0), FLOOR), 0).astype(np.float32)


def train(docs: DataFrame, learnable: Column, documents: int = 2000, min_share: float = 0.01) -> Model:
    """Count trigrams by language in about ``documents`` texts of each language at most.

    ``learnable`` marks the rows to learn from. Texts are taken by hash, at a
    rate that meets the bound (row by row, so copies do not come in as a group); counts are added up on the
    executors. A language may use the scripts that hold ``min_share`` of its
    letters.
    """
    rows = docs.where(learnable).select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"), F.col("doc_id").alias("doc_id")).where("lang is not null and text is not null")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    languages = sorted(sizes)
    if not languages:
        return Model([], np.zeros((_BUCKETS, 0), dtype=np.float32), np.zeros((OTHER_SCRIPT + 1, 0), dtype=bool))
    rate = F.create_map(*[F.lit(x) for lang in languages for x in (lang, min(1.0, documents / sizes[lang]))])
    sample = rows.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 20)) < rate[F.col("lang")] * (1 << 20))
    number = {lang: i for i, lang in enumerate(languages)}
    cells = _BUCKETS + OTHER_SCRIPT + 1

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(languages), cells), dtype=np.int64)
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = words(lowered(text))
                total[number[lang], :_BUCKETS] += np.bincount(found.grams, minlength=_BUCKETS)
                total[number[lang], _BUCKETS:] += np.bincount(found.script, weights=found.ends - found.starts, minlength=OTHER_SCRIPT + 1).astype(np.int64)
        flat = total.ravel()
        at = np.flatnonzero(flat)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(flat[at], pa.int64())], ["cell", "n"])

    total = np.zeros(len(languages) * cells)
    for row in sample.select("lang", "text").mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():  # at most languages x cells rows
        total[row["cell"]] = row["n"]
    total = total.reshape(len(languages), cells)
    grams, scripts = total[:, :_BUCKETS], total[:, _BUCKETS:]
    kinds = max(1, int((grams.sum(axis=0) > 0).sum()))
    log = np.log((grams + 0.5) / (grams.sum(axis=1, keepdims=True) + 0.5 * kinds))
    share = scripts / np.maximum(scripts.sum(axis=1, keepdims=True), 1)
    return Model(languages, np.ascontiguousarray(log.T, dtype=np.float32), np.ascontiguousarray((share >= min_share).T))


def viterbi(scores: list[np.ndarray], penalty: float) -> list[np.ndarray]:
    """The best label of each word of each text; all texts advance together, a word at a step."""
    lengths = np.array([len(s) for s in scores])
    order = np.argsort(-lengths, kind="stable")
    lengths = lengths[order]
    longest = int(lengths[0]) if len(lengths) else 0
    if not longest:
        return [np.zeros(0, dtype=np.uint8) for _ in scores]
    flat = np.concatenate([scores[i] for i in order])
    kind = np.min_scalar_type(flat.shape[1])
    first = np.cumsum(lengths) - lengths
    active = np.searchsorted(-lengths, -np.arange(longest), side="left")  # texts with more than t words
    back = np.empty(flat.shape, dtype=kind)
    own = np.arange(flat.shape[1], dtype=kind)
    value = flat[first[: active[0]]].copy()
    for t in range(1, longest):
        n = active[t]
        value = value[:n]
        best = value.argmax(axis=1)
        switched = value[np.arange(n), best][:, None] - np.float32(penalty)
        stay = value >= switched
        at = first[:n] + t
        back[at] = np.where(stay, own, best[:, None])
        value = np.where(stay, value, switched) + flat[at]
        if t + 1 == longest or active[t + 1] < n:
            last = slice(0 if t + 1 == longest else active[t + 1], n)
            flat[first[last] + t] = value[last]  # kept for the end of these texts
    label = np.empty(len(flat), dtype=kind)
    ended = np.flatnonzero(lengths > 0)
    state = np.zeros(len(lengths), dtype=np.int64)
    state[ended] = flat[first[ended] + lengths[ended] - 1].argmax(axis=1)
    for t in range(longest - 1, -1, -1):
        n = active[t]
        at = first[:n] + t
        label[at] = state[:n]
        if t:
            state[:n] = back[at, state[:n]]
    out: list[np.ndarray] = [np.zeros(0, dtype=kind)] * len(scores)
    for place, i in enumerate(order):
        out[i] = label[first[place] : first[place] + lengths[place]]
    return out


def spans(found: Words, labels: np.ndarray, languages: list[str]) -> list[tuple[str, int, int]]:
    """Runs of one label as (language, start, end) in code points; a run ends where the next begins.

    The label after the last language is ``UNKNOWN``.
    """
    if not len(labels):
        return []
    at = np.concatenate(([0], np.flatnonzero(labels[1:] != labels[:-1]) + 1))
    starts = found.starts[at]
    ends = np.concatenate((starts[1:], [found.ends[-1]]))
    return [(languages[labels[i]] if labels[i] < len(languages) else UNKNOWN, int(s), int(e)) for i, s, e in zip(at, starts, ends, strict=True)]


PREDICTED = "doc_id long, lang_pred string, score double, spans string"
_WORDS_AT_ONCE = 400_000


def predict(docs: DataFrame, model: Model, penalty: float = 12.0) -> DataFrame:
    """One row per document: ``PREDICTED``; the score is the share of letters with the label."""

    def label(ids: list, found: list[Words]) -> pa.RecordBatch:
        rows = []
        labels = viterbi([model.scores(w) for w in found], penalty) if model.languages else [np.zeros(0, dtype=np.uint8)] * len(ids)
        for doc_id, w, own in zip(ids, found, labels, strict=True):
            if not len(own) or not len(w.starts):
                rows.append((doc_id, UNKNOWN, 0.0, ""))
                continue
            share = model.shares(w, own)
            best = int(share.argmax())
            labelled = spans(w, np.where(model.candidates(w), own, len(model.languages)), model.languages)
            rows.append((doc_id, model.languages[best] if share[best] else UNKNOWN, float(share[best]), ",".join(f"{a}:{b}:{c}" for a, b, c in labelled)))
        columns = list(zip(*rows, strict=True)) or [()] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.float64(), pa.string()), strict=True)], ["doc_id", "lang_pred", "score", "spans"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, found, size = [], [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                w = words(lowered(text or ""))
                if not w.letters:  # marks alone are no word
                    w = words("")
                ids.append(doc_id)
                found.append(w)
                size += len(w.starts) + len(w.grams) // 8
                if size >= _WORDS_AT_ONCE:
                    yield label(ids, found)
                    ids, found, size = [], [], 0
        if ids:
            yield label(ids, found)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, PREDICTED)


def keep(docs: DataFrame, model: Model, min_score: float = 0.5, penalty: float = 12.0) -> DataFrame:
    """``docs`` without rows that have no language, or none with ``min_score`` of their letters.

    All columns are kept, and a missing lang is filled in with the prediction.
    Rows are judged where they lie, without a shuffle.
    """
    text_at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch, found in _parts(whole, text_at):
                labels = viterbi([model.scores(w) for w in found], penalty) if model.languages else []
                kept, names = [], []
                for at, (w, own) in enumerate(zip(found, labels, strict=False)):
                    if len(own):
                        share = model.shares(w, own)
                        if share.max() > 0 and share.max() >= min_score:
                            kept.append(at)
                            names.append(model.languages[int(share.argmax())])
                batch = batch.take(pa.array(kept, pa.int64()))
                if "lang" in batch.schema.names and len(kept):
                    place = batch.schema.names.index("lang")
                    lang = [old if old is not None else new for old, new in zip(batch.column(place).to_pylist(), names, strict=True)]
                    columns = [pa.array(lang, c.type) if i == place else c for i, c in enumerate(batch.columns)]
                    batch = pa.RecordBatch.from_arrays(columns, schema=batch.schema)
                yield batch

    return docs.mapInArrow(run, docs.schema)


def _parts(batch: pa.RecordBatch, text_at: int) -> Iterator[tuple[pa.RecordBatch, list[Words]]]:
    """A batch in parts of a bounded number of words, with the words of each text."""
    first, found, size = 0, [], 0
    for at, text in enumerate(batch.column(text_at).to_pylist()):
        w = words(lowered(text or ""))
        found.append(w if w.letters else words(""))
        size += len(w.starts) + len(w.grams) // 8
        if size >= _WORDS_AT_ONCE:
            yield batch.slice(first, at + 1 - first), found
            first, found, size = at + 1, [], 0
    if found:
        yield batch.slice(first), found
