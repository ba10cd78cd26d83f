"""Arrow functions, for what Spark has no expression.

``register`` gives them their SQL names.
"""

from __future__ import annotations

import difflib
import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPAN = T.ArrayType(T.StructType([T.StructField("s", T.IntegerType()), T.StructField("e", T.IntegerType())]))
OPS = T.ArrayType(T.StructType([T.StructField("op", T.StringType()), T.StructField("n", T.IntegerType()), T.StructField("a", T.StringType()), T.StructField("b", T.StringType())]))


def _fold(text: str | None) -> str | None:
    """Trimmed, lower case, without combining marks; nothing left is null."""
    text = (text or "").strip().lower()
    if not text:
        return None
    if text.isascii():
        return text
    return unicodedata.normalize("NFC", "".join(c for c in unicodedata.normalize("NFD", text) if unicodedata.category(c) != "Mn"))


@F.pandas_udf(T.StringType())
def nfc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFC", t))


@F.pandas_udf(T.StringType())
def fold_search(texts: pd.Series) -> pd.Series:
    return texts.map(_fold)


BLOCKS = T.ArrayType(T.StructType([T.StructField("tag", T.StringType())] + [T.StructField(n, T.IntegerType()) for n in ("a_start", "a_end", "b_start", "b_end")]))
PUA_BASE = 0x105000


@F.pandas_udf(T.StringType())
def expand_entities(texts: pd.Series) -> pd.Series:
    """``&KR0001;`` as its character of the private plane."""
    return texts.map(lambda t: t and re.sub(r"&KR(\d+);", lambda m: chr(PUA_BASE + int(m[1])), t))


@F.pandas_udf(T.StringType())
def entities(texts: pd.Series) -> pd.Series:
    """The inverse of ``expand_entities``."""
    return texts.map(lambda t: t and re.sub("[\U00105000-\U00108fff]", lambda m: f"&KR{ord(m[0]) - PUA_BASE:04d};", t))


def regex_spans(pattern: str, flags: int = 0):
    """Spans of all matches, leftmost, not overlapping, in codepoints; empty matches are an error."""

    @F.pandas_udf(SPAN)
    def spans(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        compiled = re.compile(pattern, flags)

        def of(text: str | None) -> list[dict]:
            found = [{"s": m.start(), "e": m.end()} for m in compiled.finditer(text or "")]
            if any(x["s"] == x["e"] for x in found):
                raise ValueError("zero_length_regex: the expression matched nothing at all")
            return found

        for part in texts:
            yield part.map(of)

    return spans


def near_offsets(left: int, right: int, distance: int, negate: bool = False):
    """Of two sorted arrays of offsets, those of the first with (or without) one of the second nearby.

    ``left`` and ``right`` are the lengths of what stands there; spans that touch or overlap are 0 apart.
    """

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def of(own: pd.Series, other: pd.Series) -> pd.Series:
        out = []
        for a, b in zip(own, other, strict=True):
            a, b = np.asarray(a, dtype=np.int64), np.asarray(b, dtype=np.int64)
            # the first that does not end too far before, and whether it begins too far after
            at = np.searchsorted(b, a - distance - right)
            close = np.append(b, np.iinfo(np.int64).max)[at] <= a + left + distance
            out.append(a[close != negate].astype(np.int32))
        return pd.Series(out)

    return of


def jcs(value) -> str:
    """Canonical JSON: sorted keys, no white space, plain characters."""
    return json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"))


@F.pandas_udf(T.StringType())
def jcs_hash(documents: pd.Series) -> pd.Series:
    """The hash of a JSON text in canonical form."""
    import hashlib

    return documents.map(lambda d: d and "sha256:" + hashlib.sha256(jcs(json.loads(d)).encode()).hexdigest())


@F.pandas_udf(T.StringType())
def self_hash(documents: pd.Series) -> pd.Series:
    """The hash of a JSON object whose own hash field is blank."""
    import hashlib

    def of(document: str | None) -> str | None:
        if document is None:
            return None
        return "sha256:" + hashlib.sha256(jcs(json.loads(document) | {"hash": ""}).encode()).hexdigest()

    return documents.map(of)


def _costs(a: str, b: str) -> np.ndarray:
    """The least edits between every prefix of a and every prefix of b, row by row."""
    n, m = len(a), len(b)
    points = np.frombuffer(b.encode("utf-32-le"), dtype="<u4").astype(np.int64)
    whole = np.empty((n + 1, m + 1), dtype=np.int32)
    along = np.arange(m + 1, dtype=np.int32)
    whole[0] = along
    for i, c in enumerate(a, 1):
        row = whole[i - 1] + 1  # deleted
        row[1:] = np.minimum(row[1:], whole[i - 1, :-1] + (points != ord(c)))  # kept or substituted
        whole[i] = np.minimum.accumulate(row - along) + along  # or characters of b inserted after any of these
    return whole


#: What a step back does to the places in both texts, in the order in which steps of equal cost are taken.
_STEPS = (("=", 1, 1, 0), ("s", 1, 1, 1), ("d", 1, 0, 1), ("i", 0, 1, 1))


def align(a: str, b: str) -> list[dict]:
    """A least-edit script from a to b: runs of kept characters, else substitutions, deletions, insertions.

    Traced from the end; of equal costs a substitution goes before a deletion
    before an insertion.
    """
    cost = _costs(a, b)
    at, out = (len(a), len(b)), []
    while at != (0, 0):
        for op, back_a, back_b, edits in _STEPS:
            to = (at[0] - back_a, at[1] - back_b)
            if min(to) < 0 or cost[at] != cost[to] + edits or op in "=s" and (a[to[0]] == b[to[1]]) != (op == "="):
                continue
            if op == "=" and out and out[-1]["op"] == "=":
                out[-1]["n"] += 1
            else:
                out.append({"op": op, "n": 1, "a": a[to[0]] if op in "sd" else "", "b": b[to[1]] if op in "si" else ""})
            at = to
            break
    return out[::-1]


@F.pandas_udf(OPS)
def align_ops(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([align(x, y) for x, y in zip(a, b, strict=True)])


@F.pandas_udf(BLOCKS)
def opcodes(a: pd.Series, b: pd.Series) -> pd.Series:
    """Matching and differing blocks of two texts."""
    names = ("tag", "a_start", "a_end", "b_start", "b_end")
    return pd.Series([[dict(zip(names, code, strict=True)) for code in difflib.SequenceMatcher(None, x or "", y or "", autojunk=False).get_opcodes()] for x, y in zip(a, b, strict=True)])


def register(spark: SparkSession) -> None:
    """The functions under their SQL names."""
    for name, function in (("nfc", nfc), ("fold_search", fold_search), ("align_ops", align_ops), ("expand_entities", expand_entities), ("entities", entities), ("jcs_hash", jcs_hash), ("opcodes", opcodes)):
        spark.udf.register(name, function)
