"""Labels of syntactic functions: tokens, nesting, diagnostics; display labels of records."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Full-width signs and what they should be.
PLAIN = str.maketrans("＋－（）", "+-()")
PAIRS = {"(": ")", "[": "]", "{": "}"}
DIAGNOSTICS = "uuid string, code string, severity string, kind string, start int, end int"


def tokens(label: str, morphemes: frozenset[str]) -> list[tuple[str, str, int, int]]:
    """(kind, text, start, end): ellipses, connectors, brackets, numbers, the longest known morphemes, and the rest."""
    known = "|".join(map(re.escape, sorted(morphemes, key=len, reverse=True))) or r"(?!)"
    pattern = re.compile(rf"(?P<ellipsis>\.\.\.)|(?P<open>[(\[{{])|(?P<close>[)\]}}])|(?P<connector>[.+\-:=>|/&!_])|(?P<number>\d+)|(?P<atom>{known})|(?P<space>\s+)|(?P<unknown>.)", re.DOTALL)
    out: list[tuple[str, str, int, int]] = []
    for m in pattern.finditer(label):
        kind = m.lastgroup or "unknown"
        if kind == "unknown" and out and out[-1][0] == "unknown" and out[-1][3] == m.start():
            out[-1] = ("unknown", out[-1][1] + m[0], out[-1][2], m.end())
        elif kind != "space":
            out.append((kind, m[0], m.start(), m.end()))
    return out


def tree(label: str, morphemes: frozenset[str]) -> list[tuple[int, int | None, str, str, int, int]]:
    """(node, parent, kind, text, start, end) of a label's syntax tree, a node before its children.

    Brackets are groups that hold what stands in them; a group that is never
    closed ends with the label, and a closing sign without one is a leaf.
    """
    nodes: list[list] = [[0, None, "label", label, 0, len(label)]]
    inside = [0]
    for kind, text, start, end in tokens(label, morphemes):
        if kind == "close" and len(inside) > 1 and PAIRS[nodes[inside[-1]][3]] == text:
            nodes[inside.pop()][5] = end
            continue
        nodes.append([len(nodes), inside[-1], "group" if kind == "open" else kind, text, start, len(label) if kind == "open" else end])
        if kind == "open":
            inside.append(len(nodes) - 1)
    for node in nodes:
        if node[2] == "group":
            node[3] = label[node[4] : node[5]]
    return [tuple(node) for node in nodes]


def trees(label: Column, morphemes: frozenset[str]) -> Column:
    """``tree`` of a column of labels."""

    @F.pandas_udf("array<struct<node:int,parent:int,kind:string,text:string,start:int,end:int>>")
    def of(labels: pd.Series) -> pd.Series:
        return labels.map(lambda x: [dict(zip(("node", "parent", "kind", "text", "start", "end"), n, strict=True)) for n in tree(x or "", morphemes)])

    return of(label)


def tokenised(label: Column, morphemes: frozenset[str]) -> Column:
    """``tokens`` of a column of labels."""

    @F.pandas_udf("array<struct<kind:string,text:string,start:int,end:int>>")
    def of(labels: pd.Series) -> pd.Series:
        return labels.map(lambda x: [dict(zip(("kind", "text", "start", "end"), t, strict=True)) for t in tokens(x or "", morphemes)])

    return of(label)


def diagnose(label: str, morphemes: frozenset[str]) -> list[tuple[str, str, int, int]]:
    """(severity, kind, start, end) of what is odd about a label."""
    found = []
    for at, c in enumerate(label):
        if c in "＋－（）":
            found.append(("warning", "fullwidth-punctuation", at, at + 1))
        if c.isspace():
            found.append(("warning", "whitespace", at, at + 1))
        elif not c.isascii():
            found.append(("warning", "unicode-confusable" if "CYRILLIC" in unicodedata.name(c, "") else "non-ascii", at, at + 1))
    open_: list[tuple[str, int]] = []
    for kind, text, start, end in tokens(unicodedata.normalize("NFC", label).translate(PLAIN), morphemes):
        if kind == "unknown":
            found.append(("warning", "unknown-token", start, end))
        elif text == "_":
            found.append(("warning", "underscore", start, end))
        elif kind == "open":
            open_.append((text, start))
        elif kind == "close":
            if open_ and PAIRS[open_[-1][0]] == text:
                open_.pop()
            else:
                found.append(("error", "unmatched-close", start, end))
    return found + [("error", "unmatched-open", at, at + 1) for _, at in open_]


def lint(records: DataFrame, morphemes: frozenset[str]) -> DataFrame:
    """Diagnostics of labels, without those a record accepts, and codes that several records have.

    ``records`` has uuid, code and accept (array of kinds).
    """
    from pyspark.sql import Window

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(uuid, code, *d) for uuid, code in zip(frame["uuid"], frame["code"], strict=True) for d in (diagnose(code, morphemes) if code else [("error", "missing-code", 0, 0)])]
            if rows:
                yield pd.DataFrame(rows, columns=["uuid", "code", "severity", "kind", "start", "end"])

    own = records.select("uuid", F.coalesce("code", F.lit("")).alias("code")).mapInPandas(run, DIAGNOSTICS)
    place = F.row_number().over(Window.partitionBy("code").orderBy("uuid"))
    twice = records.where("code <> ''").withColumn("__p", place).where("__p > 1").select("uuid", "code", F.lit("warning").alias("severity"), F.lit("duplicate-code").alias("kind"), F.lit(0).alias("start"), F.lit(0).alias("end"))
    both = own.unionByName(twice).join(records.select("uuid", "accept"), "uuid")
    return both.where(~F.coalesce(F.array_contains("accept", F.col("kind")), F.lit(False))).drop("accept")


def display(kind: Column, fields: Column, concept: Column, word: Column, ordinal: Column) -> Column:
    """A record's label by its type; ``concept``, ``word`` and ``ordinal`` are those of its parents, or null.

    ``fields`` maps names to lists of texts, of which the first that is not blank counts.
    """
    get = lambda name: F.get(F.filter(F.coalesce(fields[name], F.array().cast("array<string>")), lambda v: F.trim(v) != ""), F.lit(0))
    orth = get("orth")
    return (
        F.when(kind == "concept", get("concept"))
        .when(kind == "bibliography", get("citation_label"))
        .when(kind == "graph", F.coalesce(get("attested"), F.concat(get("standardised"), F.lit(" (standardised)"))))
        .when(kind.isin("syntactic-function", "semantic-feature", "rhetorical-device"), get("code"))
        .when(kind == "word", F.coalesce(F.concat(orth, F.lit(": "), concept), orth, concept))
        .when(kind == "super-entry", orth)
        .when(kind == "sense", F.coalesce(F.concat(word, F.lit(" (sense "), ordinal.cast("string"), F.lit(")")), word, get("definition")))
        .when(kind == "tax-char", get("heads"))
        .when(kind == "word-relation", F.coalesce(F.concat(get("rel_type"), F.lit(": "), get("left"), F.lit(" ↔ "), get("right")), get("rel_label"), get("rel_type")))
    )
