"""License scans: TF-IDF cosine of notices to templates, then inheritance down the path.

Lines, sentences, runs of neighbouring lines without their comment signs, and whole
texts that may be a licence file, are sparse TF-IDF vectors over the templates' words and a share for all others; a
cosine above the threshold names the licence. A file without a notice of its own
takes that of the nearest ancestor directory that has a licence file, found by
joins of directory paths.

Defined results: null text is empty and has no notice; a null path has no
directory, so nothing is inherited; of several notices the one with the highest
cosine counts, then the first by name; of several licence files in a directory
the same holds; repeated rows are files of their own; an empty table returns no
rows. Further input columns are not read.
"""

from __future__ import annotations

import bisect
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.storage import stored

# Short notices by SPDX name, several for each licence.
TEMPLATES = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "SPDX-License-Identifier: Apache-2.0",
        "Apache License Version 2.0, January 2004",
    ),
    "MIT": (
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "SPDX-License-Identifier: MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "The MIT License (MIT)",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ),
    "GPL-2.0": (
        "This work is licensed under the GNU General Public License, version 2.",
        "GNU GENERAL PUBLIC LICENSE Version 2, June 1991",
        "SPDX-License-Identifier: GPL-2.0-only",
    ),
    "LGPL-3.0": ("Licensed under the GNU Lesser General Public License, version 3.", "SPDX-License-Identifier: LGPL-3.0-only"),
    "AGPL-3.0": ("Licensed under the GNU Affero General Public License, version 3.", "SPDX-License-Identifier: AGPL-3.0-only"),
    "BSD-3-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Licensed under the BSD 3-Clause License.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "SPDX-License-Identifier: MPL-2.0"),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC0-1.0": ("To the extent possible under law, the author has waived all copyright: CC0 1.0 Universal public domain dedication.", "SPDX-License-Identifier: CC0-1.0"),
    "Unlicense": ("This is free and unencumbered software released into the public domain.",),
    "proprietary": ("All rights reserved.", "Copyright. All rights reserved. Confidential and proprietary; no part may be reproduced without written permission."),
}
LINES = 16  # lines that a wrapped notice has at most; the longest template has 43 words
LICENSE_NAME = re.compile(r"(?:^|/)(?:licen[cs]e|copying|notice|unlicense)[^/]*\Z", re.IGNORECASE)
_WORD = re.compile(r"[a-z]+|[0-9]+")


def terms(text: str) -> list[str]:
    return _WORD.findall(text.lower())


@dataclass
class Matcher:
    """Unit TF-IDF vectors of all templates, as postings by term."""

    idf: dict[str, float]
    other: float  # the idf of a word that no template has
    postings: dict[str, list[tuple[int, float]]]
    names: list[str]

    @classmethod
    def of(cls, documents: int, having: dict[str, int]) -> Matcher:
        """From the number of documents, and of those that have each template word."""
        idf = {t: math.log((documents + 1) / (having.get(t, 0) + 1)) + 1 for t in VOCABULARY}
        postings: dict[str, list[tuple[int, float]]] = {}
        names = []
        for name, texts in TEMPLATES.items():
            for text in texts:
                weight = {t: n * idf[t] for t, n in Counter(terms(text)).items()}
                norm = math.sqrt(sum(w * w for w in weight.values()))
                for t, w in weight.items():
                    postings.setdefault(t, []).append((len(names), w / norm))
                names.append(name)
        return cls(idf, math.log(documents + 1) + 1, postings, names)

    def reaches(self, text: str, threshold: float) -> bool:
        """Can any part of a text have the cosine, which the root of a template's weight in its words bounds?

        One word is no notice: "Mit." is a German sentence too.
        """
        held: dict[int, float] = {}
        words: Counter = Counter()
        for t in VOCABULARY.intersection(terms(text)):
            for at, v in self.postings[t]:
                held[at] = held.get(at, 0.0) + v * v
                words[at] += 1
        return any(w >= threshold * threshold - 1e-9 and words[at] > 1 for at, w in held.items())

    def best(self, text: str) -> tuple[float, str]:
        """The highest cosine, and the licence that has it (ties: the first by name)."""
        count = Counter(terms(text))
        dots: dict[int, float] = {}
        norm = 0.0
        for t, n in count.items():
            w = n * self.idf.get(t, self.other)
            norm += w * w
            for at, v in self.postings.get(t, ()):
                dots[at] = dots.get(at, 0.0) + v * w
        if not dots:
            return 0.0, ""
        at = min(dots, key=lambda i: (-round(dots[i], 9), self.names[i]))
        return dots[at] / math.sqrt(norm), self.names[at]


VOCABULARY = frozenset(t for texts in TEMPLATES.values() for text in texts for t in terms(text))


def matcher(files: DataFrame) -> Matcher:
    """IDF over all files: how many have each of the templates' words (a fixed number of rows)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            total[""] += batch.num_rows
            for text in batch.column(0).to_pylist():
                if text:
                    total.update(VOCABULARY.intersection(terms(text)))
        yield pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())], ["term", "n"])

    rows = files.select(F.col("text").cast("string")).mapInArrow(count, "term string, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    having = {r["term"]: r["n"] for r in rows}
    return Matcher.of(having.pop("", 0), having)


_SENTENCE = re.compile(r"(?<=[a-z0-9][.;])\s+(?=[A-Z])")
# what a comment's line begins with
_LEAD = re.compile(r"(?m)^[ \t]*(?:/\*+|\*+/?|//+|#+|--+|;+|<!--|%+)[ \t]?")


def _cut(text: str) -> Iterator[tuple[int, int]]:
    """Starts and ends of a text's sentences."""
    start = 0
    for gap in _SENTENCE.finditer(text):
        yield start, gap.start()
        start = gap.end()
    yield start, len(text)


def _wrapped(text: str, match: Matcher, threshold: float) -> set[tuple[int, int]]:
    """Places that may hold a notice over several lines: runs of neighbouring lines, and sentences of joined ones."""
    plain = _LEAD.sub(lambda lead: " " * len(lead[0]), text)
    found: set[tuple[int, int]] = set()
    block: list[tuple[int, int]] = []
    at = 0
    for line in [*plain.split("\n"), ""]:
        if _WORD.search(line.lower()):
            block.append((at + len(line) - len(line.lstrip()), at + len(line.rstrip())))
        elif block:
            first, last = block[0][0], block[-1][1]
            if match.reaches(plain[first:last], threshold):  # else no part does
                for i in range(len(block)):
                    ends = [end for _, end in block[i + 1 : i + LINES]]
                    if ends and match.reaches(plain[block[i][0] : ends[-1]], threshold):
                        found |= {(block[i][0], end) for end in ends}
                found |= {(first + a, first + b) for a, b in _cut(plain[first:last]) if "\n" in plain[first + a : first + b]}
            block = []
        at += len(line) + 1
    return found


def _places(text: str, match: Matcher, threshold: float) -> set[tuple[int, int]]:
    """Places that are compared: lines and their sentences, each where it stands, and what is wrapped over lines."""
    found, at = set(), 0
    for line in text.split("\n"):
        if match.reaches(line, threshold):
            found |= {(at, at + len(line)), *((at + a, at + b) for a, b in _cut(line))}
        at += len(line) + 1
    return found | _wrapped(text, match, threshold) if "\n" in text else found


def notices(text: str, match: Matcher, threshold: float) -> list[tuple[float, str, int, int]]:
    """Licence notices of a text, none over another: (cosine, licence, start, end), the highest cosine first.

    Of places that overlap the one with the highest cosine counts, then the
    first by name and by place; so a notice that stands twice in a line is two.
    """
    if not match.reaches(text, threshold):
        return []
    compared = []
    for start, end in _places(text, match, threshold):
        part = text[start:end]
        if match.reaches(part, threshold):
            cosine, name = match.best(part)
            if cosine >= threshold:
                compared.append((cosine, name, start, end))
    found: list[tuple[float, str, int, int]] = []
    taken: list[tuple[int, int]] = []  # in order, none over another
    for one in sorted(compared, key=lambda x: (-round(x[0], 9), x[1], x[2], x[3])):
        at = bisect.bisect_left(taken, (one[2], one[3]))
        if (at == 0 or taken[at - 1][1] <= one[2]) and (at == len(taken) or taken[at][0] >= one[3]):
            taken.insert(at, (one[2], one[3]))
            found.append(one)
    return found


SCANNED = "file_id long, dir string, is_license_file boolean, own_license string, cosine double, n_notices long, notices string"


def scan(files: DataFrame, match: Matcher, threshold: float = 0.7) -> DataFrame:
    """One row per file: its directory, its own licence, and all its notices as licence:start:end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for file_id, path, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                text = text or ""
                found = notices(text, match, threshold)
                directory = None if path is None else path.rpartition("/")[0]
                named = bool(path and LICENSE_NAME.search(path))
                if named and not found:
                    cosine, name = match.best(text)
                    found = [(cosine, name, 0, len(text))] if cosine >= threshold / 2 else []
                # a licence file by name, or one that holds a notice alone, speaks for its directory
                whole = bool(found) and (named or match.best(text)[0] >= 0.95)
                best = found[0] if found else (0.0, None, 0, 0)
                rows.append((file_id, directory, whole, best[1], float(best[0]), len(found), ",".join(f"{n}:{s}:{e}" for _, n, s, e in sorted(found, key=lambda x: (x[2], x[3], x[1])))))
            columns = list(zip(*rows, strict=True)) or [()] * 7
            types = [pa.int64(), pa.string(), pa.bool_(), pa.string(), pa.float64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["file_id", "dir", "is_license_file", "own_license", "cosine", "n_notices", "notices"])

    return files.select(F.col("file_id").cast("long"), F.col("path").cast("string"), F.col("text").cast("string")).mapInArrow(run, SCANNED)


def inherited(scanned: DataFrame) -> DataFrame:
    """For each directory with files: the licence of its nearest ancestor (or itself) that has one.

    Directories are made distinct before their ancestors are listed, so a
    directory with very many files costs one row.
    """
    # the highest cosine, then the first name
    licensed = scanned.where("is_license_file and dir is not null").select("dir", "own_license", F.round("cosine", 9).alias("c"))
    top = licensed.groupBy("dir").agg(F.max("c").alias("c"))
    licensed = licensed.join(top, ["dir", "c"]).groupBy("dir").agg(F.min("own_license").alias("license")).withColumnRenamed("dir", "ancestor")
    directories = scanned.where("dir is not null").select("dir").distinct()
    parts = F.split("dir", "/")
    ancestors = directories.select("dir", F.explode(F.sequence(F.lit(0), F.size(parts))).alias("depth"), parts.alias("parts")).select(
        "dir", "depth", F.array_join(F.slice("parts", 1, F.col("depth")), "/").alias("ancestor")
    )
    # depth 0 is the root, "", which is the directory "" itself when a path has no slash
    ancestors = ancestors.where("not (dir = '' and depth = 1)")
    return ancestors.join(licensed, "ancestor").groupBy("dir").agg(F.max_by("license", "depth").alias("inherited_license"), F.max_by("ancestor", "depth").alias("inherited_from"))


def resolve(files: DataFrame, threshold: float = 0.7) -> DataFrame:
    """One row per file with its own licence, else the inherited one.

    ``files`` has file_id, path and text. Texts are read twice and never
    shuffled: once for document counts, once for notices.
    """
    scanned = stored(scan(files, matcher(files), threshold), "licenses")
    # written, so that both sides are shuffled as they are and a directory of very many files can be split;
    # merged at every size, so that a small run has the plan of a large one
    joined = scanned.join(stored(inherited(scanned), "inherited").hint("merge"), "dir", "left")
    own = F.col("own_license").isNotNull()
    return joined.select(
        "file_id",
        "dir",
        "is_license_file",
        F.coalesce("own_license", "inherited_license").alias("license"),
        F.when(own, "own").when(F.col("inherited_license").isNotNull(), "inherited").otherwise("none").alias("origin"),
        F.when(~own, F.col("inherited_from")).alias("inherited_from"),
        F.round("cosine", 6).alias("cosine"),
        "n_notices",
        "notices",
    )
