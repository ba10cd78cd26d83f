import math
from collections import Counter

import pytest

from lectern.llm import licenses
from lectern.llm.queries import op9_licenses

FILES = "file_id long, path string, text string"
MIT = "Released under the MIT License."


def dense_cosine(match, a, b):
    x, y = ({t: n * match.idf.get(t, match.other) for t, n in Counter(licenses.terms(s)).items()} for s in (a, b))
    norm = lambda v: math.sqrt(sum(w * w for w in v.values()))
    return sum(w * y.get(t, 0) for t, w in x.items()) / (norm(x) * norm(y))


def test_sparse_cosine_is_the_plain_one():
    match = licenses.Matcher.of(1000, dict.fromkeys(licenses.VOCABULARY, 5))
    for text in ("Released under MIT terms.", "licensed under the GNU GPL version 3 or later", "all rights reserved by me"):
        best = max((dense_cosine(match, text, t), n) for n, ts in licenses.TEMPLATES.items() for t in ts)
        assert match.best(text)[0] == pytest.approx(best[0])


def test_inheritance_from_the_nearest_ancestor(spark):
    rows = [
        (1, "a/LICENSE", "The MIT License (MIT)\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
        (2, "a/x.txt", "plain words"),
        (3, "a/b/c/y.txt", "plain words"),
        (4, "a/b/LICENSE.md", "Licensed under the Apache License, Version 2.0."),
        (5, "a/b/z.txt", "code. All rights reserved."),
        (6, "other/q.txt", "nothing"),
        (7, "ab/q.txt", "nothing"),
        (8, None, "nothing"),
        (9, "root.txt", "nothing"),
    ]
    got = {r["file_id"]: (r["license"], r["origin"], r["inherited_from"]) for r in licenses.resolve(spark.createDataFrame(rows, FILES)).collect()}
    assert got[1] == ("MIT", "own", None) and got[4] == ("Apache-2.0", "own", None)
    assert got[2] == ("MIT", "inherited", "a")
    assert got[3] == ("Apache-2.0", "inherited", "a/b")
    assert got[5][:2] == ("proprietary", "own")
    assert {got[i][1] for i in (6, 7, 8, 9)} == {"none"}


def test_a_root_licence_covers_all(spark):
    rows = [(1, "COPYING", MIT), (2, "a/b/c.txt", "words"), (3, "d.txt", "words"), (4, "a/b/e.txt", "words")]
    got = {r["file_id"]: (r["license"], r["inherited_from"]) for r in licenses.resolve(spark.createDataFrame(rows, FILES)).collect()}
    assert got == {1: ("MIT", None), 2: ("MIT", ""), 3: ("MIT", ""), 4: ("MIT", "")}


def test_whole_table(spark):
    """Every notice line of the documents is found as what it names, and no other document has one."""
    data = "/root/testdata/sf0.01"
    lines = {"Released under the MIT License.": "MIT", "Licensed under the Apache License, Version 2.0.": "Apache-2.0", "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0", "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0", "All rights reserved.": "proprietary"}
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    rows = op9_licenses(spark, data).collect()
    assert len(rows) == len(docs)
    for r in rows:
        text = docs[r["doc_id"]]
        want = {name for line, name in lines.items() if line in text}
        found = [x.split(":") for x in r["notices"].split(",") if x]
        assert {x[0] for x in found} == want
        assert all(any(line in text[int(a) : int(b)] for line in lines) for _, a, b in found)
        assert (r["origin"] == "own") == bool(want)


def test_nasty_and_empty(spark, nasty, empty):
    from pyspark.sql import functions as F

    files = nasty.withColumn("file_id", F.col("doc_id")).withColumn("path", F.when(F.col("doc_id") > 2, F.concat(F.lit("x/"), F.col("doc_id").cast("string"))))
    rows = licenses.resolve(files).collect()
    assert len(rows) == nasty.count()
    assert all(r["license"] is None for r in rows)
    assert licenses.resolve(empty.select(F.col("doc_id").alias("file_id"), F.col("source").alias("path"), "text")).count() == 0


WRAPPED = {
    "MPL-2.0": """/* This Source Code Form is subject to the terms of the Mozilla Public
 * License, v. 2.0. If a copy of the MPL was not distributed with this
 * file, You can obtain one at http://mozilla.org/MPL/2.0/. */

int main() {}
""",
    "GPL-3.0": """# tool.py does something
#
# This program is free software: you can redistribute it and/or modify
# it under the terms of the GNU General Public License as published by
# the Free Software Foundation, either version 3 of the License, or
# (at your option) any later version.

import os
""",
    "Apache-2.0": """// Licensed under the Apache License, Version 2.0 (the "License");
// you may not use this file except in compliance with the License.
// You may obtain a copy of the License at
""",
    "CC-BY-4.0": "Some words first.\nReleased under CC BY 4.0.\nMore words.",
}


def test_wrapped_notices_and_notices_without_cue_words(spark):
    files = [(i, f"src/{i}/a.c", text) for i, text in enumerate(WRAPPED.values())]
    files += [(10 + i, f"plain/{i}/b.c", f"words of the text number {i}\nand the others of this one\nas it is") for i in range(300)]
    rows = {r["file_id"]: r for r in licenses.resolve(spark.createDataFrame(files, "file_id long, path string, text string")).collect()}
    assert [(rows[i]["license"], rows[i]["origin"]) for i in range(len(WRAPPED))] == [(name, "own") for name in WRAPPED]
    assert all(rows[i]["origin"] == "none" for i in range(10, 310))


def test_a_notice_that_stands_twice_is_two():
    match = licenses.Matcher.of(1000, dict.fromkeys(licenses.VOCABULARY, 5))
    text = "Released under the MIT License. Foo. Released under the MIT License."
    assert sorted((n, s, e) for _, n, s, e in licenses.notices(text, match, 0.7)) == [("MIT", 0, 31), ("MIT", 37, 68)]
    assert sorted((s, e) for _, _, s, e in licenses.notices(f"{MIT}\n{MIT}\n\nwords\n{MIT}", match, 0.7)) == [(0, 31), (32, 63), (71, 102)]


def test_notices_against_brute_force():
    """Every run of words within neighbouring lines is compared: no better notice is missed where one is reported, and none overlap."""
    match = licenses.Matcher.of(1000, dict.fromkeys(licenses.VOCABULARY, 5))
    for text in [*WRAPPED.values(), "code\nAll rights reserved.\nmore", "words alone, of no licence\nat all"]:
        found = licenses.notices(text, match, 0.7)
        places = sorted((s, e) for _, _, s, e in found)
        assert all(a[1] <= b[0] for a, b in zip(places, places[1:], strict=False))
        lines = text.split("\n")
        best = max(match.best("\n".join(lines[i:j]))[0] for i in range(len(lines)) for j in range(i + 1, min(len(lines), i + licenses.LINES) + 1))
        assert (max((c for c, *_ in found), default=0.0) >= min(best, 1.0) - 1e-9) if best >= 0.7 else not found


def test_inheritance_of_the_table_against_brute_force(spark):
    """Files in directories of several levels: the nearest ancestor's licence file, by walking up."""
    import random

    rng = random.Random(3)
    notice = {"MIT": MIT, "Apache-2.0": "Licensed under the Apache License, Version 2.0.", "GPL-3.0": "This work is licensed under the GNU General Public License, version 3."}
    dirs = ["/".join(rng.choice("ab") for _ in range(rng.randrange(0, 5))) for _ in range(40)]
    files, own = [], {}
    for i, folder in enumerate(dirs * 3):
        name = rng.choice([None, *notice]) if i % 7 == 0 else None
        files.append((i, (folder + "/" if folder else "") + (f"LICENSE.{i}" if name else f"f{i}.txt"), notice.get(name, "plain words")))
        if name:
            own.setdefault(folder, []).append(name)
    got = {r["file_id"]: (r["license"], r["origin"], r["inherited_from"]) for r in licenses.resolve(spark.createDataFrame(files, FILES)).collect()}
    for i, path, text in files:
        folder = path.rpartition("/")[0]
        if text != "plain words":
            assert got[i][1] == "own"
            continue
        up = [folder]
        while up[-1]:
            up.append(up[-1].rpartition("/")[0])
        nearest = next((d for d in up if d in own), None)
        assert got[i][2] == nearest
        assert got[i][0] in (own[nearest] if nearest is not None else (None,))
