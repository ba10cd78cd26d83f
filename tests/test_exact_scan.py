import random
from hashlib import md5

import numpy as np
import pytest

from lectern.functions.digests import window_numbers
from lectern.operators import exact_scan, passages

SOURCE = "bucket_id long, text string"


@pytest.mark.parametrize("alphabet", ["abc d", "abcé", "漢字a", "😀x漢é"])
def test_window_numbers_are_those_of_md5(alphabet):
    rng = random.Random(3)
    for n, width in ((0, 5), (11, 12), (12, 12), (500, 12), (9000, 12), (300, 5), (300, 16)):
        text = "".join(rng.choice(alphabet) for _ in range(n))
        assert window_numbers(text.encode(), width).tolist() == [int.from_bytes(md5(text[i : i + width].encode()).digest()[:8], "big") for i in range(n - width + 1)]


@pytest.mark.parametrize("top", [2, 30, 1 << 60])
def test_anchors_of_few_steps_are_the_rightmost_least(top):
    rng = np.random.default_rng(top % 97)
    for n, width in ((1, 1), (5, 13), (13, 13), (14, 13), (400, 13), (400, 8)):
        values = rng.integers(0, top, n).astype(np.uint64)
        want = sorted({max(range(i, i + width), key=lambda j: (-int(values[j]), j)) for i in range(n - width + 1)})
        assert exact_scan.chosen(values, width).tolist() == want


def rows_of(frame):
    return sorted(tuple(r) for r in frame.select(passages.SPAN).collect())


@pytest.mark.parametrize("most", [3, 6, 10_000])
def test_spans_without_texts_are_those_of_texts(spark, monkeypatch, most):
    """Also behind anchors that are too frequent, in characters of every width, within a text and at its ends."""
    rng = random.Random(most)
    word = lambda n, signs="abcdefgh": "".join(rng.choice(signs) for _ in range(n))
    common, long = word(90), word(400)
    texts = [long, long, long[:150] + "#" + long[151:], word(30) + long[50:300] + common, common + long[20:60] + common, *[word(9) + common + word(25) for _ in range(7)], "é漢😀" * 20 + long[:70], "漢字" + "é漢😀" * 20, "ab" * 40, long[:30] * 3, "", None, "short"]
    rows = spark.createDataFrame(list(enumerate(texts)), SOURCE)
    expected = rows_of(passages.scan(rows, 12, 24, most))
    assert expected and rows_of(passages.exact_spans(rows, 12, 24, most)) == expected
    assert rows_of(passages.exact_spans(rows.repartition(3), 12, 24, most)) == expected
    monkeypatch.setattr(exact_scan, "HELD", 20)
    monkeypatch.setattr(exact_scan, "_PAIRS", 10)
    monkeypatch.setattr(exact_scan, "LONG", 7)  # ends that are not seen are looked for in the texts
    assert rows_of(passages.exact_spans(rows, 12, 24, most)) == expected


def test_no_text_is_sent_to_others(spark, monkeypatch):
    rng = random.Random(1)
    long = "".join(rng.choice("abcdefgh ") for _ in range(3000))
    rows = spark.createDataFrame([(i, long[100 * i : 2000 + 50 * i]) for i in range(6)], SOURCE)
    expected = rows_of(passages.scan(rows))
    monkeypatch.setattr(passages, "spans", None)
    assert expected and rows_of(passages.exact_spans(rows)) == expected


@pytest.mark.parametrize("text", ["plain letters and some more of them", "é漢😀 letters é漢😀 letters 漢"])
def test_hashes_of_places_need_no_text_in_their_rows(spark, text):
    rows = spark.createDataFrame([(1, text), (2, text[5:]), (3, None)], SOURCE)
    places = spark.createDataFrame([(b, s, e) for b, n in ((1, len(text)), (2, len(text) - 5)) for s in range(0, n, 3) for e in (s + 1, n)], "bucket_id long, start int, end int")
    from hashlib import sha256

    got = {(r["bucket_id"], r["start"], r["end"], bytes(r["passage"])) for r in passages._hashed(rows, places).collect()}
    assert got == {(r["bucket_id"], r["start"], r["end"], sha256((text if r["bucket_id"] == 1 else text[5:])[r["start"] : r["end"]].encode()).digest()) for r in places.collect()}


def test_containment_does_not_depend_on_cells(spark, monkeypatch):
    rng = random.Random(2)
    rows = [(f"c{i % 40:02d}", 5 + i % 40, b, s, s + 5 + i % 40) for i in range(300) for b, s in ((rng.randrange(3), rng.randrange(200)),)]
    frame = spark.createDataFrame(sorted(set(rows)), "cluster string, length int, bucket_id long, start int, end int")
    found = []
    for cell in (1 << 20, 64, 7):
        monkeypatch.setattr(passages, "CELL", cell)
        found.append(sorted(map(tuple, passages.uncontained(frame).collect())))
    assert found[0] and found[0] == found[1] == found[2]


def test_pairs_of_sources_are_those_of_texts(spark, monkeypatch):
    rng = random.Random(4)
    word = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    long = word(500)
    rows = spark.createDataFrame(list(enumerate([long, long[100:400] + word(50), word(70) + long[:120] + word(9) + long[300:], word(200), long[:150] * 2])), SOURCE)
    lengths = rows.selectExpr("bucket_id", "length(text) as chars")
    expected = sorted(map(repr, passages.pair_rows(passages.scan(rows), lengths).collect()))
    monkeypatch.setattr(passages, "spans", None)  # no texts of blocks
    assert expected and sorted(map(repr, passages.pair_rows(passages.exact_spans(rows), lengths).collect())) == expected
