import struct
import zlib
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lectern.llm import packing
from lectern.llm.queries import op2_packing, vocabulary_path

ROOM = 2048


def slow_ids(text):
    from tokenizers import Tokenizer

    coder = Tokenizer.from_file(vocabulary_path())
    return coder.encode(text, add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))


def check(rows, texts):
    """Every id in one piece, every sequence gapless and not too long."""
    by_sequence, by_doc = defaultdict(list), defaultdict(list)
    for r in rows:
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
        by_doc[r["doc_id"]].append(r)
    for pieces in by_sequence.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= ROOM
    for doc_id, ids in texts.items():
        at = 0
        for r in sorted(by_doc[doc_id], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == crc(ids[at : at + r["length"]])
            at += r["length"]
        assert at == len(ids)
    return by_sequence


def test_whole_table(spark, data):
    docs = {r["doc_id"]: slow_ids(r["text"] or "") + [1] for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    rows = op2_packing(spark, data).collect()
    sequences = check(rows, docs)
    assert sorted(sequences) == list(range(len(sequences)))
    total = sum(map(len, docs.values()))
    assert total / (len(sequences) * ROOM) > 0.97


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=60))
def test_fast_ids_are_those_of_tokenizers(text):
    assert packing.coder(vocabulary_path()).ids(text).tolist() == slow_ids(text)


def test_special_strings_have_their_own_id():
    """As the plain call has it, with the faster library or without."""
    coder = packing.coder(vocabulary_path())
    plain = slow_ids("a <|endoftext|> b")
    assert 50256 in plain
    assert coder.ids("a <|endoftext|> b").tolist() == plain
    alone = packing.Coder(vocabulary_path())
    alone.fast = None
    for text in ("a <|endoftext|> b", "<|endoftext", "a b  c", ""):
        assert alone.ids(text).tolist() == coder.ids(text).tolist() == slow_ids(text)


@pytest.mark.parametrize("text", ["<|endoftext|>", "x<|endoftext|><|endoftext|> \n<|endoftext", " \n\n  x", "１２３ ٣٤ ²", " a\u0085b﻿", "don't I'LL we'Re", "\U0001f9d1‍\U0001f680" * 5, "a" * 5000])
def test_odd_texts_have_the_ids_of_tokenizers(text):
    assert packing.coder(vocabulary_path()).ids(text).tolist() == slow_ids(text)


@settings(max_examples=80, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 30), max_size=20))
def test_patterns_use_the_histogram_up(histogram):
    used = defaultdict(int)
    patterns = packing.shortest_pack_first(histogram, 64)
    for count, lengths in patterns:
        assert count > 0 and sum(lengths) <= 64
        for length in lengths:
            used[length] += count
    assert used == {k: v for k, v in histogram.items()}
    assert len(patterns) <= 2 * len(histogram) + 1


def test_nasty(spark, nasty):
    rows = packing.pack(nasty, vocabulary_path()).collect()
    assert sum(r["start"] == 0 for r in rows) == nasty.count()
    assert [r["length"] for r in rows if r["doc_id"] in (2, 3)] == [1, 1]
    check(rows, {})


def test_empty(empty):
    assert packing.pack(empty, vocabulary_path()).count() == 0
