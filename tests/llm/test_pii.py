import hashlib
import re
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lectern.llm import pii
from lectern.llm.queries import op1_pii

RULES = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        d = d * 2 if i % 2 else d
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def passes(kind, text):
    digits = "".join(c for c in text if c in "0123456789")
    return {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in text.split(".")), "card": 12 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]


def brute(text):
    found = [(m.start(), n, kind, m.end()) for n, (kind, rule) in enumerate(RULES.items()) for m in re.finditer(rule, text) if passes(kind, m[0])]
    return [(kind, start, end) for start, _, kind, end in sorted(found)]


CASES = [
    "mail a.b+c@x-y.example.com, not a@b",
    "10.0.0.1 and 256.1.1.1 and 1.2.3.4.5 and 0001.02.3.4",
    "4111 1111 1111 1111 or 4111-1111-1111-1112 or 378282246310005",
    "+1 (743) 555-3824 4111111111111111 and +12",
    "中文a@b.cc é+49 30 1234567 \U0001f600 1.1.1.1",
    "",
]


def test_base_rules():
    for text in CASES:
        assert pii.base_spans(text) == brute(text)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(["a", "b_", "@", ".", "1", "0", "25", "256", "+", "-", " ", "(", ")", "é", "a@b", ".c"]), max_size=40))
def test_base_rules_of_odd_texts(parts):
    assert pii.base_spans("".join(parts)) == brute("".join(parts))


RUNS = {
    "letters": "a" * 10**6 + "@",
    "address": "a" * 10**6 + "@b.c" + "d" * 10**6,
    "signs": "a@" * 500_000,
    "digits": "1" * 10**6,
    "dots": "1." * 500_000,
    "zeros": "0" * 10**6 + ".1.2.3",
    "spaced": "1 " * 500_000 + "a",
    "written": "a(at)" * 200_000,
    "plus": "+1" * 500_000,
}


@pytest.mark.parametrize("name", RUNS)
def test_long_runs_take_linear_time(name):
    """A megabyte without a space, with more digits than an integer may have, takes seconds and not hours."""
    began = time.time()
    base = pii.base_spans(RUNS[name])
    pii.mentions(RUNS[name], base)
    assert time.time() - began < 15
    assert [k for k, _, _ in base][:1] == {"address": ["email"], "dots": ["ip"], "zeros": ["ip"]}.get(name, [])


def test_zeros_before_a_part():
    assert pii.base_spans("0" * 5000 + ".1.2.3") == [("ip", 0, 5006)]
    assert pii.base_spans("0" * 5000 + "256.1.2.3") == []


def test_skip_weights_are_learned():
    """From hidden second mentions: kinds that were seen pull, others do not, and nothing is pulled apart."""
    docs = [pii.mentions(t, pii.base_spans(t)) for t in ["call +1 (743) 555-3824 now", "mail x.y@mail1.example.com"] * 40]
    skip = pii.fit(docs).skip
    seen = [pii.KINDS.index(k) + 1 for k in ("email", "phone")]
    assert all(skip[i, i] > 2 for i in seen)
    assert skip.sum() == pytest.approx(sum(skip[i, i] for i in seen))
    assert not pii.fit([]).skip.any()


def test_field_makes_an_entity_consistent():
    docs = [pii.mentions(t, pii.base_spans(t)) for t in ["call +1 (743) 555-3824 now", "mail x.y@mail1.example.com", "host 10.1.2.3 is down", "card 4111111111111111 x", "total 1234567 items"] * 40]
    field = pii.fit([d for d in docs if d])
    text = "call +1 (743) 555-3824 or 7435553824; mail bob@a.example.com or bob (at) a (dot) example; 9999999 items"
    base, added = pii.all_spans(text, field)
    shown = {text[s:e] for _, s, e in added}
    assert base == brute(text)
    assert {"7435553824", "bob (at) a (dot) example"} <= shown
    assert "9999999" not in shown


def test_numbers_side_by_side_are_both_found():
    field = pii.fit([pii.mentions(t, pii.base_spans(t)) for t in ["at +1 (743) 555-3824 ok", "pay 4111111111111111 ok"] * 60])
    text = "so +1 (269) 555-3296 4524132264652876 there"
    assert pii.base_spans(text) == []
    assert {k for k, _, _ in pii.all_spans(text, field)[1]} == {"phone", "card"}


def test_whole_table(spark, data):
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    rows = op1_pii(spark, data).collect()
    assert len(rows) == len(docs)
    for r in rows:
        want = brute(docs[r["doc_id"]])
        text = ",".join(f"{k}:{s}:{e}" for k, s, e in want)
        assert r["base_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        assert [r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]] == [sum(x[0] == k for x in want) for k in pii.KINDS]
        assert set(text.split(",")) <= set(r["spans"].split(","))


def test_a_text_of_very_many_mentions_teaches_a_bounded_number(make):
    text = " ".join(f"call +1 (743) 555-{i:04d}" for i in range(5000))
    nodes = pii.mentions(text, pii.base_spans(text))
    drawn = pii._drawn(nodes, text, 64)
    assert len(nodes) == 5000 and len(drawn) == 64
    assert [m.start for m in drawn] == [m.start for m in nodes][next(i for i, m in enumerate(nodes) if m is drawn[0]) :][:64]
    assert pii._drawn(nodes[:3], text, 64) == nodes[:3]
    assert pii.train(make([(1, text), (2, "mail a@b.example.com")])).skip.any()


def test_mask_keeps_columns_and_hides_spans(nasty):
    out = pii.mask(nasty, pii.train(nasty))
    assert out.schema == nasty.schema
    rows = out.collect()
    assert len(rows) == nasty.count()
    assert not any("a@b.example.org" in (r["text"] or "") for r in rows)
    assert sum(r["text"] is None for r in rows) == 2


def test_nasty_and_empty(nasty, empty):
    rows = pii.find(nasty, pii.train(nasty)).collect()
    assert len(rows) == nasty.count()
    assert [r["spans"] for r in rows if r["doc_id"] in (2, 3)] == ["", ""]
    assert pii.find(empty, pii.train(empty)).count() == 0
