import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st

from lectern.llm import merkle
from lectern.llm.queries import op10_merkle


def brute(rows):
    """Rows by doc_id descending, the next one of the last being the first."""
    ordered = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    out = []
    for (doc_id, text), (_, following) in zip(ordered, ordered[1:] + ordered[:1], strict=True):
        half = len(text) // 2
        changed = text[: len(text) - half] + following[:half]
        a, b, c = merkle.tree(text), merkle.tree(changed), merkle.tree(following)
        gone = merkle.differences(a, b)[0] if text != changed else []
        located = (min(x.start for x in gone), max(x.end for x in gone)) if gone else (None, None)
        out.append((doc_id, len(text), hashlib.sha256(changed.encode()).hexdigest(), a.digest.hex(), b.digest.hex(), merkle.likeness(a, b), merkle.likeness(a, c), *located))
    return sorted(out, key=repr)


def rows_of(df):
    return sorted((tuple(r[n] for n in merkle.NAMES) for r in df.collect()), key=repr)


def test_whole_table(spark, data):
    docs = [(r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    got = rows_of(op10_merkle(spark, data))
    assert got == brute(docs)
    near = [r for r in got if r[1] > 400]
    assert sum(r[5] > r[6] for r in near) > 0.95 * len(near)


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="ab .\n", max_size=80), st.text(alphabet="ab .\n", max_size=80))
def test_tree_covers_the_text_and_roots_test_equality(a, b):
    x, y = merkle.tree(a), merkle.tree(b)
    for tree, text in ((x, a), (y, b)):
        at = 0
        for leaf in tree.leaves():
            assert leaf.start == at
            at = leaf.end
        assert at == len(text)
    assert (x.digest == y.digest) == (a == b)
    assert 0 <= merkle.likeness(x, y) <= 1
    assert merkle.likeness(x, y) == merkle.likeness(y, x)
    assert (merkle.likeness(x, y) == 1) >= (a == b)


def test_differing_branches_locate_the_edit():
    paragraphs = [f"This is paragraph {i}. It has two sentences." for i in range(20)]
    old = "\n\n".join("\n".join(paragraphs[i : i + 5]) for i in range(0, 20, 5))
    new = old.replace("paragraph 12", "paragraph twelve")
    only_old, only_new = merkle.differences(merkle.tree(old), merkle.tree(new))
    assert [old[x.start : x.end] for x in only_old] == ["This is paragraph 12. "]
    assert [new[x.start : x.end] for x in only_new] == ["This is paragraph twelve. "]


def test_rows_that_share_an_id_span_partitions(spark, make):
    """Neighbours go by doc_id, then text, wherever partitions end."""
    rows = [(None if i % 3 == 0 else i // 40, f"text {i * 7919 % 200} here. More of it. {'x' * (i % 5)}") for i in range(200)] + [(4, "a"), (4, "a"), (None, "")]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert rows_of(merkle.fingerprints(make(rows))) == brute(rows)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_nasty_single_and_empty(make, nasty, empty):
    assert rows_of(merkle.fingerprints(nasty)) == brute([(r["doc_id"], r["text"] or "") for r in nasty.collect()])
    assert rows_of(merkle.fingerprints(make([(5, "alone here.")]))) == brute([(5, "alone here.")])
    assert merkle.fingerprints(empty).count() == 0
