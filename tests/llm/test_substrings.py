import hashlib
import random

import duckdb
import pytest

from lectern.llm import queries, substrings


def brute(rows, length):
    """Rows of (doc_id, text): every window against every other document's."""
    words = [[w for w in text.encode().split()] for _, text in rows]
    first = {}
    for (doc_id, _), own in zip(rows, words, strict=True):
        if doc_id is not None:
            for i in range(len(own) - length + 1):
                key = tuple(own[i : i + length])
                first[key] = min(doc_id, first.get(key, doc_id))
    out = []
    for (doc_id, _), own in zip(rows, words, strict=True):
        gone = set()
        if doc_id is not None:
            for i in range(len(own) - length + 1):
                if first[tuple(own[i : i + length])] < doc_id:
                    gone.update(range(i, i + length))
        kept = [w for i, w in enumerate(own) if i not in gone]
        out.append((doc_id, len(own), len(gone), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_words", "n_removed", "kept_sha256").collect()), key=repr)


@pytest.mark.parametrize(("seed", "length"), [(0, 6), (1, 7), (2, 10)])
def test_against_brute_force(make, seed, length):
    rng = random.Random(seed)
    passages = [[rng.choice("abcdefgh") + str(rng.randrange(6)) for _ in range(rng.randrange(4, 40))] for _ in range(8)]
    rows = []
    for i in range(60):
        parts = [p for _ in range(rng.randrange(1, 5)) for p in (rng.choice(passages) if rng.random() < 0.5 else [f"u{rng.randrange(50)}" for _ in range(rng.randrange(12))])]
        rows.append((rng.choice([i, i, i, 7]), rng.choice([" ", "\n", "  "]).join(parts)))
    rows += [(100 + i, rows[3][1]) for i in range(5)] + [(50, "x " * 30), (51, "x " * 45)]
    assert got(substrings.deduplicate(make(rows), length)) == brute(rows, length)


def test_sql_says_the_same(spark, data):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{data}/documents.parquet'")
    want = con.sql(f"select doc_id, n_words, n_removed, kept_sha256 from ({queries.ORACLE['op4_substrings']})").fetchall()
    assert got(queries.op4_substrings(spark, data)) == sorted(want, key=repr)


def test_nasty_and_empty(nasty, empty):
    rows = [(r["doc_id"], r["text"] or "") for r in nasty.collect()]
    assert got(substrings.deduplicate(nasty, 10)) == brute(rows, 10)
    assert substrings.deduplicate(empty).count() == 0


def test_longest_doubles_until_none_survive(make):
    shared = [f"w{i}" for i in range(45)]
    rows = [(1, " ".join(shared)), (2, " ".join(["a", *shared, "b"])), (3, " ".join(shared[:12])), (4, "nothing of it here at all, nothing of it")]
    found = {r["doc_id"]: r["repeated"] for r in substrings.longest(make(rows), 10).collect()}
    assert found == {1: 40, 2: 40, 3: 10}


@pytest.mark.parametrize("seed", [4, 5])
def test_longest_against_brute_force(make, seed):
    """The greatest doubling of the length at which a window of a document is also in another one, trying all windows."""
    rng = random.Random(seed)
    passages = [[f"w{rng.randrange(30)}" for _ in range(rng.choice([5, 9, 17, 40]))] for _ in range(6)]
    rows = [(i, [w for _ in range(rng.randrange(1, 4)) for w in (rng.choice(passages) if rng.random() < 0.7 else [f"u{rng.randrange(10**6)}" for _ in range(9)])]) for i in range(30)]
    rows += [(100 + i, rows[i][1]) for i in range(3)] + [(200, [f"only{i}" for i in range(20)]), (201, [f"only{i}" for i in range(20)])]
    want = {}
    length = 4
    while True:
        where = {}
        for doc_id, own in rows:
            for i in range(len(own) - length + 1):
                where.setdefault(tuple(own[i : i + length]), set()).add(doc_id)
        level = {d for docs in where.values() if len(docs) > 1 for d in docs}
        if not level:
            break
        want |= dict.fromkeys(level, length)
        length *= 2
    assert {r["doc_id"]: r["repeated"] for r in substrings.longest(make([(d, " ".join(own)) for d, own in rows]), 4).collect()} == want


def test_lengths_sql_says_the_same(spark, data):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{data}/documents.parquet'")
    want = con.sql(f"select doc_id, repeated from ({queries.ORACLE['repeated_lengths']})").fetchall()
    assert sorted((r["doc_id"], r["repeated"]) for r in queries.repeated_lengths(spark, data).collect()) == sorted(want)
