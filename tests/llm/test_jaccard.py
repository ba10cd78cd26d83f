import itertools
import random

import duckdb
import pytest

from lectern.llm import jaccard, queries

NAMES = ["doc_id", "class_id", "representative", "n_copies", "n_text_links", "n_links"]


def shingles(text, n=5):
    import re

    words = re.findall("[a-z0-9\x80-\U0010ffff]+", text.lower())
    return frozenset(tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))) if words else frozenset()


def brute(rows, threshold):
    sets = {}
    for doc_id, text in rows:
        sets.setdefault(doc_id, shingles(text))
    ids = sorted(sets)
    linked = {i: set() for i in ids}
    for a, b in itertools.combinations(ids, 2):
        x, y = sets[a], sets[b]
        if x and y and len(x & y) >= threshold * len(x | y) - 1e-9:
            linked[a].add(b)
            linked[b].add(a)
    label = {}
    for i in ids:
        todo = [i] if i not in label else []
        while todo:
            j = todo.pop()
            if j not in label:
                label[j] = i
                todo += linked[j]
    out = []
    for i in ids:
        same = [j for j in ids if sets[j] == sets[i]] if sets[i] else [i]
        texts = {sets[j] for j in linked[i] if sets[j] != sets[i]}
        out.append((i, label[i], min(same), len(same), len(texts), len(linked[i])))
    return out


def got(df):
    return sorted(tuple(r[n] for n in NAMES) for r in df.where("doc_id is not null").distinct().collect())


def copies(seed, n, words=60):
    """Texts of one origin, a few words changed in each."""
    rng = random.Random(seed)
    origin = [f"w{rng.randrange(400)}" for _ in range(words)]
    for _ in range(n):
        own = list(origin)
        for _ in range(rng.randrange(4)):
            own[rng.randrange(len(own))] = f"x{rng.randrange(1000)}"
        yield " ".join(own)


@pytest.mark.parametrize("block", [150_000, 400])
def test_against_brute_force(make, monkeypatch, block):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    rng = random.Random(5)
    texts = list(copies(1, 40)) + list(copies(2, 15)) + [" ".join(f"q{rng.randrange(500)}" for _ in range(rng.randrange(1, 50))) for _ in range(40)]
    texts += ["one two", "One, two!", "", "...", "one two three", texts[0], texts[0].upper(), texts[45]]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    assert got(jaccard.join(make(rows))) == brute(rows, 0.8)


def test_banding_meets_its_recall():
    for threshold in (0.5, 0.7, 0.8, 0.9):
        for recall in (0.9, 0.99, 0.999):
            bands, rows = jaccard.banding(threshold, recall)
            assert 1 - (1 - threshold**rows) ** bands >= recall


def test_candidates_reach_recall():
    """Pairs just above the threshold share a band as often as the banding says."""
    bands, rows = jaccard.banding(0.8, 0.999)
    rng = random.Random(3)
    hit = 0
    for i in range(300):
        common, own = 160, 20
        a = sorted({rng.getrandbits(63) for _ in range(common)})
        import numpy as np

        x = np.unique(np.array(a + [rng.getrandbits(63) for _ in range(own)], dtype=np.uint64))
        y = np.unique(np.array(a + [rng.getrandbits(63) for _ in range(own)], dtype=np.uint64))
        hit += bool((jaccard.bands_of(x, bands, rows) == jaccard.bands_of(y, bands, rows)).any())
    assert hit >= 297


def test_sql_says_the_same(spark, data):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{data}/documents.parquet'")
    want = con.sql(f"select {', '.join(NAMES)} from ({queries.ORACLE['op8_jaccard']})").fetchall()
    assert sorted(tuple(r[n] for n in NAMES) for r in queries.op8_jaccard(spark, data).collect()) == sorted(want)


def test_nasty_and_empty(nasty, empty):
    rows = jaccard.join(nasty).collect()
    assert len(rows) == nasty.count()
    found = {r["doc_id"]: r for r in rows}
    assert found[None]["class_id"] is None
    assert found[8]["class_id"] == 1 and found[5]["class_id"] == 4
    assert found[2]["class_id"] == 2 and found[2]["n_links"] == 0 and found[6]["class_id"] == 6
    assert jaccard.join(empty).count() == 0


def test_keep_judges_rows_that_repeat_an_id_by_their_text(make):
    """No text is lost whose class has no other row, and no copy stays beside its class's least document."""
    a, z, other = "the cat sat on the mat all day long", "a quite different text about ships at sea", "and one more that nobody else has written"
    rows = [(0, a), (1, a), (1, z), (2, z.upper()), (1, other), (3, ""), (3, ""), (3, "..."), (4, ""), (None, a)]
    kept = [tuple(r) for r in jaccard.keep(make(rows)).select("doc_id", "text").collect()]
    assert sorted(kept, key=repr) == sorted([(0, a), (1, z), (1, other), (3, ""), (3, "..."), (4, ""), (None, a)], key=repr)


def test_keep_against_brute_force(make):
    rng = random.Random(9)
    texts = list(copies(3, 25)) + list(copies(4, 10)) + [" ".join(f"q{rng.randrange(500)}" for _ in range(rng.randrange(1, 50))) for _ in range(20)]
    rows = list(enumerate(rng.sample(texts, len(texts))))
    least = {(i, t) for (i, t), (_, class_id, *_) in zip(rows, brute(rows, 0.8), strict=True) if i == class_id}
    assert {(r["doc_id"], r["text"]) for r in jaccard.keep(make(rows)).collect()} == least


def test_two_blocks_compare_what_shares_a_bucket(make, monkeypatch):
    """A chain of texts, each near the next, in many blocks: its links are found, and far members are not shipped."""
    monkeypatch.setattr(jaccard, "BLOCK", 300)
    words = [f"w{i}" for i in range(900)]
    rows = [(i, " ".join(words[6 * i : 6 * i + 120])) for i in range(100)]
    shipped = []
    verified = jaccard._verified
    monkeypatch.setattr(jaccard, "_verified", lambda members, *rest: shipped.append(members.count()) or verified(members, *rest))
    assert got(jaccard.join(make(rows))) == brute(rows, 0.8)
    assert shipped[0] < 100 * 20


def test_keep_leaves_one_of_each_class(nasty, empty):
    kept = jaccard.keep(nasty)
    assert kept.columns == nasty.columns
    ids = [r["doc_id"] for r in kept.collect()]
    # the other text with the id 1 is in no other document, so it stays too
    assert sorted(i for i in ids if i is not None) == [1, 1, 2, 3, 4, 6, 7, 9]
    assert ids.count(None) == 2
    assert jaccard.keep(empty).count() == 0
