import random

import numpy as np
import pytest

from lectern.llm import decontaminate
from lectern.llm.queries import op7_decontamination


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


@pytest.mark.parametrize("seed", range(5))
def test_longest_common_subsequence(seed):
    rng = random.Random(seed)
    a, b = ([rng.randrange(6) for _ in range(rng.randrange(1, 80))] for _ in range(2))
    assert decontaminate.Pattern(np.array(a, dtype=np.uint64)).lcs(b) == lcs(a, b)


def test_svd_spans_the_leading_directions(spark):
    rng = np.random.default_rng(2)
    dense = rng.normal(size=(60, 5)) @ rng.normal(size=(5, 40)) + 0.01 * rng.normal(size=(60, 40))
    rows = spark.createDataFrame([(list(range(40)), r.tolist()) for r in dense], "terms array<int>, weights array<float>")
    basis = decontaminate.randomised_svd(rows, 40, 5)
    _, _, exact = np.linalg.svd(dense, full_matrices=False)
    assert np.linalg.norm(exact[:5] @ basis) ** 2 == pytest.approx(5, abs=1e-2)


def passages(rng, n, size=30):
    common = [f"c{i}" for i in range(30)]
    return [" ".join(rng.choice(common) if rng.random() < 0.4 else f"r{rng.randrange(3000)}" for _ in range(size)) + "." for _ in range(n)]


@pytest.mark.parametrize("rank", [256, 24])
def test_recall_against_brute_force(spark, make, monkeypatch, rank):
    """Copies and paraphrases are found, also with fewer dimensions than passages; others are left alone."""
    rng = random.Random(4)
    items = passages(rng, 60)
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    docs, want = [], set()
    for i in range(300):
        words = " ".join(passages(rng, rng.randrange(1, 8), 40)).split()
        if i % 3 == 0:
            item = rng.randrange(60)
            leak = items[item].split()
            if i % 2:  # a paraphrase: a fifth of the words go, but not those of the end
                leak = [w for j, w in enumerate(leak) if j > 24 or rng.random() > 0.2]
            at = rng.randrange(len(words))
            words[at:at] = leak
            want.add((i, item))
        docs.append((i, " ".join(words)))
    # the last sentence is the passage, so the answer check asks for much of it
    found = {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(make(docs), benchmark, decontaminate.Rules(lcs=0.7), rank).collect()}
    assert len(found & want) >= 0.95 * len(want)
    assert not found - want


@pytest.mark.parametrize("size", [61, 200, 300, 1000])
def test_long_passages(spark, make, size):
    """A passage that is longer than a window is found, whole and with a fifth of its words dropped; others are left alone."""
    rng = random.Random(size)
    items = passages(rng, 20, size)
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    docs, want = [], set()
    for i in range(60):
        words = " ".join(passages(rng, rng.randrange(1, 8), 100)).split()
        if i % 3:
            leak = items[i % 20].split()
            at = rng.randrange(len(words))
            words[at:at] = leak if i % 3 == 1 else [w for w in leak if rng.random() > 0.2]
            want.add((i, i % 20))
        docs.append((i, " ".join(words)))
    found = {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(make(docs), benchmark, decontaminate.Rules(lcs=0.65)).collect()}
    assert found == want
    assert {r["doc_id"] for r in decontaminate.clean(make(docs), benchmark, decontaminate.Rules(lcs=0.65)).collect()} == set(range(60)) - {i for i, _ in want}


def test_more_passages_than_dimensions(spark, data):
    """Cosines are exact at any size: 1,000 passages of real texts are all found where they come from."""
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").orderBy("doc_id").limit(500)
    texts = [(r["doc_id"], words) for r in docs.collect() if len(words := (r["text"] or "").split()) >= 65]
    rng = random.Random(5)
    items, want = [], set()
    for item in range(1000):
        doc_id, words = texts[item % len(texts)]
        size = rng.randrange(15, 60)
        at = rng.randrange(len(words) - size)
        items.append((item, " ".join(words[at : at + size])))
        want.add((doc_id, item))
    found = {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(docs, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert len(want - found) == 0


def test_answers_confirm_paraphrases():
    assert decontaminate.answer_of("What is it?\nAnswer: blue whale") == "blue whale"
    assert decontaminate.answer_of("First one. The second sentence.") == "The second sentence."
    assert decontaminate.answer_of(" ".join(f"w{i}" for i in range(30)) + ".") == " ".join(f"w{i}" for i in range(20, 30)) + "."
    assert decontaminate.answer_of("few words are their own answer") == "few words are their own answer"


def test_verbatim_passages_of_all_sizes(spark, make):
    """At the query's own rules, whole copies of 1 to 5,000 words are all found, and nothing else is."""
    rng = random.Random(12)
    sizes = [1, 3, 7, 8, 12, 20, 30, 59, 60, 61, 90, 150, 182, 200, 250, 300, 500, 1000, 2000, 5000]
    items = [passages(rng, 1, n)[0] if n >= 8 else " ".join(f"short{n}x{i}" for i in range(n)) for n in sizes]
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    docs, want = [], set()
    for i in range(3 * len(items)):
        words = " ".join(passages(rng, rng.randrange(1, 8), 60)).split()
        if i < 2 * len(items):
            at = rng.randrange(len(words))
            words[at:at] = items[i % len(items)].split()
            want.add((i, i % len(items)))
        docs.append((i, " ".join(words)))
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(make(docs), benchmark).collect()} == want
    assert {r["doc_id"] for r in decontaminate.clean(make(docs), benchmark).collect()} == {i for i, _ in docs} - {i for i, _ in want}


def holds(text, passage, answer, width, rules):
    """Does some run of at most ``width`` words of a text meet the rules? Every run is tried."""
    for at in range(0, max(1, len(text) - width + 1)):
        near = text[at : at + width]
        ratio = lcs(passage, near) / len(passage)
        if ratio >= rules.lcs or (ratio >= rules.paraphrase and lcs(answer, near) >= rules.answer * len(answer)):
            return True
    return False


@pytest.mark.parametrize(("size", "dropped"), [(12, 0.1), (30, 0.2), (30, 0.35), (50, 0.25)])
def test_paraphrases_against_brute_force(spark, make, size, dropped):
    """At the query's own rules: what every run of a text, tried one by one, says is a leak is found, to 0.95 at least."""
    rules = decontaminate.Rules()
    rng = random.Random(size)
    items = passages(rng, 12, size)
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    docs = []
    for i in range(72):
        words = " ".join(passages(rng, rng.randrange(1, 3), 40)).split()
        if i % 4:
            leak = [w for j, w in enumerate(items[i % 12].split()) if rng.random() > dropped or j > 0.6 * size and i % 2]
            at = rng.randrange(len(words))
            words[at:at] = leak
        docs.append((i, " ".join(words)))
    found = {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(make(docs), benchmark).collect()}
    own = [(decontaminate.words_of(t).tolist(), decontaminate.words_of(decontaminate.answer_of(t)).tolist()) for t in items]
    texts = [decontaminate.words_of(t).tolist() for _, t in docs]
    want = {(i, k) for i, text in enumerate(texts) for k, (p, a) in enumerate(own) if i % 12 == k and holds(text, p, a, size, rules)}
    most = {(i, k) for i, text in enumerate(texts) for k, (p, a) in enumerate(own) if holds(text, p, a, 2 * decontaminate.STEP + 2 * size, rules)}
    assert len(want) > 20
    assert len(found & want) >= 0.95 * len(want)
    assert found <= most


def test_many_rounds_and_passes(spark, make, monkeypatch):
    """Several passes for the words and several rounds for the units change no result."""
    rng = random.Random(21)
    items = passages(rng, 20)
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    docs = make([(i, "before it " + t + " and after") for i, t in enumerate(items)] + [(98, None), (99, "clean words alone here"), (None, items[3])])
    once = sorted(map(repr, decontaminate.leaks(docs, benchmark).select("doc_id", "item_id", "lcs_ratio").collect()))
    monkeypatch.setattr(decontaminate, "TERMS", 100)
    monkeypatch.setattr(decontaminate, "GROUPS", 2)
    assert sorted(map(repr, decontaminate.leaks(docs, benchmark, rank=4).select("doc_id", "item_id", "lcs_ratio").collect())) == once
    kept = decontaminate.clean(docs, benchmark, rank=4)
    assert kept.schema == docs.schema
    assert sorted(r["doc_id"] for r in kept.collect()) == [98, 99]


def test_whole_table(spark, data):
    """Every document that holds all words of a passage in a row is found, and no document that shares little with it."""
    items = {r["item_id"]: decontaminate.words_of(r["text"]).tolist() for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()}
    docs = {r["doc_id"]: decontaminate.words_of(r["text"] or "").tolist() for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    whole, near = set(), set()
    for doc_id, words in docs.items():
        at = set(zip(words, words[1:], words[2:], strict=False))
        for item_id, own in items.items():
            share = sum(g in at for g in zip(own, own[1:], own[2:], strict=False)) / max(1, len(own) - 2)
            whole |= {(doc_id, item_id)} if share == 1 else set()
            near |= {(doc_id, item_id)} if share > 0.3 else set()
    found = {(r["doc_id"], r["item_id"]) for r in op7_decontamination(spark, data).collect()}
    assert whole <= found <= near


def test_blocks_of_the_benchmark(spark, make, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_ITEMS", 7)
    items = passages(random.Random(1), 20)
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    docs = make([(i, "before it " + t + " and after") for i, t in enumerate(items)] + [(99, "clean words alone here")])
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(docs, benchmark).collect()} == {(i, i) for i in range(20)}
    assert [r["doc_id"] for r in decontaminate.clean(docs, benchmark).collect()] == [99]


def test_nasty_and_empty(spark, nasty, empty):
    rows = [(1, "The cat sat on the mat and looked at the door for a while."), (1, None), (2, ""), (3, "word5 and5"), (None, "word1 and1 word2 and2 word3 and3 word4 and4 word5 and5 word6 and6")]
    benchmark = spark.createDataFrame(rows, "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(nasty, benchmark).collect()}
    assert {(1, 1), (8, 1), (4, None), (5, None), (4, 3)} <= found
    assert not {d for d, _ in found} & {2, 3, 6, 7, 9}
    kept = decontaminate.clean(nasty, benchmark)
    assert kept.schema == nasty.schema
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(["1", "2", "3", "None", "None", "6", "7", "9"])
    assert decontaminate.leaks(nasty, benchmark.where("item_id = 77")).count() == 0
    assert decontaminate.leaks(empty, benchmark).count() == 0
