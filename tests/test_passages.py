import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.operators import passages
from lectern.operators.components import components

SOURCE = "bucket_id long, text string"


def sources(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), SOURCE)


def seeded(spark, seed, least, *texts, edits=0):
    rows = sources(spark, *texts)
    return rows, passages.spans(rows, passages.seed_pairs(rows, seed), len(seed), least, edits)


def clusters(rows, found, n=2):
    kept = passages.uncontained(passages.exact_occurrences(rows, found, n), n)
    out = {}
    for r in passages.located(kept, rows).collect():
        out.setdefault(r["passage"], set()).add((r["bucket_id"], r["start"]))
    return out


def test_two_and_three_texts(spark):
    rows, found = seeded(spark, "PAS", 12, "aaaSHARED-PASSAGE-ALPHAbbb", "cccSHARED-PASSAGE-ALPHAddd")
    assert clusters(rows, found) == {"SHARED-PASSAGE-ALPHA": {(0, 3), (1, 3)}}
    rows, found = seeded(spark, "PAS", 12, "xTRIPLE-PASSAGEy", "zzTRIPLE-PASSAGEq", "TRIPLE-PASSAGE")
    assert clusters(rows, found, 3) == {"TRIPLE-PASSAGE": {(0, 1), (1, 2), (2, 0)}}


def test_overlapping_with_itself_is_none(spark):
    _, found = seeded(spark, "AAA", 6, "AAAAAAA")
    assert found.count() == 0
    with pytest.raises(ValueError, match="more than"):
        passages.seed_pairs(sources(spark, "AAAAAAA"), "A", 3)


def brute_spans(texts, least):
    """All maximal common spans of two texts that are long enough."""
    out = set()
    for (i, a), (j, b) in itertools.combinations_with_replacement(enumerate(texts), 2):
        for shift in range(-len(b), len(a) + 1):
            if i == j and shift <= 0:
                continue
            run = 0
            for p in range(max(0, shift), min(len(a), len(b) + shift) + 1):
                same = p < len(a) and p - shift < len(b) and a[p] == b[p - shift]
                if same:
                    run += 1
                    continue
                if run >= least:
                    sa, sb = (p - run, p), (p - shift - run, p - shift)
                    if i == j:
                        if not (sa[0] < sb[1] and sb[0] < sa[1]):
                            out.add((i, *min(sa, sb), j, *max(sa, sb)))
                    else:
                        out.add((i, *sa, j, *sb))
                run = 0
    return out


@pytest.mark.parametrize("seed", range(4))
def test_scan_finds_every_long_span(spark, seed):
    rng = random.Random(seed)
    shared = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(10, 40))) for _ in range(4)]
    texts = ["".join(rng.choice(shared) if rng.random() < 0.4 else "".join(rng.choice("uvwxyz") for _ in range(rng.randrange(8))) for _ in range(5)) for _ in range(12)]
    rows = sources(spark, *texts)
    found = {tuple(r)[:6] for r in passages.scan(rows, 5, 12, 10_000).collect()}
    assert found == brute_spans(texts, 12)
    for parts in (1, 5):
        assert {tuple(r)[:6] for r in passages.scan(rows.repartition(parts), 5, 12, 10_000).collect()} == found


def test_hot_anchors_and_targets(spark):
    rows = sources(spark, *["common passage text here " + str(i) for i in range(6)], "unrelated words only")
    anchors = passages.winnow(rows, 6, 12)
    assert passages.anchor_pairs(anchors, 5).count() == 0
    assert passages.anchor_pairs(anchors, 6).count() > 0
    target = rows.where("bucket_id = 2").select("bucket_id")
    assert {2 in (r["bucket_a"], r["bucket_b"]) for r in passages.anchor_pairs(anchors, 6, target).collect()} == {True}


def test_fuzzy_spans(spark):
    base = "the quick brown fox jumps over the lazy dog"
    for other, edits, found in ((base.replace("lazy", "lazz"), 1, True), (base.replace("over ", "ove "), 1, True), (base.replace("lazy", "lxxy").replace("quick", "qzzzk"), 1, False)):
        rows, spans = seeded(spark, "fox", 40, "aa" + base + "bb", "cc" + other + "dd", edits=edits)
        assert (spans.count() > 0) == found
    rows, spans = seeded(spark, "fox", 20, base, base.replace("lazy", "lazz"), base.replace("lazy", "lozy"), edits=1)
    got = passages.fuzzy_occurrences(rows, spans, 1).collect()
    assert {r["bucket_id"] for r in got} == {0, 1, 2}
    assert {r["edits"] for r in got} >= {0, 1}
    assert all((r["edits"] == 0) == (r["ops"] == "") for r in got)


@pytest.mark.parametrize(
    ("a", "b", "k", "want"),
    [("abcx", "abcy", 0, (3, 3, 0)), ("abcxdef", "abcydef", 1, (7, 7, 1)), ("abcdef", "abdef", 1, (6, 5, 1)), ("abdef", "abcdef", 1, (5, 6, 1)), ("", "abc", 1, (0, 0, 0)), ("abXXef", "abYYef", 1, (2, 2, 0)), ("abXXef", "abYYef", 2, (6, 6, 2))],
)
def test_reach(a, b, k, want):
    x, y = (np.frombuffer(t.encode("utf-32-le"), dtype="<u4") for t in (a, b))
    assert passages.reach(x, y, k)[k] == want


def brute_uncontained(groups, least):
    kept = []
    for name, spans in sorted(groups.items(), key=lambda g: (-(g[1][0][2] - g[1][0][1]), g[0])):
        length = spans[0][2] - spans[0][1]
        if not any(o[0][2] - o[0][1] >= length and sum(any(b == c and s >= t and e <= u for c, t, u in o) for b, s, e in spans) >= least for _, o in kept):
            kept.append((name, spans))
    return {name for name, _ in kept}


@pytest.mark.parametrize("seed", range(3))
def test_containment_is_greedy_on_kept_clusters(spark, seed):
    rng = random.Random(seed)
    groups = {}
    for i in range(40):
        length = rng.randrange(2, 12)
        groups[f"c{i:02d}"] = sorted({(rng.randrange(3), s, s + length) for s in (rng.randrange(25) for _ in range(rng.randrange(2, 5)))})
    rows = [(name, e - s, b, s, e) for name, spans in groups.items() for b, s, e in spans]
    df = spark.createDataFrame(rows, "cluster string, length int, bucket_id long, start int, end int")
    assert {r["cluster"] for r in passages.uncontained(df).select("cluster").distinct().collect()} == brute_uncontained(groups, 2)


def test_pairs_merge_their_spans(spark):
    found = spark.createDataFrame([(1, 0, 10, 2, 5, 15, 0), (1, 8, 20, 2, 30, 42, 0), (1, 40, 45, 1, 60, 65, 0)], "bucket_a long, start_a int, end_a int, bucket_b long, start_b int, end_b int, edits int")
    lengths = spark.createDataFrame([(1, 100), (2, 50)], "bucket_id long, chars int")
    rows = {(r["bucket_a"], r["bucket_b"]): r for r in passages.pair_rows(found, lengths, 5).collect()}
    two = rows[1, 2]
    assert (two["chars_a"], two["chars_b"], two["longest_span"], two["longest_a"], two["longest_b"]) == (20, 22, 12, 8, 30)
    assert two["coverage_a"] == 0.2 and not two["intra"]
    assert rows[1, 1]["chars_a"] == rows[1, 1]["chars_b"] == 10 and rows[1, 1]["intra"]


def test_point_lookup(spark):
    rows = spark.createDataFrame([("c", 1, 10, 20), ("c", 2, 0, 10), ("d", 1, 15, 30), ("d", 3, 0, 15)], "cluster string, bucket_id long, start int, end int")
    at = lambda o, mode: {r["cluster"] for r in passages.at_offset(rows, 1, o, mode).collect()}
    assert at(12, "overlap") == {"c"} and at(20, "overlap") == {"d"} and at(20, "cover") == {"c", "d"} and at(5, "cover") == set()
    assert {tuple(r) for r in passages.lookup(rows, 1, 12).select("cluster", "bucket_id").collect()} == {("c", 2)}
    assert passages.directed(rows, [1]).count() == 2


def test_sketches_find_near_copies(spark):
    rng = random.Random(1)
    base = [f"w{rng.randrange(300)}" for _ in range(200)]
    near = list(base)
    near[50] = "other"
    rows = sources(spark, " ".join(base), " ".join(near), " ".join(f"z{rng.randrange(300)}" for _ in range(200)), "ab", "")
    sketches = passages.minhash(rows)
    pairs = passages.similarity(passages.band_pairs(sketches), sketches).collect()
    assert [(r["bucket_a"], r["bucket_b"]) for r in pairs] == [(0, 1)]
    assert pairs[0]["similarity"] > 0.85


def test_sketch_pairs_against_brute_force(spark):
    """Every pair that agrees in a band is given with its similarity, among copies and near copies too."""
    rng = random.Random(2)
    base = [f"w{rng.randrange(300)}" for _ in range(120)]
    texts = []
    for i in range(8):
        near = list(base)
        for at in rng.sample(range(120), 3 * i):
            near[at] = f"n{i}"
        texts += [" ".join(near)] * (3 if i % 3 == 0 else 1)
    sketches = passages.minhash(sources(spark, *texts, "zzzzzz", "ab"))
    own = sorted((r["bucket_id"], r["sketch"]) for r in sketches.collect())
    want = {}
    for i, (a, x) in enumerate(own):
        for b, y in own[i + 1 :]:
            if any(x[k : k + 8] == y[k : k + 8] for k in range(0, 128, 8)):
                want[a, b] = sum(p == q for p, q in zip(x, y, strict=True)) / 128
    rows = [tuple(r) for r in passages.similar_pairs(sketches).collect()]
    assert len(rows) == len(want) and {(a, b): s for a, b, s in rows} == want
    assert {tuple(r) for r in passages.band_pairs(sketches).collect()} == set(want)


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(20)]
    label = {n: n for e in edges if e[0] != e[1] for n in e}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            if a != b:
                low = min(label[a], label[b])
                changed |= label[a] != low or label[b] != low
                label[a] = label[b] = low
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == label


def test_estimate_scales_a_sample(spark):
    rows = sources(spark, *["some words of a text that is long enough " + str(i) for i in range(50)])
    guess = passages.estimate(rows, 6, 12, 1.0)
    assert guess["sources"] == 50 and guess["anchors"] == passages.winnow(rows, 6, 12).count()


@pytest.mark.parametrize("seed", range(4))
def test_reach_against_all_alignments(seed):
    """The farthest common start within a budget, ended on agreement or where a text ends, by trying all pairs of ends."""
    rng = random.Random(seed)
    for _ in range(40):
        a, b = ("".join(rng.choice("ab") for _ in range(rng.randrange(1, 9))) for _ in range(2))
        rows = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a) + 1):
            for j in range(len(b) + 1):
                rows[i][j] = max(i, j) if not i or not j else min(rows[i - 1][j - 1] + (a[i - 1] != b[j - 1]), rows[i - 1][j] + 1, rows[i][j - 1] + 1)
        x, y = (np.frombuffer(t.encode("utf-32-le"), dtype="<u4") for t in (a, b))
        for budget in range(4):
            ends = [i + j for i in range(len(a) + 1) for j in range(len(b) + 1) if rows[i][j] <= budget and (i == len(a) or j == len(b) or i and j and a[i - 1] == b[j - 1] and rows[i][j] == rows[i - 1][j - 1])]
            i, j, used = passages.reach(x, y, budget)[budget]
            assert rows[i][j] <= used <= budget
            assert i + j <= max([0, *ends])
            assert i + j >= max([0, *ends]) - budget  # of frontiers the farthest in a text counts, which may differ from the longest by the budget


@pytest.mark.parametrize("edits", [0, 1])
def test_spans_do_not_depend_on_blocks(spark, monkeypatch, edits):
    rng = random.Random(11)
    shared = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(15, 40))) for _ in range(4)]
    texts = ["".join(rng.choice(shared) if rng.random() < 0.5 else "".join(rng.choice("uvwxyz") for _ in range(rng.randrange(8))) for _ in range(6)) for _ in range(15)] + [shared[0] * 3, "", None]
    rows = sources(spark, *texts)
    found = []
    for block, least in ((1_000_000, 1), (1_000_000, 6), (60, 1)):
        monkeypatch.setattr(passages, "BLOCK", block)
        monkeypatch.setattr(passages, "LEAST_BLOCKS", least)
        found.append(sorted(map(repr, passages.scan(rows, 5, 12, 10_000, edits).collect())))
    assert found[0] == found[1] == found[2] and found[0]
    if not edits:  # spans from elsewhere have no hash, and make the same clusters
        spans = passages.scan(rows, 5, 12, 10_000)
        both = [sorted(map(repr, passages.exact_occurrences(rows, x).collect())) for x in (spans, spans.drop("passage"))]
        assert both[0] == both[1] and both[0]
    hashes = {(bytes(r["passage"]), texts[r["bucket_a"]][r["start_a"] : r["end_a"]]) for r in passages.scan(rows, 5, 12, 10_000).collect()}
    assert len({h for h, _ in hashes}) == len({t for _, t in hashes}) == len(hashes)


def test_minhash_estimates_similarity(spark):
    a = "".join(chr(97 + i * 7 % 26) + str(i) for i in range(300))
    rows = sources(spark, a, a, a[: len(a) * 9 // 10] + "zzz" * 20, "q" * 3, None, "completely other words, nothing in common at all here")
    found = {(r["bucket_a"], r["bucket_b"]): r["similarity"] for r in passages.similar_pairs(passages.minhash(rows)).collect()}
    assert found[0, 1] == 1.0
    grams = [{t[i : i + 5] for i in range(len(t) - 4)} for t in (a, a[: len(a) * 9 // 10] + "zzz" * 20)]
    assert abs(found[0, 2] - len(grams[0] & grams[1]) / len(grams[0] | grams[1])) < 0.15
    assert not any(4 in pair or 5 in pair for pair in found)


@pytest.mark.parametrize("listed", [2, 256])
def test_distances_of_a_group(spark, monkeypatch, listed):
    """Listed or compared one by one, distances are those of every pair, and no single task has them all."""
    monkeypatch.setattr(passages, "LISTED", listed)
    texts = ["abc", "abd", "abc", None, "xyzxyz", "abcd", ""]
    rows = spark.createDataFrame([(g, k, t) for g in "pq" for k, t in enumerate(texts if g == "p" else texts[:3])], "g string, key long, text string").coalesce(1)
    found = passages.distances(rows, ["g"], 2)

    def far(a, b):
        if a is None or b is None:
            return None
        line = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            line, before = [i], line
            for j, y in enumerate(b, 1):
                line.append(min(before[j] + 1, line[-1] + 1, before[j - 1] + (x != y)))
        return min(line[-1], 3)

    expected = {(g, i, j, far(own[i], own[j])) for g, own in (("p", texts), ("q", texts[:3])) for i in range(len(own)) for j in range(i + 1, len(own))}
    got = [tuple(r) for r in found.collect()]
    assert len(got) == len(expected) and set(got) == expected
    many = spark.createDataFrame([("p", k, "abc") for k in range(200)], "g string, key long, text string").coalesce(1)
    busy = passages.distances(many, ["g"], 2).groupBy(F.spark_partition_id()).count().collect()
    assert len(busy) > 1 and sum(r["count"] for r in busy) == 200 * 199 // 2


@pytest.mark.parametrize("edits", [0, 1])
def test_pairs_along_one_passage_are_one(spark, monkeypatch, edits):
    """Pairs that others lead up to are left out, and the spans are those of all pairs, also behind anchors that are too frequent."""
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    common, long = word(40), word(400)
    text = long[:200] + common + long[200:]
    rows = sources(spark, text, text[:300] + "#" + text[301:], word(50) + text[100:] + word(20), text + word(10) + text[50:150], *[common + word(30) for _ in range(8)])
    anchors = passages.winnow(rows, 12, 24, True)
    pairs = passages.anchor_pairs(anchors, 6)
    fewer = passages.anchor_pairs(anchors, 6, seed=12)
    assert fewer.count() * 4 < pairs.count() and fewer.subtract(pairs).isEmpty()
    expected = passages.spans(rows, pairs, 12, 24, edits).collect()
    assert expected and sorted(map(repr, passages.scan(rows, 12, 24, 6, edits).collect())) == sorted(map(repr, expected))
    taken = []
    monkeypatch.setattr(passages, "spans", lambda sources, pairs, *rest: taken.append(pairs.count()))
    passages.scan(rows, 12, 24, 6, edits)
    assert taken == [fewer.count()]
