import numpy as np
from pyspark.sql import functions as F

from lectern.llm import quality
from lectern.llm.queries import op5_quality


def test_held_out_accuracy(spark):
    data = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{data}/labels.parquet").select("doc_id", "quality")
    rows = op5_quality(spark, data).join(labels, "doc_id").where("held_out").collect()
    good = [r["score"] for r in rows if r["quality"] == 1]
    bad = [r["score"] for r in rows if r["quality"] == 0]
    auc = np.mean([[g > b for b in bad] for g in good])
    assert auc > 0.97
    assert sum((r["score"] >= 0.5) == (r["predicted"] == 1) for r in rows) == len(rows)
    assert sum(r["predicted"] == r["quality"] for r in rows) > 0.95 * len(rows)


def test_preferences_order_documents():
    rng = np.random.default_rng(0)
    rows = rng.normal(size=(600, len(quality.FEATURES)))
    labels = (rows[:, 3] - rows[:, 7] + rng.normal(scale=0.3, size=600) > 0.4).astype(int)
    ranker = quality.fit(rows[:400], labels[:400])
    assert ranker.weights[3] > 0 > ranker.weights[7]
    scores = ranker.scores(rows[400:])
    assert ((scores >= 0.5) == (labels[400:] == 1)).mean() > 0.85
    # the quantile: as many learning documents pass as are labelled good
    assert abs((ranker.scores(rows[:400]) >= 0.5).sum() - labels[:400].sum()) <= 1


def test_features_read_whole_texts():
    assert len(quality.features("")) == len(quality.FEATURES)
    assert not np.allclose(quality.features("word " * 5000), quality.features("word " * 5000 + "#$% " * 500))


def test_nasty_and_empty(spark, nasty, empty):
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (4, 0, 0), (None, 1, 0), (8, None, 1), (5, 1, 0)], "doc_id long, quality int, toxic int")
    ranker = quality.train(nasty, labels, F.lit(True))
    rows = quality.score(nasty, ranker).collect()
    assert len(rows) == nasty.count()
    assert all(0 <= r["score"] <= 1 for r in rows)
    none = quality.train(empty, labels, F.lit(True))
    assert quality.score(empty, none).count() == 0
    assert {r["score"] for r in quality.score(nasty, none).collect()} == {0.5}


def slow_features(text):
    """Character by character, as the names say."""
    kinds = {"lower": "abcdefghijklmnopqrstuvwxyz", "upper": "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": "0123456789", "space": " \t\r\x0b\x0c", "line": "\n", "stop": ".?", "pause": ",;:", "quote": "'\"()-", "bang": "!", "bar": "|", "markup": "<>{}[]\\/=_~^`", "symbol": "#$%&*+@"}
    count = dict.fromkeys([*kinds, "control", "wide"], 0)
    for byte in text.encode():
        kind = next((k for k, chars in kinds.items() if chr(byte) in chars), "wide" if byte >= 128 else "control")
        count[kind] += 1
    total = max(1, sum(count.values()))
    words = [w for w in text.encode().split()]
    n = max(1, len(words))
    lines = [x for x in text.encode().split(b"\n") if x]
    return [
        *(v / total for v in count.values()),
        np.log1p(len(words)),
        min(40.0, (total - count["space"] - count["line"]) / n),
        min(3.0, count["stop"] / n),
        min(3.0, count["pause"] / n),
        count["upper"] / max(1, count["lower"] + count["upper"]),
        len({*words}) / n if words else 1.0,
        1 - len({*lines}) / len(lines) if lines else 0.0,
        np.log1p(n / max(1, len(lines))),
        min(6.0, (count["symbol"] + count["bang"] + count["bar"]) / n),
    ]


def test_whole_table_against_brute_force(spark, data):
    """Every score is the logistic function of the fitted weights on features made character by character."""
    from lectern.llm.queries import _fold
    from lectern.llm.storage import documents, table

    docs = documents(spark, data)
    ranker = quality.train(docs, table(spark, data, "labels"), ~_fold(3, 1))
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    rows = op5_quality(spark, data).collect()
    assert len(rows) == len(texts)
    for r in rows:
        value = [(f - m) / s for f, m, s in zip(slow_features(texts[r["doc_id"]]), ranker.mean, ranker.scale, strict=True)]
        latent = sum(min(8, max(-8, v)) * w for v, w in zip(value, ranker.weights, strict=True)) - ranker.threshold
        want = 1 / (1 + np.exp(-min(30, max(-30, latent))))
        assert abs(r["score"] - want) < 1e-9 and r["predicted"] == (r["score"] >= 0.5)


def test_weights_minimise_the_loss():
    """The logistic loss on the preference pairs rises in every direction from the fitted weights."""
    rng = np.random.default_rng(1)
    width, pairs, ridge = len(quality.FEATURES), 4000, 1e-3
    rows = rng.normal(size=(300, width))
    labels = (rows[:, 0] + rng.normal(size=300) > 0).astype(int)
    ranker = quality.fit(rows, labels, pairs=pairs, ridge=ridge)
    x = np.clip((rows - ranker.mean) / ranker.scale, -8, 8)
    draw = np.random.default_rng(7)
    difference = x[draw.choice(np.flatnonzero(labels == 1), pairs)] - x[draw.choice(np.flatnonzero(labels == 0), pairs)]

    def loss(weights):
        return np.log1p(np.exp(-difference @ weights)).mean() + ridge / 2 * (weights**2).sum()

    least = loss(ranker.weights)
    for i in range(width):
        for step in (-0.01, 0.01):
            assert loss(ranker.weights + step * np.eye(width)[i]) > least
