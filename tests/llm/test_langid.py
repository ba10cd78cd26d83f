import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.llm import langid
from lectern.llm.queries import op3_language


def brute_viterbi(scores, penalty):
    """All paths of a short text."""
    import itertools

    best = None
    for path in itertools.product(range(scores.shape[1]), repeat=len(scores)):
        value = sum(scores[i, k] for i, k in enumerate(path)) - penalty * sum(a != b for a, b in zip(path, path[1:], strict=False))
        if best is None or value > best[0] + 1e-6:
            best = (value, path)
    return best


@pytest.mark.parametrize("seed", range(8))
def test_viterbi_finds_the_best_path(seed):
    rng = np.random.default_rng(seed)
    texts = [rng.normal(size=(n, 3)).astype(np.float32) for n in (6, 1, 0, 4, 6, 2)]
    for own, labels in zip(texts, langid.viterbi(texts, 0.7), strict=True):
        assert len(labels) == len(own)
        if len(own):
            value = sum(own[i, k] for i, k in enumerate(labels)) - 0.7 * (labels[1:] != labels[:-1]).sum()
            assert value == pytest.approx(brute_viterbi(own, 0.7)[0], abs=1e-4)


def test_held_out_accuracy(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "lang")
    rows = op3_language(spark, data).join(docs, "doc_id").where("held_out").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in rows) >= 0.97 * len(rows)
    assert all(0 <= r["score"] <= 1 for r in rows)


@pytest.fixture(scope="module")
def model(make):
    english, russian = "the quick brown fox jumps over the lazy dog and runs away with the cat", "съешь ещё этих мягких французских булок да выпей же чаю с другом"
    french = "le renard brun saute par dessus le chien paresseux et il court avec le chat"
    return langid.train(make([(i, t, c) for i in range(9) for t, c in ((english, "en"), (russian, "ru"), (french, "fr"))]), F.lit(True))


def test_spans_of_mixed_text(make, model):
    text = "the quick fox runs over the lazy dog, съешь этих мягких булок, le chien paresseux court avec le chat"
    row = langid.predict(make([(1, text)]), model).first()
    labels = [s.split(":") for s in row["spans"].split(",")]
    assert [x[0] for x in labels] == ["en", "ru", "fr"]
    assert text[int(labels[1][1]) : int(labels[1][2])].strip(" ,") .startswith("съешь")
    assert row["score"] < 0.6


def test_scripts_narrow_candidates(make, model):
    found = langid.words(langid.lowered("чай dog"))
    scores = model.scores(found)
    ru = model.languages.index("ru")
    assert scores[0].argmax() == ru and scores[0, ru] == 0 and scores[1, ru] == langid.FLOOR


def test_und_nasty_and_empty(make, nasty, empty, model):
    rows = langid.predict(nasty, model).collect()
    assert len(rows) == nasty.count()
    assert {r["lang_pred"] for r in rows if r["doc_id"] in (2, 3, 6, 7)} == {"und"}
    assert langid.predict(empty, model).count() == 0
    nothing = langid.train(empty, F.lit(True))
    assert [r["lang_pred"] for r in langid.predict(make([(1, "words here")]), nothing).collect()] == ["und"]


def test_keep_drops_texts_without_language(nasty, model):
    kept = langid.keep(nasty, model)
    assert kept.schema == nasty.schema
    ids = [r["doc_id"] for r in kept.collect()]
    assert not set(ids) & {2, 3, 6, 7}
    assert ids.count(1) == 3 and 4 in ids
    assert all(r["lang"] for r in kept.collect())


def test_scripts_of_no_language_belong_to_none(make, model):
    """Letters that no learned language uses add to none: und alone, and less score among others."""
    thai, english = "ภาษาไทยเป็นภาษาที่มีระดับเสียง", "the quick brown fox"
    half = english + " 語言語言語言語言語言語言語言語言"
    docs = make([(1, thai, None), (2, "中文文本没有空格", None), (3, half, None), (4, english, None)])
    rows = {r["doc_id"]: r for r in langid.predict(docs, model).collect()}
    assert [(rows[i]["lang_pred"], rows[i]["score"]) for i in (1, 2)] == [("und", 0.0)] * 2
    assert rows[1]["spans"].startswith("und:0:")
    assert (rows[3]["lang_pred"], rows[3]["score"]) == ("en", 0.5)
    assert [x.split(":")[0] for x in rows[3]["spans"].split(",")] == ["en", "und"]
    assert (rows[4]["lang_pred"], rows[4]["score"]) == ("en", 1.0)
    assert [(r["doc_id"], r["lang"]) for r in langid.keep(docs, model, 0.34).orderBy("doc_id").collect()] == [(3, "en"), (4, "en")]
    assert [r["doc_id"] for r in langid.keep(docs, model, 0.6).collect()] == [4]


def test_letters_of_the_third_plane_are_letters(make, model):
    """CJK extensions G and H are letters of a script that this model has no language for; selectors part no word."""
    rows = {r["doc_id"]: r for r in langid.predict(make([(1, "\U00030001\U00031350", None), (2, "dog\U00030001 the quick brown", None), (3, "the qu\U000e0101ick brown fox", None)]), model).collect()}
    assert rows[1]["lang_pred"] == "und" and rows[1]["spans"] == "und:0:2"
    assert rows[2]["lang_pred"] == "en"
    assert (rows[3]["lang_pred"], rows[3]["score"]) == ("en", 1.0)
    han = langid.train(make([(i, "\U00030001\U00031350 中文", "zh") for i in range(5)]), F.lit(True))
    assert [(r["lang_pred"], r["score"]) for r in langid.predict(make([(1, "\U00030007")]), han).collect()] == [("zh", 1.0)]


def test_more_languages_than_a_byte_counts():
    scores = np.full((40, 300), -1.0, dtype=np.float32)
    scores[:20, 270] = scores[20:, 3] = 0
    assert [x.tolist() for x in langid.viterbi([scores], 2.0)] == [[270] * 20 + [3] * 20]


def slow_prediction(text, model, penalty=12.0):
    """Words, scripts, trigrams and the best path by plain loops over characters and languages."""
    import unicodedata

    mask = (1 << 32) - 1
    low = langid.lowered(text)
    inside = [c.isalpha() or unicodedata.category(c)[0] == "M" for c in low]
    if not any(c.isalpha() for c in low):
        return "und", 0.0
    value, back, lengths, allowed_any = None, [], [], []
    at, n = 0, len(model.languages)
    while at < len(low):
        if not inside[at]:
            at += 1
            continue
        end = at
        while end < len(low) and inside[end]:
            end += 1
        script = next((i for i, ranges in enumerate(langid.SCRIPTS.values()) if any(a <= ord(low[at]) <= b for a, b in ranges)), langid.OTHER_SCRIPT)
        allowed = [bool(model.scripts[script, k]) for k in range(n)]
        total = [0.0] * n
        for i in range(at, end):
            three = [ord(low[j]) if 0 <= j < len(low) and inside[j] else 32 for j in (i - 1, i, i + 1)]
            h = (three[0] * 0x9E3779B1 & mask) ^ (three[1] * 0x85EBCA6B & mask) ^ (three[2] * 0xC2B2AE35 & mask)
            h = (((h ^ h >> 15) * 0x2C1B3C6D & mask) >> 16) & langid._BUCKETS - 1
            for k in range(n):
                total[k] += float(model.grams[h, k])
        best = max((t for t, a in zip(total, allowed, strict=True) if a), default=None)
        own = [0.0 if best is None else max(t - best, float(langid.FLOOR)) if a else float(langid.FLOOR) for t, a in zip(total, allowed, strict=True)]
        if value is None:
            value = own
        else:
            top = max(range(n), key=lambda k: value[k])
            back.append([k if value[k] >= value[top] - penalty else top for k in range(n)])
            value = [max(value[k], value[top] - penalty) + own[k] for k in range(n)]
        lengths.append(end - at)
        allowed_any.append(any(allowed))
        at = end
    state = max(range(n), key=lambda k: value[k])
    labels = [state]
    for step in reversed(back):
        labels.append(step[labels[-1]])
    share = [0.0] * n
    for label, length, known in zip(reversed(labels), lengths, allowed_any, strict=True):
        share[label] += length * known
    best = max(range(n), key=lambda k: share[k])
    return (model.languages[best], share[best] / sum(lengths)) if share[best] else ("und", 0.0)


def test_whole_table_against_brute_force(spark, data):
    """The query's labels and scores are those of plain loops, text by text."""
    from lectern.llm.queries import _fold
    from lectern.llm.storage import documents

    docs = documents(spark, data)
    trained = langid.train(docs, ~_fold(4, 2))
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    rows = op3_language(spark, data).collect()
    assert len(rows) == len(texts)
    other = 0
    for r in rows:
        label, score = slow_prediction(texts[r["doc_id"]], trained)
        assert r["lang_pred"] == label
        other += abs(r["score"] - score) > 1e-9  # sums in single precision may part ways at a tie
    assert other <= 0.01 * len(rows)
