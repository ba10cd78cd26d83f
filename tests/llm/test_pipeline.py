import corpus_pipeline
from lectern.llm import decontaminate, jaccard, langid, packing, pii
from lectern.llm.queries import QUERIES, vocabulary_path
from lectern.llm.storage import stored

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_in_order():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "benchmark_leaks", "personal_data", "sequences"]


def test_every_stage_against_its_operator(spark, data):
    """Each stage's rows are what its operator's own result says, held against its input row by row."""
    docs = spark.read.parquet(f"{data}/documents.parquet")
    stage = dict(corpus_pipeline.STAGES)

    one = stored(stage["language"](spark, docs, data), "t1")
    assert one.columns == COLUMNS
    model = langid.train(docs, docs["doc_id"].isNotNull())
    want = {r["doc_id"] for r in langid.predict(docs, model).where("lang_pred <> 'und' and score >= 0.34").collect()}
    assert {r["doc_id"] for r in one.collect()} == want

    two = stored(stage["near_duplicates"](spark, one, data), "t2")
    assert two.columns == COLUMNS
    assert sorted(r["doc_id"] for r in two.collect()) == sorted({r["class_id"] for r in jaccard.join(one).collect()})

    three = stored(stage["benchmark_leaks"](spark, two, data), "t3")
    assert three.columns == COLUMNS
    bad = {r["doc_id"] for r in decontaminate.leaks(two, spark.read.parquet(f"{data}/benchmark.parquet")).collect()}
    assert bad
    assert {r["doc_id"] for r in three.collect()} == {r["doc_id"] for r in two.collect()} - bad

    four = stored(stage["personal_data"](spark, three, data), "t4")
    assert four.columns == COLUMNS and four.count() == three.count()
    field = pii.train(three)
    before = {r["doc_id"]: r["text"] for r in three.collect()}
    for r in four.collect():
        assert r["text"] == pii.masked(before[r["doc_id"]], field)
        assert r["n_chars"] == len(r["text"])
        assert not pii.base_spans(r["text"])

    five = stage["sequences"](spark, four, data).collect()
    coder = packing.coder(vocabulary_path())
    tokens = {r["doc_id"]: len(coder.ids(r["text"])) + 1 for r in four.collect()}
    assert {r["doc_id"]: r["doc_tokens"] for r in five} == tokens
    assert sum(r["length"] for r in five) == sum(tokens.values())


def test_run_gives_the_last_stage(spark, data):
    rows = corpus_pipeline.run(spark, data).collect()
    assert set(rows[0].asDict()) == {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"}


def test_nasty_and_empty(spark, nasty, empty, data):
    for docs in (nasty, empty):
        kept = docs
        for _, stage in corpus_pipeline.STAGES:
            kept = stored(stage(spark, kept, data), "nasty")
        kept.count()


def test_queries_for_every_operator():
    for n in range(1, 11):
        assert [q for q in QUERIES if q.startswith(f"op{n}_")], n
