from lectern.llm.storage import hash_sample, shared_dir, stored


def test_a_group_of_copies_does_not_break_the_bound(make):
    docs = make([(i, "the same text" if i % 3 else f"text {i}") for i in range(6000)])
    n = hash_sample(docs, 300, "doc_id", "text").count()
    assert 200 < n < 400
    assert hash_sample(docs, 6000, "doc_id").count() == 6000


def test_stored_tables_keep_their_columns_when_empty(spark, empty):
    back = stored(empty, "none")
    assert back.schema == empty.schema and back.count() == 0
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")
