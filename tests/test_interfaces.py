import json
import tracemalloc

import pytest

from lectern import __main__ as command
from lectern.functions import udtfs
from lectern.sources import records


def test_table_functions(spark):
    udtfs.register(spark)
    rows = spark.sql("select * from kwic('aaXaa', 'a', 1)").collect()
    assert [(r[0], r[1], r[3]) for r in rows] == [(0, "", "a"), (1, "a", "X"), (3, "X", "a"), (4, "a", "")]
    assert [tuple(r) for r in spark.sql("select * from shingles('甲\U00105001乙', 2)").collect()] == [(0, "甲\U00105001"), (1, "\U00105001乙")]
    assert spark.sql("select * from kwic(null, 'a', 1)").count() == 0


def test_paged_listing(spark, tmp_path):
    for page in range(3):
        path = tmp_path / "did1" / f"{page}.json"
        path.parent.mkdir(exist_ok=True)
        path.write_text("".join(json.dumps({"uri": f"u{page}{i}", "cid": "c", "value": {"n": i}}) + "\n" for i in range(2)))
    records.register(spark)
    rows = spark.read.format("record_listing").option("path", str(tmp_path)).option("dids", "did1,none").load()
    assert sorted(r["uri"] for r in rows.collect()) == ["u00", "u01", "u10", "u11", "u20", "u21"]


def test_live_events_resume(spark, tmp_path):
    folder = tmp_path / "events"
    folder.mkdir()

    def put(name, *times):
        (folder / name).write_text("".join(json.dumps({"kind": "commit", "did": "d", "time_us": t, "commit": {"rkey": str(t)}}) + "\n" for t in times))

    records.register(spark)
    out = []

    def run():
        stream = spark.readStream.format("record_events").option("path", str(tmp_path)).option("cursor", "1").load()
        query = stream.writeStream.foreachBatch(lambda b, _: out.extend(r["time_us"] for r in b.collect())).option("checkpointLocation", str(tmp_path / "cp")).start()
        query.processAllAvailable()
        query.stop()

    put("a.json", 1, 3, 2)
    run()
    assert out == [2, 3]
    put("b.json", 5)
    run()
    assert out == [2, 3, 5]


def test_live_events_are_never_all_held(tmp_path):
    """The driver reads bursts one event at a time, and each burst is a task's."""
    folder = tmp_path / "events"
    folder.mkdir()
    line = json.dumps({"time_us": 7, "commit": {"record": "x" * 10_000}}) + "\n"
    for name in "ab":
        (folder / name).write_text(line * 2_000)
    reader = records._LiveReader(str(tmp_path), 1)
    tracemalloc.start()
    end = reader.latestOffset()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert end == {"time_us": 7} and peak < 2_000_000
    tasks = reader.partitions({"time_us": 1}, end)
    assert [sum(1 for _ in reader.read(task)) for task in tasks] == [2_000, 2_000]


def test_backoff():
    assert [records.backoff(n) for n in (0, 1, 5, 6, 9)] == [1, 2, 32, 60, 60]


def test_command_line(spark, data, capsys, tmp_path):
    command.main(["list"])
    assert "kwic_literal" in capsys.readouterr().out
    command.main(["search", "the ", "--data", data, "--textid", "src1", "--out", str(tmp_path / "out")])
    assert spark.read.parquet(str(tmp_path / "out")).count() > 0
    with pytest.raises(SystemExit):
        command.main(["run", "nothing", "--data", data])


@pytest.mark.parametrize(
    ("arguments", "columns"),
    [
        (["summary", "the "], {"textid", "n"}),
        (["facets", "tionth"], {"dim", "value", "n"}),
        (["survey", "--textid", "src1"], {"char", "codepoint", "n"}),
        (["clusters", "--textid", "src1", "--uncontained"], {"cluster", "length", "occurrence_count", "first_bucket", "first_start"}),
        (["pairs", "--textid", "src1", "--textid", "src2"], {"bucket_a", "bucket_b", "chars_a", "coverage_a"}),
        (["spans", "--textid", "src1", "--edits", "1", "--least", "40"], {"bucket_a", "start_a", "edits"}),
    ],
)
def test_commands_at_their_defaults(spark, data, tmp_path, arguments, columns):
    command.main([*arguments, "--data", data, "--out", str(tmp_path / "out")])
    rows = spark.read.parquet(str(tmp_path / "out"))
    assert columns <= set(rows.columns) and rows.count() > 0


def test_defaults_of_a_scan():
    given = command.parser().parse_args(["spans", "--data", "x"])
    assert (given.anchor, given.least, given.most, given.edits) == (12, 24, 200, 0)


def test_a_cluster_needs_a_shared_folder(monkeypatch):
    from lectern import storage

    class Session:
        def __init__(self, **conf):
            self.conf = {k.replace("__", "."): v for k, v in conf.items()}

    assert storage.shared_dir(Session(spark__checkpoint__dir="hdfs://x/y/", spark__master="spark://h")) == "hdfs://x/y"
    assert storage.shared_dir(Session(spark__master="local[4]")).endswith("lectern-checkpoints")
    with pytest.raises(RuntimeError, match="checkpoint"):
        storage.shared_dir(Session(spark__master="spark://h"))
