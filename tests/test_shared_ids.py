"""Queries whose text ids are cut to four digits give SQL's rows where several conversations or customers share one."""

import duckdb
import pytest

from lectern.plans import registry

NAMES = ("bundle_counts", "bundle_manifests", "bundle_sections", "edition_merge", "juan_scan", "marker_split", "marker_union", "text_id_list", "parallel_assets",)


@pytest.fixture(scope="module")
def shared(tmp_path_factory):
    root = tmp_path_factory.mktemp("shared-ids")
    con = duckdb.connect()
    tables = {
        "conversations": "select c::bigint as conv_id, t::bigint as turn, if(t % 2 = 0, 'user', 'assistant') as role, repeat('text ' || c || ' of ' || t || ' ', (c % 3 + 1)::int) as text from (select unnest([7, 1234, 1235, 12340, 12341, 12350, 99991]) as c), range(8) r(t) where c <> 12341 or t < 4",
        "customer": "select c::bigint as c_custkey, 'n' || c as c_name, 3 as c_nationkey from (select unnest([5, 1234, 12340, 12341, 12345]) as c)",
        "orders": "select o::bigint as o_orderkey, (case when o % 3 = 0 then 1234 when o % 3 = 1 then 12340 else 5 end)::bigint as o_custkey, (o * 50000)::double as o_totalprice from range(12) r(o)",
    }
    for name, sql in tables.items():
        con.sql(f"copy ({sql}) to '{root}/{name}.parquet' (format parquet)")
        con.sql(f"create view {name} as select * from '{root}/{name}.parquet'")
    return con, str(root)


@pytest.mark.parametrize("name", NAMES)
def test_same_rows_as_sql_where_ids_are_shared(spark, shared, name):
    con, root = shared
    ours, theirs = registry.QUERIES[name](spark, root), con.sql(registry.ORACLE[name])
    order = sorted(ours.columns)
    at = [theirs.columns.index(c) for c in order]
    rows = theirs.fetchall()
    assert rows and sorted(repr(tuple(r[c] for c in order)) for r in ours.collect()) == sorted(repr(tuple(r[i] for i in at)) for r in rows)


def test_manifests_below_a_root_with_a_scheme(spark, tmp_path):
    from lectern.sources import readers

    (tmp_path / "T").mkdir()
    (tmp_path / "T" / "T.manifest.yaml").write_text("canonical_identifier: T\n")
    for root in (str(tmp_path), f"file:{tmp_path}", f"file://{tmp_path}"):
        assert [r["textid"] for r in readers.discover(spark, root, max_depth=1).collect()] == ["T"]


def test_each_conversation_has_files_of_its_own(spark, shared, monkeypatch):
    """Files that conversations share would hold whichever comes last, and their hash in the manifest another."""
    from lectern.plans import reader_queries
    from lectern.sources import sinks

    con, root = shared
    written = []
    monkeypatch.setattr(reader_queries.sinks, "write_files", lambda rows, to, put=sinks.write_files: written.append(rows.count()) or put(rows, to))
    reader_queries.bundle_manifests(spark, root)
    assert [(n,) for n in written] == con.sql("select count(distinct (conv_id, turn // 3)) + count(distinct conv_id) from conversations").fetchall()
