"""Registered queries against their SQL on the smallest tables, and the driver contract."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from lexigrid.plans import registry

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="test tables are not here")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for name in os.listdir(DATA):
        c.sql(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{DATA}/{name}'")
    return c


def rows(cells, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(repr(tuple(r[i] for i in order)) for r in cells)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, DATA)
    want = duck.sql(registry.ORACLE_SQL[name])
    assert rows(df.collect(), df.columns) == rows(want.fetchall(), want.columns)


def test_contract(spark):
    assert entry.entry(spark).count() == 10
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert registry.QUERIES["random_queries"](spark, DATA).collect()[1].query.islower()
    assert registry.QUERIES["search_counts"](spark, DATA).where("visited_nodes + skipped_nodes = num_nodes and skipped_nodes > 0").count() == 4


def test_no_product_over_rows(spark):
    plan = registry.QUERIES["fuzzy_topk"](spark, DATA)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "ReadSchema: struct<word:string>" in plan
    plan = registry.QUERIES["dictionary_distinct"](spark, DATA)._jdf.queryExecution().toString()
    assert "ReadSchema: struct<text:string>" in plan


def test_index_is_kept_between_queries(spark):
    assert registry.index(spark, DATA) is registry.index(spark, DATA)


def test_reports_go_on_after_a_failure(spark, tmp_path, monkeypatch):
    from lexigrid.plans import runs

    monkeypatch.setitem(runs.REPORTS, "broken", "SELECT nothing FROM m")
    path, failed = runs.write_reports(spark, DATA, str(tmp_path), ["broken", "bench_counts"])
    assert len(failed) == 1 and failed[0].startswith("broken") and spark.read.parquet(f"{path}/bench_counts").count() == 1
    assert "broken" in spark.read.text(f"{path}/sql").first().value


def test_command_line(spark, tmp_path, capsys):
    from lexigrid import __main__ as command

    (tmp_path / "w.txt").write_text("house mouse\nmoose\n")
    assert command.arguments([str(tmp_path), "q"]).n == 10
    for wrong in ([str(tmp_path)], [str(tmp_path), "q", "--lang", "fr"]):
        with pytest.raises(SystemExit):
            command.arguments(wrong)
    assert command.main([str(tmp_path / "w.txt"), "hause", "-n", "1", "--lang", "en", "--repeat", "2"]) == 0
    said = capsys.readouterr().out
    assert "house" in said and "query:" in said and "build/sort:" in said
