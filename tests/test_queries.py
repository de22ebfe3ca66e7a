"""Every query of the scene engine against its SQL."""

from __future__ import annotations

import pytest

from meshlake.plans import catalogue

from .compare import connection, rows_of_spark, rows_of_sql

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connection(SF)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_same_rows_as_sql(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    got = rows_of_spark(df)
    if name not in catalogue.ORACLE_SQL:
        return
    columns, want = rows_of_sql(duck, catalogue.ORACLE_SQL[name])
    assert sorted(df.columns) == columns
    assert got == want


def test_json_escape_takes_whole_pages(spark):
    import json

    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = {r.page_id: r.escaped for r in catalogue.QUERIES["json_escape_whole"](spark, SF).collect()}
    assert {k: json.loads(f'"{v}"', strict=False) for k, v in got.items()} == pages


def test_path_crc(spark):
    import zlib

    urls = {r.page_id: r.url for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = {r.page_id: r.crc for r in catalogue.QUERIES["path_crc"](spark, SF).collect()}
    assert got == {k: zlib.crc32(v.encode()) for k, v in urls.items()}


def test_every_sql_has_its_query():
    assert set(catalogue.ORACLE_SQL) <= set(catalogue.QUERIES)


def test_entry_imports_without_the_training_data_operators(monkeypatch):
    import importlib
    import sys

    import __spark_entry__ as entry

    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    alone = importlib.reload(entry)
    try:
        assert set(alone.queries()) == set(catalogue.QUERIES)
        assert set(alone.oracle_sql()) == set(catalogue.ORACLE_SQL)
    finally:
        monkeypatch.undo()
        importlib.reload(entry)
