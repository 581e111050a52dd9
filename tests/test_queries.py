"""Every registered query with SQL against DuckDB on the same tables."""

import math
import os

import pytest

import __spark_entry__ as entry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.exists(SF), reason="the driver's tables aren't here")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


def norm(rows):
    return sorted((tuple(round(x, 9) if isinstance(x, float) and not math.isnan(x) else x for x in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    got = entry.queries()[name](spark, SF)
    rel = duck.sql(entry.oracle_sql()[name])
    columns = sorted(rel.columns)
    assert sorted(got.columns) == columns
    want = [tuple(r) for r in rel.project(", ".join(f'"{c}"' for c in columns)).fetchall()]
    rows = norm(map(tuple, got.select(*columns).collect()))
    assert rows == norm(want)
    if name != "range_empty":
        assert rows


def test_every_sql_has_a_query():
    assert entry.oracle_sql().keys() <= entry.queries().keys()


def test_entry(spark):
    assert entry.entry(spark).count() == 1


def test_unended_file_is_whole_without_the_drivers_memory(spark, monkeypatch):
    """At 1 GB the driver got no bytes of the file, without an error."""
    from seqloom.plans import fixtures as fx

    monkeypatch.setattr(fx, "_made", {})
    monkeypatch.setattr("seqloom.storage.read_bytes", lambda *a: b"")
    monkeypatch.setattr(fx, "read_bytes", lambda *a: b"", raising=False)
    assert entry.queries()["fastq_without_last_newline"](spark, SF).count() == fx.table(spark, SF, "orders").count()


def test_bam_is_made_by_the_workers(spark, monkeypatch):
    from pyspark.sql.classic.dataframe import DataFrame

    from seqloom.plans import fixtures as fx

    monkeypatch.setattr(fx, "_made", {})
    monkeypatch.setattr(DataFrame, "toLocalIterator", lambda *a, **k: pytest.fail("rows are sent to the driver"))
    assert entry.queries()["bam_to_records"](spark, SF).count() == fx.table(spark, SF, "orders").count()
