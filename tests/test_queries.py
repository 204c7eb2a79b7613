"""Every registered query against its SQL, all values."""

import pytest

import compare
from bitexture.plans.catalog import QUERIES
from bitexture.plans.stream_queries import _table_stream
from bitexture.streaming.jobs import write_available


@pytest.fixture(scope="module")
def con(sf):
    return compare.duck(sf)


@pytest.mark.parametrize("name", [n for n, q in QUERIES.items() if q.sql])
def test_same_as_sql(spark, con, sf, name):
    # the smallest input has no run as long as one logging step
    allowed = ("ok", "no rows") if name == "running_loss" else ("ok",)
    assert compare.compare(spark, con, sf, name, QUERIES[name]) in allowed


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["conversations", "events"])
def test_streams_read_tables_of_many_files(spark, sf, tmp_path, name):
    """A table may be one file or a folder of part files."""
    rows = spark.read.parquet(f"{sf}/{name}.parquet")
    rows.repartition(3).write.parquet(f"{tmp_path}/in/{name}.parquet")
    rows.limit(1).write.parquet(f"{tmp_path}/in/other.parquet")
    for i, base in enumerate((sf, f"{tmp_path}/in")):
        write_available(_table_stream(spark, base, name), f"{tmp_path}/out{i}", f"{tmp_path}/state{i}").awaitTermination()
        got = spark.read.schema(rows.schema).parquet(f"{tmp_path}/out{i}")
        assert got.count() == rows.count() and got.exceptAll(rows).isEmpty()
