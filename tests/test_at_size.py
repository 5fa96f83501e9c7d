"""Queries whose work is dealt to many tasks, as on larger tables."""

import glob

import pytest

import __spark_entry__ as entry
from tessera import scratch
from tests import oracle


@pytest.fixture
def dealt(spark):
    """No merging of small partitions, so that groups come to many tasks."""
    before = spark.conf.get("spark.sql.adaptive.enabled"), spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "61")
    yield spark
    spark.conf.set("spark.sql.adaptive.enabled", before[0])
    spark.conf.set("spark.sql.shuffle.partitions", before[1])


@pytest.mark.parametrize("name", ["json_arrays", "metric_series"])
def test_every_document_has_its_own_file(dealt, sf_dir, name):
    assert oracle.compare(entry.queries()[name](dealt, sf_dir), oracle.connection(sf_dir), entry.oracle_sql()[name]) is None


def test_sqlite_files_lie_where_executors_see_them(spark, sf_dir, tmp_path, monkeypatch):
    monkeypatch.setattr(scratch, "path", lambda spark, name: f"file://{tmp_path}/{name}")
    got = entry.queries()["sqlite_table"](spark, sf_dir)
    assert oracle.compare(got, oracle.connection(sf_dir), entry.oracle_sql()["sqlite_table"]) is None
    assert glob.glob(f"{tmp_path}/**/*.db", recursive=True)
