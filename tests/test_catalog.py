"""Every registered query of the catalogue, against DuckDB where SQL can express it."""

from __future__ import annotations

import pytest

from storyloom.catalog import ORACLE_SQL, QUERIES
from tests.compare import connect, differences

#: Queries whose result may be empty at the smallest size.
SPARSE = {"heading_fast_path", "roster_names", "inline_tokens", "descriptors", "insert_new", "page_links", "anti_aliases", "roster_merge", "thought_cues"}


@pytest.fixture(scope="module")
def db(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_against_sql(spark, sf_dir, db, name):
    found = differences(QUERIES[name](spark, sf_dir), db, ORACLE_SQL[name])
    assert found == "" or found == "both are empty" and name in SPARSE


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_has_rows(spark, sf_dir, name):
    rows = QUERIES[name](spark, sf_dir).collect()
    assert rows or name in SPARSE


def test_entry(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0


def test_same_rows_under_other_partitions(spark, sf_dir):
    names = ["script_spans", "padded_pauses", "attribution_cascade", "chapter_ranges"]
    first = [sorted(map(str, QUERIES[n](spark, sf_dir).collect())) for n in names]
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        assert [sorted(map(str, QUERIES[n](spark, sf_dir).collect())) for n in names] == first
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
