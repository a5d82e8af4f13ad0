"""Every query with reference SQL gives the same rows on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry_points
import verify_sql

ROOT = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def db():
    return verify_sql.connect(ROOT)


@pytest.mark.parametrize("name", sorted(entry_points.oracle_sql()))
def test_same_rows(spark, db, name):
    line = verify_sql.compare(spark, db, ROOT, name)
    assert line.startswith("ok"), line


def test_entry_has_rows(spark):
    assert entry_points.entry(spark).limit(1).count() == 1


def test_every_sql_has_a_query():
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())
