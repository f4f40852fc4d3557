"""Every registered query against its SQL, at the smallest scale."""

import os

import pytest

import __spark_entry__ as entry
import check_queries

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    return check_queries.connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, duck, name):
    result = check_queries.compare(spark, duck, SF_DIR, name)
    assert "FAIL" not in result, result


def test_entry(spark):
    frame = entry.entry(spark)
    assert frame.columns == ["split", "shard_index", "batch_in_shard", "row", "inputs", "targets"]
    assert frame.count() > 0


def test_every_check_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
