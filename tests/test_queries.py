import pytest

import __spark_entry__ as entry
from check_queries import compare, connect

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", entry._QUERIES)
def test_query_gives_the_rows_of_its_sql(spark, con, name):
    count, verdict = compare(spark, con, name, SF_DIR)
    assert verdict == "ok" and count > 0


def test_every_query_has_sql():
    assert entry._QUERIES.keys() == entry._SQL.keys()


def test_entry(spark):
    result = entry.entry(spark)
    assert result.columns == ["conv_id", "n_turns", "n_tokens", "digest"]
    assert result.count() > 0
