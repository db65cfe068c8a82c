"""Every registered query against its DuckDB oracle on sf0.001 (the driver checks sf0.01)."""

import pytest

import __spark_entry__ as E
from paths import SF_SMALL
from oracle_check import compare

QUERIES = E.queries()
ORACLES = E.oracle_sql()


def test_every_query_has_an_oracle_or_is_listed():
    rows_only = set(QUERIES) - set(ORACLES)
    assert set(ORACLES) <= set(QUERIES)
    assert len(ORACLES) >= 80, rows_only


@pytest.mark.parametrize("key", sorted(ORACLES))
def test_query_matches_oracle(spark, duck, key):
    status, msg = compare(spark, duck, key, SF_SMALL, QUERIES, ORACLES)
    assert status == "ok", msg


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() >= 0
    assert "stress_index" in df.columns
