"""Every query with an oracle equals its DuckDB SQL (row count, columns, values)."""

import pytest

from conftest import SF_ORACLE
from oracle_compare import compare

import __spark_entry__ as E


@pytest.mark.parametrize("name", sorted(E.queries()))
def test_query_matches_oracle(spark, name):
    res = compare(spark, SF_ORACLE, [name], verbose=False)[name]
    assert res[0] in ("OK", "ROWS_ONLY"), res


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns == ["severity", "check", "file", "detail"]
    assert df.count() >= 0
