"""Queries against their SQL on DuckDB."""

import pytest

from srcweave.llm.oracles import ORACLES
from srcweave.llm.registry import QUERIES
from tests.oracle import duck_rows, spark_rows


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, sf_dir, name):
    names, _, rows = spark_rows(QUERIES[name](spark, sf_dir))
    want_names, _, want = duck_rows(sf_dir, ORACLES[name])
    assert names == want_names and rows == want and rows
