"""Every query of the roster, and every example on typed rows, against its SQL on DuckDB."""

import pytest

from srcweave.plans import roster
from tests.oracle import duck_rows, spark_rows

QUERIES, ORACLES = roster.load()
QUERIES |= {name: run for name, (run, _) in roster.EXAMPLES.items()}
ORACLES |= {name: sql for name, (_, sql) in roster.EXAMPLES.items()}
SAME = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "boolean": "BOOLEAN", "double": "DOUBLE"}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, name):
    names, kinds, rows = spark_rows(QUERIES[name](spark, sf_dir))
    if name not in ORACLES:
        return
    want_names, want_kinds, want = duck_rows(sf_dir, ORACLES[name])
    assert names == want_names
    assert rows == want, (rows[:3], want[:3], len(rows), len(want))
    assert [SAME.get(k, k) for k in kinds] == want_kinds
    assert rows or name in MAY_BE_EMPTY, "no rows"


MAY_BE_EMPTY = {"secret_scan"}
