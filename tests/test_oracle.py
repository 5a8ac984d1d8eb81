"""Every query that has SQL gives what DuckDB gives, over the smallest data; the others run."""

import pytest
from oracle_check import compare

from millrace.catalog import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", [*QUERIES])
def test_query(spark, name):
    said = compare(spark, name, SF, QUERIES, ORACLE)
    assert said.startswith("ok" if name in ORACLE else "rows-only"), said


def test_every_sql_has_its_query():
    assert not set(ORACLE) - set(QUERIES)
