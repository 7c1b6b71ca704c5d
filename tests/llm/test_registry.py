"""Queries with SQL against DuckDB on the smallest tables."""

import glob
import os

import duckdb
import pytest

from codelattice.llm import registry
from tests.llm.helpers import SF


def test_each_operator_has_one_query():
    assert sorted(int(name[2:].split("_")[0]) for name in registry.QUERIES) == list(range(1, 14))
    assert all(isinstance(sql, str) for sql in registry.ORACLES.values()) and registry.ORACLES.keys() <= registry.QUERIES.keys()


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_against_sql(spark, name):
    connection = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        connection.execute(f"create view {os.path.basename(path)[:-8]} as select * from read_parquet('{path}')")
    frame = registry.QUERIES[name](spark, SF)
    columns = sorted(frame.columns)
    result = connection.execute(registry.ORACLES[name])
    names = [c[0] for c in result.description]
    assert sorted(names) == columns
    expected = sorted(str(tuple(row[names.index(c)] for c in columns)) for row in result.fetchall())
    assert sorted(str(tuple(r)) for r in frame.select(columns).collect()) == expected
