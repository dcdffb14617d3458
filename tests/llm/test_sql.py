"""Queries of the subpackage that have SQL, against DuckDB on whole tables of sf0.001."""

import os

import duckdb
import pytest

from hornlake.llm import registry

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    got = registry.queries()[name](spark, SF)
    found = con.execute(registry.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(got.columns)
    key = lambda rows: sorted(tuple(map(str, r)) for r in rows)
    assert key(tuple(r[c] for c in names) for r in got.collect()) == key(found.fetchall())
