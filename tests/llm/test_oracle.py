"""Queries against the SQL that the driver also runs."""

import duckdb
import pytest

from colstride.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query(spark, name):
    duck = duckdb.connect()
    for table in ("documents", "embeddings", "labels"):
        duck.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    cursor = duck.execute(queries.ORACLE_SQL[name])
    columns = [d[0] for d in cursor.description]
    order = sorted(columns)
    found = queries.QUERIES[name](spark, SF)
    assert sorted(found.columns) == order
    expected = sorted(tuple(r[columns.index(c)] for c in order) for r in cursor.fetchall())
    assert sorted(tuple(r) for r in found.select(*order).collect()) == expected


def test_every_operator_has_one_query():
    numbers = sorted(int(name[2:].split("_")[0]) for name in queries.QUERIES)
    assert numbers == [1, 2, 3, 4, 5, 6, 7, 8, 9, 10]
