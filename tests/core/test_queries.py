"""Every core query against its SQL on the smallest tables."""

import duckdb
import numpy as np
import pytest
from test_codecs import sizes_of

from colstride import queries as Q

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_query(spark, duck, name):
    found = Q.QUERIES[name](spark, SF)
    if name not in Q.ORACLE_SQL:
        pytest.skip("no SQL: held against brute force elsewhere")
    cursor = duck.execute(Q.ORACLE_SQL[name])
    columns = [d[0] for d in cursor.description]
    order = sorted(columns)
    assert sorted(found.columns) == order
    expected = sorted(tuple(r[columns.index(c)] for c in order) for r in cursor.fetchall())
    assert sorted(tuple(r) for r in found.select(*order).collect()) == expected


def test_format_choice_against_brute_force(spark):
    """Pages of the query's column, each encoded in every format."""
    column = {r.pos: r.v for r in Q.orders(spark, SF, "o_custkey").collect()}
    for r in Q.QUERIES["format_choice"](spark, SF).collect():
        values = np.array([column[p] for p in range(r.page * 2048, r.page * 2048 + r.n)], dtype=np.uint64)
        sizes = sizes_of(values)
        assert sizes[r.code] == min(sizes.values())


def test_unsigned_bounds_push_down(spark):
    plan = Q.QUERIES["select_lt"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "LessThan(o_custkey,500)" in plan and "GreaterThanOrEqual(o_custkey,0)" in plan


def test_plans_push_down(spark):
    plan = Q.QUERIES["select_sum"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(l_linenumber,3)" in plan and "l_extendedprice" not in plan


def test_variant_on_compressed_takes_one_worker(spark, monkeypatch):
    """The frames that the harness compares: encoding and decoding are one Python step."""
    from colstride.plans import harness

    seen = []
    plain = harness.fingerprint
    monkeypatch.setattr(harness, "fingerprint", lambda df: (seen.append(df._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow")), plain(df))[1])
    assert {r.name: r.status for r in Q.QUERIES["variants_agree"](spark, SF).collect()} == {"fused": 1, "positional": 1, "on_compressed": 1}
    assert seen == [0, 0, 1]
