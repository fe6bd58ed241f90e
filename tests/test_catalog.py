"""Every query of the shade analytics against the oracle, and queries without one against their rules."""

import math

import duckdb
import pytest

from parasol.plans import catalog
from parasol.plans.dialect import TABLES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5) + 0.0
    return v


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_equals_the_oracle(spark, oracle, name):
    frame = catalog.QUERIES[name](spark, SF)
    columns = sorted(frame.columns)
    got = sorted((repr([plain(r[c]) for c in columns]) for r in frame.collect()))
    answer = oracle.execute(catalog.ORACLE_SQL[name])
    names = [d[0] for d in answer.description]
    assert sorted(names) == columns
    want = sorted((repr([plain(r[names.index(c)]) for c in columns]) for r in answer.fetchall()))
    assert got == want


def test_routes_keep_the_promise(spark):
    routes = catalog.QUERIES["route_batch"](spark, SF).collect()
    by = {}
    for r in routes:
        by.setdefault(r.request, []).append(r)
    for rows in by.values():
        rows.sort(key=lambda r: r.weight)
        if rows[0].length_m is None:
            assert all(r.length_m is None for r in rows)
            continue
        shade = [r.shade_fraction for r in rows]
        assert all(b >= a - 1e-9 for a, b in zip(shade, shade[1:], strict=False))  # more weight never means less shade, but for the clamp's slack
        assert rows[0].length_m == min(r.length_m for r in rows)
        assert all(abs(r.minutes - r.length_m / 1.4 / 60) < 1e-9 for r in rows)


def test_every_operator_is_registered(spark):
    import __spark_entry__

    queries, oracle_sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(catalog.QUERIES) <= set(queries) and set(oracle_sql) <= set(queries)
    assert __spark_entry__.entry(spark).count() > 0
