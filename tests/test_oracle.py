"""Every query against its SQL on the small tables."""

import math

import duckdb
import pytest

from tessera import registry

NAMES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 5)
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for name in NAMES:
        con.sql(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query(spark, duck, sf_dir, name):
    df = registry.queries()[name](spark, sf_dir)
    want = duck.sql(registry.oracle_sql()[name])
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    place = [want.columns.index(c) for c in columns]
    expected = sorted((tuple(plain(r[i]) for i in place) for r in want.fetchall()), key=repr)
    assert len(got) == len(expected) > 0
    for a, b in zip(got, expected, strict=True):
        assert a == b


def test_queries_without_sql_run(spark, sf_dir):
    for name, run in registry.queries().items():
        if name not in registry.oracle_sql():
            assert run(spark, sf_dir).count() > 0, name
