"""Every query with SQL against DuckDB on sf0.001."""

import math

import duckdb
import pytest

from concord import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def norm(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    value = lambda v: round(v, 6) if isinstance(v, float) and not math.isnan(v) else int(v) if isinstance(v, int) and not isinstance(v, bool) else v
    return sorted((tuple(value(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, db, name):
    got = registry.queries()[name](spark, SF)
    rows = [tuple(r) for r in got.collect()]
    sql = registry.oracle_sql().get(name)
    if sql is None:
        assert rows
        return
    cur = db.execute(sql)
    names = [d[0] for d in cur.description]
    want = cur.fetchall()
    assert sorted(got.columns) == sorted(names)
    assert norm(rows, got.columns) == norm(want, names)
    if name not in ("reach_depth_2",):
        assert rows, "an empty result tests nothing"
