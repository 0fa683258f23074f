"""The operators' SQL in DuckDB against their queries, on sf0.001."""

import duckdb
import pytest

from concord.llm import registry

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_sql(spark, name):
    db = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings", "conversations"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = registry.queries()[name](spark, SF)
    cur = db.execute(registry.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert set(names) <= set(got.columns)
    rows = got.select(*names).collect()
    assert rows and sorted(map(tuple, rows), key=repr) == sorted(cur.fetchall(), key=repr)
