"""Every registered query against its DuckDB twin."""

import duckdb
import pytest

from planweave.plans import registry

FOLDER = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def values(rows, columns):
    return sorted((tuple(round(r[c], 5) + 0.0 if isinstance(r[c], float) else r[c] for c in columns) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query(spark, db, name):
    want = db.execute(registry.oracle_sql()[name])
    columns = sorted(d[0] for d in want.description)
    want = [dict(zip([d[0] for d in want.description], r, strict=True)) for r in want.fetchall()]
    got = registry.queries()[name](spark, FOLDER)
    assert sorted(got.columns) == columns
    assert values(got.collect(), columns) == values(want, columns)
    assert want


def test_every_query_runs(spark):
    for name in set(registry.queries()) - set(registry.oracle_sql()):
        assert registry.queries()[name](spark, FOLDER).count() > 0
