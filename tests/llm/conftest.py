"""Small tables and the comparison with DuckDB that the operators' tests share."""

import duckdb
import pytest

SMALL = "/root/testdata/sf0.001"


def values(rows, columns):
    return sorted((tuple(round(r[c], 9) if isinstance(r[c], float) else r[c] for c in columns) for r in rows), key=repr)


@pytest.fixture
def against_duckdb(spark):
    from planweave.llm import queries

    def compare(name, folder=SMALL):
        con = duckdb.connect()
        for t in ("documents", "pages", "embeddings", "labels", "benchmark", "conversations"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
        want = con.execute(queries.ORACLE_SQL[name])
        columns = [d[0] for d in want.description]
        want = [dict(zip(columns, r, strict=True)) for r in want.fetchall()]
        got = queries.QUERIES[name](spark, folder)
        assert sorted(got.columns) == sorted(columns)
        assert values(got.collect(), sorted(columns)) == values(want, sorted(columns))

    return compare


@pytest.fixture
def docs(spark):
    def make(rows, schema="doc_id long, text string, lang string, source string, n_chars long"):
        rows = [tuple(r) + (None,) * (5 - len(r)) if schema.startswith("doc_id long, text string, lang") else tuple(r) for r in rows]
        return spark.createDataFrame(rows, schema)

    return make
