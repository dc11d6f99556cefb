"""Queries against their DuckDB twins on keys and plans that the small tables don't hold."""

import duckdb

from planweave.plans import registry


def same_as_sql(spark, folder, name, **tables):
    """The query's rows, equal to those of its SQL, over tables that DuckDB makes."""
    con = duckdb.connect()
    for t, sql in tables.items():
        con.execute(f"COPY ({sql}) TO '{folder}/{t}.parquet' (FORMAT parquet)")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    got = registry.queries()[name](spark, str(folder))
    columns = got.columns
    value = lambda v: round(v, 5) + 0.0 if isinstance(v, float) else v
    rows = sorted((tuple(map(value, r)) for r in got.collect()), key=repr)
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({registry.oracle_sql()[name]})").fetchall()
    assert rows == sorted((tuple(map(value, r)) for r in want), key=repr)
    return rows


def test_colours_of_keys_beyond_six_digits(spark, tmp_path):
    rows = same_as_sql(spark, tmp_path, "hex_rgba", part="SELECT unnest([1, 4092, 4094, 19999, 1200000])::BIGINT AS p_partkey")
    assert (4094, 0x00, 0x0F, 0xFA, 255) in rows


def test_orders_that_repeat_a_key_or_turn_its_sign_are_all_written_back(spark, tmp_path):
    keys = "[0, 97, -97, 679, 679, 679, 7, 7, 5, 5, NULL, NULL]"
    orders = f"SELECT unnest({keys})::BIGINT AS o_orderkey, unnest(['1-URGENT', '1-URGENT', '1-URGENT', '1-URGENT', '1-URGENT', '2-HIGH', '2-HIGH', '2-HIGH', '5-LOW', '5-LOW', '5-LOW', '5-LOW']) AS o_orderpriority, 'O' AS o_orderstatus, unnest([1.5, 1.5, 3, 1.5, 3, 3, 1.5, 1.5, 2, 2.5, 2, 2])::DOUBLE AS o_totalprice"
    assert len(same_as_sql(spark, tmp_path, "write_back", orders=orders)) == 12 + 5


LINES = "{plan}::BIGINT AS l_orderkey, {part}::BIGINT AS l_partkey, 1::BIGINT AS l_suppkey, n::INT AS l_linenumber, {pos}::DOUBLE AS l_quantity, 1.0::DOUBLE AS l_extendedprice, 0.0::DOUBLE AS l_discount, 0.0::DOUBLE AS l_tax, TIMESTAMP '1995-01-01' AS l_shipdate"


def lines(plan="p", part="n * 7 + p", pos="(n * 5 + p * 3) % 50 + 1", plans=6, n=9):
    """SQL of a table of lines: ``n`` a plan."""
    return f"SELECT {LINES.format(plan=plan, part=part, pos=pos)} FROM range(1, {n + 1}) a(n), range({plans}) b(p)"


def test_plans_with_a_single_room_keep_it(spark, tmp_path):
    # of four cells one is large enough, and not too large
    rows = same_as_sql(spark, tmp_path, "ladder_rooms", lineitem=lines(pos="CASE WHEN n = 1 THEN 1 ELSE 6 END", plans=3, n=4))
    assert len(rows) == 3 and {r[3] for r in rows} == {1}
