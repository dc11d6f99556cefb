import hashlib

from planweave.llm.exact_dedup import ContentTable, exact_dedup, parted

ROWS = [(1, "Abc"), (2, "aBC"), (3, None), (4, ""), (5, "É"), (6, "é"), (7, "x" * 300_000), (8, "X" * 300_000), (None, "abc"), (None, "alone"), (9, "k"), (10, "K")]


def expected(rows):
    key = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    groups = {}
    for i, t in rows:
        groups.setdefault(key(t), []).append(i)
    out = []
    for k, ids in groups.items():
        best = max((i for i in ids if i is not None), default=None)
        out += [(i, best, len(ids), i == best, hashlib.sha256(k.encode()).hexdigest()) for i in ids]
    return sorted(out, key=repr)


def test_matches_brute_force(docs):
    for size, bits in ((1, 8), (1 << 20, 8), (40, 1)):
        assert sorted(map(tuple, exact_dedup(docs(ROWS), bucket_bytes=size, step_bits=bits).collect()), key=repr) == expected(ROWS)


def test_only_buckets_that_do_not_fit_are_parted_again(spark):
    low = [(i, i, 10, b"x" * 10) for i in range(20)]
    high = [(100 + i, (1 << 62) + (i << 30), 10, b"y" * 10) for i in range(3)]
    df = spark.createDataFrame(low + high, "entry long, hash long, size long, content binary")
    tables = [sorted(r.entry for r in t.collect()) for t in parted(df, 64, 16)]
    assert tables[0] == [100, 101, 102] and sorted(sum(tables, [])) == sorted(r[0] for r in low + high)
    sizes = [t.groupBy("bucket").agg({"size": "sum"}).collect() for t in parted(df, 64, 16)]
    assert all(r["sum(size)"] <= 64 for rows in sizes for r in rows)


def test_hot_text_without_ids(docs):
    rows = [(None, "same")] * 40 + [(i, "same") for i in range(3)] + [(None, "other")] * 5
    got = exact_dedup(docs(rows).repartition(3)).collect()
    assert sorted((r.doc_id, r.keep_id, r.group_size) for r in got if r.kept and r.keep_id is not None) == [(2, 2, 43)]
    assert sum(r.kept for r in got) == 2 and {r.keep_id for r in got} == {2, None}


def test_repeated_rows_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, "a", 7, "z"), (1, "a", 7, "z")], "doc_id long, text string, hash long, content string")
    assert sorted(r.kept for r in exact_dedup(df).collect()) == [False, True]


def test_empty(docs):
    assert exact_dedup(docs([])).count() == 0


def test_table_compares_contents_when_hashes_collide():
    table = ContentTable()
    numbers = [table.add(b"%d" % (i % 50), 3) for i in range(200)]
    assert numbers == [i % 50 for i in range(200)]


def test_sql(against_duckdb):
    against_duckdb("op10_exact_dedup")
