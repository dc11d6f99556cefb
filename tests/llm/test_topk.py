import math
import random
from fractions import Fraction

import numpy as np
import pytest

from planweave.llm.topk import Best, Block, Space, lifted, sort_key, top_k_inner


def brute(rows, k=5, every=50):
    ok = [(i, [math.floor(256 * Fraction(x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for at, (q, query) in enumerate(ok):
        if q % every == 0:
            best = sorted((-sum(a * b for a, b in zip(query, v)), i) for j, (i, v) in enumerate(ok) if j != at)[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return sorted(out)


def run(spark, rows, **options):
    return sorted(map(tuple, top_k_inner(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), **options).collect()))


@pytest.mark.parametrize("candidates", [16, 4096])
def test_matches_brute_force(spark, candidates):
    rng = random.Random(4)
    rows = [(i, [rng.gauss(0, 0.3) for _ in range(8)]) for i in range(300)]
    rows += [(1000 + i, rows[50][1]) for i in range(12)]  # ties
    assert run(spark, rows, candidates=candidates, queries=3) == brute(rows)


def test_nulls_empty_and_odd_vectors(spark):
    rows = [(0, [1.0, 2.0]), (1, None), (2, [None, 1.0]), (3, [float("nan"), 1.0]), (4, [float("inf"), 1.0]), (5, []), (6, [1.0]), (-50, [0.5, -0.5]), (None, [1.0, 1.0]), (7, [0.0, 0.0]), (0, [1.0, 2.0])]
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == []
    assert run(spark, [(50, [1.0])]) == []


def test_clashing_columns(spark):
    df = spark.createDataFrame([(0, [1.0], 1, 2), (1, [1.0], 3, 4)], "vec_id long, embedding array<float>, block int, id int")
    assert [tuple(r) for r in top_k_inner(df).collect()] == [(0, 1, 1, 65536)]


def test_large_components_and_many(spark):
    rng = random.Random(6)
    rows = [(i, [rng.choice((-1, 1)) * rng.choice((1e6, 4e6 + i, 3.25, 0.0)) for _ in range(6)]) for i in range(120)]
    assert run(spark, rows) == brute(rows)
    wide = [(i, [rng.gauss(0, 90.0) for _ in range(9000)]) for i in range(12)]
    assert run(spark, wide, candidates=4) == brute(wide)
    # doubles can't tell these sums apart, and none of these
    rows = [(0, [2.0**22, 1.0, 1 / 256]), (1, [2.0**22, 1.0, 0.0]), (2, [2.0**22, 1.0, 1 / 256]), (3, [2.0**22, 1.0, 2 / 256])]
    assert run(spark, rows, k=3) == brute(rows, k=3) and [r[2] for r in run(spark, rows, k=3)] == [3, 2, 1]
    huge = [(0, [1e300, 1.0]), (1, [1e300, 5.0]), (2, [3.0, 2.0]), (3, [-1e300, 0.0])]
    assert [(r[2], r[3]) for r in run(spark, huge)] == [(1, 2**63 - 1), (2, 2**63 - 1), (3, -(2**63))]


def test_no_component_is_clamped(spark):
    rows = [(0, [2e17, -1e17]), (1, [1 / 256, 2 / 256]), (2, [1e-9, -1.0]), (3, [-1.5, -3.0])]
    held = lambda found: [(q, r, v, max(-(2**63), min(2**63 - 1, s))) for q, r, v, s in found]
    assert run(spark, rows) == held(brute(rows)) and (0, 2, 1, 0) in run(spark, rows)
    top = 1.7e308
    rows = [(0, [top, 1.0]), (1, [top, 5.0]), (2, [top, 4.0]), (3, [-top, 0.0]), (4, [1e-300, -1e-300]), (50, [-1.0, 0.5])]
    for candidates in (2, 4096):
        got = run(spark, rows, candidates=candidates)
        assert held(brute(rows)) == got and [r[2] for r in got if r[0] == 0] == [1, 2, 4, 50, 3]


def test_sort_keys():
    numbers = [0, 1, -1, 255, 256, -255, -256, 10**30, -(10**30), 2**63, -(2**63)]
    assert sorted(numbers) == sorted(numbers, key=sort_key)


def test_bounds_stop_the_search():
    values = np.arange(5000.0)[:, None]
    space = Space(1, 8192.0, float((4999 / 8192) ** 2), lifted(values[[4999, 0]] / 8192, float((4999 / 8192) ** 2)))
    block = Block(np.arange(5000), np.arange(5000), values, space.table(values, False))
    best = Best(3, [], -np.inf)
    best.search(np.array([4000.0]), -1, block, space.table(np.array([[4000.0]]), True)[:, 0], space)
    assert [v for _, v, _ in sorted(best.found)] == [4999, 4998, 4997]
    assert best.scored <= 1024
    before = best.scored
    best.search(np.array([4000.0]), -1, Block(np.arange(9), np.arange(9), values[:9], space.table(values[:9], False)), space.table(np.array([[4000.0]]), True)[:, 0], space)
    assert best.scored == before


def test_sql(against_duckdb):
    against_duckdb("op5_topk")
