"""Folds of plans that are taken whole, listed or cut into islands."""

import random

import pytest

from planweave.operators import intervals


@pytest.mark.parametrize("name", ["pairs", "extents", "walls"])
def test_plans_of_every_size_fold_alike(spark, monkeypatch, name):
    rng = random.Random(11)
    rows = [(p, bool((p or 0) % 2), i, rng.randrange(40 * (p or 1)), s, s + rng.randrange(30), rng.randrange(9)) for p in (0, 1, 2, None) for i in range(9 * (p or 1)) for s in [rng.randrange(60)]]
    lines = spark.createDataFrame(rows, "plan int, flat boolean, id long, pos int, s int, e int, thick int")
    keys = ["plan", "flat"]
    fold = {
        "pairs": lambda: intervals.greedy_pairs(lines, keys, 3, 20, 0.3),
        "extents": lambda: intervals.merged_extents(lines, keys, 2, 10),
        "walls": lambda: intervals.dedupe_walls(lines, keys, 10, 0.4),
    }[name]
    found = []
    for whole, few in ((4096, 64), (4096, 2), (10, 9), (0, 0)):
        monkeypatch.setattr(intervals, "WHOLE_LINES", whole)
        monkeypatch.setattr(intervals, "FEW_LINES", few)
        found.append(sorted(map(repr, fold().collect())))
    assert found[0] and found.count(found[0]) == 4


def test_small_plans_move_once(spark, tmp_path):
    """Lines that are together already are folded where they are."""
    spark.range(1000).selectExpr("id % 50 AS plan", "id", "int(id % 7) AS pos", "0 AS s", "9 AS e", "1 AS thick").write.parquet(str(tmp_path / "lines"))
    lines = spark.read.parquet(str(tmp_path / "lines")).repartition(4, "plan")
    small = intervals.dedupe_walls(lines, ["plan"], 10, 0.4)._jdf.queryExecution().executedPlan().toString().split("MapInArrow")[1]
    assert small.count("Exchange") == 1
