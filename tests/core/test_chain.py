"""The parse chain of many small plans at once, against its tables and scans."""

import random

import pyarrow as pa
import pytest

from planweave.operators import chain, drawings
from planweave.operators.intervals import dedupe_walls, greedy_pairs, merged_extents
from planweave.plans import drawing

LINE = "struct<id:bigint,horizontal:boolean,pos:int,s:int,e:int>"
CONTOUR = LINE[:-1] + ",thick:int>"
PARTS = f"plan int, lines array<{LINE}>, contours array<{CONTOUR}>, gaps array<struct<gap_id:bigint,cx:bigint,cy:bigint,width_px:int>>, arcs array<struct<cx:bigint,cy:bigint>>, width int, height int, white double, square_meters double"


def parts(rnd, plans):
    """Rooms with doubled walls in pieces, jittered contours and stray lines, in parts of a plan; some plans hold nothing."""
    for plan in range(plans):
        lines, contours, gaps, arcs = [], [], [], []
        put = lambda flat, pos, s, e: lines.append((len(lines), flat, pos, s, e))
        for room in range(rnd.choice([0, 1, 3, 8])):
            x, y, w, h = 200 * room - 300, rnd.choice([-60, 0, 7]), rnd.randint(20, 90), rnd.randint(30, 120)
            for d in (-3, 3):
                cut = rnd.randint(5, w - 5)
                put(True, y + d, x, x + cut)
                put(True, y + d, x + cut + rnd.randint(0, 12), x + w)
                put(True, y + h + d, x, x + w)
                put(False, x + d, y, y + h)
                put(False, x + w + d, y, y + h)
            if rnd.random() < 0.5:
                contours.append((room, rnd.random() < 0.5, y + rnd.randint(-20, 20), x + rnd.randint(-5, 5), x + w, rnd.randint(4, 12)))
            gaps.append((room, x + w // 2, y, rnd.choice([-5, 0, 3, 12, 40])))
            if rnd.random() < 0.6:
                arcs.append((x + w // 2 + rnd.randint(-15, 15), y + rnd.randint(-9, 9)))
        for _ in range(rnd.choice([0, 0, 6])):
            put(rnd.random() < 0.5, rnd.randint(900, 960), rnd.randint(-20, 20), rnd.randint(0, 60))
        k = len(lines) // 3
        frame = rnd.choice([900, 2000]), 300, plan % 10 / 10, rnd.choice([None, 60.0])
        yield plan, lines[k:], None, gaps[1:], arcs, *frame
        yield plan, lines[:k], contours, gaps[:1], None, *frame


def test_small_plans_parse_as_tables_do(spark):
    df = spark.createDataFrame(list(parts(random.Random(3), 60)), PARTS).repartition(3)
    value = lambda df: sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect())
    found, by_tables, mixed = (value(chain.parsed_parts(df, small)) for small in (None, 0, 40))
    assert found == by_tables == mixed and len(found) == 60
    # plans with rooms, contours' walls and both kinds of openings came up
    assert len({r[1] for r in found}) > 8 and len({r[2] for r in found}) > 2 and any(r[3] for r in found) and any(r[4] for r in found)
    assert chain.parsed_parts(df.limit(0)).count() == 0
    # plans that stand alone in their batch, with and without rooms
    for r in (next(r for r in found if not r[2]), next(r for r in found if r[2])):
        assert value(chain.parsed_parts(df.filter(f"plan = {r[0]}").coalesce(1))) == [r]


@pytest.mark.parametrize("n", [1, 12, 90])
def test_folds_of_many_groups_equal_scans(spark, n):
    rnd = random.Random(n)
    rows = [(g, i, rnd.randint(-40, 40), *sorted((rnd.randint(-30, 30), rnd.randint(-30, 30))), rnd.randint(1, 20)) for g in range(9) for i in range(rnd.randint(1, n))]
    df = spark.createDataFrame(rows, "g int, id long, pos int, s int, e int, thick int").cache()
    g, id_, pos, s, e, thick = (pa.array(c).to_numpy() for c in zip(*rows, strict=True))
    a, b = drawings.paired(g, id_, pos, s, e, 3, 20, 0.3)
    assert sorted(zip(g[a], id_[a], id_[b], pos[b] - pos[a], strict=True)) == sorted(map(tuple, greedy_pairs(df, ["g"], 3, 20, 0.3).collect()))
    first, *extent = drawings.merged(g, [id_], pos, s, e, 2, 10)
    assert sorted(zip(g[first], id_[first], *extent, strict=True)) == sorted(tuple(r)[:5] for r in merged_extents(df, ["g"], 2, 10).collect())
    stay = drawings.kept(g, [id_], pos, s, e, thick, 10, 0.4)
    assert sorted(zip(g[stay], id_[stay], thick[stay], strict=True)) == sorted((r.g, r.kept, r.thick) for r in dedupe_walls(df, ["g"], 10, 0.4).collect())


def test_the_chain_takes_few_jobs(spark):
    # every table between two steps was a job or more of its own
    spark.sparkContext.setJobGroup("chain", "chain")
    assert drawing.parse_chain(spark, "/root/testdata/sf0.001").count() > 0
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("chain")) <= 8


def test_lists_count_in_what_a_task_holds(spark, monkeypatch):
    # rows of long lists are not worked on by the number of rows
    held, kernel = spark.sparkContext.accumulator(0), chain.small_plans
    lines = "transform(sequence(0, 199), k -> struct(bigint(k) AS id, k % 2 = 0 AS horizontal, int(k * 7 % 90) AS pos, int(k) AS s, int(k + 30) AS e))"
    empty = lambda kind: f"CAST(array() AS array<{kind}>)"
    df = spark.range(300).selectExpr("id AS plan", f"{lines} AS lines", f"{empty(CONTOUR)} AS contours", f"{empty('struct<gap_id:bigint,cx:bigint,cy:bigint,width_px:int>')} AS gaps", f"{empty('struct<cx:bigint,cy:bigint>')} AS arcs", "900 AS width", "300 AS height", "0.5 AS white", "NULL AS square_meters").coalesce(1)

    def counted(number, part):
        held.add(number[-1] + 1 > 30)
        return kernel(number, part)

    monkeypatch.setattr(chain, "TOGETHER", 4000)
    monkeypatch.setattr(chain, "small_plans", counted)
    assert len({repr(r[1:]) for r in chain.parsed_parts(df).collect()}) == 1 and held.value == 0
