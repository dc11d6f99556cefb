"""Range joins and order-dependent folds over intervals."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def band_pairs(lines: DataFrame, keys: list[str], position: str, row: str, low: int, high: int) -> DataFrame:
    """Pairs (a, b) of rows of a key whose positions lie ``low`` to ``high`` apart.

    Each row looks in its own bucket of ``high`` units and in the next one, so the join is on the key and the
    bucket and a large key is spread over many of both.
    """
    bucket = F.floor(F.col(position) / high).cast("long")
    a = lines.select(*keys, F.col(row).alias("a"), F.col(position).alias("__pa"), F.explode(F.array(bucket, bucket + 1)).alias("__bucket"))
    b = lines.select(*keys, F.col(row).alias("b"), F.col(position).alias("__pb"), bucket.alias("__bucket"))
    apart = F.col("__pb") - F.col("__pa")
    return a.join(b, [*keys, "__bucket"]).filter(apart.between(low, high)).select(*keys, "a", "b", apart.alias("apart"))


def overlapping_pairs(lines: DataFrame, keys: list[str], row: str, start: str, end: str, width: int) -> DataFrame:
    """keys, a, b, s_a, e_a, s_b, e_b: pairs of rows of a key (a before b) whose intervals [start, end] touch.

    An interval stands in every bucket of ``width`` units that it reaches, and a pair counts in the first bucket
    that both reach, so a large key is spread over its buckets and no pair comes twice.
    """
    at = lambda c: F.floor(F.col(c) / width).cast("long")
    rows = lines.select(*keys, F.col(row).alias("a"), F.col(start).alias("s_a"), F.col(end).alias("e_a"), at(start).alias("__from"), F.explode(F.sequence(at(start), at(end))).alias("__bucket"))
    other = rows.select(*keys, F.col("a").alias("b"), F.col("s_a").alias("s_b"), F.col("e_a").alias("e_b"), F.col("__from").alias("__other"), "__bucket")
    met = rows.join(other, [*keys, "__bucket"]).filter((F.col("a") < F.col("b")) & (F.col("__bucket") == F.greatest("__from", "__other")))
    return met.filter((F.col("s_a") <= F.col("e_b")) & (F.col("s_b") <= F.col("e_a"))).select(*keys, "a", "b", "s_a", "e_a", "s_b", "e_b")


def with_neighbour(lines: DataFrame, keys: list[str], position: str, reach: int, condition: Column, how: str) -> DataFrame:
    """The rows of ``lines`` that have another one (its columns called ``<name>_b``) with ``condition`` at most ``reach``
    away in position, by a semi-join, or that have none, by an anti-join.

    A row looks for others in its own bucket of ``reach`` units; others stand in their own and both next to it.
    """
    bucket = F.floor(F.col(position) / reach).cast("long")
    other = lines.select(*[F.col(c).alias(f"{c}_b") for c in lines.columns], F.explode(F.array(bucket - 1, bucket, bucket + 1)).alias("__bucket_b"))
    same = F.col("__bucket") == F.col("__bucket_b")
    for k in keys:
        same = same & (F.col(k) == F.col(f"{k}_b"))
    return lines.withColumn("__bucket", bucket).join(other, same & condition, how).drop("__bucket")


def islands(lines: DataFrame, keys: list[str], reach: int) -> DataFrame:
    """The lines with ``__island``, the number of their island, and ``__width``, the mean extent of its lines.

    Positions fall to buckets as wide as the reach; an island is a stretch of buckets without an empty one, so lines of
    different islands lie further apart than the reach and never meet. Buckets are counted and numbered, never lines, so
    a drawing with very many lines is neither sorted nor held in one task.
    """
    lines = lines.withColumn("__bucket", F.floor(F.col("pos") / F.greatest(F.lit(reach), F.lit(1))).cast("long"))
    used = lines.groupBy(*keys, "__bucket").agg(F.sum(F.greatest(F.col("e") - F.col("s"), F.lit(0)).cast("double")).alias("__sum"), F.count("*").alias("__n"))
    w = Window.partitionBy(*keys).orderBy("__bucket")
    apart = F.coalesce((F.col("__bucket") - F.lag("__bucket").over(w) > 1).cast("long"), F.lit(0))
    used = used.withColumn("__apart", apart).withColumn("__island", F.sum("__apart").over(w))
    whole = Window.partitionBy(*keys, "__island")
    width = F.ceil(F.sum("__sum").over(whole) / F.sum("__n").over(whole)).cast("long")
    names = [F.col(k).alias(f"__of_{i}") for i, k in enumerate(keys)]
    used = used.select(*names, F.col("__bucket").alias("__at"), "__island", F.greatest(width, F.lit(1)).alias("__width"))
    same = F.col("__bucket") == F.col("__at")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"__of_{i}"))
    return lines.join(used, same).drop("__bucket", "__at", *[f"__of_{i}" for i in range(len(keys))])


class Cells:
    """What a fold has seen so far, by bands of position and cells along the lines."""

    def __init__(self, band: int, width: int) -> None:
        self.band, self.width = max(1, band), width
        self.bands: dict[int, dict[int, dict[int, list]]] = {}
        self.reach: dict[tuple[int, int], tuple[int, int]] = {}

    def put(self, pos: int, low: int, high: int, number: int, item: list) -> None:
        """Enters the item in the cells from low to high; cells that it stands in already aren't gone through again."""
        band, first, last = pos // self.band, low // self.width, high // self.width
        before = self.reach.get((band, number))
        cells = self.bands.setdefault(band, {})
        if before is None:
            new = range(first, last + 1)
        else:
            new = [*range(first, before[0]), *range(before[1] + 1, last + 1)]
            first, last = min(first, before[0]), max(last, before[1])
        for c in new:
            cells.setdefault(c, {})[number] = item
        self.reach[band, number] = first, last

    def take(self, pos: int, number: int) -> None:
        band = pos // self.band
        first, last = self.reach.pop((band, number))
        for c in range(first, last + 1):
            del self.bands[band][c][number]

    def first(self, below: int, above: int, low: int, high: int, fits: Callable[[list], bool]) -> int | None:
        """The smallest number of an item that fits, among those at positions from below to above and in the cells from low to high."""
        found: int | None = None
        for band in range(below // self.band, above // self.band + 1):
            cells = self.bands.get(band)
            if cells is None:
                continue
            for c in range(low // self.width, high // self.width + 1):
                for number, item in cells.get(c, {}).items():
                    if (found is None or number < found) and fits(item):
                        found = number
        return found

    def forget(self, below: int) -> None:
        """Drops bands of positions below that nothing will meet any more."""
        for band in [b for b in self.bands if b < below // self.band]:
            for items in self.bands.pop(band).values():
                for number in items:
                    self.reach.pop((band, number), None)


class Few:
    """``Cells`` for few lines: all are gone through."""

    def __init__(self) -> None:
        self.reach: dict[int, list] = {}

    def put(self, pos: int, low: int, high: int, number: int, item: list) -> None:
        self.reach[number] = item

    def take(self, pos: int, number: int) -> None:
        del self.reach[number]

    def first(self, below: int, above: int, low: int, high: int, fits: Callable[[list], bool]) -> int | None:
        # numbers come in order
        for number, item in self.reach.items():
            if fits(item):
                return number
        return None

    def forget(self, below: int) -> None:
        pass


def seen(band: int, width: int) -> Cells | Few:
    """Where a fold keeps what it has seen; the width is 0 where there are few lines."""
    return Cells(band, width) if width else Few()


#: Lines of a key that are folded as one island, without looking for its islands; and lines that are few.
WHOLE_LINES, FEW_LINES = 4096, 64


def scanned(lines: DataFrame, keys: list[str], reach: int, order: list[str], values: list[str], fold: Callable, out: list[tuple[str, str]]) -> DataFrame:
    """A fold over each island's lines in order: ``fold`` makes, for an island's mean extent (0: few lines), a step that gets a line's ``values`` and
    an end; both give rows of ``out``.

    Lines come sorted, one after the other, so a task holds what the fold keeps and never a plan's lines. Keys of up to WHOLE_LINES lines are one island each
    and move once, where they aren't together already; only larger ones are cut into islands.
    """
    whole = Window.partitionBy(*keys)
    columns = [*keys, *dict.fromkeys([*values, *order, "pos", "s", "e"])]
    extent = F.greatest(F.ceil(F.avg(F.greatest(F.col("e") - F.col("s"), F.lit(0))).over(whole)), F.lit(1)).cast("long")
    sized = lines.select(*columns, F.count("*").over(whole).alias("__n"), extent.alias("__width"))
    named = [*keys, "__island", "__width", *values]
    small = sized.filter(F.col("__n") <= WHOLE_LINES).withColumn("__island", F.lit(0).cast("long")).withColumn("__width", F.when(F.col("__n") <= FEW_LINES, 0).otherwise(F.col("__width")).cast("long"))
    small = small.sortWithinPartitions(*keys, *order).select(*named)
    large = islands(sized.filter(F.col("__n") > WHOLE_LINES).select(*columns), keys, reach)
    large = large.repartition(*keys, "__island").sortWithinPartitions(*keys, "__island", *order).select(*named)
    kinds = {"int": pa.int32(), "long": pa.int64()}
    n = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, step, end, types = None, None, None, []
        for batch in batches:
            types = [batch.schema.field(i).type for i in range(n)]
            found: list[tuple] = []
            for row in zip(*map(plain, batch.columns), strict=True):
                if row[: n + 1] != group:
                    if end is not None:
                        found += [(*group[:n], *r) for r in end()]
                    group = row[: n + 1]
                    step, end = fold(row[n + 1])
                found += [(*group[:n], *r) for r in step(*row[n + 2 :])]
            yield batch_of(found, types)
        if end is not None:
            yield batch_of([(*group[:n], *r) for r in end()], types)

    def plain(column: pa.Array) -> list:
        numbers = not column.null_count and pa.types.is_integer(column.type)
        return column.to_numpy().tolist() if numbers else column.to_pylist()  # to_pylist is slow

    def batch_of(found: list[tuple], types: list[pa.DataType]) -> pa.RecordBatch:
        kept = [*types, *(kinds[k] for _, k in out)]
        columns = list(zip(*found, strict=True)) or [()] * len(kept)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kept, strict=True)], names=[*keys, *(name for name, _ in out)])

    schema = ", ".join([*(f"`{k}` {lines.schema[k].dataType.simpleString()}" for k in keys), *(f"{name} {kind}" for name, kind in out)])
    return small.mapInArrow(run, schema).union(large.mapInArrow(run, schema))


def share(s1: int, e1: int, s2: int, e2: int) -> float:
    """The shared part of two intervals against the longer one, as ``overlap_ratio`` has it."""
    return max(0, min(e1, e2) - max(s1, s2)) / max(e1 - s1, e2 - s2, 1)


def greedy_pairs(lines: DataFrame, keys: list[str], low: int, high: int, least_overlap: float) -> DataFrame:
    """Pairs of parallel lines: in the order of position, a line takes the earliest open line at a distance
    between the bounds that overlaps it enough; both are then closed. ``lines`` has pos, id, s and e (its extent); ``least_overlap`` is above 0.

    That is each line taking the nearest later one that is still free. One scan over each island's lines, which keeps the open lines of the last ``high`` units.
    """

    def fold(width: int):
        open_, numbers = seen(high, width), iter(range(1 << 62))
        items: dict[int, list] = {}

        def step(pos: int, id_: int, s: int, e: int) -> list[tuple]:
            open_.forget(pos - high)
            hit = open_.first(pos - high, pos - low, s, e, lambda o: low <= pos - o[0] <= high and share(o[2], o[3], s, e) >= least_overlap)
            if hit is None:
                number = next(numbers)
                items[number] = [pos, id_, s, e]
                open_.put(pos, s, e, number, items[number])
                if len(items) > 4 * len(open_.reach) + 1000:  # those that were dropped
                    alive = {n for _, n in open_.reach}
                    for k in [k for k in items if k not in alive]:
                        del items[k]
                return []
            other = items.pop(hit)
            open_.take(other[0], hit)
            return [(other[1], id_, pos - other[0])]

        return step, list

    values = ["pos", "id", "s", "e"]
    return scanned(lines, keys, high, values, values, fold, [("a", "long"), ("b", "long"), ("apart", "int")])


def merged_extents(lines: DataFrame, keys: list[str], gap: int, near: int) -> DataFrame:
    """Merged extents (keys, first, pos, s, e, n), named by their first line: in the order of ``id``, a line joins the first extent so far whose position is within
    ``near`` and that lies within ``gap`` of it; the extent grows and its position becomes the truncated mean. Earlier lines
    are not tried again. ``lines`` has id, pos, s and e.

    One scan over each island's lines, which keeps the extents, found by their place.
    """

    def fold(width: int):
        cells, extents = seen(near, width), []

        def step(id_: int, pos: int, s: int, e: int) -> list[tuple]:
            hit = cells.first(pos - near, pos + near, min(s, e), max(s, e), lambda o: abs(o[1] - pos) <= near and max(o[2], s) - min(o[3], e) <= gap)
            if hit is None:
                hit = len(extents)
                extents.append([id_, pos, s, e, 1])
            else:
                first, at, low, high, n = extents[hit]
                extents[hit][:] = first, int((at + pos) / 2), min(low, s), max(high, e), n + 1
            _, at, low, high, _ = extents[hit]
            cells.put(at, min(low, high) - gap, max(low, high) + gap, hit, extents[hit])
            return []

        return step, lambda: map(tuple, extents)

    return scanned(lines, keys, near, ["id", "pos", "s", "e"], ["id", "pos", "s", "e"], fold, [("first", "long"), ("pos", "int"), ("s", "int"), ("e", "int"), ("n", "int")])


def merge_collinear(lines: DataFrame, keys: list[str], gap: int, near: int) -> DataFrame:
    """``merged_extents``, numbered in a plan from 0."""
    # extents are numbered in the order in which they began
    number = F.row_number().over(Window.partitionBy(*keys).orderBy("first")) - 1
    return merged_extents(lines, keys, gap, near).select(*keys, number.alias("extent"), "pos", "s", "e", "n")


def dedupe_walls(walls: DataFrame, keys: list[str], near: int, least_overlap: float) -> DataFrame:
    """Walls without doubles: in the order of ``id``, a wall falls to the first seed that is near and overlaps it
    enough, which keeps the strictly thicker of the two; else it is a seed. Later walls are compared with the
    seed, not with what it keeps. ``walls`` has id, pos, s, e and thick; ``least_overlap`` is 0 or more.

    One scan over each island's walls, which keeps the seeds, found by their place.
    """

    def fold(width: int):
        cells, seeds = seen(near, width), []

        def step(id_: int, pos: int, s: int, e: int, thick: int) -> list[tuple]:
            hit = cells.first(pos - near, pos + near, s, e, lambda o: abs(o[3] - pos) <= near and share(o[4], o[5], s, e) > least_overlap)
            if hit is None:
                seeds.append([id_, id_, thick, pos, s, e])
                cells.put(pos, s, e, len(seeds) - 1, seeds[-1])
            elif thick > seeds[hit][2]:
                seeds[hit][1:3] = id_, thick
            return []

        return step, lambda: (tuple(s[:3]) for s in seeds)

    return scanned(walls, keys, near, ["id", "pos", "s", "e", "thick"], ["id", "pos", "s", "e", "thick"], fold, [("seed", "long"), ("kept", "long"), ("thick", "int")])
