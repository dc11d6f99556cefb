"""The faces of many small plans at once, in numpy: what ``faces`` does by joins, for the plans of one batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from planweave.sources.scratch import Round

#: Most rows of a plan that is worked on in one task, rows of the plans that are worked on together, and pairs held at a time.
SMALL, TOGETHER, PAIRS = 4096, 65_536, 1 << 20


def ringed(after: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least number of each edge's ring and the steps to it, where ``after`` has the edge that follows each."""
    face, off, jump, steps = np.arange(len(after)), np.zeros(len(after), np.int64), after, 1
    while True:
        nearer = face[jump] < face
        if not nearer.any():
            return face, off
        face, off, jump, steps = np.where(nearer, face[jump], face), np.where(nearer, off[jump] + steps, off), jump[jump], 2 * steps


def starts(*columns: np.ndarray) -> np.ndarray:
    """Where in sorted columns a new value begins."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return new


def order_by(*keys: np.ndarray) -> np.ndarray:
    """The order of rows by whole numbers, the first key first; one number stands for all keys where it can."""
    code, size = np.zeros(len(keys[0]), np.int64), 1
    if not len(code):
        return code
    for k in keys:
        low = int(k.min())
        span = int(k.max()) - low + 1
        size *= span
        if size >= 1 << 62:
            return np.lexsort(keys[::-1])
        code = code * span + (k.astype(np.int64, copy=False) - low)
    return np.argsort(code, kind="stable")


def following(plan: np.ndarray, e: np.ndarray) -> np.ndarray:
    """The edge that follows each directed edge (ax, ay, bx, by): of those that leave its end the next one clockwise from the way back."""
    n = len(e)
    if n == 0:
        return np.zeros(0, np.int64)
    way = lambda dx, dy: np.arctan2(dy.astype(float), dx.astype(float))
    d = e[:, 2:] - e[:, :2]
    x, y = np.concatenate([e[:, 0], e[:, 2]]), np.concatenate([e[:, 1], e[:, 3]])
    angle = np.concatenate([way(d[:, 0], d[:, 1]), way(-d[:, 0], -d[:, 1])])
    leaves, edge, at = np.repeat([True, False], n), np.tile(np.arange(n), 2), np.tile(plan, 2)
    order = order_by(at, x, y, np.unique(angle, return_inverse=True)[1], leaves.astype(np.int64))
    new, out = starts(at[order], x[order], y[order]), leaves[order]
    first = np.maximum.accumulate(np.where(new, np.arange(2 * n), 0))
    last = np.maximum.accumulate(np.where(out, np.arange(2 * n), -1))
    ends = np.append(np.flatnonzero(new)[1:], 2 * n) - 1
    last = np.where(last >= first, last, last[ends][np.cumsum(new) - 1])
    after = np.empty(n, np.int64)
    after[edge[order][~out]] = edge[order][last[~out]]
    return after


def both_ways(plan: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different segments of some length, each in both directions, one after the other."""
    turned = (s[:, 0] > s[:, 2]) | ((s[:, 0] == s[:, 2]) & (s[:, 1] > s[:, 3]))
    s = np.where(turned[:, None], s[:, [2, 3, 0, 1]], s)
    known = np.column_stack([plan, s])[(s[:, :2] != s[:, 2:]).any(1)]
    known = known[order_by(*known.T)]
    known = known[starts(*known.T)] if len(known) else known
    return np.repeat(known[:, 0], 2), np.stack([known[:, 1:], known[:, [3, 4, 1, 2]]], 1).reshape(-1, 4)


def around(plan: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, ...]:
    """The directed edges of segments that lie on rings, with ring, steps and follower: edges of one face on both sides are left out."""
    plan, e = both_ways(plan, s)
    face, off = ringed(after := following(plan, e))
    loose = np.repeat(face[::2] == face[1::2], 2)
    if loose.any():
        plan, e = plan[~loose], e[~loose]
        face, off = ringed(after := following(plan, e))
    return plan, e, face, off, after


class Rings:
    """The rings around something of directed edges: plan, twice the area less the holes', least edge and corners. ``outside``: whether edges
    stand in both directions, so that the outside of each part is a ring as well."""

    def __init__(self, plan: np.ndarray, e: np.ndarray, face: np.ndarray, off: np.ndarray, after: np.ndarray, outside: bool = True) -> None:
        cross = e[:, 0] * e[:, 3] - e[:, 1] * e[:, 2]
        order = order_by(face, *e.T)
        at = np.flatnonzero(starts(face[order]))
        names, first = face[order][at], e[order][at]
        double, of = np.add.reduceat(cross[order], at), plan[order][at]
        row = np.full(len(e), -1)
        row[names] = np.arange(len(names))
        outer = np.flatnonzero(double < 0)
        if outside:  # the plan's outside is traced too: only plans of several parts have holes
            outer = outer[np.bincount(of[outer], minlength=of.max() + 1)[of[outer]] > 1]
        cut = np.zeros(len(names), np.int64)
        if len(outer):
            on = np.full(len(names), -1)
            on[outer] = above_next_edge(of[outer], first[outer, :2], plan, e, row[face])
            # an outline above another outline lies in the same ring
            while len(moved := outer[(on[outer] >= 0) & (double[on[outer]] < 0)]):
                on[moved] = on[on[moved]]
            held = outer[on[outer] >= 0]
            np.add.at(cut, on[held], double[held])
        shell = np.flatnonzero(double > 0)
        self.plan, self.double, self.first, self.names = of[shell], (double + cut)[shell], first[shell], names[shell]
        self.parts = plan, e, face, off, after

    def corners(self, some: np.ndarray) -> pa.ListArray:
        """The corners of the outer ring of the rings numbered ``some``."""
        _, e, face, off, after = self.parts
        wanted = np.zeros(len(e), bool)
        wanted[self.names[some]] = True
        names, rings = outer_rings(e, face, off, after, np.flatnonzero(wanted[face]))
        place = np.empty(len(e), np.int64)
        place[names] = np.arange(len(names))
        return rings.take(pa.array(place[self.names[some]]))


def above_next_edge(of: np.ndarray, at: np.ndarray, plan: np.ndarray, e: np.ndarray, face: np.ndarray) -> np.ndarray:
    """The face above the edge next below each point ``at`` of the plans ``of``, -1 without one."""
    rising = np.flatnonzero(e[:, 2] > e[:, 0])
    rising = rising[np.argsort(plan[rising], kind="stable")]
    low, high = np.searchsorted(plan[rising], of, "left"), np.searchsorted(plan[rising], of, "right")
    hit = np.full(len(of), -1)
    for some in np.split(np.arange(len(of)), np.flatnonzero(np.diff(np.cumsum(high - low) // PAIRS)) + 1):
        n = (high - low)[some]
        point = np.repeat(some, n)
        edge = rising[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low[some], n)]
        (ax, ay, bx, by), (x, y) = e[edge].T, at[point].T
        under = (ax <= x) & (x < bx) & ((ay - y) * (bx - ax) + (by - ay) * (x - ax) < 0)
        point, edge, ax, ay, bx, by, x = (c[under] for c in (point, edge, ax, ay, bx, by, x))
        order = np.lexsort(((by - ay) / (bx - ax), ay + (by - ay) * (x - ax) / (bx - ax), point))
        hit[point[order]] = face[edge[order]]  # the last of a point counts
    return hit


def outer_rings(e: np.ndarray, face: np.ndarray, off: np.ndarray, after: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, pa.ListArray]:
    """The faces of the edges numbered ``edges`` and the corners of their outer rings: a ring that comes to a corner again is closed there, and the one around the others counts."""
    order = edges[np.lexsort((e[edges, 3], e[edges, 2], face[edges]))]
    again = ~starts(face[order], e[order, 2], e[order, 3]) if len(order) else np.zeros(0, bool)
    if not again.any():
        return drawn(e, face, off, edges)
    names, rings = drawn(e, face, off, edges[~np.isin(face[edges], face[order][again])])
    some = order[np.isin(face[order], face[order][again])]
    some = some[np.lexsort((along(off[some]), e[some, 3], e[some, 2], face[some]))]
    new = starts(face[some], e[some, 2], e[some, 3])
    before = np.arange(len(some)) - 1
    before[new] = np.append(np.flatnonzero(new)[1:], len(some)) - 1
    number = np.empty(len(e), np.int64)
    number[some] = np.arange(len(some))
    part, steps = ringed(number[after[some][before]])
    double = np.zeros(len(some), np.int64)
    np.add.at(double, part, e[some, 0] * e[some, 3] - e[some, 1] * e[some, 2])
    split, more = drawn(e[some], part, steps, np.flatnonzero(double[part] > 0))
    return np.append(names, face[some[split]]), pa.concat_arrays([rings, more])


def along(off: np.ndarray) -> np.ndarray:
    """What sorts the edges of a ring from its least edge on."""
    return np.where(off == 0, -(1 << 62), -off)


def drawn(e: np.ndarray, face: np.ndarray, off: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, pa.ListArray]:
    """The faces of the edges numbered ``edges`` and their corners in order, from its least edge."""
    order = edges[np.lexsort((along(off[edges]), face[edges]))]
    at = np.flatnonzero(starts(face[order])) if len(order) else np.zeros(0, np.int64)
    points = pa.StructArray.from_arrays([pa.array(e[order, 0]), pa.array(e[order, 1])], ["x", "y"])
    return face[order][at], pa.ListArray.from_arrays(pa.array(np.append(at, len(order)), pa.int32()), points)


def plan_by_plan(rows: DataFrame, kernel: Callable[[np.ndarray, pa.Table], tuple[np.ndarray, list[pa.Array]]], schema: str, types: list[pa.DataType], small: int | None = None, size: Column | None = None, together: int = TOGETHER) -> tuple[DataFrame, DataFrame]:
    """What ``kernel`` makes of the rows (plan, ...) of plans of at most ``small`` rows (SMALL), and the rows of larger plans, left as they are.
    A row counts as ``size``, 1 at least, where it holds lists; about ``together`` rows, so counted, are worked on together.

    ``kernel`` gets the rows of many whole plans and each row's plan, numbered from 0; it gives the plan's number and the values of ``schema`` (``types``) for each
    row that it makes. A window counts the rows of a plan, which so follow each other in one task without another shuffle; a task
    holds one batch of small plans. All is read once and written.
    """
    names, limit = rows.columns, SMALL if small is None else small
    fields = [f.split()[0] for f in schema.split(", ")]
    counted = rows.withColumn("__size", F.lit(1) if size is None else size)
    counted = counted.withColumn("__rows", F.sum("__size").over(Window.partitionBy("plan"))).sortWithinPartitions("plan")
    made_type = pa.struct(list(zip(fields, types, strict=True)))

    def result(plan: pa.Array, made: pa.Array, kept: pa.Array) -> list[pa.RecordBatch]:
        return pa.table([plan, made, kept], names=["plan", "made", "kept"]).to_batches()

    def worked(part: pa.Table) -> list[pa.RecordBatch]:
        part = part.combine_chunks()
        code = part["plan"].combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
        new = starts(code)
        of, columns = kernel(np.cumsum(new) - 1, part)
        plan = part["plan"].combine_chunks().take(pa.array(np.flatnonzero(new)[of]))
        kept = pa.struct([part.schema.field(n) for n in names[1:]])
        return result(plan, pa.StructArray.from_arrays(columns, fields=list(made_type)), pa.nulls(len(of), kept))

    def pieces(t: pa.Table, whole: bool) -> tuple[list[pa.Table], pa.Table]:
        """Tables of whole plans, and what is left: the rows of the last plan, which may go on, unless all are ``whole``."""
        code = t["plan"].combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
        at, sizes = np.flatnonzero(starts(code)), t["__size"].to_numpy()
        cuts = at[1:][np.diff((np.cumsum(sizes) - sizes)[at] // together) > 0]
        end = t.num_rows if whole else at[-1]
        cuts = [0, *cuts[cuts < end], end]
        return [t.slice(a, b - a) for a, b in zip(cuts, cuts[1:]) if b > a], t.slice(end)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left: pa.Table | None = None
        held = 0
        for batch in batches:
            t = pa.Table.from_batches([batch])
            large = t.filter(pc.greater(t["__rows"], limit)).combine_chunks()
            if large.num_rows:
                values = [large[n].combine_chunks() for n in names[1:]]
                yield from result(large["plan"].combine_chunks(), pa.nulls(large.num_rows, made_type), pa.StructArray.from_arrays(values, fields=[t.schema.field(n) for n in names[1:]]))
                t = t.filter(pc.less_equal(t["__rows"], limit))
            left = t if left is None else pa.concat_tables([left, t])
            held += pc.sum(t["__size"]).as_py() or 0
            if held >= together + limit:
                done, left = pieces(left.combine_chunks(), False)
                for part in done:
                    yield from worked(part)
                held = pc.sum(left["__size"]).as_py()
        if left is not None and left.num_rows:
            for part in pieces(left.combine_chunks(), True)[0]:
                yield from worked(part)

    of_plan = rows.schema["plan"].dataType.simpleString()
    kept = ", ".join(f"`{n}`: {rows.schema[n].dataType.simpleString()}" for n in names[1:])
    made = ", ".join(f"{f.split(' ', 1)[0]}: {f.split(' ', 1)[1]}" for f in schema.split(", "))
    written = Round(counted.mapInArrow(run, f"plan {of_plan}, made struct<{made}>, kept struct<{kept}>")).table
    return written.filter("made IS NOT NULL").select("plan", "made.*"), written.filter("kept IS NOT NULL").select("plan", "kept.*")


FACES = "ring array<struct<x:bigint,y:bigint>>, area double, first struct<ax:bigint,ay:bigint,bx:bigint,by:bigint>"
POINT = pa.struct([("x", pa.int64()), ("y", pa.int64())])
EDGE = pa.struct([(n, pa.int64()) for n in ("ax", "ay", "bx", "by")])
FACE_TYPES = [pa.list_(POINT), pa.float64(), EDGE]
FRAMED, FRAMED_TYPES = f"{FACES}, width double, height double", [*FACE_TYPES, pa.float64(), pa.float64()]
NONE = np.zeros(0, np.int64), [pa.array([], t) for t in FACE_TYPES]


def ends_of(part: pa.Table, *names: str) -> np.ndarray:
    return np.column_stack([part[n].to_numpy() for n in names]).astype(np.int64)


def made_of(rings: Rings, some: np.ndarray) -> tuple[np.ndarray, list[pa.Array]]:
    first = pa.StructArray.from_arrays([pa.array(c) for c in rings.first[some].T], fields=list(EDGE))
    return rings.plan[some], [rings.corners(some).cast(pa.list_(POINT)), pa.array(rings.double[some] / 2), first]


def small_faces(number: np.ndarray, part: pa.Table) -> tuple[np.ndarray, list[pa.Array]]:
    """The polygons that each plan's segments (x1, y1, x2, y2) enclose."""
    edges = around(number, ends_of(part, "x1", "y1", "x2", "y2"))
    return made_of(rings := Rings(*edges), np.arange(len(rings.plan))) if len(edges[0]) else NONE


def small_framed_faces(number: np.ndarray, part: pa.Table) -> tuple[np.ndarray, list[pa.Array]]:
    """The same with the largest width and height that stand in the plan's rows."""
    plan, columns = small_faces(number, part)
    largest = [np.fmax.reduceat(part[c].to_numpy(), np.flatnonzero(starts(number))) for c in ("width", "height")]
    return plan, [*columns, *(pa.array(v[plan], pa.float64(), from_pandas=True) for v in largest)]


def largest_rings(number: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, list[pa.Array]]:
    """The largest ring of each plan's directed edges (ax, ay, bx, by); of equals the one with the least first edge."""
    if not len(e):
        return NONE
    rings = Rings(number, e, *ringed(after := following(number, e)), after, outside=False)
    order = np.lexsort((*rings.first.T[::-1], -rings.double, rings.plan))
    return made_of(rings, order[starts(rings.plan[order])]) if len(order) else NONE


REGIONS, REGION_TYPES = "area bigint, y bigint, x bigint", [pa.int64()] * 3


def small_regions(number: np.ndarray, part: pa.Table, reach: int) -> tuple[np.ndarray, list[pa.Array]]:
    """Area and first pixel of each region of runs (y, x1, x2) of neighbouring rows that lie within ``reach`` of each other."""
    y, x1, x2 = ends_of(part, "y", "x1", "x2").T
    order = np.lexsort((x1, y, number))
    plan, y, x1, x2 = (c[order] for c in (number, y, x1, x2))
    if not len(plan):
        return plan, [pa.array([], t) for t in REGION_TYPES]
    row, wide = plan * (np.ptp(y) + 2) + y - y.min(), np.ptp(np.append(x1, x2)) + 3
    at = lambda r, x: r * wide + np.clip(x - x1.min() + 1, 0, wide - 1)
    # runs of a row don't meet, so those that a run touches in the next row follow each other
    low = np.searchsorted(at(row, x2), at(row + 1, x1 - reach), "left")
    n = np.maximum(np.searchsorted(at(row, x1), at(row + 1, x2 + reach), "right") - low, 0)
    a = np.repeat(np.arange(len(plan)), n)
    b = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
    label = np.arange(len(plan))
    while True:
        near = label.copy()
        np.minimum.at(near, a, label[b])
        np.minimum.at(near, b, label[a])
        near = np.minimum(near, near[near])
        if (near == label).all():
            break
        label = near
    area = np.zeros(len(plan), np.int64)
    np.add.at(area, label, x2 - x1 + 1)
    first = np.flatnonzero(label == np.arange(len(plan)))
    return plan[first], [pa.array(c[first]) for c in (area, y, x1)]
