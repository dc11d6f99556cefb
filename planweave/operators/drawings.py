"""The parse chain of many small plans at once, in numpy: what ``chain`` does by joins and scans, for the plans of one batch."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from planweave.operators.plane import PAIRS, Rings, around, order_by, starts


def met(of: np.ndarray, low: np.ndarray, high: np.ndarray, other: np.ndarray, at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows (i, j) with of[i] = other[j] and low[i] <= at[j] <= high[i], about PAIRS at a time."""
    if not len(of) or not len(other):
        return
    order = order_by(other, at)
    least = min(at.min(), low.min())
    wide = max(at.max(), high.max()) - least + 1
    key = other[order] * wide + at[order] - least
    first = np.searchsorted(key, of * wide + low - least, "left")
    n = np.maximum(np.searchsorted(key, of * wide + high - least, "right") - first, 0)
    for some in np.split(np.arange(len(of)), np.flatnonzero(np.diff(np.cumsum(n) // PAIRS)) + 1):
        m = n[some]
        yield np.repeat(some, m), order[np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m) + np.repeat(first[some], m)]


def share(s1: np.ndarray, e1: np.ndarray, s2: np.ndarray, e2: np.ndarray) -> np.ndarray:
    """The shared part of two intervals against the longer one, as ``overlap_ratio`` has it."""
    return np.maximum(np.minimum(e1, e2) - np.maximum(s1, s2), 0) / np.maximum(np.maximum(e1 - s1, e2 - s2), 1)


def islands(group: np.ndarray, pos: np.ndarray, s: np.ndarray, e: np.ndarray, reach: int, gap: int) -> np.ndarray:
    """Numbers of islands: lines of different ones have different groups, lie further apart than the reach, or further along than the gap."""
    if not len(group):
        return group
    order = order_by(group, pos)
    new = starts(group[order])
    new[1:] |= np.diff(pos[order]) > reach
    strip = np.empty(len(group), np.int64)
    strip[order] = np.cumsum(new) - 1
    low, high = np.minimum(s, e), np.maximum(s, e)
    order = order_by(strip, low)
    base = strip * (high.max() - low.min() + gap + 2) - low.min()
    so_far = np.maximum.accumulate((base + high)[order])
    new[1:] = (base + low)[order][1:] > so_far[:-1] + gap
    found = np.empty(len(group), np.int64)
    found[order] = np.cumsum(new) - 1
    return found


def tables(island: np.ndarray, *keys: np.ndarray) -> Iterator[np.ndarray]:
    """The rows of each island in the order of ``keys``, a line an island, those of like size in one table; the rest of a line is -1."""
    order = order_by(island, *keys)
    at = np.flatnonzero(starts(island[order])) if len(order) else order
    size = np.diff(np.append(at, len(order)))
    width = np.where(size <= 8, size, 1 << np.ceil(np.log2(np.maximum(size, 1))).astype(np.int64))
    for w in np.unique(width):
        some, place = width == w, np.arange(w)
        row = np.minimum(at[some][:, None] + place, len(order) - 1)
        yield np.where(place < size[some][:, None], order[row], -1)


def first_fitting(fits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lines of a table with something that fits, and where it stands first."""
    hit = fits.argmax(1)
    row = np.flatnonzero(fits[np.arange(len(fits)), hit])
    return row, hit[row]


def paired(group: np.ndarray, id_: np.ndarray, pos: np.ndarray, s: np.ndarray, e: np.ndarray, low: int, high: int, least_overlap: float) -> tuple[np.ndarray, np.ndarray]:
    """The rows (a, b) of ``greedy_pairs``: all islands go on by a line at a time."""
    found = [(np.zeros(0, np.int64),) * 2]
    for t in tables(islands(group, pos, s, e, high, 0), pos, id_, s, e):
        p, s_, e_, open_ = pos[t], s[t], e[t], t >= 0
        for k in range(1, t.shape[1]):
            apart = p[:, k, None] - p[:, :k]
            fits = open_[:, :k] & open_[:, k, None] & (low <= apart) & (apart <= high) & (share(s_[:, :k], e_[:, :k], s_[:, k, None], e_[:, k, None]) >= least_overlap)
            row, hit = first_fitting(fits)
            open_[row, hit] = open_[row, k] = False
            found.append((t[row, hit], t[row, k]))
    a, b = zip(*found, strict=True)
    return np.concatenate(a), np.concatenate(b)


def merged(group: np.ndarray, order: list[np.ndarray], pos: np.ndarray, s: np.ndarray, e: np.ndarray, gap: int, near: int) -> tuple[np.ndarray, ...]:
    """The extents of ``merged_extents`` in the given order: the row that began each, its position, start and end."""
    found = [(np.zeros(0, np.int64),) * 4]
    for t in tables(islands(group, pos, s, e, near, gap), *order):
        # an extent stands where its first line does
        at, low, high, begun = pos[t], s[t], e[t], t >= 0
        for k in range(1, t.shape[1]):
            apart = np.maximum(low[:, :k], low[:, k, None]) - np.minimum(high[:, :k], high[:, k, None])
            fits = begun[:, :k] & begun[:, k, None] & (np.abs(at[:, :k] - at[:, k, None]) <= near) & (apart <= gap)
            row, hit = first_fitting(fits)
            at[row, hit] = np.trunc((at[row, hit] + at[row, k]) / 2)
            low[row, hit], high[row, hit] = np.minimum(low[row, hit], low[row, k]), np.maximum(high[row, hit], high[row, k])
            begun[row, k] = False
        found.append((t[begun], at[begun], low[begun], high[begun]))
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def kept(group: np.ndarray, order: list[np.ndarray], pos: np.ndarray, s: np.ndarray, e: np.ndarray, thick: np.ndarray, near: int, least_overlap: float) -> np.ndarray:
    """The rows that ``dedupe_walls`` keeps in the given order."""
    found = [np.zeros(0, np.int64)]
    for t in tables(islands(group, pos, s, e, near, 0), *order):
        p, s_, e_, most, best, seed = pos[t], s[t], e[t], thick[t], t.copy(), t >= 0
        for k in range(1, t.shape[1]):
            fits = seed[:, :k] & seed[:, k, None] & (np.abs(p[:, :k] - p[:, k, None]) <= near) & (share(s_[:, :k], e_[:, :k], s_[:, k, None], e_[:, k, None]) > least_overlap)
            row, hit = first_fitting(fits)
            seed[row, k] = False
            thicker = most[row, k] > most[row, hit]
            row, hit = row[thicker], hit[thicker]
            most[row, hit], best[row, hit] = most[row, k], t[row, k]
        found.append(best[seed])
    return np.concatenate(found)


def room_areas(plan: np.ndarray, ends: np.ndarray, grid: int, least_walls: int, least_segments: int) -> tuple[np.ndarray, np.ndarray]:
    """Plan and area of each polygon that the plans' walls (x1, y1, x2, y2) enclose once they are snapped."""
    ends = (np.rint(ends / grid) * grid).astype(np.int64)
    if not len(plan):
        return plan, np.zeros(0)
    enough = np.bincount(plan) >= least_walls
    enough &= np.bincount(plan, (ends[:, :2] != ends[:, 2:]).any(1)) >= least_segments
    edges = around(plan[enough[plan]], ends[enough[plan]])
    if not len(edges[0]):
        return plan[:0], np.zeros(0)
    rings = Rings(*edges)
    return rings.plan, rings.double / 2


def parts_of(part: pa.Table, name: str, plan: np.ndarray, *fields: str) -> list[np.ndarray]:
    """Plan and fields (whole numbers) of all that the rows' lists ``name`` hold."""
    lists = part[name].combine_chunks()
    values = pc.list_flatten(lists)
    return [plan[pc.list_parent_indices(lists).to_numpy()], *(values.field(f).to_numpy(zero_copy_only=False).astype(np.int64) for f in fields)]


def lists_of(n: int, plan: np.ndarray, values: np.ndarray) -> pa.ListArray:
    """The values of the plans 0 to n - 1 as lists."""
    order = np.argsort(plan, kind="stable")
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(np.bincount(plan, minlength=n))), pa.int32()), pa.array(values[order]))
