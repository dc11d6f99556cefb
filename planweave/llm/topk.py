"""Exact top-k search by inner product, with candidates ruled out by a table of distances to pivots."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from planweave.llm.common import partitions, written

#: Pivots, vectors they are chosen from, vectors in a block of candidates and of queries, candidate blocks that one
#: task holds, and candidates scored between two looks at the bounds.
PIVOTS = 32
PIVOT_SAMPLE = 2_000
CANDIDATES = 4_096
QUERIES = 1_024
GROUP = 8
STEP = 256
#: Doubles hold every integer up to EXACT; from WHOLE on, 256 times a double is a whole number.
EXACT, WHOLE, SCALE = float(1 << 53), float(1 << 45), 256.0
#: Most bytes of a candidate block.
BLOCK_BYTES = 4 << 20
#: Room for rounding in a distance (a root of a difference) and in a product, against the longest vector's square.
GAP_SLACK, SLACK = 1e-6, 1e-9
LONG = (1 << 63) - 1

FOUND = pa.schema([("q", pa.int64()), ("query_id", pa.int64()), ("score", pa.int64()), ("order", pa.binary()), ("vec_id", pa.int64())])


def scaled(name: str = "embedding") -> Column:
    """floor(256 x) / 256, which a double holds for any x: beyond WHOLE, x itself is a multiple of 1/256."""
    return F.transform(F.col(name).cast("array<double>"), lambda x: F.when(F.abs(x) >= WHOLE, x).otherwise(F.floor(SCALE * x).cast("double") / SCALE))


def usable(name: str = "embedding") -> Column:
    """No null, no null or non-finite component."""
    bad = F.exists(F.col(name).cast("array<double>"), lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.col(name).isNotNull() & ~F.coalesce(bad, F.lit(True))


def farthest_first(sample: np.ndarray, pivots: int) -> np.ndarray:
    """Pivots far from each other, the first the longest vector."""
    chosen = [int(np.argmax((sample**2).sum(1)))]
    distance = ((sample - sample[chosen[0]]) ** 2).sum(1)
    while len(chosen) < min(pivots, len(sample)):
        chosen.append(int(np.argmax(distance)))
        distance = np.minimum(distance, ((sample - sample[chosen[-1]]) ** 2).sum(1))
    return sample[chosen]


def lifted(vectors: np.ndarray, longest: float, query: bool = False) -> np.ndarray:
    """One more component gives all candidates the same length, so that the nearest has the largest product."""
    norms = (vectors**2).sum(1)
    extra = np.zeros(len(vectors)) if query else np.sqrt(np.maximum(0.0, longest - norms))
    return np.column_stack([vectors, extra])


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, (a**2).sum(1)[:, None] + (b**2).sum(1)[None] - 2 * a @ b.T))


@dataclass
class Space:
    """What all tasks know: the pivots, and the unit (a power of two) in which every component is at most 1.

    Bounds and first scores are worked out in this unit, so nothing overflows; a power of two loses no digit.
    """

    width: int
    unit: float
    longest: float
    pivots: np.ndarray

    def table(self, points: np.ndarray, query: bool) -> np.ndarray:
        """(pivots, points): distances to the pivots."""
        return distances(self.pivots, lifted(points / self.unit, self.longest, query))

    @property
    def slack(self) -> float:
        return SLACK * (1 + self.longest)

    def upper(self, norm: float, gaps: np.ndarray) -> np.ndarray:
        """The largest product (in squares of the unit) at a distance of at least ``gaps``."""
        return (norm + self.longest - np.maximum(0.0, gaps - GAP_SLACK * (1 + self.longest)) ** 2) / 2 + self.slack


@dataclass
class Block:
    """Vectors of a block with their numbers, ids and distances to the pivots; ``low`` and ``high`` hold the range per pivot."""

    rows: np.ndarray
    ids: np.ndarray
    vectors: np.ndarray
    table: np.ndarray

    def __post_init__(self) -> None:
        self.low, self.high = self.table.min(1), self.table.max(1)
        with np.errstate(over="ignore"):  # too long for an exact product in doubles all the same
            self.norms = np.sqrt((self.vectors**2).sum(1))


def whole(x: float) -> int:
    """256 x for a multiple of 1/256, in Python's integers of any size."""
    return int(x) * int(SCALE) if abs(x) >= WHOLE else int(x * SCALE)


def whole_product(a: np.ndarray, b: np.ndarray) -> int:
    """The inner product of the whole numbers that 256 times the components are."""
    return sum(whole(x) * whole(y) for x, y in zip(a.tolist(), b.tolist(), strict=True))


def sort_key(score: int) -> bytes:
    """Bytes that are ordered as integers of any size are: sign, number of bytes, bytes; turned over below zero."""
    size = (abs(score).bit_length() + 7) // 8
    key = b"\x01" + size.to_bytes(4, "big") + abs(score).to_bytes(size, "big")
    return key if score >= 0 else b"\x00" + bytes(255 - b for b in key[1:])


@dataclass
class Best:
    """The k best candidates of a query so far, as (-score, id, row), best first; ``scored`` counts products."""

    k: int
    found: list[tuple[int, int, int]]
    floor: float
    scored: int = 0

    def search(self, query: np.ndarray, own: int, block: Block, to_pivots: np.ndarray, space: Space) -> None:
        """Scores the block's candidates in the order of their bounds, until none can enter any more."""
        norm = float((query / space.unit) @ (query / space.unit))
        gaps = np.maximum(np.maximum(block.low - to_pivots, to_pivots - block.high), 0.0)
        if space.upper(norm, gaps.max(initial=0.0)) < self.floor:
            return
        lower = np.zeros(len(block.ids))
        for p in range(len(to_pivots)):
            np.maximum(lower, np.abs(block.table[p] - to_pivots[p]), out=lower)
        upper = space.upper(norm, lower)
        order = np.argsort(-upper, kind="stable")
        length = np.sqrt(norm) * space.unit
        for i in range(0, len(order), STEP):
            if upper[order[i]] < self.floor:
                return
            some = order[i : i + STEP]
            some = some[block.rows[some] != own]
            self.scored += len(some)
            # where every partial sum is a whole number that doubles hold, the product is exact
            product = (block.vectors[some] / space.unit) @ (query / space.unit)
            exact = length * block.norms[some] * SCALE**2 < EXACT
            near = np.flatnonzero(product >= self.floor - space.slack) if len(self.found) >= self.k else np.arange(len(some))
            if len(near) > self.k and exact.all():
                # only the k best of this step, and their ties, can enter
                near = near[product[near] >= np.partition(product[near], -self.k)[-self.k]]
            for j in near.tolist():
                c = some[j]
                score = int(block.vectors[c] @ query * SCALE**2) if exact[j] else whole_product(query, block.vectors[c])
                self.found.append((-score, int(block.ids[c]), int(block.rows[c])))
            self.found = sorted(self.found)[: self.k]
            if len(self.found) == self.k:
                # integers of any size divide to the nearest double
                self.floor = max(self.floor, -self.found[-1][0] / whole(space.unit) ** 2 - space.slack)


def first_floor(query: np.ndarray, own: int, sample: Block, space: Space, k: int) -> float:
    """A score that k candidates of the sample reach, less the room for rounding."""
    product = ((sample.vectors / space.unit) @ (query / space.unit))[sample.rows != own]
    return float(np.partition(product, -k)[-k]) - space.slack if len(product) >= k else -np.inf


def unpack(one: dict, width: int, table: int) -> Block:
    n = len(one["rows"])
    return Block(np.array(one["rows"], np.int64), np.array(one["ids"], np.int64), np.frombuffer(one["vectors"], np.float64).reshape(n, width), np.frombuffer(one["pivots"], np.float64).reshape(table, n))


def _tabled(space: Space, query: bool):
    """Each block with its distances to the pivots, worked out once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                one = batch.slice(i, 1)
                points = np.asarray(one.column(3)[0].values).reshape(-1, space.width)
                yield pa.RecordBatch.from_arrays([*one.columns[:3], pa.array([points.tobytes()], pa.binary()), pa.array([space.table(points, query).tobytes()], pa.binary())], names=["block", "rows", "ids", "vectors", "pivots"])

    return run


def _search(space: Space, sample: Block, k: int):
    """Rows come group by group, its candidate blocks (side 0) before the blocks of queries (side 1) that meet them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held = None, []
        for batch in batches:
            for one in (batch.slice(i, 1).to_pylist()[0] for i in range(len(batch))):
                if one["at"] != group:
                    group, held = one["at"], []
                block = unpack(one, space.width, len(space.pivots))
                if one["side"] == 0:
                    held.append(block)
                    continue
                out: list[tuple[int, int, int, bytes, int]] = []
                for i, (row, id_) in enumerate(zip(block.rows.tolist(), block.ids.tolist(), strict=True)):
                    query, to_pivots = block.vectors[i], block.table[:, i]
                    best = Best(k, [], first_floor(query, row, sample, space, k))
                    # blocks that may hold a nearer candidate come first
                    gaps = [np.maximum(np.maximum(b.low - to_pivots, to_pivots - b.high), 0.0).max(initial=0.0) for b in held]
                    for b in np.argsort(gaps, kind="stable").tolist():
                        best.search(query, row, held[b], to_pivots, space)
                    out += [(row, id_, max(-LONG - 1, min(LONG, -s)), sort_key(-s), v) for s, v, _ in best.found]
                columns = list(zip(*out, strict=True)) or [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, FOUND, strict=True)], schema=FOUND)

    return run


def _packed(grouped) -> DataFrame:
    packed = grouped.agg(F.collect_list(F.struct("row", "id", "v")).alias("r"))
    return packed.select(F.col("block").cast("long").alias("block"), F.col("r.row").alias("rows"), F.col("r.id").alias("ids"), F.flatten("r.v").alias("vectors"))


def _nearest(space: Space):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                points = np.asarray(batch.column("v").flatten()).reshape(-1, space.width)
                near = space.table(points, False).argmin(0).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("id"), batch.column("v"), pa.array(near)], names=["row", "id", "v", "near"])

    return run


def top_k_inner(vectors: DataFrame, k: int = 5, every: int = 50, id_column: str = "vec_id", vector_column: str = "embedding", candidates: int = CANDIDATES, queries: int = QUERIES) -> DataFrame:
    """query_id, rank, vec_id, score: each query's ``k`` highest inner products, ties to the smaller id.

    Components are floor(256 x). Queries are the rows whose id is divisible by ``every``; candidates are all
    rows but the query's own. Vectors that are null or hold a null or non-finite component take
    no part, nor do rows with a null id; shorter vectors count as filled up with zeros, empty ones included. Rows that
    repeat an id are candidates each, and queries each. Fewer than k candidates give fewer rows; an empty table
    gives none; other columns are ignored. Scores are exact for any finite component and any width: where a
    double might not hold a sum, Python's integers do. A score beyond a long is given as the nearest long, after ranking.

    Candidates stand in blocks by their nearest pivot, with their distances to all pivots (chosen from a bounded sample; every
    row is indexed). A task holds a group of candidate blocks, and every block of queries comes to each group, so
    neither candidates nor their tables are sent more than once. A query first scores the sample, which gives it
    a k-th score to beat; then the pivots bound each block, and each candidate, from above, and candidates are scored in
    that order until the next bound is below the k-th best score. Each group gives at most k rows a query.
    """
    rows = vectors.filter(usable(vector_column) & F.col(id_column).isNotNull()).select(F.col(id_column).cast("long").alias("id"), scaled(vector_column).alias("v")).withColumn("row", F.monotonically_increasing_id())
    # written, as a number must not change when a task runs again
    rows = written(rows)
    facts = rows.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("width"), F.max(F.array_max(F.transform("v", F.abs))).alias("component")).first()
    n, width = facts["n"], max(1, facts["width"] or 1)
    unit = 2.0 ** min(1023, max(0, int(np.frexp(facts["component"] or 1.0)[1])))
    squares = F.aggregate("v", F.lit(0.0), lambda a, x: a + (x / unit) * (x / unit))
    longest = rows.agg(F.max(squares)).first()[0] or 0.0
    rows = rows.withColumn("v", F.concat("v", F.array_repeat(F.lit(0.0), F.lit(width) - F.size("v"))))
    chosen = rows.orderBy(F.xxhash64("id"), "id", "row").limit(PIVOT_SAMPLE).collect()
    points = np.array([r["v"] for r in chosen], np.float64).reshape(-1, width)
    pivots = farthest_first(lifted(points / unit, longest), PIVOTS) if len(points) else np.zeros((1, width + 1))
    space = Space(width, unit, longest, pivots)
    sample = Block(np.array([r["row"] for r in chosen], np.int64), np.array([r["id"] for r in chosen], np.int64), points, space.table(points, False) if len(points) else np.zeros((1, 1)))
    # candidates of one pivot lie near each other, which keeps a block's range of distances narrow
    nearest = rows.mapInArrow(_nearest(space), "row long, id long, v array<double>, near int")
    candidates = max(1, min(candidates, BLOCK_BYTES // (8 * (width + len(pivots)))))
    counts = dict(map(tuple, nearest.groupBy("near").count().collect()))  # at most PIVOTS rows
    first, blocks = [0], []
    for p in range(len(pivots)):
        blocks.append(max(1, -(-counts.get(p, 0) // candidates)))
        first.append(first[-1] + blocks[-1])
    listed = [F.array(*map(F.lit, x))[F.col("near")] for x in (first, blocks)]
    dealt = nearest.groupBy((listed[0] + F.pmod(F.xxhash64("row"), listed[1])).alias("block"))
    kinds = "block long, rows array<long>, ids array<long>, vectors binary, pivots binary"
    packed = _packed(dealt).mapInArrow(_tabled(space, False), kinds)
    q_blocks = max(1, -(-n // (every * queries)))
    asked = rows.filter(F.col("id") % every == 0).groupBy(F.pmod(F.xxhash64("row"), F.lit(q_blocks)).alias("block"))
    asked = _packed(asked).mapInArrow(_tabled(space, True), kinds)
    groups = max(1, -(-n // (candidates * GROUP)), min(partitions(vectors), -(-n // candidates)))
    here = packed.withColumn("at", F.pmod("block", F.lit(groups))).withColumn("side", F.lit(0))
    there = asked.withColumn("at", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long")))).withColumn("side", F.lit(1))
    columns = ["at", "side", "block", "rows", "ids", "vectors", "pivots"]
    met = here.select(*columns).unionByName(there.select(*columns)).repartition(groups, "at").sortWithinPartitions("at", "side", "block")
    found = met.mapInArrow(_search(space, sample, k), "q long, query_id long, score long, order binary, vec_id long")
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("order"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
