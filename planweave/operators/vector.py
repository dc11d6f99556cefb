"""Cosine similarity search, against every vector or through an inverted-file index."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from planweave.sources.scratch import Round


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, v: s + v)


#: Vectors in a block, pairs that a task holds at a time, and what a product of matrices may be off for vectors of length 1.
BLOCK_ROWS, HELD_PAIRS, SLACK = 20_000, 2_000_000, 1e-9


def best_in_blocks(asked: DataFrame, dealt: DataFrame, blocks: list[str], k: int) -> DataFrame:
    """(query_id, vec_id, similarity): of each block the k best vectors (vec_id, v, norm) for each query (query_id, q, q_norm), more in no case.

    Vectors are finite, not null, all as long and of lengths that can be multiplied. A product of matrices tells which pairs can be among the best; only those are
    worked out component by component as ``dot`` does, so results are the same to the last bit.
    """
    kinds = [f"{n} {df.schema[n].dataType.simpleString()}" for df, n in ((asked, "query_id"), (dealt, "vec_id"))]

    def matrix(table: pa.Table, name: str) -> np.ndarray:
        return table[name].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(table), -1)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        queries, rows, best = [], [], []
        if len(left) and len(right):
            right = right.sort_by("vec_id")
            q, v = matrix(left, "q"), matrix(right, "v")
            q_norm, norm = left["q_norm"].to_numpy(), right["norm"].to_numpy()
            unit_q, unit_v = q / q_norm[:, None], (v / norm[:, None]).T
            step = max(1, HELD_PAIRS // len(right))
            for at in range(0, len(left), step):
                near = unit_q[at : at + step] @ unit_v
                least = np.partition(near, -k, axis=1)[:, -k] if k < len(right) else near.min(1)
                i, j = np.nonzero(near >= least[:, None] - SLACK)
                total, i = np.zeros(len(i)), i + at
                for c in range(q.shape[1]):
                    total += q[i, c] * v[j, c]
                total /= q_norm[i] * norm[j]
                order = np.lexsort((j, -total, i))
                i, j, total = i[order], j[order], total[order]
                kept = np.arange(len(i)) - np.searchsorted(i, i) < k
                queries.append(i[kept])
                rows.append(j[kept])
                best.append(total[kept])
        join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
        return pa.table({"query_id": left["query_id"].take(join(queries, np.int64)), "vec_id": right["vec_id"].take(join(rows, np.int64)), "similarity": join(best, float)})

    return asked.groupBy(*blocks).cogroup(dealt.groupBy(*blocks)).applyInArrow(run, ", ".join([*kinds, "similarity double"]))


def cosine_top_k(vectors: DataFrame, queries: DataFrame, k: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(query_id, vec_id, similarity, rank): every query against every vector, in blocks of vectors.

    There are as many blocks as the number of vectors asks for, and at least one a shuffle partition. A query meets each
    block in one task, which keeps k rows a query. Odd vectors (null, with nulls, not finite, of another size than most or of a length that is
    hard to multiply) meet all others one by one; their similarity may be null.
    """
    blocks = max(-(-vectors.count() // block_rows), int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    size = vectors.groupBy(F.size("embedding").alias("size")).count().orderBy(F.desc("count"), "size").first()
    v = F.col("embedding")
    norm = F.sqrt(dot(v, v))
    plain = F.coalesce((F.size(v) == F.lit(size["size"] if size else 0)) & F.col("vec_id").isNotNull() & (norm > 1e-100) & (norm < 1e100), F.lit(False))
    dealt = vectors.select("vec_id", v.alias("v"), norm.alias("norm"), plain.alias("plain")).withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)))
    asked = queries.select(F.col("vec_id").alias("query_id"), v.alias("q"), norm.alias("q_norm"), plain.alias("q_plain"))
    asked = asked.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    odd = lambda a, b: a.join(b, "block").select("query_id", "vec_id", F.try_divide(dot(F.col("q"), F.col("v")), F.col("q_norm") * F.col("norm")).alias("similarity"))
    scored = best_in_blocks(asked.filter("q_plain"), dealt.filter("plain"), ["block"], k)
    scored = scored.union(odd(asked.filter("q_plain"), dealt.filter("NOT plain"))).union(odd(asked.filter("NOT q_plain"), dealt))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "vec_id"))
    return scored.withColumn("rank", rank).filter(F.col("rank") <= k)


#: Most lists of an index, vectors that its centres are found from for each list, and rounds of that; room for rounding in an angle.
MAX_LISTS, SAMPLE_A_LIST, ROUNDS, ANGLE_SLACK = 1024, 40, 8, 1e-6


def unit(v: Column) -> Column:
    """The vector at length 1, null for one that is null, empty, of length 0 or not finite."""
    norm = F.sqrt(dot(v, v))
    return F.when((norm > 0) & (norm < float("inf")), F.transform(v, lambda x: x.cast("double") / norm))


def angle_between(a: Column, b: Column) -> Column:
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b))))


class InvertedIndex:
    """Vectors (vec_id, embedding) in lists by their nearest centre, written by list.

    There are about sqrt(n) lists, MAX_LISTS at most. Their centres are found by k-means on a sample of SAMPLE_A_LIST vectors a list (ordered by a
    hash, so reruns agree); every vector is indexed. Null vectors and those without a direction are not. Of each list the index knows the
    widest angle to its centre.
    """

    def __init__(self, vectors: DataFrame, lists: int | None = None, seed: int = 1) -> None:
        spark = vectors.sparkSession
        rows = Round(vectors.select("vec_id", unit(F.col("embedding")).alias("u")).filter("u IS NOT NULL")).table
        n = rows.count()
        self.lists = max(1, min(lists or math.isqrt(n), MAX_LISTS, n))
        if n == 0:
            self.centres = spark.createDataFrame([], "list int, centre array<double>, radius double, size long")
            self.rows = rows.select("vec_id", "u", F.lit(0).alias("list"))
            return
        sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE_A_LIST * self.lists).select(array_to_vector("u").alias("features"))
        if self.lists > 1:
            model = KMeans(k=self.lists, maxIter=ROUNDS, seed=seed).fit(sample)
            centres = model.clusterCenters()
            placed = model.transform(rows.withColumn("features", array_to_vector("u"))).select("vec_id", "u", F.col("prediction").alias("list"))
        else:
            centres, placed = [rows.first()["u"]], rows.withColumn("list", F.lit(0))
        table = spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(centres)], "list int, centre array<double>")
        # a centre without a direction may stand anywhere
        table = table.withColumn("centre", F.coalesce(unit(F.col("centre")), F.transform("centre", lambda x, i: (i == 0).cast("double"))))
        placed = placed.join(F.broadcast(table), "list").select("vec_id", "u", "list", angle_between(F.col("u"), F.col("centre")).alias("angle"))
        self.rows = Round(placed.repartition("list")).table
        widths = self.rows.groupBy("list").agg(F.max("angle").alias("radius"), F.count("*").alias("size"))
        self.centres = Round(table.join(widths, "list")).table

    def search(self, queries: DataFrame, k: int, probes: int = 8, exact: bool = True) -> DataFrame:
        """(query_id, vec_id, similarity, rank): the k nearest of each query (vec_id, embedding), ties to the smaller id.

        A query first meets the vectors of its ``probes`` nearest lists. That is the answer of an approximate search; an exact one then meets every other list that can hold a
        vector nearer than the k-th so far: those whose centre lies no further than that one's angle and the list's radius together.
        """
        asked = queries.select(F.col("vec_id").alias("query_id"), unit(F.col("embedding")).alias("q")).filter("q IS NOT NULL").distinct()
        listed = asked.withColumn("list", F.explode(F.sequence(F.lit(0), F.lit(self.lists - 1))))
        # at most MAX_LISTS centres
        to_list = listed.join(F.broadcast(self.centres), "list").select("query_id", "q", "list", "radius", "size", angle_between(F.col("q"), F.col("centre")).alias("far"))
        order = F.row_number().over(Window.partitionBy("query_id").orderBy("far", "list"))
        plan = Round(to_list.withColumn("order", order)).table
        first = self._nearest(self._met(plan.filter(F.col("order") <= probes), k), k)
        if not exact:
            return first
        first = Round(first).table
        kth = first.filter(F.col("rank") == k).select("query_id", F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("similarity")))).alias("reach"))
        more = plan.filter(F.col("order") > probes).join(kth, "query_id", "left").filter(F.col("far") - F.col("radius") <= F.coalesce("reach", F.lit(math.pi)) + ANGLE_SLACK)
        return self._nearest(self._met(more, k).unionByName(first.drop("rank")), k)

    def _met(self, plan: DataFrame, k: int) -> DataFrame:
        """The k best of each list for its queries; large lists are cut into parts."""
        one, parts = F.lit(1.0), F.ceil(F.col("size") / BLOCK_ROWS).cast("long")
        asked = plan.select("query_id", "q", "list", one.alias("q_norm"), F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("part"))
        rows = self.rows.join(F.broadcast(self.centres.select("list", "size")), "list")
        dealt = rows.select("vec_id", F.col("u").alias("v"), "list", one.alias("norm"), F.pmod(F.xxhash64("vec_id"), parts).alias("part"))
        return best_in_blocks(asked, dealt, ["list", "part"], k)

    @staticmethod
    def _nearest(scored: DataFrame, k: int) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "vec_id"))
        return scored.withColumn("rank", rank).filter(F.col("rank") <= k)
