"""The inverted-file index against all vectors."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from planweave.operators.vector import InvertedIndex, best_in_blocks, cosine_top_k, dot


@pytest.fixture(scope="module")
def vectors(spark):
    rng = random.Random(7)
    centres = [[rng.gauss(0, 1) for _ in range(12)] for _ in range(30)]
    rows = [(i, [x + rng.gauss(0, 0.25) for x in rng.choice(centres)]) for i in range(3000)]
    rows += [(5000 + i, rows[7][1]) for i in range(9)] + [(6000, None), (6001, [0.0] * 12), (6002, [float("nan")] * 12)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>").cache()


def test_exact_search_equals_a_scan(vectors):
    queries = vectors.filter("vec_id % 100 = 0 AND vec_id < 5000")
    sound = vectors.filter("vec_id < 6000")
    want = {(r.query_id, r["rank"]): r.vec_id for r in cosine_top_k(sound, queries, 5).withColumn("similarity", F.round("similarity", 9)).collect()}
    index = InvertedIndex(vectors)
    assert index.lists == 54 and index.rows.count() == 3009
    for probes in (1, 4, 100):
        got = index.search(queries, 5, probes).collect()
        assert {(r.query_id, r["rank"]): r.vec_id for r in got} == want, probes


def test_recall_and_rows_read(vectors):
    queries = vectors.filter("vec_id % 100 = 0 AND vec_id < 5000")
    index = InvertedIndex(vectors)
    exact = {(r.query_id, r.vec_id) for r in index.search(queries, 5).collect()}
    found = {(r.query_id, r.vec_id) for r in index.search(queries, 5, probes=6, exact=False).collect()}
    assert len(found & exact) / len(exact) >= 0.9
    largest = index.centres.orderBy(F.desc("size")).limit(6).agg(F.sum("size")).first()[0]
    assert largest < index.rows.count() / 2  # what a query reads at most


def test_small_and_empty_tables(spark):
    schema = "vec_id long, embedding array<double>"
    none = spark.createDataFrame([], schema)
    assert InvertedIndex(none).search(none, 3).count() == 0
    few = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], schema)
    assert [(r.vec_id, r["rank"]) for r in InvertedIndex(few).search(few.filter("vec_id = 1"), 5, probes=1).orderBy("rank").collect()] == [(1, 1), (2, 2)]


def test_blocks_hand_on_only_the_best(spark, vectors):
    """As pair by pair, odd vectors, equal ones and other sizes among them; of each block k rows a query leave the task."""
    odd = spark.createDataFrame([(7000, [1.0] * 11), (7001, [1e-200] * 12), (7002, [1e200] * 12), (7003, [None] * 12), (7, [1.0] * 12), (None, [2.0] * 12), (7005, [float("inf")] * 12)], "vec_id long, embedding array<double>")
    rows = vectors.filter("vec_id >= 2500").union(odd)
    queries = rows.filter("vec_id % 50 = 0 OR vec_id >= 5000 OR vec_id IS NULL")
    pairs = queries.selectExpr("vec_id AS query_id", "embedding AS q").crossJoin(rows)
    norm = lambda c: F.sqrt(dot(F.col(c), F.col(c)))
    pairs = pairs.withColumn("similarity", F.try_divide(dot(F.col("q"), F.col("embedding")), norm("q") * norm("embedding")))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "vec_id"))
    want = pairs.withColumn("rank", rank).filter("rank <= 5").select("query_id", "vec_id", "similarity", "rank").collect()
    got = cosine_top_k(rows, queries, 5, block_rows=100).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    sides = vectors.filter("vec_id < 5000").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"), F.lit(1.0).alias("q_norm"), F.lit(0).alias("block"))
    dealt = sides.selectExpr("query_id AS vec_id", "q AS v", "q_norm AS norm", "block")
    assert best_in_blocks(sides.filter("query_id % 100 = 0"), dealt, ["block"], 5).count() == 150
