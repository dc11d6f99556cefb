import re
from collections import Counter, defaultdict
from math import comb

import pytest
from pyspark.sql import functions as F

from planweave.llm.mixing import hypergeometric, mix_sources, mixed_blocks, mixed_shards, mixed_texts, shard_quotas, uniform

SMALL = "/root/testdata/sf0.001"


def targets(sizes):
    """Caps at twice the source, the excess reshared by weight until none is above."""
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: (3.0, 1.0, 2.0)[i % 3] for i, s in enumerate(names)}
    left, open_, got = 1.5 * sum(sizes.values()), set(names), {}
    while open_:
        share = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if share * weight[s] > 2 * sizes[s]}
        if not over:
            return got | {s: share * weight[s] for s in open_}
        for s in over:
            got[s] = 2.0 * sizes[s]
            left -= got[s]
        open_ -= over
    return got


def check(rows, want):
    size = Counter()
    for text, source in want:
        size[source] += len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    aim, taken = targets(size), defaultdict(int)
    for r in rows:
        assert r.source_size == size[r.source] and r.target == pytest.approx(aim[r.source])
        assert 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
    for s in size:
        assert abs(taken[s] - aim[s]) <= 1
    assert len(rows) == len(want)


@pytest.mark.parametrize("shard_words", [2_000_000, 3_000])
def test_quotas_are_exact_and_reruns_agree(spark, shard_words):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = mix_sources(docs, shard_words=shard_words, window_blocks=16).collect()
    check(rows, [(r.text, r.source) for r in docs.collect()])
    assert sorted(rows) == sorted(mix_sources(docs.repartition(3), shard_words=shard_words, window_blocks=16).collect())


def test_every_source_is_dealt_over_the_shards(spark):
    """Shards are of even size, and hold of each source what a random draw of their size would."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows, blocks = mixed_blocks(docs, shard_words=60_000)
    source = {r.row: r.source for r in rows.collect()}
    blocks = blocks.collect()
    sizes, n, at = Counter(), Counter(), Counter()
    for b in blocks:
        sizes[b.shard] += 1
        n[source[b.row]] += 1
        at[b.shard, source[b.row]] += 1
    total, shards = len(blocks), len(sizes)
    assert shards >= 8 and max(sizes.values()) - min(sizes.values()) <= 1
    for shard, size in sizes.items():
        for s, k in n.items():
            share = k / total
            spread = (size * share * (1 - share) * (total - size) / (total - 1)) ** 0.5
            assert abs(at[shard, s] - size * share) <= 5 * spread + 1, (shard, s)
    # a copy's blocks are disjoint, and positions number each shard
    assert len({(b.row, b.copy, b.block) for b in blocks}) == total
    for shard, size in sizes.items():
        assert sorted(b.position for b in blocks if b.shard == shard) == list(range(1, size + 1))


def test_quotas_add_up_and_frequencies_are_hypergeometric(spark):
    counts = {1: 500, 2: 300, 3: 0, 4: 480}
    quotas = shard_quotas(spark.createDataFrame(list(counts.items()), "s int, n long"), 7).collect()
    of = lambda key: Counter({k: sum(q.quota for q in quotas if q[key] == k) for k in {q[key] for q in quotas}})
    assert of("s") == Counter({1: 500, 2: 300, 4: 480}) and of("shard") == Counter({s: 10 for s in range(128)})
    # 128 shards of 10 of 1280 blocks
    seen = Counter(q.quota for q in quotas if q.s == 1)
    for k in range(1, 8):
        p = comb(500, k) * comb(780, 10 - k) / comb(1280, 10)
        assert abs(seen[k] / 128 - p) < 4 * (p * (1 - p) / 128) ** 0.5 + 0.01


def test_shards_hold_the_words_of_the_mix(docs):
    rows = [(1, "one two  three\n four", "en", "a"), (2, " ".join(f"w{i}" for i in range(1000)), "en", "a"), (3, "x y", "en", "b"), (4, None, "en", "b")]
    df = docs(rows)
    mixed = mixed_shards(df, shard_words=200).collect()
    texts = {i: t.split() if t else [] for i, t, *_ in rows}
    took = Counter()
    for r in mixed:
        part = texts[r.doc_id][256 * r.block : 256 * (r.block + 1)]
        assert r.text.split() == part[: len(r.text.split())]
        took[r.doc_id] += len(r.text.split())
    assert took == Counter({r.doc_id: r.taken for r in mix_sources(df, shard_words=200).collect() if r.taken})
    assert len({(r.shard, r.position) for r in mixed}) == len(mixed)
    whole = Counter((r.doc_id, len(r.text.split())) for r in mixed_texts(df).collect())
    assert sum(k[1] * n for k, n in whole.items()) == sum(took.values())


def test_nulls_ties_and_long_texts(docs):
    rows = [(1, "a b", "en", "x"), (1, "a b", "en", "x"), (None, None, None, None), (2, "w " * 50_000, "en", None), (3, "", "en", "y"), (4, "a b c", "en", "z"), (5, "q", "en", "\U0001f600"), (6, "q", "en", "￮")]
    check(mix_sources(docs(rows)).collect(), [(r[1], r[3]) for r in rows])
    assert mix_sources(docs([])).count() == 0


def test_clashing_columns(spark):
    df = spark.createDataFrame([(1, "a b c", "s", 9, 9, 9)], "doc_id long, text string, source string, size int, target int, words int")
    assert [(r.size, r.taken) for r in mix_sources(df).collect()] == [(3, 5)] or [(r.size, r.taken) for r in mix_sources(df).collect()] == [(3, 4)]


def test_hypergeometric_frequencies(spark):
    n, left, k, draws = 12, 5, 6, 20_000
    u = uniform(F.col("id"))
    got = spark.range(draws).select(hypergeometric(F.lit(n).cast("long"), F.lit(left).cast("long"), F.lit(k).cast("long"), u).alias("x")).groupBy("x").count().collect()
    for r in got:
        assert abs(r["count"] / draws - comb(left, r.x) * comb(n - left, k - r.x) / comb(n, k)) < 0.015
    assert {r.x for r in got} <= set(range(6))
