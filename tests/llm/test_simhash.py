import random

import numpy as np
import pytest
import xxhash

from planweave.llm.common import components
from planweave.llm.simhash import allocate, fingerprint, group_bits, links, pigeonhole_plan, simhash_groups


def slow_fingerprint(text, width=4):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def closure(nodes, linked):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(nodes):
        for b in nodes[:i]:
            if linked(a, b):
                r, s = find(a), find(b)
                root[max(r, s)] = min(r, s)
    return {n: find(n) for n in nodes}


def brute(rows, distance=4):
    fp = {i: slow_fingerprint(t) for i, t in rows}
    part = closure(sorted(fp), lambda a, b: (fp[a] ^ fp[b]).bit_count() <= distance)
    return sorted((i, f"{fp[i]:016x}", part[i]) for i in fp)


def test_fingerprint():
    rng = random.Random(1)
    for n in (0, 1, 3, 4, 5, 60):
        text = " \t".join(rng.choice(["A", "b", "É", " x", "c\x1cd"]) for _ in range(n))
        assert fingerprint(text.encode(), 4) == slow_fingerprint(text)


def test_whole_small_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert sorted(map(tuple, simhash_groups(docs).collect())) == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_nulls_ties_long_and_empty(docs):
    base = [f"w{i}" for i in range(400)]
    rows = [(1, None), (2, ""), (3, " \n"), (4, "x " * 60_000), (5, " ".join(base)), (6, " ".join(base[:200] + ["q"] + base[201:])), (7, "X " * 60_000), (8, "alone")]
    assert sorted(map(tuple, simhash_groups(docs(rows)).collect())) == brute(rows)
    assert simhash_groups(docs([])).count() == 0
    got = simhash_groups(docs([(None, "a b c d e"), (None, "a b c d e"), (9, "a b c d e"), (None, "other")])).collect()
    assert sorted(str(r.component_id) for r in got) == ["9", "9", "9", "None"]


def test_clashing_columns(spark):
    df = spark.createDataFrame([(1, "a", 5, 5, 5), (2, "a", 6, 6, 6)], "doc_id long, text string, id int, fp int, node int")
    assert {r.component_id for r in simhash_groups(df).collect()} == {1}


@pytest.mark.parametrize("distance", [2, 4])
def test_links_lose_nothing_in_dense_groups(spark, distance, monkeypatch):
    from planweave.llm import simhash

    monkeypatch.setattr(simhash, "BLOCK", 16)
    rng = random.Random(distance)
    values = set()
    for _ in range(6):
        centre = rng.getrandbits(64)
        values |= {centre ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(6))) & (2**64 - 1) for _ in range(60)}
    values |= {rng.getrandbits(64) for _ in range(200)}
    values = sorted(int(np.uint64(v).view(np.int64)) for v in values)
    edges = links(spark.createDataFrame([(v,) for v in values], "fp long"), distance).collect()
    assert len(edges) < 40 * len(values)
    want = closure(values, lambda a, b: ((a ^ b) & (2**64 - 1)).bit_count() <= distance)
    pairs = {(r.a, r.b) for r in edges}
    assert closure(values, lambda a, b: (a, b) in pairs or (b, a) in pairs) == want


def test_thresholds_cover_the_distance():
    rng = np.random.default_rng(3)
    sample = rng.integers(-(2**63), 2**63, 500)
    for n in (100, 10**6, 10**9):
        plan = pigeonhole_plan(sample, n, 4)
        assert sum(t + 1 for _, t in plan) == 5
        bits = [b for g, _ in plan for b in g]
        assert len(bits) == len(set(bits))
    assert allocate([[0, 5, 9], [0, 1, 2]], 2) == [0, 1]
    assert sorted(b for g in group_bits(np.ones((3, 64)), 5) for b in g) == list(range(64))


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (300, 200), (200, 300)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(30)} | {200: 200, 300: 200}
