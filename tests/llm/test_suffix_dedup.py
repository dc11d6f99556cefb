import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from planweave.llm import suffix_dedup
from planweave.llm.suffix_dedup import LENGTH, Texts, _known, common_prefixes, dedup_strings, merged, suffix_array


def brute(rows):
    """Every 100 bytes seen before, in the order of ids, cover bytes that go."""
    seen, out = set(), []
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - LENGTH + 1):
            s = b[p : p + LENGTH]
            if s in seen:
                gone[p : p + LENGTH] = True
            seen.add(s)
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        edges = np.diff(np.concatenate([[0], gone.astype(int), [0]]))
        out.append((i, len(b), int(gone.sum()), int((edges == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def run(docs, rows):
    return sorted(map(tuple, dedup_strings(docs(rows)).collect()), key=repr)


def mixed(n, seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(["th", "é", "on", "er", "\n", "a", "x", "中"]) for _ in range(rng.randrange(1, 5)))
    passages = [" ".join(word() for _ in range(rng.randrange(20, 90))) for _ in range(8)]
    rows = []
    for i in range(n):
        parts = [" ".join(word() for _ in range(rng.randrange(40)))]
        for _ in range(rng.randrange(3)):
            p = rng.choice(passages)
            a = rng.randrange(len(p) // 2)
            parts += [p[a : a + rng.randrange(60, 400)], word()]
        if rng.random() < 0.1:
            parts.append(rng.choice(["ab", "x", "the "]) * rng.randrange(30, 300))
        rows.append((i, " ".join(parts)))
    rows += [(n + i, rows[rng.randrange(n)][1]) for i in range(n // 8)]
    return rows


@pytest.mark.parametrize("small", [False, True])
def test_random_texts(docs, monkeypatch, small):
    if small:  # many shards, pieces and portions
        monkeypatch.setattr(suffix_dedup, "SHARD_BYTES", 3000)
        monkeypatch.setattr(suffix_dedup, "MERGE_BYTES", 500)
        monkeypatch.setattr(suffix_dedup, "SIFT_BYTES", 700)
        monkeypatch.setattr(suffix_dedup, "HOT_RUNS", 4)
    rows = mixed(150, 3)
    assert run(docs, rows) == brute(rows)


def test_a_passage_in_every_shard(docs, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SHARD_BYTES", 2000)
    monkeypatch.setattr(suffix_dedup, "MERGE_BYTES", 400)
    monkeypatch.setattr(suffix_dedup, "HOT_RUNS", 10)
    rng = random.Random(21)
    passage = "".join(rng.choices("abcdefgh ", k=260))
    own = lambda n: "".join(rng.choices("klmnopqrst ", k=n))
    rows = [(i, own(150) + passage[: rng.randrange(60, 261)] + own(90)) for i in range(120)]
    rows += [(500 + i, own(60) + passage[5:80] + own(60)) for i in range(60)]
    assert run(docs, rows) == brute(rows)


def test_nulls_short_long_and_ties(docs):
    a = "".join(random.Random(1).choices("abcdefgh ", k=5000))
    rows = [(5, None), (6, ""), (7, a), (8, a), (9, "x" * 99), (10, "x" * 100), (11, "x" * 250_000), (None, a[:300]), (12, a[100:199] + "!"), (13, a[100:200]), (14, "ÿ" * 300)]
    assert run(docs, rows) == brute(rows)
    assert run(docs, []) == []
    assert [r[2] for r in run(docs, [(1, a), (1, a), (2, a)])] in ([0, 5000, 5000], [5000, 0, 5000])


def test_small_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert sorted(map(tuple, dedup_strings(df).collect()), key=repr) == brute([(r.doc_id, r.text) for r in df.collect()])


def test_clashing_columns(spark):
    df = spark.createDataFrame([(1, "a", 2, 3, "x")], "doc_id long, text string, doc int, at int, route string")
    assert [tuple(r)[:4] for r in dedup_strings(df).collect()] == [(1, 1, 0, 0)]


def test_suffix_array_and_prefixes():
    rng = random.Random(2)
    t = Texts([bytes(rng.choices(b"ab", k=rng.randrange(1, 700))) for _ in range(20)] + [b"a" * 900, b"ab" * 500])
    order, tied = suffix_array(t)
    suffix = [t.data[i : i + 128].ljust(128, b"\xff") for i in order]
    assert sorted(order.tolist()) == list(range(t.n))
    inside = [s for i, s in zip(order, suffix, strict=True) if i + 128 <= t.n]
    assert inside == sorted(inside)
    shared = common_prefixes(t, order, tied)
    for k in range(1, t.n):
        a, b = t.data[order[k - 1] :], t.data[order[k] :]
        want = next((j for j in range(min(LENGTH, len(a), len(b))) if a[j] != b[j]), LENGTH)
        assert shared[k] == want


def test_merging_compares_every_byte():
    texts = [b"a" * 101, b"b" * 98 + b"\0\0", b"a" * 100, b"b" * 98 + b"\0\0", b"b" * 97 + b"\0\0\0"]
    row, a, b = merged(texts, np.array([4, 3, 2, 1, 5]), np.zeros(5, int), np.array([2, 1, 1, 1, 1]))
    assert sorted(zip(row.tolist(), a.tolist(), b.tolist())) == [(0, 0, 2), (1, 0, 1)]


def test_common_grams_cross_batches():
    def batch(*rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.int8()))], names=["route", "doc", "at", "kind"])

    out = [tuple(r.values()) for b in _known(iter([batch((1, 1, 0, 0), (2, 2, 0, 0)), batch((2, 3, 0, 0), (2, 4, 0, 0)), batch((2, 5, 0, 0)), batch((3, 6, 0, 1), (4, 7, 0, 0), (9, 9, 1, 2))])) for r in b.to_pylist()]
    assert set(out) == {(2, 0), (3, 0), (4, 0), (5, 0), (6, 0), (9, 1)}


def test_sql(against_duckdb):
    against_duckdb("op2_suffix_dedup", "/root/testdata/sf0.01")
