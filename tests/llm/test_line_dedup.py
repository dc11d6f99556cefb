import random

import pytest
from pyspark.sql import functions as F

from planweave.llm import line_dedup
from planweave.llm.line_dedup import dedup_lines


def brute(rows, least=8, longest=None):
    """Deletes the lines of every run, of any number of lines, with enough words that also starts earlier."""
    order = sorted({(i if i is not None else -(2**63), t) for i, t in rows if t is not None})
    lines = {(i, t): t.split("\n") for i, t in order}
    gone = {k: set() for k in lines}
    counts = {k: [len(x.split()) for x in v] for k, v in lines.items()}
    for size in range(1, longest + 1 if longest else max(map(len, lines.values()), default=0) + 1):
        seen = set()
        for k, v in lines.items():
            for at in range(len(v) - size + 1):
                run = tuple(v[at : at + size])
                if run in seen and sum(counts[k][at : at + size]) >= least:
                    gone[k] |= set(range(at, at + size))
                seen.add(run)
    out = []
    for i, t in rows:
        if t is None:
            out.append((i, None, 0, 0))
            continue
        k = (i if i is not None else -(2**63), t)
        out.append((i, "\n".join(x for n, x in enumerate(lines[k]) if n not in gone[k]), len(lines[k]), len(gone[k])))
    return sorted(out, key=repr)


def run(docs, rows, **options):
    return sorted(((r.doc_id, r.text, r.n_lines, r.n_removed) for r in dedup_lines(docs(rows), **options).collect()), key=repr)


def test_random_runs(docs):
    rng = random.Random(11)
    block = [f"line {i} " + "w " * (i % 5) for i in range(12)]
    rows = []
    for i in range(40):
        text = []
        for _ in range(rng.randrange(4)):
            a = rng.randrange(len(block))
            text += block[a : a + rng.randrange(1, 9)]
            if rng.random() < 0.5:
                text.append(f"own {rng.random()}")
        rows.append((i, "\n".join(text)))
    assert run(docs, rows) == brute(rows)


def test_nulls_empty_long_repeated(docs):
    long = "\n".join(f"this is the line of number {i} in it" for i in range(700))
    rows = [(1, None), (2, ""), (3, long), (4, long + "\nmore"), (4, long + "\nmore"), (None, "\n\n"), (5, "one\ntwo"), (6, "one\ntwo"), (7, "\n".join(["same words in each of these lines here"] * 5)), (8, "x " * 100_000), (9, "x " * 100_000)]
    assert run(docs, rows) == brute(rows)
    assert run(docs, []) == []
    assert run(docs, [(1, "a")]) == [(1, "a", 1, 0)]


def test_columns_stay(spark):
    df = spark.createDataFrame([(1, "a b c d e f g h", 5, 1, 2, 3), (2, "a b c d e f g h", 6, 1, 2, 3)], "doc_id long, text string, n_removed int, at int, runs int, `x.y` int")
    got = {r.doc_id: r for r in dedup_lines(df).collect()}
    assert set(dedup_lines(df).columns) == {"doc_id", "text", "at", "runs", "x.y", "n_lines", "n_removed", "longest_run"}
    assert (got[2].text, got[2].n_removed, got[2].at, got[2].longest_run) == ("", 1, 1, 1) and got[1].n_removed == 0


def test_runs_of_any_length(docs):
    shared = ["one two three", "four five six", "seven eight nine"]
    assert [r[3] for r in run(docs, [(1, "\n".join(shared)), (2, "\n".join(["own", *shared, "last"]))])] == [0, 3]
    blank = ["a b c d", "", "", "", "", "", "e f g h", "", "i"]
    rows = [(1, "\n".join(["w " * 20, "x y", "z v"])), (2, "\n".join(["first", "w " * 20, "x y", "z v"])), (3, "\n".join(blank)), (4, "\n".join([*blank[:-1], "j"])), (5, "\n".join(["q", *blank]))]
    assert run(docs, rows) == brute(rows)
    assert [r[3] for r in run(docs, rows)][:2] == [0, 3]


def test_random_short_lines(docs):
    rng = random.Random(4)
    rows = [(i, "\n".join(rng.choice(["", "a", "b", "a b", "c d e", "f"]) for _ in range(rng.randrange(1, 40)))) for i in range(25)]
    assert run(docs, rows) == brute(rows)
    assert run(docs, rows, least_words=3) == brute(rows, 3)


def test_sql(against_duckdb):
    against_duckdb("op7_line_dedup")


@pytest.mark.parametrize("weak", [0, 1])
def test_lines_whose_one_hash_collides_stay_apart(docs, monkeypatch, weak):
    """The other hash alone tells lines apart, so it doesn't depend on the colliding one."""
    keys = line_dedup.line_keys
    monkeypatch.setattr(line_dedup, "line_keys", lambda line: tuple(F.lit(7).cast("long") if i == weak else k for i, k in enumerate(keys(line))))
    rows = [(i, f"own line {i} of this text with many words in it\nshared line of this text with many words in it") for i in range(6)]
    assert run(docs, rows) == brute(rows)
    first, second = docs([(1, "some line")]).select(*keys("text")).first()
    assert second not in docs([(1, "some line")]).select(F.hash(F.lit(first)), F.xxhash64(F.lit(first)), F.xxhash64("text", F.lit(1))).first()
