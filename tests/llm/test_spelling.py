import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from planweave.llm.spelling import near_in_tile, near_words, roots, spelling_variants

ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def near(a, b):
    """Plain edit distance of exactly one."""
    a, b = sorted((a, b), key=len)
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def counted(rows):
    n = Counter()
    for i, text in rows:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(ASCII)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: c for w, c in n.items() if len(w) >= 7 and c >= 2}


def expected(n):
    out, forms = [], {}
    for w in n:
        others = [o for o in n if near(w, o)]
        best = min(others, key=lambda o: (-n[o], o), default=None)
        forms[w] = best if best is not None and n[best] >= 10 * n[w] else None
        out.append((w, len(others)))
    rows = []
    for w, count in out:
        root = w
        while forms[root] is not None:
            root = forms[root]
        rows.append((w, forms[w], root, n[w], count, None if forms[w] is None else n[forms[w]]))
    return sorted(rows)


def got(df, **how):
    return sorted((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling_variants(df, **how).select("word", "form", "root", "n", "n_near", "form_n").collect())


def vocabulary(rng, count, alphabet="aé\xffbß"):
    base = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(7, 11))) for _ in range(count)]
    more = []
    for w in base:
        i = rng.randrange(len(w))
        more += [w[:i] + w[i + 1 :], w[:i] + rng.choice(alphabet) + w[i:], w[:i] + rng.choice(alphabet) + w[i + 1 :]]
    return base + more


@pytest.mark.parametrize("how", [{}, {"regions": 2, "tile_words": 4}, {"regions": 5, "tile_words": 3, "tile_cells": 64}])
def test_matches_brute_force(spark, how):
    rng = random.Random(4)
    words = vocabulary(rng, 60)
    weight = [rng.choice([1, 1, 2, 40, 900]) for _ in words]
    rows = [(i if i % 7 else None, ", ".join(rng.choices([w.upper() if rng.random() < 0.2 else w for w in words], weight, k=60)) + " kurz 12") for i in range(150)]
    rows += [(1, None), (2, ""), (3, "short"), (3, "Repeated row"), (3, "Repeated row")]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, word string, n int")
    assert got(df.repartition(3), **how) == expected(counted(rows))


def test_chain_of_forms_and_ties(spark):
    n = {"aaaaaaa": 1000, "aaaaaab": 100, "aaaaabb": 10, "aaaabbb": 1, "zzzzzzz": 50, "zzzzzzy": 50, "zzzzzz": 5, "zzzzzzyy": 5}
    found = {r.word: (r.n_near, r.form, r.form_n) for r in near_words(spark.createDataFrame(list(n.items()), "word string, n long")).collect()}
    assert found["zzzzzz"] == (2, "zzzzzzy", 50) and found["aaaabbb"] == (1, "aaaaabb", 10) and found["zzzzzzy"][0] == 3
    forms = spark.createDataFrame([("aaaabbb", "aaaaabb"), ("aaaaabb", "aaaaaab"), ("aaaaaab", "aaaaaaa")], "word string, form string")
    assert {(r.word, r.root) for r in roots(forms).collect()} == {(w, "aaaaaaa") for w in ("aaaabbb", "aaaaabb", "aaaaaab")}


def test_very_long_words_and_hot_bucket(spark):
    long = "x" * 30_000
    words = [long, long + "x", long[:-1] + "y", "y" + long[1:]] + [f"samestart{a}{b}samelast" for a in "abcdefgh" for b in "abcdefgh"]
    n = {w: 2 + i for i, w in enumerate(words)}
    df = spark.createDataFrame(list(n.items()), "word string, n long")
    for how in ({}, {"tile_words": 16, "tile_cells": 1 << 16}):
        found = {r.word: (r.n_near, r.form) for r in near_words(df, **how).collect()}
        want = {w: [o for o in n if near(w, o)] for w in n}
        assert found == {w: (len(o), min(o, key=lambda k: (-n[k], k))) for w, o in want.items() if o}


def test_a_tile_finds_each_single_edit_once():
    rng = random.Random(2)
    words = sorted(set(vocabulary(rng, 40, "ab")))
    size = np.array([len(w) for w in words])
    seen = Counter()
    for long in range(6, 13):
        for cut in range(0, long, 2):
            may = np.maximum(size[:, None], size[None, :]) == long
            np.fill_diagonal(may, False)
            ones = np.ones(len(words), np.int64)
            a, b = near_in_tile(words, may, ones * cut, ones * min(cut + 2, long), ones * long)
            seen.update((words[i], words[j]) for i, j in zip(a, b, strict=True))
    assert seen == Counter({(a, b): 1 for a in words for b in words if near(a, b)})


def test_empty(docs):
    assert spelling_variants(docs([])).count() == 0 and spelling_variants(docs([(1, None), (2, "few words")])).count() == 0


def test_sql(against_duckdb):
    against_duckdb("op13_spelling_variants", "/root/testdata/sf0.01")
