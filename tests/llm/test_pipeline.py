import random
import re
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from planweave.llm.mixing import mix_sources, mixed_texts
from planweave.llm.simhash import near_duplicates
from tests.llm.test_line_dedup import brute as brute_lines
from tests.llm.test_packing import PATH
from tests.llm.test_packing import check as check_packing

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark):
    """Every stage's input and output over a whole table, each judged on its own input."""
    docs, out = spark.read.parquet(f"{FOLDER}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, docs, FOLDER).cache()
        out[name] = ([r.asDict() for r in docs.collect()], [r.asDict() for r in got.collect()])
        docs = got
    return out


def test_stages_keep_the_columns(stages):
    for name in list(stages)[:-1]:
        assert set(stages[name][1][0]) == {"doc_id", "text", "lang", "source", "n_chars"}
        assert stages[name][1]


def test_toxicity_rejects_few_clean_documents(spark, stages):
    before, after = stages["toxicity"]
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    gone = {r["doc_id"] for r in before} - {r["doc_id"] for r in after}
    assert gone and sum(labels.get(i) == 0 for i in gone) <= 0.1 * len(gone) + 1


def test_lines(stages):
    before, after = stages["line_dedup"]
    want = {i: t for i, t, n, gone in brute_lines([(r["doc_id"], r["text"]) for r in before]) if not gone or gone < n}
    assert {r["doc_id"]: r["text"] for r in after} == want


def shingles(text):
    words = (text or "").encode().lower().split()
    return {b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def test_near_copies(stages):
    before, after = stages["simhash_dedup"]
    sets = {r["doc_id"]: shingles(r["text"]) for r in before}
    kept = {r["doc_id"] for r in after}
    for i in set(sets) - kept:  # a document only goes for one like it, or through a chain of such
        assert any(len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) for j in sets if j != i)
    assert {r["doc_id"]: r["text"] for r in after}.items() <= {r["doc_id"]: r["text"] for r in before}.items()


def test_mix(spark, stages):
    before, after = stages["mixing"]
    taken = {r.doc_id: r.taken for r in mix_sources(spark.createDataFrame(before)).collect()}
    texts = {r["doc_id"]: r["text"] for r in before}
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t or "")
    got = {}
    for r in after:
        got.setdefault(r["doc_id"], []).append(r["text"])
    for i, copies in got.items():
        assert sum(len(words(t)) for t in copies) == taken[i]
        parted = [t for t in copies if t != texts[i]]
        assert len(parted) <= 1 and all(Counter(words(t)) <= Counter(words(texts[i])) for t in parted)
    assert {i for i, n in taken.items() if n} == set(got)


def test_packing(stages):
    before, after = stages["packing"]
    used, least = check_packing([type("R", (), r) for r in after], [(r["doc_id"], r["text"]) for r in before], 4096)
    assert used <= least + 2 and PATH


def test_run_gives_the_last_stage(spark):
    assert set(corpus_pipeline.run(spark, "/root/testdata/sf0.001").columns) == {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"}


def test_intermediate_tables_are_deleted(spark):
    from pathlib import Path

    from planweave.llm.common import cleared, shared_folder, written

    tables = lambda: set(Path(shared_folder(spark).removeprefix("file://")).glob("table-*"))
    before = tables()
    with cleared(spark):
        mine = written(spark.range(3))
        kept = written(mine.filter("id > 0"), keep=True)
        assert len(tables() - before) == 2
    assert len(tables() - before) == 1 and kept.count() == 2


def test_clashing_columns_in_stages(spark):
    df = spark.createDataFrame([(1, "a b c d e f", "en", "x", 11, 7, 8, 9, "t"), (2, "a b c d e f", "en", "x", 11, 7, 8, 9, "u")], "doc_id long, text string, lang string, source string, n_chars long, __row int, __mix int, taken int, drawn string")
    assert [r.doc_id for r in corpus_pipeline.simhash_dedup(spark, df, "").collect()] == [1]
    got = mixed_texts(df)
    assert set(got.columns) == set(df.columns) and got.count() >= 2 and {r.drawn for r in got.collect()} == {"t", "u"}


def test_near_duplicates_by_brute_force(docs):
    rng = random.Random(8)
    rows, base = [], [[f"w{rng.randrange(5000)}" for _ in range(200)] for _ in range(25)]
    for i in range(150):
        words = list(rng.choice(base))
        for _ in range(rng.randrange(3)):
            words[rng.randrange(len(words))] = f"e{rng.random()}"
        rows.append((i, " ".join(words)))
    rows += [(1000, None), (1001, ""), (1002, "one two three four five six"), (1003, "seven eight nine ten one two"), (None, "x")]
    got = {r.id: r.keep for r in near_duplicates(docs(rows)).collect()}
    root = {i: i for i, _ in rows if i is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    sets = {i: shingles(t) for i, t in rows if i is not None}
    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                r, s = find(a), find(b)
                root[max(r, s)] = min(r, s)
    want = {i: find(i) for i in root if find(i) != i}
    assert all(find(i) == find(keep) and keep < i for i, keep in got.items())
    assert len(got) >= 0.9 * len(want)
    assert near_duplicates(docs([])).count() == 0


def test_drawn_blocks_are_disjoint_parts_of_the_text(docs):
    rng = random.Random(3)
    rows = [(i, " ".join(f"{i}.{k}" for k in range(rng.randrange(1, 1500))), "en", rng.choice("abc"), 1) for i in range(60)]
    taken = {r.doc_id: (r.taken, r["size"]) for r in mix_sources(docs(rows)).collect()}
    got, partial = {}, 0
    for r in mixed_texts(docs(rows)).collect():
        got.setdefault(r.doc_id, []).append([int(w.split(".")[1]) for w in r.text.split()])
    for i, copies in got.items():
        assert sum(map(len, copies)) == taken[i][0]
        for at in copies:
            assert at == sorted(set(at))  # words in their order, none twice
            partial += len(at) < taken[i][1]
    assert partial > 5 and {i for i, (n, _) in taken.items() if n} == set(got)


def test_partial_copies_keep_what_stands_between(docs):
    got = mixed_texts(docs([(1, " a\tb\n\nc d", "en", "x", 1)])).collect()
    assert sorted(r.text for r in got) == [" a\tb", " a\tb\n\nc d"]


def test_near_duplicates_lose_nothing_in_a_dense_group(docs, monkeypatch):
    from planweave.llm import simhash

    monkeypatch.setattr(simhash, "BLOCK", 256)
    rng = random.Random(5)
    base, rows = [f"w{i}" for i in range(60)], []
    for i in range(2500):
        words = list(base)
        for _ in range(rng.choice((1, 1, 2, 3, 4))):
            words[rng.randrange(60)] = f"e{rng.randrange(40)}"
        rows.append((i, " ".join(words)))
    sets = [shingles(t) for _, t in rows]
    prints = np.array([simhash.fingerprint_pair(t.encode(), 5) for _, t in rows], np.uint64)
    root = np.arange(len(rows))
    for a in range(len(rows)):
        bits = np.bitwise_count(prints ^ prints[a])
        close = ((bits <= 8).any(axis=1) | (bits.sum(axis=1) <= simhash.WIDE)) & (root != root[a])
        for b in np.flatnonzero(close).tolist():
            if root[a] != root[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                low, high = sorted((root[a], root[b]))
                root[root == high] = low
    want = {i: int(root[i]) for i in range(len(rows)) if root[i] != i}
    assert len(want) > 1000
    assert {r.id: r.keep for r in near_duplicates(docs(rows)).collect()} == want


def near_pairs(rng, band, number, words=120):
    """Pairs of texts whose similarity lies in the band; the pairs have nothing in common with each other."""
    out = []
    while len(out) < number:
        a = [f"v{rng.getrandbits(40)}" for _ in range(words)]
        b = list(a)
        for _ in range(rng.randrange(1, 7)):
            b[rng.randrange(words)] = f"e{rng.getrandbits(40)}"
        x, y = shingles(" ".join(a)), shingles(" ".join(b))
        if band[0] <= len(x & y) / len(x | y) < band[1]:
            out.append((" ".join(a), " ".join(b)))
    return out


BANDS = [(0.8, 0.85), (0.85, 0.9), (0.9, 0.95)]


def test_recall_by_band(docs):
    rng = random.Random(12)
    pairs = [p for band in BANDS for p in near_pairs(rng, band, 300)]
    rows = [(2 * i + k, t) for i, p in enumerate(pairs) for k, t in enumerate(p)]
    got = {r.id: r.keep for r in near_duplicates(docs(rows)).collect()}
    assert all(i == keep + 1 and i % 2 for i, keep in got.items())
    for k in range(3):
        share = sum(2 * i + 1 in got for i in range(300 * k, 300 * k + 300)) / 300
        print("recall", BANDS[k], share)
        assert share >= 0.9


@pytest.mark.parametrize("n", [10**6, 15 * 10**6, 10**9])
def test_recall_of_the_plan_for_many_texts(n):
    """Which pairs the probes of a plan for ``n`` texts would bring together and find close."""
    from planweave.llm import simhash

    rng = random.Random(n)
    for band in BANDS:
        prints = [[simhash.fingerprint_pair(t.encode(), 5) for t in p] for p in near_pairs(rng, band, 400)]
        plans = [simhash.pigeonhole_plan(np.array([np.uint64(f[k]) for p in prints for f in p]).view(np.int64), n, 8) for k in range(2)]
        met = 0
        for a, b in prints:
            bits = [(x ^ y).bit_count() for x, y in zip(a, b)]
            probed = [any(sum((x ^ y) >> (63 - bit) & 1 for bit in group) <= t for group, t in plan) for x, y, plan in zip(a, b, plans)]
            met += any(p and (d <= 8 or sum(bits) <= simhash.WIDE) for p, d in zip(probed, bits))
        print("recall", n, band, met / len(prints), [(len(g), t) for g, t in plans[0]])
        assert met >= 0.9 * len(prints)


def test_dense_group_of_mixed_similarity(docs):
    rng = random.Random(400)
    base, rows = [f"w{i}" for i in range(120)], []
    for i in range(400):
        words = list(base)
        for at in rng.sample(range(120), rng.choice((2, 3, 3))):
            words[at] = f"e{rng.getrandbits(40)}"
        rows.append((i, " ".join(words)))
    sets = [shingles(t) for _, t in rows]
    root = list(range(400))
    for a in range(400):
        for b in range(a):
            if root[a] != root[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                low, high = sorted((root[a], root[b]))
                root = [low if r == high else r for r in root]
    want = {i for i in range(400) if root[i] != i}
    got = {r.id for r in near_duplicates(docs(rows)).collect()}
    print("dense group", len(got), len(want))
    assert got <= want or len(got) <= len(want)
    assert len(got) >= 0.9 * len(want)


def test_null_and_repeated_ids_go_as_rows(spark, docs):
    copy, other = " ".join(f"c{i}" for i in range(40)), " ".join(f"o{i}" for i in range(40))
    near = copy.replace("c39", "d")
    rows = [(1, copy), (1, copy), (1, other), (None, copy), (None, near), (None, "null id alone"), (2, near), (3, "a b c")]
    rows = [(i, t, "en", "x", len(t)) for i, t in rows]
    got = corpus_pipeline.simhash_dedup(spark, docs(rows), "").collect()
    assert sorted(((r.doc_id, r.text) for r in got), key=repr) == sorted([(1, copy), (1, other), (None, "null id alone"), (3, "a b c")], key=repr)


def test_mix_of_null_and_repeated_ids(docs):
    rows = [(None, "a b c"), (None, "d e f g"), (7, "h i"), (7, "j k"), (7, "h i"), (8, "l m n o p")]
    rows = [(i, t, "en", "x", len(t)) for i, t in rows]
    taken = sorted(((r.doc_id, r.taken) for r in mix_sources(docs(rows)).collect()), key=repr)
    got = mixed_texts(docs(rows)).collect()
    assert sum(len(r.text.split()) for r in got) == sum(n for _, n in taken)
    for i in (None, 7, 8):
        assert sum(len(r.text.split()) for r in got if r.doc_id == i) == sum(n for j, n in taken if j == i)
    assert {r.text for r in got} >= {t for _, t, *_ in rows}
