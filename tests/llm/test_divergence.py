import re
from collections import Counter

import numpy as np
import pytest

from planweave.llm.divergence import _priced, source_divergence

ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def expected(rows, least, ranks=50):
    docs = [((lang or ""), (source or ""), re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(ASCII))) for _, text, lang, source in rows]
    out = []
    for lang in {d[0] for d in docs}:
        df = Counter(t for name, _, words in docs if name == lang for t in set(words))
        kept = {t for t, n in df.items() if n >= least}
        counts = {}
        for name, source, words in docs:
            if name == lang:
                counts.setdefault(source, Counter()).update(w for w in words if w in kept)
        both = sum(counts.values(), Counter())
        share = lambda c, t: 1 + 10**9 * (c[t] + 5) // (sum(c.values()) + 5 * len(kept))  # noqa: B023, E731
        for source, c in counts.items():
            pairs = sorted((-sum(abs(share(c, t) - share(o, t)) for t in kept), other) for other, o in counts.items() if other != source)
            terms = sorted((share(both, t) - share(c, t), t.encode()) for t in kept if c[t] > 0 and share(c, t) > share(both, t))
            out += [(lang, source, "pair", other, -v, k) for k, (v, other) in enumerate(pairs, 1)]
            out += [(lang, source, "term", t.decode(), -v, k) for k, (v, t) in enumerate(terms[:ranks], 1)]
    return sorted(out)


def rows(count=120, seed=1):
    rng = np.random.default_rng(seed)
    words = ["the", "The", "Ünit", "ünit", "naïve", "a1b", "日本", "\U0001f600x", "end", "K", "mid", "rare"]
    weights = 1.0 / np.arange(1, 13)
    out = []
    for i in range(count):
        text = " ".join(rng.choice(words, rng.integers(0, 30), p=weights / weights.sum()).tolist())
        out.append((i, text, ["en", "de", None][i % 3], f"s{rng.integers(0, 7)}" if i % 11 else None))
    return [*out, (1, None, "en", "only nulls"), (1, None, "en", "only nulls"), (2, "word", "xx", "lone"), (3, "word", "yy", "p"), (4, "other", "yy", "q")]


def got(df, **how):
    return sorted((r.lang, r.source, r.part, r["item"], r.value, r.rank) for r in source_divergence(df, **how).collect())


@pytest.mark.parametrize("how", [{}, {"block_terms": 2, "block_groups": 2, "columns": 3}])
def test_matches_brute_force(docs, how):
    data = rows()
    assert got(docs(data), least_documents=10, term_ranks=3, **how) == expected(data, 10, 3)


def test_long_text_repeated_rows_and_hot_group(docs):
    data = [(7, "Alpha beta " * 40_000, "en", "hot")] * 3 + [(i, "alpha gamma", "en", "hot") for i in range(60)] + [(i, "beta gamma gamma", "en", f"s{i % 3}") for i in range(40)]
    assert got(docs(data).repartition(3)) == expected(data, 30)


def test_clashing_columns_and_order_of_ties(spark):
    data = [("x y", "en", s, 1, "t") for s in ("b", "a", "é", "c")] * 30
    df = spark.createDataFrame(data, "text string, lang string, source string, n int, term string")
    found = [r for r in got(df) if r[2] == "pair" and r[1] == "b"]
    assert [(r[3], r[4]) for r in found] == [("a", 0), ("c", 0), ("é", 0)]


def test_empty(docs):
    assert source_divergence(docs([])).count() == 0


def test_a_block_equals_direct_sums():
    rng = np.random.default_rng(3)
    group, term = (a.ravel() for a in np.meshgrid(np.arange(5), np.arange(40)))
    level = rng.integers(0, 6, group.size)
    some = level > 0
    price = level * 10 + group
    zero = {g: g for g in range(5)}
    p = price.reshape(40, 5)
    for left, right in (([0, 1, 2, 3, 4], [0, 1, 2, 3, 4]), ([0, 1], [2, 3, 4])):
        found = _priced(group[some], level[some], price[some], term[some], 40, zero, left, right, columns=7)
        assert found == {(a, b): int(abs(p[:, a] - p[:, b]).sum()) for a in left for b in right if a < b}


def test_sql(against_duckdb):
    against_duckdb("op11_source_divergence", "/root/testdata/sf0.01")
