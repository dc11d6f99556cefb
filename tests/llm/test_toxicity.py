import random

import numpy as np
import pytest

from planweave.llm import queries
from planweave.llm.toxicity import CLASSES, MIXED, Scorer, char_class, decode, forms, held_out, ln_model, parts, readings, score_toxicity, tokens, trigram_counts

CLEAN = "the river ran past old houses and green fields while people spoke of rain bread music letters travel and winter light".split()
TOXIC = ["grobnik", "snurfel", "idioten"]


@pytest.fixture(scope="module")
def model():
    text = " ".join(CLEAN * 3 + TOXIC * 3).encode()
    return ln_model(trigram_counts([text])).tolist()


@pytest.mark.parametrize(("raw", "plain"), [("gr0bn1k", "grobnik"), ("$nurf3l", "snurfel"), ("1d10t3n", "idioten"), ("snuuuurfel", "snurfel"), ("gr@bnik", "grabnik"), ("", ""), ("idi0ten", "idioten")])
def test_decoding(model, raw, plain):
    assert decode(raw, model) == plain


def test_what_looks_disguised():
    assert all(MIXED.search(w) for w in ("m0ron", "stuuupid", "@ss"))
    assert not any(MIXED.search(w) for w in ("moron", "2024", "well", "%%%", "été"))
    assert "i d i o t" in tokens("you I D I O T!") and "m-o-r-o-n" in tokens("a: m-o-r-o-n, b")
    assert tokens("a b") == {"a", "b"} and tokens("1 2 3 4") == {"1", "2", "3", "4"}


@pytest.mark.parametrize(("raw", "plain"), [("1 d 1 0 t 3 n", "idioten"), ("g r 0 b n i k", "grobnik"), ("gr.ob.nik", "grobnik"), ("gro bnik", "grobnik"), ("green fields", "green fields"), ("r1v3r_h0us3s", "river houses")])
def test_spaces_and_signs_are_edges_of_the_lattice(model, raw, plain):
    assert decode(raw, model) == plain


def test_decode_finds_the_best_of_all_readings(model):
    rng = random.Random(9)
    for _ in range(150):
        span = "".join(rng.choice("gr0bn1k3e @._oos$") for _ in range(rng.randrange(1, 8)))
        best = {}

        def walk(i, a, b, last, text, cost):
            if i == len(span):
                best[text] = max(best.get(text, -1e9), cost + model[a][b][0])
                return
            for x, channel in readings(span[i], last):
                if x:
                    k = char_class(x)
                    walk(i + 1, b, k, x, text + x, cost + channel + model[a][b][k])
                else:
                    walk(i + 1, a, b, last, text, cost + channel)

        walk(0, 0, 0, "", "", 0.0)
        assert best[decode(span, model)] >= max(best.values()) - 1e-9


def test_score_by_hand(model):
    rng = random.Random(10)
    weights = {p: rng.uniform(0.8, 4.0) for w in TOXIC for p in parts(w)}
    scorer = Scorer(weights, model, (-3.0, 1.5, 0.5, 0.25))
    disguises = ["gr0bnik", "s n u r f e l", "idi oten", "gro-bnik", "idiooooten", "snurfel."]
    for _ in range(60):
        chosen = [(rng.choice(TOXIC + CLEAN)) for _ in range(rng.randrange(0, 30))] + rng.sample(disguises, rng.randrange(3))
        rng.shuffle(chosen)
        plain = {"gr0bnik": "grobnik", "s n u r f e l": "snurfel", "idi oten": "idioten", "gro-bnik": "grobnik", "idiooooten": "idioten", "snurfel.": "snurfel"}
        by_token = {}
        for w in chosen:
            word = plain.get(w, w)
            by_token[word] = max((weights.get(p, 0.0) for p in parts(word)), default=0.0)
            for piece in {"idi oten": ["idi", "oten"], "gro-bnik": []}.get(w, []):
                by_token[piece] = max((weights.get(p, 0.0) for p in parts(piece)), default=0.0)
        found = sorted((x for x in by_token.values() if x > 0), reverse=True) + [0.0, 0.0]
        z = -3.0 + 1.5 * found[0] + 0.5 * found[1] + 0.25 * np.log1p(sum(x > 1.0 for x in found))
        assert abs(scorer.score(" ".join(chosen)) - 1 / (1 + np.exp(-z))) < 1e-9


def test_spaced_words_are_scored(model):
    scorer = Scorer({"grobnik$": 3.0, "idioten$": 3.0}, model)
    for text in ("x gro bnik y", "a gr0 bnik.", "id io ten", "g r 0 b n i k", "gr.ob.nik", "1 d 1 0 t 3 n"):
        assert scorer.evidence(text)[0] == 3.0
    for text in ("the river ran", "1 2 3 4", "a b", "well-known"):
        assert scorer.evidence(text)[0] == 0.0


def test_trigrams_do_not_depend_on_the_chunk():
    text = b"abc de" * 400_000
    c = trigram_counts([text])
    assert c.sum() == len(text) - 2 and len(c) == CLASSES**3


def corpus(n, disguised=False):
    rng = random.Random(7)
    docs, labels = [], []
    for i in range(n):
        words = [rng.choice(CLEAN) for _ in range(rng.randrange(5, 60))]
        toxic = int(rng.random() < 0.3)
        if toxic:
            for _ in range(rng.randrange(1, 4)):
                w = rng.choice(TOXIC)
                if disguised and held_out(i):
                    w = rng.choice([w.replace("o", "0").replace("i", "1").replace("e", "3"), w[:2] + w[2] * 4 + w[3:], " ".join(w)])
                words.insert(rng.randrange(len(words)), w)
        docs.append((i, " ".join(words)))
        labels.append((i, 0, toxic))
    return docs, labels


def test_disguised_words_are_found_in_held_out_rows(spark, docs):
    rows, labels = corpus(900, disguised=True)
    got = score_toxicity(docs(rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    truth = {i: t for i, _, t in labels}
    assert all(r.held_out == held_out(r.doc_id) for r in got)
    held = [r for r in got if r.held_out]
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) >= 0.97
    assert all((r.score >= 0.5) == (r.predicted == 1) and 0 <= r.score <= 1 for r in got)


def test_nulls_long_repeated_and_unlabelled(spark, docs):
    rows = [(1, None), (2, ""), (3, "grobnik " * 50_000), (3, "grobnik " * 50_000), (None, "x"), (4, "a" * 200_000), (5, "1a" * 100)]
    no_labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = score_toxicity(docs(rows), no_labels).collect()
    assert len(got) == 7 and all(r.predicted == 0 for r in got)
    assert score_toxicity(docs([]), no_labels).count() == 0
    more, labels = corpus(300)
    odd = [(None, 0, 1), (10_000, None, None), (5000, 0, 0), (5000, 0, 1)]
    got = score_toxicity(docs(rows + [(i + 10, t) for i, t in more]), spark.createDataFrame([(i + 10, q, t) for i, q, t in labels] + odd, "doc_id long, quality int, toxic int")).collect()
    assert [r.predicted for r in got if r.doc_id == 3] == [1, 1] and [r.predicted for r in got if r.doc_id in (1, 2)] == [0, 0]


def test_clashing_columns(spark):
    df = spark.createDataFrame([(1, "a", 1, 0.5, 1)], "doc_id long, text string, toxic int, score double, part int")
    labels = spark.createDataFrame([(1, 0, 1, "x")], "doc_id long, quality int, toxic int, text string")
    assert score_toxicity(df, labels).count() == 1


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.1"
    got = queries.QUERIES["op8_toxicity"](spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").filter("held_out").collect()
    assert np.mean([r.predicted == r.toxic for r in got]) > 0.95
    toxic, clean = [r.score for r in got if r.toxic], [r.score for r in got if not r.toxic]
    assert np.mean([t > c for t in toxic for c in clean]) > 0.95


def test_long_tokens_are_restored(model):
    long = "_".join(["r1v3r", "gr0bn1k", "h0us3s"] * 8)
    assert len(long) > 60 and {"river", "grobnik", "houses"} <= set(forms(long, model))
    assert "grobnik" in forms("-".join(["br3ad", "gr0bnik"]), model)
    assert "snurfel" in forms("sn" + "u" * 100 + "rfel", model)
    assert decode("1d10t3n" * 300, model)[:7] == "idioten"
