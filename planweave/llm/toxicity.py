"""Toxicity scores of texts restored by a noisy-channel decoder: leetspeak, spacing and repetition undone."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planweave.llm.common import arrow_rows, bounded_batches, text_bytes

#: Labelled documents that the classifier learns from.
SAMPLE = 24_000
#: Least weight of a word part that is remembered; a document can hold few words of such weight.
LEAST_WEIGHT = 0.7
#: Fewest labelled documents that a word part must stand in, and weight of the base rate against its own.
LEAST_DOCS = 4
PRIOR = 3.0
#: Word starts of these lengths are features, besides whole words.
STARTS = (4, 5, 6)
#: Words whose weight a worker remembers, and starts again beyond; texts that it gets at a time when it learns.
KNOWN_WORDS = 100_000
TEXTS = 1_000

#: Letters that a character can stand for. Fixed values.
LEET = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t"}
#: Natural logarithms of the channel's probabilities: a substituted character, one that repeats the last, and what
#: only holds letters apart.
SUBSTITUTED, DROPPED, HELD_APART = -1.0, -1.0, -1.0
#: The channel hardly ever keeps a digit or sign inside a word as it is.
KEPT_SIGN = -12.0

LETTER = "[^\\W\\d_]"
SIGN = "[0134578@$!|+9]"
#: A word mixes letters with what can stand for letters, repeats a letter three times, or holds letters apart.
MIXED = re.compile(rf"{LETTER}{SIGN}|{SIGN}{LETTER}|({LETTER})\1\1|[^\W_][.*_\-/~]+[^\W_]")
#: A token with a sign or digit that stands for a letter beside one.
DISGUISED = re.compile(rf"{LETTER}[@$!|+](?![^\w\s])|(?<![^\w\s])[@$!|+]{LETTER}|{LETTER}[0134578][a-z]|^[0134578]{LETTER}|{LETTER}[0134578]$")
#: A letter three times in a row.
TRIPLED = re.compile(rf"({LETTER})\1\1")
#: Signs around a token that are no part of a word.
AROUND = ".,;:?!\"'()"
#: A sign repeated at an end of a token stands for no letter.
JUNK = re.compile(r"^([^\w\s])\1+|([^\w\s])\2+$")
#: Letters of a path that are held as one string; the strings of a longer path are linked, so its cost is linear.
LINKED = 64

#: Classes of the language model: word break, a-z, any other letter.
CLASSES = 28
CLASS_OF = {c: i for i, c in enumerate("abcdefghijklmnopqrstuvwxyz", 1)}


def char_class(c: str) -> int:
    return CLASS_OF.get(c, 27 if c.isalpha() else 0)


_BYTE_CLASS = np.array([CLASS_OF.get(chr(b).lower(), 0) if b < 128 else 27 for b in range(256)], np.int64)


def trigram_counts(texts: Iterable[bytes]) -> np.ndarray:
    """How often three classes follow each other; the bytes of a letter beyond ASCII count as one or two letters."""
    counts = np.zeros(CLASSES**3, np.int64)
    for text in texts:
        for at in range(0, len(text), 1 << 20):
            c = _BYTE_CLASS[np.frombuffer(text[max(0, at - 2) : at + (1 << 20)], np.uint8)]
            if len(c) > 2:
                counts += np.bincount(c[:-2] * CLASSES**2 + c[1:-1] * CLASSES + c[2:], minlength=CLASSES**3)
    return counts


def ln_model(counts: np.ndarray) -> np.ndarray:
    """ln P(c | a, b), interpolated with P(c | b) and a constant."""
    three = counts.reshape(CLASSES, CLASSES, CLASSES).astype(float)
    two = three.sum(0)
    p3 = three / np.maximum(1, three.sum(2, keepdims=True))
    p2 = two / np.maximum(1, two.sum(1, keepdims=True))
    return np.log(0.7 * p3 + 0.29 * p2[None] + 0.01 / CLASSES)


def decode(span: str, model: list) -> str:
    """The likeliest text behind a span: the Viterbi path through the lattice of its characters.

    A state is the classes of the last two characters and the last one kept. Each character may stand for
    itself or a letter of LEET; a repeated letter or a sign between letters may be dropped; what stands between
    letters, a space or any other sign, may be dropped or end a word. A character has
    few readings, so the states are few and the cost grows in proportion to the span.
    """
    paths: dict[tuple[int, int, str], tuple[float, tuple | None, str]] = {(0, 0, ""): (0.0, None, "")}
    for c in span:
        after: dict[tuple[int, int, str], tuple[float, tuple | None, str]] = {}
        for (a, b, last), (cost, before, text) in paths.items():
            if len(text) >= LINKED:
                before, text = (before, text), ""
            for x, channel in readings(c, last):
                if x:
                    k = char_class(x)
                    state, value = (b, k, x), cost + channel + model[a][b][k]
                else:
                    state, value = (a, b, last), cost + channel
                if state not in after or value > after[state][0]:
                    after[state] = (value, before, text + x)
        paths = after
    _, before, text = max(paths.items(), key=lambda p: p[1][0] + model[p[0][0]][p[0][1]][0])[1]
    found = [text]
    while before is not None:
        before, text = before
        found.append(text)
    return "".join(reversed(found))


def readings(c: str, last: str) -> list[tuple[str, float]]:
    """What a character can stand for after the last one kept, with the channel's logarithm; "" is nothing."""
    letters = LEET.get(c, "")
    steps = [(x, SUBSTITUTED) for x in letters]
    if c.isalpha():
        steps.append((c, 0.0))
        if c == last:
            steps.append(("", DROPPED))
    elif letters:
        steps.append((c, KEPT_SIGN))
        if last and last in letters:
            steps.append(("", DROPPED))
    else:
        steps.append(("", HELD_APART))
        if last != " ":
            steps.append((" ", 0.0))
    return steps


WORDS = re.compile(r"[^\W_]+")


def forms(span: str, model: list) -> list[str]:
    """The words in a lower-case token, and if it looks disguised those of its restored form. A span with spaces
    gives its restored form alone, as its tokens speak for themselves."""
    core = JUNK.sub("", span.strip(AROUND))
    spaced = " " in core
    found = [] if spaced else WORDS.findall(span)
    if spaced or MIXED.search(core):
        found += WORDS.findall(decode(core, model))
    return found


class Memory(dict):
    """What a function gives for its latest arguments; it starts again when it is full."""

    def __init__(self, of) -> None:
        self.of = of

    def __missing__(self, key: str):
        if len(self) > KNOWN_WORDS:
            self.clear()
        value = self[key] = self.of(key)
        return value


DISGUISED_TOKENS = Memory(lambda w: DISGUISED.search(w) is not None)


def tokens(text: str, starts: frozenset[str] = frozenset(), whole: frozenset[str] = frozenset()) -> set[str]:
    """Different lower-case tokens of a text without the signs around them, and spans of several that may be one word: three single
    characters or more, disguised tokens with a neighbour, and tokens that together spell a word of ``whole``, whose beginnings
    are ``starts``."""
    listed = [w if len(w) == 1 else w.strip(AROUND) for w in text.lower().split()]
    found = set(listed)
    found.discard("")
    odd = {w for w in found if not w.isalpha() and DISGUISED_TOKENS[w]}
    spans = [listed[max(0, i - 1) : i + 2] for i, w in enumerate(listed) if w in odd] if odd else []
    spans = [pair for near in spans for pair in (near[:2], near[-2:]) if len(pair) == 2]
    single = [i for i, w in enumerate(listed) if len(w) == 1 and (w.isalpha() or w in LEET)]
    at = 0
    while at < len(single):
        n = 1
        while at + n < len(single) and single[at + n] == single[at] + n:
            n += 1
        if n > 2 and any(map(str.isalpha, run := listed[single[at] : single[at] + n])):
            spans.append(run)
        at += n
    for i in [i for i, w in enumerate(listed) if w in starts]:
        joined, j = listed[i], i + 1
        while joined in starts and j < len(listed):
            joined, j = joined + listed[j], j + 1
            if joined in whole:
                spans.append(listed[i:j])
    found.update(map(" ".join, spans))
    return found


def parts(word: str) -> list[str]:
    """Features of a word: the word and its starts."""
    return [word + "$", *(word[:n] for n in STARTS if len(word) >= n)]


@dataclass
class Scorer:
    """Weights of word parts, the calibration of a document's evidence, and the character model."""

    weights: dict[str, float]
    model: list
    calibration: tuple[float, float, float, float] = (-2.0, 1.0, 0.0, 0.0)
    known: dict[str, tuple[str, float] | None] = field(default_factory=dict)

    def __post_init__(self) -> None:
        # words that weigh enough to be looked for across spaces
        self.whole = frozenset(p[:-1] for p, w in self.weights.items() if w > 1.0 and p.endswith("$") and len(p) > max(STARTS))
        self.starts = frozenset(w[:n] for w in self.whole for n in range(2, len(w)))
        self.heads = frozenset(p.removesuffix("$")[: min(STARTS)] for p in self.weights)

    def weighed(self, span: str) -> tuple[str, float] | None:
        """The word of a token or span that weighs most, and its weight, if any weighs anything."""
        if (w := self.known.get(span, ())) == ():
            if len(self.known) > KNOWN_WORDS:
                self.known.clear()
            get = self.weights.get
            found = ((x, max(get(p, 0.0) for p in parts(x))) for x in forms(span, self.model))
            word, weight = max(found, key=lambda f: f[1], default=("", 0.0))
            w = self.known[span] = (word, weight) if weight > 0.0 else None
        return w

    def evidence(self, text: str) -> tuple[float, float, float]:
        """The two largest weights of different words, and the logarithm of how many words weigh over 1."""
        heads, n = self.heads, min(STARTS)
        spans = tokens(text, self.starts, self.whole)
        # a word of letters alone, none of them tripled, weighs nothing unless its first ones begin a part that does
        spans = [w for w in spans if w[:n] in heads or not w.isalpha() or len(w) > 2 and TRIPLED.search(w)]
        found = dict(filter(None, map(self.weighed, spans)))
        w = sorted(found.values(), reverse=True)
        return (w[0] if w else 0.0, w[1] if len(w) > 1 else 0.0, math.log1p(sum(x > 1.0 for x in w)))

    def score(self, text: str) -> float:
        b, *c = self.calibration
        z = b + sum(x * y for x, y in zip(c, self.evidence(text), strict=True))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def held_out(doc_id: int | None) -> bool:
    """Rows that labels are never learned from: CRC-32 of the id as text is divisible by 5."""
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> tuple[float, ...]:
    """Coefficients of a logistic regression with a constant, by Newton's method."""
    x = np.column_stack([np.ones(len(x)), x])
    beta = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        gradient = x.T @ (y - p) - ridge * beta
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + ridge * np.eye(len(beta)), gradient)
        beta = beta + step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(beta.tolist())


def character_model(docs: DataFrame, text_column: str) -> np.ndarray:
    """Character trigrams counted over every whole text; each task gives one row of CLASSES cubed numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(CLASSES**3, np.int64)
        for batch in batches:
            counts += trigram_counts(t.as_py() for t in batch.column(0))
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], names=["at", "n"])

    rows = docs.select(text_bytes(text_column)).mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n"))
    counts = np.zeros(CLASSES**3, np.int64)
    for r in rows.collect():  # at most CLASSES cubed rows
        counts[r["at"]] = r["n"]
    return ln_model(counts)


def _part_counts(model: list):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        toxic, all_ = Counter(), Counter()

        def flush() -> pa.RecordBatch:
            keys = list(all_)
            out = pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([toxic[k] for k in keys], pa.int64()), pa.array([all_[k] for k in keys], pa.int64())], names=["part", "toxic", "n"])
            toxic.clear()
            all_.clear()
            return out

        for batch in batches:
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = {p for word in tokens(text) for x in forms(word, model) for p in parts(x)}
                all_.update(found)
                if label:
                    toxic.update(found)
                if len(all_) > KNOWN_WORDS:
                    yield flush()
        if all_:
            yield flush()

    return run


def _evidence(scorer: Scorer):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [scorer.evidence(t) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(1), *(pa.array([f[i] for f in found], pa.float64()) for i in range(3))], names=["toxic", "x", "y", "z"])

    return run


def learn(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", sample: int = SAMPLE) -> Scorer:
    """A scorer from at most ``sample`` labelled documents that are not held out; the character model is counted
    over all documents. Two thirds of the sample weigh word parts, one third calibrates the score. Labels that
    are null, and ids whose labels differ, are left out. Without labels of both kinds every score is below 0.5.
    """
    model = character_model(docs, text_column)
    as_list = model.tolist()
    known = labels.select(F.col("doc_id").cast("long").alias("id"), F.col("toxic").cast("int").alias("toxic")).filter("id IS NOT NULL AND toxic IN (0, 1)")
    known = known.filter(F.crc32(F.col("id").cast("string").cast("binary")) % 5 != 0).groupBy("id").agg(F.max("toxic").alias("toxic"), F.min("toxic").alias("least")).filter("toxic = least").drop("least")
    chosen = known.orderBy(F.xxhash64("id"), "id").limit(sample).withColumn("part", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(3)))
    totals = {(bool(r["fit"]), r["toxic"]): r["n"] for r in chosen.groupBy((F.col("part") == 0).alias("fit"), "toxic").agg(F.count("*").alias("n")).collect()}
    texts = docs.select(F.col(id_column).cast("long").alias("id"), F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("text"))
    labelled = texts.join(F.broadcast(chosen), "id")  # at most ``sample`` pairs of numbers
    scorer = Scorer({}, as_list)
    toxic, clean = totals.get((False, 1), 0), totals.get((False, 0), 0)
    if not toxic or not clean:
        return scorer
    rate = toxic / (toxic + clean)
    counts = labelled.filter("part <> 0").select("text", "toxic").mapInArrow(_part_counts(as_list), "part string, toxic long, n long")
    counts = counts.groupBy("part").agg(F.sum("toxic").alias("toxic"), F.sum("n").alias("n")).filter(F.col("n") >= LEAST_DOCS)
    share = (F.col("toxic") + PRIOR * rate) / (F.col("n") + PRIOR)
    weight = F.ln(share / (1 - share)) - math.log(rate / (1 - rate))
    # every part of enough weight that LEAST_DOCS of the at most ``sample`` documents share
    lexicon = counts.select("part", weight.alias("weight")).filter(F.col("weight") > LEAST_WEIGHT).collect()
    scorer = Scorer({r["part"]: r["weight"] for r in lexicon}, as_list)
    fit = labelled.filter("part = 0").select("text", "toxic").mapInArrow(_evidence(scorer), "toxic int, x double, y double, z double").collect()
    if {r["toxic"] for r in fit} == {0, 1}:
        scorer.calibration = logistic(np.array([(r["x"], r["y"], r["z"]) for r in fit]), np.array([r["toxic"] for r in fit], float))
    return scorer


def _scores(scorer: Scorer):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            score = np.array([scorer.score(t) for t in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([held_out(i) for i in ids]), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return run


def score_toxicity(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", sample: int = SAMPLE) -> DataFrame:
    """One row per input row: doc_id, held_out, score (0 to 1), predicted (1 if score >= 0.5).

    Spans that look disguised (signs and digits among letters, letters repeated three times, letters or pieces of a word held
    apart by spaces or signs)
    are decoded over a lattice of what each character can stand for, under a character model of the corpus; the
    text's words and the restored ones are then weighed. A null text is empty and scored like one; a null id is
    held out or not by the text "None"; repeated rows are rows like others; an empty table gives no rows; other
    columns are ignored. Labels are read from ``labels`` (doc_id, toxic) alone.
    """
    bounded_batches(docs.sparkSession)
    with arrow_rows(docs.sparkSession, TEXTS):
        scorer = learn(docs, labels, id_column, text_column, sample)
    texts = docs.select(F.col(id_column).cast("long").alias("id"), F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("text"))
    return texts.mapInArrow(_scores(scorer), "doc_id long, held_out boolean, score double, predicted int")


def without_toxic(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows whose text scores below ``threshold``, with their columns; the text never leaves its partition."""
    bounded_batches(docs.sparkSession)
    with arrow_rows(docs.sparkSession, TEXTS):
        scorer = learn(docs, labels, id_column, text_column)

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        return pa.array([scorer.score(t) for t in texts.to_pylist()], pa.float64())

    return docs.filter(score(F.coalesce(F.col(text_column).cast("string"), F.lit(""))) < threshold)
