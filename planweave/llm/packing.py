"""Best-fit packing of token sequences: combinations that fill a sequence exactly come first, by hashed complements."""

from __future__ import annotations

import bisect
import functools
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from planweave.llm.common import arrow_rows, bounded_batches, written

CONTEXT = 4096
END_ID = 1
#: Words whose ids a worker remembers in each of two generations, and their length at most; words that come again live on in the next.
KNOWN_WORDS, KNOWN_LENGTH = 100_000, 64
#: The word that holds words apart, and how many stand in a run.
APART = "\x01"
RUN_WORDS = 1_000
#: Texts on which word by word and as a whole must give the same ids.
PROBES = (
    " The  quick,brown fox's 12.5 JUMPS.\n\nOver (the) lazy-dog, and. \tNaïve Ünïcode\u00a0text \u4e2d\u6587 e.g. x\ny ",
    "FIN!! (Über) ÀÑ%%% rock'n'roll' it's' Don'T. ### a_ 3rd?! x) \"Quoted.\" Straße; x' s'",
)
#: Texts that a worker holds at a time.
TEXTS = 512
#: Signs that part from the letters before them where a word ends.
ENDS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: Pieces of one length that one task ranks; a length with more is dealt out.
RANK_ROWS = 100_000


def lowered(text: str, added: list[str]) -> str:
    """The text in lower case where that changes no tokens of a tokenizer that lower-cases; beyond Latin-1 composing letters may come
    first, and tokens that were ``added`` are found before."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return text
    low = text.lower()
    return text if any(token in low for token in added) else low


class WordIds:
    """Little-endian 32-bit ids of texts, word by word.

    Where the tokenizer parts texts at white space and keeps nothing across it, a text's ids are those of its
    words joined, and only words not seen before go through the tokenizer. A word here is what stands between
    spaces and line feeds; other white space inside it is left to the tokenizer. Signs that end a word of letters
    are a word of their own. Arrow finds the different words of the texts and puts their ids together. That is tried on PROBES first; a
    tokenizer that answers otherwise gets whole texts.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        apart = self.tokenizer.encode(APART, add_special_tokens=False).ids
        self.added = [token.content for token in self.tokenizer.get_added_tokens_decoder().values()]
        self.by_word = len(apart) == 1 and not any(" " in t or "\n" in t or (t[0].isalpha() and t[-1] in ENDS) for t in self.added)
        if self.by_word:
            self.apart = apart[0]
            self.by_word = self._of_words(list(PROBES)) == self._of_texts(list(PROBES))

    def __call__(self, texts: list[str]) -> list[bytes]:
        return self._of_words(texts) if self.by_word else self._of_texts(texts)

    def _of_texts(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _of_words(self, texts: list[str]) -> list[bytes]:
        parts = pc.split_pattern(pc.replace_substring(pa.array([lowered(t, self.added) for t in texts], pa.large_string()), "\n", " "), " ")
        words = parts.flatten().dictionary_encode()
        bases = pc.utf8_rtrim(words.dictionary, ENDS)
        bases = pc.if_else(pc.match_substring_regex(bases, r"^\pL+$"), bases, words.dictionary)
        bases, whole = (strings.to_numpy(zero_copy_only=False).tolist() for strings in (bases, words.dictionary))  # to_pylist is slow
        ends = [word[len(base) :] for word, base in zip(whole, bases, strict=True)]
        ids = self._of_different({*bases, *ends})
        each = pa.array([ids[base] + ids[end] for base, end in zip(bases, ends, strict=True)], pa.large_binary())
        return pc.binary_join(pa.ListArray.from_arrays(parts.offsets, each.take(words.indices)), pa.scalar(b"", pa.large_binary())).to_pylist()

    def _of_different(self, words: set[str]) -> dict[str, bytes]:
        """The ids of each word, remembered ones first."""
        known, older = self.known, self.older
        out, new = {}, []
        for word in words:
            if (ids := known.get(word)) is None:
                if (ids := older.get(word)) is None:
                    new.append(word)
                    continue
                known[word] = ids
            out[word] = ids
        # words of letters hold apart without spaces, which the tokenizer takes longer for
        plain = [w for w in new if w.isalpha()]
        for some, apart in ((plain, APART), ([w for w in new if not w.isalpha()], f" {APART} ")):
            for i in range(0, len(some), RUN_WORDS):
                run = some[i : i + RUN_WORDS]
                for word, ids in zip(run, self._of_run(run, apart), strict=True):
                    out[word] = ids
                    if len(word) <= KNOWN_LENGTH:
                        known[word] = ids
        if len(known) > KNOWN_WORDS:
            self.known, self.older = {}, known
        return out

    def _of_run(self, run: list[str], apart: str) -> list[bytes]:
        """Tokenizes words in a run held apart by a word of one id, which is much faster than one by one."""
        ids = np.array(self.tokenizer.encode_batch_fast([apart.join(run)], add_special_tokens=False)[0].ids, "<u4")
        cuts = np.flatnonzero(ids == self.apart)
        if len(cuts) != len(run) - 1:  # a word holds that id itself
            return self._of_texts(run)
        data, starts, ends = ids.tobytes(), [0, *(4 * (cuts + 1)).tolist()], [*(4 * cuts).tolist(), 4 * len(ids)]
        return [data[i:j] for i, j in zip(starts, ends, strict=True)]


@functools.cache
def word_ids(path: str) -> WordIds:
    """One per worker: what a task has learned serves the worker's next tasks."""
    return WordIds(path)


def _pieces(path: str, context: int):
    """Per text its pieces: start, length and CRC-32 of the ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = word_ids(path)
        end = np.array([END_ID], "<u4").tobytes()
        for batch in batches:
            for at in range(0, len(batch), TEXTS):
                some = batch.slice(at, TEXTS)
                rows: list[tuple[int | None, int, int, int, int]] = []
                for one, ids in zip(some.column(0).to_pylist(), ids_of(some.column(1).to_pylist()), strict=True):
                    ids += end
                    for k, i in enumerate(range(0, len(ids), 4 * context)):
                        piece = ids[i : i + 4 * context]
                        rows.append((one, k, i // 4, len(piece) // 4, zlib.crc32(piece)))
                columns = list(zip(*rows, strict=True))
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


class SumIndex:
    """What lengths add up to a sum: single lengths, pairs by their larger part, triples by their largest part.

    Built once from the lengths that occur; ``left`` says how many of each are still available.
    """

    def __init__(self, left: np.ndarray) -> None:
        self.left, n = left, len(left)
        lengths, present = np.flatnonzero(left)[::-1], left > 0
        small = lengths.astype(np.uint16)
        self.pairs, least = [small[:0]], np.full(n, n)
        for total in range(1, n):
            here = (lengths < total) & (2 * lengths >= total)
            here[here] = present[total - lengths[here]]
            self.pairs.append(small[here])
            if here.any():
                least[total] = lengths[here][-1]  # the smallest larger part of a pair
        self.triples = [small[:0]]
        for total in range(1, n):
            here = (lengths < total) & (3 * lengths >= total)
            here[here] = least[total - lengths[here]] <= lengths[here]
            self.triples.append(small[here])

    def of_two(self, total: int, largest: int) -> list[tuple[int, int]]:
        a = self.pairs[total].astype(np.int64)
        a = a[(a <= largest) & (self.left[a] > 0) & (self.left[total - a] > 0)]
        return [(x, total - x) for x in a.tolist()]

    def of_three(self, total: int) -> Iterator[tuple[int, int, int]]:
        for a in self.triples[total].tolist():
            if self.left[a]:
                yield from ((a, b, c) for b, c in self.of_two(total - a, a))


def pack_lengths(counts: dict[int, int], context: int = CONTEXT) -> list[tuple[tuple[int, ...], int]]:
    """Sequences as (lengths, how many such sequences), from how many pieces there are of each length.

    From the longest length down, the gap it leaves is looked up in the index of single lengths, sums of two and
    sums of three; a combination that fills the gap exactly is taken as often as
    its lengths are still available. What stays is packed by best fit: from the longest down, into the open sequences with
    the smallest gap that holds it. At most ``context`` different lengths exist, whatever the input's size.
    """
    left = np.zeros(context + 1, np.int64)
    for n, c in counts.items():
        left[n] = c
    out: list[tuple[tuple[int, ...], int]] = []

    def take(*lengths: int) -> None:
        k = min(int(left[n]) // lengths.count(n) for n in set(lengths))
        if k:
            for n in lengths:
                left[n] -= k
            out.append((lengths, k))

    index = SumIndex(left)
    for longest in np.flatnonzero(left)[::-1].tolist():
        gap = context - longest
        if not gap:
            take(longest)
            continue
        take(longest, gap)
        for a, b in index.of_two(gap, gap):
            take(longest, a, b)
        if left[longest]:
            for three in index.of_three(gap):
                take(longest, *three)
                if not left[longest]:
                    break
    # residuals: open sequences by gap, each kind with its number
    open_: dict[int, dict[tuple[int, ...], int]] = {}
    gaps: list[int] = []

    def put(lengths: tuple[int, ...], k: int) -> None:
        gap = context - sum(lengths)
        if gap not in open_:
            open_[gap] = {}
            bisect.insort(gaps, gap)
        open_[gap][lengths] = open_[gap].get(lengths, 0) + k

    for n in np.flatnonzero(left)[::-1].tolist():
        need = int(left[n])
        while need:
            i = bisect.bisect_left(gaps, n)
            if i == len(gaps):
                each = context // n
                if need >= each:
                    put((n,) * each, need // each)
                    need %= each
                if need:
                    put((n,) * need, 1)
                break
            gap = gaps[i]
            kinds = open_[gap]
            lengths, k = next(iter(kinds.items()))
            used = min(k, need)
            if used == k:
                del kinds[lengths]
                if not kinds:
                    del open_[gap]
                    gaps.pop(i)
            else:
                kinds[lengths] = k - used
            put((*lengths, n), used)
            need -= used
    return out + [(lengths, k) for kinds in open_.values() for lengths, k in kinds.items()]


def slots(plan: Iterable[tuple[tuple[int, ...], int]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per length, where its pieces go by rank: first ranks of runs, the sequence of each run's first rank, offset."""
    runs: dict[int, list[tuple[int, int, int]]] = {}
    ranks: dict[int, int] = {}
    sequence = 0
    for lengths, k in plan:
        offset = 0
        for n in lengths:
            runs.setdefault(n, []).append((ranks.get(n, 0), sequence, offset))
            ranks[n] = ranks.get(n, 0) + k
            offset += n
        sequence += k
    return {n: tuple(np.array(c, np.int64) for c in zip(*r, strict=True)) for n, r in runs.items()}


def _placed(where: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = np.asarray(batch["length"]), np.asarray(batch["rank"])
            sequence, offset = np.empty(len(batch), np.int64), np.empty(len(batch), np.int64)
            for n in np.unique(length).tolist():
                here = np.flatnonzero(length == n)
                first, start, at = where[n]
                i = np.searchsorted(first, rank[here], side="right") - 1
                sequence[here] = start[i] + rank[here] - first[i]
                offset[here] = at[i]
            kept = [batch[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sequence), pa.array(offset)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return run


def best_fit_packing(docs: DataFrame, tokenizer: str, id_column: str = "doc_id", text_column: str = "text", context: int = CONTEXT) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its text's ids by the tokenizer file (null: no ids) and an end id; longer ones are cut into
    pieces of ``context`` ids, the last may be shorter. Pieces are packed into sequences of at most ``context``
    ids, offsets gapless from 0. Only the number of pieces per length (at most ``context`` numbers) reaches the
    driver, which packs lengths, not pieces; pieces then find their places by their rank in their length.
    Ranks are counted per length and shard, so no length is ordered in one task. Null ids and repeated rows are
    documents like others; an empty table gives no rows; other columns are ignored.
    """
    bounded_batches(docs.sparkSession)
    texts = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("text"))
    pieces = texts.mapInArrow(_pieces(tokenizer, context), "doc_id long, piece int, start long, length long, ids_crc32 long")
    with arrow_rows(docs.sparkSession, TEXTS):
        pieces = written(pieces)
    # ranks: within (length, shard) in the shard's order, after the counts of the shards before
    totals = dict(map(tuple, pieces.groupBy("length").agg(F.count("*")).collect()))  # at most ``context`` rows
    spread = docs.sparkSession.createDataFrame([(n, -(-c // RANK_ROWS)) for n, c in totals.items()], "length long, shards long")
    dealt = pieces.join(F.broadcast(spread), "length").withColumn("shard", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), "shards"))
    counts = dealt.groupBy("length", "shard").agg(F.count("*").alias("n"))
    before = counts.select("length", "shard", (F.sum("n").over(Window.partitionBy("length").orderBy("shard")) - F.col("n")).alias("before"))
    local = F.row_number().over(Window.partitionBy("length", "shard").orderBy("doc_id", "piece", "start", "ids_crc32")) - 1
    ranked = dealt.withColumn("local", local).join(before, ["length", "shard"]).withColumn("rank", F.col("local") + F.col("before"))
    where = slots(pack_lengths(totals, context))
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", "rank"]
    return ranked.select(*columns).mapInArrow(_placed(where), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
