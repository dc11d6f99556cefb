"""Deduplication of repeated byte strings by suffix arrays per shard, merged across shards by binary search."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planweave.llm.common import bounded_batches, partitions, text_bytes, written

#: Bytes of a string that must not occur twice; bytes of the grams that are sifted; grams in a string.
LENGTH = 100
GRAM = 40
WINDOW = LENGTH - GRAM + 1
#: Bytes of text in one suffix array, bytes of runs that are merged at a time, and bytes that are sifted at a time.
SHARD_BYTES = 1 << 20
MERGE_BYTES = 1 << 20
SIFT_BYTES = 1 << 20
#: Runs of one gram that are merged in one task; the strings of a gram with more are merged one by one.
HOT_RUNS = 2_000
#: Low bits of a gram's sort key that hold its place.
PLACE_BITS = 23
#: Stands between texts; no UTF-8 text holds it.
APART = b"\xff" * 8
#: Odd factors of a hash over 8-byte words.
FACTORS = [np.uint64((0x9E3779B97F4A7C15 * (2 * i + 1) ^ 0xD6E8FEB86659FD93) % 2**64 | 1) for i in range(16)]


def words(buffer: np.ndarray) -> np.ndarray:
    """The little-endian 8 bytes from each place on; the buffer ends with 8 bytes of padding."""
    return np.ndarray((len(buffer) - 7,), "<u8", buffer, strides=(1,))


def offsets(length: int) -> list[int]:
    """Where the 8-byte words begin that cover ``length`` bytes."""
    return [*range(0, length - 7, 8)] + ([length - 8] if length % 8 else [])


def mixed(columns: list[np.ndarray]) -> np.ndarray:
    """A 64-bit hash of each row of words."""
    out = np.zeros(len(columns[0]), np.uint64)
    for i, column in enumerate(columns):
        x = column * FACTORS[i]
        x ^= x >> np.uint64(29)
        out += x * FACTORS[i + 1]
    out ^= out >> np.uint64(32)
    out *= FACTORS[0]
    out ^= out >> np.uint64(29)
    return out


def hashes(w: np.ndarray, length: int, n: int) -> np.ndarray:
    """A hash of the ``length`` bytes from each of the first ``n`` places on."""
    return mixed([w[a : a + n] for a in offsets(length)])


class Texts:
    """Texts side by side in one buffer, kept apart by bytes that no text holds."""

    def __init__(self, parts: list[bytes]) -> None:
        self.lengths = np.array([len(p) for p in parts], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths + len(APART))[:-1]]).astype(np.int64)
        self.data = APART.join(parts) + APART * (LENGTH // 8 + 4)
        self.buffer = np.frombuffer(self.data, np.uint8)
        self.n = int(self.starts[-1] + self.lengths[-1]) if parts else 0
        self.words = words(self.buffer)

    def spread(self, values: np.ndarray) -> np.ndarray:
        """A value per text as one per place."""
        return np.repeat(values, np.diff(np.append(self.starts, self.n)))

    def whole(self) -> np.ndarray:
        """Whether LENGTH bytes of one text begin at each place."""
        return np.arange(self.n) + LENGTH <= self.spread(self.starts + self.lengths)

    def grams(self) -> tuple[np.ndarray, np.ndarray]:
        """Each place's gram hash, and for each place the place of the least gram of the LENGTH bytes from there.

        Equal strings have their least gram at equal offsets, ties going to the first.
        """
        h = hashes(self.words, GRAM, self.n + WINDOW)
        places = np.uint64((1 << PLACE_BITS) - 1)
        key = (h & ~places) | np.arange(len(h), dtype=np.uint64)
        least, span = key, 1
        while 2 * span <= WINDOW:
            least, span = np.minimum(least[:-span], least[span:]), 2 * span
        if rest := WINDOW - span:
            least = np.minimum(least[:-rest], least[rest:])
        return h, (least[: self.n] & places).astype(np.int64)


def starts_of_runs(*arrays: np.ndarray) -> np.ndarray:
    """Where any of the arrays changes; the first place counts."""
    change = np.zeros(len(arrays[0]), bool)
    change[:1] = True
    for a in arrays:
        change[1:] |= a[1:] != a[:-1]
    return np.flatnonzero(change)


def suffix_array(t: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Places in the order of their suffixes' first 128 bytes, and which of them equal the one before that far.

    Larsson and Sadakane's refinement: the first 8 bytes give groups; a group whose members are told apart by
    the groups of the suffixes 8, 16, 32 and 64 places on is sorted again, and groups of one are left alone.
    """
    n = t.n
    key = t.words[:n].byteswap()
    order = np.argsort(key)
    sorted_key = key[order]
    head = np.ones(n, bool)
    head[1:] = sorted_key[1:] != sorted_key[:-1]
    rank = np.empty(n + LENGTH + 32, np.int64)
    rank[n:] = n  # what follows the last text is greater than any text
    rank[order] = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    step = 8
    while step < LENGTH:
        # members of groups of two or more
        alone = head & np.append(head[1:], True)
        at = np.flatnonzero(~alone)
        if not len(at):
            break
        members = order[at]
        group, second = rank[members], rank[members + step]
        again = np.argsort(group.astype(np.uint64) << np.uint64(32) | second.astype(np.uint64))
        members, group, second = members[again], group[again], second[again]
        order[at] = members
        new = np.zeros(len(at), bool)
        new[starts_of_runs(group, second)] = True
        head[at] = new
        rank[members] = at[np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))]
        step *= 2
    return order, ~head


def common_prefixes(t: Texts, order: np.ndarray, tied: np.ndarray, lane: int = 256) -> np.ndarray:
    """For each place in the suffix array, bytes (LENGTH at most) shared with the suffix before it.

    Kasai's rule: the next place in the text shares at least one byte less with its own predecessor. It holds
    after suffixes whose order is known; after a tied one, which needs no look at the text, counting starts again.
    The text is cut into lanes that keep the rule side by side, so that every step is one vector operation.
    """
    n, w = t.n, t.words
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    equals = np.zeros(n, bool)
    equals[order] = tied
    shared = np.zeros(n, np.int64)
    starts = np.arange(0, n, lane)
    h = np.zeros(len(starts), np.int64)
    for i in range(min(lane, n)):
        here = starts + i
        if here[-1] >= n:
            here = here[:-1]
            h = h[: len(here)]
            starts = starts[: len(here)]
        other = before[here]
        h = np.where(other < 0, 0, np.maximum(h - 1, 0))
        live = np.flatnonzero((other >= 0) & (h < LENGTH) & ~equals[here])
        while len(live):
            x = w[here[live] + h[live]] ^ w[other[live] + h[live]]
            equal = x == 0
            bits = np.bitwise_count((x & (~x + np.uint64(1))) - np.uint64(1)).astype(np.int64)
            h[live] += np.where(equal, 8, bits >> 3)
            live = live[equal & (h[live] < LENGTH)]
        shared[here] = np.where(equals[here], LENGTH, np.minimum(h, LENGTH))
        h = np.where(equals[here], 0, np.minimum(h, LENGTH))
    return shared[order]


def repeats(t: Texts, rank: np.ndarray) -> np.ndarray:
    """Places of LENGTH bytes that also begin at a place of smaller ``rank``, from the shard's suffix array."""
    later = np.zeros(t.n, bool)
    order, tied = suffix_array(t)
    equal = common_prefixes(t, order, tied) >= LENGTH
    group = np.cumsum(~equal) - 1
    if not len(group):
        return later
    least = np.minimum.reduceat(rank[order], np.flatnonzero(~equal))
    later[order] = rank[order] > least[group]
    return later & t.whole()


def spans(flags: np.ndarray, *splits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true places; a run also ends where a split changes."""
    at = np.flatnonzero(flags)
    if not len(at):
        return at, at
    first = starts_of_runs(at - np.arange(len(at)), *[s[at] for s in splits])
    return at[first], np.append(at[first[1:] - 1], at[-1]) + 1


def _sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Least grams of all strings: (route, hash, doc, at, kind). Grams that a task sees twice need no other
    task's word: all but the first are known to be repeated (kind 2) and travel by document; the first (1) and
    those seen once (0) travel by hash, so a common gram costs a row a task.
    """

    def flush(ids: list[int], texts: list[bytes]) -> pa.RecordBatch:
        t = Texts(texts)
        h, least = t.grams()
        found = least[t.whole()]
        found = found[starts_of_runs(found)]
        hashed = h[found].view(np.int64)
        text = np.searchsorted(t.starts, found, side="right") - 1
        doc = np.array(ids, np.int64)[text]
        order = np.argsort(hashed, kind="stable")
        hashed, doc, at = hashed[order], doc[order], (found - t.starts[text])[order]
        first = starts_of_runs(hashed)
        size = np.diff(np.append(first, len(hashed)))
        kind = np.full(len(hashed), 2, np.int8)
        kind[first] = (size > 1).astype(np.int8)
        return pa.RecordBatch.from_arrays([pa.array(np.where(kind < 2, hashed, doc)), pa.array(doc), pa.array(at), pa.array(kind)], names=["route", "doc", "at", "kind"])

    ids: list[int] = []
    texts: list[bytes] = []
    size = 0
    for batch in batches:
        for i, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            content = text.as_py()
            if len(content) < LENGTH:
                continue
            for at in range(0, len(content), SIFT_BYTES):
                # pieces overlap, so that every string lies whole in one of them
                piece = content[at : at + SIFT_BYTES + LENGTH - 1]
                if at and len(piece) < LENGTH:
                    break
                if at or len(content) > SIFT_BYTES:
                    yield _shifted(flush([i], [piece]), at)
                else:
                    ids.append(i)
                    texts.append(piece)
                    size += len(piece)
            if size > SIFT_BYTES:
                yield flush(ids, texts)
                ids, texts, size = [], [], 0
    if texts:
        yield flush(ids, texts)


def _shifted(batch: pa.RecordBatch, by: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.asarray(batch.column(2)) + by), batch.column(3)], names=batch.schema.names)


def _known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by (by document or not, route): keeps the grams that stand in two rows, or were seen
    twice by a task. The last run of a batch waits for the next batch."""
    waiting: tuple[np.ndarray, ...] | None = None

    def decide(route: np.ndarray, doc: np.ndarray, at: np.ndarray, kind: np.ndarray) -> pa.RecordBatch:
        first = starts_of_runs(kind == 2, route)
        size = np.diff(np.append(first, len(route)))
        hot = (np.maximum.reduceat(kind, first) > 0) | (size > 1) if len(first) else np.zeros(0, bool)
        keep = np.repeat(hot, size)
        return pa.RecordBatch.from_arrays([pa.array(doc[keep]), pa.array(at[keep])], names=["doc", "at"])

    for batch in batches:
        now = tuple(np.asarray(batch.column(i)) for i in range(4))
        if waiting is not None:
            now = tuple(np.concatenate(x) for x in zip(waiting, now, strict=True))
        if not len(now[0]):
            continue
        cut = starts_of_runs(now[3] == 2, now[0])[-1]
        if cut == 0 and len(now[0]) > 1:
            # one gram fills all that waits: it is repeated, and one row of it is enough to wait for more
            yield decide(*now)
            waiting = (*(x[-1:] for x in now[:3]), np.maximum(now[3][-1:], 1))
            continue
        yield decide(*(x[:cut] for x in now))
        waiting = tuple(x[cut:] for x in now)
    if waiting is not None:
        yield decide(*waiting)


def digest_without(content: bytes, starts: list[int], ends: list[int]) -> tuple[int, int, str]:
    """(removed bytes, runs, SHA-256 of the rest) when every string that starts in [start, end) goes."""
    sha, removed, runs, at = hashlib.sha256(), 0, 0, 0
    reach = -1
    for s, e in sorted(zip(starts, ends, strict=True)):
        e += LENGTH - 1
        if s > reach:
            sha.update(content[at:s])
            removed, runs = removed + e - s, runs + 1
            at = reach = e
        elif e > reach:
            removed += e - reach
            at = reach = e
    sha.update(content[at:])
    return removed, runs, sha.hexdigest()


RESULT = "doc long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(route, doc, start, bytes): the stretches of text around repeated grams. A stretch travels by the least
    hash of its repeated grams, so that copies of it mostly meet in one shard.
    """
    for batch in batches:
        rows: list[tuple[int, int, int, bytes]] = []
        for one, text, grams in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
            if not grams.is_valid:
                continue
            content, at = text.as_py(), np.sort(np.asarray(grams.values))
            w = words(np.frombuffer(content + APART, np.uint8))
            h = mixed([w[at + o] for o in offsets(GRAM)])
            for s, e in segments(len(content), at.tolist()):
                for begin in range(s, e - LENGTH + 1, SHARD_BYTES):
                    end = min(e, begin + SHARD_BYTES + LENGTH - 1)
                    i, j = np.searchsorted(at, (begin, end))
                    rows.append((int(h[i:j].min().view(np.int64)) if j > i else one, one, begin, content[begin:end]))
        columns = list(zip(*rows, strict=True)) or [(), (), (), ()]
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["route", "doc", "start", "bytes"])


def segments(length: int, grams: list[int]) -> list[tuple[int, int]]:
    """The bytes of all strings whose least gram may be one of ``grams``, merged."""
    out: list[list[int]] = []
    for g in sorted(grams):
        s, e = max(0, g - WINDOW + 1), min(length, g + LENGTH)
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out if e - s >= LENGTH]


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(gram, shard, doc, start, n): strings that a shard knows to be later ones (gram null), and the strings that are
    the shard's first, as runs with one least gram. A shard is named by the first place of its text.
    """

    def flush(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
        rows = sorted(rows, key=lambda r: r[:2])
        t = Texts([r[2] for r in rows])
        doc, start = np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.int64)
        place = np.arange(t.n)  # segments stand in the order of documents and places
        text = t.spread(np.arange(len(rows)))
        later = repeats(t, place)
        h, least = t.grams()
        a, b = spans(later, text)
        c, d = spans(t.whole() & ~later, text, least)
        at = np.concatenate([a, c]).astype(np.int64)
        owner = text[at] if len(at) else np.zeros(0, np.int64)
        gram = np.concatenate([np.zeros(len(a), np.int64), h[least[c]].view(np.int64) if len(c) else np.zeros(0, np.int64)])
        shard = np.full(len(at), int(mixed([doc[:1].astype(np.uint64), start[:1].astype(np.uint64)]).view(np.int64)[0]))
        columns = [pa.array(gram, pa.int64(), mask=np.arange(len(at)) < len(a)), pa.array(shard), pa.array(doc[owner], pa.int64()), pa.array(start[owner] + at - t.starts[owner] if len(at) else at, pa.int64()), pa.array(np.concatenate([b - a, d - c]).astype(np.int32))]
        return pa.RecordBatch.from_arrays(columns, names=["gram", "shard", "doc", "start", "n"])

    rows: list[tuple[int, int, bytes]] = []
    size = 0
    for batch in batches:
        for one, start, content in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3), strict=True):
            rows.append((one, start, content.as_py()))
            size += len(rows[-1][2])
            if size > SHARD_BYTES:
                yield flush(rows)
                rows, size = [], 0
    if rows:
        yield flush(rows)


def _again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(route, hot, doc, start, n, bytes): the runs of grams that several shards hold, cut from their texts once more.
    Runs travel by their gram; those of a hot gram go string by string, each by its own hash.
    """
    names = ["route", "hot", "doc", "start", "n", "bytes"]
    kinds = (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
    for batch in batches:
        rows: list[tuple[int, bool, int, int, int, bytes]] = []
        for one, text, runs in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
            if not runs:
                continue
            content = text.as_py()
            for r in runs:
                start, n = r["start"], r["n"]
                piece = content[start : start + n + LENGTH - 1]
                if not r["hot"]:
                    rows.append((r["gram"], False, one, start, n, piece))
                    continue
                each = hashes(words(np.frombuffer(piece + APART, np.uint8)), LENGTH, n).view(np.int64).tolist()
                rows += [(h, True, one, start + i, 1, piece[i : i + LENGTH]) for i, h in enumerate(each)]
            if len(rows) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
                rows = []
        columns = list(zip(*rows, strict=True)) or [()] * 6
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)


def merged(contents: list[bytes], docs: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of strings from several shards: those that also begin earlier, as (row, first, end) within the runs.

    The strings make one sorted list; each finds its place there by binary search, comparing bytes, and the earliest
    string at a place is the one that stays.
    """
    order = np.lexsort((starts, docs))
    contents, counts = [contents[i] for i in order], counts[order]
    t = Texts(contents)
    row = t.spread(np.arange(len(contents)))
    begins = np.flatnonzero(np.arange(t.n) - t.starts[row] < counts[row])
    # a trailing zero byte would be lost on numpy's strings, but all of them are LENGTH bytes long
    strings = np.ndarray((t.n,), f"S{LENGTH}", t.buffer, strides=(1,))[begins]
    listed = np.sort(strings)
    at = np.searchsorted(listed, strings)
    first = np.full(len(listed), len(begins), np.int64)
    np.minimum.at(first, at, np.arange(len(begins)))
    later = first[at] < np.arange(len(begins))
    flags = np.zeros(t.n, bool)
    flags[begins[later]] = True
    a, b = spans(flags, row)
    rows = row[a] if len(a) else a
    return order[rows], a - t.starts[rows], b - t.starts[rows]


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, start, end) of later strings. Rows come sorted by hot or not, route, doc and start; runs are merged in portions that
    never part a route, and of a hot route's strings only the different ones are held.
    """
    rows: list[tuple[int, int, int, bytes]] = []
    size, last, seen = 0, None, set()

    def flush() -> Iterator[tuple[int, int, int]]:
        doc, start, n = (np.array([r[i] for r in rows], np.int64) for i in range(3))
        row, a, b = merged([r[3] for r in rows], doc, start, n)
        rows.clear()
        return zip(doc[row].tolist(), (start[row] + a).tolist(), (start[row] + b).tolist(), strict=True)

    for batch in batches:
        found: list[tuple[int, int, int]] = []
        for route, hot, doc, start, n, content in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
            if hot:
                if route != last:
                    seen, last = set(), route
                if content in seen:
                    found.append((doc, start, start + 1))
                seen.add(content)
                continue
            if size > MERGE_BYTES and route != last:
                found += flush()
                size = 0
            rows.append((doc, start, n, content))
            size, last = size + len(content), route
        columns = list(zip(*found, strict=True)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc", "start", "end"])
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in list(zip(*flush(), strict=True)) or [(), (), ()]], names=["doc", "start", "end"])


def _finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found, sizes = [], []
        for text, runs in zip(batch.column(1), batch.column(2).to_pylist(), strict=True):
            content, runs = text.as_py(), runs or []
            sizes.append(len(content))
            found.append(digest_without(content, [r["start"] for r in runs], [r["end"] for r in runs]))
        columns = [pa.array([f[i] for f in found], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.string()))]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), *columns], names=["doc", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def numbered(docs: DataFrame, id_column: str, text_column: str) -> tuple[DataFrame, DataFrame | None]:
    """(doc, text) with a unique number in the order of ids, and where that is not the id itself, doc_id by doc."""
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), text_bytes(text_column).alias("text"))
    n, different = rows.agg(F.count("*"), F.count_distinct("doc_id")).first()
    if n == different:
        return rows.withColumnRenamed("doc_id", "doc"), None
    rows = written(rows.orderBy(F.col("doc_id").asc_nulls_first(), F.xxhash64("text")).withColumn("doc", F.monotonically_increasing_id()))
    return rows.select("doc", "text"), rows.select("doc", "doc_id")


def dedup_strings(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    Every byte covered by a LENGTH-byte string that also starts earlier goes: in a document of smaller id, or
    earlier in the same text. Texts are UTF-8 bytes, null is empty, strings never cross documents and are
    judged on the input. A null id comes before all others; rows that repeat an id are ordered by their texts'
    hashes, so of repeated rows one stays whole. Texts below LENGTH bytes stay. An empty table gives no rows;
    other columns are ignored.

    Grams of GRAM bytes are sifted first: of every string the least gram is a fixed choice, and a string can
    only occur twice if its least gram does. Text around repeated grams goes to suffix arrays, shard by shard;
    a shard's later strings are known at once. Of its first ones, those whose least gram another shard holds too are
    cut from the texts once more and merged with that shard's by binary search. The sieve loses
    nothing, and whatever passes it is compared byte by byte. No task holds more than a few MB of text, however
    common a gram is: the strings of a gram with more than HOT_RUNS runs travel one by one.
    """
    bounded_batches(docs.sparkSession)
    texts, names = numbered(docs, id_column, text_column)
    n = partitions(docs)
    grams = texts.mapInArrow(_sift, "route long, doc long, at long, kind byte")
    by_gram = grams.repartition(n, "route").sortWithinPartitions(F.col("kind") == 2, "route")
    hot = by_gram.mapInArrow(_known, "doc long, at long").groupBy("doc").agg(F.collect_set("at").alias("at"))
    # left joins over the same texts: they are exchanged once up to the shards, and once for both joins after them
    cut = texts.join(hot, "doc", "left").select("doc", "text", "at").mapInArrow(_cut, "route long, doc long, start long, bytes binary")
    # only a good place for copies to meet, so a hot one may be split
    shards = written(cut.hint("rebalance", F.col("route")).sortWithinPartitions("route").mapInArrow(_shards, "gram long, shard long, doc long, start long, n int"))
    runs = shards.filter("gram IS NOT NULL")
    shared = runs.groupBy("gram").agg(F.min("shard").alias("low"), F.max("shard").alias("high"), F.count("*").alias("runs")).filter("low < high")
    shared = written(shared.select("gram", (F.col("runs") > HOT_RUNS).alias("hot")))
    asked = runs.join(shared, "gram").groupBy("doc").agg(F.collect_list(F.struct("gram", "hot", "start", "n")).alias("asked"))
    again = texts.join(asked, "doc", "left").select("doc", "text", "asked").mapInArrow(_again, "route long, hot boolean, doc long, start long, n int, bytes binary")
    dealt = again.repartition(n, "hot", "route").sortWithinPartitions("hot", "route", "doc", "start")
    later = dealt.mapInArrow(_merge, "doc long, start long, end long")
    known = shards.filter("gram IS NULL").select("doc", "start", (F.col("start") + F.col("n")).alias("end"))
    later = later.unionByName(known).groupBy("doc").agg(F.collect_list(F.struct("start", "end")).alias("runs"))
    result = texts.join(later, "doc", "left").select("doc", "text", "runs").mapInArrow(_finished, RESULT)
    if names is None:
        return result.withColumnRenamed("doc", "doc_id")
    return result.join(names, "doc").select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
