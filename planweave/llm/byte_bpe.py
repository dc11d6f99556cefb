"""Byte-level BPE from a file of ranks: exact merges found by backtracking from longest matches."""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator
from itertools import islice

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planweave.llm.common import bounded_batches, text_bytes

#: Pieces that a worker remembers in each of two generations, the longest that it remembers, and answers on pairs.
KNOWN_PIECES, LONGEST_KNOWN, KNOWN_PAIRS = 200_000, 40, 1_000_000
#: Pieces of a text that are held at a time.
PIECES = 1 << 16

ENCODED = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])
DECODED = pa.schema([*ENCODED, ("decoded", pa.binary())])


def read_ranks(path: str) -> dict[bytes, int]:
    """The tokens of a rank file, one ``base64 rank`` a line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(bytes.strip, lines))}


class ByteBPE:
    """The ids that merging by rank gives a piece of text, without merging.

    Merging joins the adjacent two tokens of least rank, the leftmost of equals, until no two adjacent ones are a token. A sequence of
    tokens is its outcome exactly if each of two adjacent ones is the outcome for their own bytes
    (``compatible``). So the sequence is looked for from the left: at each place the longest token comes first, then its
    prefixes; where none goes with the token before, that token is taken back, and the place is not entered again.
    Each place is left behind at most once, so time is linear in the piece.

    Longest matches come from an Aho-Corasick automaton over the bytes mapped to Latin-1 characters. This holds for
    ranks that merges were numbered by: a token that merging tokens of lower rank doesn't make is an error.
    """

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.left: dict[int, int] = {}
        self.right: dict[int, int] = {}
        self.merged: dict[int, int] = {}
        self.shorter: dict[int, int | None] = {}
        self.size: dict[int, int] = {}
        self.pairs: dict[int, bool] = {}
        self.known = Known(self, {})
        self.longest = 1
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        made: dict[bytes, int] = {}
        for token, rank in sorted(ranks.items(), key=lambda r: (len(r[0]) > 1, r[1])):
            if len(token) > 1 and not self._split(token, rank, made):
                raise ValueError(f"no merges of lower rank make the token {token!r} of rank {rank}")
            made[token] = rank
            self.size[rank] = len(token)
            self.automaton.add_word(token.decode("latin-1"), rank)
            self.longest = max(self.longest, len(token))
        for token, rank in made.items():
            self.shorter[rank] = next((made[token[:k]] for k in range(len(token) - 1, 0, -1) if token[:k] in made), None)
        self.automaton.make_automaton()
        self.pairs.clear()
        self.code = {rank: rank.to_bytes(4, "little") for rank in ranks.values()}

    def _split(self, token: bytes, rank: int, made: dict[bytes, int]) -> bool:
        """Notes which two tokens of lower rank the last merge of ``token`` joins; False if there are none."""
        for k in range(len(token) - 1, 0, -1):
            a, b = made.get(token[:k]), made.get(token[k:])
            if a is not None and b is not None and self.compatible(a, b):
                self.left[rank], self.right[rank] = a, b
                self.merged[a << 32 | b] = rank
                return True
        return False

    def compatible(self, a: int, b: int) -> bool:
        """Whether merging the bytes of both tokens ends with these two."""
        key = a << 32 | b
        if (known := self.pairs.get(key)) is None:
            if len(self.pairs) >= KNOWN_PAIRS:
                self.pairs.clear()
            self.pairs[key] = known = self._stay_apart(a, b)
        return known

    def _stay_apart(self, a: int, b: int) -> bool:
        """Takes the merges next to the border back, latest first: no two tokens that met there may have been merged
        before the merge that came next."""
        merged, left, right = self.merged, self.left, self.right
        before: float = float("inf")  # a merge across the border must not have a rank below this
        while True:
            if merged.get(a << 32 | b, before) < before:
                return False
            # single bytes are no merge; of equal ranks the left one was merged first
            time_a, time_b = (a if a in right else -1), (b if b in left else -1)
            if time_a < 0 and time_b < 0:
                return True
            if time_a > time_b:
                before, a = a, right[a]
            else:
                before, b = b + 1, left[b]

    def encode(self, piece: bytes) -> list[int]:
        """Ids of one match of the pattern."""
        whole = self.ranks.get(piece)
        if whole is not None or not piece:
            return [] if whole is None else [whole]
        text, end = piece.decode("latin-1"), len(piece)
        longest, shorter, size, compatible = self.automaton.iter_long, self.shorter, self.size, self.compatible
        # longest matches all along the piece; most often they go together, else the search begins where two don't
        out = [token for _, token in longest(text)]
        for bad in range(1, len(out)):
            if not compatible(out[bad - 1], out[bad]):
                break
        else:
            return out
        token: int | None = out[bad]
        del out[bad:]
        at = sum(map(size.__getitem__, out))
        possible = bytearray(b"\x01") * (end + 1)
        while at < end:
            while token is not None and not (possible[at + size[token]] and (not out or compatible(out[-1], token))):
                token = shorter[token]
            if token is not None:
                out.append(token)
                at += size[token]
                token = next(longest(text[at : at + self.longest]))[1] if at < end else None
            else:
                possible[at] = 0
                token = out.pop()
                at -= size[token]
        return out

    def packed(self, pieces: list[str]) -> bytes:
        """The ids of all pieces as little-endian unsigned 32-bit integers."""
        out = b"".join(map(self.known.__getitem__, pieces))
        if len(self.known) > KNOWN_PIECES:
            self.known = Known(self, self.known)
        return out


class Known(dict):
    """Packed ids of pieces, worked out when they are asked for first; pieces of the generation before live on."""

    def __init__(self, bpe: ByteBPE, older: dict[str, bytes]) -> None:
        super().__init__()
        self.bpe, self.older = bpe, dict(older)

    def __missing__(self, piece: str) -> bytes:
        if (ids := self.older.get(piece)) is None:
            code = self.bpe.code
            ids = b"".join([code[i] for i in self.bpe.encode(piece.encode())])
        if len(piece) <= LONGEST_KNOWN:
            self[piece] = ids
        return ids


@functools.cache
def byte_bpe(path: str) -> ByteBPE:
    """One per worker, so its tasks share what it has learned."""
    return ByteBPE(read_ranks(path))


@functools.cache
def token_bytes(path: str) -> dict[int, bytes]:
    return {rank: token for token, rank in read_ranks(path).items()}


def encode_texts(docs: DataFrame, ranks_path: str, pattern: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_tokens, ids (little-endian unsigned 32-bit integers).

    Each match of ``pattern`` in the whole text is encoded by itself with the ranks of the file, which every worker reads by its path; no special tokens are known.
    A null text is empty and has no ids; ids of rows may be null or repeat; an empty table gives no rows; other columns are ignored,
    whatever their names. A text of any length is walked in runs of PIECES matches.
    """
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, matches = byte_bpe(ranks_path), regex.compile(pattern)
        for batch in batches:
            ids = []
            for text in batch.column(1):
                found = (m.group() for m in matches.finditer(text.as_py()))
                ids.append(b"".join(bpe.packed(pieces) for pieces in iter(lambda f=found: list(islice(f, PIECES)), [])))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(i) // 4 for i in ids], pa.int64()), pa.array(ids, pa.binary())], schema=ENCODED)

    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), text_bytes(text_column).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids binary")


def decode_ids(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """``encoded`` (doc_id, n_tokens, ids) with ``decoded``, the bytes that the ids stand for; an unknown id is an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = token_bytes(ranks_path).__getitem__
        for batch in batches:
            texts = [b"".join(map(token, np.frombuffer(ids.as_buffer(), "<u4").tolist())) for ids in batch.column(2)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.binary())], schema=DECODED)

    return encoded.select("doc_id", "n_tokens", "ids").mapInArrow(run, "doc_id long, n_tokens long, ids binary, decoded binary")
