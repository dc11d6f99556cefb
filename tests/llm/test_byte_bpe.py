import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import regex
import tiktoken

from planweave.llm.byte_bpe import ByteBPE, byte_bpe, decode_ids, encode_texts, read_ranks
from planweave.llm.queries import QUERIES

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
SMALL = "/root/testdata/sf0.001"


def library(path=RANKS):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(path), special_tokens={})


def merge(ranks, piece):
    """Plain merging: the adjacent two of least rank, the leftmost of equals, until none are a token."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    if piece in ranks:
        return [ranks[piece]]
    while pairs := [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in ranks]:
        _, i = min(pairs)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return [ranks[p] for p in parts]


@pytest.mark.parametrize("name", ["byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken"])
def test_pieces_equal_plain_merging(name):
    bpe, rng = byte_bpe(public_tokenizers.path(name)), random.Random(5)
    tokens = list(bpe.ranks)
    kinds = [lambda: bytes(rng.choice(b"etaoinshr ") for _ in range(rng.randrange(40))), lambda: bytes(rng.randrange(256) for _ in range(rng.randrange(12))), lambda: b"".join(rng.choice(tokens) for _ in range(rng.randrange(6)))]
    for _ in range(1500):
        piece = rng.choice(kinds)()
        assert bpe.encode(piece) == merge(bpe.ranks, piece), piece


def test_any_ranks_that_merges_were_numbered_by():
    rng, used = random.Random(9), 0
    for _ in range(400):
        order = [b"a", b"b", b"c"]
        for _ in range(rng.randrange(1, 14)):
            token = rng.choice(order) + rng.choice(order)
            order += [] if token in order else [token]
        try:
            bpe = ByteBPE({t: i for i, t in enumerate(order)})
        except ValueError:  # an earlier merge always takes a part of one of the tokens
            continue
        used += 1
        for _ in range(30):
            piece = bytes(rng.choice(b"abc") for _ in range(rng.randrange(1, 16)))
            assert bpe.encode(piece) == merge(bpe.ranks, piece), (order, piece)
    assert used > 50


def test_a_token_without_merges_is_an_error():
    with pytest.raises(ValueError, match="abc"):
        ByteBPE({b"a": 0, b"b": 1, b"c": 2, b"abc": 3})


def test_every_kind_of_sign_is_parted_as_the_library_does():
    ours, theirs, matches = byte_bpe(RANKS), library(), regex.compile(public_tokenizers.PATTERN)
    for c in [*range(0x3100), *range(0xFE00, 0x10100), *range(0x1F300, 0x1F700), *range(0x3100, 0x110000, 97)]:
        if not 0xD800 <= c < 0xE000:
            text = f"a{chr(c)}{chr(c)} {chr(c)}b1"
            assert np.frombuffer(ours.packed(matches.findall(text)), "<u4").tolist() == theirs.encode_ordinary(text), hex(c)


def test_long_pieces_take_linear_time():
    bpe, theirs = byte_bpe(RANKS), library()
    for unit in (b"a", b"ab", b" ", b"etaoin", b"\xe6\x97"):
        piece = unit * (60_000 // len(unit))
        assert bpe.encode(piece) == theirs._core_bpe.encode_single_piece(piece)


def test_rows(spark):
    texts = [None, "", "Hello  world's\n\n end ", "x" * 50_000 + " é\U0001f600", "word " * 150_000, "same", "same"]
    df = spark.createDataFrame([(None if i == 2 else i, t, b"own", 5) for i, t in enumerate(texts)], "doc_id long, text string, ids binary, n_tokens int")
    got = decode_ids(encode_texts(df.repartition(3), RANKS, public_tokenizers.PATTERN), RANKS).collect()
    theirs = library()
    want = [(None if i == 2 else i, theirs.encode_ordinary(t or ""), (t or "").encode()) for i, t in enumerate(texts)]
    assert sorted(((r.doc_id, np.frombuffer(r.ids, "<u4").tolist(), bytes(r.decoded)) for r in got), key=repr) == sorted(want, key=repr)
    assert all(r.n_tokens == len(r.ids) // 4 for r in got)
    assert encode_texts(df.limit(0), RANKS, public_tokenizers.PATTERN).count() == 0


def test_query_equals_the_library_on_whole_documents(spark):
    theirs = library()
    want = []
    for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect():
        ids = theirs.encode_ordinary(r.text or "")
        want.append((r.doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()))
    assert sorted(map(tuple, QUERIES["op12_byte_bpe"](spark, SMALL).collect())) == sorted(want)
