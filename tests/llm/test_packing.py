import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from planweave.llm.packing import SumIndex, WordIds, best_fit_packing, pack_lengths

PATH = public_tokenizers.path("word_bpe_49k.json")


def check(rows, texts, context):
    """Every piece is the tokenizer's, and sequences are gapless and full enough."""
    tokenizer = Tokenizer.from_file(PATH)
    want = []
    for one, text in texts:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        for k, i in enumerate(range(0, len(ids), context)):
            piece = ids[i : i + context]
            want.append((one, k, i, len(piece), zlib.crc32(np.array(piece, "<u4").tobytes())))
    assert sorted(map(repr, want)) == sorted(repr((r.doc_id, r.piece, r.start, r.length, r.ids_crc32)) for r in rows)
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= context
    return len(sequences), -(-sum(w[3] for w in want) // context)


def test_small_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    used, least = check(best_fit_packing(docs, PATH).collect(), [(r.doc_id, r.text) for r in docs.collect()], 4096)
    assert used <= least + 1


def test_nulls_empty_long_and_repeated(docs):
    rows = [(1, None), (2, ""), (3, "Word " * 3000), (3, "Word " * 3000), (None, "a\tb c\x1cd <|endoftext|> é"), (5, "\n \n"), (6, "It's 12 o'clock!!")]
    check(best_fit_packing(docs(rows), PATH, context=256).collect(), rows, 256)
    assert best_fit_packing(docs([]), PATH).count() == 0


def test_clashing_columns(spark):
    df = spark.createDataFrame([(1, "a b", 5, 6, 7)], "doc_id long, text string, length int, shard int, rank int")
    assert [(r.length, r.offset) for r in best_fit_packing(df, PATH).collect()] == [(3, 0)]


def test_words_give_the_whole_text_ids():
    rng = random.Random(5)
    ids = WordIds(PATH)
    tokenizer = Tokenizer.from_file(PATH)
    alphabet = ["a", "Bc", " ", "\n", "\t", "\r", " ", " ", "\x85", "\x1f", "1", "'s", "é", "é", "́", "Σ", "<|startoftext|>", "!", "ſ", "中", "‍", "😀", ".", ",", "\x01", "a.", "b,", "it's."]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(40))) for _ in range(400)]
    got = ids(texts)
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_exact_fills_come_first():
    plan = pack_lengths({60: 3, 40: 2, 25: 1, 15: 1, 30: 2, 10: 4, 100: 7}, 100)
    used = defaultdict(int)
    for lengths, k in plan:
        assert sum(lengths) <= 100
        for n in lengths:
            used[n] += k
    assert used == {60: 3, 40: 2, 25: 1, 15: 1, 30: 2, 10: 4, 100: 7}
    assert sum(k for _, k in plan) == 11


def test_packing_is_near_the_bound():
    rng = random.Random(9)
    counts = defaultdict(int)
    for _ in range(5000):
        counts[min(4096, int(rng.lognormvariate(6.3, 1)) + 1)] += 1
    plan = pack_lengths(counts)
    least = -(-sum(n * c for n, c in counts.items()) // 4096)
    assert sum(k for _, k in plan) <= least + 1


def test_another_tokenizer_gets_whole_texts(docs):
    other = public_tokenizers.path("byte_bpe_50k.json")
    assert WordIds(PATH).by_word and not WordIds(other).by_word
    tokenizer = Tokenizer.from_file(other)
    text = " The quick,  brown fox.\n\nÜber it's "
    ids = [*tokenizer.encode(text, add_special_tokens=False).ids, 1]
    row = best_fit_packing(docs([(1, text)]), other).first()
    assert (row.length, row.ids_crc32) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))


def test_index_of_sums():
    rng = random.Random(1)
    left = np.zeros(61, np.int64)
    for n in rng.sample(range(1, 60), 25):
        left[n] = rng.randrange(1, 3)
    index, there = SumIndex(left), [n for n in range(61) if left[n]]
    for total in range(1, 61):
        assert sorted(index.of_two(total, total)) == sorted((a, b) for a in there for b in there if b <= a and a + b == total)
        assert sorted(index.of_three(total)) == sorted((a, b, c) for a in there for b in there for c in there if c <= b <= a and a + b + c == total)


def test_words_are_told_apart_without_case_and_ends():
    rng = random.Random(6)
    ids = WordIds(PATH)
    assert ids.by_word
    tokenizer = Tokenizer.from_file(PATH)
    alphabet = ["a", "B", "Ñ", "ß", "µ", "ÿ", "s", "T", " ", " ", "\n", "'", "!", "%%", "_", "-", ".", ")", "1", "²", "̈", "̸", "=", "\xa0", "\x01", "Σ"]
    texts = ["".join(rng.choice(alphabet[: rng.choice((23, 26))]) for _ in range(rng.randrange(40))) for _ in range(3000)]
    assert [np.frombuffer(g, "<u4").tolist() for g in ids(texts)] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    texts = ["A <|ENDOFTEXT|> b", "a <|endoftext|> B", "Ab<|endoftext|>!"]
    assert [np.frombuffer(g, "<u4").tolist() for g in ids(texts)] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    # one word in many guises is remembered once, and words of any length aren't
    ids = WordIds(PATH)
    before = set(ids.known)
    ids(["Wört!! wört%%% WÖRT wÖrt", "x" * 1000])
    assert {w for w in set(ids.known) - before if w.isalpha()} == {"wört"}
