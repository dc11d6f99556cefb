"""Spelling variants: words one edit apart, found by dense comparison of code-point tiles from both ends."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planweave.llm.common import bounded_batches, drop_written, partitions, written

#: Letters of a run, and the classes of upper and lower case that are made equal.
LETTERS = r"[A-Za-zÀ-ÿ]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Code points and occurrences that a word needs, how much more frequent a form is, and one run in so many is misspelt.
LEAST_LENGTH, LEAST_COUNT, TIMES, MISSPELT = 7, 2, 10, 31
#: Parts of a word of which one holds the edit.
REGIONS = 3
#: Most words of a bucket that is one tile, most code points of a tile, and rows of a strip that are compared at once.
TILE_WORDS, TILE_CELLS, STRIP = 1024, 4 << 20, 256

NEAR = pa.schema([("word", pa.string()), ("n_near", pa.int64()), ("form", pa.string()), ("form_n", pa.int64())])


def word_counts(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, misspelt: int = MISSPELT) -> DataFrame:
    """(word, n): the words of all texts that are long and frequent enough, A-Z lower-cased.

    In a run whose CRC-32 together with its document's id (null: empty) is divisible by ``misspelt`` one code point is left out. Shorter runs
    are no words and can't become any, so they are not even taken out of the text.
    """
    runs = F.regexp_extract_all(F.col(text_column).cast("string"), F.lit(f"({LETTERS}{{{least_length},}})"))
    rows = docs.select(F.coalesce(F.col(id_column).cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run")).withColumn("run", F.translate("run", UPPER, LOWER))
    h = F.crc32(F.concat("id", F.lit(":"), "run"))
    at = (h % F.length("run")).cast("int")
    spelt = F.when(h % misspelt == 0, F.concat(F.expr("substring(run, 1, at)"), F.expr("substring(run, at + 2)"))).otherwise(F.col("run"))
    words = rows.withColumn("at", at).select(spelt.alias("word")).filter(F.length("word") >= least_length)
    return words.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least_count)


def bucketed(words: DataFrame, regions: int = REGIONS) -> DataFrame:
    """(long, region, bucket, word, n): a word is in a bucket for each part in which an edit may lie, once as the longer and
    once as the shorter word of a pair.

    Two words one edit apart agree before and after it. With the longer word cut into ``regions`` parts, both have what
    stands before the edit's part at their start and what stands after it at their end, and so share its bucket.
    """
    cut = lambda i: F.floor(F.col("long") * F.lit(i) / regions).cast("int")
    parts = F.array(*[F.struct(F.lit(i).alias("region"), cut(i).alias("start"), cut(i + 1).alias("stop")) for i in range(regions)])
    size = F.length("word")
    rows = words.withColumn("long", F.explode(F.array(size, size + 1))).withColumn("part", F.explode(parts)).select("long", "part.*", "word", "n")
    ends = F.expr("substring(word, 1, start)"), F.expr("right(word, long - stop)")
    return rows.select("long", "region", F.xxhash64("long", "region", *ends).alias("bucket"), "word", "n")


def dealt(rows: DataFrame, tile_words: int = TILE_WORDS, tile_cells: int = TILE_CELLS) -> DataFrame:
    """``rows`` with block, x and y: a bucket of too many words is cut into blocks by the word's hash, and each two
    blocks meet in a tile (x, y) of their own; other buckets are one tile."""
    limit = F.greatest(F.lit(2), F.least(F.lit(tile_words), F.floor(F.lit(tile_cells) / F.col("long"))))
    large = rows.groupBy("bucket", "long").agg(F.count("*").alias("words")).filter(F.col("words") > limit)
    large = large.select("bucket", "long", F.ceil(2 * F.col("words") / limit).cast("int").alias("blocks"))
    joined = rows.join(large, ["bucket", "long"], "left").withColumn("block", F.coalesce(F.pmod(F.xxhash64("word"), F.col("blocks")), F.lit(0)).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1))
    met = joined.withColumn("other", other)
    return met.select("long", "region", "bucket", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "block", "word", "n")


def _matrix(words: list[str]) -> np.ndarray:
    """A row of code points a word, zeros behind its end."""
    width = max(map(len, words))
    codes = np.frombuffer("".join(w.ljust(width, "\0") for w in words).encode("utf-32-le"), "<u4").reshape(len(words), width)
    return codes.astype(np.uint8) if codes.max(initial=0) < 256 else codes


def near_in_tile(words: list[str], may: np.ndarray, start: np.ndarray, stop: np.ndarray, long: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows (a, b) of ``words`` where ``may`` allows the pair (words of its bucket other than itself, the longer of ``long`` code points) whose
    common prefix and suffix together reach the longer length less one, and whose edit lies in [start, stop).

    Words are compared column by column from their start, and from their end, with all others at once.
    """
    size = np.array([len(w) for w in words])
    ahead, back = _matrix(words), _matrix([w[::-1] for w in words])
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for at in range(0, len(words), STRIP):
        part = slice(at, at + STRIP)
        shorter = np.minimum(size[part, None], size[None, :])

        def common(codes: np.ndarray, alive: np.ndarray) -> np.ndarray:
            length = np.zeros(alive.shape, np.int32)
            for column in codes.T:
                alive &= column[part, None] == column[None, :]  # noqa: B023
                if not alive.any():
                    break
                length += alive
            return np.minimum(length, shorter)  # noqa: B023

        pairs = may[part] & (shorter >= long[part, None] - 1)
        prefix = common(ahead, pairs.copy())
        edit = np.minimum(prefix, long[part, None] - 1)
        pairs = pairs & (edit >= start[part, None]) & (edit < stop[part, None])
        if pairs.any():
            suffix = common(back, pairs.copy())
            a, b = np.nonzero(pairs & (prefix + suffix >= long[part, None] - 1))
            found.append((a + at, b))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found])


def _tiles(regions: int):
    def flush(rows: list[tuple]) -> pa.RecordBatch:
        long, region, bucket, x, y, block = (np.array([r[i] for r in rows], np.int64) for i in range(6))
        words, n = [r[6] for r in rows], np.array([r[7] for r in rows], np.int64)
        size = np.array([len(w) for w in words])
        may = np.ones((len(rows), len(rows)), bool)
        for key in (long, bucket, x, y):
            may &= key[:, None] == key[None, :]
        may &= (x == y)[:, None] | (block[:, None] != block[None, :])
        may &= np.maximum(size[:, None], size[None, :]) == long[:, None]
        np.fill_diagonal(may, False)
        a, b = near_in_tile(words, may, long * region // regions, long * (region + 1) // regions, long)
        order = np.zeros(len(rows), np.int64)
        among = np.unique(b)
        order[among[sorted(range(len(among)), key=lambda k: words[among[k]])]] = np.arange(len(among))
        best = np.lexsort((order[b], -n[b], a))
        first, counts = np.unique(a[best], return_index=True)[1], np.unique(a, return_counts=True)
        chosen = b[best][first]
        columns = [[words[i] for i in counts[0]], counts[1], [words[i] for i in chosen], n[chosen]]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, NEAR, strict=True)], schema=NEAR)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        tile, width = None, 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (key := row[:5]) != tile:
                    # small tiles are compared together, up to half the size of a large one
                    if 2 * len(rows) >= TILE_WORDS or 2 * len(rows) * max(width, row[0]) >= TILE_CELLS:
                        yield flush(rows)
                        rows, width = [], 0
                    tile = key
                rows.append(row)
                width = max(width, row[0])
        if rows:
            yield flush(rows)

    return run


def near_words(words: DataFrame, regions: int = REGIONS, tile_words: int = TILE_WORDS, tile_cells: int = TILE_CELLS) -> DataFrame:
    """(word, n_near, form, form_n): of each word (word, n; distinct) with near ones their number and the one of largest n,
    of equals the first in code-point order.

    Words meet in buckets of what they share around a possible edit (``bucketed``), and a bucket's words are compared in dense
    tiles; a pair counts in the one bucket in whose part its first difference lies. No pairs leave a tile, only each word's number and best.
    """
    rows = dealt(bucketed(words, regions), tile_words, tile_cells)
    key = ("long", "region", "bucket", "x", "y")
    tiles = rows.repartition(partitions(words), *key).sortWithinPartitions(*key).select(*key, "block", "word", "n")
    near = tiles.mapInArrow(_tiles(regions), "word string, n_near long, form string, form_n long")
    first = F.min(F.struct((-F.col("form_n")).alias("n"), "form"))
    return near.groupBy("word").agg(F.sum("n_near").alias("n_near"), first.alias("first")).select("word", "n_near", "first.form", (-F.col("first.n")).alias("form_n"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): where the forms (word, form) lead from each word, by doubling the steps until none moves. A form is
    more frequent than its word, so there are no circles, and counts of 64 bits allow few steps."""
    now = written(forms.select("word", F.col("form").alias("root")))
    while True:
        on = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        after = written(now.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        drop_written(now)
        now = after.select("word", "root")
        if after.filter("moved").isEmpty():
            return now


def spelling_variants(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", times: int = TIMES, regions: int = REGIONS, tile_words: int = TILE_WORDS, tile_cells: int = TILE_CELLS) -> DataFrame:
    """word, form, root, n, n_near, form_n: each word with the spelling that it most likely stands for.

    Words are the runs of letters of all whole texts (``word_counts``). Two are near if one inserted, deleted or replaced code point
    makes them equal. The form is the near word of largest n, ties to the first in code-point order, if that is at least ``times`` the word's n; the root is
    where forms lead in the end, the word itself without one. Null texts have no words, repeated rows count as often as they stand, null ids
    are empty in the hash; runs of any length are words; an empty table gives no rows; other columns are ignored, whatever their names.
    """
    bounded_batches(docs.sparkSession)
    words = written(word_counts(docs, id_column, text_column))
    near = near_words(words, regions, tile_words, tile_cells)
    good = F.col("form_n") >= times * F.col("n")
    named = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(good, F.col("form")).alias("form"), F.when(good, F.col("form_n")).alias("form_n"))
    named = written(named)
    ends = roots(named.filter("form IS NOT NULL"))
    return named.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def duckdb_sql() -> str:
    return f"""
        WITH RECURSIVE crc AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(i))),
        runs AS (SELECT coalesce(doc_id::VARCHAR, '') AS id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]{{{LEAST_LENGTH},}}')), '{UPPER}', '{LOWER}') AS run FROM documents),
        each AS (SELECT id, run, count(*) AS k FROM runs GROUP BY ALL),
        h AS (SELECT run, k, xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(id || ':' || run, ''), lambda s: CASE WHEN unicode(s) < 128 THEN [unicode(s)::BIGINT] ELSE [192 + (unicode(s) >> 6), 128 + (unicode(s) & 63)]::BIGINT[] END))),
            lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS h FROM each, crc),
        w AS (SELECT CASE WHEN h % {MISSPELT} = 0 THEN substring(run, 1, (h % length(run))::INT) || substring(run, (h % length(run))::INT + 2) ELSE run END AS word, k FROM h),
        words AS (SELECT word, sum(k)::BIGINT AS n FROM w WHERE length(word) >= {LEAST_LENGTH} GROUP BY word HAVING sum(k) >= {LEAST_COUNT}),
        gone AS (SELECT DISTINCT word, i, substring(word, 1, i - 1) || substring(word, i + 1) AS rest FROM (SELECT word, unnest(range(1, length(word) + 1))::INT AS i FROM words)),
        near AS (SELECT a.word, b.word AS other FROM gone a JOIN gone b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
          UNION SELECT a.word, b.word FROM gone a JOIN words b ON a.rest = b.word UNION SELECT b.word, a.word FROM gone a JOIN words b ON a.rest = b.word),
        best AS (SELECT near.word, count(*) AS n_near, first(other ORDER BY o.n DESC, other) AS form, max(o.n) AS form_n FROM near JOIN words o ON near.other = o.word GROUP BY near.word),
        named AS (SELECT words.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= {TIMES} * n THEN form END AS form, CASE WHEN form_n >= {TIMES} * n THEN form_n END AS form_n FROM words LEFT JOIN best ON words.word = best.word),
        way AS (SELECT word, word AS place, 0 AS step FROM named UNION ALL SELECT way.word, named.form, step + 1 FROM way JOIN named ON way.place = named.word WHERE named.form IS NOT NULL)
        SELECT named.word, form, root, n, n_near, form_n FROM named JOIN (SELECT word, arg_max(place, step) AS root FROM way GROUP BY word) r ON named.word = r.word"""
