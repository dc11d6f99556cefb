"""How far a language's sources differ in their terms: joint tables of counts by products of one-hot matrices."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from planweave.llm.common import bounded_batches, partitions, text_bytes, written

#: A term in lower-cased UTF-8: letters of ASCII and whatever lies beyond ASCII.
TERM_BYTES = re.compile(rb"[a-z\x80-\xff]+")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Documents that a term needs, the prior count, the scale of a share, and ranks of terms that are reported.
LEAST_DOCUMENTS, PRIOR, SCALE, TERM_RANKS = 30, 5, 1_000_000_000, 50
#: Terms of a block of rows and groups of a block of columns; most columns that are multiplied at once.
BLOCK_TERMS, BLOCK_GROUPS, COLUMNS = 128, 24, 512

#: Terms of all groups that a task counts before it hands them on.
MOST_TERMS = 400_000

COUNTED = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])
PARTIAL = pa.schema([("lang", pa.string()), ("a", pa.int64()), ("b", pa.int64()), ("value", pa.int64())])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences and documents of a task's terms by group, handed on whenever MOST_TERMS are held."""
    held: dict[tuple[str, str], tuple[Counter[bytes], Counter[bytes]]] = {}

    def flush() -> pa.RecordBatch:
        names, terms, counts, docs = [], [], [], []
        for name, (n, d) in held.items():
            names += [name] * len(n)
            terms += n.keys()
            counts += n.values()
            docs += [d[t] for t in n]
        held.clear()
        columns = [[x for x, _ in names], [x for _, x in names], pa.array(terms, pa.binary()).cast(pa.string()), counts, docs]
        return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, COUNTED, strict=True)], schema=COUNTED)

    for batch in batches:
        for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            # lower() of bytes changes A-Z alone, and every byte of another sign is above those of ASCII
            words = TERM_BYTES.findall(text.as_py().lower())
            n, d = held.setdefault((lang, source), (Counter(), Counter()))
            n.update(words)
            d.update(set(words))
        if sum(len(n) for n, _ in held.values()) >= MOST_TERMS:
            yield flush()
    yield flush()


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences of a group's terms and the group's documents that hold them, summed in
    each task; dealt by lang and term, so that what follows needs no other exchange to sum them up."""
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    counted = docs.select(name("lang"), name("source"), text_bytes("text").alias("text")).mapInArrow(_counted, "lang string, source string, term string, n long, docs long")
    dealt = counted.repartition(partitions(docs), "lang", "term")
    return dealt.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (n + PRIOR) / (total + PRIOR * terms)) in whole numbers of 38 digits."""
    exact = lambda c: c.cast("decimal(20,0)")
    up, down = exact(n + PRIOR) * F.lit(SCALE).cast("decimal(10,0)"), exact(total + PRIOR * terms)
    return F.call_function("div", up, F.greatest(down, F.lit(1).cast("decimal(20,0)"))) + 1


def _priced(group: np.ndarray, level: np.ndarray, price: np.ndarray, term: np.ndarray, rows: int, zero: dict[int, int], left: list[int], right: list[int], columns: int = COLUMNS) -> dict[tuple[int, int], int]:
    """The price of each joint table of a group of ``left`` and one of ``right`` over a block of ``rows`` terms.

    A column stands for a group and a count level; it is 1 in the rows of the terms that the group counts so. The
    product of the transposed columns with each other holds, for each two groups, how many terms have which two
    levels. All entries are at most ``rows``, so products of floats are exact; prices are summed as integers.
    """

    def one_hot(groups: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The matrix (terms by columns), each column's group (its place in ``groups``) and its price."""
        place = {g: i for i, g in enumerate(groups)}
        mine = np.isin(group, groups)
        at = np.array([place[g] for g in group[mine]], np.int64)
        # level 0 of every group first, then the levels that occur
        keys, column = np.unique(np.stack([at, level[mine]], 1), axis=0, return_inverse=True)
        column = column.reshape(-1)
        matrix = np.zeros((rows, len(groups) + len(keys)), np.float32)
        matrix[:, : len(groups)] = 1
        matrix[term[mine], at] = 0
        matrix[term[mine], len(groups) + column] = 1
        prices = np.concatenate([np.array([zero[g] for g in groups], np.int64), np.zeros(len(keys), np.int64)])
        prices[len(groups) + column] = price[mine]
        return matrix, np.concatenate([np.arange(len(groups)), keys[:, 0].astype(np.int64)]), prices

    x, gx, px = one_hot(left)
    y, gy, py = (x, gx, px) if left == right else one_hot(right)
    total = np.zeros((len(left), len(right)), np.int64)
    order = np.argsort(gy, kind="stable")
    y, gy, py = y[:, order], gy[order], py[order]
    starts = np.flatnonzero(np.r_[True, gy[1:] != gy[:-1]])
    for at in range(0, x.shape[1], columns):
        part = slice(at, at + columns)
        joint = np.rint(x[:, part].T @ y).astype(np.int64)
        joint *= np.abs(px[part, None] - py[None, :])
        np.add.at(total, gx[part], np.add.reduceat(joint, starts, axis=1))
    return {(a, b): int(total[i, j]) for i, a in enumerate(left) for j, b in enumerate(right) if a < b}


def joint_prices(cells: DataFrame, heads: DataFrame, block_groups: int, columns: int = COLUMNS) -> DataFrame:
    """(lang, a, b, value): for each two groups a < b of a lang, the sum of differences of their shares over all terms.

    ``cells`` has lang, block, term, g (the group's number), n and p; ``heads`` has a row of g, p (the share of count 0) and rows
    (the block's terms) for each group and block. A block of terms meets each two blocks of groups in one task: at most about
    BLOCK_TERMS rows and twice ``block_groups`` groups.
    """
    band = F.floor(F.col("g") / block_groups)
    none = lambda kind: F.lit(None).cast(kind)
    rows = heads.select("lang", "block", "bands", none("string").alias("term"), "g", none("long").alias("n"), "p", "rows")
    rows = rows.unionByName(cells.select("lang", "block", "bands", "term", "g", "n", "p", none("long").alias("rows")))
    pairs = F.transform(F.sequence(F.lit(0).cast("long"), F.col("bands") - 1), lambda k: F.struct(F.least(band, k).alias("x"), F.greatest(band, k).alias("y")))
    dealt = rows.withColumn("pair", F.explode(pairs)).select("lang", "block", F.col("pair.x").alias("x"), F.col("pair.y").alias("y"), "term", "g", "n", "p", "rows")

    def run(table: pa.Table) -> pa.Table:
        lang, x, y = (table.column(c)[0].as_py() for c in ("lang", "x", "y"))
        head = np.array(table.column("term").is_null())
        group, price = table.column("g").to_numpy(), table.column("p").to_numpy()
        zero = dict(zip(group[head].tolist(), price[head].tolist(), strict=True))
        term = table.column("term").filter(pa.array(~head)).combine_chunks().dictionary_encode().indices.to_numpy()
        count = table.column("rows").filter(pa.array(head))[0].as_py()
        level = table.column("n").filter(pa.array(~head)).to_numpy().astype(np.int64)
        sides = [[g for g in sorted(zero) if g // block_groups == k] for k in (x, y)]
        found = _priced(group[~head], level, price[~head], term, count, zero, *sides, columns)
        flat = [(lang, a, b, v) for (a, b), v in found.items()]
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*flat, strict=True) if flat else [()] * 4, PARTIAL, strict=True)], schema=PARTIAL)

    found = dealt.groupBy("lang", "block", "x", "y").applyInArrow(run, "lang string, a long, b long, value long")
    return found.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def source_divergence(docs: DataFrame, least_documents: int = LEAST_DOCUMENTS, term_ranks: int = TERM_RANKS, block_terms: int = BLOCK_TERMS, block_groups: int = BLOCK_GROUPS, columns: int = COLUMNS) -> DataFrame:
    """lang, source, part, item, value, rank: how far each source of a language is from the others, and its own terms.

    Null text, lang and source are ''. A language keeps the terms of at least ``least_documents`` of its documents. A
    group or language with n occurrences of a kept term, N of all of them and V kept terms has the share
    1 + floor(10^9 * (n + 5) / (N + 5 V)). Part ``pair`` has each other source of the language and the sum of absolute
    differences of shares over the kept terms (0 without any); part ``term`` the ``term_ranks`` terms of a group that exceed their share in
    the language most. Ties go to the smaller item in UTF-8. Repeated rows count as often as they stand; an empty table gives no
    rows; documents of any length are taken whole; columns but text, lang and source are ignored, whatever their names.

    Terms with totals of like size share blocks, dealt by the term's hash, so that a block has few levels; a group's levels
    and shares become one-hot columns, and every joint table of two groups is priced from their product (``_priced``).
    """
    bounded_batches(docs.sparkSession)
    counts = term_counts(docs)
    kept = counts.groupBy("lang", "term").agg(F.sum("n").alias("total"), F.sum("docs").alias("docs")).filter(F.col("docs") >= least_documents)
    kept = kept.select("lang", "term", "total", F.length(F.bin("total")).alias("size"))
    # both sides with all columns, so that one exchange serves both
    cells = written(counts.join(kept, ["lang", "term"]))
    kept = cells.select("lang", "term", "total", "size").distinct()
    of_size = written(kept.groupBy("lang", "size").agg(F.count("*").alias("terms"), F.sum("total").alias("sum")))
    langs = of_size.groupBy("lang").agg(F.sum("terms").alias("terms"), F.sum("sum").alias("lang_n"))
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    groups = docs.select(name("lang"), name("source")).distinct()
    sums = cells.groupBy("lang", "source").agg(F.sum("n").alias("group_n"))
    number = (F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1).cast("long")
    groups = groups.join(sums, ["lang", "source"], "left").join(langs, "lang", "left").fillna(0, ["group_n", "terms", "lang_n"]).withColumn("g", number)
    last = groups.groupBy("lang").agg((F.max("g") + 1).alias("sources"), (F.floor(F.max("g") / block_groups) + 1).alias("bands"))
    groups = written(groups.join(last, "lang"))
    cells = cells.join(groups, ["lang", "source"]).withColumn("p", share(F.col("n"), F.col("group_n"), F.col("terms")))

    own = cells.withColumn("value", F.col("p") - share(F.col("total"), F.col("lang_n"), F.col("terms"))).filter("n > 0 AND value > 0")
    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "term")
    own = own.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= term_ranks)
    out = own.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value", "rank")

    deal = of_size.select("lang", "size", F.ceil(F.col("terms") / block_terms).alias("blocks"))
    block = F.concat_ws("-", "size", F.pmod(F.xxhash64("term"), F.col("blocks"))).alias("block")
    rows = kept.join(deal, ["lang", "size"]).groupBy("lang", block).agg(F.count("*").alias("rows"))
    nothing = share(F.lit(0), F.col("group_n"), F.col("terms"))
    heads = rows.join(groups, "lang").select("lang", "block", "bands", "g", nothing.alias("p"), "rows")
    priced = joint_prices(cells.join(deal, ["lang", "size"]).withColumn("block", block), heads, block_groups, columns)
    # every pair of a lang's sources, also where no term is kept
    one, two = groups.select("lang", "source", "g"), groups.select("lang", F.col("source").alias("item"), F.col("g").alias("h"))
    pairs = one.join(two, "lang").filter("g <> h").withColumn("a", F.least("g", "h")).withColumn("b", F.greatest("g", "h"))
    pairs = pairs.join(priced, ["lang", "a", "b"], "left").withColumn("value", F.coalesce("value", F.lit(0).cast("long")))
    far = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(far).alias("rank")).unionByName(out)


def duckdb_sql() -> str:
    return f"""
        WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
            translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS text FROM documents),
        o AS (SELECT r, lang, source, unnest(regexp_extract_all(text, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d),
        k AS (SELECT lang, term, count(*) AS total FROM o GROUP BY lang, term HAVING count(DISTINCT r) >= {LEAST_DOCUMENTS}),
        l AS (SELECT lang, count(*) AS v, sum(total) AS lang_n FROM k GROUP BY lang),
        c AS (SELECT o.lang, o.source, o.term, count(*) AS n FROM o JOIN k ON o.lang = k.lang AND o.term = k.term GROUP BY ALL),
        g AS (SELECT x.lang, x.source, coalesce((SELECT sum(n) FROM c WHERE c.lang = x.lang AND c.source = x.source), 0) AS group_n FROM (SELECT DISTINCT lang, source FROM d) x),
        m AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
            1 + ({SCALE}::HUGEINT * (coalesce(c.n, 0) + {PRIOR})) // (g.group_n + {PRIOR} * l.v)::HUGEINT AS p,
            1 + ({SCALE}::HUGEINT * (k.total + {PRIOR})) // (l.lang_n + {PRIOR} * l.v)::HUGEINT AS q
          FROM g JOIN l ON g.lang = l.lang JOIN k ON g.lang = k.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
        pv AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM m a JOIN m b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
        pr AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value
          FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pv ON pv.lang = a.lang AND pv.source = a.source AND pv.item = b.source),
        tm AS (SELECT lang, source, 'term' AS part, term AS item, (p - q)::BIGINT AS value FROM m WHERE n > 0 AND p > q),
        z AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM (SELECT * FROM pr UNION ALL SELECT * FROM tm))
        SELECT lang, source, part, item, value, rank FROM z WHERE part = 'pair' OR rank <= {TERM_RANKS}"""
