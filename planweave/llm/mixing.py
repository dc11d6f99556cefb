"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree; DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from planweave.llm.common import WORD, fresh, let, numbered, partitions, written

#: Words that an output shard should hold of the mix, words in a block, and blocks of a source that one window orders.
SHARD_WORDS = 2_000_000
BLOCK_WORDS = 256
WINDOW_BLOCKS = 8_192
#: Levels of the splitting tree that are worked out in one pass over its nodes.
PASS_LEVELS = 6
#: A word with the white space before it.
SPACED_WORD = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"
#: Weights of the sources in code-point order, repeating; the mix's share of all words; most copies of a source.
WEIGHTS = (3.0, 1.0, 2.0)
TOTAL_SHARE = 1.5
MAX_COPIES = 2.0


def ln_factorial(n: Column) -> Column:
    """ln n! by Stirling's series at n + 8, where its error is below 1e-10."""
    m = n + 8.0
    product = n + 1.0
    for i in range(2, 9):
        product = product * (n + float(i))
    return (m + 0.5) * F.ln(m) - m + 0.5 * math.log(2 * math.pi) + 1 / (12 * m) - 1 / (360 * m * m * m) - F.ln(product)


def hypergeometric(n: Column, left: Column, k: Column, u: Column) -> Column:
    """How many of ``k`` blocks, drawn without replacement from ``n``, are among the first ``left`` of them.

    The inverse of the cumulated probabilities at the uniform ``u``, over the numbers within eight standard
    deviations of the mode (all of them, where they are few).
    """

    def spread(v: Column) -> Column:
        n, left, k = v["n"].cast("double"), v["l"].cast("double"), v["k"].cast("double")
        share = left / F.greatest(n, F.lit(1.0))
        return F.sqrt(k * share * (1 - share) * (n - k) / F.greatest(n - 1, F.lit(1.0)))

    def draw(v: Column) -> Column:
        low = F.greatest(F.lit(0), v["k"] - (v["n"] - v["l"]), v["mode"] - v["reach"])
        high = F.least(v["k"], v["l"], v["mode"] + v["reach"])

        def ln_weight(x: Column) -> Column:
            return -(ln_factorial(x) + ln_factorial(v["l"] - x) + ln_factorial(v["k"] - x) + ln_factorial(v["n"] - v["l"] - v["k"] + x))

        def choose(s: Column) -> Column:
            start = F.struct(F.lit(0.0).alias("sum"), F.lit(0).cast("long").alias("at"))
            walk = F.aggregate(s["w"], start, lambda a, w: F.struct((a["sum"] + w).alias("sum"), (a["at"] + F.when(a["sum"] + w < u * s["all"], 1).otherwise(0)).alias("at")))
            return F.least(s["low"] + walk["at"], s["high"])

        weights = let(ln_weight(v["mode"]), lambda top: F.transform(F.sequence(low, high), lambda x: F.exp(ln_weight(x) - top)))
        totals = let(weights, lambda w: F.struct(w.alias("w"), F.aggregate(w, F.lit(0.0), lambda a, x: a + x).alias("all"), low.alias("low"), high.alias("high")))
        return let(totals, choose)

    # the mode as a ratio of doubles, held within the support
    mode = F.floor((k + 1.0) * (left + 1.0) / (n + 2.0)).cast("long")
    inside = F.least(F.greatest(mode, F.lit(0), k - (n - left)), k, left)
    facts = F.struct(n.alias("n"), left.alias("l"), k.alias("k"), inside.alias("mode"))
    return let(facts, lambda v: let(v.withField("reach", F.ceil(8 * spread(v)) + 2), draw))


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) that depends on ``parts`` alone, so reruns agree."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 11) / float(1 << 53)


def source_targets(sizes: DataFrame) -> DataFrame:
    """Per source: source_size and target. Targets share TOTAL_SHARE of all words by weight; none exceeds
    MAX_COPIES of its source. Sources sorted by the level at which they fill up: the first whose level lies
    above the common one sets it. One row a source; nulls are one source, the last.
    """
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    number = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (number - 1) % len(WEIGHTS) + 1)
    sources = sources.select("source", "source_size", weight.alias("weight"), (MAX_COPIES * F.col("source_size")).alias("limit"))
    order = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())
    full = F.coalesce(F.sum("limit").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    weights = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    everything = Window.partitionBy()
    level = (TOTAL_SHARE * F.sum("source_size").over(everything) - full) / weights
    levels = sources.withColumn("level", level).withColumn("open", F.col("level") <= F.col("limit") / F.col("weight"))
    common = F.max(F.when(F.col("open"), F.col("level"))).over(everything)
    target = F.least("limit", F.coalesce(common * F.col("weight"), F.col("limit")))
    return levels.select("source", "source_size", target.alias("target"))


def shard_quotas(counts: DataFrame, levels: int, seed: int = 0) -> DataFrame:
    """(s, shard, quota): how many of each source's blocks (s, n) each of 2**levels shards gets.

    The root of the splitting tree holds all blocks. The left half of a node gets half of the node's blocks, drawn without
    replacement: a multivariate hypergeometric number of each source, worked out source by source from what is left to draw
    and left to draw from; the right half gets the rest. So shards differ by at most one block in size, every source's quotas add up to
    n, and each shard's mix is that of a random draw. A node's numbers are one row, as many as there are sources; nodes are dealt
    over the tasks anew every PASS_LEVELS levels.
    """

    def drawn(level: int) -> Column:
        total = F.aggregate("parts", F.lit(0).cast("long"), lambda a, p: a + p["n"])

        def step(a: Column, p: Column) -> Column:
            u = uniform(F.lit(seed), F.lit(level), F.col("node"), p["s"])
            one = hypergeometric(a["rest"], p["n"], a["draws"], u)
            return let(one, lambda k: F.struct((a["rest"] - p["n"]).alias("rest"), (a["draws"] - k).alias("draws"), F.array_append(a["out"], k).alias("out")))

        def fold(t: Column) -> Column:
            start = F.struct(t.alias("rest"), F.floor(t / 2).cast("long").alias("draws"), F.array().cast("array<bigint>").alias("out"))
            return F.aggregate("parts", start, step)["out"]

        return let(total, fold)

    part = F.struct("s", "n")
    nodes = counts.filter("n > 0").agg(F.array_sort(F.collect_list(part)).alias("parts")).select(F.lit(0).cast("long").alias("node"), "parts")
    for level in range(levels):
        left = F.zip_with("parts", "left", lambda p, k: F.struct(p["s"].alias("s"), k.alias("n")))
        right = F.zip_with("parts", "left", lambda p, k: F.struct(p["s"].alias("s"), (p["n"] - k).alias("n")))
        halves = F.array(F.struct((2 * F.col("node")).alias("node"), left.alias("parts")), F.struct((2 * F.col("node") + 1).alias("node"), right.alias("parts")))
        nodes = nodes.withColumn("left", drawn(level)).select(F.explode(halves).alias("h")).select("h.*")
        if (level + 1) % PASS_LEVELS == 0:
            nodes = written(nodes).repartition(partitions(counts), "node")
    return nodes.select(F.col("node").alias("shard"), F.explode("parts").alias("p")).select("p.s", "shard", F.col("p.n").alias("quota")).filter("quota > 0")


def before(rows: DataFrame, u: str, weight: str, windows: str, ties: list[str], name: str) -> DataFrame:
    """``rows`` with ``name``, the sum of ``weight`` of the rows of the same source ``s`` that come before in the order of
    ``u`` (in [0, 1)) and the ties.

    Rows fall to ``windows`` stretches of u, the column that says how many a source has. Only a stretch is ordered in one task; the
    sums of the stretches before come from their totals, a row a stretch.
    """
    rows = rows.withColumn("__at", F.floor(F.col(u) * F.col(windows)).cast("long"))
    totals = rows.groupBy("s", "__at").agg(F.sum(weight).alias("__sum"))
    so_far = Window.partitionBy("s").orderBy("__at").rowsBetween(Window.unboundedPreceding, 0)
    totals = totals.select("s", "__at", (F.sum("__sum").over(so_far) - F.col("__sum")).alias("__before"))
    inside = Window.partitionBy("s", "__at").orderBy(u, *ties).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("__inside", F.sum(weight).over(inside) - F.col(weight))
    return rows.join(totals, ["s", "__at"]).withColumn(name, F.col("__before") + F.col("__inside")).drop("__at", "__before", "__inside")


def mixed_blocks(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source", seed: int = 0, shard_words: int = SHARD_WORDS, window_blocks: int = WINDOW_BLOCKS, row_column: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The input's rows (row, doc_id, source, size, source_size, target) and the mix's blocks (row, copy, block, words, shard, position).

    A block is up to BLOCK_WORDS words of a text in a copy of it. Whole copies (1, 2) hold all blocks of their source; the rest of its target
    is drawn: blocks in a permuted order, none twice, until it is reached, the last one in part (copy 0). The sum of a source's words is its target, rounded.
    The source's blocks, all copies together, are dealt to shards by the splitting tree's quotas (``shard_quotas``): in another permuted
    order each shard takes as many as its quota, so shards are disjoint and lose none. ``position`` is a block's place
    in its shard's shuffled order.

    A source of a third of all rows is ordered in as many windows as its blocks ask for; a shard's window holds its blocks. Only sizes are
    shuffled, never texts.
    """
    # the text is reduced to its number of words and a hash in the scan
    text = F.col(text_column).cast("string")
    size = F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
    row = F.col(row_column) if row_column else F.monotonically_increasing_id()
    sizes = written(docs.select(F.col(id_column).alias("doc_id"), F.col(source_column).cast("string").alias("source"), size.alias("size"), F.xxhash64(text).alias("content"), row.alias("row")))
    wanted = F.round("target").cast("long")
    copies = F.when(F.col("source_size") > 0, F.floor(wanted / F.greatest("source_size", F.lit(1)))).otherwise(0).cast("long")
    of_size = sizes.groupBy("source").agg(F.sum(F.ceil(F.col("size") / BLOCK_WORDS)).alias("blocks")).withColumnRenamed("source", "of")
    targets = source_targets(sizes).withColumn("copies", copies).withColumn("part", wanted - F.col("copies") * F.col("source_size"))
    # a table of its own, one row a source, worked out once however the joins below are planned
    sources = written(targets.join(of_size, F.col("source").eqNullSafe(F.col("of"))).drop("of").withColumn("s", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))).withColumn("windows", F.greatest(F.lit(1), F.ceil(F.col("blocks") / window_blocks))))
    placed = sizes.join(sources.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))).drop("of")

    block = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("size") - 1) / BLOCK_WORDS).cast("long")))
    pieces = placed.filter("size > 0").select("row", "doc_id", "content", "s", "size", "copies", "part", "windows", block.alias("block"))
    pieces = pieces.withColumn("words", F.least(F.lit(BLOCK_WORDS), F.col("size") - F.col("block") * BLOCK_WORDS))
    of_block = ["doc_id", "content", "block"]
    pieces = before(pieces.withColumn("u", uniform(F.lit(seed + 1), *of_block)), "u", "words", "windows", [*of_block, "row"], "gone")
    drawn = F.greatest(F.lit(0).cast("long"), F.least("words", F.col("part") - F.col("gone")))
    whole = F.transform(F.sequence(F.lit(1).cast("long"), F.col("copies")), lambda c: F.struct(c.alias("copy"), F.col("words").alias("words")))
    whole = F.when(F.col("copies") > 0, whole).otherwise(F.expr("array()").cast("array<struct<copy:bigint,words:bigint>>"))
    taken = F.filter(F.concat(F.array(F.struct(F.lit(0).cast("long").alias("copy"), drawn.alias("words"))), whole), lambda t: t["words"] > 0)
    blocks = written(pieces.withColumn("t", F.explode(taken)).select("row", "doc_id", "content", "s", "size", "windows", "block", "t.copy", "t.words"))

    counts = written(blocks.groupBy("s").agg(F.count("*").alias("n"), F.sum("words").alias("words")))
    total = counts.agg(F.sum("words")).first()[0] or 0
    levels = max(0, math.ceil(math.log2(max(1.0, total / shard_words))), int(math.log2(partitions(docs))))
    quotas = written(shard_quotas(counts.select("s", "n"), levels, seed))
    upto = F.sum("quota").over(Window.partitionBy("s").orderBy("shard").rowsBetween(Window.unboundedPreceding, 0))
    # a shard's stretch of its source's order, in cells about as wide as a stretch
    stretches = quotas.withColumn("end", upto).withColumn("start", F.col("end") - F.col("quota")).join(counts.select("s", F.greatest(F.lit(1), F.floor(F.col("n") / F.lit(1 << levels))).alias("width")), "s")
    cells = stretches.withColumn("cell", F.explode(F.sequence(F.floor(F.col("start") / F.col("width")), F.floor((F.col("end") - 1) / F.col("width")))))
    of_copy = [*of_block, "copy"]
    ranked = before(blocks.withColumn("u", uniform(F.lit(seed + 2), *of_copy)).withColumn("one", F.lit(1)), "u", "one", "windows", [*of_copy, "row"], "rank")
    ranked = ranked.join(counts.select("s", F.greatest(F.lit(1), F.floor(F.col("n") / F.lit(1 << levels))).alias("width")), "s").withColumn("cell", F.floor(F.col("rank") / F.col("width")))
    dealt = ranked.join(cells.select("s", "cell", "start", "end", "shard"), ["s", "cell"]).filter((F.col("start") <= F.col("rank")) & (F.col("rank") < F.col("end")))
    shuffled = Window.partitionBy("shard").orderBy(uniform(F.lit(seed + 3), *of_copy), *of_copy, "row")
    return placed.select("row", "doc_id", "source", "size", "source_size", "target"), dealt.select("row", "copy", "block", "words", "size", "shard", F.row_number().over(shuffled).cast("long").alias("position"))


def mix_sources(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source", seed: int = 0, shard_words: int = SHARD_WORDS, window_blocks: int = WINDOW_BLOCKS) -> DataFrame:
    """One row per input row: doc_id, source, size, source_size, target, taken, shards.

    ``size`` counts the words of the text (null: 0), ``taken`` the words that the mix takes of it, repeats counted, and ``shards`` the
    output shards that hold blocks of it (``mixed_blocks``).
    Null sources are one source, which comes last; null ids and repeated rows are rows like others; an empty
    table gives no rows; other columns are ignored. Rows that agree in id, text and source may change places, all others
    are always mixed alike.
    """
    rows, blocks = mixed_blocks(docs, id_column, text_column, source_column, seed, shard_words, window_blocks)
    taken = blocks.groupBy("row").agg(F.sum("words").alias("taken"), F.count_distinct("shard").alias("shards"))
    zero = F.lit(0).cast("long")
    return rows.join(taken, "row", "left").select("doc_id", "source", "size", "source_size", "target", F.coalesce("taken", zero).alias("taken"), F.coalesce("shards", zero).alias("shards"))


def words_of(text: Column, blocks: Column) -> Column:
    """The words of the blocks (block, words) of a text in the given order, with what stands before each."""
    parts = let(F.regexp_extract_all(text, F.lit(SPACED_WORD), F.lit(0)), lambda w: F.flatten(F.transform(blocks, lambda d: F.slice(w, (d["block"] * BLOCK_WORDS + 1).cast("int"), d["words"].cast("int")))))
    return F.array_join(parts, "")


def mixed_texts(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source") -> DataFrame:
    """The mix as documents: the columns of ``docs``, a row for every copy of a document that the mix takes.

    Blocks of a copy are put together again, whatever their shards; a copy that is taken in part holds the words of its drawn blocks in their order. Documents of which
    nothing is taken go. Rows are told apart by a written number, so ids may be null or repeat.
    """
    names, row = docs.columns, fresh(docs, "__row")
    rows = numbered(docs, row)
    _, blocks = mixed_blocks(rows, id_column, text_column, source_column, row_column=row)
    mix = fresh(rows, "__mix")
    # a copy that holds all words is the text itself
    drawn = F.array_sort(F.collect_list(F.when(F.col("copy") == 0, F.struct("block", "words"))))
    copies = blocks.groupBy("row", "copy", "size").agg(F.sum("words").alias("sum"), drawn.alias("drawn"))
    copies = copies.select(F.col("row").alias(row), F.struct((F.col("sum") == F.col("size")).alias("whole"), "drawn").alias(mix))
    text = F.when(F.col(f"`{mix}`.whole"), F.col(f"`{text_column}`")).otherwise(words_of(F.col(f"`{text_column}`"), F.col(f"`{mix}`.drawn")))
    return rows.join(copies, row).select(*[text.alias(c) if c == text_column else F.col(f"`{c}`") for c in names])


def mixed_shards(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source", seed: int = 0, shard_words: int = SHARD_WORDS) -> DataFrame:
    """The mix as shards: (shard, position, doc_id, source, copy, block, text), a row for every block, to be written by shard in
    the order of position."""
    row = fresh(docs, "__row")
    rows = numbered(docs, row)
    _, blocks = mixed_blocks(rows, id_column, text_column, source_column, seed, shard_words, row_column=row)
    texts = rows.select(F.col(row).alias("row"), F.col(f"`{id_column}`").alias("doc_id"), F.col(f"`{source_column}`").alias("source"), F.col(f"`{text_column}`").alias("text"))
    # a text is parted once, however many of its blocks are taken
    listed = blocks.groupBy("row").agg(F.collect_list(F.struct("shard", "position", "copy", "block", "words")).alias("blocks"))
    parts = texts.join(listed, "row").withColumn("w", F.regexp_extract_all("text", F.lit(SPACED_WORD), F.lit(0)))
    each = F.transform("blocks", lambda b: F.struct(b["shard"].alias("shard"), b["position"].alias("position"), b["copy"].alias("copy"), b["block"].alias("block"), F.array_join(F.slice("w", (b["block"] * BLOCK_WORDS + 1).cast("int"), b["words"].cast("int")), "").alias("text")))
    return parts.select("doc_id", "source", F.explode(each).alias("b")).select("b.shard", "b.position", "doc_id", "source", "b.copy", "b.block", "b.text")
