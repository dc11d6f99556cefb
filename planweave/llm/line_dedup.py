"""Line deduplication: a suffix array over line numbers by distributed prefix doubling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from planweave.llm.common import WORD, drop_written, fresh, written

#: Fewest words of a repeated run of lines whose later copies are deleted.
LEAST_WORDS = 8
PLACE = ["doc", "text_hash", "at"]


def line_keys(line: str) -> tuple[Column, Column]:
    """Two hashes of a line that don't depend on each other: the second starts from a constant's hash."""
    return F.xxhash64(line), F.xxhash64(F.lit(1), line)


def line_rows(docs: DataFrame) -> DataFrame:
    """(doc, text_hash, at, words, k1, k2): every line of every whole text, by 128 bits of hash."""
    k1, k2 = line_keys("line")
    lines = docs.select("doc", "text_hash", F.posexplode(F.split("text", "\n", -1)).alias("at", "line"))
    words = F.regexp_count("line", F.lit(WORD)).cast("long")
    return lines.select(*PLACE, words.alias("words"), k1.alias("k1"), k2.alias("k2"))


def ranked(suffixes: DataFrame, keys: list[str]) -> DataFrame:
    """The different suffixes whose ``keys`` another one shares, with ``rank``, their number in the order of the keys.

    The distinct keys are sorted by range and numbered by partition and place, so no task sees them all. Equal
    ranks are an interval of the suffix array whose longest common prefix is at least the keys' run of lines.
    """
    position = F.struct(*PLACE)
    classes = suffixes.groupBy(*keys).agg(F.min(position).alias("first"), F.max(position).alias("last")).filter("first <> last").select(*keys)
    # written, as a number must not change when a task runs again
    table = written(classes.orderBy(*keys).withColumn("rank", F.monotonically_increasing_id()))
    level = written(suffixes.join(table, keys).drop(*keys).distinct())
    drop_written(table)
    return level


def least_windows(level: DataFrame, least_words: int) -> DataFrame:
    """(doc, text_hash, start, end): the shortest windows of repeated lines with ``least_words`` words that begin
    at each line, and those that end there.

    A later copy with enough words is the union of such windows within it: of a line in it, the lines up to it
    hold a window that ends there, or else the window from the copy's first line reaches it. So these windows are
    all that needs to be looked up. Lines are laid out by the number of words before them in their stretch of
    repeated lines, and the line that holds a given word is the last one that begins at or before it.
    """
    order = Window.partitionBy("doc", "text_hash").orderBy("at")
    stretch = level.select(*PLACE, "words", (F.col("at") - F.row_number().over(order)).alias("stretch"))
    so_far = Window.partitionBy("doc", "text_hash", "stretch").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    laid = stretch.withColumn("end", F.sum("words").over(so_far)).withColumn("begin", F.col("end") - F.col("words"))
    # each line, the word that a window from it must reach, and the word that a window up to it must begin with
    line = F.struct(F.col("begin").alias("key"), F.when(F.col("words") > 0, 0).alias("kind"))
    ahead = F.struct((F.col("begin") + (least_words - 1)).alias("key"), F.lit(1).alias("kind"))
    back = F.struct((F.col("end") - least_words).alias("key"), F.lit(2).alias("kind"))
    asked = laid.withColumn("ask", F.explode(F.array(line, ahead, back))).filter("ask.kind IS NOT NULL AND ask.key >= 0")
    asked = asked.select("doc", "text_hash", "stretch", "at", "end", "ask.key", "ask.kind")
    before = Window.partitionBy("doc", "text_hash", "stretch").orderBy("key", "kind", "at").rowsBetween(Window.unboundedPreceding, 0)
    holder = F.last(F.when(F.col("kind") == 0, F.struct("at", "end")), ignorenulls=True).over(before)
    found = asked.withColumn("holder", holder).filter("kind > 0 AND holder.end > key")
    start = F.when(F.col("kind") == 1, F.col("at")).otherwise(F.col("holder.at"))
    end = F.when(F.col("kind") == 1, F.col("holder.at")).otherwise(F.col("at")) + 1
    return found.select("doc", "text_hash", start.alias("start"), end.alias("end")).distinct()


def later_windows(lines: DataFrame, least_words: int) -> DataFrame | None:
    """(doc, text_hash, start, end): windows of lines that also begin earlier; their unions are the later copies of
    maximal repeated runs.

    Prefix doubling ranks the suffixes by their first 1, 2, 4, ... lines, up to the longest window. Two windows of
    n lines are equal if they agree in the ranks of their first and of their last 2**j lines, 2**j the largest
    power of two in n: they stand in one interval of the suffix array with a common prefix of n lines or more.
    """
    levels = [ranked(lines, ["k1", "k2"])]
    windows = written(least_windows(levels[0], least_words))
    longest = windows.agg(F.max(F.col("end") - F.col("start"))).first()[0]
    if not longest:
        return None
    while 1 << len(levels) <= longest:
        length = 1 << (len(levels) - 1)
        last = levels[-1]
        here = last.select(*PLACE, F.col("rank").alias("head"))
        there = last.select("doc", "text_hash", (F.col("at") - length).alias("at"), F.col("rank").alias("tail"))
        levels.append(ranked(here.join(there, PLACE), ["head", "tail"]))
    ranks = levels[0].select(F.lit(0).alias("level"), *PLACE, "rank")
    for j, level in enumerate(levels[1:], 1):
        ranks = ranks.unionByName(level.select(F.lit(j).alias("level"), *PLACE, "rank"))
    length = (F.col("end") - F.col("start")).cast("int")
    level = sum((length >= 1 << j).cast("int") for j in range(1, len(levels))) if len(levels) > 1 else F.lit(0)
    asked = windows.withColumn("length", length).withColumn("level", level)
    asked = asked.withColumn("tail_at", F.expr("end - shiftleft(1, level)"))
    key = ["level", "doc", "text_hash"]
    asked = asked.join(ranks.select(*key, F.col("at").alias("start"), F.col("rank").alias("head")), [*key, "start"])
    asked = asked.join(ranks.select(*key, F.col("at").alias("tail_at"), F.col("rank").alias("tail")), [*key, "tail_at"])
    asked = asked.select("doc", "text_hash", "start", "end", "length", "head", "tail")
    same, position = ["length", "head", "tail"], F.struct("doc", "text_hash", "start")
    # a table of its own, so that the join below has an exchange of its own, which can be dealt anew where a window is very common
    first = written(asked.groupBy(*same).agg(F.min(position).alias("first"), F.count("*").alias("n")).filter("n > 1"))
    return asked.join(first, same).filter(position > F.col("first")).select("doc", "text_hash", "start", "end")


def deleted_runs(lines: DataFrame, least_words: int) -> DataFrame | None:
    """(doc, text_hash, runs): the maximal runs of lines to delete, as an array of (start, end), end excluded."""
    runs = later_windows(lines, least_words)
    if runs is None:
        return None
    runs = runs.groupBy("doc", "text_hash", "start").agg(F.max("end").alias("end"))
    order = Window.partitionBy("doc", "text_hash").orderBy("start")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.withColumn("run", F.sum(F.coalesce((F.col("start") > reach).cast("int"), F.lit(0))).over(order))
    merged = runs.groupBy("doc", "text_hash", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return merged.groupBy("doc", "text_hash").agg(F.collect_list(F.struct("start", "end")).alias("runs"))


def without(lines: Column, runs: Column) -> Column:
    return F.filter(lines, lambda _, i: ~F.exists(runs, lambda r: (r["start"] <= i) & (i < r["end"])))


def dedup_lines(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", least_words: int = LEAST_WORDS) -> DataFrame:
    """The input's columns with shortened texts, and n_lines, n_removed and longest_run (all long).

    Lines stand between line feeds. A maximal run of lines of any number with at least ``least_words`` words is a
    later copy if the same lines also start earlier: in a document of smaller id, or earlier in the same one. All
    lines of later copies go. ``longest_run`` is the most lines deleted in a row. Runs are judged on the
    input, overlaps count, and never cross documents.

    A null text stays null and has no lines; an empty one has one line, which never goes. A null id comes
    before all others. Rows that repeat an id and a text are one document, each gets the same text. Ties between
    different texts of one id are ordered by the texts' hashes. An empty table gives no rows. Columns of ``docs``
    that are called like the added ones are replaced.
    """
    names = [c for c in docs.columns if c not in ("n_lines", "n_removed", "longest_run")]
    row = F.struct(F.lit(0).alias(fresh(docs, "__none")), *[F.col(f"`{c}`") for c in names if c != text_column]).alias("__row")
    doc = F.coalesce(F.col(id_column).cast("long"), F.lit(-(1 << 63))).alias("doc")
    keyed = docs.select(row, doc, F.xxhash64(text_column).alias("text_hash"), F.col(text_column).cast("string").alias("text"))
    lines = line_rows(keyed.filter(F.col("text").isNotNull()))
    runs = deleted_runs(lines, least_words)
    if runs is None:
        joined = keyed.withColumn("runs", F.expr("array()").cast("array<struct<start:int,end:int>>"))
    else:
        joined = keyed.join(runs, ["doc", "text_hash"], "left").withColumn("runs", F.coalesce("runs", F.expr("array()").cast(runs.schema["runs"].dataType)))
    size = F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n", -1)))
    total = F.aggregate("runs", F.lit(0).cast("long"), lambda a, r: a + (r["end"] - r["start"]))
    longest = F.coalesce(F.array_max(F.transform("runs", lambda r: r["end"] - r["start"])), F.lit(0))
    left = F.when(F.size("runs") == 0, F.col("text")).otherwise(F.array_join(without(F.split("text", "\n", -1), F.col("runs")), "\n"))
    columns = [left.alias(c) if c == text_column else F.col(f"__row.`{c}`").alias(c) for c in names]
    return joined.select(*columns, size.cast("long").alias("n_lines"), total.alias("n_removed"), longest.cast("long").alias("longest_run"))


def duckdb_sql(least_words: int = LEAST_WORDS) -> str:
    """The digest columns by DuckDB: it compares the windows' lines themselves and knows no ranks."""
    return f"""
        WITH t AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents WHERE text IS NOT NULL),
        l AS (SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS spot FROM t),
        w AS (SELECT doc_id, spot, len(regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+')) AS words FROM l),
        p AS (SELECT doc_id, spot, words, sum(words) OVER (PARTITION BY doc_id ORDER BY spot) AS upto FROM w),
        b AS (SELECT doc_id, spot, upto - words AS begins, upto FROM p WHERE words > 0),
        f AS (SELECT q.doc_id, q.spot AS s, b.spot + 1 AS e FROM (SELECT doc_id, spot, upto - words + {least_words - 1} AS k FROM p) q ASOF JOIN b ON q.doc_id = b.doc_id AND q.k >= b.begins WHERE b.upto > q.k),
        r AS (SELECT q.doc_id, b.spot AS s, q.spot + 1 AS e FROM (SELECT doc_id, spot, upto - {least_words} AS k FROM p) q ASOF JOIN b ON q.doc_id = b.doc_id AND q.k >= b.begins WHERE q.k >= 0),
        c AS (SELECT doc_id, s, e, lines[s + 1:e] AS content FROM (FROM f UNION FROM r) JOIN t USING (doc_id)),
        later AS (SELECT doc_id, s AS spot, max(e) AS e FROM (SELECT *, row_number() OVER (PARTITION BY content ORDER BY doc_id, s) AS k FROM c) WHERE k > 1 GROUP BY ALL),
        reach AS (SELECT doc_id, spot, line, max(e) OVER (PARTITION BY doc_id ORDER BY spot) > spot AS gone FROM l LEFT JOIN later USING (doc_id, spot)),
        d AS (SELECT doc_id, spot, line, coalesce(gone, false) AS gone, spot - row_number() OVER (PARTITION BY doc_id, coalesce(gone, false) ORDER BY spot) AS run FROM reach),
        g AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, count(*) AS n_lines, coalesce(string_agg(line, chr(10) ORDER BY spot) FILTER (NOT gone), '') AS kept FROM d GROUP BY doc_id),
        m AS (SELECT doc_id, max(c) AS longest_run FROM (SELECT doc_id, run, count(*) AS c FROM d WHERE gone GROUP BY ALL) GROUP BY doc_id)
        SELECT documents.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, coalesce(longest_run, 0) AS longest_run,
          sha256(coalesce(kept, '')) AS kept_sha256
        FROM documents LEFT JOIN g USING (doc_id) LEFT JOIN m USING (doc_id)"""
