"""SimHash near-deduplication: fingerprints probed by the generalised pigeonhole principle, then verified."""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from planweave.llm.common import arrow_rows, bounded_batches, components, numbered, partitions, text_bytes, written

SEED = 42
#: Fingerprints on which bit correlations and candidate counts are estimated; every fingerprint is indexed.
SAMPLE = 4_000
#: Texts that a worker gets at a time.
TEXTS = 1_000
#: Members of a bucket that are compared in one step; larger buckets are dealt out in such blocks.
BLOCK = 1_024
#: Bits of two fingerprints together in which texts of a similarity of 0.8 hardly ever differ (mean 19, deviation 4),
#: and others never.
WIDE = 28
#: Bytes of shingle hashes that a block of texts should hold when texts are compared.
BLOCK_BYTES = 2_000_000
#: Estimated cost of one probe row against one compared pair.
PROBE_COST = 40.0


def remixed(h: np.ndarray) -> np.ndarray:
    """Another, independent hash from a hash."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(32))


def fingerprint(text: bytes, width: int) -> int:
    """A bit is 1 if it is set in over half of the shingles' hashes; no words give zero."""
    return fingerprint_pair(text, width, 1)[0]


def shingle_hashes(words: list[bytes], width: int) -> np.ndarray:
    """The hash of every run of ``width`` words, repeats included; fewer words are one run."""
    joined = b" ".join(words)
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    ends = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    starts = itertools.chain((0,), (ends + 1).tolist())
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[i:j], SEED) for i, j in zip(starts, ends[width - 1 :].tolist() + [len(joined)], strict=False)], np.uint64)


def fingerprint_pair(text: bytes, width: int, number: int = 2) -> list[int]:
    """The fingerprint, and with ``number`` 2 another one from remixed hashes."""
    words = text.lower().split()
    if not words:
        return [0] * number
    hashes, out = shingle_hashes(words, width), []
    for k in range(number):
        hashes = remixed(hashes) if k else hashes
        counts = np.zeros(64, np.int64)
        for i in range(0, len(hashes), 1 << 14):
            bits = np.unpackbits(hashes[i : i + (1 << 14)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
            counts += bits.sum(0, dtype=np.int64)
        out.append(int(np.packbits(2 * counts > len(hashes)).view(">u8")[0]))
    return out


def fingerprints(docs: DataFrame, id_column: str, text_column: str, width: int, number: int = 1) -> DataFrame:
    """(id, fp): every whole text's fingerprint as a signed 64-bit number; with ``number`` 2 also fp2, the other one."""
    names = ["fp", "fp2"][:number]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint_pair(t.as_py(), width, number) for t in batch.column(1)], np.uint64).reshape(-1, number).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(np.ascontiguousarray(found[:, k])) for k in range(number))], names=["id", *names])

    content = F.col(text_column) if dict(docs.dtypes)[text_column] == "binary" else text_bytes(text_column)
    return docs.select(F.col(id_column).cast("long").alias("id"), content.alias("text")).mapInArrow(run, "id long, " + ", ".join(f"{c} long" for c in names))


def group_bits(bits: np.ndarray, parts: int) -> list[list[int]]:
    """Deals the 64 bit positions to ``parts``, correlated bits to the same part: a part then holds less
    information than its width says, and the others hold more. Greedy: each part grows by the free bit that
    correlates most with it.
    """
    with np.errstate(all="ignore"):
        correlation = np.abs(np.nan_to_num(np.corrcoef(bits.T.astype(float)))) if len(bits) > 1 else np.zeros((64, 64))
    free, out = set(range(64)), []
    for p in range(parts):
        want = 64 // parts + (p < 64 % parts)
        seed = max(free, key=lambda b: (correlation[b, sorted(free)].sum(), -b))
        part = [seed]
        free.discard(seed)
        while len(part) < want:
            b = max(free, key=lambda b: (correlation[b, part].sum(), -b))
            part.append(b)
            free.discard(b)
        out.append(sorted(part))
    return out


def allocate(cost: list[list[float]], distance: int) -> list[int]:
    """Per-part thresholds (-1: not probed) of least summed cost whose sum is distance - parts + 1.

    If two fingerprints differ in at most ``distance`` bits, some part differs in at most its threshold: else
    they would differ in at least the sum of (threshold + 1) = distance + 1 bits. ``cost[p][t + 1]`` is the
    estimated cost of part p at threshold t. Dynamic programming over parts and the sum of (threshold + 1).
    """
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for row in cost:
        after: dict[int, tuple[float, list[int]]] = {}
        for used, (c, chosen) in best.items():
            for t1, x in enumerate(row):
                s = used + t1
                if s <= distance + 1 and (s not in after or c + x < after[s][0]):
                    after[s] = (c + x, [*chosen, t1 - 1])
        best = after
    return best[distance + 1][1]


def pigeonhole_plan(sample: np.ndarray, n: int, distance: int) -> list[tuple[list[int], int]]:
    """Parts and thresholds for ``n`` fingerprints, of the number of parts whose estimated cost is least."""
    bits = np.unpackbits(sample.view(np.uint64).astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
    best: tuple[float, list[tuple[list[int], int]]] | None = None
    for parts in range(2, distance + 2):
        groups = group_bits(bits, parts)
        cost = []
        for group in groups:
            row, variants = [0.0], 0
            values = bits[:, group].astype(np.int64) @ (1 << np.arange(len(group), dtype=np.int64))
            _, counts = np.unique(values, return_counts=True)
            m = max(2, len(sample))
            # the chance that two fingerprints agree on the part: what the sample shows, else uniform bits
            agree = max(float((counts * (counts - 1)).sum()) / (m * (m - 1)), 2.0 ** -len(group))
            for t in range(distance + 1):
                variants += math.comb(len(group), t)
                row.append(PROBE_COST * n * variants + float(n) * n * agree * variants)
            cost.append(row)
        chosen = allocate(cost, distance)
        total = sum(cost[p][t + 1] for p, t in enumerate(chosen))
        if best is None or total < best[0]:
            best = (total, [(g, t) for g, t in zip(groups, chosen, strict=True) if t >= 0])
    return best[1]


def _keys(plan: list[tuple[list[int], int]]):
    """Index rows (part and its value) and probe rows (every value within the part's threshold) of items, whose
    first column is the fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps, n = np.asarray(batch.column(0)).view(np.uint64), len(batch)
            for p, (group, threshold) in enumerate(plan):
                mask = sum(1 << (63 - b) for b in group)
                own = fps & np.uint64(mask)
                for t in range(threshold + 1):
                    for flips in itertools.combinations(group, t):
                        value = own ^ np.uint64(sum(1 << (63 - b) for b in flips))
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(n, p, np.int32)), pa.array(value.view(np.int64)), pa.array(np.full(n, t > 0)), *batch.columns], names=["part", "value", "probe", *batch.schema.names])

    return run


Items = tuple[np.ndarray, ...]


def is_close(a: Items, x: int, b: Items, distance: int, wide: int | None) -> np.ndarray:
    """Which items of ``b`` differ from ``a``'s item x in at most ``distance`` bits; items that have a second
    fingerprint also count if both together differ in at most ``wide``."""
    bits = np.bitwise_count((b[0] ^ a[0][x]).view(np.uint64))
    close = bits <= distance
    if wide is not None:
        close |= bits.astype(np.int64) + np.bitwise_count((b[1] ^ a[1][x]).view(np.uint64)) <= wide
    return close


def spanning_links(a: Items, b: Items, distance: int, wide: int | None = None) -> Iterator[tuple[int, int]]:
    """Edges that join all close members of two blocks: a spanning forest, never all pairs.

    Items are arrays of fingerprints and perhaps second fingerprints, and are named by them. Every member of one block is compared
    with every member of the other; an edge is only given where it joins
    two parts of the forest, so a block of n members gives fewer than n edges.
    """
    root: dict = {}

    def find(i):
        while (r := root.setdefault(i, i)) != i:
            root[i] = root.setdefault(r, r)
            i = r
        return i

    named = lambda items: items[0].tolist() if len(items) == 1 else list(zip(*(c.tolist() for c in items), strict=True))
    names = named(b)
    for i, x in enumerate(named(a)):
        for j in np.flatnonzero(is_close(a, i, b, distance, wide)).tolist():
            y = names[j]
            if x != y and (r := find(x)) != (s := find(y)):
                root[max(r, s)] = min(r, s)
                yield x, y


def _verify(distance: int, wide: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            half = batch.num_columns // 2
            columns = [(np.asarray(c.values), np.asarray(c.offsets)) for c in batch.columns]
            edges: list = []
            for i in range(len(batch)):
                sides = [values[offsets[i] : offsets[i + 1]] for values, offsets in columns]
                edges += spanning_links(tuple(sides[:half]), tuple(sides[half:]), distance, wide)
            ends = [e[k] for k in (0, 1) for e in [tuple(zip(*edges, strict=True)) or ((), ())]]
            columns = [c for end in ends for c in ([end] if half == 1 else list(zip(*end, strict=True)) or [()] * half)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=ENDS[half])

    return run


#: What the ends of a link are called, by the number of fingerprints.
ENDS = {1: ["a", "b"], 2: ["a", "a2", "b", "b2"]}


def in_blocks(rows: DataFrame, names: list[str]) -> DataFrame:
    """(part, value, block, blocks, and the ``names`` as arrays): each bucket's items in blocks of about BLOCK members."""
    key = ["part", "value"]
    counts = rows.groupBy(*key).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    large = counts.filter("blocks > 1")
    dealt = rows.join(large, key, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("block", F.pmod(F.xxhash64(*names), F.col("blocks")).cast("int"))
    gathered = dealt.groupBy(*key, "block", "blocks").agg(F.collect_list(F.struct(*names)).alias("m"))
    return gathered.select(*key, "block", "blocks", *[F.col(f"m.{c}").alias(c) for c in names])


def links(items: DataFrame, distance: int, wide: int | None = None) -> DataFrame:
    """Edges (a, b) between items whose closure joins all whose fingerprints differ in <= distance bits.

    ``items`` has different rows (fp), or with ``wide`` (fp, fp2), and edges (a, a2, b, b2). Buckets of the
    index (own value of a part) are compared with themselves and with the probes that fall in
    them (values within the part's threshold). Large buckets are dealt out in blocks, compared pair by pair in
    tasks of their own. With ``wide``, items that meet in a bucket are also joined if both fingerprints together
    differ in at most that many bits.
    """
    n = items.count()
    names = ["fp", "fp2"] if wide is not None else ["fp"]
    ends = ENDS[len(names)]
    # those with the smallest hashes are a random sample that reruns repeat
    sample = np.array([r.fp for r in items.select("fp").orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE).collect()], np.int64)
    if n < 2:
        return items.select(*[F.col("fp").alias(c) for c in ends]).filter("false")
    plan = pigeonhole_plan(sample, n, distance)
    keyed = items.select(*names).mapInArrow(_keys(plan), "part int, value long, probe boolean, " + ", ".join(f"{c} long" for c in names))
    index = written(in_blocks(keyed.filter("NOT probe").drop("probe"), names))
    hits = keyed.filter("probe").drop("probe").join(index.select("part", "value").distinct(), ["part", "value"], "left_semi")
    probes = in_blocks(hits, names)
    key, a, b = ["part", "value"], [f"a_{c}" for c in names], [f"b_{c}" for c in names]
    left = index.select(*key, F.col("block").alias("i"), F.col("blocks").alias("n"), *[F.col(c).alias(x) for c, x in zip(names, a, strict=True)])
    right = [F.col("blocks").alias("m"), *[F.col(c).alias(x) for c, x in zip(names, b, strict=True)]]
    own = left.join(index.select(*key, F.col("block").alias("j"), *right), key).filter(F.expr(f"i <= j AND (i < j OR size({a[0]}) > 1)"))
    probed = left.join(probes.select(*key, *right), key)
    pairs = own.select("n", "m", *a, *b).union(probed.select("n", "m", *a, *b))
    # blocks of large buckets are sent to tasks of their own, the others are compared where they met
    large = pairs.filter("n > 1 OR m > 1").select(*a, *b).repartition(partitions(items))
    compared = [p.mapInArrow(_verify(distance, wide), ", ".join(f"{c} long" for c in ends)) for p in (pairs.filter("n = 1 AND m = 1").select(*a, *b), large)]
    return written(compared[0].union(compared[1]))


def simhash_groups(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", width: int = 4, distance: int = 4) -> DataFrame:
    """One row per input row: doc_id, fingerprint (16 hex digits), component_id (smallest id reachable).

    Words are runs other than ASCII white space, after lower-casing A-Z; shingles of ``width`` words, repeats
    included, are hashed by XXH64 (seed 42). A text of fewer words is one shingle; null and texts without words
    have fingerprint zero, linked like any other. Rows of one fingerprint are one class and only classes are
    compared, so copies cost nothing. A row with a null id gets its class's component and never names one;
    component_id is null where no id is reachable. Repeated rows are rows like others; an empty table gives no
    rows; other columns are ignored.
    """
    bounded_batches(docs.sparkSession)
    with arrow_rows(docs.sparkSession, TEXTS):
        rows = written(fingerprints(docs, id_column, text_column, width))
    # a class is named by its smallest id, so that the smallest name of a component holds its id, and no component is gathered
    least = F.min("id")
    classes = written(rows.groupBy("fp").agg(least.alias("least")).select("fp", F.struct(F.col("least").isNull().alias("none"), "least", "fp").alias("name")))
    edges = links(classes.select("fp"), distance)
    edges = edges.join(classes.select(F.col("fp").alias("a"), F.col("name").alias("p")), "a").join(classes.select(F.col("fp").alias("b"), F.col("name").alias("q")), "b")
    joined = components(edges.select(F.col("p").alias("a"), F.col("q").alias("b")))
    # a table of its own, so that both sides of the join below are exchanged for it and a hot fingerprint can be dealt anew
    named = written(classes.join(joined.select(F.col("node.fp").alias("fp"), "component"), "fp", "left").select("fp", F.coalesce("component.least", "name.least").alias("component_id")))
    return rows.join(named, "fp").select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def shingled(rows: DataFrame, texts: DataFrame, width: int) -> DataFrame:
    """``rows`` (numbered by ``row``) with ``shingles``, their texts' sets of shingle hashes as bytes. They are made anew where they are
    needed, as they take as much room as the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.unique(shingle_hashes(t.as_py().lower().split(), width)).tobytes() for t in batch.column(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sets, pa.binary())], names=[*batch.schema.names[:-1], "shingles"])

    names = rows.columns
    schema = StructType([*rows.schema.fields, StructField("shingles", BinaryType())])
    return rows.join(texts.select("row", "text"), "row").select(*names, "text").mapInArrow(run, schema)


def similar_links(rows: list[tuple[int, int, int, int, int, bytes]], distance: int, wide: int, least: float) -> Iterator[tuple[int, int]]:
    """Links that join all similar texts of a block, or of two blocks: a spanning forest of checked links.

    ``rows`` are (side, row, group, fp, fp2, shingles). Of two sides only texts of different sides are compared.
    Each pair within ``distance`` bits of either fingerprint or ``wide`` bits of both is checked, unless checked
    links or the groups already join it.
    """
    side, row, label = (np.array([r[k] for r in rows], np.int64) for k in range(3))
    prints = [np.array([r[k] for r in rows], np.int64) for k in (3, 4)]
    sets: dict[int, set[int]] = {}

    def shingles(i: int) -> set[int]:
        if i not in sets:
            sets[i] = set(np.frombuffer(rows[i][5], np.uint64).tolist())
        return sets[i]

    crossed = len(rows) > 0 and (side != side[0]).any()
    for x in range(len(rows) - 1):
        bits = [np.bitwise_count((f[x + 1 :] ^ f[x]).view(np.uint64)).astype(np.int64) for f in prints]
        near = (np.minimum(*bits) <= distance) | (bits[0] + bits[1] <= wide)
        near &= label[x + 1 :] != label[x]
        if crossed:
            near &= side[x + 1 :] != side[x]
        for y in (np.flatnonzero(near) + x + 1).tolist():
            small, large = sorted((len(rows[x][5]), len(rows[y][5])))
            if label[x] == label[y] or small < least * large:
                continue
            common = len(shingles(x) & shingles(y))
            if common >= least * ((small + large) // 8 - common):
                label[label == label[y]] = label[x]
                yield int(row[x]), int(row[y])


def _check_blocks(distance: int, wide: int, least: float):
    """Links of each job (spot, i, j), whose rows follow each other; a worker holds one job at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        job, held = None, []

        def flush() -> pa.RecordBatch:
            found = list(similar_links(held, distance, wide, least))
            return pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

        for batch in batches:
            for spot, i, j, *rest in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (spot, i, j) != job:
                    if len(held) > 1:
                        yield flush()
                    job, held = (spot, i, j), []
                held.append(tuple(rest))
        if len(held) > 1:
            yield flush()

    return run


def checked_links(jobs: DataFrame, distance: int, wide: int, similarity: float) -> DataFrame:
    """(a, b), written: the links of all jobs; ``jobs`` has spot, i, j, side, row, group, fp, fp2 and shingles."""
    key = ["spot", "i", "j"]
    dealt = jobs.select(*key, "side", "row", "group", "fp", "fp2", "shingles").repartition(partitions(jobs), *key).sortWithinPartitions(*key, "side", "row")
    with arrow_rows(jobs.sparkSession, TEXTS):
        return written(dealt.mapInArrow(_check_blocks(distance, wide, similarity), "a long, b long"))


def in_parts(members: DataFrame, key: list[str]) -> DataFrame:
    """``members`` with ``part``, the block it is dealt to, and ``n_parts`` of its key, by number and by size of texts."""
    number = F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("size") / BLOCK_BYTES)).cast("int")
    sizes = members.groupBy(*key).agg(number.alias("n_parts"))
    return members.join(sizes, key).withColumn("part", F.pmod(F.xxhash64("row"), F.col("n_parts")).cast("int"))


def similar_pairs(members: DataFrame, texts: DataFrame, width: int, distance: int, wide: int, similarity: float) -> DataFrame:
    """(a, b): checked links whose closure joins all similar texts of a spot; ``members`` has spot, row, fp, fp2 and size.

    A spot's texts are first checked block by block. Where a spot has several blocks, its largest group of
    linked texts needs no more checks within itself: the other texts are checked block by block against each
    other and against that group, so a hot spot of true copies costs few checks.
    """
    dealt = written(in_parts(members, ["spot"]))
    same = shingled(dealt.select("spot", "row", "fp", "fp2", "part"), texts, width)
    same = same.select("*", F.col("part").alias("i"), F.col("part").alias("j"), F.lit(0).alias("side"), F.col("row").alias("group"))
    first = checked_links(same, distance, wide, similarity)
    large = dealt.filter("n_parts > 1").drop("part", "n_parts")
    if large.isEmpty():
        return first
    grouped = large.join(components(first), F.col("row") == F.col("node"), "left").withColumn("group", F.coalesce("component", "row")).drop("node", "component")
    largest = grouped.groupBy("spot", "group").agg(F.count("*").alias("n")).groupBy("spot").agg(F.max_by("group", F.struct("n", "group")).alias("main"))
    split = grouped.join(largest, "spot").withColumn("other", F.col("group") != F.col("main")).drop("main")
    placed = written(in_parts(split, ["spot", "other"]))
    counts = placed.filter("other").groupBy("spot").agg(F.first("n_parts").alias("n_others"))
    blocks = placed.filter("NOT other").groupBy("spot").agg(F.first("n_parts").alias("n_main"))
    if counts.isEmpty():
        return first
    with_sets = written(shingled(placed.join(counts.select("spot"), "spot", "left_semi"), texts, width))
    spread = with_sets.join(counts, "spot").withColumn("at", F.explode(F.sequence(F.lit(0), F.col("n_others") - 1)))
    # others meet others in the jobs (smaller block, larger block), the largest group in the jobs (block, -1 - its block)
    others = spread.filter("other").select("*", F.least("part", "at").alias("i"), F.greatest("part", "at").alias("j"), F.col("part").alias("side"))
    main = spread.filter("NOT other").select("*", F.col("at").alias("i"), (-1 - F.col("part")).alias("j"), F.lit(1).alias("side"))
    facing = with_sets.filter("other").join(blocks, "spot").withColumn("at", F.explode(F.sequence(F.lit(0), F.col("n_main") - 1)))
    facing = facing.select("*", F.col("part").alias("i"), (-1 - F.col("at")).alias("j"), F.lit(0).alias("side"))
    columns = ["spot", "i", "j", "side", "row", "group", "fp", "fp2", "shingles"]
    jobs = others.select(*columns).unionByName(main.select(*columns)).unionByName(facing.select(*columns))
    return first.unionByName(checked_links(jobs, distance, wide, similarity))


def close_classes(classes: DataFrame, distance: int, wide: int) -> DataFrame:
    """(a, b): links between classes, named by their smallest rows, whose closure joins all candidates: classes of
    equal fingerprints, and those that the probes of either fingerprint bring together and find close."""
    heads = written(classes.groupBy("fp", "fp2").agg(F.min("least").alias("name")))
    within = classes.join(heads, ["fp", "fp2"]).filter("least <> name").select(F.col("name").alias("a"), F.col("least").alias("b"))
    first = links(heads, distance, wide)
    second = links(heads.select(F.col("fp2").alias("fp"), F.col("fp").alias("fp2")), distance, wide)
    both = first.unionByName(second.select(F.col("a2").alias("a"), F.col("a").alias("a2"), F.col("b2").alias("b"), F.col("b").alias("b2")))
    end = lambda x, name: heads.select(F.col("fp").alias(x), F.col("fp2").alias(f"{x}2"), F.col("name").alias(name))
    named = both.join(end("a", "p"), ["a", "a2"]).join(end("b", "q"), ["b", "b2"])
    return within.unionByName(named.select(F.col("p").alias("a"), F.col("q").alias("b")))


def near_copies(docs: DataFrame, row_column: str, id_column: str = "doc_id", text_column: str = "text", width: int = 5, distance: int = 8, similarity: float = 0.8, wide: int = WIDE) -> DataFrame:
    """(row, id, keep): rows that are exact or near copies of another row of their group, and the id of the row that stays.

    Texts of equal bytes are one class. Each text has two independent fingerprints; classes that differ in
    ``distance`` bits or fewer of either are candidates, and so are classes that the probes bring together and that differ in
    ``wide`` bits or fewer of both: the probes of a smaller distance meet most pairs of a larger one. Candidates are
    linked if their sets of ``width``-word shingles (as
    64-bit hashes) have a Jaccard similarity of ``similarity`` or more; groups are the connected classes. The
    closure of candidates parts the classes into spots; within a spot every candidate pair is checked
    unless checked links already join it, so no link is lost however dense the spot is.
    ``row_column`` numbers the rows; ids may be null or repeat. Of each group the row of smallest id stays, null
    ids last, and of those the smallest row number.
    """
    bounded_batches(docs.sparkSession)
    texts = docs.select(F.col(row_column).alias("row"), F.col(id_column).cast("long").alias("id"), text_bytes(text_column).alias("text"))
    hashed = texts.select("row", F.col("id").alias("doc"), F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2"), F.octet_length("text").alias("size"))
    with arrow_rows(docs.sparkSession, TEXTS):
        rows = written(fingerprints(texts, "row", "text", width, 2).withColumnRenamed("id", "row").join(hashed, "row"))
    # the row of a class that would stay is its name, so that the smallest name of a group is the row that does
    first = F.min(F.struct(F.col("doc").isNull().alias("none"), "doc", "row")).alias("name")
    classes = written(rows.groupBy("h1", "h2", "fp", "fp2").agg(F.min("row").alias("least"), F.max("size").alias("size"), first))
    spots = components(close_classes(classes.select("fp", "fp2", "least"), distance, wide))
    members = classes.join(spots, F.col("least") == F.col("node")).select(F.col("component").alias("spot"), F.col("least").alias("row"), "fp", "fp2", "size")
    with arrow_rows(docs.sparkSession, TEXTS):
        found = similar_pairs(members, texts, width, distance, wide, similarity)
    found = found.join(classes.select(F.col("least").alias("a"), F.col("name").alias("p")), "a").join(classes.select(F.col("least").alias("b"), F.col("name").alias("q")), "b")
    joined = components(found.select(F.col("p").alias("a"), F.col("q").alias("b")))
    stays = written(classes.join(joined, F.col("name") == F.col("node"), "left").select("h1", "h2", F.coalesce("component", "name").alias("first")))
    return rows.join(stays, ["h1", "h2"]).filter("row <> first.row").select("row", F.col("doc").alias("id"), F.col("first.doc").alias("keep"))


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", width: int = 5, distance: int = 8, similarity: float = 0.8) -> DataFrame:
    """(id, keep): a row for each row of ``near_copies``, for any table; a null or repeated id does not tell which."""
    rows = numbered(docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).cast("string").alias("text")))
    return near_copies(rows, "__row", "doc_id", "text", width, distance, similarity).select("id", "keep")
