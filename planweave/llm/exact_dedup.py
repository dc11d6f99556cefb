"""Exact deduplication by Grace hashing: partition by content hash until a bucket fits a table of complete contents."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planweave.llm.common import bounded_batches, partitions, text_bytes, written

#: Most bytes of distinct content that a bucket should hold, and hash bits by which records are parted each time.
BUCKET_BYTES = 32 << 20
STEP_BITS = 8
#: How many times smaller than that a bucket of even hashes should be at first.
EVEN = 16


class ContentTable:
    """An open-addressing table keyed by complete contents: linear probing from a content's hash.

    A slot holds an entry's number; a probe compares the stored hash first and then every byte.
    """

    def __init__(self) -> None:
        self.clear()

    def clear(self) -> None:
        self.slots, self.mask, self.bytes = [-1] * 64, 63, 0
        self.hashes: list[int] = []
        self.contents: list[bytes] = []

    def add(self, content: bytes, hashed: int) -> int:
        """The number of the entry with this content, a new one if there is none."""
        slot = hashed & self.mask
        while (entry := self.slots[slot]) >= 0:
            if self.hashes[entry] == hashed and self.contents[entry] == content:
                return entry
            slot = (slot + 1) & self.mask
        self.slots[slot] = entry = len(self.contents)
        self.hashes.append(hashed)
        self.contents.append(content)
        self.bytes += len(content) + 100
        if 2 * len(self.contents) > self.mask:
            self.mask = 2 * self.mask + 1
            self.slots = [-1] * (self.mask + 1)
            for i, h in enumerate(self.hashes):
                slot = h & self.mask
                while self.slots[slot] >= 0:
                    slot = (slot + 1) & self.mask
                self.slots[slot] = i
        return entry


#: A row per different content of a task (with content) and per further record of it (without).
RECORD = pa.schema([("entry", pa.int64()), ("row", pa.int64()), ("id", pa.int64()), ("hash", pa.int64()), ("size", pa.int64()), ("content", pa.binary())])
ENTRY = pa.schema([("entry", pa.int64()), ("group", pa.int64()), ("text_sha256", pa.string())])


def _collapse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """On the map side: the first record of each content of a task is the entry that the task's others belong to."""
    table, first = ContentTable(), []
    for batch in batches:
        rows, ids, hashes = (batch.column(i).to_pylist() for i in range(3))
        entries, contents = [], []
        for row, hashed, content in zip(rows, hashes, batch.column(3), strict=True):
            content = content.as_py().lower()
            if (entry := table.add(content, hashed)) == len(first):
                first.append(row)
                contents.append(content)
            else:
                contents.append(None)
            entries.append(first[entry])
        yield pa.RecordBatch.from_arrays([pa.array(entries, pa.int64()), batch.column(0), batch.column(1), batch.column(2), pa.array([None if c is None else len(c) for c in contents], pa.int64()), pa.array(contents, pa.binary())], schema=RECORD)
        if table.bytes > BUCKET_BYTES:
            table.clear()
            first.clear()


def _bucketed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come bucket by bucket; one bucket's different contents are held at a time. Entries of equal contents get
    the first one's number as their group."""
    table, groups, digests, current = ContentTable(), [], [], None
    for batch in batches:
        found: list[tuple[int, int, str]] = []
        for bucket, hashed, entry, content in zip(*(batch.column(i).to_pylist() for i in range(3)), batch.column(3), strict=True):
            if bucket != current:
                table.clear()
                groups.clear()
                digests.clear()
                current = bucket
            content = content.as_py()
            at = table.add(content, hashed)
            if at == len(groups):
                groups.append(entry)
                digests.append(hashlib.sha256(content).hexdigest())
            found.append((entry, groups[at], digests[at]))
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found, strict=True) if found else [()] * 3, ENTRY, strict=True)], schema=ENTRY)


def parted(contents: DataFrame, bucket_bytes: int, step_bits: int = STEP_BITS) -> Iterator[DataFrame]:
    """``contents`` with ``bucket``, in tables of buckets that fit.

    The records are parted by the leading bits of their hash, at first by as many as their sum asks for if hashes were even. Buckets that hold more than ``bucket_bytes`` of
    different hashes' contents are written to spill files in the shared folder and parted again by further bits,
    they alone, until none is left; a bucket of one hash can't be parted and is as large as that content.
    """
    total = contents.agg(F.sum("size")).first()[0] or 0
    rest, bits = contents, min(64, max(step_bits, math.ceil(math.log2(max(1.0, EVEN * total / bucket_bytes)))))
    while True:
        rest = rest.withColumn("bucket", F.shiftrightunsigned("hash", 64 - bits))
        # a content that several tasks hold counts once
        sizes = rest.groupBy("bucket", "hash").agg(F.max("size").alias("size"))
        large = sizes.groupBy("bucket").agg(F.sum("size").alias("size"), F.count("*").alias("n")).filter((F.col("size") > bucket_bytes) & (F.col("n") > 1)).select("bucket")
        large = written(large)
        if bits >= 64 or large.isEmpty():
            yield rest
            return
        yield rest.join(large, "bucket", "left_anti")
        rest, bits = written(rest.join(large, "bucket", "left_semi").drop("bucket")), min(64, bits + step_bits)


def exact_dedup(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", bucket_bytes: int = BUCKET_BYTES, step_bits: int = STEP_BITS) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are identical after lower-casing A-Z; null is the empty text. Of equal texts
    the largest id stays. Ids of null lose to any other; where all are null, keep_id is null. Of rows that
    repeat an id and a text exactly one is kept. An empty table gives no
    rows. Other columns of ``docs`` are ignored, whatever their names.

    Records are written once, with each task's copies of a content collapsed to one entry. Their contents are
    parted by a 64-bit hash, again and again where a bucket doesn't fit, and each bucket's complete contents are compared in an
    open-addressing table, which gives every entry its group. Records find their group's best row and size through their entry,
    so a hot text is spread over as many entries as tasks saw it.
    """
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_column).cast("long").alias("id"), text_bytes(text_column).alias("content"))
    # lower() joins at least what lower-casing A-Z joins, so equal texts share a hash
    rows = rows.select("row", "id", F.xxhash64(F.lower(F.col("content").cast("string"))).alias("hash"), "content")
    records = written(rows.mapInArrow(_collapse, "entry long, row long, id long, hash long, size long, content binary"))
    groups = None
    for table in parted(records.filter("content IS NOT NULL").select("entry", "hash", "size", "content"), bucket_bytes, step_bits):
        dealt = table.select("bucket", "hash", "entry", "content").repartition(partitions(docs), "bucket").sortWithinPartitions("bucket")
        found = dealt.mapInArrow(_bucketed, "entry long, group long, text_sha256 string")
        groups = found if groups is None else groups.unionByName(found)
    groups = written(groups)
    # of an entry's records, which stand in one task's output, the best and their number; then of each group's entries
    kept = F.struct(F.col("id").isNotNull().alias("known"), "id", (-F.col("row")).alias("order"))
    counted = records.groupBy("entry").agg(F.max(kept).alias("best"), F.count("*").alias("n"))
    totals = groups.join(counted, "entry").groupBy("group").agg(F.max("best").alias("best"), F.sum("n").alias("n"))
    of_entry = groups.join(totals, "group").select("entry", F.col("best.id").alias("keep_id"), (-F.col("best.order")).alias("keep_row"), "n", "text_sha256")
    joined = records.select("entry", "row", "id").join(of_entry, "entry")
    return joined.select(F.col("id").alias("doc_id"), "keep_id", F.col("n").alias("group_size"), (F.col("row") == F.col("keep_row")).alias("kept"), "text_sha256")
