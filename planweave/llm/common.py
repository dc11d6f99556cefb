"""What the training-data operators share: table reads, written intermediate tables, connected components."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What the pattern [^\x20\x09-\x0D]+ calls a word; Java and Python read it alike.
WORD = r"[^\x20\x09-\x0D]+"
#: Most bytes of a batch that a Python function gets.
BATCH_BYTES = 8 << 20


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's spark.checkpoint.dir.

    Where that is unset, the warehouse takes its place on a cluster, and a temporary folder where driver and
    executors are one process, as in tests.
    """
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if conf:
        return conf.rstrip("/")
    own = spark.conf.get("spark.planweave.shared.dir", None)
    if not own:
        alone = re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master) is not None
        own = "file://" + tempfile.mkdtemp(prefix="planweave-") if alone else f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/planweave-{spark.sparkContext.applicationId}"
        spark.conf.set("spark.planweave.shared.dir", own)
    return own


#: Folders of written tables, for each open block of ``cleared``.
_made: list[list[str]] = []


def written(df: DataFrame, keep: bool = False) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read back: it cuts the lineage and survives lost executors.

    The table stays until ``cleared`` deletes it, and beyond that if it is to be kept.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    for block in [] if keep else _made[-1:]:
        block.append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def cleared(spark: SparkSession) -> Iterator[None]:
    """Tables written within the block are deleted at its end, but for those to be kept, such as its result."""
    _made.append([])
    try:
        yield
    finally:
        for path in _made.pop():
            delete(spark, path)


def numbered(df: DataFrame, name: str = "__row") -> DataFrame:
    """``df`` with a row number, written so that the number stays when a task runs again; ids may be null or repeat."""
    return written(df.withColumn(name, F.monotonically_increasing_id()))


def fresh(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def bounded_batches(spark: SparkSession) -> None:
    """From here on the session's Python functions get at most BATCH_BYTES at a time, however long the texts are."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(str(spark.conf.get(key)).rstrip("b")) > BATCH_BYTES:
        spark.conf.set(key, f"{BATCH_BYTES}b")


@contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Within this block Python functions get that many rows at a time, as whole texts make large batches."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def delete(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def drop_written(df: DataFrame) -> None:
    """Deletes the files of a table made by ``written`` once nothing reads it any more."""
    for file in df.inputFiles()[:1]:
        folder = file.rsplit("/", 1)[0]
        if folder.rsplit("/", 1)[1].startswith("table-"):
            delete(df.sparkSession, folder)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once."""
    return F.transform(F.array(value), body)[0]


def partitions(df: DataFrame) -> int:
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def text_bytes(name: str) -> Column:
    """The text as UTF-8 bytes, null as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit("")).cast("binary")


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges`` (a, b): rows (node, component), component the smallest node reachable.

    Nodes are of any type that Spark orders. Alternating large-star and small-star rounds, until nothing changes: each round only groups and joins edges
    by node, so no component is gathered anywhere. A hot node's neighbours are reduced to their minimum by a
    partial aggregate and joined back, a join that adaptive execution may split.
    """
    both = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct())
    while True:
        # large star: every neighbour larger than the node points to the smallest of node and neighbours
        sides = both.select("a", "b").union(both.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = sides.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = sides.join(least, "a").filter("b > a AND b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # small star: smaller neighbours and the node itself point to the smallest of them
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        small = small.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b"))).distinct()
        after = written(small)
        same = after.join(both, ["a", "b"], "left_anti").isEmpty() and both.join(after, ["a", "b"], "left_anti").isEmpty()
        drop_written(both)
        both = after
        if same:
            break
    return both.select(F.col("a").alias("node"), F.col("b").alias("component")).union(both.select(F.col("b"), F.col("b")).distinct())
