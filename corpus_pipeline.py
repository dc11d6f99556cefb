"""A training corpus in five stages, each a table that the next one reads: toxic documents go, repeated lines go,
one document of each group of near copies stays, sources are mixed to their weights, and sequences are packed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planweave.llm.common import cleared, documents, drop_written, fresh, numbered, written
from planweave.llm.line_dedup import dedup_lines
from planweave.llm.mixing import mixed_texts
from planweave.llm.packing import best_fit_packing
from planweave.llm.queries import tokenizer_file
from planweave.llm.simhash import near_copies
from planweave.llm.toxicity import without_toxic

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.5."""
    return without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later copies of runs of lines; documents of nothing but such lines go."""
    kept = dedup_lines(docs).filter("n_removed = 0 OR n_removed < n_lines")
    return kept.withColumn("n_chars", F.when(F.col("n_removed") == 0, F.col("n_chars")).otherwise(F.length("text"))).select(*COLUMNS)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity 0.8) the row of smallest id; ids may be null or repeat."""
    row = fresh(docs, "__row")
    rows = numbered(docs, row)
    gone = near_copies(rows, row).select(F.col("row").alias(row))
    return rows.join(gone, row, "left_anti").select(*COLUMNS)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for every copy of a document that the mix takes."""
    return mixed_texts(docs).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in their sequences."""
    return best_fit_packing(docs, tokenizer_file())


STAGES = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("simhash_dedup", simhash_dedup),
    ("mixing", mixing),
    ("packing", packing),
]

#: SQL can't express a learned score, a splitting tree of draws or a tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage over what the others kept; a stage's table is deleted once the next one is written."""
    docs = documents(spark, sf_dir)
    for number, (_, stage) in enumerate(STAGES[:-1]):
        with cleared(spark):
            after = written(stage(spark, docs, sf_dir), keep=True)
        if number:
            drop_written(docs)
        docs = after
    return STAGES[-1][1](spark, docs, sf_dir)
