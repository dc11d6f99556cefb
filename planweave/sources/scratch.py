"""Tables written between the rounds of an iterative operator."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_folder(spark: SparkSession) -> str:
    """The folder that the session's spark.checkpoint.dir names, which driver and executors share; the warehouse where it is unset."""
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    return (conf or spark.conf.get("spark.sql.warehouse.dir")).rstrip("/")


class Round:
    """A table written and read back, which cuts the lineage and outlives lost executors; ``drop`` deletes its files."""

    def __init__(self, df: DataFrame) -> None:
        self.spark, self.path = df.sparkSession, f"{scratch_folder(df.sparkSession)}/round-{uuid.uuid4().hex}"
        df.write.parquet(self.path)
        self.table = self.spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(folder, True)
