"""Tables that cut lineage: written in the folder that spark.checkpoint.dir names, read back with their real size, deleted when a computation is over."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

LOCAL_DEFAULT = "file:///tmp/checkpoints"


def folder(spark: SparkSession) -> str:
    """The shared folder's URI; a local session without one uses its machine's own."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors see")
        base = LOCAL_DEFAULT
    return base.rstrip("/") if ":" in base.partition("/")[0] else f"file://{base.rstrip('/')}"


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a folder or file on any file system that Spark knows."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


class Scratch:
    """Written steps of an iteration: ``cut`` writes a frame, ``drop`` deletes one that is no longer read; the rest goes at the end, but for what ``keep`` hands to the caller.

    A step that is a table on shared storage survives lost executors, and a plan never
    grows over the rounds.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.name, self.made = spark, name, {}

    def __enter__(self) -> Scratch:
        return self

    def cut(self, df: DataFrame) -> DataFrame:
        path = f"{folder(self.spark)}/{self.name}-{uuid.uuid4().hex}.parquet"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.made[id(out)] = (out, path)
        return out

    def keep(self, df: DataFrame) -> DataFrame:
        df._scratch_path = self.made.pop(id(df))[1]
        return df

    def take(self, df: DataFrame) -> DataFrame:
        """A table that another scratch kept goes with this one's."""
        self.made[id(df)] = (df, df._scratch_path)
        return df

    def drop(self, df: DataFrame) -> None:
        delete(self.spark, self.made.pop(id(df))[1])

    def __exit__(self, *_) -> None:
        for _, path in self.made.values():
            delete(self.spark, path)
