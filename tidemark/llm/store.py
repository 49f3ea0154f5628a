"""Shared storage for intermediate tables and binary files.

Everything goes below spark.checkpoint.dir, the one folder that the driver and all
executors see; only where the session leaves it unset (tests) a local folder is used.
Tables go through Spark's writers. Binary files are written with pyarrow's file
systems, under a name of the task attempt's own, and count only once the manifest
row that the attempt returns has been collected: a lost or speculative attempt leaves
an unlisted file, never a wrong result.
"""

from __future__ import annotations

import threading
import uuid
from contextlib import contextmanager

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LOCAL_DEFAULT = "file:///tmp/checkpoints"


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder's URI in the shared checkpoint folder."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        # a machine's own folder is shared only where there is one machine
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors see")
        base = LOCAL_DEFAULT
    if "://" not in base and not base.startswith("file:"):
        base = f"file://{base}"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


_OPEN = threading.local()


def _scopes() -> list[dict[str, SparkSession]]:
    """This thread's open scopes, the innermost last: path -> session of the tables written in each."""
    if not hasattr(_OPEN, "scopes"):
        _OPEN.scopes = []
    return _OPEN.scopes


def table(df: DataFrame, name: str) -> DataFrame:
    """Writes df in the shared folder and reads it back: cuts lineage, survives lost executors, and gives joins a real size."""
    path = f"{shared_dir(df.sparkSession, name)}.parquet"
    if scopes := _scopes():
        scopes[-1][path] = df.sparkSession
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.table_path = path
    return out


def keep(*tables: DataFrame) -> None:
    """Hands tables of the present scope to the one around it, or to the caller for good."""
    *_, outer, inner = [{}, *_scopes()]
    for df in tables:
        spark = inner.pop(df.table_path, None)
        if spark is not None:
            outer[df.table_path] = spark


def drop(path: str, spark: SparkSession) -> None:
    """Deletes a table's folder; nothing may read it any more."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def scope():
    """Tables written inside are deleted at the end, but for those handed out by ``keep``.

    A written table cuts the lineage, so once the tables that are kept are there, those
    they were made from are never read again.
    """
    _scopes().append({})
    try:
        yield
    finally:
        for path, spark in _scopes().pop().items():
            drop(path, spark)


#: Rows of at most 40 bytes or so that a join side may have to be broadcast.
BROADCAST_ROWS = 1_000_000


def checked_broadcast(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """df, which is a written table, marked for broadcast if it has at most ``limit`` rows; else a shuffle join takes over."""
    return F.broadcast(df) if df.count() <= limit else df


def bounded_sample(df: DataFrame, rows: int, limit: int, *key: str) -> DataFrame:
    """About ``limit`` of the ``rows`` rows of df, never more, by a hash of the key columns.

    The share is a filter on the scan, so no task gathers more than the sample itself.
    """
    if rows <= limit:
        return df.limit(limit)
    return df.where(F.pmod(F.xxhash64(*key), F.lit(1 << 40)) < int((1 << 40) * (limit / rows) * 0.97)).limit(limit)


def open_out(uri: str):
    """A binary output stream at a URI, on any file system pyarrow knows."""
    where, path = fs.FileSystem.from_uri(uri)
    where.create_dir(path.rpartition("/")[0], recursive=True)
    return where.open_output_stream(path)


def open_in(uri: str):
    """A sequential binary input stream at a URI."""
    where, path = fs.FileSystem.from_uri(uri)
    return where.open_input_stream(path)


def open_random(uri: str):
    """A seekable input file at a URI."""
    where, path = fs.FileSystem.from_uri(uri)
    return where.open_input_file(path)


def manifest_frame(spark: SparkSession, rows: list, schema: str) -> DataFrame:
    """One partition for each manifest row, so each file is read by a task of its own."""
    df = spark.createDataFrame(rows, schema)
    return df.repartition(max(1, len(rows))) if len(rows) > 1 else df
