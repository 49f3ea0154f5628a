"""Sinks: Parquet, CSV, JSON, versioned upserts, size-bounded and grouped parts, manifests, resume guards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.sources.versions import Conflict, compact, current_version, delete_where, deltas_behind, insert_new, read_versioned, update_where, write_upsert  # noqa: F401


def flat(df: DataFrame) -> DataFrame:
    """Nested columns as JSON text."""
    nested = (T.StructType, T.ArrayType, T.MapType)
    return df.select(*(F.to_json(f.name).alias(f.name) if isinstance(f.dataType, nested) else F.col(f.name) for f in df.schema.fields))


def write_parquet(df: DataFrame, path: str, mode: str = "append", partition_by: list[str] = (), max_records: int | None = None) -> None:
    w = df.write.mode(mode).option("compression", "zstd")
    w = w.option("maxRecordsPerFile", max_records) if max_records else w
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)


def write_csv(df: DataFrame, path: str, single: bool = False) -> None:
    """CSV with a header, nested values as JSON; one file only for exports known to be small."""
    out = flat(df)
    (out.coalesce(1) if single else out).write.mode("overwrite").option("header", True).csv(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def insert(df: DataFrame, path: str) -> None:
    """Appends rows; never replayed by the writer itself, as a replay would repeat them."""
    df.write.mode("append").option("compression", "zstd").parquet(path)


def write_fixed(df: DataFrame, path: str, schema: T.StructType | str, mode: str = "append") -> None:
    """Parquet under a declared schema: its columns in its order and types; a missing column or a value that does not fit is an error."""
    schema = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    out = df.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields))
    out.write.mode(mode).option("compression", "zstd").parquet(path)


def write_export(df: DataFrame, path: str) -> None:
    """Parquet for export: nested values as JSON text; an empty table is written as one with a single column ``empty`` and no row."""
    out = flat(df)
    if df.isEmpty():
        out = df.sparkSession.createDataFrame([], "empty boolean")
    out.write.mode("overwrite").option("compression", "zstd").parquet(path)


def union_of_keys(frames: list[DataFrame]) -> DataFrame:
    """Rows of frames with different columns under all their columns, in order of appearance; missing values are null."""
    names = list(dict.fromkeys(c for f in frames for c in f.columns))
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out.select(*names)


def bounded_parts(df: DataFrame, keys: list[str], limit: int) -> DataFrame:
    """Adds part: rows packed so that a part's rows stay within ``limit`` bytes of JSON; a larger row is an error.

    Rows are dealt to buckets by a hash of the keys, enough of them for half the limit
    each, and cut by the running sum inside a bucket, so no task holds more than a few
    parts and a retry deals the same.
    """
    size = F.octet_length(F.to_json(F.struct(*df.columns))).cast("long")
    x = df.withColumn("_bytes", size)
    total = x.agg(F.sum("_bytes")).first()[0] or 0
    over = F.raise_error(F.lit("row larger than the limit")).cast("long")
    x = x.withColumn("_bytes", F.when(F.col("_bytes") > limit, over).otherwise(F.col("_bytes")))
    x = x.withColumn("_bucket", F.pmod(F.xxhash64(*keys), F.lit(int(max(1, -(-2 * total // limit))))))
    w = W.partitionBy("_bucket").orderBy(*keys, *[c for c in df.columns if c not in keys]).rowsBetween(W.unboundedPreceding, 0)
    run = F.sum("_bytes").over(w)
    # a row of more than half the limit is a part of its own
    small = F.sum(F.when(F.col("_bytes") * 2 <= limit, F.col("_bytes")).otherwise(0)).over(w)
    own = F.when(F.col("_bytes") * 2 > limit, F.concat_ws("-", F.lit("own"), "_bucket", run))
    return x.withColumn("part", F.coalesce(own, F.concat_ws("-", "_bucket", F.floor((small - 1) / (limit / 2))))).drop("_bytes", "_bucket")


def file_manifest(spark: SparkSession, path: str) -> DataFrame:
    """path, bytes, sha256 of the files below a folder, read in the tasks."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return raw.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def grouped_parts(df: DataFrame, group: str, size: str, limit: int, buckets: int = 64) -> DataFrame:
    """Adds part: whole groups packed so that a part's bytes stay within the limit; a larger group is an error.

    Groups are dealt to buckets by hash and packed in order inside each bucket, so no
    task sees all groups; parts are numbered (bucket, cut) as text.
    """
    each = df.groupBy(group).agg(F.sum(size).alias("_bytes")).withColumn("_bucket", F.pmod(F.xxhash64(group), F.lit(buckets)))
    over = F.raise_error(F.concat(F.lit("group larger than the limit: "), F.col(group).cast("string")))
    each = each.withColumn("_bytes", F.when(F.col("_bytes") > limit, over.cast("long")).otherwise(F.col("_bytes")))
    # a group of more than half the limit is a part of its own; the others are cut where the running sum passes multiples of half the limit
    each = each.withColumn("_small", F.when(F.col("_bytes") * 2 <= limit, F.col("_bytes")).otherwise(0))
    w = W.partitionBy("_bucket").orderBy(group).rowsBetween(W.unboundedPreceding, 0)
    each = each.withColumn("_cut", F.floor((F.sum("_small").over(w) - 1) / (limit / 2)))
    own = F.when(F.col("_bytes") * 2 > limit, F.concat(F.lit("own-"), F.col(group).cast("string")))
    each = each.select(group, F.coalesce(own, F.concat_ws("-", F.lpad(F.col("_bucket").cast("string"), 4, "0"), F.col("_cut").cast("string"))).alias("part"))
    return df.join(each, group)


def manifest(df: DataFrame, part: str, size: str) -> DataFrame:
    """part, rows, bytes of the parts written."""
    return df.groupBy(part).agg(F.count("*").alias("rows"), F.sum(size).alias("bytes"))


def pending(work: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Units of work that no completed run has recorded: resuming is an anti join on a table of finished keys."""
    return work.join(done.select(*keys), keys, "left_anti")


def guard_frozen(spark: SparkSession, path: str, name: str, digest: str) -> None:
    """Records the digest of a frozen input under a name, or raises if a run recorded another: a resumed study must see the same universe.

    Of runs that come at the same time one records its digest, and the others are held against it.
    """
    insert_new(spark.createDataFrame([(name, digest)], "name string, digest string"), path, ["name"])
    if [r.digest for r in read_versioned(spark, path).where(F.col("name") == name).select("digest").collect()] != [digest]:
        raise ValueError(f"{name} changed since the study began")


def without_partial(rows: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of completed units only: what a broken run left of others goes before the resume."""
    return rows.join(done.select(*keys).distinct(), keys, "left_semi")
