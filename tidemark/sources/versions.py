"""Keyed tables as a base and deltas: an upsert writes its own rows, a reader merges by key and version, writers cannot lose each other's rows.

A table's folder holds data folders (Parquet, one for each commit, under a name of its own) and
``_log/<number>.json``, one entry a version. A commit writes its data first and then creates
the next entry, which only one writer can: whoever comes second takes the number after it, or,
where the change was made from what the table held, starts again from the newer table. A crash
before the entry leaves a folder that nothing refers to, a crash inside it an entry that does
not parse; readers pass over both.

Kinds of an entry: a base holds all rows, of the versions up to the one it covers; a delta holds
changed rows and, flagged, deleted ones. Reading takes the newest base and the deltas beyond
what it covers: of the deltas the last row of each key, of the base the rows whose key no delta
has. ``compact`` writes that result as a new base, beside writers.

Defined cases: null keys equal null; a delta may bring new columns, which are null in older
rows; an empty delta is a version; a table without a complete base or delta is an error.
"""

from __future__ import annotations

import json
import os
import uuid
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.ordered import latest

#: Whether a row of a delta deletes its key.
GONE = "_deleted"


class Conflict(RuntimeError):
    """Another writer took the version that a change was made for."""


def _fs(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _entry(path: str, number: int) -> str:
    return f"{path.rstrip('/')}/_log/{number:012d}.json"


def log(spark: SparkSession, path: str) -> tuple[list[dict], int]:
    """(complete entries in order, the largest number taken) of a table."""
    pattern, files = _fs(spark, f"{path.rstrip('/')}/_log/*.json")
    entries, most = [], 0
    for found in files.globStatus(pattern) or []:
        number = int(found.getPath().getName()[:-5])
        most = max(most, number)
        stream = files.open(found.getPath())
        try:
            text = bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()
        try:
            entries.append(json.loads(text) | {"number": number})
        except ValueError:  # its writer has not ended, or never will
            continue
    return sorted(entries, key=lambda e: e["number"]), most


def _take(spark: SparkSession, path: str, number: int, entry: dict) -> bool:
    """Creates the entry of a version; false if there is one."""
    name, body = _entry(path, number), json.dumps(entry).encode()
    url = urlparse(name)
    if url.scheme in ("", "file"):
        os.makedirs(os.path.dirname(url.path), exist_ok=True)
        try:
            with open(os.open(url.path, os.O_CREAT | os.O_EXCL | os.O_WRONLY, 0o644), "wb") as f:
                f.write(body)
        except FileExistsError:
            return False
        return True
    where, files = _fs(spark, name)
    try:
        out = files.create(where, False)
    except Exception as e:  # the file system's own exception, by its Java name
        if "AlreadyExists" in str(e):
            return False
        raise
    out.write(body)
    out.close()
    return True


def _commit(df: DataFrame, path: str, kind: str, keys: list[str], made_from: int | None = None, covers: int | None = None) -> int:
    """Writes df and takes the next version; with ``made_from`` only the very next one."""
    spark = df.sparkSession
    folder = f"{kind}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(f"{path.rstrip('/')}/{folder}")
    entry = {"kind": kind, "folder": folder, "keys": keys} | ({"covers": covers} if covers is not None else {})
    while True:
        number = (log(spark, path)[1] if made_from is None else made_from) + 1
        if _take(spark, path, number, entry):
            return number
        if made_from is not None:
            where, files = _fs(spark, f"{path.rstrip('/')}/{folder}")
            files.delete(where, True)
            raise Conflict(f"version {number} of {path} is another writer's")


def current_version(spark: SparkSession, path: str) -> int | None:
    """The number of the newest complete version."""
    return max((e["number"] for e in log(spark, path)[0]), default=None)


def _same(a: DataFrame, b: DataFrame, keys: list[str]):
    on = F.lit(True)
    for k in keys:
        on = on & a[k].eqNullSafe(b[k])
    return on


def read_versioned(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The rows of the newest complete version, or of an older one."""
    entries = [e for e in log(spark, path)[0] if version is None or e["number"] <= version]
    if not entries:
        raise ValueError(f"no complete version below {path}")
    keys, root = entries[-1]["keys"], path.rstrip("/")
    base = max((e for e in entries if e["kind"] == "base"), key=lambda e: (e["covers"], e["number"]), default=None)
    deltas = [e for e in entries if e["kind"] == "delta" and (base is None or e["number"] > base["covers"])]
    rows = spark.read.parquet(f"{root}/{base['folder']}") if base else None
    if deltas:
        new = None
        for e in deltas:
            own = spark.read.parquet(f"{root}/{e['folder']}").withColumn("_version", F.lit(e["number"]))
            new = own if new is None else new.unionByName(own, allowMissingColumns=True)
        if len(deltas) > 1:
            new = latest(new, keys, [F.desc("_version")])
        alive = new.where(~F.coalesce(GONE, F.lit(False))).drop("_version", GONE)
        if rows is None:
            return alive
        touched = new.select(*keys)
        rows = rows.join(touched, _same(rows, touched, keys), "left_anti").unionByName(alive, allowMissingColumns=True)
    return rows


def write_upsert(df: DataFrame, path: str, keys: list[str], order: list | None = None) -> int:
    """Adds df's rows to the table at path as a delta, and returns its version: rows of keys that are there are replaced.

    Only df is written, whatever the table's size. Of rows with one key the last in ``order``
    stays (without it the largest by its other columns). A replay adds the same rows again, which changes nothing.
    """
    last = [F.desc(c) for c in (order or [c for c in df.columns if c not in keys])]
    rows = latest(df, keys, last or [F.lit(1)])
    return _commit(rows.withColumn(GONE, F.lit(False)), path, "delta", keys)


def insert_new(df: DataFrame, path: str, keys: list[str]) -> int:
    """Adds the rows whose keys the table does not have; if another writer comes first, its rows are looked at again."""

    def change(held: DataFrame | None) -> DataFrame:
        return df if held is None else df.join(held, _same(df, held, keys), "left_anti")

    return _changed(df.sparkSession, path, lambda held: change(held).withColumn(GONE, F.lit(False)), keys)


def _changed(spark: SparkSession, path: str, change, keys: list[str] | None = None, tries: int = 20) -> int:
    """Commits the delta that ``change`` makes of the table, from a newer table again if another writer was faster."""
    for _ in range(tries):
        entries, taken = log(spark, path)
        if not entries and keys is None:
            raise ValueError(f"no complete version below {path}")
        held = read_versioned(spark, path) if entries else None
        try:
            return _commit(change(held), path, "delta", keys or entries[-1]["keys"], made_from=taken)
        except Conflict:
            continue
    raise Conflict(f"no version of {path} could be taken in {tries} tries")


def update_where(spark: SparkSession, path: str, where, values: dict) -> int:
    """Sets columns of the rows that a predicate holds for (null counts as false); only they are written. Keys stay as they are."""

    def change(held: DataFrame) -> DataFrame:
        hit = held.where(F.coalesce(where, F.lit(False)))
        return hit.withColumns({c: F.lit(v).cast(held.schema[c].dataType) for c, v in values.items()}).withColumn(GONE, F.lit(False))

    entries, _ = log(spark, path)
    if entries and set(values) & set(entries[-1]["keys"]):
        raise ValueError("an update cannot change keys")
    return _changed(spark, path, change)


def delete_where(spark: SparkSession, path: str, where) -> int:
    """Leaves out the rows that a predicate holds for (null counts as false); only their keys are written."""
    return _changed(spark, path, lambda held: held.where(F.coalesce(where, F.lit(False))).withColumn(GONE, F.lit(True)))


def compact(spark: SparkSession, path: str) -> int:
    """Writes the present rows as a new base; deltas that come meanwhile count on top of it."""
    version = current_version(spark, path)
    keys = log(spark, path)[0][-1]["keys"] if version is not None else []
    return _commit(read_versioned(spark, path, version), path, "base", keys, covers=version)


def deltas_behind(spark: SparkSession, path: str) -> int:
    """How many deltas a reader merges."""
    entries, _ = log(spark, path)
    covered = max((e["covers"] for e in entries if e["kind"] == "base"), default=0)
    return sum(e["kind"] == "delta" and e["number"] > covered for e in entries)
