"""Versioned tables: deltas, conflicts, crashes, compaction."""

import json
import threading

import pytest
from pyspark.sql import functions as F

from tidemark.sources import versions, writers

COLS = "id long, s string"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_an_upsert_writes_its_own_rows_only(spark, tmp_path):
    path = str(tmp_path / "t")
    assert versions.write_upsert(spark.range(2000).select("id", F.lit("old").alias("s")), path, ["id"]) == 1
    assert versions.write_upsert(spark.createDataFrame([(5, "new"), (5, "newer"), (9000, "x")], COLS), path, ["id"], ["s"]) == 2
    entries, most = versions.log(spark, path)
    assert most == 2 and [e["kind"] for e in entries] == ["delta", "delta"]
    assert spark.read.parquet(f"{path}/{entries[1]['folder']}").count() == 2
    now = versions.read_versioned(spark, path)
    assert now.count() == 2001 and rows(now.where("id in (5, 9000)")) == [(5, "newer"), (9000, "x")]
    assert versions.read_versioned(spark, path, 1).where("id = 5").first().s == "old"


def test_keys_with_nulls_new_columns_updates_and_deletes(spark, tmp_path):
    path = str(tmp_path / "t")
    versions.write_upsert(spark.createDataFrame([(1, "a"), (None, "b"), (3, None)], COLS), path, ["id"])
    versions.write_upsert(spark.createDataFrame([(None, "z", 1.5)], COLS + ", x double"), path, ["id"])
    assert rows(versions.read_versioned(spark, path)) == sorted([(1, "a", None), (3, None, None), (None, "z", 1.5)], key=str)
    assert versions.update_where(spark, path, F.col("s") == "a", {"s": F.concat("s", F.lit("!"))}) == 3
    assert versions.delete_where(spark, path, F.col("s") == "z") == 4
    assert versions.write_upsert(spark.createDataFrame([], COLS), path, ["id"]) == 5
    assert rows(versions.read_versioned(spark, path).select("id", "s")) == [(1, "a!"), (3, None)]
    with pytest.raises(ValueError, match="keys"):
        versions.update_where(spark, path, F.lit(True), {"id": F.lit(4)})
    # a deleted key may come again
    versions.write_upsert(spark.createDataFrame([(None, "again")], COLS), path, ["id"])
    assert rows(versions.read_versioned(spark, path).where("id is null").select("s")) == [("again",)]


def test_compaction_keeps_the_rows_and_what_comes_meanwhile(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    for i in range(4):
        versions.write_upsert(spark.createDataFrame([(i, f"v{i}"), (99, f"v{i}")], COLS), path, ["id"])
    take = versions._take

    def late(spark_, path_, number, entry):
        # another writer commits between the compaction's read and its entry
        if entry["kind"] == "base":
            monkeypatch.setattr(versions, "_take", take)
            versions.write_upsert(spark.createDataFrame([(99, "late"), (50, "late")], COLS), path, ["id"])
        return take(spark_, path_, number, entry)

    monkeypatch.setattr(versions, "_take", late)
    assert versions.compact(spark, path) == 6
    assert versions.deltas_behind(spark, path) == 1
    assert rows(versions.read_versioned(spark, path)) == [(0, "v0"), (1, "v1"), (2, "v2"), (3, "v3"), (50, "late"), (99, "late")]


def test_writers_at_once_lose_no_rows(spark, tmp_path):
    path, failed = str(tmp_path / "t"), []

    def work(k):
        try:
            for i in range(3):
                versions.write_upsert(spark.createDataFrame([(10 * k + i, str(k))], COLS), path, ["id"])
        except Exception as e:  # a thread's failure fails the test below
            failed.append(e)

    threads = [threading.Thread(target=work, args=(k,)) for k in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not failed and versions.current_version(spark, path) == 12
    assert rows(versions.read_versioned(spark, path)) == sorted([(10 * k + i, str(k)) for k in range(4) for i in range(3)], key=str)


def test_a_change_made_from_an_older_table_starts_again(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    versions.write_upsert(spark.createDataFrame([(1, "a"), (2, "a")], COLS), path, ["id"])
    commit, calls = versions._commit, []

    def slow(df, *args, **options):
        if options.get("made_from") is not None and not calls:
            calls.append(1)
            commit(spark.createDataFrame([(3, "a"), (1, "b")], COLS).withColumn(versions.GONE, F.lit(False)), path, "delta", ["id"])
        return commit(df, *args, **options)

    monkeypatch.setattr(versions, "_commit", slow)
    assert versions.update_where(spark, path, F.col("s") == "a", {"s": F.lit("c")}) == 3
    assert rows(versions.read_versioned(spark, path)) == [(1, "b"), (2, "c"), (3, "c")]
    assert len([p for p in (tmp_path / "t").iterdir() if p.name.startswith("delta")]) == 3


def test_crashes_before_and_inside_a_commit(spark, tmp_path):
    path = str(tmp_path / "t")
    versions.write_upsert(spark.createDataFrame([(1, "a")], COLS), path, ["id"])
    # data without an entry, and an entry that its writer did not finish
    spark.createDataFrame([(2, "lost", False)], COLS + ", _deleted boolean").write.parquet(f"{path}/delta-lost")
    (tmp_path / "t" / "_log" / f"{2:012d}.json").write_text('{"kind": "del')
    assert versions.current_version(spark, path) == 1 and rows(versions.read_versioned(spark, path)) == [(1, "a")]
    assert versions.write_upsert(spark.createDataFrame([(3, "b")], COLS), path, ["id"]) == 3
    assert versions.update_where(spark, path, F.lit(True), {"s": F.lit("u")}) == 4
    assert rows(versions.read_versioned(spark, path)) == [(1, "u"), (3, "u")]
    assert json.loads((tmp_path / "t" / "_log" / f"{3:012d}.json").read_text())["keys"] == ["id"]


def test_frozen_inputs_are_recorded_once(spark, tmp_path):
    path, seen = str(tmp_path / "g"), []

    def run(k):
        try:
            writers.guard_frozen(spark, path, "universe", f"d{k}")
            seen.append(k)
        except ValueError:
            pass

    threads = [threading.Thread(target=run, args=(k,)) for k in range(3)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert len(seen) == 1 and rows(versions.read_versioned(spark, path)) == [("universe", f"d{seen[0]}")]
