"""Paged scans, layers, sinks, resume guards and event-time streams on hand-made rows."""

import io
import json
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from tidemark.operators import surge
from tidemark.sources import readers, writers
from tidemark.streaming import stateful


def kline(ms, close="1.5"):
    return [str(ms), "1", "2", "0.5", close, "10", str(ms + 59_999), "15", "3", "1", "1", "0"]


def test_paged_klines_are_half_open_and_must_advance(spark):
    pages = [("A", 1, [kline(m * 60_000) for m in (0, 1, 2)]), ("A", 2, [kline(m * 60_000) for m in (3, 4)]), ("B", 1, []), ("C", 1, [kline(0), kline(60_000, "x")])]
    df = spark.createDataFrame(pages, "symbol string, page int, rows array<array<string>>")
    got = sorted((r.symbol, r.open_time // 60_000, r.close) for r in readers.paged_klines(df, "symbol", 60_000, 240_000, 60_000).collect())
    assert got == [("A", 1, 1.5), ("A", 2, 1.5), ("A", 3, 1.5), ("C", 1, None)]
    stuck = spark.createDataFrame([("A", 1, [kline(60_000)]), ("A", 2, [kline(0)])], df.schema)
    with pytest.raises(Exception, match="did not advance"):
        readers.paged_klines(stuck, "symbol", 0, 10**9, 60_000).collect()


def test_paged_trades_and_truncation(spark):
    trade = lambda a, t: (a, t, "2.5", "4", a % 2 == 0)
    schema = "symbol string, page int, rows array<struct<a:long,T:long,p:string,q:string,m:boolean>>"
    pages = [("A", 1, [trade(1, 10), trade(2, 20)]), ("A", 2, [trade(3, 30), trade(4, 101)]), ("A", 3, [trade(5, 102), trade(6, 103)]), ("B", 1, [trade(7, 50), trade(8, 60)]), ("B", 2, [trade(9, 70), trade(10, 80)])]
    trades, state = readers.paged_trades(spark.createDataFrame(pages, schema), "symbol", 20, 100, max_pages=2, page_size=2)
    assert sorted((r.symbol, r.trade_id, r.price, r.size) for r in trades.collect()) == [("A", 2, 2.5, 4.0), ("A", 3, 2.5, 4.0), ("B", 7, 2.5, 4.0), ("B", 8, 2.5, 4.0), ("B", 9, 2.5, 4.0), ("B", 10, 2.5, 4.0)]
    assert {r.symbol: (r.pages, r.rows, r.truncated) for r in state.collect()} == {"A": (2, 2, False), "B": (2, 4, True)}


def test_layers_never_mix_within_a_day(spark):
    cols = "symbol string, at long, price double"
    a = spark.createDataFrame([("A", 1, 1.0), ("A", 1, 2.0)], cols)
    b = spark.createDataFrame([("A", 2, 9.0), ("A", 101, 9.0), ("B", 3, 9.0)], cols)
    rows = readers.layered(a, b, ["symbol"], "at", F.expr("at div 100"))
    assert sorted((r.symbol, r.at, r.price, r.layer) for r in rows.collect()) == [("A", 1, 2.0, "archive"), ("A", 101, 9.0, "fallback"), ("B", 3, 9.0, "fallback")]
    wanted = spark.createDataFrame([("A", 0), ("A", 1), ("A", 2), ("B", 0)], "symbol string, day long")
    got = {(r.symbol, r.day): (r.source, r.rows) for r in readers.layer_manifest(rows, wanted, ["symbol"], F.expr("at div 100")).collect()}
    assert got == {("A", 0): ("archive", 1), ("A", 1): ("fallback", 1), ("A", 2): ("missing", 0), ("B", 0): ("fallback", 1)}


def test_archive_report(spark, tmp_path):
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("a.csv", "open_time,open,high,low,close\n1,2,3,4,5\nbad,2,3,4,5\n2,2,3,4,5\n")
    (tmp_path / "A-1m-2025-01-01.zip").write_bytes(buf.getvalue())
    (tmp_path / "B-1m-2025-01-01.zip").write_bytes(b"not a zip")
    got = {r.path.rpartition("/")[2][0]: (r.zip_ok, r.rows, r.header, r.rejected) for r in readers.archive_report(spark, f"{tmp_path}/*.zip").collect()}
    assert got == {"A": (True, 2, True, 1), "B": (False, 0, False, 0)}


def test_master_payloads_and_lookups(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps({"symbols": [{"symbol": "BTCUSDT", "baseAsset": "BTC", "quoteAsset": "USDT", "status": "TRADING", "permissions": ["SPOT"], "orderTypes": ["LIMIT"]}]}))
    assert readers.read_symbol_master(spark, f"{tmp_path}/m.json").first().order_types == ["LIMIT"]
    (tmp_path / "c.json").write_text(json.dumps([{"date": "2026-01-02", "open": "09:30"}]))
    assert readers.read_json_table(spark, f"{tmp_path}/c.json", "date string, open string, close string").first().close is None
    grouped = spark.createDataFrame([({"dividend": [(1, None)], "split": [(2, "forward_split")]},)], "p map<string, array<struct<id:int, action_type:string>>>")
    assert sorted((r.id, r.action_type) for r in readers.grouped_payload(grouped, "p").collect()) == [(1, "dividend"), (2, "forward_split")]
    cols = "symbol string, v int"
    bars, want = spark.createDataFrame([("A", 1), ("R", 2)], cols), spark.createDataFrame([("A",), ("R",), ("N",)], "symbol string")
    rejected = spark.createDataFrame([("R",)], "symbol string")
    assert sorted((r.symbol, r.v or 0) for r in readers.requested_symbols(bars, want, rejected).collect()) == [("A", 1), ("N", 0), ("R", 0)]
    assert [len(p) for p in readers.pages_of(spark.range(25), ["id"], 10)] == [10, 10, 5]
    cache = spark.createDataFrame([("A", 1, True), ("B", 2, None)], "symbol string, v int, negative boolean")
    assert [r.v for r in readers.lookup(cache, want.union(spark.createDataFrame([("B",)], "symbol string")), ["symbol"], "negative").collect()] == [1]


def test_sinks_of_exports(spark, tmp_path):
    df = spark.createDataFrame([(1, "x", [1])], "id long, s string, a array<int>")
    writers.write_fixed(df, f"{tmp_path}/f", "s string, id int")
    assert spark.read.parquet(f"{tmp_path}/f").dtypes == [("s", "string"), ("id", "int")]
    with pytest.raises(Exception):
        writers.write_fixed(df, f"{tmp_path}/g", "missing string")
    writers.write_export(df, f"{tmp_path}/e")
    assert spark.read.parquet(f"{tmp_path}/e").first().a == "[1]"
    writers.write_export(df.where("id > 5"), f"{tmp_path}/n")
    assert spark.read.parquet(f"{tmp_path}/n").columns == ["empty"]
    assert writers.union_of_keys([df.select("id"), df.select("s")]).columns == ["id", "s"]
    rows = spark.createDataFrame([(i, "y" * (i % 40)) for i in range(500)], "id long, s string")
    parts = writers.bounded_parts(rows, ["id"], 600)
    worst = parts.withColumn("n", F.octet_length(F.to_json(F.struct("id", "s")))).groupBy("part").agg(F.sum("n").alias("n")).agg(F.max("n")).first()[0]
    assert worst <= 600 and parts.count() == 500
    with pytest.raises(Exception, match="larger than the limit"):
        writers.bounded_parts(rows, ["id"], 20).collect()
    assert {r.sha256 for r in writers.file_manifest(spark, f"{tmp_path}/e").collect()} and writers.file_manifest(spark, f"{tmp_path}/e").where("bytes > 0").count() >= 1


def test_updates_and_deletes_make_versions(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "id long, s string")
    path = f"{tmp_path}/t"
    assert writers.write_upsert(df, path, ["id"]) == 1
    assert writers.update_where(spark, path, F.col("s") == "a", {"s": F.lit("z")}) == 2
    assert writers.delete_where(spark, path, F.col("s") == "b") == 3
    assert sorted((r.id, r.s) for r in writers.read_versioned(spark, path).collect()) == [(1, "z"), (3, None)]
    with pytest.raises(ValueError, match="no complete version"):
        writers.read_versioned(spark, f"{tmp_path}/none")
    writers.insert(df, f"{tmp_path}/i")
    writers.insert(df, f"{tmp_path}/i")
    assert spark.read.parquet(f"{tmp_path}/i").count() == 6


def test_resume_guards(spark, tmp_path):
    writers.guard_frozen(spark, f"{tmp_path}/g", "universe", "abc")
    writers.guard_frozen(spark, f"{tmp_path}/g", "universe", "abc")
    writers.guard_frozen(spark, f"{tmp_path}/g", "rules", "x")
    with pytest.raises(ValueError, match="changed"):
        writers.guard_frozen(spark, f"{tmp_path}/g", "universe", "other")
    rows, done = spark.createDataFrame([(1, "a"), (2, "b")], "event long, v string"), spark.createDataFrame([(1,)], "event long")
    assert [r.v for r in writers.without_partial(rows, done, ["event"]).collect()] == ["a"]


def test_event_time_surges_equal_batch_whatever_the_order(spark, tmp_path):
    rnd = random.Random(6)
    rows = [(s, m, p + rnd.random(), p) for s in (1, 2) for m in sorted(rnd.sample(range(3000), 200)) for p in [rnd.choice([8.0, 9.0, 10.0, 10.5])]]
    df = spark.createDataFrame(rows, "symbol long, minute long, high double, low double").withColumn("ts", F.timestamp_seconds(F.col("minute") * 60))
    want = {tuple(r) for r in surge.first_rolling_surge(df, ["symbol"], "minute", F.expr("minute div 1440")).collect()}
    # files in order of time but with neighbours exchanged inside the delay, then one far ahead that moves the watermark
    shuffled = sorted(rows, key=lambda r: r[1] // 60 * 60 + rnd.random() * 90)
    cuts = [shuffled[i : i + 80] for i in range(0, len(shuffled), 80)] + [[(9, 100_000, 1.0, 1.0)], [(9, 100_001, 1.0, 1.0)]]
    for i, part in enumerate(cuts):
        part_df = spark.createDataFrame(part, "symbol long, minute long, high double, low double").withColumn("ts", F.timestamp_seconds(F.col("minute") * 60)).drop("minute")
        part_df.coalesce(1).write.parquet(f"{tmp_path}/in/{i:03d}")
    schema = part_df.schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*").withWatermark("ts", "4 hours")
    q = stateful.surges_by_event_time(stream).writeStream.foreachBatch(stateful.upsert_sink(f"{tmp_path}/out", ["symbol", "day"], ["minute"])).option("checkpointLocation", f"{tmp_path}/cp").start()
    q.processAllAvailable()
    q.stop()
    got = {tuple(r) for r in writers.read_versioned(spark, f"{tmp_path}/out").collect()}
    assert got == want


def test_a_day_has_one_first_surge_even_after_a_quiet_window(spark, tmp_path):
    # surges at minutes 10 and 710 of one day, the watermark a window past the first before the second comes
    steps = [[(1, 0, 10.0, 10.0), (1, 10, 20.0, 20.0)], [(2, 600, 1.0, 1.0)], [(2, 601, 1.0, 1.0)], [(1, 700, 10.0, 10.0), (1, 710, 20.0, 20.0)], [(1, 1441, 10.0, 10.0), (1, 1442, 30.0, 30.0)], [(2, 9000, 1.0, 1.0)], [(2, 9001, 1.0, 1.0)]]
    df = lambda rows: spark.createDataFrame(rows, "symbol long, minute long, high double, low double").select("symbol", F.timestamp_seconds((F.col("minute") + 144_000) * 60).alias("ts"), "high", "low")
    for i, rows in enumerate(steps):
        df(rows).coalesce(1).write.parquet(f"{tmp_path}/in/{i:03d}")
    stream = spark.readStream.schema(df(steps[0]).schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*").withWatermark("ts", "1 minute")
    q = stateful.surges_by_event_time(stream).writeStream.format("memory").queryName("one_a_day").option("checkpointLocation", f"{tmp_path}/cp").start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r.symbol, r.day, r.minute) for r in spark.table("one_a_day").collect()) == [(1, 100, 144_010), (1, 101, 145_442)]
