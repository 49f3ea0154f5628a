"""Paged data source and the stateful seconds, batch against stream."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import tape
from tidemark.sources import pages
from tidemark.streaming import seconds

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
DAY = 86_400_000


@pytest.fixture
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def trades(spark, n=400, seed=1):
    rnd = random.Random(seed)
    rows = [(rnd.choice("AB"), 19_700 * DAY + rnd.randrange(3 * DAY), i, round(rnd.uniform(1, 9), 2), rnd.randint(1, 50) / 4, rnd.random() < 0.5) for i in range(n)]
    return rows, spark.createDataFrame(rows, "symbol string, T long, a long, p double, q double, m boolean")


def landed(spark, path, size=20):
    rows, df = trades(spark)
    made = pages.land_pages(df, path, "T", "a", size).collect()
    return rows, made


def test_a_scan_of_landed_pages_gives_all_rows_and_prunes_units(spark, tmp_path):
    rows, made = landed(spark, str(tmp_path))
    assert len(made) == sum(1 for _ in tmp_path.glob("*/*/*.json")) and sum(r.rows for r in made) == 400
    df = pages.scan_pages(spark, str(tmp_path), pageSize=20)
    get = lambda d: sorted((r.symbol, r.ms, r.trade_id, r.price, r["size"], r.seller) for r in d.collect())
    assert get(df) == sorted(rows) and not df.where("truncated").count()
    low, high = 19_701 * DAY, 19_701 * DAY + DAY // 2
    try:
        some = pages.scan_pages(spark, str(tmp_path), pageSize=20).where((F.col("symbol") == "A") & (F.col("ms") >= low) & (F.col("ms") < high))
        assert get(some) == sorted(r for r in rows if r[0] == "A" and low <= r[1] < high)
        assert some.rdd.getNumPartitions() == 1 and df.rdd.getNumPartitions() == 6
        spark.conf.set("spark.sql.python.filterPushdown.enabled", "false")
        plain = pages.scan_pages(spark, str(tmp_path), pageSize=20).where((F.col("symbol") == "A") & (F.col("ms") >= low) & (F.col("ms") < high))
        assert get(plain) == get(some) and plain.rdd.getNumPartitions() == 6
    finally:
        spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    assert get(pages.scan_pages(spark, str(tmp_path), pageSize=20, symbols="B", startMs=low, endMs=high)) == sorted(r for r in rows if r[0] == "B" and low <= r[1] <= high)
    assert pages.scan_pages(spark, f"{tmp_path}/none").count() == 0


def test_page_rules(spark, tmp_path):
    import json

    def land(symbol, number, rows, day="1970-01-01"):
        (tmp_path / symbol / day).mkdir(parents=True, exist_ok=True)
        (tmp_path / symbol / day / f"{number:06d}.json").write_text(json.dumps(rows))

    trade = lambda a, t: {"a": a, "T": t, "p": "2.5", "q": "x" if a == 3 else "4", "m": a % 2 == 0}
    for n, rows in enumerate([[trade(1, 10), trade(2, 20)], [trade(3, 30), trade(4, 101)], [trade(5, 102), trade(6, 103)]], 1):
        land("A", n, rows)
    for n, rows in enumerate([[trade(7, 50), trade(8, 60)], [trade(9, 70), trade(10, 80)], [trade(11, 90)]], 1):
        land("B", n, rows)
    land("C", 1, [trade(1, 1), trade(2, 2)])
    land("C", 2, [trade(2, 2), trade(1, 1)])
    land("D", 1, [])
    scan = lambda **o: sorted((r.symbol, r.trade_id, r["size"], r.page, r.truncated) for r in pages.scan_pages(spark, str(tmp_path), pageSize=2, **o).collect())
    # the second page of A passes the end, so the third is not asked for; B is cut by the page limit
    assert scan(symbols="A,B,D", startMs=20, endMs=100, maxPages=2) == [("A", 2, 4.0, 1, False), ("A", 3, None, 2, False), ("B", 7, 4.0, 1, False), ("B", 8, 4.0, 1, False), ("B", 9, 4.0, 2, True), ("B", 10, 4.0, 2, True)]
    assert [x[1] for x in scan(symbols="B")] == [7, 8, 9, 10, 11]
    with pytest.raises(Exception, match="did not advance"):
        scan(symbols="C")
    land("K", 1, [[60_000, "1", "2", "0.5", "1.5", "10", 119_999, "15", 3], [120_000, "1"]])
    got = pages.scan_pages(spark, str(tmp_path), "klines", symbols="K", startMs=60_000, endMs=120_000).collect()
    assert [(r.ms, r.close, r.trade_count) for r in got] == [(60_000, 1.5, 3)]
    land("Q", 1, [{"a": 1, "T": 5, "bp": 1.0, "bs": 2, "ap": 1.5, "as": 3}])
    assert pages.scan_pages(spark, str(tmp_path), "quotes", symbols="Q").first().ask_size == 3


def test_a_stream_of_pages_equals_the_scan_over_restarts(spark, tmp_path):
    import shutil

    rows, _ = landed(spark, f"{tmp_path}/all")
    files = sorted((p for p in (tmp_path / "all").glob("*/*/*.json")), key=lambda p: (p.parent.name, p.name))

    def run():
        q = pages.stream_pages(spark, f"{tmp_path}/in", pageSize=20).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").start()
        q.processAllAvailable()
        q.stop()

    for part in (files[:5], [], files[5:12], files[12:]):
        for f in part:
            to = tmp_path / "in" / f.relative_to(tmp_path / "all")
            to.parent.mkdir(parents=True, exist_ok=True)
            shutil.copy(f, to)
        (tmp_path / "in").mkdir(exist_ok=True)
        run()
    got = spark.read.parquet(f"{tmp_path}/out").collect()
    assert sorted((r.symbol, r.ms, r.trade_id, r.price, r["size"], r.seller) for r in got) == sorted(rows)


def test_seconds_of_a_stream_equal_the_batch_for_any_order(spark, rocks, tmp_path):
    rnd = random.Random(5)
    start = 1_700_000_000 * seconds.NS
    tick = lambda: start + rnd.randrange(40 * seconds.NS)
    t = [(rnd.choice("AB"), tick(), i, round(rnd.uniform(1, 9), 2), rnd.randint(1, 9)) for i in range(300)]
    # several ticks in one microsecond, apart by nanoseconds only, and ties of time
    t += [("A", start + 7 * seconds.NS + 123_456_000 + d, 1000 + i, float(d), 1) for i, d in enumerate([789, 100, 500, 100, 900])]
    q = [(rnd.choice("ABC"), tick(), 5000 + i, 1.0 + i % 7, i % 5, 2.0 + i % 7, i % 3, None if i % 4 == 0 else i % 9 / 8) for i in range(300)]
    tdf = "symbol string, at long, seq long, price double, size long"
    qdf = "symbol string, at long, seq long, bid_price double, bid_size_shares long, ask_price double, ask_size_shares long, spread double"
    want = tape.second_summary(spark.createDataFrame(t, tdf), spark.createDataFrame(q, qdf), ["symbol"], "at", "seq")
    # ticks are in their order but for a shuffle within some seconds; a far tick at the end moves the watermark
    late = lambda r: r[1] + rnd.randrange(6 * seconds.NS)
    t, q = sorted(t, key=late), sorted(q, key=late)
    end = [("Z", start + 900 * seconds.NS, 1, 1.0, 1)]
    for i in range(6):
        spark.createDataFrame(t[i * 55 : (i + 1) * 55 if i < 5 else None] or end, tdf).coalesce(1).write.parquet(f"{tmp_path}/t/{i:02d}")
        spark.createDataFrame(q[i * 55 : (i + 1) * 55 if i < 5 else None], qdf).coalesce(1).write.parquet(f"{tmp_path}/q/{i:02d}")
    for i in (6, 7):
        spark.createDataFrame(end, tdf).coalesce(1).write.parquet(f"{tmp_path}/t/{i:02d}")
    read = lambda p, schema: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/{p}/*")
    x = seconds.second_stream(read("t", tdf), read("q", qdf), delay="30 seconds")
    run = x.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").start()
    run.processAllAvailable()
    run.stop()
    rows = lambda df: sorted((tuple(r[c] for c in want.columns) for r in df.collect()), key=str)
    got = rows(spark.read.parquet(f"{tmp_path}/out"))
    assert got == rows(want) and len(got) > 60


def test_merging_seconds_is_order_free():
    rnd = random.Random(2)
    import pandas as pd

    pdf = pd.DataFrame([("A", rnd.randrange(3 * seconds.NS), i, i % 3 == 0, float(i % 7), i % 5, 1.0 * i, i, 2.0 * i, i, i / 4 if i % 2 else None) for i in range(60)], columns=["symbol", "at", "seq", "quote", "price", "size", "bid_price", "bid_size_shares", "ask_price", "ask_size_shares", "spread"])
    want = seconds.summarised(pdf)
    for _ in range(5):
        order, out = pdf.sample(frac=1, random_state=rnd.randrange(99)), {}
        for p in (order.iloc[i::4] for i in range(4)):
            for s, v in seconds.summarised(p).items():
                out[s] = seconds.merged(out.get(s), v)
        assert out == want
