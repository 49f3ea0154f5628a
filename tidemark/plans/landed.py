"""Queries over sources and streams: paged scans, a page stream, seconds of a stream, versioned tables. Pages, files and versions are made from the tables first."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidemark.plans.catalog import query
from tidemark.plans.tables import TICKS, rounded, ticks
from tidemark.sources import pages, shared, versions
from tidemark.streaming import seconds


def _folder(spark, name: str) -> str:
    return f"{shared.folder(spark)}/{name}-{uuid.uuid4().hex}"


def landed_trades(spark, sf, size: int = 50) -> str:
    """A folder with all purchases as landed trade pages of ``size`` rows."""
    path = _folder(spark, "pages")
    t = ticks(spark, sf, "purchase").select((F.col("symbol") % 20).alias("symbol"), F.expr("us div 1000").alias("T"), F.col("seq").alias("a"), F.col("price").alias("p"), (F.col("seq") % 9).cast("double").alias("q"), (F.col("seq") % 2 == 0).alias("m"))
    pages.land_pages(t, path, "T", "a", size).agg(F.sum("rows")).collect()
    return path


#: A stretch inside the tables' time.
LOW, HIGH = 1704500000000, 1706000000000
TRADES = f"SELECT CAST(symbol % 20 AS VARCHAR) AS symbol, seq AS trade_id, us // 1000 AS ms, price, CAST(seq % 9 AS DOUBLE) AS size, seq % 2 = 0 AS seller FROM ({TICKS}) WHERE kind = 'purchase'"


@query("s04_paged_trades", f"SELECT * FROM ({TRADES}) WHERE ms >= {LOW} AND ms < {HIGH}")
def s04(spark, sf):
    x = pages.scan_pages(spark, landed_trades(spark, sf), pageSize=50)
    return x.where((F.col("ms") >= LOW) & (F.col("ms") < HIGH)).drop("page", "truncated")


@query(
    "s04_truncated_pages",
    f"WITH t AS (SELECT *, row_number() OVER (PARTITION BY symbol, ms // 86400000 ORDER BY ms, trade_id) AS k, count(*) OVER (PARTITION BY symbol, ms // 86400000) AS n FROM ({TRADES})) SELECT symbol, CAST(count(*) AS BIGINT) AS rows, CAST(count(*) FILTER (k > 2 AND n >= 4) AS BIGINT) AS truncated FROM t WHERE k <= 4 GROUP BY 1",
)
def s04_truncated(spark, sf):
    # the second page is the last that is asked for
    x = pages.scan_pages(spark, landed_trades(spark, sf, 2), pageSize=2, maxPages=2)
    return x.groupBy("symbol").agg(F.count("*").alias("rows"), F.count_if("truncated").alias("truncated"))


@query("r01_page_stream", TRADES)
def r01(spark, sf):
    path, out = landed_trades(spark, sf), _folder(spark, "stream")
    run = pages.stream_pages(spark, path).writeStream.format("parquet").option("path", out).option("checkpointLocation", _folder(spark, "offsets")).trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.parquet(out).drop("page", "truncated")


@query(
    "t07_second_stream",
    f"""WITH q AS (SELECT CAST(symbol % 20 AS VARCHAR) AS symbol, us // 1000000 AS second, arg_max(struct_pack(b := price, bs := seq % 30, a := price + 1, s := seq % 40), (us, seq)) AS q, min(CASE WHEN seq % 9 <> 0 THEN (seq % 4)::DOUBLE END) AS min_spread, count(*) AS quote_updates FROM ({TICKS}) WHERE kind = 'view' GROUP BY 1, 2),
    t AS (SELECT CAST(symbol % 20 AS VARCHAR) AS symbol, us // 1000000 AS second, arg_min(price, (us, seq)) AS trade_open, max(price) AS trade_high, min(price) AS trade_low, arg_max(price, (us, seq)) AS trade_close, CAST(sum(seq % 50) AS BIGINT) AS trade_volume, count(*) AS trade_count FROM ({TICKS}) WHERE kind = 'purchase' GROUP BY 1, 2)
    SELECT coalesce(t.symbol, q.symbol) AS symbol, coalesce(t.second, q.second) AS second, trade_open, trade_high, trade_low, trade_close, coalesce(trade_volume, 0) AS trade_volume, coalesce(trade_count, 0) AS trade_count, q.q.b AS bid_price, q.q.bs AS bid_size_shares, q.q.a AS ask_price, q.q.s AS ask_size_shares, min_spread, coalesce(quote_updates, 0) AS quote_updates FROM t FULL JOIN q ON t.symbol = q.symbol AND t.second = q.second""",
)
def t07(spark, sf):
    # ticks are landed as files, then read as streams; a last tick far ahead ends all seconds before it
    x = ticks(spark, sf).select((F.col("symbol") % 20).cast("string").alias("symbol"), (F.col("us") * 1000).alias("at"), "seq", "price", "kind")
    t = x.where("kind = 'purchase'").select("symbol", "at", "seq", "price", (F.col("seq") % 50).alias("size"))
    q = x.where("kind = 'view'").select("symbol", "at", "seq", F.col("price").alias("bid_price"), (F.col("seq") % 30).alias("bid_size_shares"), (F.col("price") + 1).alias("ask_price"), (F.col("seq") % 40).alias("ask_size_shares"), F.when(F.col("seq") % 9 != 0, (F.col("seq") % 4).cast("double")).alias("spread"))
    paths = [_folder(spark, name) for name in ("trades", "quotes", "seconds", "state")]
    end = x.agg((F.max("at") + 10**15).alias("at"))
    # a side's watermark follows its own ticks, so both sides get the end
    t.unionByName(end.select(F.lit("end").alias("symbol"), "at", F.lit(0).cast("long").alias("seq"), F.lit(0.0).alias("price"), F.lit(0).cast("long").alias("size"))).write.parquet(paths[0])
    q.unionByName(end.select(F.lit("end").alias("symbol"), "at", F.lit(0).cast("long").alias("seq"), *(F.lit(0).cast(k).alias(c) for c, k in q.dtypes[3:]))).write.parquet(paths[1])
    read = lambda df, path: spark.readStream.schema(df.schema).parquet(path)
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        run = seconds.second_stream(read(t, paths[0]), read(q, paths[1])).writeStream.format("parquet").option("path", paths[2]).option("checkpointLocation", paths[3]).trigger(availableNow=True).start()
        run.awaitTermination()
    finally:
        spark.conf.set(provider, before)
    return spark.read.parquet(paths[2]).where("symbol <> 'end'")


@query(
    "k02_delta_upserts",
    "WITH u AS (SELECT o_orderkey, o_orderstatus AS status, o_totalprice AS price, 1 AS v FROM orders UNION ALL SELECT o_orderkey, 'X', o_totalprice * 2, 2 FROM orders WHERE o_orderkey % 3 = 0 UNION ALL SELECT o_orderkey + 100000000, 'N', o_totalprice, 3 FROM orders WHERE o_orderkey % 5 = 0), l AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY o_orderkey ORDER BY v DESC) = 1) SELECT o_orderkey, CASE WHEN status = 'X' THEN 'Y' ELSE status END AS status, round(price, 2) AS price FROM l WHERE price >= 50000",
)
def k02(spark, sf):
    path = _folder(spark, "orders")
    o = spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price"))
    key = ["o_orderkey"]
    versions.write_upsert(o, path, key)
    versions.write_upsert(o.where("o_orderkey % 3 = 0").withColumns({"status": F.lit("X"), "price": F.col("price") * 2}), path, key)
    versions.compact(spark, path)
    versions.write_upsert(o.where("o_orderkey % 5 = 0").withColumns({"o_orderkey": F.col("o_orderkey") + 100000000, "status": F.lit("N")}), path, key)
    versions.update_where(spark, path, F.col("status") == "X", {"status": F.lit("Y")})
    versions.delete_where(spark, path, F.col("price") < 50000)
    return rounded(versions.read_versioned(spark, path), 2)
