"""Further inventory rows: universes, diagnostics, counters, nested payloads, pre-open and microstructure summaries."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators import ordered, universe
from tidemark.plans.catalog import query
from tidemark.plans.tables import DAILY, TICKS, daily_orders, load, rounded, ticks


@query(
    "p10_valid_quotes",
    f"WITH q AS (SELECT seq, price - 30 AS bid, price - 30 + (seq % 7) - 1 AS ask, seq % 5 AS size FROM ({TICKS}) WHERE kind = 'view') SELECT count(*) FILTER (ask > 0 AND size > 0 AND (bid <= 0 OR ask >= bid)) AS asks, count(*) FILTER (bid > 0 AND ask >= bid) AS bids, count(*) FILTER (bid > 0 AND ask > 0 AND ask >= bid) AS both_sides, round(sum(CASE WHEN bid > 0 AND ask > 0 AND ask >= bid THEN ask - bid END), 4) AS spread FROM q",
)
def p10(spark, sf):
    q = ticks(spark, sf, "view").select((F.col("price") - 30).alias("bid"), (F.col("price") - 30 + F.col("seq") % 7 - 1).alias("ask"), (F.col("seq") % 5).alias("size"))
    b, a, s = F.col("bid"), F.col("ask"), F.col("size")
    return q.agg(F.count(F.when(universe.valid_ask(b, a, s), 1)).alias("asks"), F.count(F.when(universe.valid_bid(b, a), 1)).alias("bids"), F.count(F.when(universe.valid_both(b, a), 1)).alias("both_sides"), F.round(F.sum(universe.spread(b, a)), 4).alias("spread"))


@query("p12_complete_bars", f"SELECT symbol, count(*) AS n FROM (SELECT DISTINCT symbol, sec // 60 * 60 AS bar_at FROM ({TICKS})) WHERE bar_at + 60 <= 1704100000 + symbol GROUP BY 1")
def p12(spark, sf):
    b = ticks(spark, sf).select("symbol", F.expr("sec div 60 * 60").alias("at")).distinct()
    return universe.complete_bars(b, "at", F.lit(1704100000) + F.col("symbol")).groupBy("symbol").agg(F.count("*").alias("n"))


@query("p22_status_ladder", "SELECT CASE WHEN l_tax = 0 THEN 'missing_decision_bar' WHEN 1 - l_discount / 10 >= 0.995 AND l_quantity > 10 THEN 'pass' WHEN 1 - l_discount / 10 >= 0.98 THEN 'warning' ELSE 'insufficient_history' END AS status, count(*) AS n FROM lineitem GROUP BY 1")
def p22(spark, sf):
    s = universe.quality_status(1 - F.col("l_discount") / 10, F.col("l_quantity") > 10, F.when(F.col("l_tax") != 0, 1))
    return load(spark, sf, "lineitem").groupBy(s.alias("status")).agg(F.count("*").alias("n"))


@query(
    "a03_preopen",
    f"""WITH t AS (SELECT symbol, sec // 3600 AS h, us, seq, CASE WHEN kind = 'purchase' THEN price END AS price, CASE WHEN kind = 'purchase' THEN seq % 9 END AS size, CASE WHEN kind = 'view' THEN price END AS bid, CASE WHEN kind = 'view' THEN price + seq % 4 END AS ask FROM ({TICKS})),
    s AS (SELECT symbol, h, arg_max(price, (us, seq)) FILTER (price IS NOT NULL) AS last_, sum(size) AS volume, min(ask - bid) FILTER (bid > 0 AND ask >= bid) / arg_max((ask + bid) / 2, (us, seq)) FILTER (bid > 0 AND ask >= bid) * 1e4 AS spread, count(*) FILTER (bid > 0 AND ask >= bid) AS quotes FROM t GROUP BY 1, 2),
    r AS (SELECT symbol, ln(last_ / lag(last_) OVER (PARTITION BY symbol ORDER BY h)) AS r FROM s WHERE last_ > 0), v AS (SELECT symbol, sqrt(coalesce(sum(r * r), 0)) AS rv FROM r GROUP BY 1),
    g AS (SELECT symbol, CAST(sum(volume) AS BIGINT) AS volume, round(median(spread), 6) AS median_spread_bps, count(last_) AS trade_seconds, CAST(sum(quotes) AS BIGINT) AS quote_count, count(spread) AS quote_seconds FROM s GROUP BY 1)
    SELECT symbol, volume, median_spread_bps, trade_seconds, quote_count, quote_seconds, round(rv, 6) AS realized_vol FROM g LEFT JOIN v USING (symbol)""",
)
def a03(spark, sf):
    t, k = ticks(spark, sf), F.col("kind")
    trade, quote = k == "purchase", k == "view"
    t = t.select("symbol", F.expr("sec div 3600").alias("h"), "us", "seq", F.when(trade, F.col("price")).alias("p"), F.when(trade, F.col("seq") % 9).alias("size"), F.when(quote, F.col("price")).alias("bid"), F.when(quote, F.col("price") + F.col("seq") % 4).alias("ask")).withColumnRenamed("p", "price")
    return rounded(universe.preopen_summary(t, ["symbol"], "h", ["us", "seq"]))


@query(
    "a25_microstructure",
    f"SELECT symbol, round(median(n), 6) AS median_n, round(quantile_cont(n, 0.9), 6) AS p90_n, max(high - low) AS max_range FROM (SELECT symbol, sec // 86400 AS d, count(*)::DOUBLE AS n, max(price) AS high, min(price) AS low FROM ({TICKS}) GROUP BY 1, 2) GROUP BY 1",
)
def a25(spark, sf):
    d = ticks(spark, sf).groupBy("symbol", F.expr("sec div 86400").alias("d")).agg(F.count("*").cast("double").alias("n"), F.max("price").alias("high"), F.min("price").alias("low"))
    return d.groupBy("symbol").agg(F.round(F.median("n"), 6).alias("median_n"), F.round(F.percentile("n", 0.9), 6).alias("p90_n"), F.max(F.col("high") - F.col("low")).alias("max_range"))


@query("a32_retention", "SELECT c_custkey AS id, count(o_orderkey) AS orders, count(o_orderkey) FILTER (o_totalprice > 200000) AS large FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def a32(spark, sf):
    n = load(spark, sf, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.count("*").alias("orders"), F.count(F.when(F.col("o_totalprice") > 200000, 1)).alias("large"))
    return load(spark, sf, "customer").select(F.col("c_custkey").alias("id")).join(n, "id", "left").na.fill(0, ["orders", "large"])


@query("a36_job_counters", "SELECT o_orderstatus AS status, count(*) FILTER (o_totalprice > 150000) AS confirmed, count(*) FILTER (o_totalprice <= 150000) AS other FROM orders GROUP BY 1")
def a36(spark, sf):
    big = F.col("o_totalprice") > 150000
    return load(spark, sf, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count_if(big).alias("confirmed"), F.count_if(~big).alias("other"))


@query("a37_action_dates", "SELECT o_orderpriority AS symbol, count(DISTINCT CAST(o_orderdate AS DATE)) AS n, CAST(min(CAST(o_orderdate AS DATE)) AS VARCHAR) AS first FROM orders WHERE o_totalprice > 300000 GROUP BY 1")
def a37(spark, sf):
    o = load(spark, sf, "orders").where("o_totalprice > 300000").select(F.lit(None).cast("string").alias("symbol"), F.col("o_orderpriority").alias("old_symbol"), F.lit("not a date").alias("ex_date"), F.col("o_orderdate").cast("date").cast("string").alias("process_date"))
    x = universe.action_dates(o, ["symbol", "old_symbol"], ["ex_date", "process_date"])
    return x.select("symbol", F.size("dates").cast("long").alias("n"), F.element_at("dates", 1).cast("string").alias("first"))


@query("a38_active_symbols", f"SELECT DISTINCT symbol FROM ({TICKS}) WHERE kind = 'purchase' AND price > 0 AND sec % 86400 < 34200")
def a38(spark, sf):
    return ticks(spark, sf, "purchase").where("price > 0 and sec % 86400 < 34200").select("symbol").distinct()


@query("a39_date_range", f"WITH d AS ({DAILY}) SELECT symbol, CAST(min(day) AS VARCHAR) AS first, CAST(max(day) AS VARCHAR) AS last, CAST(min(day) - 90 AS VARCHAR) AS before_first FROM d GROUP BY 1")
def a39(spark, sf):
    return daily_orders(spark, sf).groupBy("symbol").agg(F.min("day").cast("string").alias("first"), F.max("day").cast("string").alias("last"), F.date_sub(F.min("day"), 90).cast("string").alias("before_first"))


@query("j02_diagnostics", "SELECT l_orderkey AS order_key, l_linenumber AS line, CASE WHEN o_orderkey IS NULL THEN 'missing_features' ELSE 'ok' END AS status FROM lineitem LEFT JOIN (SELECT * FROM orders WHERE o_totalprice > 100000) ON l_orderkey = o_orderkey")
def j02(spark, sf):
    o = load(spark, sf, "orders").where("o_totalprice > 100000").select("o_orderkey")
    x = load(spark, sf, "lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    return x.select(F.col("l_orderkey").alias("order_key"), F.col("l_linenumber").alias("line"), F.when(F.col("o_orderkey").isNull(), "missing_features").otherwise("ok").alias("status"))


@query("j04_adjusted_raw", f"WITH d AS ({DAILY}), r AS (SELECT symbol, day, n FROM d WHERE n > 1) SELECT d.symbol, CAST(d.day AS VARCHAR) AS day, coalesce(r.n, 0) AS raw_volume, d.n AS volume FROM d LEFT JOIN r USING (symbol, day)")
def j04(spark, sf):
    d = daily_orders(spark, sf).select("symbol", "day", "n")
    x = d.join(d.where("n > 1").withColumnRenamed("n", "raw"), ["symbol", "day"], "left")
    return x.select("symbol", F.col("day").cast("string").alias("day"), F.coalesce("raw", F.lit(0).cast("long")).alias("raw_volume"), F.col("n").alias("volume"))


@query(
    "j11_point_lookup",
    f"WITH b AS (SELECT symbol, sec // 3600 AS h, max(price) AS high FROM ({TICKS}) GROUP BY 1, 2) SELECT s.seq AS sample_id, b.high, CASE WHEN b.high IS NULL THEN 'missing_decision_bar' ELSE 'ok' END AS status FROM ({TICKS}) s LEFT JOIN b ON b.symbol = s.symbol AND b.h = s.sec // 3600 - 1 WHERE s.kind = 'signup'",
)
def j11(spark, sf):
    b = ticks(spark, sf).groupBy("symbol", F.expr("sec div 3600").alias("h")).agg(F.max("price").alias("high"))
    s = ticks(spark, sf, "signup").select("symbol", F.col("seq").alias("sample_id"), (F.expr("sec div 3600") - 1).alias("h"))
    return s.join(b, ["symbol", "h"], "left").select("sample_id", "high", F.when(F.col("high").isNull(), "missing_decision_bar").otherwise("ok").alias("status"))


@query("j13_reference_pivot", f"SELECT sec // 86400 AS day, max(price) FILTER (symbol = 1) AS ref_1, max(price) FILTER (symbol = 2) AS ref_2, max(price) FILTER (symbol = 3) AS ref_3, round((coalesce(max(price) FILTER (symbol = 1), 0) + coalesce(max(price) FILTER (symbol = 2), 0) + coalesce(max(price) FILTER (symbol = 3), 0)) / nullif((count(DISTINCT symbol)), 0), 6) AS proxy FROM ({TICKS}) WHERE symbol IN (1, 2, 3) GROUP BY 1")
def j13(spark, sf):
    x = ticks(spark, sf).where(F.col("symbol").isin(1, 2, 3)).groupBy(F.expr("sec div 86400").alias("day")).pivot("symbol", [1, 2, 3]).agg(F.max("price"))
    x = x.select("day", *(F.col(str(k)).alias(f"ref_{k}") for k in (1, 2, 3)))
    refs = [F.col(f"ref_{k}") for k in (1, 2, 3)]
    return x.withColumn("proxy", F.round(sum((F.coalesce(r, F.lit(0.0)) for r in refs), F.lit(0.0)) / sum((r.isNotNull().cast("int") for r in refs), F.lit(0)), 6))


@query("j19_first_dataset", "SELECT o_custkey AS customer, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day, min(o_orderkey) AS dataset FROM orders GROUP BY 1, 2")
def j19(spark, sf):
    o = load(spark, sf, "orders").select(F.col("o_custkey").alias("customer"), F.col("o_orderdate").cast("date").cast("string").alias("day"), F.col("o_orderkey").alias("dataset"))
    return ordered.top_k(o, ["customer", "day"], ["dataset"], 1, "k").drop("k")


@query("j25_reuse_key", "SELECT DISTINCT substr(sha256(concat_ws('|', o_custkey, o_orderpriority)), 1, 20) AS reuse_key FROM orders")
def j25(spark, sf):
    return load(spark, sf, "orders").select(F.substring(F.sha2(F.concat_ws("|", "o_custkey", "o_orderpriority"), 256), 1, 20).alias("reuse_key")).distinct()


@query("o05_truncation", "SELECT count(*) AS kept, (SELECT count(*) FROM lineitem) > 5000 AS truncated FROM (SELECT 1 FROM lineitem LIMIT 5000)")
def o05(spark, sf):
    n = load(spark, sf, "lineitem").limit(5001).agg(F.count("*").alias("n"))
    return n.select(F.least("n", F.lit(5000).cast("long")).alias("kept"), (F.col("n") > 5000).alias("truncated"))


@query("r02_hour_windows", f"SELECT kind, sec // 3600 * 3600 AS start, count(*) AS n, round(sum(price), 4) AS v FROM ({TICKS}) GROUP BY 1, 2")
def r02(spark, sf):
    e = load(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    x = e.groupBy(F.window("ts", "1 hour"), F.col("event_type").alias("kind")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("v"))
    return x.select("kind", F.unix_seconds("window.start").alias("start"), "n", "v")


@query(
    "r04_session_windows",
    f"WITH x AS (SELECT symbol, us, CASE WHEN us - lag(us) OVER w < 7200000000 THEN 0 ELSE 1 END AS fresh FROM ({TICKS}) WINDOW w AS (PARTITION BY symbol ORDER BY us)), y AS (SELECT symbol, us, sum(fresh) OVER (PARTITION BY symbol ORDER BY us ROWS UNBOUNDED PRECEDING) AS s FROM x) SELECT symbol, count(DISTINCT s) AS sessions, count(*) AS n FROM y GROUP BY 1",
)
def r04(spark, sf):
    from tidemark.streaming.stateful import sessions

    e = load(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp")).withColumnRenamed("user_id", "symbol")
    return sessions(e, ["symbol"], "2 hours").groupBy("symbol").agg(F.count("*").alias("sessions"), F.sum("n").alias("n"))


@query("k09_group_parts", "SELECT count(DISTINCT o_custkey) AS groups, 0 AS split_groups, CAST(count(*) * 100 AS BIGINT) AS bytes, 0 AS parts_over_limit, count(*) AS rows FROM orders")
def k09(spark, sf):
    from tidemark.sources.writers import grouped_parts, manifest

    o = load(spark, sf, "orders").select(F.col("o_custkey").alias("grp"), F.lit(100).cast("long").alias("size"))
    parts = grouped_parts(o, "grp", "size", 20000)
    split = parts.groupBy("grp").agg(F.count_distinct("part").alias("n")).agg(F.count("*").alias("groups"), F.count_if(F.col("n") > 1).cast("int").alias("split_groups"))
    m = manifest(parts, "part", "size").agg(F.sum("bytes").alias("bytes"), F.count_if(F.col("bytes") > 20000).cast("int").alias("parts_over_limit"), F.sum("rows").alias("rows"))
    return split.join(F.broadcast(m))


@query("w16_control_rank", f"SELECT symbol, seq, row_number() OVER (PARTITION BY symbol ORDER BY price DESC, sha256(CAST(seq AS VARCHAR))) AS rank FROM ({TICKS}) WHERE kind = 'error'")
def w16(spark, sf):
    w = W.partitionBy("symbol").orderBy(F.desc("price"), F.sha2(F.col("seq").cast("string"), 256))
    return ticks(spark, sf, "error").select("symbol", "seq", F.row_number().over(w).alias("rank"))
