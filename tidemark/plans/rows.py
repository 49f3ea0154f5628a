"""Queries over row-level operators: scalar functions, normalised rows, filters, samples and bookkeeping, each with its oracle."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import scalar
from tidemark.operators import splits, tape, universe
from tidemark.plans.catalog import query
from tidemark.plans.tables import DAILY, TICKS, daily_orders, load, rounded, ticks

# --- scalar functions ---------------------------------------------------------


@query(
    "f10_ns_codec",
    "SELECT event_id AS id, epoch_us(ts) * 1000 + event_id % 1000 AS ns, strftime(make_timestamp(epoch_us(ts) // 1000000 * 1000000), '%Y-%m-%dT%H:%M:%S') || '.' || lpad(CAST((epoch_us(ts) % 1000000) * 1000 + event_id % 1000 AS VARCHAR), 9, '0') || 'Z' AS text FROM events",
)
def f10(spark, sf):
    e = load(spark, sf, "events").select(F.col("event_id").alias("id"), (F.unix_micros(F.col("ts").cast("timestamp")) * 1000 + F.col("event_id") % 1000).alias("ns"))
    return e.select("id", scalar.ts_ns(scalar.ns_text(F.col("ns"))).alias("ns"), scalar.ns_text(F.col("ns")).alias("text"))


@query(
    "f12_session_label",
    f"SELECT seq AS id, CASE WHEN m < 240 THEN 'overnight' WHEN m < 570 THEN 'premarket' WHEN m < 960 THEN 'regular' WHEN m < 1200 THEN 'afterhours' ELSE 'overnight' END AS session FROM (SELECT seq, hour(timezone('America/New_York', to_timestamp(sec))) * 60 + minute(timezone('America/New_York', to_timestamp(sec))) AS m FROM ({TICKS}))",
)
def f12(spark, sf):
    return ticks(spark, sf).select(F.col("seq").alias("id"), scalar.session_label(F.timestamp_seconds("sec")).alias("session"))


@query("f03_frozen_score", "SELECT l_orderkey AS id, l_linenumber AS line, round(((ln(1 + l_quantity * 100) - 8.18382400) / 4.74614788 - (ln(1 + l_discount * 1000) - 6.35332542) / 1.52922959 + (l_tax - 0.18287512) / 0.22326549) / 3, 6) AS score FROM lineitem")
def f03(spark, sf):
    return load(spark, sf, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), F.round(universe.frozen_score(F.col("l_quantity") * 100, F.col("l_discount") * 1000, F.col("l_tax")), 6).alias("score"))


@query(
    "f05_interval_return",
    "SELECT l_orderkey AS id, l_linenumber AS line, CASE WHEN l_quantity - 20 > -100 AND 1 + (l_discount * 4000 - 300) / 100 > 0 THEN round(((1 + (l_quantity - 20) / 100) / (1 + (l_discount * 4000 - 300) / 100) - 1) * 100, 6) END AS ret, CASE WHEN l_extendedprice - 30000 > 0 THEN round(30000 / ((l_extendedprice - 30000) / 2), 6) END AS rate FROM lineitem WHERE abs(l_discount * 4000 - 200) > 1",
)
def f05(spark, sf):
    x = load(spark, sf, "lineitem").where(F.abs(F.col("l_discount") * 4000 - 200) > 1)
    return x.select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), F.round(scalar.interval_return(F.col("l_quantity") - 20, F.col("l_discount") * 4000 - 300), 6).alias("ret"), F.round(scalar.earlier_rate(F.lit(30000.0), F.col("l_extendedprice"), 2), 6).alias("rate"))


@query(
    "f13_match_tier",
    "SELECT id, CASE WHEN abs(o) = 0 AND w THEN 'exact_clock_same_weekday' WHEN abs(o) = 0 THEN 'exact_clock' WHEN abs(o) <= 15 AND w THEN 'within_15m_same_weekday' WHEN abs(o) <= 15 THEN 'within_15m' WHEN abs(o) <= 30 THEN 'within_30m' ELSE 'within_60m' END AS tier FROM (SELECT o_orderkey AS id, (o_orderkey % 9 - 4) * 15 AS o, dayofweek(o_orderdate) = dayofweek(DATE '1996-01-01') AS w FROM orders)",
)
def f13(spark, sf):
    same = F.weekday("o_orderdate") == F.weekday(F.lit("1996-01-01").cast("date"))
    return load(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), scalar.match_tier((F.col("o_orderkey") % 9 - 4) * 15, same).alias("tier"))


@query("f15_quote_size", "SELECT o_orderkey AS id, CASE WHEN CAST(o_orderdate AS DATE) >= DATE '1995-06-01' THEN o_custkey ELSE o_custkey * 100 END AS shares FROM orders")
def f15(spark, sf):
    return load(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), scalar.quote_size_shares(F.col("o_custkey"), F.col("o_orderdate").cast("date"), "1995-06-01").alias("shares"))


@query("f16_safe_name", "SELECT p_partkey AS id, regexp_replace(p_name || '/' || p_brand, '[^A-Za-z0-9._-]', '_', 'g') AS name FROM part")
def f16(spark, sf):
    return load(spark, sf, "part").select(F.col("p_partkey").alias("id"), scalar.safe_name(F.concat_ws("/", "p_name", "p_brand")).alias("name"))


@query("f17_invalid_symbols", "SELECT o_custkey % 500 AS code, 'A' || (o_custkey % 7) || ',B' || (o_custkey % 500) AS symbols FROM orders GROUP BY ALL")
def f17(spark, sf):
    c = F.col("o_custkey")
    text = F.concat(F.lit('code=400, {"message":"Invalid symbol(s): b'), c % 500, F.lit(", '%61"), c % 7, F.lit("'\"}"))
    return load(spark, sf, "orders").select((c % 500).alias("code"), F.concat_ws(",", scalar.invalid_symbols(text)).alias("symbols")).distinct()


@query("f20_universe_hash", "SELECT sha256('[' || string_agg('\"' || s || '\"', ',' ORDER BY s) || ']') AS sha256 FROM (SELECT DISTINCT p_brand AS s FROM part)")
def f20(spark, sf):
    return universe.universe_hash(load(spark, sf, "part"), "p_brand")


@query("f22_json_ready", "SELECT l_orderkey AS id, l_linenumber AS line, CASE WHEN l_tax <> 0 THEN round(l_discount / l_tax, 6) END AS ratio, strftime(l_shipdate, '%Y-%m-%dT%H:%M:%S') || '+00:00' AS shipped FROM lineitem")
def f22(spark, sf):
    bad = F.when(F.col("l_discount") > 0, F.lit(float("inf"))).otherwise(F.lit(float("nan")))
    return load(spark, sf, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), F.round(scalar.finite_text(F.when(F.col("l_tax") != 0, F.col("l_discount") / F.col("l_tax")).otherwise(bad)), 6).alias("ratio"), scalar.iso_text(F.col("l_shipdate").cast("timestamp")).alias("shipped"))


FLAGS = "list_filter([CASE WHEN o_totalprice < 50000 THEN 'Trades_Missing' END, CASE WHEN o_orderstatus = 'P' THEN 'partial' END, CASE WHEN o_orderkey % 3 = 0 THEN 'quote_recovered' END], lambda x: x IS NOT NULL)"


def _flags():
    return F.array_compact(F.array(F.when(F.col("o_totalprice") < 50000, F.lit("Trades_Missing")), F.when(F.col("o_orderstatus") == "P", F.lit("partial")), F.when(F.col("o_orderkey") % 3 == 0, F.lit("quote_recovered"))))


@query("f23_flag_union", f"SELECT o_orderkey AS id, array_to_string(list_sort(list_distinct(list_concat({FLAGS}, ['partial']))), ',') AS flags, len(list_filter({FLAGS}, lambda f: contains(lower(f), 'missing') OR contains(lower(f), 'recovered'))) > 0 AS hit FROM orders")
def f23(spark, sf):
    return load(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.concat_ws(",", scalar.flag_union(_flags(), F.array(F.lit("partial")), F.lit(None).cast("array<string>"))).alias("flags"), scalar.any_flag_like(_flags(), ["missing", "recovered"]).alias("hit"))


@query("f24_rejection_counts", f"SELECT o_custkey % 40 AS grp, string_agg(f || '=' || n, ',' ORDER BY f) AS counts FROM (SELECT o_custkey % 40 AS o_custkey, f, count(*) AS n FROM (SELECT o_custkey, unnest({FLAGS}) AS f FROM orders) GROUP BY 1, 2) GROUP BY 1")
def f24(spark, sf):
    x = universe.rejection_counts(load(spark, sf, "orders").withColumn("flags", _flags()).withColumn("grp", F.col("o_custkey") % 40), "grp", "flags")
    return x.select("grp", F.concat_ws(",", F.transform(F.map_entries("counts"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))).alias("counts"))


# --- projections and filters -----------------------------------------------------

ASSETS = ("USDT", "USDC", "FDUSD", "BUSD", "ETHUP", "BTC", "JUP", "DOGE", "BTCDOWN", "EUR")


def symbols(spark, sf):
    """A symbol master made of orders: assets, quotes, permissions and order types vary with the key."""
    k, name = F.col("o_orderkey"), F.array(*map(F.lit, ASSETS))
    quote = F.get(F.array(F.lit("USDT"), F.lit("USDC"), F.lit("XYZ")), (k % 3).cast("int"))
    base = F.get(name, (k % 10).cast("int"))
    spot = F.array(F.lit("SPOT"))
    return load(spark, sf, "orders").select(
        F.concat(base, quote, k % 50).alias("symbol"), base.alias("base_asset"), quote.alias("quote_asset"), F.when(F.col("o_orderstatus") == "F", "BREAK").otherwise("TRADING").alias("status"), F.when(k % 4 == 0, spot).otherwise(F.array().cast("array<string>")).alias("permissions"), F.when(k % 4 == 1, F.array(F.array(F.lit("MARGIN")), spot)).alias("permission_sets"), F.when(k % 5 == 0, F.array(F.lit("MARKET"))).otherwise(F.array(F.lit("LIMIT"), F.lit("MARKET"))).alias("order_types"),
    ).distinct()


SYMBOLS = """SELECT DISTINCT base || quote || k % 50 AS symbol, base AS base_asset, quote AS quote_asset, status, k % 4 < 2 AS spot, k % 5 = 0 AS no_limit, base IN ('USDT', 'USDC', 'FDUSD', 'TUSD', 'USDP', 'DAI', 'EUR', 'GBP', 'TRY', 'BRL', 'AUD') AS stable_like, regexp_matches(base, '(UP|DOWN|BULL|BEAR)$') AS leveraged
    FROM (SELECT o_orderkey AS k, ['USDT', 'USDC', 'FDUSD', 'BUSD', 'ETHUP', 'BTC', 'JUP', 'DOGE', 'BTCDOWN', 'EUR'][o_orderkey % 10 + 1] AS base, ['USDT', 'USDC', 'XYZ'][o_orderkey % 3 + 1] AS quote, CASE WHEN o_orderstatus = 'F' THEN 'BREAK' ELSE 'TRADING' END AS status FROM orders)"""


@query("p01_symbol_class", f"SELECT symbol, status, spot, stable_like, leveraged, count(*) AS n FROM ({SYMBOLS}) GROUP BY ALL")
def p01(spark, sf):
    x = universe.classify_symbols(symbols(spark, sf).select("symbol", "base_asset", "quote_asset", "status", "permissions", "permission_sets", "order_types"))
    return x.withColumn("no_limit", ~F.array_contains("order_types", "LIMIT")).select("symbol", "base_asset", "quote_asset", "status", "spot", "no_limit", "stable_like", "leveraged").distinct().groupBy("symbol", "status", "spot", "stable_like", "leveraged").agg(F.count("*").alias("n"))


@query("p03_tradable", f"SELECT base_asset, arg_min(symbol, (CASE quote_asset WHEN 'USDC' THEN 1 ELSE 2 END, symbol)) AS symbol FROM ({SYMBOLS}) WHERE quote_asset IN ('USDC', 'USDT') AND status = 'TRADING' AND spot AND NOT no_limit GROUP BY 1")
def p03(spark, sf):
    return universe.tradable(universe.classify_symbols(symbols(spark, sf)), ["USDC", "USDT"]).select("base_asset", "symbol")


@query(
    "p02_kline_parse",
    f"SELECT 'S' || symbol AS symbol, '1m' AS \"interval\", strftime(make_timestamp(sec // 60 * 60000000), '%Y-%m-%dT%H:%M:%S') || '+00:00' AS open_time, strftime(make_timestamp(sec // 60 * 60000000 + 59999000), '%Y-%m-%dT%H:%M:%S.') || '999000+00:00' AS close_time, price AS open, price + 1 AS high, price - 1 AS low, price AS close, CAST(seq AS DOUBLE) AS volume, price * 2 AS quote_volume, seq % 9 AS trade_count, 1.5::DOUBLE AS taker_buy_base_volume, 2.5::DOUBLE AS taker_buy_quote_volume FROM ({TICKS})",
)
def p02(spark, sf):
    ms = F.expr("sec div 60 * 60000")
    t = lambda c: c.cast("string")
    raw = F.array(t(ms), t(F.col("price")), t(F.col("price") + 1), t(F.col("price") - 1), t(F.col("price")), t(F.col("seq")), t(ms + 59999), t(F.col("price") * 2), t(F.col("seq") % 9), F.lit("1.5"), F.lit("2.5"), F.lit("0"))
    return universe.parse_klines(ticks(spark, sf).select(F.concat(F.lit("S"), "symbol").alias("symbol"), F.lit("1m").alias("interval"), raw.alias("row")))


def _raw(spark, sf):
    """Raw trade, quote and bar rows with text stamps and missing parts."""
    x = load(spark, sf, "events").select(F.col("user_id").alias("symbol"), "event_id", "value", (F.unix_micros(F.col("ts").cast("timestamp")) * 1000 + 7).alias("ns"))
    return x.withColumn("t", scalar.ns_text(F.col("ns"))).withColumn("v", F.when(F.col("event_id") % 5 != 0, F.col("value")))


NORM = "SELECT user_id AS symbol, event_id, CASE WHEN event_id % 5 <> 0 THEN value ELSE 0 END AS v, hour(timezone('America/New_York', to_timestamp(epoch_us(ts) // 1000000))) * 60 + minute(timezone('America/New_York', to_timestamp(epoch_us(ts) // 1000000))) AS m FROM events"
LABEL = "CASE WHEN m < 240 THEN 'overnight' WHEN m < 570 THEN 'premarket' WHEN m < 960 THEN 'regular' WHEN m < 1200 THEN 'afterhours' ELSE 'overnight' END"


@query("p04_trades", f"SELECT symbol, event_id, v AS price, event_id % 3 AS size_shares, '' AS exchange, CAST(event_id AS VARCHAR) AS trade_id, {LABEL} AS session FROM ({NORM})")
def p04(spark, sf):
    raw = _raw(spark, sf).select("symbol", "t", F.col("v").alias("p"), (F.col("event_id") % 3).alias("s"), F.lit(None).cast("string").alias("x"), F.lit(None).cast("array<string>").alias("c"), F.col("event_id").cast("string").alias("i"), F.lit("C").alias("z"))
    x = universe.normalize_trades(raw, "w")
    return x.select("symbol", F.col("trade_id").cast("long").alias("event_id"), "price", "size_shares", "exchange", "trade_id", "session")


@query("p05_quotes", f"SELECT symbol, event_id, v AS bid_price, CASE WHEN event_id % 2 = 0 THEN event_id % 4 ELSE event_id % 4 * 100 END AS bid_size_shares, CASE WHEN v <> 0 THEN round(v + 1 - v, 6) END AS spread, {LABEL} AS session FROM ({NORM})")
def p05(spark, sf):
    raw = _raw(spark, sf).select("symbol", "t", F.col("v").alias("bp"), (F.col("event_id") % 4).alias("bs"), F.col("event_id").cast("string").alias("bx"), (F.coalesce("v", F.lit(0.0)) + 1).alias("ap"), (F.col("event_id") % 4).alias("as"), F.lit("Q").alias("ax"), F.lit(None).cast("array<string>").alias("c"), F.lit("C").alias("z"))
    day = F.when(F.col("bx").cast("long") % 2 == 0, F.lit("2026-01-05").cast("date")).otherwise(F.lit("2025-01-06").cast("date"))
    x = universe.normalize_quotes(raw, "w", day)
    return x.select("symbol", F.col("bid_exchange").cast("long").alias("event_id"), "bid_price", "bid_size_shares", F.round("spread", 6).alias("spread"), "session")


@query("p06_bars", f"SELECT symbol, event_id, v AS open, v + 1 AS high, v AS close, event_id AS volume, '1Min' AS timeframe, {LABEL} AS session FROM ({NORM})")
def p06(spark, sf):
    v = F.coalesce("v", F.lit(0.0))
    raw = _raw(spark, sf).select("symbol", "t", F.col("v").alias("o"), (v + 1).alias("h"), F.col("v").alias("l"), F.col("v").alias("c"), F.col("event_id").alias("vol"), F.lit(None).cast("long").alias("n"), F.lit(None).cast("double").alias("vw")).withColumnRenamed("vol", "v")
    return universe.normalize_bars(raw, "w", "1Min", "raw").select("symbol", F.col("volume").alias("event_id"), "open", "high", "close", "volume", "timeframe", "session")


@query("p08_day_high_prefilter", f"WITH d AS ({DAILY}), x AS (SELECT *, lag(close) OVER (PARTITION BY symbol ORDER BY day) AS prior FROM d) SELECT symbol, CAST(day AS VARCHAR) AS day, high, prior AS prior_close FROM x WHERE prior > 0 AND high >= prior * 1.25")
def p08(spark, sf):
    return universe.day_high_prefilter(daily_orders(spark, sf), ["symbol"], "day").select("symbol", F.col("day").cast("string").alias("day"), "high", "prior_close")


@query("p09_regular_bars", f"SELECT symbol, count(*) AS n, round(sum(price), 4) AS v FROM ({TICKS}) WHERE sec % 86400 >= 34200 AND sec % 86400 < 57600 AND price > 0 AND price - 10 > 0 GROUP BY 1")
def p09(spark, sf):
    b = ticks(spark, sf).select("symbol", "sec", F.col("price").alias("open"), F.col("price").alias("high"), (F.col("price") - 10).alias("low"), F.col("price").alias("close"), F.expr("sec - sec % 86400 + 34200").alias("o"), F.expr("sec - sec % 86400 + 57600").alias("c"))
    return universe.regular_bars(b, "sec", "o", "c").groupBy("symbol").agg(F.count("*").alias("n"), F.round(F.sum("open"), 4).alias("v"))


@query("p11_ns_cutoff", f"SELECT kind, count(*) AS n FROM ({TICKS}) WHERE us * 1000 + seq % 1000 < 1704500000000000000 + symbol GROUP BY 1")
def p11(spark, sf):
    x = ticks(spark, sf).withColumn("ns", F.col("us") * 1000 + F.col("seq") % 1000)
    return universe.before_ns(x, "ns", F.lit(1704500000000000000) + F.col("symbol")).groupBy("kind").agg(F.count("*").alias("n"))


@query("p13_symbol_like", "SELECT p_partkey AS id, regexp_matches(upper(trim(s)), '^[A-Z][A-Z0-9.\\-]{0,14}$') AS ok FROM (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN ' brk.b ' WHEN 1 THEN '12345678X' WHEN 2 THEN p_brand ELSE substr(p_name, 1, 6) END AS s FROM part)")
def p13(spark, sf):
    k = F.col("p_partkey") % 4
    s = F.when(k == 0, F.lit(" brk.b ")).when(k == 1, F.lit("12345678X")).when(k == 2, F.col("p_brand")).otherwise(F.substring("p_name", 1, 6))
    return load(spark, sf, "part").select(F.col("p_partkey").alias("id"), scalar.symbol_like(s).alias("ok"))


@query("p14_split_sanity", "SELECT l_returnflag AS flag, count(*) AS n FROM lineitem WHERE l_tax = 0 OR l_quantity / 25 BETWEEN 0.9 AND 1.1 GROUP BY 1")
def p14(spark, sf):
    return load(spark, sf, "lineitem").where(universe.split_sane(F.when(F.col("l_tax") != 0, F.col("l_quantity") / 25))).groupBy(F.col("l_returnflag").alias("flag")).agg(F.count("*").alias("n"))


@query(
    "p15_eligible",
    "WITH x AS (SELECT o_custkey % 300 AS match_group_id, o_orderkey AS id, CASE WHEN o_orderkey % 4 = 0 THEN 1 ELSE 0 END AS label, CASE WHEN o_orderstatus = 'P' THEN 'warning' ELSE 'pass' END AS status, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderkey % 5 = 0 END AS bad FROM orders), e AS (SELECT * FROM x WHERE status = 'pass' AND NOT (label = 0 AND coalesce(bad, FALSE))) SELECT match_group_id, id, label FROM e WHERE match_group_id IN (SELECT match_group_id FROM e GROUP BY 1 HAVING count(*) FILTER (label = 1) = 1 AND count(*) FILTER (label = 0) >= 1)",
)
def p15(spark, sf):
    k = F.col("o_orderkey")
    x = load(spark, sf, "orders").select((F.col("o_custkey") % 300).alias("match_group_id"), k.alias("id"), F.when(k % 4 == 0, 1).otherwise(0).alias("label"), F.when(F.col("o_orderstatus") == "P", "warning").otherwise("pass").alias("feature_quality_status"), F.when(k % 7 != 0, k % 5 == 0).alias("pseudo_window_contaminated_control"))
    return universe.eligible_samples(x).select("match_group_id", "id", "label")


@query("p17_cohort_flags", f"SELECT o_orderkey AS id, o_orderkey % 6 > 0 AND o_custkey % 3 > 0 AND (o_orderkey % 5 = 0 OR o_orderkey % 2 = 0) AS core, o_orderkey % 6 > 0 AND o_custkey % 3 > 0 AND (o_orderkey % 5 = 0 OR o_orderkey % 2 = 0) AND (o_orderkey % 3 <> 0 AND o_totalprice >= 50000) AND o_custkey % 4 <> 0 AS clean FROM (SELECT *, {FLAGS} AS f FROM orders)")
def p17(spark, sf):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    ca = F.when(c % 4 == 0, F.array(F.lit("x:corporate_actions_point_in_time_publication_unverified:y")))
    x = load(spark, sf, "orders").select(k.alias("id"), (k % 6).alias("trades"), (c % 3).alias("quotes"), F.when(k % 5 != 0, k % 2 == 0).alias("currently_tradable"), universe.positive_tier(_flags(), F.lit(None).cast("double")).alias("positive_tier"), F.lit(None).cast("array<string>").alias("pair_flags"), ca.alias("observation_flags"), F.array(F.lit("z")).alias("assessment_flags"))
    return universe.cohort_flags(x).select("id", F.col("cohort_core_usable").alias("core"), F.col("cohort_primary_clean").alias("clean"))


@query("p18_positive_tier", f"SELECT o_orderkey AS id, CASE WHEN NOT (o_totalprice / 150000 BETWEEN 0.9 AND 1.1) AND o_orderkey % 2 = 0 THEN 'extended' WHEN o_totalprice < 50000 OR o_orderkey % 3 = 0 THEN 'extended' ELSE 'primary_clean' END AS tier FROM orders")
def p18(spark, sf):
    text = F.when(F.size(_flags()) > 0, F.to_json(_flags())).otherwise(F.lit(" "))
    scale = F.when(F.col("o_orderkey") % 2 == 0, F.col("o_totalprice") / 150000)
    return load(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), universe.positive_tier(scalar.flag_list(text), scale).alias("tier"))


@query("p19_allow_list", "SELECT o_custkey, o_orderkey, o_totalprice FROM orders")
def p19(spark, sf):
    return universe.allow_list(load(spark, sf, "orders"), ["o_totalprice", "o_orderkey", "o_custkey", "not_there"])


@query("p24_json_default", "SELECT event_id AS id, CASE WHEN event_id % 3 = 0 THEN 0 ELSE 1 END AS parsed, CASE WHEN event_id % 3 = 1 THEN 2 ELSE 0 END AS listed FROM events")
def p24(spark, sf):
    k = F.col("event_id")
    x = load(spark, sf, "events").select(k.alias("id"), F.when(k % 3 == 0, F.lit("{not json")).otherwise(F.col("props")).alias("a"), F.when(k % 3 == 1, F.lit('["x","y"]')).when(k % 3 == 2, F.lit("[bad")).alias("b"))
    parsed = scalar.json_object(F.col("a"), "map<string,string>")
    return x.select("id", F.least(F.size(parsed), F.lit(1)).alias("parsed"), F.size(F.array_compact(scalar.json_object(F.col("b"), "array<string>"))).alias("listed"))


@query("p25_search", "SELECT p_partkey AS id FROM part WHERE contains(lower(p_name), 'an') OR contains(lower(p_brand), 'an')")
def p25(spark, sf):
    return universe.search(load(spark, sf, "part"), "AN", ["p_name", "p_brand"]).select(F.col("p_partkey").alias("id"))


@query(
    "p26_samples",
    """WITH e AS (SELECT event_id AS id, user_id AS symbol, date_trunc('minute', ts) AS x, event_id % 480 + 1 AS d, event_id % 3 = 0 AS resolved FROM events WHERE event_type = 'signup'),
    s AS (SELECT 'event:' || id AS sample_id, CAST(id AS VARCHAR) AS match_group_id, 1 AS label, epoch(x) - d * 60 AS baseline, epoch(x) AS crossed, d AS minutes, CASE WHEN resolved THEN 'resolved_trade_minute' ELSE 'scanner_minute_fallback' END AS how FROM e),
    c AS (SELECT 'control:c' || id AS sample_id, CAST(id AS VARCHAR) AS match_group_id, 0 AS label, epoch(x) + 86400 - d * 60 AS baseline, epoch(x) + 86400 AS crossed, d AS minutes, 'pseudo_baseline_same_event_duration' AS how FROM e)
    SELECT sample_id, match_group_id, label, CAST(baseline AS BIGINT) AS baseline, CAST(crossed AS BIGINT) AS crossed, minutes, how FROM (SELECT * FROM s UNION ALL SELECT * FROM c)""",
)
def p26(spark, sf):
    e = load(spark, sf, "events").where("event_type = 'signup'").withColumn("ts", F.col("ts").cast("timestamp"))
    minute = F.date_trunc("minute", "ts")
    base = F.timestamp_seconds(F.unix_seconds(minute) - (F.col("event_id") % 480 + 1) * 60)
    ev = e.select(F.col("event_id").alias("id"), F.col("user_id").alias("symbol"), F.col("ts").alias("first_cross_time"), F.lit(None).cast("timestamp").alias("first_cross_trade_time"), base.alias("baseline_time"), base.alias("baseline_trade_time"), (F.col("event_id") % 3 != 0).alias("baseline_trade_unresolved"), F.lit(None).cast("long").alias("minutes_baseline_open_to_cross_open"))
    s = universe.event_samples(ev, F.lit("discovery"))
    m = e.select(F.concat(F.lit("c"), "event_id").alias("control_id"), "event_id", F.lit("discovery").alias("split"), F.col("user_id").alias("symbol"), (F.col("ts") + F.expr("INTERVAL 1 DAY")).alias("control_anchor_time"), F.lit(1).alias("control_rank"))
    x = s.unionByName(universe.control_samples(m, s))
    return x.select("sample_id", "match_group_id", "label", F.unix_seconds("baseline_anchor_time").alias("baseline"), F.unix_seconds("cross_anchor_time").alias("crossed"), F.col("baseline_to_cross_minutes").alias("minutes"), F.col("baseline_resolution").alias("how"))


@query("p28_asset_universe", "SELECT symbol, arg_min(id, (CASE WHEN status = 'active' THEN 0 ELSE 1 END, id)) AS id FROM (SELECT p_partkey AS id, 'B' || substr(p_brand, 7, 2) || '.A' AS symbol, CASE WHEN p_size % 2 = 0 THEN 'active' ELSE 'inactive' END AS status, CASE WHEN p_partkey % 5 = 0 THEN 'OTC' ELSE 'NYSE' END AS exchange FROM part) WHERE exchange <> 'OTC' GROUP BY 1")
def p28(spark, sf):
    k = F.col("p_partkey")
    a = load(spark, sf, "part").select(k.alias("id"), F.concat(F.lit("b"), F.substring("p_brand", 7, 2), F.lit(".A")).alias("symbol"), F.when(F.col("p_size") % 2 == 0, "active").otherwise("inactive").alias("status"), F.when(k % 5 == 0, "otc").otherwise("NYSE").alias("exchange"), F.lit("us_equity").alias("class"))
    return universe.asset_universe(a.unionByName(a.withColumn("symbol", F.lit("123456789")))).select(F.upper("symbol").alias("symbol"), "id")


# --- joins, sets, counts -------------------------------------------------------------


@query("j20_event_files", "SELECT o_orderkey AS event_id, l_linenumber AS file FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_returnflag = 'R' AND l_linestatus = 'F' AND o_totalprice > 100000")
def j20(spark, sf):
    ev = load(spark, sf, "orders").where("o_totalprice > 100000").select(F.col("o_orderkey").alias("event_id"))
    files = load(spark, sf, "lineitem").select(F.col("l_orderkey").alias("event_id"), F.col("l_linenumber").alias("file"), F.col("l_returnflag").alias("kind"), F.concat(F.lit("s3/x/"), "l_linestatus", F.lit("/part.parquet")).alias("path"))
    return universe.files_of(ev, files, "R", "/F/").select("event_id", "file")


@query("j22_without_positives", f"WITH t AS (SELECT symbol, sec // 86400 AS day, kind FROM ({TICKS})) SELECT DISTINCT symbol, day FROM t WHERE kind = 'view' AND NOT EXISTS (SELECT 1 FROM t p WHERE p.kind = 'purchase' AND p.symbol = t.symbol AND p.day = t.day) AND NOT EXISTS (SELECT 1 FROM t u WHERE u.kind = 'error' AND u.symbol = t.symbol AND u.day = t.day)")
def j22(spark, sf):
    t = ticks(spark, sf).select("symbol", F.expr("sec div 86400").alias("day"), "kind")
    of = lambda k: t.where(F.col("kind") == k).select("symbol", "day")
    return universe.without_positives(of("view").distinct(), of("purchase"), ["day"], of("error"))


@query("u06_stalled_jobs", "SELECT o_orderkey AS id FROM orders WHERE o_orderstatus = 'O' AND (CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_orderdate AS TIMESTAMP) ELSE CAST(o_orderdate AS TIMESTAMP) + INTERVAL 10 DAY END) < TIMESTAMP '1997-01-01'")
def u06(spark, sf):
    k, day = F.col("o_orderkey"), F.col("o_orderdate").cast("timestamp")
    jobs = load(spark, sf, "orders").select(k.alias("id"), F.when(F.col("o_orderstatus") == "O", "running").otherwise("completed").alias("status"), F.when(k % 3 != 0, day + F.expr("INTERVAL 10 DAYS")).alias("heartbeat_at"), F.when(k % 6 == 0, day).alias("started_at"), day.alias("created_at"))
    return universe.stalled_jobs(jobs, F.lit("1997-01-01 00:20:00").cast("timestamp")).select("id")


@query("o06_max_events", "SELECT o_orderkey AS id FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 25")
def o06(spark, sf):
    return load(spark, sf, "orders").orderBy(F.desc("o_orderdate"), "o_orderkey").limit(25).select(F.col("o_orderkey").alias("id"))


@query(
    "a04_seller_tape",
    """WITH x AS (SELECT l_suppkey AS symbol, l_orderkey * 10 + l_linenumber AS seq, l_extendedprice AS tie, l_extendedprice / l_quantity AS price, l_quantity AS size, l_linestatus = 'F' AS seller FROM lineitem), y AS (SELECT *, price * size AS v, CASE WHEN seller THEN price * size ELSE 0 END AS sv, sum(CASE WHEN seller THEN price * size ELSE 0 END) OVER (PARTITION BY symbol ORDER BY seq, tie ROWS UNBOUNDED PRECEDING) AS run FROM x),
    z AS (SELECT *, CASE WHEN seller THEN least(sv, greatest(0, 500000 - (run - sv))) END AS used FROM y)
    SELECT symbol, round(sum(sv), 2) AS sold, round(sum(CASE WHEN seller THEN size ELSE 0 END), 2) AS quantity, round(sum(CASE WHEN seller AND price + 1e-12 >= 1500 THEN v ELSE 0 END), 2) AS sold_above, round(sum(CASE WHEN price + 1e-12 >= 1500 THEN v ELSE 0 END), 2) AS all_above, min(seq) FILTER (seller) AS first_at, min(CASE WHEN seller AND run + 1e-12 >= 500000 THEN seq END) AS hit_at, round(arg_min(price, (seq, tie)) FILTER (seller AND run + 1e-12 >= 500000), 6) AS hit_price, CASE WHEN max(run) + 1e-12 >= 500000 THEN round(500000 / sum(CASE WHEN used > 0 THEN used / price END), 4) END AS vwap FROM z GROUP BY 1""",
)
def a04(spark, sf):
    li = load(spark, sf, "lineitem").select(F.col("l_suppkey").alias("symbol"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("at"), F.col("l_extendedprice").alias("seq"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), F.col("l_quantity").alias("size"), (F.col("l_linestatus") == "F").alias("seller"))
    x = tape.seller_tape(li, ["symbol"], "at", "seq", "price", "size", "seller", F.lit(1500.0), 500000)
    r = lambda c, n, d: F.round(c, d).alias(n)
    return x.select("symbol", r("seller_notional_any_price", "sold", 2), r("seller_base_quantity_any_price", "quantity", 2), r("seller_notional_at_or_above", "sold_above", 2), r("all_trade_notional_at_or_above", "all_above", 2), F.col("first_seller_exit_at").alias("first_at"), F.col("cumulative_hit_at").alias("hit_at"), r("cumulative_hit_price", "hit_price", 6), r("exit_vwap", "vwap", 4))


@query(
    "a28_split_summary",
    """WITH c AS (SELECT CAST(o_orderdate AS DATE) AS day, count(*) AS n FROM orders GROUP BY 1), x AS (SELECT day, n, sum(n) OVER (ORDER BY day) - n AS before_, row_number() OVER (ORDER BY day DESC) AS left_, sum(n) OVER () AS total FROM c),
    s AS (SELECT day, n, CASE WHEN before_ < total * 0.70 AND left_ > 2 THEN 'discovery' WHEN before_ < total * 0.85 AND left_ > 1 THEN 'validation' ELSE 'sealed_test' END AS split FROM x)
    SELECT split, CAST(min(day) AS VARCHAR) AS start_date, CAST(max(day) AS VARCHAR) AS end_date, count(*) AS event_dates, CAST(sum(n) AS BIGINT) AS events FROM s GROUP BY 1""",
)
def a28(spark, sf):
    c = load(spark, sf, "orders").groupBy(F.col("o_orderdate").cast("date").alias("day")).agg(F.count("*").alias("n"))
    x = splits.split_summary(splits.chronological(c, "day", "n"), "day", "n")
    return x.select("split", F.col("start_date").cast("string").alias("start_date"), F.col("end_date").cast("string").alias("end_date"), "event_dates", "events")


@query("a35_dashboard", f"SELECT kind, round(median(price), 6) AS median_price, count(DISTINCT symbol) AS symbols FROM ({TICKS}) GROUP BY 1")
def a35(spark, sf):
    return rounded(ticks(spark, sf).groupBy("kind").agg(F.median("price").alias("median_price"), F.count_distinct("symbol").alias("symbols")))


@query("w20_fixed_split", "SELECT o_orderkey AS id, CASE WHEN d <= DATE '1996-06-09' THEN 'discovery' WHEN d <= DATE '1997-06-24' THEN 'validation' ELSE 'sealed_test' END AS split FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders)")
def w20(spark, sf):
    return load(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), splits.fixed(F.col("o_orderdate").cast("date"), "1996-06-09", "1997-06-24").alias("split"))


@query("o04_result_route", "SELECT o_orderkey AS id, o_totalprice AS gain, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS event_date FROM orders WHERE o_totalprice >= 250000 AND o_orderstatus = 'O' AND contains(lower(o_orderpriority), 'urgent') ORDER BY CAST(o_orderdate AS DATE) DESC, o_totalprice DESC LIMIT 40")
def o04_route(spark, sf):
    from tidemark.plans import routes

    o = load(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("high_vs_prior_close_pct"), F.col("o_orderdate").cast("date").alias("event_date"), F.col("o_orderstatus").alias("scan_id"), F.lit(True).alias("currently_tradable"), F.lit(None).cast("string").alias("company"), F.col("o_orderpriority").alias("symbol"))
    x = routes.select(o, routes.ROUTES["results"], search="URGENT", limit=40, scan_id="O", minimum_gain=250000.0)
    return x.select("id", F.col("high_vs_prior_close_pct").alias("gain"), F.col("event_date").cast("string").alias("event_date"))
