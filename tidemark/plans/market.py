"""Queries over ticks and bars, each with its oracle."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators import features, ordered, splits, surge, tape
from tidemark.plans.catalog import query
from tidemark.plans.tables import DAILY, DAY, TICKS, daily_orders, load, rounded, ticks

MINUTE_BARS = f"SELECT symbol, sec // 60 AS minute, arg_min(price, (us, seq)) AS open, max(price) AS high, min(price) AS low, arg_max(price, (us, seq)) AS close, count(*) AS n FROM ({TICKS}) GROUP BY 1, 2"
HOUR_BARS = MINUTE_BARS.replace("sec // 60 AS minute", "sec // 3600 AS hour")


def minute_bars(spark, sf):
    return surge.bars(ticks(spark, sf), ["symbol"], F.expr("sec div 60"), "price", ["us", "seq"])


def hour_bars(spark, sf):
    return surge.bars(ticks(spark, sf), ["symbol"], F.expr("sec div 3600"), "price", ["us", "seq"], "hour")


@query(
    "w01_rolling_surge",
    f"""WITH b AS ({MINUTE_BARS}), x AS (SELECT *, min({{'l': low, 'm': -minute}}) OVER (PARTITION BY symbol ORDER BY minute RANGE BETWEEN 479 PRECEDING AND 1 PRECEDING) AS base FROM b),
    y AS (SELECT symbol, minute // 1440 AS day, minute, high, base.l AS base_low, -base.m AS base_minute, row_number() OVER (PARTITION BY symbol, minute // 1440 ORDER BY minute) AS k FROM x WHERE base IS NOT NULL AND high + 1e-15 >= base.l * 1.25)
    SELECT symbol, day, minute, high, base_low, base_minute FROM y WHERE k = 1""",
)
def w01(spark, sf):
    return surge.first_rolling_surge(minute_bars(spark, sf), ["symbol"], "minute", F.expr("minute div 1440"))


@query(
    "w02_crossing_mask",
    f"""WITH b AS ({HOUR_BARS}), r AS (SELECT symbol, min(hour) AS a, max(hour) AS z FROM b GROUP BY 1), g AS (SELECT symbol, unnest(generate_series(a, z)) AS hour FROM r),
    d AS (SELECT g.symbol, g.hour, b.high, b.low, b.low IS NOT NULL AS observed FROM g LEFT JOIN b USING (symbol, hour)),
    m AS (SELECT *, sum(CASE WHEN observed THEN 1 ELSE 0 END) OVER w AS full_, min(low) OVER w AS lo FROM d WINDOW w AS (PARTITION BY symbol ORDER BY hour ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING))
    SELECT symbol, hour, observed FROM m WHERE full_ = 2 AND high >= lo * 1.25""",
)
def w02(spark, sf):
    grid = ordered.dense_grid(hour_bars(spark, sf), ["symbol"], "hour", 1)
    return surge.crossing_mask(grid, ["symbol"], "hour", 3).where("crossing").select("symbol", "hour", "observed")


@query(
    "j05_dense_grid",
    f"""WITH b AS ({HOUR_BARS}), r AS (SELECT symbol, min(hour) AS a, max(hour) AS z FROM b GROUP BY 1), g AS (SELECT symbol, unnest(generate_series(a, z)) AS hour FROM r)
    SELECT g.symbol, count(*) AS grid, count(b.hour) AS observed FROM g LEFT JOIN b USING (symbol, hour) GROUP BY 1""",
)
def j05(spark, sf):
    grid = ordered.dense_grid(hour_bars(spark, sf), ["symbol"], "hour", 1)
    return grid.groupBy("symbol").agg(F.count("*").alias("grid"), F.count(F.when(F.col("observed"), 1)).alias("observed"))


@query(
    "a01_session_detector",
    f"""WITH b AS (SELECT *, minute // 1440 AS day FROM ({MINUTE_BARS})), c AS (SELECT symbol, day, arg_max(close, minute) AS close FROM b GROUP BY 1, 2),
    p AS (SELECT symbol, day, lag(close) OVER (PARTITION BY symbol ORDER BY day) AS prior_close FROM c),
    x AS (SELECT b.*, minute * 60 AS sec_at, prior_close * 1.25 AS thr FROM b JOIN p USING (symbol, day) WHERE prior_close > 0),
    y AS (SELECT *, floor((sec_at - lag(sec_at) OVER (PARTITION BY symbol, day ORDER BY sec_at)) / 60) - 1 AS gap FROM x),
    z AS (SELECT symbol, day, max(thr) AS threshold, min(CASE WHEN high >= thr THEN sec_at END) AS cross_at, max(high) AS session_high, arg_max(sec_at, (high, -sec_at)) AS peak_at, arg_min(open, sec_at) AS first_open, arg_max(close, sec_at) AS last_close, CAST(sum(n) AS BIGINT) AS trades, CAST(coalesce(max(gap), 0) AS BIGINT) AS max_gap_minutes FROM y GROUP BY 1, 2)
    SELECT symbol, day, round(threshold, 6) AS threshold, cross_at, session_high, peak_at, first_open, last_close, trades, max_gap_minutes, cross_at IS NOT NULL AS crossed,
    concat_ws(',', CASE WHEN max_gap_minutes >= 5 THEN 'possible_halt_or_illiquidity' END, CASE WHEN first_open < 1 THEN 'sub_dollar_at_open' END, CASE WHEN trades <= 1 THEN 'thin_session' END) AS flags FROM z""",
)
def a01(spark, sf):
    b = minute_bars(spark, sf).withColumn("day", F.expr("minute div 1440"))
    c = b.groupBy("symbol", "day").agg(F.max_by("close", "minute").alias("close"))
    p = c.select("symbol", "day", F.lag("close").over(W.partitionBy("symbol").orderBy("day")).alias("prior_close")).where("prior_close > 0")
    x = b.join(p, ["symbol", "day"]).withColumn("at", F.col("minute") * 60)
    return surge.session_detector(x, ["symbol", "day"], "at", "prior_close").withColumn("threshold", F.round("threshold", 6))


@query("a02_second_rollup", f"SELECT symbol, us // 1000000 AS second, arg_min(price, (us, seq)) AS open, max(price) AS high, min(price) AS low, arg_max(price, (us, seq)) AS close, count(*) AS n FROM ({TICKS}) GROUP BY 1, 2")
def a02(spark, sf):
    return tape.second_rollup(ticks(spark, sf), ["symbol"], "us", 1_000_000, "price", "seq")


@query(
    "p07_prefilter_semi",
    f"""WITH d AS ({DAILY}), x AS (SELECT *, CASE WHEN date_diff('day', lag(day) OVER w, day) = 1 THEN lag(low) OVER w ELSE low END AS prev FROM d WINDOW w AS (PARTITION BY symbol ORDER BY day)),
    k AS (SELECT symbol, day FROM x WHERE high + 1e-15 >= least(prev, low) * 8)
    SELECT o.o_orderkey AS order_key, o.o_orderpriority AS symbol FROM orders o WHERE EXISTS (SELECT 1 FROM k WHERE k.symbol = o.o_orderpriority AND k.day = CAST(o.o_orderdate AS DATE))""",
)
def p07(spark, sf):
    days = surge.prefilter(daily_orders(spark, sf), ["symbol"], "day", 8.0).select("symbol", "day")
    o = load(spark, sf, "orders").select(F.col("o_orderkey").alias("order_key"), F.col("o_orderpriority").alias("symbol"), F.col("o_orderdate").cast("date").alias("day"))
    return o.join(days, ["symbol", "day"], "left_semi").select("order_key", "symbol")


@query(
    "j14_asof_backward",
    f"""WITH q AS (SELECT symbol, us, max_by(price, seq) AS price FROM ({TICKS}) WHERE kind = 'view' GROUP BY 1, 2), t AS (SELECT * FROM ({TICKS}) WHERE kind = 'purchase')
    SELECT t.symbol, t.us, t.seq, t.price, q.us AS r_us, q.price AS r_price FROM t ASOF LEFT JOIN q ON t.symbol = q.symbol AND t.us >= q.us""",
)
def j14(spark, sf):
    t = ticks(spark, sf)
    return ordered.asof_join(t.where("kind = 'purchase'").select("symbol", "us", "seq", "price"), t.where("kind = 'view'"), ["symbol"], "us", ["price"], "seq", width=DAY * 1_000_000)


@query(
    "j16_asof_strict_interval",
    f"""WITH q AS (SELECT symbol, us, max_by(price, seq) AS price FROM ({TICKS}) WHERE kind = 'view' GROUP BY 1, 2), t AS (SELECT * FROM ({TICKS}) WHERE kind = 'purchase'),
    j AS (SELECT t.symbol, t.us, t.seq, q.us AS r_us, q.price AS r_price FROM t ASOF LEFT JOIN q ON t.symbol = q.symbol AND t.us > q.us)
    SELECT symbol, us, seq, CASE WHEN us - r_us <= 86400000000 THEN r_us END AS r_us, CASE WHEN us - r_us <= 86400000000 THEN r_price END AS r_price FROM j""",
)
def j16(spark, sf):
    t = ticks(spark, sf)
    return ordered.asof_join(t.where("kind = 'purchase'").select("symbol", "us", "seq"), t.where("kind = 'view'"), ["symbol"], "us", ["price"], "seq", strict=True, tolerance=DAY * 1_000_000, width=DAY * 1_000_000)


SPANS = f"SELECT symbol, sec AS start, sec + 3600 AS stop, price AS size, seq FROM ({TICKS}) WHERE kind = 'view'"


def spans(spark, sf):
    return ticks(spark, sf, "view").select("symbol", F.col("sec").alias("start"), (F.col("sec") + 3600).alias("stop"), F.col("price").alias("size"), F.col("seq").alias("span"))


@query("j15_interval_semi", f"WITH s AS ({SPANS}), t AS (SELECT * FROM ({TICKS}) WHERE kind = 'purchase') SELECT symbol, seq FROM t WHERE EXISTS (SELECT 1 FROM s WHERE s.symbol = t.symbol AND t.sec > s.start AND t.sec <= s.stop)")
def j15(spark, sf):
    return ordered.interval_join(ticks(spark, sf, "purchase").select("symbol", "seq", "sec"), spans(spark, sf).drop("size", "span"), "symbol", "sec", "start", "stop", 3600).select("symbol", "seq").distinct()


@query("j09_anti_range", f"WITH k AS (SELECT symbol, sec FROM ({TICKS}) WHERE kind = 'error'), t AS (SELECT * FROM ({TICKS}) WHERE kind = 'signup') SELECT symbol, seq FROM t WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.symbol = t.symbol AND abs(k.sec - t.sec) < 86400)")
def j09(spark, sf):
    k = ticks(spark, sf, "error").select(F.col("symbol").alias("_k"), F.col("sec").alias("_s"), F.explode(F.array(*(F.floor(F.col("sec") / DAY) + d for d in (-1, 0, 1)))).alias("_b"))
    t = ticks(spark, sf, "signup").select("symbol", "seq", "sec")
    return t.join(k, (t.symbol == k._k) & (F.floor(t.sec / DAY) == k._b) & (F.abs(t.sec - k._s) < DAY), "left_anti").select("symbol", "seq")


@query(
    "j10_anchor_windows",
    f"WITH a AS (SELECT symbol, seq AS sample_id, sec // 60 AS minute FROM ({TICKS}) WHERE kind = 'signup'), b AS ({MINUTE_BARS}) SELECT sample_id, count(*) AS bars, max(b.high) AS high, CAST(sum(b.n) AS BIGINT) AS volume FROM a JOIN b ON a.symbol = b.symbol AND b.minute BETWEEN a.minute - 1440 AND a.minute + 1440 GROUP BY 1",
)
def j10(spark, sf):
    a = ticks(spark, sf, "signup").select("symbol", F.col("seq").alias("sample_id"), (F.expr("sec div 60") - 1440).alias("lo"), (F.expr("sec div 60") + 1440).alias("hi"))
    x = ordered.interval_join(minute_bars(spark, sf), a, "symbol", "minute", "lo", "hi", 1440, open_start=False)
    return x.groupBy("sample_id").agg(F.count("*").alias("bars"), F.max("high").alias("high"), F.sum("n").alias("volume"))


@query(
    "j17_prior_session",
    f"WITH d AS ({DAILY}) SELECT symbol, CAST(day AS VARCHAR) AS day, CAST(CASE WHEN date_diff('day', lag(day) OVER w, day) <= 10 THEN lag(day) OVER w END AS VARCHAR) AS prior_day, CASE WHEN date_diff('day', lag(day) OVER w, day) <= 10 THEN lag(close) OVER w END AS prior_close FROM d WINDOW w AS (PARTITION BY symbol ORDER BY day)",
)
def j17(spark, sf):
    w = W.partitionBy("symbol").orderBy("day")
    near = F.datediff("day", F.lag("day").over(w)) <= 10
    return daily_orders(spark, sf).select("symbol", F.col("day").cast("string").alias("day"), F.when(near, F.lag("day").over(w)).cast("string").alias("prior_day"), F.when(near, F.lag("close").over(w)).alias("prior_close"))


@query("j18_prior_sessions", f"WITH d AS (SELECT symbol, day, row_number() OVER (PARTITION BY symbol ORDER BY day) AS i FROM ({DAILY})) SELECT a.symbol, CAST(a.day AS VARCHAR) AS day, CAST(b.day AS VARCHAR) AS prior_day, CAST(a.i - b.i AS INTEGER) AS k FROM d a JOIN d b ON a.symbol = b.symbol AND b.i < a.i AND b.i >= a.i - 5")
def j18(spark, sf):
    x = ordered.prior_sessions(daily_orders(spark, sf).select("symbol", "day"), ["symbol"], "day", 5)
    return x.select("symbol", F.col("day").cast("string").alias("day"), F.col("prior_day").cast("string").alias("prior_day"), "k")


@query(
    "j24_price_at_decision",
    f"""WITH b AS ({MINUTE_BARS}), d AS (SELECT symbol, max(sec // 86400) * 86400 AS at FROM ({TICKS}) GROUP BY 1),
    x AS (SELECT d.symbol, arg_max(b.close, b.minute) AS bar_close FROM d JOIN b ON b.symbol = d.symbol AND b.minute * 60 < d.at GROUP BY 1),
    t AS (SELECT d.symbol, arg_max(k.price, (k.us, k.seq)) AS trade FROM d JOIN ({TICKS}) k ON k.symbol = d.symbol AND k.sec >= d.at AND k.sec < d.at + 3600 GROUP BY 1)
    SELECT d.symbol, coalesce(t.trade, x.bar_close) AS price FROM d LEFT JOIN x USING (symbol) LEFT JOIN t USING (symbol)""",
)
def j24(spark, sf):
    t = ticks(spark, sf)
    at = F.max(F.expr("sec div 86400")).over(W.partitionBy("symbol")) * DAY
    x = t.withColumn("at", at).groupBy("symbol").agg(F.max_by("price", F.when((F.col("sec") >= F.col("at")) & (F.col("sec") < F.col("at") + 3600), F.struct("us", "seq"))).alias("trade"), F.max_by("price", F.when(F.expr("sec div 60 * 60") < F.col("at"), F.struct("us", "seq"))).alias("bar"))
    return x.select("symbol", F.coalesce("trade", "bar").alias("price"))


@query(
    "w03_drawdown_runup",
    f"WITH x AS (SELECT symbol, price, max(price) OVER w AS hi, min(price) OVER w AS lo FROM ({TICKS}) WINDOW w AS (PARTITION BY symbol ORDER BY us, seq)) SELECT symbol, round(min(CASE WHEN hi <> 0 THEN price / hi END - 1), 6) AS max_drawdown, round(max(CASE WHEN lo <> 0 THEN price / lo END - 1), 6) AS max_runup FROM x GROUP BY 1",
)
def w03(spark, sf):
    return rounded(ordered.running_extremes(ticks(spark, sf), ["symbol"], ["us", "seq"], "price", width=DAY * 1_000_000))


@query(
    "w04_realized_vol",
    f"WITH x AS (SELECT symbol, ln(price / lag(price) OVER (PARTITION BY symbol ORDER BY us, seq)) AS r FROM ({TICKS}) WHERE price > 0) SELECT symbol, count(*) AS n, round(stddev_samp(r) * sqrt(count(*)) * 100, 6) AS vol, round(sqrt(sum(r * r)), 6) AS second_vol, round(avg(CASE WHEN r > 0 THEN 1.0 ELSE 0.0 END), 6) AS positive FROM x WHERE r IS NOT NULL GROUP BY 1",
)
def w04(spark, sf):
    return rounded(features.realized_vol(ticks(spark, sf), ["symbol"], ["us", "seq"], "price"))


@query("w06_prior_high", f"SELECT symbol, hour, CASE WHEN count(high) OVER w >= 6 THEN max(high) OVER w END AS prior_high FROM ({HOUR_BARS}) WINDOW w AS (PARTITION BY symbol ORDER BY hour ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING)")
def w06(spark, sf):
    return hour_bars(spark, sf).select("symbol", "hour", features.prior_high(None, ["symbol"], ["hour"], "high", 8, 6).alias("prior_high"))


@query("w07_pct_change", f"SELECT symbol, hour, round(CASE WHEN lag(close) OVER w <> 0 THEN close / lag(close) OVER w - 1 END, 6) AS change FROM ({HOUR_BARS}) WINDOW w AS (PARTITION BY symbol ORDER BY hour)")
def w07(spark, sf):
    w = W.partitionBy("symbol").orderBy("hour")
    return hour_bars(spark, sf).select("symbol", "hour", F.round(F.try_divide("close", F.lag("close").over(w)) - 1, 6).alias("change"))


@query(
    "w08_atr",
    f"""WITH d AS ({DAILY}), x AS (SELECT symbol, greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w)) / lag(close) OVER w AS t, row_number() OVER (PARTITION BY symbol ORDER BY day DESC) AS k, lag(close) OVER w AS p FROM d WINDOW w AS (PARTITION BY symbol ORDER BY day))
    SELECT symbol, round(median(t), 6) AS atr_pct FROM x WHERE k <= 10 AND p IS NOT NULL GROUP BY 1""",
)
def w08(spark, sf):
    return rounded(features.atr_pct(daily_orders(spark, sf), ["symbol"], "day"))


@query(
    "w09_state_intervals",
    f"SELECT symbol, seq, sec AS start, stop FROM (SELECT *, coalesce(lead(sec) OVER (PARTITION BY symbol ORDER BY sec, seq), sec + 60) AS stop FROM ({TICKS}) WHERE kind = 'view') WHERE stop > sec",
)
def w09(spark, sf):
    return ordered.state_intervals(ticks(spark, sf, "view"), ["symbol"], "sec", "seq", F.col("sec") + 60, keep_empty=False).select("symbol", "seq", "start", "stop")


@query(
    "w10_merge_islands",
    f"""WITH s AS ({SPANS}), a AS (SELECT *, max(stop) OVER (PARTITION BY symbol ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM s),
    b AS (SELECT *, sum(CASE WHEN prev IS NULL OR start > prev THEN 1 ELSE 0 END) OVER (PARTITION BY symbol ORDER BY start, stop) AS i FROM a), c AS (SELECT symbol, i, max(stop) - min(start) AS d FROM b GROUP BY 1, 2)
    SELECT symbol, count(*) AS segments, CAST(sum(d) AS BIGINT) AS total, max(d) AS longest FROM c GROUP BY 1""",
)
def w10(spark, sf):
    return ordered.merged_duration(spans(spark, sf), ["symbol"], "start", "stop")


@query(
    "w11_opportunity_segments",
    f"""WITH s AS (SELECT symbol, sec AS start, sec + 86400 AS stop, price AS size FROM ({TICKS}) WHERE kind = 'view'), l AS (SELECT s.*, unnest([10.0, 50.0, 100.0]) AS level FROM s),
    a AS (SELECT *, size >= level AS ok, coalesce(lag(size >= level) OVER w, FALSE) AS was, lag(stop) OVER w AS prev FROM l WINDOW w AS (PARTITION BY symbol, level ORDER BY start, stop)),
    b AS (SELECT *, sum(CASE WHEN ok AND (NOT was OR start - prev > 0) THEN 1 ELSE 0 END) OVER (PARTITION BY symbol, level ORDER BY start, stop) AS i FROM a), c AS (SELECT symbol, level, i, max(stop) - min(start) AS d, count(*) AS n FROM b WHERE ok GROUP BY 1, 2, 3)
    SELECT symbol, CAST(level AS DOUBLE) AS level, count(*) AS segments, CAST(sum(d) AS BIGINT) AS total, max(d) AS longest, CAST(sum(n) AS BIGINT) AS spans FROM c GROUP BY 1, 2""",
)
def w11(spark, sf):
    s = ticks(spark, sf, "view").select("symbol", F.col("sec").alias("start"), (F.col("sec") + DAY).alias("stop"), F.col("price").alias("size"))
    return tape.opportunity_segments(s, ["symbol"], "start", "stop", "size", [10.0, 50.0, 100.0], 0)


@query(
    "w12_max_gap",
    f"WITH x AS (SELECT symbol, sec, sec - coalesce(lag(sec) OVER (PARTITION BY symbol ORDER BY sec), sec // 86400 * 86400) AS d FROM ({TICKS})) SELECT symbol, greatest(max(d), max((sec // 86400 + 1) * 86400) - max(sec)) AS max_gap FROM x GROUP BY 1",
)
def w12(spark, sf):
    return ordered.max_gap(ticks(spark, sf), ["symbol"], "sec", F.expr("sec div 86400 * 86400"), F.expr("(sec div 86400 + 1) * 86400"))


@query(
    "w14_loss_streak",
    f"WITH x AS (SELECT symbol, us, seq, CASE WHEN price < 40 THEN 1 ELSE 0 END AS h FROM ({TICKS})), y AS (SELECT symbol, h, sum(1 - h) OVER (PARTITION BY symbol ORDER BY us, seq ROWS UNBOUNDED PRECEDING) AS g FROM x), z AS (SELECT symbol, g, sum(h) AS n FROM y GROUP BY 1, 2) SELECT symbol, CAST(max(n) AS BIGINT) AS streak FROM z GROUP BY 1",
)
def w14(spark, sf):
    return ordered.longest_streak(ticks(spark, sf), ["symbol"], ["us", "seq"], F.col("price") < 40)


@query(
    "w15_equity_drawdown",
    f"""WITH x AS (SELECT symbol, us, seq, price - 50 AS pnl FROM ({TICKS})), e AS (SELECT *, sum(pnl) OVER (PARTITION BY symbol ORDER BY us, seq ROWS UNBOUNDED PRECEDING) AS e FROM x), p AS (SELECT *, greatest(0, max(e) OVER (PARTITION BY symbol ORDER BY us, seq ROWS UNBOUNDED PRECEDING)) AS p FROM e)
    SELECT symbol, round(sum(pnl), 4) AS total, round(max(p - e), 4) AS drawdown FROM p GROUP BY 1""",
)
def w15(spark, sf):
    return rounded(ordered.equity_drawdown(ticks(spark, sf).withColumn("pnl", F.col("price") - 50), ["symbol"], ["us", "seq"], "pnl"), 4)


@query(
    "w17_log_trend",
    f"""WITH x AS (SELECT symbol, price, row_number() OVER (PARTITION BY symbol ORDER BY us, seq) - 1 AS i, count(*) OVER (PARTITION BY symbol) AS n FROM ({TICKS}) WHERE price > 0),
    y AS (SELECT symbol, CAST(i AS DOUBLE) AS x, ln(price) AS y FROM x WHERE i % CAST(greatest(1, ceil(n / 600.0)) AS BIGINT) = 0)
    SELECT symbol, count(*) AS n, round(regr_slope(y, x), 6) AS slope, round(CASE WHEN max(y) > min(y) THEN regr_r2(y, x) END, 6) AS r2 FROM y GROUP BY 1""",
)
def w17(spark, sf):
    return rounded(features.log_trend(ticks(spark, sf), ["symbol"], ["us", "seq"], "price"))


@query(
    "w18_minutes_since_extreme",
    f"WITH x AS (SELECT *, max(high) OVER (PARTITION BY symbol) AS hi, min(low) OVER (PARTITION BY symbol) AS lo, max(minute) OVER (PARTITION BY symbol) AS last_ FROM ({MINUTE_BARS})) SELECT symbol, max(last_) - max(CASE WHEN high = hi THEN minute END) AS since_high, max(last_) - max(CASE WHEN low = lo THEN minute END) AS since_low FROM x GROUP BY 1",
)
def w18(spark, sf):
    b = minute_bars(spark, sf).groupBy("symbol").agg(F.max("minute").alias("z"), F.max(F.struct("high", "minute")).alias("h"), F.min(F.struct("low", (-F.col("minute")).alias("m"))).alias("l"))
    return b.select("symbol", (F.col("z") - F.col("h.minute")).alias("since_high"), (F.col("z") + F.col("l.m")).alias("since_low"))


@query(
    "w19_temporal_split",
    """WITH c AS (SELECT CAST(o_orderdate AS DATE) AS day, count(*) AS n FROM orders GROUP BY 1), x AS (SELECT *, sum(n) OVER (ORDER BY day) - n AS before_, row_number() OVER (ORDER BY day DESC) AS left_, sum(n) OVER () AS total FROM c)
    SELECT CAST(day AS VARCHAR) AS day, n, CASE WHEN before_ < total * 0.70 AND left_ > 2 THEN 'discovery' WHEN before_ < total * 0.85 AND left_ > 1 THEN 'validation' ELSE 'sealed_test' END AS split FROM x""",
)
def w19(spark, sf):
    counts = load(spark, sf, "orders").groupBy(F.col("o_orderdate").cast("date").alias("day")).agg(F.count("*").alias("n"))
    return splits.chronological(counts, "day", "n").withColumn("day", F.col("day").cast("string"))


@query(
    "w21_decision_points",
    f"""WITH b AS ({MINUTE_BARS}), d AS (SELECT DISTINCT symbol, minute // 1440 AS day FROM b), t AS (SELECT symbol, day, unnest([14, 17, 19]) AS hour FROM d),
    u AS (SELECT symbol, day, hour, CAST(epoch(timezone('Europe/London', make_timestamp(day * 86400000000 + hour * 3600000000))) AS BIGINT) // 60 AS target FROM t),
    f AS (SELECT u.symbol, u.day, u.hour, min(b.minute) AS minute, arg_min(b.open, b.minute) AS open FROM u JOIN b ON b.symbol = u.symbol AND b.minute // 1440 = u.day AND b.minute >= u.target GROUP BY 1, 2, 3)
    SELECT f.symbol, f.day, f.hour, f.minute, f.open, max(b.high) AS later_high FROM f JOIN b ON b.symbol = f.symbol AND b.minute // 1440 = f.day AND b.minute >= f.minute GROUP BY ALL""",
)
def w21(spark, sf):
    from tidemark.functions.scalar import local_clock_utc

    b = minute_bars(spark, sf).withColumn("day", F.expr("minute div 1440"))
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.col("day").cast("int"))
    at = F.array(*(F.struct(F.lit(h).alias("hour"), F.expr("1").cast("long").alias("one"), (F.unix_seconds(local_clock_utc(day, h, 0, "Europe/London")) / 60).cast("long").alias("target")) for h in (14, 17, 19)))
    x = b.withColumn("_t", F.explode(at)).where(F.col("minute") >= F.col("_t.target"))
    return x.groupBy("symbol", "day", F.col("_t.hour").alias("hour")).agg(F.min("minute").alias("minute"), F.min_by("open", "minute").alias("open"), F.max("high").alias("later_high"))


@query(
    "a05_vwap_to_target",
    """WITH x AS (SELECT l_suppkey, l_extendedprice AS v, l_extendedprice / l_quantity AS p, l_orderkey, l_linenumber FROM lineitem), y AS (SELECT *, coalesce(sum(v) OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before_ FROM x),
    z AS (SELECT l_suppkey, p, least(v, greatest(0, 500000 - before_)) AS used FROM y)
    SELECT l_suppkey AS supplier, round(sum(used), 2) AS sold, round(sum(used) / sum(used / p), 6) AS vwap, count(*) FILTER (used > 0) AS rows_used, sum(used) + 1e-12 >= 500000 AS reached FROM z GROUP BY 1""",
)
def a05(spark, sf):
    li = load(spark, sf, "lineitem").select(F.col("l_suppkey").alias("supplier"), "l_orderkey", "l_linenumber", "l_extendedprice", (F.col("l_extendedprice") / F.col("l_quantity")).alias("p"))
    x = tape.vwap_to_target(li, ["supplier"], ["l_orderkey", "l_linenumber", "l_extendedprice"], "p", F.col("l_extendedprice"), 500000)
    return x.select("supplier", F.round("sold", 2).alias("sold"), F.round("vwap", 6).alias("vwap"), "rows_used", "reached")


WINDOWS = [15, 60, 240, 1440, 10080]


def _multi_sql() -> str:
    one = lambda w: f"count(*) FILTER (age < {w}) AS bars_{w}, CAST(sum(n) FILTER (age < {w}) AS BIGINT) AS volume_{w}, max(high) FILTER (age < {w}) AS high_{w}, min(low) FILTER (age < {w}) AS low_{w}, round(CAST(sum(n) FILTER (age < {w}) AS DOUBLE) / {w}, 6) AS rate_{w}, round((max(high) FILTER (age < {w}) / nullif(min(low) FILTER (age < {w}), 0) - 1) * 100, 6) AS range_pct_{w}"
    return f"WITH a AS (SELECT symbol, seq AS sample_id, sec // 60 AS minute FROM ({TICKS}) WHERE kind = 'signup'), b AS ({MINUTE_BARS}), x AS (SELECT sample_id, b.*, a.minute - b.minute AS age FROM a JOIN b ON a.symbol = b.symbol AND b.minute BETWEEN a.minute - {max(WINDOWS) - 1} AND a.minute) SELECT sample_id, {', '.join(map(one, WINDOWS))} FROM x GROUP BY 1"


@query("a06_multi_window", _multi_sql())
def a06(spark, sf):
    s = ticks(spark, sf, "signup").select("symbol", F.col("seq").alias("sample_id"), F.expr("sec div 60").alias("minute"))
    return features.window_metrics(s, minute_bars(spark, sf), "symbol", "minute", WINDOWS, 1)


@query(
    "a08_daily_resample",
    f"WITH d AS (SELECT symbol, sec // 86400 AS day, arg_min(price, (us, seq)) AS open, max(price) AS high, min(price) AS low, arg_max(price, (us, seq)) AS close, count(*) AS n FROM ({TICKS}) GROUP BY 1, 2) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY day DESC) AS k FROM d) WHERE k <= 11",
)
def a08(spark, sf):
    d = surge.bars(ticks(spark, sf), ["symbol"], F.expr("sec div 86400"), "price", ["us", "seq"], "day")
    return ordered.top_k(d, ["symbol"], [F.desc("day")], 11, "k")


@query(
    "a09_distribution",
    f"SELECT kind, round(avg(price), 6) AS mean, round(stddev_samp(price), 6) AS std, round(skewness(price), 6) AS skew, min(price) AS min, "
    + ", ".join(f"round(quantile_cont(price, {q}), 6) AS {n}" for n, q in (("p01", 0.01), ("p05", 0.05), ("p25", 0.25), ("p50", 0.5), ("p75", 0.75), ("p95", 0.95), ("p99", 0.99)))
    + f", max(price) AS max, round(avg(CASE WHEN price > 0 THEN 1.0 ELSE 0.0 END), 6) AS positive FROM ({TICKS}) GROUP BY 1",
)
def a09(spark, sf):
    return rounded(ticks(spark, sf).groupBy("kind").agg(*features.distribution("price")))


@query(
    "a10_same_time_median",
    f"""WITH s AS (SELECT symbol, seq AS sample_id, sec AS at FROM ({TICKS}) WHERE kind = 'signup'), k AS (SELECT s.*, unnest(range(0, 8)) AS k FROM s), b AS (SELECT symbol, sec, count(*) AS n FROM ({TICKS}) GROUP BY 1, 2),
    v AS (SELECT sample_id, k, sum(b.n) AS v FROM k LEFT JOIN b ON b.symbol = k.symbol AND b.sec <= k.at - k.k * 86400 AND b.sec > k.at - k.k * 86400 - 86400 GROUP BY 1, 2),
    m AS (SELECT sample_id, max(v) FILTER (k = 0) AS now, median(v) FILTER (k > 0) AS usual FROM v GROUP BY 1)
    SELECT sample_id, CAST(now AS BIGINT) AS now, CAST(usual AS DOUBLE) AS usual, round(now / nullif(usual, 0), 6) AS ratio FROM m""",
)
def a10(spark, sf):
    s = ticks(spark, sf, "signup").select("symbol", F.col("seq").alias("sample_id"), F.col("sec").alias("at"))
    b = ticks(spark, sf).groupBy("symbol", F.col("sec").alias("at")).agg(F.count("*").alias("n"))
    return rounded(features.same_time_ratio(s, b, "symbol", "at", DAY, DAY))


@query(
    "a13_outcomes",
    f"WITH s AS (SELECT symbol, seq AS sample_id, sec // 60 AS minute, price FROM ({TICKS}) WHERE kind = 'signup' AND price > 0), b AS ({MINUTE_BARS}) SELECT sample_id, round(max(b.high / s.price) - 1, 6) AS max_gain, round(min(b.low / s.price) - 1, 6) AS max_fall FROM s JOIN b ON b.symbol = s.symbol AND b.minute > s.minute AND b.minute <= s.minute + 2880 GROUP BY 1",
)
def a13(spark, sf):
    s = ticks(spark, sf, "signup").where("price > 0").select("symbol", F.col("seq").alias("sample_id"), F.expr("sec div 60").alias("minute"), "price")
    return rounded(features.outcomes(s, minute_bars(spark, sf), "symbol", "minute", 2880))


@query(
    "a14_daily_features",
    f"""WITH d AS ({DAILY}), l AS (SELECT *, ln(close / lag(close) OVER w) AS lr FROM d WINDOW w AS (PARTITION BY symbol ORDER BY day)),
    x AS (SELECT symbol, day, count(close) OVER p AS history, lag(close) OVER w AS prior_close, median(n) OVER p AS median_volume, stddev_samp(lr) OVER (PARTITION BY symbol ORDER BY day ROWS BETWEEN 9 PRECEDING AND 1 PRECEDING) AS realized_vol, lag(close) OVER w / lag(close, 2) OVER w - 1 AS prior_return, lag(close) OVER w / lag(close, 10) OVER w - 1 AS momentum, high FROM l
    WINDOW w AS (PARTITION BY symbol ORDER BY day), p AS (PARTITION BY symbol ORDER BY day ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING))
    SELECT symbol, CAST(day AS VARCHAR) AS day, prior_close, round(median_volume, 6) AS median_volume, round(realized_vol, 6) AS realized_vol, round(prior_return, 6) AS prior_return, round(momentum, 6) AS momentum, high < prior_close * 1.25 AS no_hit FROM x WHERE history = 10""",
)
def a14(spark, sf):
    return rounded(features.daily_features(daily_orders(spark, sf), ["symbol"], "day").select("symbol", F.col("day").cast("string").alias("day"), "prior_close", "median_volume", "realized_vol", "prior_return", "momentum", "no_hit"))


@query(
    "a33_pseudo_window_audit",
    f"WITH x AS (SELECT symbol, price, minute, high, min(low) OVER (PARTITION BY symbol ORDER BY minute ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS lo FROM (SELECT *, close AS price FROM ({MINUTE_BARS}))) SELECT symbol, count(*) AS bars, round(max((high / nullif(lo, 0) - 1) * 100), 4) AS max_gain_pct, coalesce(max((high / nullif(lo, 0) - 1) * 100) >= 25, FALSE) AS contaminated FROM x GROUP BY 1",
)
def a33(spark, sf):
    w = W.partitionBy("symbol").orderBy("minute").rowsBetween(W.unboundedPreceding, -1)
    x = minute_bars(spark, sf).withColumn("g", (F.try_divide(F.col("high"), F.min("low").over(w)) - 1) * 100).groupBy("symbol").agg(F.count("*").alias("bars"), F.max("g").alias("g"))
    return x.select("symbol", "bars", F.round("g", 4).alias("max_gain_pct"), F.coalesce(F.col("g") >= 25, F.lit(False)).alias("contaminated"))


@query(
    "a24_session_summary",
    f"""WITH x AS (SELECT symbol, us, price, CASE WHEN m BETWEEN 240 AND 569 THEN 'premarket' WHEN m BETWEEN 570 AND 959 THEN 'regular' WHEN m BETWEEN 960 AND 1199 THEN 'afterhours' ELSE 'overnight' END AS session FROM
    (SELECT *, hour(timezone('America/New_York', to_timestamp(sec))) * 60 + minute(timezone('America/New_York', to_timestamp(sec))) AS m FROM ({TICKS})))
    SELECT session, count(*) AS n, round(sum(price), 4) AS volume, count(DISTINCT symbol) AS symbols FROM x GROUP BY 1""",
)
def a24(spark, sf):
    from tidemark.functions.scalar import session_label

    x = ticks(spark, sf).withColumn("session", session_label(F.timestamp_seconds("sec")))
    return rounded(x.groupBy("session").agg(F.count("*").alias("n"), F.sum("price").alias("volume"), F.count_distinct("symbol").alias("symbols")), 4)


@query(
    "a26_snapshot_summary",
    f"""WITH x AS (SELECT *, (max(sec) OVER (PARTITION BY symbol)) AS cut FROM ({TICKS}))
    SELECT symbol, arg_max(price, (sec, seq)) AS last_price, count(*) AS n, max(price) AS high, min(price) AS low, {", ".join(f"count(*) FILTER (sec >= cut - {t}) AS n_{t}, max(price) FILTER (sec >= cut - {t}) AS high_{t}, round(sum(price) FILTER (sec >= cut - {t}), 6) AS sum_{t}" for t in (86400, 604800))} FROM x WHERE sec < cut GROUP BY 1""",
)
def a26(spark, sf):
    return rounded(tape.snapshot(ticks(spark, sf), ["symbol"], "sec", F.max("sec").over(W.partitionBy("symbol")), "price", "seq", [86400, 604800]))


QUOTES = f"SELECT symbol, sec, seq, price AS bid, price * 1.01 AS ask FROM ({TICKS}) WHERE kind = 'view' AND price > 0"


@query(
    "t03_execution_sim",
    f"""WITH q AS ({QUOTES}), m AS (SELECT symbol, median(price) AS lim, max(sec) AS close_at FROM ({TICKS}) GROUP BY 1), x AS (SELECT q.*, lim, close_at FROM q JOIN m USING (symbol)),
    e AS (SELECT symbol, min((sec, seq)) AS k, arg_min(ask, (sec, seq)) * 1.001 AS fill FROM x WHERE ask < lim GROUP BY 1),
    y AS (SELECT x.*, e.k, e.fill FROM x JOIN e USING (symbol) WHERE (x.sec, x.seq) >= e.k),
    h AS (SELECT symbol, arg_min(sec, (sec, seq)) AS t, arg_min(bid, (sec, seq)) AS b, arg_min(bid >= fill * 1.25, (sec, seq)) AS won FROM y WHERE bid >= fill * 1.25 OR bid <= fill * 0.95 GROUP BY 1),
    l AS (SELECT symbol, arg_max(sec, (sec, seq)) AS t, arg_max(bid, (sec, seq)) AS b, max(close_at) AS c, min(k) AS k, max(fill) AS fill FROM y GROUP BY 1)
    SELECT l.symbol, CAST(struct_extract(l.k, 1) AS BIGINT) AS entry_at, round(l.fill, 6) AS entry_price, CASE WHEN h.symbol IS NOT NULL THEN h.t WHEN c - l.t <= 864000 THEN l.t END AS exit_at,
    round(CASE WHEN h.symbol IS NOT NULL THEN h.b WHEN c - l.t <= 864000 THEN l.b END * 0.999, 6) AS exit_price,
    CASE WHEN h.symbol IS NOT NULL THEN CASE WHEN h.won THEN 'target' ELSE 'stop' END WHEN c - l.t <= 864000 THEN 'time' ELSE 'no_executable_close_exit' END AS reason,
    round(CASE WHEN h.symbol IS NOT NULL THEN h.b WHEN c - l.t <= 864000 THEN l.b END * 0.999 / l.fill - 1, 6) AS ret FROM l LEFT JOIN h USING (symbol)""",
)
def t03(spark, sf):
    t = ticks(spark, sf)
    m = t.groupBy("symbol").agg(F.median("price").alias("lim"), F.max("sec").alias("close_at"))
    q = t.where("kind = 'view' and price > 0").select("symbol", "sec", "seq", F.col("price").alias("bid"), (F.col("price") * 1.01).alias("ask")).join(m, "symbol")
    return rounded(tape.simulate_execution(q, ["symbol"], "sec", "seq", "bid", "ask", "lim", F.col("_fill") * 1.25, stale=864000, close=F.col("close_at")))


@query(
    "t04_sellability",
    f"""WITH s AS ({SPANS}), a AS (SELECT *, max(stop) OVER (PARTITION BY symbol ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM s),
    b AS (SELECT *, sum(CASE WHEN prev IS NULL OR start > prev THEN 1 ELSE 0 END) OVER (PARTITION BY symbol ORDER BY start, stop) AS i FROM a), c AS (SELECT symbol, i, max(stop) - min(start) AS d FROM b GROUP BY 1, 2),
    m AS (SELECT symbol, count(*) AS segments, CAST(sum(d) AS BIGINT) AS displayed, max(d) AS longest FROM c GROUP BY 1),
    t AS (SELECT * FROM ({TICKS}) WHERE kind = 'purchase'), n AS (SELECT symbol, count(*) AS trades FROM t GROUP BY 1),
    k AS (SELECT symbol, count(*) AS confirming FROM t WHERE EXISTS (SELECT 1 FROM s WHERE s.symbol = t.symbol AND t.sec > s.start AND t.sec <= s.stop) GROUP BY 1)
    SELECT symbol, coalesce(segments, 0) AS segments, coalesce(displayed, 0) AS displayed, coalesce(longest, 0) AS longest, coalesce(trades, 0) AS trades, coalesce(confirming, 0) AS confirming,
    CASE WHEN coalesce(confirming, 0) > 0 THEN 'confirmed_sellable' WHEN coalesce(displayed, 0) > 0 THEN 'displayed_bid_only' WHEN coalesce(trades, 0) > 0 THEN 'trade_only' ELSE 'not_confirmed' END AS status
    FROM m FULL JOIN n USING (symbol) LEFT JOIN k USING (symbol)""",
)
def t04(spark, sf):
    return tape.sellability(spans(spark, sf), ticks(spark, sf, "purchase"), "symbol", "start", "stop", "sec", 3600).select("symbol", "segments", "displayed", "longest", "trades", "confirming", "status")
