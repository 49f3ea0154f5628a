"""Queries over the wide feature rows, each with its oracle: hours stand for minutes, groups of users for symbols."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import context
from tidemark.plans.catalog import query
from tidemark.plans.tables import TICKS, rounded, ticks

BARS = f"SELECT symbol % 8 AS symbol, sec // 3600 AS step, arg_min(price, (us, seq)) AS open, max(price) AS high, min(price) AS low, arg_max(price, (us, seq)) AS close, sum(price) AS quote_volume, count(*) AS trade_count, coalesce(sum(price) FILTER (seq % 2 = 0), 0) AS taker_quote FROM ({TICKS}) WHERE price > 0 GROUP BY 1, 2"
SAMPLES = f"SELECT seq AS sample_id, symbol % 8 AS symbol, sec // 3600 AS step FROM ({TICKS}) WHERE kind = 'signup'"
ENTRY = f"b AS ({BARS}), s AS ({SAMPLES}), e AS (SELECT s.sample_id, s.symbol, s.step, b.close AS entry_price FROM s JOIN b USING (symbol, step))"
WINDOWS = [4, 12, 24, 72, 240]
DAY, SPAN = 24, 240


def bars(spark, sf):
    t = ticks(spark, sf).where("price > 0").withColumn("symbol", F.col("symbol") % 8).withColumn("step", F.expr("sec div 3600"))
    key = F.struct("us", "seq")
    return t.groupBy("symbol", "step").agg(F.min_by("price", key).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", key).alias("close"), F.sum("price").alias("quote_volume"), F.count("*").alias("trade_count"), F.coalesce(F.sum(F.when(F.col("seq") % 2 == 0, F.col("price"))), F.lit(0.0)).alias("taker_quote"))


def samples(spark, sf):
    return ticks(spark, sf, "signup").select(F.col("seq").alias("sample_id"), (F.col("symbol") % 8).alias("symbol"), F.expr("sec div 3600").alias("step"))


def _windows_sql(windows: list[int], least: int) -> str:
    """Long rows of window metrics by their plain definition."""
    return f"""{ENTRY}, v AS (SELECT unnest({windows}) AS w), x AS (SELECT e.sample_id, e.entry_price, e.step AS end_, v.w, b.* EXCLUDE (symbol) FROM e CROSS JOIN v JOIN b ON b.symbol = e.symbol AND b.step <= e.step AND b.step > e.step - v.w),
    y AS (SELECT *, ln(close / lag(close) OVER p) AS r, close / max(close) OVER (PARTITION BY sample_id, w ORDER BY step ROWS UNBOUNDED PRECEDING) - 1 AS dd, close / min(close) OVER (PARTITION BY sample_id, w ORDER BY step ROWS UNBOUNDED PRECEDING) - 1 AS ru, row_number() OVER p - 1 AS i FROM x WINDOW p AS (PARTITION BY sample_id, w ORDER BY step)),
    g AS (SELECT sample_id, w, any_value(entry_price) AS entry_price, any_value(end_) AS end_, count(*) AS n, max(high) AS high, min(low) AS low, sum(quote_volume) AS q, sum(trade_count)::DOUBLE AS t, sum(taker_quote) AS k, stddev_samp(r) AS sd, count(r) AS nr, avg(CASE WHEN r > 0 THEN 1.0 WHEN r IS NOT NULL THEN 0.0 END) AS up, min(dd) * 100 AS dd, max(ru) * 100 AS ru, max_by(step, (high, step)) AS hi_at, max_by(step, (-low, step)) AS lo_at, CASE WHEN count(*) >= 6 THEN regr_slope(ln(close), i) END AS slope, CASE WHEN count(*) >= 6 AND max(close) > min(close) THEN regr_r2(ln(close), i) END AS r2 FROM y GROUP BY 1, 2),
    l AS (SELECT e.sample_id, v.w, b.close AS lag_close FROM e CROSS JOIN v JOIN b ON b.symbol = e.symbol AND b.step = e.step - v.w),
    m AS (SELECT g.sample_id, CAST(g.w AS BIGINT) AS "window", entry_price, n / g.w::DOUBLE AS observed_fraction, (entry_price / lag_close - 1) * 100 AS ret, (high / low - 1) * 100 AS range, q AS quote_volume, t AS trade_count, q / t AS average_trade_quote, CASE WHEN q > 0 THEN k / q END AS taker_buy_ratio,
      CASE WHEN n >= greatest({least}, floor(g.w * 0.8)) AND nr >= 2 THEN sd * sqrt(g.w) * 100 END AS realized_vol, CASE WHEN n > 1 THEN up END AS positive_return_fraction, CASE WHEN n > 1 THEN dd END AS max_drawdown, CASE WHEN n > 1 THEN ru END AS max_runup, CASE WHEN high > low THEN (entry_price - low) / (high - low) END AS position_in_range, CASE WHEN high > low THEN (entry_price / high - 1) * 100 END AS close_vs_high, CASE WHEN high > low THEN (entry_price / low - 1) * 100 END AS close_vs_low,
      CASE WHEN high > low THEN end_ - hi_at END AS since_high, CASE WHEN high > low THEN end_ - lo_at END AS since_low, slope * {DAY} AS log_trend, r2 AS trend_r2 FROM g LEFT JOIN l ON l.sample_id = g.sample_id AND l.w = g.w)"""


LONG = ["entry_price", "observed_fraction", "ret", "range", "quote_volume", "trade_count", "average_trade_quote", "taker_buy_ratio", "realized_vol", "positive_return_fraction", "max_drawdown", "max_runup", "position_in_range", "close_vs_high", "close_vs_low", "trend_r2", "log_trend"]
#: Means of prices with two digits often end in a 5 at the sixth digit exactly; engines add in different orders and so differ in the last bit of such ties. Both sides move them up by this before rounding.
TIE = 1e-9
ROUNDED = ", ".join(f"round({c} + {TIE}, 5) AS {c}" for c in LONG)


def off_ties(df):
    return df.select(*((F.col(c) + TIE).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


@query("a06_context_windows", f'WITH {_windows_sql(WINDOWS, 5)} SELECT sample_id, "window", since_high, since_low, {ROUNDED} FROM m')
def a06(spark, sf):
    x = context.window_metrics(samples(spark, sf), bars(spark, sf), "symbol", "step", WINDOWS, per_day=DAY)
    return rounded(off_ties(x.withColumn("log_trend", F.log1p(F.col("trend") / 100)).drop("trend")), 5)


NARROW = [1, 5, 15, 30, 60]
NARROW_SQL = ", ".join(f"round(max({m}) FILTER (\"window\" = {w}), 5) AS {n.format(w)}" for w in NARROW for m, n in context.NAMES.items() if m in ("observed_fraction", "ret", "range", "quote_volume", "trade_count", "taker_buy_ratio", "max_drawdown", "max_runup"))


@query(
    "a07_narrow_windows",
    f"""WITH {_windows_sql(NARROW, 3)}, z AS (SELECT sample_id, {NARROW_SQL}, round(max(realized_vol) FILTER ("window" = 15), 5) AS realized_vol_15m_pct FROM m GROUP BY 1),
    a AS (SELECT e.sample_id, sum(b.quote_volume) FILTER (e.step - b.step < 5) AS q5, count(*) FILTER (e.step - b.step < 5) AS n5, sum(b.quote_volume) FILTER (e.step - b.step BETWEEN 5 AND 34) AS q30, count(*) FILTER (e.step - b.step BETWEEN 5 AND 34) AS n30 FROM e JOIN b ON b.symbol = e.symbol AND b.step <= e.step AND b.step > e.step - 35 GROUP BY 1)
    SELECT z.*, round(CASE WHEN n5 = 5 AND n30 = 30 AND q30 > 0 THEN q5 / (q30 / 6) END, 5) AS volume_ratio_5m_to_previous_30m FROM z JOIN a USING (sample_id)""",
)
def a07(spark, sf):
    x = context.narrow_context(samples(spark, sf), bars(spark, sf), "symbol", "step", tuple(NARROW), day=DAY)
    keep = [n.format(w) for w in NARROW for m, n in context.NAMES.items() if m in ("observed_fraction", "ret", "range", "quote_volume", "trade_count", "taker_buy_ratio", "max_drawdown", "max_runup")]
    return rounded(x.select("sample_id", *keep, "realized_vol_15m_pct", "volume_ratio_5m_to_previous_30m"), 5)


DAYS = f"""x AS (SELECT e.sample_id, b.* EXCLUDE (symbol) FROM e JOIN b ON b.symbol = e.symbol AND b.step <= e.step AND b.step > e.step - {SPAN}),
    d AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY day) - 1 AS i FROM (SELECT sample_id, step // {DAY} AS day, arg_min(open, step) AS open, max(high) AS high, min(low) AS low, arg_max(close, step) AS close, sum(quote_volume) AS q, sum(taker_quote) AS k, count(*) AS minutes, row_number() OVER (PARTITION BY sample_id ORDER BY step // {DAY} DESC) AS back FROM x GROUP BY sample_id, step // {DAY}) WHERE back <= 11),
    dd AS (SELECT sample_id, count(*) FILTER (minutes >= 23) AS complete_daily_bars_in_context, count(*) AS calendar_days_with_data_in_context, CASE WHEN count(*) >= 3 THEN avg(CASE WHEN close > open THEN 1.0 ELSE 0.0 END) END AS up_day_fraction_context, CASE WHEN count(*) >= 3 THEN median(k / nullif(q, 0)) END AS daily_taker_buy_ratio_median,
      CASE WHEN count(*) >= 6 THEN regr_slope(ln(q), i) END AS volume_trend, CASE WHEN count(*) >= 6 THEN regr_r2(ln(q), i) END AS volume_r2, CASE WHEN count(*) >= 6 THEN regr_slope(ln(close), i) END AS close_trend, CASE WHEN count(*) >= 6 THEN regr_slope(ln(greatest((high / low - 1) * 100, 1e-9) + 1), i) END AS range_trend FROM d GROUP BY 1)"""


@query(
    "a08_daily_context",
    f"WITH {ENTRY}, {DAYS} SELECT sample_id, complete_daily_bars_in_context, calendar_days_with_data_in_context, round(up_day_fraction_context, 5) AS up_day_fraction_context, round(daily_taker_buy_ratio_median, 5) AS daily_taker_buy_ratio_median, round(volume_trend, 5) AS volume_trend, round(volume_r2, 5) AS volume_r2, round(close_trend, 5) AS close_trend, round(range_trend, 5) AS range_trend FROM dd",
)
def a08(spark, sf):
    s, b = samples(spark, sf), bars(spark, sf)
    x = context.daily_context(s.join(context.entries(s, b, "symbol", "step"), "sample_id", "left_semi"), b, "symbol", "step", SPAN, DAY, 23)
    slope = lambda c, name: F.log1p(F.col(c) / 100).alias(name)
    x = x.select("sample_id", "complete_daily_bars_in_context", "calendar_days_with_data_in_context", "up_day_fraction_context", "daily_taker_buy_ratio_median", slope("daily_quote_volume_trend_pct_per_day", "volume_trend"), F.col("daily_quote_volume_trend_r2").alias("volume_r2"), slope("daily_close_trend_pct_per_day", "close_trend"), slope("daily_range_trend_pct_per_day", "range_trend"))
    return rounded(x, 5)


def _dist(source: str, prefix: str) -> str:
    qs = ", ".join(f"round(quantile_cont(v, {q}), 5) AS {prefix}_{n}" for n, q in context.QUANTILES.items())
    return f"SELECT sample_id, round(avg(v) + {TIE}, 5) AS {prefix}_mean, round(CASE WHEN count(*) > 1 THEN stddev_samp(v) ELSE 0 END, 5) AS {prefix}_std, round(CASE WHEN count(*) > 2 THEN CASE WHEN max(v) = min(v) THEN 0 ELSE skewness(v) END END, 5) + 0.0 AS {prefix}_skew, round(min(v), 5) AS {prefix}_min, {qs}, round(max(v), 5) AS {prefix}_max, round(avg(CASE WHEN v > 0 THEN 1.0 ELSE 0.0 END), 5) AS {prefix}_positive_fraction FROM {source} WHERE v IS NOT NULL GROUP BY 1"


#: Four steps make a coarse bar here, and six coarse bars the prior high (at least four of them there).
COARSE, BACK, LEAST = 4, 6, 4
SERIES = {"minute_return_pct_10d": "s1", "hourly_return_pct_10d": "s2", "hourly_quote_volume_10d": "s3", "hourly_trade_count_10d": "s4", "close_vs_prior_24h_high_pct_10d": "s5"}
HOURS = f"""h AS (SELECT sample_id, step // {COARSE} AS hour, max(high) AS high, arg_max(close, step) AS close, sum(quote_volume) AS q, sum(trade_count)::DOUBLE AS t, count(*) AS minutes FROM x GROUP BY 1, 2),
    hp AS (SELECT *, CASE WHEN count(high) OVER p >= {LEAST} THEN max(high) OVER p END AS prior FROM h WINDOW p AS (PARTITION BY sample_id ORDER BY hour ROWS BETWEEN {BACK} PRECEDING AND 1 PRECEDING)),
    s1 AS (SELECT sample_id, close / lag(close) OVER (PARTITION BY sample_id ORDER BY step) * 100 - 100 AS v FROM x), s2 AS (SELECT sample_id, close / lag(close) OVER (PARTITION BY sample_id ORDER BY hour) * 100 - 100 AS v FROM h), s3 AS (SELECT sample_id, q AS v FROM h), s4 AS (SELECT sample_id, t AS v FROM h), s5 AS (SELECT sample_id, close / prior * 100 - 100 AS v FROM hp),
    hh AS (SELECT sample_id, CAST(sum(minutes) AS BIGINT) AS observed_minutes_10d, count(*) AS observed_hours_10d, round(CASE WHEN median(q) > 0 THEN max(q) / median(q) END, 5) AS maximum_hourly_volume_vs_median_10d, count(*) FILTER (high >= prior) AS new_rolling_24h_high_count_10d FROM hp GROUP BY 1), """ + ", ".join(f"d{k} AS ({_dist(s, p)})" for k, (p, s) in enumerate(SERIES.items()))


@query("a09_hourly_distributions", f"WITH {ENTRY}, {DAYS}, {HOURS} SELECT * FROM hh LEFT JOIN d0 USING (sample_id) LEFT JOIN d1 USING (sample_id) LEFT JOIN d2 USING (sample_id) LEFT JOIN d3 USING (sample_id) LEFT JOIN d4 USING (sample_id)")
def a09(spark, sf):
    s, b = samples(spark, sf), bars(spark, sf)
    x = context.hourly_context(s.join(context.entries(s, b, "symbol", "step"), "sample_id", "left_semi"), b, "symbol", "step", SPAN, COARSE, BACK, LEAST)
    return rounded(x.withColumns({c: F.col(c) + TIE for c in x.columns if c.endswith("_mean")}), 5)


SAME = f"""k AS (SELECT e.sample_id, e.symbol, e.step, k FROM e CROSS JOIN (SELECT unnest(range(0, 8)) AS k)), sv AS (SELECT k.sample_id, k.k, """ + ", ".join(f"CASE WHEN count(*) FILTER (b.step > k.step - k.k * {DAY} - {n}) = {n} THEN sum(b.quote_volume) FILTER (b.step > k.step - k.k * {DAY} - {n}) END AS v{n}" for n in (2, 4)) + f""" FROM k JOIN b ON b.symbol = k.symbol AND b.step <= k.step - k.k * {DAY} AND b.step > k.step - k.k * {DAY} - 4 GROUP BY 1, 2),
    st AS (SELECT sample_id, """ + ", ".join(f"median(v{n}) FILTER (k > 0) AS quote_volume_{n}m_prior_7d_same_time_median, max(v{n}) FILTER (k = 0) / nullif(median(v{n}) FILTER (k > 0), 0) AS quote_volume_{n}m_vs_prior_7d_same_time" for n in (2, 4)) + " FROM sv GROUP BY 1)"
SAME_COLUMNS = ", ".join(f"round(quote_volume_{n}m_{s}, 5) AS quote_volume_{n}m_{s}" for n in (2, 4) for s in ("prior_7d_same_time_median", "vs_prior_7d_same_time"))


@query("a10_same_time_full", f"WITH {ENTRY}, {SAME} SELECT e.sample_id, {SAME_COLUMNS} FROM e LEFT JOIN st USING (sample_id)")
def a10(spark, sf):
    s, b = samples(spark, sf), bars(spark, sf)
    return rounded(context.same_time(s.join(context.entries(s, b, "symbol", "step"), "sample_id", "left_semi"), b, "symbol", "step", (2, 4), DAY), 5)


REFS = {"one": 1, "two": 2, "three": 3}
REF_WINDOWS = (4, 24, 72)
REF_SQL = f"""r AS (SELECT e.sample_id, p.prefix, v.w, (c.close / o.close - 1) * 100 AS ret FROM e CROSS JOIN (VALUES {", ".join(f"('{k}', {v})" for k, v in REFS.items())}) AS p(prefix, ref) CROSS JOIN (SELECT unnest({list(REF_WINDOWS)}) AS w) v JOIN b c ON c.symbol = p.ref AND c.step = e.step JOIN b o ON o.symbol = p.ref AND o.step = e.step - v.w),
    rr AS (SELECT sample_id, """ + ", ".join(f"max(ret) FILTER (prefix = '{p}' AND w = {w}) AS {p}_ret_{w}m_pct" for p in REFS for w in REF_WINDOWS) + ", " + ", ".join(f"avg(ret) FILTER (w = {w}) AS market_proxy_ret_{w}m_pct" for w in REF_WINDOWS) + " FROM r GROUP BY 1)"
REF_COLUMNS = [*(f"{p}_ret_{w}m_pct" for p in REFS for w in REF_WINDOWS), *(f"market_proxy_ret_{w}m_pct" for w in REF_WINDOWS)]


@query("a11_reference_context", f"WITH {ENTRY}, {REF_SQL} SELECT e.sample_id, {', '.join(f'round({c}, 5) AS {c}' for c in REF_COLUMNS)} FROM e LEFT JOIN rr USING (sample_id)")
def a11(spark, sf):
    s, b = samples(spark, sf), bars(spark, sf)
    x = context.reference_context(s.join(context.entries(s, b, "symbol", "step"), "sample_id", "left_semi"), b, "symbol", "step", REFS, REF_WINDOWS, DAY)
    return rounded(x.select("sample_id", *REF_COLUMNS), 5)


X03 = ["entry_price", "ret_24m_pct", "max_drawdown_240m_pct", "quote_volume_72m", "up_day_fraction_context", "hourly_return_pct_10d_mean", "quote_volume_4m_vs_prior_7d_same_time", "market_proxy_ret_24m_pct", "ret_24m_minus_market_proxy_pct_points", "outcome_next_8h_max_gain_pct", "outcome_to_anchor_max_drawdown_pct", "observed_fraction_prior_window"]


@query(
    "x03_ten_day_context",
    f"""WITH {_windows_sql([24, 72, 240], 5)}, {DAYS.replace("x AS (", "xx AS (").replace("FROM x GROUP", "FROM xx GROUP")}, {HOURS.replace("FROM x)", "FROM xx)").replace("FROM x GROUP", "FROM xx GROUP")}, {SAME}, {REF_SQL},
    f AS (SELECT e.sample_id, (max(b.high) / e.entry_price - 1) * 100 AS gain, (min(b.low) FILTER (b.step <= e.step + 6) / e.entry_price - 1) * 100 AS fall FROM e JOIN b ON b.symbol = e.symbol AND b.step > e.step AND b.step <= e.step + 8 GROUP BY e.sample_id, e.entry_price),
    n AS (SELECT sample_id, count(*) AS seen FROM xx GROUP BY 1),
    q AS (SELECT s.sample_id, e.entry_price, max(ret) FILTER ("window" = 24) AS ret_24m_pct, max(max_drawdown) FILTER ("window" = 240) AS max_drawdown_240m_pct, max(m.quote_volume) FILTER ("window" = 72) AS quote_volume_72m FROM s LEFT JOIN e USING (sample_id) LEFT JOIN m USING (sample_id) GROUP BY 1, 2)
    SELECT q.sample_id, {', '.join(f'round({c}, 5) AS {c}' for c in X03[:7] if c != 'entry_price')}, round(q.entry_price, 5) AS entry_price, round(market_proxy_ret_24m_pct, 5) AS market_proxy_ret_24m_pct, round(ret_24m_pct - market_proxy_ret_24m_pct, 5) AS ret_24m_minus_market_proxy_pct_points, round(gain, 5) AS outcome_next_8h_max_gain_pct, round(fall, 5) AS outcome_to_anchor_max_drawdown_pct, round(coalesce(seen, 0) / {SPAN}, 5) AS observed_fraction_prior_window,
    CASE WHEN q.entry_price IS NULL THEN 'missing_decision_bar' WHEN coalesce(seen, 0) / {SPAN} >= 0.995 THEN 'pass' WHEN coalesce(seen, 0) / {SPAN} >= 0.98 THEN 'warning' ELSE 'insufficient_history' END AS feature_quality_status
    FROM q LEFT JOIN dd USING (sample_id) LEFT JOIN d1 USING (sample_id) LEFT JOIN st USING (sample_id) LEFT JOIN rr USING (sample_id) LEFT JOIN f USING (sample_id) LEFT JOIN n USING (sample_id)""",
)
def x03(spark, sf):
    s = samples(spark, sf).withColumn("anchor", F.col("step") + 6)
    x = context.ten_day_context(s, bars(spark, sf), "symbol", "step", REFS, (24, 72, 240), 10, DAY, COARSE, (2, 4), REF_WINDOWS, horizon=8, liquidity=1)
    x = x.withColumn("hourly_return_pct_10d_mean", F.col("hourly_return_pct_10d_mean") + TIE)
    return rounded(x.select("sample_id", *X03, "feature_quality_status"), 5)
