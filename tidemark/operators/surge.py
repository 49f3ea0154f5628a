"""Surge detection on bars: rollups, the first rolling surge, the crossing mask, the session detector."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

EPSILON = 1e-15


def bars(ticks: DataFrame, by: list[str], bucket: Column, price: str, order: list[str], name: str = "minute") -> DataFrame:
    """Open, high, low, close and count of each bucket; open and close by the given unique order."""
    key = F.struct(*order)
    return ticks.withColumn(name, bucket).groupBy(*by, name).agg(F.min_by(price, key).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, key).alias("close"), F.count("*").alias("n"))


def first_rolling_surge(b: DataFrame, by: list[str], minute: str, day: Column, window: int = 480, rise: float = 1.25) -> DataFrame:
    """The first minute of each key and day whose high reaches ``rise`` times the lowest low of the window - 1 minutes before it.

    Of equal lows the latest is the baseline. The look-back may begin on an earlier day. A
    key's minutes are cut into stretches of four windows, each with the window before it
    copied in, so a key with most of the bars is spread over the cluster.
    """
    size = 4 * window
    stretch = lambda c: F.floor(c / F.lit(size))
    b = b.withColumn("_c", F.explode(F.sequence(stretch(F.col(minute)), stretch(F.col(minute) + window - 1))))
    w = W.partitionBy(*by, "_c").orderBy(minute).rangeBetween(-(window - 1), -1)
    base = F.min(F.struct(F.col("low").alias("l"), (-F.col(minute)).alias("m"))).over(w)
    x = b.withColumn("_base", base).where((stretch(F.col(minute)) == F.col("_c")) & (F.col("high") + EPSILON >= F.col("_base.l") * rise))
    x = x.select(*by, day.alias("day"), minute, "high", F.col("_base.l").alias("base_low"), (-F.col("_base.m")).alias("base_minute"))
    first = F.min_by(F.struct(minute, "high", "base_low", "base_minute"), minute)
    return x.groupBy(*by, "day").agg(first.alias("_f")).select(*by, "day", "_f.*")


def crossing_mask(grid: DataFrame, by: list[str], at: str, window: int, rise: float = 1.25) -> DataFrame:
    """Adds crossing: on a dense grid, true where the window - 1 rows before are all observed and high reaches rise times their lowest low."""
    w = W.partitionBy(*by).orderBy(at).rowsBetween(-(window - 1), -1)
    full = F.sum(F.when(F.col("observed"), 1).otherwise(0)).over(w) == window - 1
    return grid.withColumn("crossing", F.coalesce(full & (F.col("high") >= F.min("low").over(w) * rise), F.lit(False)))


def session_detector(b: DataFrame, by: list[str], at: str, prior_close: str, rise_pct: float = 25.0) -> DataFrame:
    """One row a session: threshold, first cross, peak (the first of equals), gaps and flags."""
    thr = F.col(prior_close) * (1 + rise_pct / 100)
    w = W.partitionBy(*by).orderBy(at)
    x = b.withColumn("_thr", thr).withColumn("_gap", F.floor((F.col(at) - F.lag(at).over(w)) / 60) - 1)
    x = x.groupBy(*by).agg(
        F.max("_thr").alias("threshold"),
        F.min(F.when(F.col("high") >= F.col("_thr"), F.col(at))).alias("cross_at"),
        F.max("high").alias("session_high"),
        F.max_by(at, F.struct("high", -F.col(at))).alias("peak_at"),
        F.min_by("open", at).alias("first_open"),
        F.max_by("close", at).alias("last_close"),
        F.sum("n").alias("trades"),
        F.coalesce(F.max("_gap"), F.lit(0)).cast("long").alias("max_gap_minutes"),
    )
    flags = F.array_compact(F.array(F.when(F.col("max_gap_minutes") >= 5, F.lit("possible_halt_or_illiquidity")), F.when(F.col("first_open") < 1, F.lit("sub_dollar_at_open")), F.when(F.col("trades") <= 1, F.lit("thin_session"))))
    return x.withColumn("crossed", F.col("cross_at").isNotNull()).withColumn("flags", F.concat_ws(",", flags))


def prefilter(daily: DataFrame, by: list[str], day: str, rise: float = 1.25) -> DataFrame:
    """Days that can hold a surge: high reaches rise times the lower of this and the directly preceding day's low."""
    w = W.partitionBy(*by).orderBy(day)
    low = F.when(F.datediff(F.col(day), F.lag(day).over(w)) == 1, F.lag("low").over(w)).otherwise(F.col("low"))
    return daily.withColumn("_prev", low).where(F.col("high") + EPSILON >= F.least("_prev", "low") * rise).drop("_prev")


def session_scan(b: DataFrame, by: list[str], day: str, at: str, opens: Column, closes: Column, rise_pct: float = 25.0) -> DataFrame:
    """A row for each key and day with regular bars and a prior close: the detection result with its percentages, times and flags.

    The prior close is the last close of the key's day before. Bars have open, high, low,
    close, volume and n (trades), at in seconds; only those from the open until before the
    close with positive prices count. The first bar at the highest high is the peak.
    """
    close = b.groupBy(*by, day).agg(F.max_by("close", at).alias("_c"))
    prior = close.select(*by, day, F.lag("_c").over(W.partitionBy(*by).orderBy(day)).alias("prior_close")).where("prior_close > 0")
    x = b.withColumns({"_o": opens, "_e": closes}).where((F.col(at) >= F.col("_o")) & (F.col(at) < F.col("_e")))
    for c in ("open", "high", "low", "close"):
        x = x.where(F.col(c) > 0)
    x = x.join(prior, [*by, day])
    w = W.partitionBy(*by, day).orderBy(at)
    x = x.withColumns({"_thr": F.col("prior_close") * (1 + rise_pct / 100), "_gap": F.floor((F.col(at) - F.lag(at).over(w)) / 60) - 1})
    bar = F.struct(at, "volume", "n", "close")
    x = x.groupBy(*by, day).agg(
        F.max("prior_close").alias("prior_close"), F.max("_thr").alias("threshold_price"), F.min_by("open", at).alias("session_open"), F.max("high").alias("session_high"), F.min("low").alias("session_low"), F.max_by("close", at).alias("session_close"), F.sum("volume").alias("session_volume"), F.sum("n").alias("session_trade_count"),
        F.min_by(bar, at).alias("_first"), F.max_by(bar, F.struct("high", -F.col(at))).alias("_peak"), F.min(F.when(F.col("high") >= F.col("_thr"), F.col(at))).alias("threshold_cross_bar_start"), F.greatest(F.coalesce(F.max("_gap"), F.lit(0)), F.lit(0)).cast("long").alias("max_missing_bar_gap_minutes"), F.max("_o").alias("_o"),
    )
    pct = lambda a, base: F.when(base > 0, (a / base - 1) * 100).otherwise(0.0)
    c = F.col
    # Names of the flags.
    flags = F.array_compact(F.array(
        F.when(c(f"_first.{at}") > c("_o"), F.lit("no_trade_at_official_open")), F.when(c("_first.n") <= 1, F.lit("thin_opening_bar")), F.when(c("_peak.n") <= 1, F.lit("single_or_thin_peak_print")), F.when(c("max_missing_bar_gap_minutes") >= 5, F.lit("possible_halt_or_illiquidity")), F.when(c("session_open") < 1, F.lit("sub_dollar_at_open")), F.when(c("session_volume") < 100_000, F.lit("low_session_volume")),
    ))
    minutes = lambda t: F.floor((t - c("_o")) / 60)
    x = x.withColumns({
        "qualifies": c("threshold_cross_bar_start").isNotNull(), "opening_gap_pct": pct(c("session_open"), c("prior_close")), "high_vs_prior_close_pct": pct(c("session_high"), c("prior_close")), "open_to_peak_pct": pct(c("session_high"), c("session_open")), "first_minute_close": c("_first.close"), "first_minute_entry_to_peak_pct": pct(c("session_high"), c("_first.close")),
        "peak_bar_start": c(f"_peak.{at}"), "minutes_from_open_to_cross": minutes(c("threshold_cross_bar_start")), "minutes_from_open_to_peak": minutes(c(f"_peak.{at}")), "first_bar_volume": c("_first.volume"), "first_bar_trade_count": c("_first.n"), "peak_bar_volume": c("_peak.volume"), "peak_bar_trade_count": c("_peak.n"), "quality_flags": flags,
    })
    return x.drop("_first", "_peak", "_o")
