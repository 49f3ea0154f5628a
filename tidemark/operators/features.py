"""Point-in-time features over bars and daily rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.scalar import adjusted_skew, price_band


def window_metrics(samples: DataFrame, b: DataFrame, by: str, at: str, windows: list[int], span: int) -> DataFrame:
    """For each sample (by, at, sample_id) metrics of the windows that end at its minute, in one pass.

    Bars meet samples once, through (key, bucket of the longest window); every metric is a
    conditional aggregate on the bar's age, so all windows share one join and one shuffle.
    """
    longest = max(windows)
    bb = b.withColumnRenamed(at, "_m").withColumn("_b", F.explode(F.array(F.floor(F.col("_m") / longest), F.floor(F.col("_m") / longest) + 1)))
    ss = samples.withColumn("_b", F.floor(F.col(at) / longest))
    x = ss.join(bb, [by, "_b"]).withColumn("_age", F.col(at) - F.col("_m")).where((F.col("_age") >= 0) & (F.col("_age") < longest))
    out: list[Column] = []
    for w in windows:
        here = F.col("_age") < w
        hi, lo = F.max(F.when(here, F.col("high"))), F.min(F.when(here, F.col("low")))
        out += [
            F.count(F.when(here, 1)).alias(f"bars_{w}"),
            F.sum(F.when(here, F.col("n"))).alias(f"volume_{w}"),
            hi.alias(f"high_{w}"),
            lo.alias(f"low_{w}"),
            F.round(F.try_divide(F.sum(F.when(here, F.col("n"))), F.lit(w)), 6).alias(f"rate_{w}"),
            F.round((F.try_divide(hi, lo) - 1) * 100, 6).alias(f"range_pct_{w}"),
        ]
    return x.groupBy("sample_id").agg(*out)


def log_returns(rows: DataFrame, by: list[str], order: list[str], price: str) -> DataFrame:
    """Adds r, the log return over the previous row of the key with a positive price; rows without are left out."""
    w = W.partitionBy(*by).orderBy(*order)
    return rows.where(F.col(price) > 0).withColumn("r", F.log(F.col(price) / F.lag(price).over(w)))


def realized_vol(rows: DataFrame, by: list[str], order: list[str], price: str) -> DataFrame:
    """by, n, vol (percent: sample deviation times root of n), second_vol (root of the sum of squares), positive share."""
    x = log_returns(rows, by, order, price).where("r is not null")
    return x.groupBy(*by).agg(
        F.count("*").alias("n"), (F.stddev_samp("r") * F.sqrt(F.count("*").cast("double")) * 100).alias("vol"), F.sqrt(F.sum(F.col("r") * F.col("r"))).alias("second_vol"), F.avg(F.when(F.col("r") > 0, 1.0).otherwise(0.0)).alias("positive")
    )


def prior_high(rows: DataFrame, by: list[str], order: list[str], value: str, size: int = 24, least: int = 18) -> Column:
    """The largest value of the ``size`` rows before, if at least ``least`` of them are known."""
    w = W.partitionBy(*by).orderBy(*order).rowsBetween(-size, -1)
    return F.when(F.count(value).over(w) >= least, F.max(value).over(w))


def atr_pct(daily: DataFrame, by: list[str], day: str, size: int = 10) -> DataFrame:
    """by, atr_pct: median of true range over the previous close of the last ``size`` days."""
    w = W.partitionBy(*by).orderBy(day)
    prev = F.lag("close").over(w)
    tr = F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - prev), F.abs(F.col("low") - prev))
    x = daily.withColumn("_t", F.try_divide(tr, prev)).withColumn("_k", F.row_number().over(W.partitionBy(*by).orderBy(F.desc(day)))).where(f"_k <= {size} and _t is not null")
    return x.groupBy(*by).agg(F.median("_t").alias("atr_pct"))


def log_trend(rows: DataFrame, by: list[str], order: list[str], price: str, most: int = 600) -> DataFrame:
    """by, n, slope, r2 of ln(price) over the row number, rows thinned by a stride to at most ``most``; r2 is null for constant prices."""
    part = W.partitionBy(*by)
    x = rows.where(F.col(price) > 0).withColumn("_i", F.row_number().over(part.orderBy(*order)) - 1).withColumn("_n", F.count("*").over(part))
    stride = F.greatest(F.lit(1), F.ceil(F.col("_n") / most))
    x = x.where(F.col("_i") % stride == 0).withColumn("_y", F.log(price)).withColumn("_x", F.col("_i").cast("double"))
    return x.groupBy(*by).agg(F.count("*").alias("n"), F.regr_slope("_y", "_x").alias("slope"), F.when(F.max("_y") > F.min("_y"), F.regr_r2("_y", "_x")).alias("r2"))


def distribution(x: str, prefix: str = "") -> list[Column]:
    """Mean, deviation, adjusted skew, exact percentiles and positive share of a column."""
    c = F.col(x)
    qs = {"p01": 0.01, "p05": 0.05, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95, "p99": 0.99}
    return [F.avg(c).alias(f"{prefix}mean"), F.stddev_samp(c).alias(f"{prefix}std"), adjusted_skew(c).alias(f"{prefix}skew"), F.min(c).alias(f"{prefix}min"), *(F.percentile(c, q).alias(f"{prefix}{n}") for n, q in qs.items()), F.max(c).alias(f"{prefix}max"), F.avg(F.when(c > 0, 1.0).otherwise(0.0)).alias(f"{prefix}positive")]


def same_time_ratio(samples: DataFrame, b: DataFrame, by: str, at: str, window: int, period: int, back: int = 7) -> DataFrame:
    """sample_id, now, usual, ratio: the window's volume against the median of those ``period`` apart on the ``back`` periods before."""
    k = F.explode(F.sequence(F.lit(0), F.lit(back))).alias("_k")
    s = samples.select("*", k).withColumn("_end", F.col(at) - F.col("_k") * period)
    s = s.withColumn("_b", F.floor(F.col("_end") / window))
    bb = b.withColumnRenamed(at, "_m").withColumn("_b", F.explode(F.array(F.floor(F.col("_m") / window), F.floor(F.col("_m") / window) + 1)))
    x = s.join(bb, [by, "_b"], "left").withColumn("_in", (F.col("_m") <= F.col("_end")) & (F.col("_m") > F.col("_end") - window))
    x = x.groupBy("sample_id", "_k").agg(F.sum(F.when(F.col("_in"), F.col("n"))).alias("v"))
    x = x.groupBy("sample_id").agg(F.max(F.when(F.col("_k") == 0, F.col("v"))).alias("now"), F.median(F.when(F.col("_k") > 0, F.col("v"))).alias("usual"))
    return x.withColumn("ratio", F.try_divide(F.col("now"), F.col("usual")))


def outcomes(samples: DataFrame, b: DataFrame, by: str, at: str, horizon: int) -> DataFrame:
    """sample_id, max_gain, max_fall of highs and lows in the horizon after a sample against its price; never a feature."""
    bb = b.withColumnRenamed(at, "_m").withColumn("_b", F.explode(F.array(F.floor(F.col("_m") / horizon), F.floor(F.col("_m") / horizon) - 1)))
    x = samples.withColumn("_b", F.floor(F.col(at) / horizon)).join(bb, [by, "_b"])
    x = x.where((F.col("_m") > F.col(at)) & (F.col("_m") <= F.col(at) + horizon))
    return x.groupBy("sample_id").agg((F.max(F.try_divide(F.col("high"), F.col("price"))) - 1).alias("max_gain"), (F.min(F.try_divide(F.col("low"), F.col("price"))) - 1).alias("max_fall"))


def window_median(value: Column, window) -> Column:
    """Exact median of a column over an ordered frame of a few rows (the aggregate has no such form)."""
    own = F.sort_array(F.collect_list(value).over(window))
    n = F.size(own)
    return F.when(n > 0, (F.get(own, F.floor((n - 1) / 2).cast("int")) + F.get(own, F.floor(n / 2).cast("int"))) / 2)


def daily_features(daily: DataFrame, by: list[str], day: str, n: int = 10) -> DataFrame:
    """Features of each day from the n days before it only: median volume and dollar volume, momentum, prior return, deviation of log returns, ATR, band, logs.

    Returns are those between the n days; a day with fewer days before it goes, and so
    does one with a price that isn't positive.
    """
    w = W.partitionBy(*by).orderBy(day)
    past = w.rowsBetween(-n, -1)
    x = daily.withColumn("_lr", F.log(F.col("close") / F.lag("close").over(w)))
    x = x.withColumn("history", F.count("close").over(past)).withColumn("prior_close", F.lag("close").over(w))
    x = x.withColumn("median_volume", window_median(F.col("n"), past)).withColumn("median_dollar_volume", window_median(F.col("close") * F.col("n"), past))
    prev = F.lag("close").over(w)
    x = x.withColumn("_tr", F.when(prev > 0, F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - prev), F.abs(F.col("low") - prev)) / prev))
    x = x.withColumn("atr_pct", window_median(F.col("_tr"), past)).withColumn("listing_sessions", F.row_number().over(w) - 1).withColumn("_least", F.min("close").over(past))
    inner = w.rowsBetween(-(n - 1), -1)
    x = x.withColumn("realized_vol", F.stddev_samp("_lr").over(inner)).withColumn("prior_return", F.lag("close").over(w) / F.lag("close", 2).over(w) - 1)
    x = x.withColumn("momentum", F.lag("close").over(w) / F.lag("close", n).over(w) - 1).withColumn("no_hit", F.col("high") < F.col("prior_close") * 1.25)
    x = x.withColumns({"price_band": price_band(F.col("prior_close")), "log_prior_close": F.log(F.greatest("prior_close", F.lit(1e-9))), "log_median_dollar_volume": F.log(F.greatest("median_dollar_volume", F.lit(1.0))), "log_listing_sessions": F.log(F.greatest("listing_sessions", F.lit(1)))})
    return x.where((F.col("history") == n) & (F.col("_least") > 0) & (F.col("high") > 0)).drop("_lr", "_tr", "_least")
