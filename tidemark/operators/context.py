"""Wide feature rows of samples: all windows, daily and hourly context, same-time volume, references, outcomes.

A sample is (sample_id, key, step): the last complete bar before its decision. Bars are one
row for each observed step (a minute, or any other unit) with open, high, low, close,
quote_volume, trade_count and taker_quote; a step without a row is unobserved.

Sums, extremes, falls, returns and lines over a stretch of steps come from folds of ready
blocks (``ranges``). Only exact percentiles of a sample's own minutes need the minutes
themselves (``meet``).
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.scalar import earlier_rate, interval_return, pct_change
from tidemark.operators import ranges
from tidemark.operators.features import adjusted_skew
from tidemark.sources.shared import Scratch

# Windows in minutes of the wide rows, of the narrower first version, and of reference assets.
CONTEXT_WINDOWS = (15, 30, 60, 120, 180, 360, 480, 720, 1440, 2880, 4320, 7200, 10080, 14400)
NARROW_WINDOWS = (1, 5, 15, 30, 60, 120, 180, 360, 480, 720, 1440)
REFERENCE_WINDOWS = (60, 180, 480, 1440, 4320, 10080, 14400)
# Column names of a window's metrics in the wide rows.
NAMES = {
    "observed_fraction": "observed_fraction_{}m",
    "ret": "ret_{}m_pct",
    "range": "range_{}m_pct",
    "quote_volume": "quote_volume_{}m",
    "trade_count": "trade_count_{}m",
    "average_trade_quote": "average_trade_quote_{}m",
    "taker_buy_ratio": "taker_buy_ratio_{}m",
    "realized_vol": "realized_vol_{}m_pct",
    "positive_return_fraction": "positive_return_fraction_{}m",
    "max_drawdown": "max_drawdown_{}m_pct",
    "max_runup": "max_runup_{}m_pct",
    "position_in_range": "position_in_{}m_range",
    "close_vs_high": "close_vs_{}m_high_pct",
    "close_vs_low": "close_vs_{}m_low_pct",
    "since_high": "minutes_since_{}m_high",
    "since_low": "minutes_since_{}m_low",
    "trend": "log_price_trend_{}m_pct_per_day",
    "trend_r2": "log_price_trend_{}m_r2",
}


def meet(samples: DataFrame, bars: DataFrame, by: str, at: str, span: int) -> DataFrame:
    """Samples with the bars of their key that are at most ``span`` steps old (age).

    Samples, the fewer rows, go to each bucket of steps they can reach, so bars are
    shuffled once and never copied, and a hot key is split by its buckets.
    """
    size = max(1, span // 8)
    s = samples.select("sample_id", by, F.col(at).alias("_end"), F.explode(F.sequence(F.floor((F.col(at) - span) / size), F.floor(F.col(at) / size))).alias("_b"))
    b = bars.withColumnRenamed(at, "_m").withColumn("_b", F.floor(F.col("_m") / size))
    x = s.join(b, [by, "_b"]).withColumn("_age", F.col("_end") - F.col("_m"))
    return x.where(F.col("_age").between(0, span)).drop("_b")


def entries(samples: DataFrame, bars: DataFrame, by: str, at: str) -> DataFrame:
    """sample_id, entry_price: the close of the sample's own bar; samples without one are missing."""
    return samples.select("sample_id", by, at).join(bars.select(by, at, F.col("close").alias("entry_price")), [by, at]).select("sample_id", "entry_price")


def trend(rows: DataFrame, by: list[str], order: str, value: str, step: float = 1.0, per_day: float = 1440.0, most: int = 600) -> DataFrame:
    """by, trend (percent a day), r2 of ln(value) over the row number, thinned by a stride to at most ``most`` rows.

    Null below six rows or with a value that isn't positive; r2 is null for constant values.
    """
    part = W.partitionBy(*by)
    x = rows.withColumn("_i", F.row_number().over(part.orderBy(order)) - 1).withColumn("_n", F.count("*").over(part)).withColumn("_least", F.min(value).over(part))
    x = x.where((F.col("_n") >= 6) & (F.col("_least") > 0) & (F.col("_i") % F.greatest(F.lit(1), F.ceil(F.col("_n") / most)) == 0))
    x = x.withColumn("_y", F.log(value)).withColumn("_x", F.col("_i") * F.lit(float(step)))
    return x.groupBy(*by).agg(_per_day(F.regr_slope("_y", "_x"), per_day).alias("trend"), F.when(F.max("_y") > F.min("_y"), F.regr_r2("_y", "_x")).alias("r2"))


def _per_day(slope: Column, per_day: float) -> Column:
    return F.expm1(slope * per_day) * 100


def window_metrics(samples: DataFrame, bars: DataFrame, by: str, at: str, windows: list[int] = CONTEXT_WINDOWS, per_day: float = 1440.0, vol_share: float = 0.8, vol_least: int = 5, trends: bool = True, tree: DataFrame | None = None) -> DataFrame:
    """sample_id, window and its metrics (the keys of NAMES), a row for each window of each sample that has its own bar.

    Windows are nested, so the steps between two of them are one stretch, folded from ready
    blocks of its key (``ranges``), and a window is the fold of its stretches: a sample
    meets some tens of blocks a window, never its bars. Ratios with a zero or missing
    denominator are null. Realised volatility needs ``vol_share`` of the window's closes and
    at least ``vol_least``. ``tree`` is ``ranges.blocks`` of the bars, if there is one
    already. The rows are a written table.
    """
    windows = sorted(windows)
    with Scratch(samples.sparkSession, "windows") as scratch:
        if tree is None:
            tree = scratch.cut(ranges.blocks(bars, by, at, windows[-1]))
        entry = entries(samples, bars, by, at)
        own = scratch.cut(samples.select("sample_id", by, F.col(at).cast("long").alias("_end")).join(entry, "sample_id"))
        wide = F.array(*(F.lit(w).cast("long") for w in windows))
        folds = scratch.cut(_window_folds(own, tree, by, windows))
        back = own.select("sample_id", by, "_end", F.explode(wide).alias("window"))
        lag = back.withColumn(at, F.col("_end") - F.col("window")).join(bars.select(by, F.col(at).cast("long").alias(at), F.col("close").alias("lag_close")), [by, at]).select("sample_id", "window", "lag_close")
        out = own.select("sample_id", "entry_price", "_end", F.explode(wide).alias("window")).join(folds, ["sample_id", "window"], "left").join(lag, ["sample_id", "window"], "left")
        if trends:
            out = _window_trends(out, own.select("sample_id", by, "_end"), bars, by, at, per_day, max(windows))
        else:
            out = out.withColumns({"trend": F.lit(None).cast("double"), "trend_r2": F.lit(None).cast("double")})
        return scratch.keep(scratch.cut(_finish(out, vol_share, vol_least)))


def _window_folds(own: DataFrame, tree: DataFrame, by: str, windows: list[int]) -> DataFrame:
    """sample_id, window and the fold of each window that holds a bar: of the stretches between two windows first, then of those that make it up."""
    rings = [F.struct(F.lit(i).alias("_ring"), (F.col("_end") - w + 1).alias("_low"), (F.col("_end") - (windows[i - 1] if i else 0)).alias("_high")) for i, w in enumerate(windows)]
    folds = ranges.fold_ranges(own.select("sample_id", by, F.inline(F.array(*rings))), tree, ["sample_id", "_ring"], by, "_low", "_high", windows[-1])
    reach = F.explode(F.slice(F.array(*(F.lit(w).cast("long") for w in windows)), F.col("_ring") + 1, len(windows))).alias("window")
    return ranges.fold(folds.select("*", reach), ["sample_id", "window"], -F.col("_ring"))


def _finish(out: DataFrame, vol_share: float, vol_least: int) -> DataFrame:
    """Metrics from the sums of each window."""
    c, seen, good = F.col, F.col("n") > 0, F.col("cmin") > 0
    n, wide = c("nr"), (c("high") > c("low"))
    variance = F.greatest((c("s2") - c("s") * c("s") / n) / (n - 1), F.lit(0.0))
    enough = F.coalesce(c("n"), F.lit(0)) >= F.greatest(F.lit(vol_least), F.floor(c("window") * vol_share + 1e-9))
    return out.select(
        "sample_id",
        "window",
        "entry_price",
        (F.coalesce(c("n"), F.lit(0)) / c("window")).alias("observed_fraction"),
        pct_change(c("lag_close"), c("entry_price")).alias("ret"),
        pct_change(c("low"), c("high")).alias("range"),
        F.when(seen, c("quote_volume")).alias("quote_volume"),
        F.when(seen, c("trade_count").cast("double")).alias("trade_count"),
        F.when(c("trade_count") > 0, c("quote_volume") / c("trade_count")).alias("average_trade_quote"),
        F.when(c("quote_volume") > 0, c("taker_quote") / c("quote_volume")).alias("taker_buy_ratio"),
        F.when(good & enough & (n >= 2), F.sqrt(variance) * F.sqrt(c("window").cast("double")) * 100).alias("realized_vol"),
        F.when(good & (c("n") > 1), c("up") / n).alias("positive_return_fraction"),
        F.when(good & (c("n") > 1), c("dd") * 100).alias("max_drawdown"),
        F.when(good & (c("n") > 1), c("ru") * 100).alias("max_runup"),
        F.when(wide, (c("entry_price") - c("low")) / (c("high") - c("low"))).alias("position_in_range"),
        F.when(wide, pct_change(c("high"), c("entry_price"))).alias("close_vs_high"),
        F.when(wide, pct_change(c("low"), c("entry_price"))).alias("close_vs_low"),
        F.when(wide, c("_end") - c("hi_at")).alias("since_high"),
        F.when(wide, c("_end") - c("lo_at")).alias("since_low"),
        F.when(good, c("trend")).alias("trend"),
        F.when(good, c("trend_r2")).alias("trend_r2"),
    )


def _window_trends(folds: DataFrame, own: DataFrame, bars: DataFrame, by: str, at: str, per_day: float, longest: int, most: int = 600) -> DataFrame:
    """folds with trend and trend_r2 of each window's ln(close) over its row numbers, every stride-th row from its first so that at most ``most`` count.

    Windows of up to ``most`` rows have their line from their fold. The rows of a thinned
    one are looked up by their rank in the key: its last row is the sample's own bar, so the
    others' ranks are known.
    """
    slope, r2 = ranges.line(F.col("n"), F.col("sy"), F.col("siy"), F.col("syy"))
    some = F.col("n").between(6, most)
    out = folds.withColumns({"trend": F.when(some, _per_day(slope, per_day)), "trend_r2": F.when(some & (F.col("cmax") > F.col("cmin")), r2)})
    if longest <= most:
        return out
    rank = ranges.ranks(bars, by, at).join(bars.select(by, at, "close"), [by, at])
    last = own.withColumnRenamed("_end", at).join(rank.select(by, at, "rank"), [by, at]).select("sample_id", by, "rank")
    long = folds.where(F.col("n") > most).select("sample_id", "window", "n").join(last, "sample_id")
    stride = F.ceil(F.col("n") / most)
    thin = long.select("sample_id", "window", by, (F.col("rank") - F.col("n") + 1).alias("_first"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, stride)).alias("_i"))
    rows = thin.withColumn("rank", F.col("_first") + F.col("_i")).join(rank.where("close > 0").select(by, "rank", F.log("close").alias("_y")), [by, "rank"]).withColumn("_x", F.col("_i").cast("double"))
    fits = rows.groupBy("sample_id", "window").agg(_per_day(F.regr_slope("_y", "_x"), per_day).alias("_t"), F.when(F.max("_y") > F.min("_y"), F.regr_r2("_y", "_x")).alias("_t2"))
    out = out.join(fits, ["sample_id", "window"], "left")
    return out.withColumns({"trend": F.coalesce("trend", "_t"), "trend_r2": F.coalesce("trend_r2", "_t2")}).drop("_t", "_t2")


def widen(rows: DataFrame, windows: list[int], metrics: list[str] | None = None, names: dict[str, str] = NAMES) -> DataFrame:
    """sample_id, entry_price and a column for each metric of each window."""
    metrics = metrics or list(names)
    held = rows.groupBy("sample_id").agg(F.first("entry_price").alias("entry_price"), F.map_from_entries(F.collect_list(F.struct("window", F.struct(*metrics)))).alias("_w"))
    return held.select("sample_id", "entry_price", *(F.element_at("_w", F.lit(w).cast("long"))[m].alias(names[m].format(w)) for w in windows for m in metrics))


def _coarse(samples: DataFrame, bars: DataFrame, by: str, at: str, span: int, size: int, name: str, tree: DataFrame | None) -> DataFrame:
    """Bars of the coarser unit of each sample's last ``span`` steps, from its observed bars: units inside are the key's own, those at the ends are folded."""
    end = F.col(at).cast("long")
    unit = lambda c: F.floor(c / F.lit(size)).cast("long")
    each = samples.select("sample_id", by, end.alias("_end"), (end - span + 1).alias("_from"), F.explode(F.sequence(unit(end - span + 1), unit(end))).alias(name))
    each = each.withColumns({"_low": F.greatest(F.col("_from"), F.col(name) * size), "_high": F.least(F.col("_end"), F.col(name) * size + size - 1)})
    whole = F.col("_high") - F.col("_low") == size - 1
    leaf = ranges.leaves(bars, at).withColumn(name, unit(F.col("_m")))
    units = leaf.groupBy(by, name).agg(F.min_by("open", "_m").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("last", "_m").alias("last"), *(F.sum(c).alias(c) for c in ranges.SUMS), F.count("*").alias("n"))
    out = ["sample_id", name, "open", "high", "low", F.col("last").alias("close"), "quote_volume", F.col("trade_count").alias("trades"), "taker_quote", F.col("n").alias("minutes")]
    inside = each.where(whole).join(units, [by, name]).select(*out)
    tree = ranges.blocks(bars, by, at, size) if tree is None else tree
    ends = ranges.fold_ranges(each.where(~whole), tree, ["sample_id", name], by, "_low", "_high", size).select(*out)
    return inside.unionByName(ends)


def daily_context(samples: DataFrame, bars: DataFrame, by: str, at: str, span: int = 14400, day: int = 1440, full: int = 1430, days: int = 11, tree: DataFrame | None = None, write: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """sample_id and the shape of its last ``days`` calendar days with data: counts, trends of volume, close and range, up days, taker share.

    ``write`` makes a table of the days, which are read several times.
    """
    d = write(_coarse(samples, bars, by, at, span, day, "_day", tree).withColumn("_k", F.row_number().over(W.partitionBy("sample_id").orderBy(F.desc("_day")))).where(F.col("_k") <= days))
    out = d.groupBy("sample_id").agg(
        F.count(F.when(F.col("minutes") >= full, 1)).alias("complete_daily_bars_in_context"),
        F.count("*").alias("calendar_days_with_data_in_context"),
        F.avg(F.when(F.col("close") > F.col("open"), 1.0).otherwise(0.0)).alias("up_day_fraction_context"),
        F.median(F.when(F.col("quote_volume") != 0, F.col("taker_quote") / F.col("quote_volume"))).alias("daily_taker_buy_ratio_median"),
    )
    wide = d.withColumn("_range", F.greatest((F.col("high") / F.col("low") - 1) * 100, F.lit(1e-9)) + 1)
    for value, name in (("quote_volume", "daily_quote_volume_trend"), ("close", "daily_close_trend"), ("_range", "daily_range_trend")):
        t = trend(wide, ["sample_id"], "_day", value, step=day, per_day=day)
        out = out.join(t.withColumnsRenamed({"trend": f"{name}_pct_per_day", "r2": f"{name}_r2"}), "sample_id", "left")
    late = [c for c in out.columns if c not in ("sample_id", "complete_daily_bars_in_context", "calendar_days_with_data_in_context")]
    return out.select("sample_id", "complete_daily_bars_in_context", "calendar_days_with_data_in_context", *(F.when(F.col("calendar_days_with_data_in_context") >= 3, F.col(c)).alias(c) for c in late))


# Percentiles of a distribution summary.
QUANTILES = {"p01": 0.01, "p05": 0.05, "p25": 0.25, "median": 0.5, "p75": 0.75, "p95": 0.95, "p99": 0.99}


def distribution(value: Column) -> dict[str, Column]:
    """Mean, deviation, adjusted skew, extremes, exact percentiles and positive share."""
    out = {"mean": F.avg(value), "std": F.when(F.count(value) > 1, F.stddev_samp(value)).otherwise(0.0), "skew": adjusted_skew(value), "min": F.min(value)}
    # constant values have no skew; pandas and the reference report it as zero
    out["skew"] = F.when((F.count(value) > 2) & (F.max(value) == F.min(value)), 0.0).otherwise(out["skew"])
    exact = F.percentile(value, F.array(*(F.lit(q) for q in QUANTILES.values())))
    out |= {k: exact[i] for i, k in enumerate(QUANTILES)}
    return out | {"max": F.max(value), "positive_fraction": F.avg(F.when(value > 0, 1.0).when(value.isNotNull(), 0.0))}


def hourly_context(samples: DataFrame, bars: DataFrame, by: str, at: str, span: int = 14400, hour: int = 60, back: int = 24, least: int = 18, tree: DataFrame | None = None, write: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """sample_id and distributions of minute and hourly returns, hourly volume and trades, and distances to the prior 24-hour high.

    ``write`` makes a table of the hours, which are read several times.
    """
    # exact percentiles of minute returns need the minutes; the closes are all that is met
    x = meet(samples, bars.select(by, at, "close"), by, at, span - 1)
    h = _coarse(samples, bars, by, at, span, hour, "_h", tree)
    w, wm = W.partitionBy("sample_id").orderBy("_h"), W.partitionBy("sample_id").orderBy("_m")
    prior = w.rowsBetween(-back, -1)
    h = write(h.withColumn("_prior", F.when(F.count("high").over(prior) >= least, F.max("high").over(prior))))
    minute = x.select("sample_id", F.lit("minute_return_pct_10d").alias("series"), (F.try_divide(F.col("close"), F.lag("close").over(wm)) * 100 - 100).alias("v"))
    pct = lambda a, b: F.try_divide(a, b) * 100 - 100
    named = F.array(
        F.struct(F.lit("hourly_return_pct_10d").alias("series"), pct(F.col("close"), F.lag("close").over(w)).alias("v")),
        F.struct(F.lit("hourly_quote_volume_10d").alias("series"), F.col("quote_volume").cast("double").alias("v")),
        F.struct(F.lit("hourly_trade_count_10d").alias("series"), F.col("trades").cast("double").alias("v")),
        F.struct(F.lit("close_vs_prior_24h_high_pct_10d").alias("series"), pct(F.col("close"), F.col("_prior")).alias("v")),
    )
    hourly = h.select("sample_id", named.alias("_s")).select("sample_id", F.inline("_s"))
    series = minute.unionByName(hourly).where("v is not null").groupBy("sample_id", "series").agg(F.struct(*(c.alias(k) for k, c in distribution(F.col("v")).items())).alias("d"))
    held = series.groupBy("sample_id").agg(F.map_from_entries(F.collect_list(F.struct("series", "d"))).alias("_d"))
    kinds = ("minute_return_pct_10d", "hourly_return_pct_10d", "hourly_quote_volume_10d", "hourly_trade_count_10d", "close_vs_prior_24h_high_pct_10d")
    stats = ["mean", "std", "skew", "min", *QUANTILES, "max", "positive_fraction"]
    held = held.select("sample_id", *(F.element_at("_d", F.lit(k))[s].alias(f"{k}_{s}") for k in kinds for s in stats))
    whole = h.groupBy("sample_id").agg(
        F.sum("minutes").alias("observed_minutes_10d"),
        F.count("*").alias("observed_hours_10d"),
        F.when(F.median("quote_volume") > 0, F.max("quote_volume") / F.median("quote_volume")).alias("maximum_hourly_volume_vs_median_10d"),
        F.count(F.when(F.col("high") >= F.col("_prior"), 1)).alias("new_rolling_24h_high_count_10d"),
    )
    return whole.join(held, "sample_id", "left")


def same_time(samples: DataFrame, bars: DataFrame, by: str, at: str, lengths: tuple[int, ...] = (15, 60), day: int = 1440, back: int = 7, tree: DataFrame | None = None) -> DataFrame:
    """sample_id and, for each length, the median volume of the same clock time on the days before and the present volume against it; only fully observed stretches count."""
    k = F.explode(F.sequence(F.lit(0), F.lit(back))).alias("_k")
    ends = samples.select("sample_id", by, F.col(at).alias("_at"), k).select("sample_id", by, "_k", (F.col("_at") - F.col("_k") * day).alias(at))
    each = ends.select("sample_id", by, "_k", F.col(at).alias("_high"), F.explode(F.array(*(F.lit(n).cast("long") for n in lengths))).alias("_n")).withColumn("_low", F.col("_high") - F.col("_n") + 1)
    tree = ranges.blocks(bars.select(by, at, "quote_volume"), by, at, max(lengths)) if tree is None else tree
    found = ranges.fold_ranges(each, tree, ["sample_id", "_k", "_n"], by, "_low", "_high", max(lengths))
    v = found.where("n = _n").groupBy("sample_id", "_k").agg(*(F.max(F.when(F.col("_n") == n, F.col("quote_volume"))).alias(f"_v{n}") for n in lengths))
    out = []
    for n in lengths:
        now, usual = F.max(F.when(F.col("_k") == 0, F.col(f"_v{n}"))), F.median(F.when(F.col("_k") > 0, F.col(f"_v{n}")))
        out += [usual.alias(f"quote_volume_{n}m_prior_7d_same_time_median"), F.when(usual > 0, now / usual).alias(f"quote_volume_{n}m_vs_prior_7d_same_time")]
    return samples.select("sample_id").join(v.groupBy("sample_id").agg(*out), "sample_id", "left")


def reference_context(samples: DataFrame, bars: DataFrame, by: str, at: str, references: dict, windows: tuple[int, ...] = REFERENCE_WINDOWS, vol_window: int = 1440, tree: DataFrame | None = None) -> DataFrame:
    """sample_id and, for each reference asset (prefix -> key), its returns over the windows and its volatility; the market proxy is the mean of those there are."""
    ref = bars.where(F.col(by).isin(*references.values()))
    every = sorted({*windows, vol_window})
    each = F.inline(F.array(*(F.struct(F.lit(p).alias("_prefix"), F.lit(k).cast(bars.schema[by].dataType).alias(by)) for p, k in references.items())))
    own = samples.select("sample_id", at, each)
    # samples of one step share the rows of its references
    points = own.select(by, at).distinct().select(F.struct(by, at).alias("sample_id"), by, at)
    rows = widen(window_metrics(points, ref, by, at, every, trends=False, tree=tree), every, ["ret", "realized_vol"])
    rows = own.join(rows.withColumn(by, F.col(f"sample_id.{by}")).withColumn(at, F.col(f"sample_id.{at}")).drop("sample_id"), [by, at])
    got = [(f"ret_{w}m_pct", f"ret_{w}m_pct") for w in windows] + [(f"realized_vol_{vol_window}m_pct", f"rv_{vol_window}m_pct")]
    columns = [F.max(F.when(F.col("_prefix") == p, F.col(c))).alias(f"{p}_{name}") for p in references for c, name in got]
    out = samples.select("sample_id").join(rows.select("sample_id", "_prefix", *(c for c, _ in got)).groupBy("sample_id").agg(*columns), "sample_id", "left")
    for w in windows:
        each = F.array_compact(F.array(*(F.col(f"{p}_ret_{w}m_pct") for p in references)))
        mean = F.aggregate(each, F.lit(0.0), lambda a, v: a + v) / F.size(each)
        out = out.withColumn(f"market_proxy_ret_{w}m_pct", F.when(F.size(each) > 0, mean))
    return out


def outcome_context(samples: DataFrame, bars: DataFrame, by: str, start: str, spans: dict[str, Column], longest: int, tree: DataFrame | None = None) -> DataFrame:
    """sample_id and, for each named span of steps from ``start`` (both ends inside), the largest gain and fall against entry_price and the observed share.

    spans gives each span's last step; none may lie more than ``longest`` steps after the start. Outcomes are never features.
    """
    step = "step" if "step" in bars.columns else start
    each = samples.select("sample_id", by, "entry_price", F.col(start).cast("long").alias("_low"), F.explode(F.array(*(F.struct(F.lit(k).alias("_k"), c.cast("long").alias("_high")) for k, c in spans.items()))).alias("_x")).select("sample_id", by, "entry_price", "_low", "_x.*")
    tree = ranges.blocks(bars.select(by, step, "high", "low"), by, step, longest) if tree is None else tree
    found = ranges.fold_ranges(each, tree, ["sample_id", "_k"], by, "_low", "_high", longest)
    x = each.join(found.select("sample_id", "_k", "high", "low", "n"), ["sample_id", "_k"], "left").withColumn("_length", F.col("_high") - F.col("_low") + 1)
    out = []
    for k in spans:
        of = lambda e: F.max(F.when(F.col("_k") == k, e))  # noqa: B023, E731
        out += [of(pct_change(F.col("entry_price"), F.col("high"))).alias(f"outcome_{k}_max_gain_pct"), of(pct_change(F.col("entry_price"), F.col("low"))).alias(f"outcome_{k}_max_drawdown_pct"), of(F.when(F.col("_length") > 0, F.coalesce("n", F.lit(0)) / F.col("_length")).otherwise(0.0)).alias(f"outcome_{k}_observed_fraction")]
    return samples.select("sample_id").join(x.groupBy("sample_id").agg(*out), "sample_id", "left").na.fill(0.0, [f"outcome_{k}_observed_fraction" for k in spans])


def derived(rows: DataFrame) -> DataFrame:
    """Adds ratios, accelerations and chained returns to a wide row that has the windows they take."""
    have = set(rows.columns)
    ratio = lambda a, b: F.when(F.col(b) != 0, F.col(a) / F.col(b))
    # Names of the derived columns and what they divide.
    ratios = {
        "volume_share_last_1d_of_3d": ("quote_volume_1440m", "quote_volume_4320m"),
        "volume_share_last_1d_of_7d": ("quote_volume_1440m", "quote_volume_10080m"),
        "volume_share_last_3d_of_10d": ("quote_volume_4320m", "quote_volume_14400m"),
        "volatility_1d_to_7d_ratio": ("realized_vol_1440m_pct", "realized_vol_10080m_pct"),
        "volatility_3d_to_10d_ratio": ("realized_vol_4320m_pct", "realized_vol_14400m_pct"),
        "range_1d_to_7d_ratio": ("range_1440m_pct", "range_10080m_pct"),
        "average_trade_size_1d_to_7d_ratio": ("average_trade_quote_1440m", "average_trade_quote_10080m"),
    }
    r1, r3, r5, r7, r10 = (F.col(f"ret_{w}m_pct") for w in (1440, 4320, 7200, 10080, 14400))
    new = {k: ratio(a, b) for k, (a, b) in ratios.items() if {a, b} <= have}
    if {"ret_1440m_pct", "ret_4320m_pct", "ret_7200m_pct", "ret_10080m_pct", "ret_14400m_pct"} <= have:
        new |= {
            "return_acceleration_1d_vs_prior_2d_pct_points_per_day": r1 - (r3 - r1) / 2,
            "return_acceleration_3d_vs_10d_pct_points_per_day": r3 / 3 - (r10 - r3) / 7,
            "relative_strength_3d_minus_10d_rate_pct_points": r3 / 3 - r10 / 10,
            "ret_prior_1d_to_3d_pct": interval_return(r3, r1),
            "ret_prior_1d_to_5d_pct": interval_return(r5, r1),
            "ret_prior_1d_to_7d_pct": interval_return(r7, r1),
            "ret_prior_1d_to_10d_pct": interval_return(r10, r1),
            "volume_last1d_vs_prior2d_daily_rate": earlier_rate(F.col("quote_volume_1440m"), F.col("quote_volume_4320m"), 2),
            "trade_count_last1d_vs_prior2d_daily_rate": earlier_rate(F.col("trade_count_1440m"), F.col("trade_count_4320m"), 2),
        }
    return rows.withColumns(new) if new else rows


def ten_day_context(samples: DataFrame, bars: DataFrame, by: str, at: str, references: dict | None = None, windows: tuple[int, ...] = CONTEXT_WINDOWS, prior_days: int = 10, day: int = 1440, hour: int = 60, same: tuple[int, ...] = (15, 60), reference_windows: tuple[int, ...] = REFERENCE_WINDOWS, least_notional: float = 0.0, liquidity: int = 5, horizon: int = 480, tree: DataFrame | None = None) -> DataFrame:
    """The whole feature row of each sample (sample_id, key, step, anchor step and any other columns), with its quality status.

    A sample without its own bar has status missing_decision_bar and nulls. References map
    a prefix to a key of the same bars. All features are of the key and step (outcomes of the
    anchor step, too), so samples that share these share one row. The bars and their
    blocks are made once, as tables, for all parts of the row, and each part is one, so no
    plan grows with the number of parts. ``tree`` is ``ranges.block_table`` of the bars, which
    are a table too then, if there is one already.
    """
    with Scratch(samples.sparkSession, "context") as scratch:
        # a file of few values is far smaller than its rows in memory, so no part is taken for small enough to go through the driver
        part = lambda df: scratch.cut(df).hint("merge")
        if tree is None:
            bars = scratch.cut(bars)
            tree = ranges.block_table(bars, by, at, scratch.cut)
        samples = part(samples)
        places = part(samples.select(by, at).distinct().select(F.struct(by, at).alias("sample_id"), by, at))
        rows = part(_ten_days(places, bars, tree, part, by, at, references, windows, prior_days, day, hour, same, reference_windows, least_notional, liquidity))
        out = _shared(samples, rows.drop("sample_id"), [by, at])
        if "anchor" in samples.columns:
            looks = samples.select(by, at, "anchor").distinct().select(F.struct(by, at, "anchor").alias("sample_id"), by, at, "anchor")
            priced = looks.join(entries(places, bars, by, at).select("entry_price", f"sample_id.{by}", f"sample_id.{at}"), [by, at]).withColumn("_from", F.col(at) + 1)
            moves = outcome_context(part(priced), bars.withColumnRenamed(at, "step"), by, "_from", {"to_anchor": F.least(F.col("anchor"), F.col("_from") + horizon - 1), "next_8h": F.col("_from") + horizon - 1}, horizon, tree)
            out = _shared(out, part(moves).select(*(f"sample_id.{c}" for c in (by, at, "anchor")), *moves.columns[1:]), [by, at, "anchor"])
        return scratch.keep(scratch.cut(out))


def _shared(samples: DataFrame, rows: DataFrame, on: list[str]) -> DataFrame:
    """samples with the row of their place, if there is one; nulls are equal."""
    same, named = F.lit(True), {c: f"_on_{c}" for c in on}
    for c in on:
        same = same & F.col(c).eqNullSafe(F.col(named[c]))
    return samples.join(rows.withColumnsRenamed(named), same, "left").drop(*named.values())


def _ten_days(samples, bars, tree, cut, by, at, references, windows, prior_days, day, hour, same, reference_windows, least_notional, liquidity) -> DataFrame:
    span = day * prior_days
    keep = samples.columns
    entry = entries(samples, bars, by, at)
    base = cut(samples.join(entry, "sample_id", "left"))
    with_bar = base.where("entry_price is not null").select(*keep)
    rows = base.join(cut(widen(window_metrics(samples, bars, by, at, list(windows), per_day=day, tree=tree), list(windows)).drop("entry_price")), "sample_id", "left")
    rows = rows.join(cut(daily_context(with_bar, bars, by, at, span, day, math.floor(day * 1430 / 1440), tree=tree, write=cut)), "sample_id", "left")
    rows = rows.join(cut(hourly_context(with_bar, bars, by, at, span, hour, tree=tree, write=cut)), "sample_id", "left")
    rows = rows.join(cut(same_time(with_bar, bars, by, at, same, day, tree=tree)), "sample_id", "left")
    seen = cut(segment_sums(with_bar, bars, by, at, {f"entry_quote_volume_{liquidity}m": (0, liquidity, "quote_volume")}, {"_seen": (0, span)}, tree))
    first = bars.groupBy(by).agg(F.min(at).alias("_first"))
    rows = rows.join(seen, "sample_id", "left").join(first, by, "left")
    rows = derived(rows)
    if references:
        rows = rows.join(cut(reference_context(with_bar, bars, by, at, references, reference_windows, day, tree)), "sample_id", "left")
        for w in reference_windows:
            if w in windows:
                rows = rows.withColumns({f"ret_{w}m_minus_{p}_pct_points": F.col(f"ret_{w}m_pct") - F.col(f"{p}_ret_{w}m_pct") for p in references} | {f"ret_{w}m_minus_market_proxy_pct_points": F.col(f"ret_{w}m_pct") - F.col(f"market_proxy_ret_{w}m_pct")})
    pass_ = F.coalesce(F.col(f"entry_quote_volume_{liquidity}m") >= least_notional, F.lit(False))
    share = F.coalesce(F.col("_seen"), F.lit(0)) / span
    status = F.when(F.col("entry_price").isNull(), "missing_decision_bar").when((share >= 0.995) & pass_, "pass").when(share >= 0.98, "warning").otherwise("insufficient_history")
    rows = rows.withColumns({"observed_fraction_prior_window": share, "missing_minutes_prior_window": span - F.coalesce(F.col("_seen"), F.lit(0)), "observed_history_days": (F.col(at) - F.col("_first")) / day, "entry_liquidity_pass": pass_, "feature_quality_status": status})
    return rows.drop("_seen", "_first")


def segment_sums(samples: DataFrame, bars: DataFrame, by: str, at: str, segments: dict[str, tuple[int, int, str]], counts: dict[str, tuple[int, int]] = {}, tree: DataFrame | None = None) -> DataFrame:
    """sample_id and, for each named (offset, length, column), the column's sum over the length steps that end ``offset`` steps before; null unless all are observed.

    ``counts`` names observed steps of (offset, length). Samples without a bar in any of them are missing.
    """
    every = sorted({(o, n) for o, n, _ in segments.values()} | set(counts.values()))
    longest = max(n for _, n in every)
    end = F.col(at).cast("long")
    each = samples.select("sample_id", by, F.inline(F.array(*(F.struct(F.lit(i).alias("_k"), (end - o - n + 1).alias("_low"), (end - o).alias("_high")) for i, (o, n) in enumerate(every)))))
    tree = ranges.blocks(bars, by, at, longest) if tree is None else tree
    x = ranges.fold_ranges(each, tree, ["sample_id", "_k"], by, "_low", "_high", longest)
    out = [F.max(F.when((F.col("_k") == every.index((o, n))) & (F.col("n") == n), F.col(column))).alias(name) for name, (o, n, column) in segments.items()]
    out += [F.max(F.when(F.col("_k") == every.index(p), F.col("n"))).alias(name) for name, p in counts.items()]
    return x.groupBy("sample_id").agg(*out)


def narrow_context(samples: DataFrame, bars: DataFrame, by: str, at: str, windows: tuple[int, ...] = NARROW_WINDOWS, unit: int = 1, day: int = 1440) -> DataFrame:
    """The narrower first version of the feature row: its windows, recent against previous volume, acceleration, taker change and the last candle.

    ``unit`` scales the 5, 15, 30 and 60 steps of the ratios.
    """
    u = unit
    names = {k: v for k, v in NAMES.items() if k in ("observed_fraction", "ret", "range", "quote_volume", "trade_count", "taker_buy_ratio", "realized_vol", "positive_return_fraction", "max_drawdown", "max_runup")}
    every = sorted({*windows, 15 * u, day})
    long = window_metrics(samples, bars, by, at, every, per_day=day, vol_least=3, trends=False)
    # windows below five steps have no volatility and no share of rises
    long = long.withColumns({m: F.when(F.col("window") >= 5, F.col(m)) for m in ("realized_vol", "positive_return_fraction")})
    wide = widen(long, list(windows), list(names), names)
    of_day = long.where(F.col("window") == day).select("sample_id", F.col("close_vs_high").alias("close_vs_24h_high_pct"), F.col("close_vs_low").alias("close_vs_24h_low_pct"), F.col("position_in_range").alias("position_in_24h_range"), F.col("since_high").alias("minutes_since_24h_high"), F.col("since_low").alias("minutes_since_24h_low"))
    recent = long.where(F.col("window") == 15 * u).select("sample_id", F.col("ret").alias("_r15"), F.col("taker_buy_ratio").alias("_t15"))
    q, t, k = "quote_volume", "trade_count", "taker_quote"
    sums = segment_sums(samples, bars, by, at, {"_q5": (0, 5 * u, q), "_q30": (5 * u, 30 * u, q), "_q15": (0, 15 * u, q), "_q60": (15 * u, 60 * u, q), "_t5": (0, 5 * u, t), "_t30": (5 * u, 30 * u, t), "_pq": (15 * u, 15 * u, q), "_pk": (15 * u, 15 * u, k)})
    x = meet(samples, bars, by, at, 30 * u)
    points = x.groupBy("sample_id").agg(F.max(F.when(F.col("_age") == 15 * u, F.col("close"))).alias("_c15"), F.max(F.when(F.col("_age") == 30 * u, F.col("close"))).alias("_c30"), *(F.max(F.when(F.col("_age") == 0, F.col(c))).alias(f"_{c}") for c in ("open", "high", "low", "close")))
    rows = wide
    for part in (of_day, recent, sums, points):
        rows = rows.join(part, "sample_id", "left")
    per = lambda a, b, n: F.when(F.col(b) > 0, F.col(a) / (F.col(b) / n))
    span = F.when(F.col("_high") > F.col("_low"), F.col("_high") - F.col("_low"))
    rows = rows.withColumns({
        "volume_ratio_5m_to_previous_30m": per("_q5", "_q30", 6),
        "volume_ratio_15m_to_previous_60m": per("_q15", "_q60", 4),
        "trade_intensity_ratio_5m_to_previous_30m": per("_t5", "_t30", 6),
        "return_acceleration_15m_pct_points": F.col("_r15") - pct_change(F.col("_c30"), F.col("_c15")),
        "taker_buy_ratio_change_15m": F.col("_t15") - F.when(F.col("_pq") > 0, F.col("_pk") / F.col("_pq")),
        "last_candle_body_fraction": F.abs(F.col("_close") - F.col("_open")) / span,
        "last_candle_upper_wick_fraction": (F.col("_high") - F.greatest("_open", "_close")) / span,
        "last_candle_lower_wick_fraction": (F.least("_open", "_close") - F.col("_low")) / span,
    })
    return rows.drop(*(c for c in rows.columns if c.startswith("_")))
