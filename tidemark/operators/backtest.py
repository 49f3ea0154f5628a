"""The execution backtest: sessions, triggers of both strategies, selected trades under friction, days and gates.

Ticks and bars carry symbol, trade_date (the New York day) and their time ``at`` in epoch
microseconds; all joins are equi-joins on symbol and trade_date, so tables that are
partitioned or bucketed by these are read where they lie.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators import evaluate, tape, universe

DAY_KEY = ["symbol", "trade_date"]
KEY = ["strategy", "trade_date", "symbol"]

# Thresholds of the two frozen rules, seeds of their bootstraps.
PREOPEN_THRESHOLD = -0.007082378439967338
MIDDAY_THRESHOLD_PCT = 13.776879223878035
SEEDS = {"preopen": 1701, "midday": 1702}


class Backtest(NamedTuple):
    triggers: DataFrame
    trades: DataFrame
    days: DataFrame
    summary: DataFrame


def local_micros(day: Column, clock: str, zone: str) -> Column:
    """Epoch microseconds of a wall clock time of a day in a zone."""
    return F.unix_micros(F.to_utc_timestamp(F.to_timestamp(F.concat_ws(" ", day.cast("string"), F.lit(clock))), zone))


def sessions(days: DataFrame, day: str = "day", opens: str = "09:30:00", closes: str = "16:00:00", reaction_s: float = 5.0, close_minutes: int = 5) -> DataFrame:
    """trade_date and the moments of its session.

    pre_from is 04:00 in New York, preopen_at 14:00 and midday_at 17:00 in London, open_at
    and close_at are the session's. Orders fill from preopen_enter (never before the open)
    or midday_enter on, until exit_by.
    """
    ny, london, wait = "America/New_York", "Europe/London", int(reaction_s * 1e6)
    d = F.col("trade_date")
    x = days.select(F.col(day).alias("trade_date")).distinct()
    x = x.withColumns({"pre_from": local_micros(d, "04:00:00", ny), "open_at": local_micros(d, opens, ny), "close_at": local_micros(d, closes, ny), "preopen_at": local_micros(d, "14:00:00", london), "midday_at": local_micros(d, "17:00:00", london)})
    return x.withColumns({"preopen_enter": F.greatest("open_at", "preopen_at") + wait, "midday_enter": F.col("midday_at") + wait, "exit_by": F.col("close_at") - close_minutes * 60_000_000})


def day_universe(daily: DataFrame, calendar: DataFrame, assets: DataFrame, look_back: int = 10) -> DataFrame:
    """A row for each listed symbol with daily bars on a trade date and on the last earlier day that has any, at most ``look_back`` days before.

    Adds prior_close, high, adjustment_scale, eligible (no scale, or one from 0.9 to 1.1)
    and the moments of the session. daily has open, high, close, raw_open and raw_close.
    """
    d = daily.join(assets.select("symbol").distinct(), "symbol", "left_semi")
    days = d.select("trade_date").distinct()
    # each date meets its look-back days by equality; days are few, and no window holds them all
    seen = calendar.select("trade_date").withColumn("_p", F.explode(F.sequence(F.date_sub("trade_date", look_back), F.date_sub("trade_date", 1))))
    prior = seen.join(days.withColumnRenamed("trade_date", "_p"), "_p").groupBy("trade_date").agg(F.max("_p").alias("_p"))
    before = d.select("symbol", F.col("trade_date").alias("_p"), F.col("close").alias("prior_close"))
    ratio = lambda a, b: F.when((F.col(a) != 0) & (F.col(b) != 0), F.col(a) / F.col(b))
    scale = F.coalesce(ratio("open", "raw_open"), ratio("close", "raw_close"))
    x = d.select(*DAY_KEY, "high", scale.alias("adjustment_scale")).join(prior, "trade_date").join(before, ["symbol", "_p"]).drop("_p")
    return x.withColumn("eligible", F.coalesce(F.col("adjustment_scale").between(0.9, 1.1), F.lit(True))).join(calendar, "trade_date")


def preopen_triggers(stocks: DataFrame, bars: DataFrame, trades: DataFrame, quotes: DataFrame, threshold: float = PREOPEN_THRESHOLD) -> DataFrame:
    """Symbols of the day's universe whose frozen score at the pre-open decision reaches the threshold.

    Only symbols with volume in a minute bar from 04:00 on count, and only if the decision
    comes before the open. Trades and quotes count up to the end of the decision's second;
    without trades or a spread there is no score.
    """
    day = stocks.where(F.col("eligible") & (F.col("preopen_at") < F.col("open_at"))).select(*DAY_KEY, "prior_close", "pre_from", (F.col("preopen_at") + 1_000_000).alias("_end"), F.col("preopen_at").alias("decision_at"), F.col("preopen_enter").alias("enter_from"), "exit_by")
    span = (F.col("at") >= F.col("pre_from")) & (F.col("at") < F.col("_end"))
    active = bars.where("volume > 0").join(day, DAY_KEY).where(span).select(*DAY_KEY).distinct()
    day = day.join(active, DAY_KEY, "left_semi")
    none = lambda kind: F.lit(None).cast(kind)
    t = trades.where("price > 0 and size > 0").select(*DAY_KEY, "at", "seq", F.col("price").cast("double").alias("price"), F.col("size").cast("long").alias("size"), none("double").alias("bid"), none("double").alias("ask"))
    q = quotes.select(*DAY_KEY, "at", "seq", none("double").alias("price"), none("long").alias("size"), F.col("bid_price").cast("double").alias("bid"), F.col("ask_price").cast("double").alias("ask"))
    ticks = t.unionByName(q).join(day.select(*DAY_KEY, "pre_from", "_end"), DAY_KEY).where(span).withColumn("second", F.expr("at div 1000000"))
    s = universe.preopen_summary(ticks, DAY_KEY, "second", ["at", "seq"]).where("volume > 0 and median_spread_bps is not null and trade_seconds > 0")
    s = s.withColumn("signal_value", universe.frozen_score(F.col("volume"), F.col("median_spread_bps"), F.col("realized_vol"))).where(F.col("signal_value") >= threshold)
    features = F.struct(F.col("volume").alias("trade_volume"), "median_spread_bps", F.col("realized_vol").alias("realized_second_log_vol"), "trade_seconds", "quote_count", "quote_seconds")
    return s.join(day, DAY_KEY).select(F.lit("preopen").alias("strategy"), *DAY_KEY, "signal_value", "prior_close", "decision_at", "enter_from", "exit_by", features.alias("features"))


def midday_triggers(stocks: DataFrame, bars: DataFrame, trades: DataFrame, threshold_pct: float = MIDDAY_THRESHOLD_PCT) -> DataFrame:
    """Symbols of the day's universe that stand more than the threshold above the prior close at the midday decision.

    The price is the close of the last minute bar before the decision, or the last trade of
    the decision's second. The day's high decides who is looked at, as it bounds the price.
    """
    reach = F.col("prior_close") * (1 + threshold_pct / 100)
    day = stocks.where(F.col("eligible") & (F.col("prior_close") > 0) & (F.col("high") >= reach)).select(*DAY_KEY, "prior_close", "open_at", F.col("midday_at").alias("decision_at"), F.col("midday_enter").alias("enter_from"), "exit_by")
    last = bars.join(day.select(*DAY_KEY, "open_at", "decision_at"), DAY_KEY).where((F.col("at") >= F.col("open_at")) & (F.col("at") < F.col("decision_at"))).groupBy(*DAY_KEY).agg(F.max_by("close", "at").alias("_bar"))
    late = trades.where("price > 0").join(day.select(*DAY_KEY, "decision_at"), DAY_KEY).where((F.col("at") >= F.col("decision_at")) & (F.col("at") < F.col("decision_at") + 1_000_000)).groupBy(*DAY_KEY).agg(F.max_by("price", F.struct("at", "seq")).alias("_late"))
    x = day.join(last, DAY_KEY).join(late, DAY_KEY, "left").withColumn("signal_value", (F.coalesce("_late", "_bar") / F.col("prior_close") - 1) * 100)
    return x.where(F.col("signal_value") > threshold_pct).select(F.lit("midday").alias("strategy"), *DAY_KEY, "signal_value", "prior_close", "decision_at", "enter_from", "exit_by")


def rank_triggers(triggers: DataFrame, most: int = 5) -> DataFrame:
    """Adds rank within strategy and date (largest signal first, then symbol) and selected, the first ``most``; a window holds one date's triggers."""
    w = W.partitionBy("strategy", "trade_date").orderBy(F.desc("signal_value"), "symbol")
    return triggers.withColumn("rank", F.row_number().over(w)).withColumn("selected", F.col("rank") <= most)


def execute(triggers: DataFrame, quotes: DataFrame, assets: DataFrame, notional: float = 500.0, stop_pct: float = 5.0, slip_bps: float = 5.0, stale: float = 60.0) -> DataFrame:
    """A trade for each selected trigger: its order under ``slip_bps`` of friction, and its profit under 0 and 10.

    A trigger without quotes has an unfilled trade; an asset that isn't fractionable buys
    whole shares. quotes hold sizes in shares.
    """
    picked = triggers.where("selected")
    known = assets.select("symbol", F.coalesce("fractionable", F.lit(False)).alias("fractionable"), F.coalesce("tradable", F.lit(False)).alias("tradable"), F.coalesce(F.col("status") == "active", F.lit(False)).alias("_active")).dropDuplicates(["symbol"])
    picked = picked.join(known, "symbol", "left").na.fill(False, ["fractionable", "tradable", "_active"])
    q = quotes.join(picked.select(*KEY, F.col("enter_from").alias("_from_us"), F.col("exit_by").alias("_by_us"), "prior_close", "fractionable"), DAY_KEY)
    q = q.where(F.col("at").between(F.col("_from_us"), F.col("_by_us"))).withColumns({"at": F.col("at") / 1e6, "_from": F.col("_from_us") / 1e6, "_by": F.col("_by_us") / 1e6})
    s = tape.simulate_scenarios(q, KEY, "at", "seq", "_from", "_by", "prior_close", notional, stop_pct, (slip_bps, 0.0, 10.0), "fractionable", stale)
    plain = [c for c in s.columns if c not in (*KEY, "slip_bps", "filled", "reason", "capacity_shortfall")]
    main = F.max(F.when(F.col("slip_bps") == float(slip_bps), F.struct("filled", "reason", "capacity_shortfall", *plain))).alias("m")
    other = [F.max(F.when(F.col("slip_bps") == v, F.col("pnl_usd"))).alias(f"pnl_{n}") for v, n in ((0.0, "0bps"), (10.0, "10bps"))]
    x = picked.join(s.groupBy(*KEY).agg(main, *other), KEY, "left")
    flags = F.array_compact(F.array(F.when(~F.col("tradable"), F.lit("point_in_time_tradability_unverified")), F.when(~F.col("_active"), F.lit("inactive_current_asset"))))
    no = F.lit(False)
    return x.select(
        *KEY, "rank", "signal_value", "prior_close", F.coalesce("m.filled", no).alias("filled"), F.when(F.col("m").isNull(), "no_executable_subthreshold_ask").otherwise(F.col("m.reason")).alias("unfilled_reason"), *(F.col(f"m.{c}").alias(c) for c in plain), F.coalesce("m.capacity_shortfall", no).alias("capacity_shortfall"), "pnl_0bps", "pnl_10bps", flags.alias("quality_flags"),
    )


def day_report(calendar: DataFrame, stocks: DataFrame, triggers: DataFrame, trades: DataFrame) -> DataFrame:
    """A row for each date of the calendar: status, reason, eligible and excluded symbols, triggers of each strategy, trades and fills."""
    u = stocks.groupBy("trade_date").agg(F.count_if("eligible").alias("eligible_symbol_count"), F.count_if(~F.col("eligible")).alias("adjustment_excluded"))
    g = triggers.groupBy("trade_date").agg(*(F.count_if(F.col("strategy") == s).alias(f"{s}_trigger_count") for s in ("preopen", "midday")))
    t = trades.groupBy("trade_date").agg(F.count("*").alias("selected_trade_count"), F.count_if("filled").alias("filled_trade_count"))
    x = calendar.select("trade_date", (F.col("preopen_at") >= F.col("open_at")).alias("preopen_skipped_not_before_open")).join(u, "trade_date", "left")
    none = F.col("eligible_symbol_count").isNull()
    x = x.withColumns({"status": F.when(none, "skipped").otherwise("completed"), "reason": F.when(none, "no_prior_session")}).join(g, "trade_date", "left").join(t, "trade_date", "left")
    return x.na.fill(0, ["eligible_symbol_count", "adjustment_excluded", "preopen_trigger_count", "midday_trigger_count", "selected_trade_count", "filled_trade_count"])


def all_triggers(stocks: DataFrame, bars: DataFrame, trades: DataFrame, quotes: DataFrame, most: int = 5) -> DataFrame:
    """The ranked triggers of both strategies; features is null for midday."""
    a = preopen_triggers(stocks, bars, trades, quotes)
    return rank_triggers(a.unionByName(midday_triggers(stocks, bars, trades), allowMissingColumns=True), most)


def backtest(daily: DataFrame, bars: DataFrame, trades: DataFrame, quotes: DataFrame, calendar: DataFrame, assets: DataFrame, most: int = 5, reps: int = 10_000, stale: float = 60.0, write=None) -> Backtest:
    """Triggers, trades, days and the summary with its gates, of both strategies.

    ``write`` cuts a frame (``Scratch.cut``, or a write to a table): the universe, triggers and
    trades are read several times, so without it they are computed again for each output.
    """
    write = write or (lambda df: df)
    stocks = write(day_universe(daily, calendar, assets))
    found = write(all_triggers(stocks, bars, trades, quotes, most))
    done = write(execute(found, quotes, assets, stale=stale))
    return Backtest(found, done, day_report(calendar, stocks, found, done), evaluate.backtest_summary(found, done, reps=reps, seeds=SEEDS))
