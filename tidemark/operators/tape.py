"""Trade and quote tapes: seller exits, sellability, entry feasibility, the execution simulator."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.scalar import floor_div
from tidemark.operators import ordered


def vwap_to_target(tape: DataFrame, by: list[str], order: list[str], price: str, notional: Column, target: float) -> DataFrame:
    """by, sold, vwap, rows_used, reached: price reached when notional is taken in order until ``target`` (the last row in part).

    Whether it is reached allows for what a sum of doubles loses, a part in 10^12 of the
    target: a fixed 1e-12 is less than the last bit of a target over some thousands.
    """
    w = W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    x = tape.withColumn("_v", notional).withColumn("_before", F.coalesce(F.sum("_v").over(w), F.lit(0.0)))
    x = x.withColumn("_used", F.least(F.col("_v"), F.greatest(F.lit(0.0), F.lit(float(target)) - F.col("_before"))))
    x = x.groupBy(*by).agg(F.sum("_used").alias("sold"), F.try_divide(F.sum("_used"), F.sum(F.try_divide(F.col("_used"), F.col(price)))).alias("vwap"), F.count(F.when(F.col("_used") > 0, 1)).alias("rows_used"))
    return x.withColumn("reached", F.col("sold") + max(1.0, abs(float(target))) * 1e-12 >= target)


def second_rollup(ticks: DataFrame, by: list[str], at: str, unit: int, price: str, seq: str) -> DataFrame:
    """First, high, low, last, count of each second; the first of equal times opens, the last closes."""
    key = F.struct(at, seq)
    return ticks.withColumn("second", floor_div(F.col(at), unit)).groupBy(*by, "second").agg(F.min_by(price, key).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, key).alias("close"), F.count("*").alias("n"))


def snapshot(ticks: DataFrame, by: list[str], at: str, cutoff: Column, price: str, seq: str, trailing: list[int]) -> DataFrame:
    """State strictly before a cutoff: last price, totals, and counts and ranges over trailing spans."""
    x = ticks.withColumn("_cut", cutoff).where(F.col(at) < F.col("_cut"))
    key = F.struct(at, seq)
    out = [F.max_by(price, key).alias("last_price"), F.count("*").alias("n"), F.max(price).alias("high"), F.min(price).alias("low")]
    for t in trailing:
        here = F.col(at) >= F.col("_cut") - t
        out += [F.count(F.when(here, 1)).alias(f"n_{t}"), F.max(F.when(here, F.col(price))).alias(f"high_{t}"), F.sum(F.when(here, F.col(price))).alias(f"sum_{t}")]
    return x.groupBy(*by).agg(*out)


def sellability(spans: DataFrame, trades: DataFrame, by: str, start: str, stop: str, at: str, bucket: int) -> DataFrame:
    """by, displayed (total), segments, confirmed trades, status of quote spans and later trades of a key.

    A trade confirms a span if it comes strictly after the span's start and no later than its end.
    """
    held = ordered.interval_join(trades, spans.select(by, start, stop), by, at, start, stop, bucket)
    confirmed = held.select(by, at, "seq").distinct().groupBy(by).agg(F.count("*").alias("confirming"))
    shown = ordered.merged_duration(spans, [by], start, stop).withColumnRenamed("total", "displayed")
    traded = trades.groupBy(by).agg(F.count("*").alias("trades"))
    x = shown.join(traded, by, "full").join(confirmed, by, "left")
    x = x.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("segments", "displayed", "longest", "trades", "confirming")})
    status = F.when(F.col("confirming") > 0, "confirmed_sellable").when(F.col("displayed") > 0, "displayed_bid_only").when(F.col("trades") > 0, "trade_only").otherwise("not_confirmed")
    return x.withColumn("status", status)


def opportunity_segments(spans: DataFrame, by: list[str], start: str, stop: str, size: str, levels: list[float], gap: int) -> DataFrame:
    """by, level, segments, total, longest: runs of spans whose size reaches a level, broken by gaps beyond ``gap`` or by thin spans.

    Spans of equal start and stop go by their size, so the runs never depend on how the rows lie.
    """
    x = spans.withColumn("level", F.explode(F.array(*(F.lit(float(v)) for v in levels))))
    keys = [*by, "level"]
    w = W.partitionBy(*keys).orderBy(start, stop)
    placed = W.partitionBy(*keys).orderBy(start, stop, size)
    ok = F.col(size) >= F.col("level")
    x = x.withColumn("_ok", ok).withColumn("_broken", ~F.coalesce(F.lag("_ok").over(placed), F.lit(False)) | (F.col(start) - F.lag(stop).over(placed) > gap))
    x = x.withColumn("_i", F.sum(F.when(F.col("_ok") & F.coalesce("_broken", F.lit(True)), 1).otherwise(0)).over(w)).where("_ok")
    each = x.groupBy(*keys, "_i").agg((F.max(stop) - F.min(start)).alias("d"), F.count("*").alias("spans"))
    return each.groupBy(*keys).agg(F.count("*").alias("segments"), F.sum("d").alias("total"), F.max("d").alias("longest"), F.sum("spans").alias("spans"))


def simulate_execution(quotes: DataFrame, by: list[str], at: str, seq: str, bid: str, ask: str, limit: str, target: Column, stop_pct: float = 5.0, slip_bps: float = 10.0, stale: int = 60, close: Column | None = None) -> DataFrame:
    """Entry at the first quote whose ask is below the limit; exit at the first quote from then on that reaches target or stop, else at the close.

    The state machine has a closed form: two first-row aggregates over one partitioning.
    The entering quote may also exit. A time exit needs a last quote at most ``stale`` old.
    """
    slip = slip_bps / 1e4
    valid = quotes.where((F.col(bid) > 0) & (F.col(ask) >= F.col(bid)))
    w = W.partitionBy(*by)
    key = F.struct(at, seq)
    x = valid.withColumn("_enter", F.min(F.when(F.col(ask) < F.col(limit), key)).over(w))
    x = x.withColumn("_fill", F.max(F.when(key == F.col("_enter"), F.col(ask))).over(w) * (1 + slip)).where(F.col("_enter").isNotNull() & (key >= F.col("_enter")))
    x = x.withColumn("_target", target).withColumn("_stop", F.col("_fill") * (1 - stop_pct / 100))
    hit = (F.col(bid) >= F.col("_target")) | (F.col(bid) <= F.col("_stop"))
    out = x.groupBy(*by).agg(
        F.first("_enter").getField(at).alias("entry_at"), F.first("_fill").alias("entry_price"), F.min_by(F.struct(F.col(at).alias("t"), F.col(bid).alias("b"), (F.col(bid) >= F.col("_target")).alias("won")), F.when(hit, key)).alias("_x"), F.max_by(F.struct(F.col(at).alias("t"), F.col(bid).alias("b")), key).alias("_last"), *([F.max(close).alias("_close")] if close is not None else [])
    )
    fresh = (F.col("_close") - F.col("_last.t") <= stale) if close is not None else F.lit(True)
    reason = F.when(F.col("_x").isNotNull(), F.when(F.col("_x.won"), "target").otherwise("stop")).when(fresh, "time").otherwise("no_executable_close_exit")
    price = F.when(F.col("_x").isNotNull(), F.col("_x.b")).when(fresh, F.col("_last.b")) * (1 - slip)
    return out.select(*by, "entry_at", "entry_price", F.when(F.col("_x").isNotNull(), F.col("_x.t")).when(fresh, F.col("_last.t")).alias("exit_at"), price.alias("exit_price"), reason.alias("reason"), (price / F.col("entry_price") - 1).alias("ret"))


def seller_tape(trades: DataFrame, by: list[str], at: str, seq: str, price: str, size: str, seller: str, threshold: Column, target: float, tolerance: float = 1e-12) -> DataFrame:
    """by and what sellers took after a crossing: notional at any price and at or above the threshold, base quantity, price range, first time, and the fill of ``target`` notional.

    seller marks trades in which the taker sold. The fill takes seller trades in order
    until the target (the last in part): its price and time are that trade's, its VWAP
    is the target over the base quantity it took.
    """
    w = W.partitionBy(*by).orderBy(at, seq).rowsBetween(W.unboundedPreceding, 0)
    sold, above = F.col(seller), F.col(price) + tolerance >= threshold
    x = trades.withColumn("_v", F.col(price) * F.col(size))
    x = x.withColumns({"_above": F.coalesce(above, F.lit(False)), "_sv": F.when(sold, F.col("_v")).otherwise(0.0)}).withColumn("_run", F.sum("_sv").over(w))
    x = x.withColumn("_used", F.when(sold, F.least(F.col("_sv"), F.greatest(F.lit(0.0), F.lit(float(target)) - (F.col("_run") - F.col("_sv"))))))
    reached = sold & (F.col("_run") + 1e-12 >= target)
    out = x.groupBy(*by).agg(
        F.sum("_sv").alias("seller_notional_any_price"),
        F.sum(F.when(sold, F.col(size)).otherwise(0.0)).alias("seller_base_quantity_any_price"),
        F.sum(F.when(sold & F.col("_above"), F.col("_v")).otherwise(0.0)).alias("seller_notional_at_or_above"),
        F.sum(F.when(F.col("_above"), F.col("_v")).otherwise(0.0)).alias("all_trade_notional_at_or_above"),
        F.min(F.when(sold, F.col(at))).alias("first_seller_exit_at"),
        F.min(F.when(sold, F.col(price))).alias("lowest_seller_exit_price"),
        F.max(F.when(sold, F.col(price))).alias("highest_seller_exit_price"),
        F.min_by(F.struct(F.col(at).alias("at"), F.col(price).alias("price")), F.when(reached, F.struct(at, seq))).alias("_hit"),
        F.sum(F.when(F.col("_used") > 0, F.try_divide(F.col("_used"), F.col(price)))).alias("_base"),
    )
    hit = F.col("_hit").isNotNull() & F.lit(target > 0)
    return out.withColumns({"cumulative_hit_at": F.when(hit, F.col("_hit.at")), "cumulative_hit_price": F.when(hit, F.col("_hit.price")), "exit_vwap": F.when(hit & (F.col("_base") > 0), F.lit(float(target)) / F.col("_base"))}).drop("_hit", "_base")


def second_summary(trades: DataFrame, quotes: DataFrame, by: list[str], at: str, seq: str) -> DataFrame:
    """A row for each second with trades or quotes: trade open, high, low, close, volume and count; last bid and ask, least spread, updates.

    at is in nanoseconds. Of equal times the first trade opens, the last closes and the last quote stands.
    """
    key = F.struct(at, seq)
    t = trades.withColumn("second", floor_div(F.col(at), 1_000_000_000)).groupBy(*by, "second").agg(F.min_by("price", key).alias("trade_open"), F.max("price").alias("trade_high"), F.min("price").alias("trade_low"), F.max_by("price", key).alias("trade_close"), F.sum("size").alias("trade_volume"), F.count("*").alias("trade_count"))
    last = F.max_by(F.struct("bid_price", "bid_size_shares", "ask_price", "ask_size_shares"), key)
    q = quotes.withColumn("second", floor_div(F.col(at), 1_000_000_000)).groupBy(*by, "second").agg(last.alias("_q"), F.min("spread").alias("min_spread"), F.count("*").alias("quote_updates")).select(*by, "second", "_q.*", "min_spread", "quote_updates")
    return t.join(q, [*by, "second"], "full").na.fill(0, ["trade_volume", "trade_count", "quote_updates"])


def snapshot_summary(seconds: DataFrame, by: list[str], cutoff: Column, prior_close: Column) -> DataFrame:
    """by and the state at an inclusive cutoff second of second rows: totals, price path, spreads, depth and the trailing 60 and 300 seconds.

    A key without a row up to its cutoff is missing. Seconds count as traded with a trade,
    as quoted with both sides.
    """
    x = seconds.withColumns({"_cut": cutoff, "_prior": prior_close}).where(F.col("second") <= F.col("_cut"))
    traded, quoted = F.col("trade_count") > 0, (F.col("bid_price") > 0) & (F.col("ask_price") > 0)
    w = W.partitionBy(*by).orderBy("second").rowsBetween(W.unboundedPreceding, -1)
    before = F.last(F.when(traded & (F.col("trade_close") > 0), F.col("trade_close")), ignorenulls=True).over(w)
    x = x.withColumn("_r", F.when(traded & (F.col("trade_close") > 0), F.log(F.col("trade_close") / before)))
    mid = (F.col("bid_price") + F.col("ask_price")) / 2
    x = x.withColumns({"_t": F.when(traded, F.lit(True)), "_q": F.when(quoted, F.lit(True)), "_bps": F.when(quoted & F.col("min_spread").isNotNull(), F.col("min_spread") / mid * 10_000), "_bn": F.when(quoted, F.col("bid_price") * F.col("bid_size_shares")), "_an": F.when(quoted, F.col("ask_price") * F.col("ask_size_shares"))})
    at = lambda flag: F.when(F.col(flag), F.col("second"))
    quote = F.struct(F.col("bid_price").alias("b"), F.col("ask_price").alias("a"), F.col("_bn").alias("bn"), F.col("_an").alias("an"))
    out = [
        F.min("second").alias("first_observed"), F.max("second").alias("last_observed"), F.count("*").alias("active_seconds"), F.count("_t").alias("trade_seconds"), F.count("_q").alias("quote_seconds"),
        F.sum(F.when(F.col("_t"), F.col("trade_count")).otherwise(0)).alias("trade_count"), F.sum(F.when(F.col("_t"), F.col("trade_volume")).otherwise(0)).alias("trade_volume"), F.sum(F.when(F.col("_q"), F.col("quote_updates")).otherwise(0)).alias("quote_updates"),
        F.min_by("trade_open", at("_t")).alias("first_trade_price"), F.max_by("trade_close", at("_t")).alias("last_trade_price"), F.max(F.when(F.col("_t"), F.col("trade_high"))).alias("high"), F.min(F.when(F.col("_t"), F.col("trade_low"))).alias("low"),
        F.sqrt(F.coalesce(F.sum(F.col("_r") * F.col("_r")), F.lit(0.0))).alias("realized_volatility_second_log"), F.coalesce(F.max(F.abs("_r")), F.lit(0.0)).alias("max_abs_second_log_return"),
        F.median("_bps").alias("median_spread_bps"), F.percentile("_bps", 0.9).alias("p90_spread_bps"), F.median("_bn").alias("median_bid_notional"), F.median("_an").alias("median_ask_notional"), F.max_by(quote, at("_q")).alias("_last"), F.max("_prior").alias("_prior"),
    ]
    for n in (60, 300):
        late = F.col("second") > F.col("_cut") - n
        t, q = late & traded, late & quoted
        out += [F.count(F.when(late, 1)).alias(f"trailing_{n}s_active_seconds"), F.sum(F.when(t, F.col("trade_count")).otherwise(0)).alias(f"trailing_{n}s_trade_count"), F.sum(F.when(t, F.col("trade_volume")).otherwise(0)).alias(f"trailing_{n}s_trade_volume"), F.sum(F.when(q, F.col("quote_updates")).otherwise(0)).alias(f"trailing_{n}s_quote_updates")]
        out += [F.max_by("trade_close", F.when(t, F.col("second"))).alias(f"trailing_{n}s_last_trade_price"), F.max_by("bid_price", F.when(q, F.col("second"))).alias(f"trailing_{n}s_last_bid"), F.max_by("ask_price", F.when(q, F.col("second"))).alias(f"trailing_{n}s_last_ask")]
    y = x.groupBy(*by).agg(*out)
    pct = lambda a, b: F.when((F.col(a) != 0) & (F.col(b) != 0), (F.col(a) / F.col(b) - 1) * 100)
    return y.withColumns({
        "return_from_first_trade_pct": pct("last_trade_price", "first_trade_price"), "return_from_prior_close_pct": pct("last_trade_price", "_prior"), "range_pct_of_prior_close": F.when(F.col("_prior") != 0, (F.col("high") - F.col("low")) / F.col("_prior") * 100),
        "last_bid": F.col("_last.b"), "last_ask": F.col("_last.a"), "last_bid_notional": F.col("_last.bn"), "last_ask_notional": F.col("_last.an"),
    }).drop("_last", "_prior")


# Notional levels of the entry analysis, and the gap that does not break a segment.
NOTIONAL_LEVELS = (100.0, 500.0, 1000.0, 5000.0)
SEGMENT_GAP_NS = 2_000_000


def entry_intervals(quotes: DataFrame, by: list[str], at: str, seq: str, opens: str, cross: str, threshold: str, least: float) -> DataFrame:
    """by, start, stop, ask, notional: how long each quote's ask stood below the threshold with at least ``least`` notional, between the open and the crossing.

    A quote stands until the next of its key, the last until the crossing. An ask counts
    with a positive price and size and a bid that isn't above it.
    """
    inside = quotes.where((F.col(at) >= F.col(opens)) & (F.col(at) < F.col(cross)))
    x = ordered.state_intervals(inside, by, at, seq, F.col(cross), keep_empty=False)
    ok = (F.col("ask_price") > 0) & (F.col("ask_size_shares") > 0) & ((F.coalesce("bid_price", F.lit(0.0)) <= 0) | (F.col("ask_price") >= F.col("bid_price")))
    return x.where(ok & (F.col("ask_price") < F.col(threshold))).withColumn("notional", F.col("ask_price") * F.col("ask_size_shares")).where(F.col("notional") >= least).select(*by, "start", "stop", F.col("ask_price").alias("ask"), "notional", F.col(opens).alias("_open"), F.col(cross).alias("_cross"), F.col(threshold).alias("_threshold"))


def confirming(trades: DataFrame, spans: DataFrame, by: list[str], at: str, seq: str) -> DataFrame:
    """Trades with the entry interval (r_) that they come in: strictly after its start, no later than its end, before the crossing."""
    # intervals of a key don't overlap, so the interval of a trade is the last that starts before it
    last = spans.select(*by, F.col("start").alias(at), "stop", "ask", "_froms", F.col("start").alias("_s"), "_cross", F.lit(0).alias("_z"))
    held = ordered.asof_join(trades.select(*by, at, seq, "price"), last, by, at, ["stop", "ask", "_froms", "_s", "_cross"], "_z", strict=True)
    return held.where((F.col(at) < F.col("r__cross")) & (F.col(at) <= F.col("r_stop")))


def entry_feasibility(quotes: DataFrame, trades: DataFrame, by: list[str], at: str, seq: str, opens: str, cross: str, threshold: str, levels: tuple[float, ...] = NOTIONAL_LEVELS, window_start: Column | None = None, windows: dict[str, Column] | None = None, delay_ns: int = 5_000_000_000, least_seconds: float = 30.0, least_edge_pct: float = 0.0, need_trade: bool = True) -> DataFrame:
    """by, level and the opportunities to buy below the threshold before the first trade at it.

    Quotes and trades have the key, at (ns) and seq; quotes also bid_price, ask_price and
    ask_size_shares, and the key's open, crossing and threshold. Intervals of enough
    notional that lie within 2 ms form a segment; one of too little breaks it. A trade
    confirms an interval if it comes strictly after its start and no later than its end,
    after the reaction delay, at its ask or above. A segment is actionable if it lasts
    ``least_seconds`` and its first confirmation with enough edge is there. ``windows`` names
    several starts (of _open, _cross and _threshold): all come from one pass over quotes
    and trades, with their name in a column window.
    """
    spans = entry_intervals(quotes, by, at, seq, opens, cross, threshold, min(levels))
    starts = windows or {"after_open": window_start if window_start is not None else F.col("_open")}
    spans = spans.withColumn("_froms", F.array(*(F.greatest(F.col("_open"), c) + delay_ns for c in starts.values())))
    held = confirming(trades, spans, by, at, seq)
    # a confirmation of each window from one pass over the trades
    fits = F.col("price") + 1e-12 >= F.col("r_ask")
    hits = held.groupBy(*by, F.col("r__s").alias("start")).agg(F.array(*(F.min(F.when(fits & (F.col(at) >= F.get("r__froms", F.lit(i))), F.col(at))) for i in range(len(starts)))).alias("_confirms"))
    names = F.array(*(F.lit(n) for n in starts))
    x = spans.join(hits, [*by, "start"], "left").select("*", F.posexplode("_froms").alias("_i", "_from")).withColumns({"confirm": F.get("_confirms", F.col("_i")), "window": F.get(names, F.col("_i"))}).drop("_froms", "_confirms", "_i").where(F.col("stop") > F.col("_from"))
    by, base = [*by, "window"], by
    x = x.withColumn("level", F.explode(F.array(*(F.lit(float(v)) for v in levels))))
    w = W.partitionBy(*by, "level").orderBy("start")
    x = x.withColumns({"_ok": F.col("notional") + 1e-9 >= F.col("level"), "_s": F.greatest("start", "_from"), "_e": F.col("stop")})
    x = x.withColumn("_edge", (F.col("_threshold") / F.col("ask") - 1) * 100)
    joined = F.lag("_ok").over(w) & (F.col("_s") - F.lag("_e").over(w) <= SEGMENT_GAP_NS)
    x = x.withColumn("_new", F.when(F.col("_ok") & ~F.coalesce(joined, F.lit(False)), 1).otherwise(0)).withColumn("_i", F.sum("_new").over(w)).where("_ok")
    at_entry = F.col("confirm") if need_trade else F.col("_s")
    edged = F.when(at_entry.isNotNull() & (F.col("_edge") + 1e-12 >= least_edge_pct), at_entry)
    entry = lambda when: F.min_by(F.struct(when.alias("at"), F.col("ask").alias("ask"), F.col("_edge").alias("edge")), F.when(when.isNotNull(), F.struct(when, F.col("_s"))))
    seg = x.groupBy(*by, "level", "_i").agg(
        F.min("_s").alias("s"), ((F.max("_e") - F.min("_s")) / 1e9).alias("seconds"), F.max("notional").alias("notional"), F.min("ask").alias("ask"), entry(F.col("confirm")).alias("confirmed"), entry(edged).alias("edged"), F.min_by("ask", "_s").alias("first_ask"), F.max("_threshold").alias("_threshold"), F.max("_cross").alias("_cross"), F.max("_from").alias("_from")
    )
    mechanical = F.when(F.col("confirmed").isNotNull(), F.struct(F.col("confirmed.at").alias("at"), F.col("confirmed.ask").alias("ask")))
    if not need_trade:
        mechanical = F.coalesce(mechanical, F.struct(F.col("s").alias("at"), F.col("first_ask").alias("ask")))
    can = mechanical.isNotNull() & (F.col("seconds") + 1e-12 >= least_seconds) & F.col("edged").isNotNull()
    seg = seg.withColumns({"_m": mechanical, "_a": F.when(can, F.struct(F.col("edged.at").alias("at"), F.col("edged.ask").alias("ask"), F.col("edged.edge").alias("edge"), "seconds"))})
    out = seg.groupBy(*by, "level").agg(
        F.count("*").alias("segments"), F.sum("seconds").alias("total_displayed_seconds"), F.max("seconds").alias("max_contiguous_displayed_seconds"), F.max("notional").alias("max_displayed_ask_notional"), F.min("ask").alias("minimum_displayed_ask"),
        F.min_by("_m", F.col("_m.at")).alias("_m"), F.min_by("_a", F.col("_a.at")).alias("_a"), F.max("_threshold").alias("_threshold"), F.max("_cross").alias("_cross"), F.max("_from").alias("_from"),
    )
    keys = quotes.select(*base).distinct().withColumn("window", F.explode(names)).withColumn("level", F.explode(F.array(*(F.lit(float(v)) for v in levels))))
    out = keys.join(out, [*by, "level"], "left")
    got = out.select(
        *by, "level", F.col("segments").isNotNull().alias("displayed"), F.col("_m").isNotNull().alias("mechanically_purchasable"), F.col("_a").isNotNull().alias("manually_actionable"), F.coalesce("total_displayed_seconds", F.lit(0.0)).alias("total_displayed_seconds"), F.coalesce("max_contiguous_displayed_seconds", F.lit(0.0)).alias("max_contiguous_displayed_seconds"), F.coalesce("max_displayed_ask_notional", F.lit(0.0)).alias("max_displayed_ask_notional"), "minimum_displayed_ask",
        F.col("_m.at").alias("first_confirmed_at"), F.col("_m.ask").alias("first_confirmed_ask"), ((F.col("_threshold") / F.col("_m.ask") - 1) * 100).alias("first_confirmed_edge_pct"), F.col("_a.at").alias("first_actionable_at"), F.col("_a.ask").alias("first_actionable_ask"), F.col("_a.edge").alias("first_actionable_edge_pct"), F.col("_a.seconds").alias("first_actionable_segment_seconds"),
        ((F.col("_m.at") - F.col("_from")) / 1e9).alias("seconds_to_first_confirmed"), ((F.col("_cross") - F.col("_m.at")) / 1e9).alias("seconds_from_first_confirmed_to_threshold"),
    )
    return got if windows else got.drop("window")


def entry_flags(levels: DataFrame, by: list[str], primary: float, opens: Column, cross: Column, quotes: Column, trades: Column) -> DataFrame:
    """by, quality_flags, purchase_feasible, primary_actionable of the primary notional level."""
    # Names of the flags.
    x = levels.where(F.col("level") == primary)
    shown = F.when(~F.col("displayed"), "no_subthreshold_ask_at_primary_notional").when(~F.col("mechanically_purchasable"), "subthreshold_ask_not_trade_confirmed").when(~F.col("manually_actionable"), "entry_opportunity_below_manual_duration_or_edge_gate")
    flags = F.array_compact(F.array(F.when(cross <= opens, F.lit("threshold_reached_at_or_before_regular_open")), F.when(quotes == 0, F.lit("no_regular_session_quotes_before_threshold")), F.when(trades == 0, F.lit("no_regular_session_trades_during_candidate_ask_intervals")), shown))
    return x.select(*by, flags.alias("quality_flags"), F.col("mechanically_purchasable").alias("purchase_feasible"), F.col("manually_actionable").alias("primary_actionable"))


def london_windows() -> dict[str, Column]:
    """Starts of the decision windows of an event: its open, and the snapshots of its London day, in nanoseconds."""
    # Names and London times of the snapshots.
    clocks = {"preopen_1400_bst": "14:00:00", "midday_1700_bst": "17:00:00", "afternoon_1900_bst": "19:00:00"}
    day = F.to_date(F.from_utc_timestamp(F.timestamp_micros(F.expr("_open div 1000")), "Europe/London")).cast("string")
    at = lambda c: F.unix_micros(F.to_utc_timestamp(F.to_timestamp(F.concat_ws(" ", day, F.lit(c))), "Europe/London")) * 1000
    return {"after_open": F.col("_open"), **{k: at(c) for k, c in clocks.items()}}


def entry_assessment(events: DataFrame, quotes: DataFrame, trades: DataFrame, by: list[str], at: str, seq: str, primary: float = 500.0, **options) -> DataFrame:
    """A row for each event: what of its entry was displayed, confirmed and actionable, why it is excluded, and all windows and levels.

    events has the key, open_ns, cross_ns, threshold, session_open, adjusted_threshold and
    quality_flags; quotes and trades the key and at (ns). An event that opened at its
    adjusted threshold, or crossed no later than the open, is never feasible. window_metrics
    holds the 16 rows of windows and levels of an event (empty without quotes); options go to
    ``entry_feasibility``.
    """
    known = events.select(*by, "open_ns", "cross_ns", "threshold")
    q = quotes.join(known, by)
    cells = entry_feasibility(q, trades, by, at, seq, "open_ns", "cross_ns", "threshold", windows=london_windows(), **options)
    rest = [c for c in cells.columns if c not in by]
    mine = (F.col("window") == "after_open") & (F.col("level") == float(primary))
    cells = cells.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct(*rest))).alias("window_metrics"), F.max(F.when(mine, F.struct(*rest))).alias("p"))
    inside = (F.col(at) >= F.col("open_ns")) & (F.col(at) < F.col("cross_ns"))
    seen = q.where(inside).groupBy(*by).agg(F.count("*").alias("regular_quote_count"))
    spans = entry_intervals(q, by, at, seq, "open_ns", "cross_ns", "threshold", min(options.get("levels", NOTIONAL_LEVELS))).withColumn("_froms", F.array("_open"))
    counts = spans.groupBy(*by).agg(F.count("*").alias("interval_count"))
    traded = confirming(trades, spans, by, at, seq).groupBy(*by).agg(F.count("*").alias("regular_trade_count"))
    x = events
    for part in (cells, seen, counts, traded):
        x = x.join(part, by, "left")
    x = x.na.fill(0, ["regular_quote_count", "interval_count", "regular_trade_count"])
    shown, bought, acted = (F.coalesce(f"p.{c}", F.lit(False)) for c in ("displayed", "mechanically_purchasable", "manually_actionable"))
    gapped = F.coalesce(F.col("session_open") >= F.col("adjusted_threshold"), F.lit(False))
    early = F.col("cross_ns") <= F.col("open_ns")
    # Names of the flags and of the reasons for an exclusion.
    flag = lambda when, name: F.when(when, F.lit(name))
    ladder = F.when(~shown, "no_subthreshold_ask_at_primary_notional").when(~bought, "subthreshold_ask_not_trade_confirmed").when(~acted, "entry_opportunity_below_manual_duration_or_edge_gate")
    flags = F.array(flag(gapped, "opened_at_or_above_adjusted_threshold"), flag(early, "threshold_reached_at_or_before_regular_open"), flag(F.col("regular_quote_count") == 0, "no_regular_session_quotes_before_threshold"), ladder)
    actionable = acted & ~gapped & ~early
    reason = F.when(actionable, F.lit(None).cast("string")).when(gapped, "opened_at_or_above_threshold").when(early, "threshold_at_or_before_open").when(~shown, "no_displayed_subthreshold_ask_at_primary_notional").when(~bought, "no_confirmed_purchase_at_primary_notional").otherwise("manual_duration_or_edge_gate_not_met")
    return x.select(
        *by, "open_ns", "cross_ns", F.col("threshold").alias("raw_threshold_price"), ((F.col("cross_ns") - F.col("open_ns")) / 1e9).alias("seconds_open_to_threshold"), (bought & ~gapped & ~early).alias("purchase_feasible"), actionable.alias("primary_actionable"),
        F.col("p.first_actionable_at").alias("first_entry_at"), F.col("p.first_actionable_ask").alias("first_entry_ask"), F.when(F.col("p.first_actionable_ask").isNotNull(), float(primary)).alias("first_entry_notional"), F.col("p.first_actionable_edge_pct").alias("first_entry_gross_edge_pct"), F.col("p.first_actionable_segment_seconds").alias("opportunity_seconds"), F.col("p.seconds_from_first_confirmed_to_threshold").alias("seconds_entry_to_threshold"),
        "interval_count", "regular_quote_count", "regular_trade_count", F.array_sort(F.array_distinct(F.array_compact(F.concat(F.coalesce("quality_flags", F.array().cast("array<string>")), flags)))).alias("quality_flags"), reason.alias("exclusion_reason"), "window_metrics",
    )


def simulate_scenarios(quotes: DataFrame, by: list[str], at: str, seq: str, entry_from: str, close: str, prior_close: str, notional: float = 500.0, stop_pct: float = 5.0, slips_bps: tuple[float, ...] = (0.0, 10.0), fractionable: bool | str = True, stale: float = 60.0, rise: float = 1.25) -> DataFrame:
    """by, slip_bps and the outcome of an order under each friction scenario.

    quotes has bid_price, bid_size_shares, ask_price, ask_size_shares, at in seconds (any
    fraction) and the key's entry boundary, close boundary and prior close. The order
    enters at the first valid quote from the boundary on whose ask lies below the target
    and is deep enough; the entering quote may exit. It leaves at the first bid at the
    target or at or below the stop that is deep enough for all its shares; else at the
    close, if the last deep enough bid is fresh. fractionable may name a column; whole
    shares are bought where it is false.
    """
    valid = (F.col("bid_price") > 0) & (F.col("ask_price") > 0) & (F.col("ask_price") >= F.col("bid_price"))
    x = quotes.where(valid & (F.col(at) <= F.col(close)) & (F.col(at) >= F.col(entry_from)))
    x = x.withColumn("slip_bps", F.explode(F.array(*(F.lit(float(s)) for s in sorted(set(slips_bps))))))
    keys, slip, target = [*by, "slip_bps"], F.col("slip_bps") / 10_000, F.col(prior_close) * rise
    fill = F.col("ask_price") * (1 + slip)
    part = F.col(fractionable) if isinstance(fractionable, str) else F.lit(fractionable)
    shares = F.when(part, F.lit(notional) / fill).otherwise(F.floor(F.lit(notional) / fill).cast("double"))
    depth = F.col("ask_price") * F.col("ask_size_shares") + 1e-9
    can = (F.col("ask_price") < target) & (depth >= notional) & (shares > 0) & (depth >= shares * F.col("ask_price"))
    key = F.struct(at, seq)
    w = W.partitionBy(*keys)
    x = x.withColumn("_in", F.min_by(F.struct(key.alias("k"), F.col("ask_price").alias("ask"), fill.alias("price"), shares.alias("shares")), F.when(can, key)).over(w))
    x = x.where(F.col("_in").isNotNull() & (key >= F.col("_in.k")))
    stop = F.col("_in.price") * (1 - stop_pct / 100)
    x = x.withColumns({"_won": F.col("bid_price") >= target, "_lost": F.col("bid_price") <= stop, "_deep": F.col("bid_size_shares") + 1e-9 >= F.col("_in.shares")})
    x = x.withColumn("_out", F.min_by(F.struct(key.alias("k"), F.col("bid_price").alias("bid"), F.when(F.col("_won"), "target").otherwise("stop").alias("why")), F.when((F.col("_won") | F.col("_lost")) & F.col("_deep"), key)).over(w))
    x = x.where(F.col("_out").isNull() | (key <= F.col("_out.k")))
    gap = F.col(at) - F.lag(at).over(w.orderBy(at, seq))
    x = x.withColumn("_gap", gap)
    y = x.groupBy(*keys).agg(
        F.first("_in").alias("i"), F.first("_out").alias("o"), F.max_by(F.struct(F.col(at).alias("at"), F.col("bid_price").alias("bid")), F.when(F.col("_deep"), key)).alias("l"), F.max("bid_price").alias("max_bid_after_entry"), F.min("bid_price").alias("min_bid_after_entry"), F.coalesce(F.max("_gap").cast("double"), F.lit(0.0)).alias("max_quote_gap_seconds"),
        F.max((F.col("_won") | F.col("_lost")) & ~F.col("_deep")).alias("_short"), F.max(target).alias("target_price"), F.max(close).alias("_close"),
    )
    y = quotes.select(*by).distinct().withColumn("slip_bps", F.explode(F.array(*(F.lit(float(s)) for s in sorted(set(slips_bps)))))).join(y, keys, "left")
    fresh = F.col("l").isNotNull() & (F.col("_close") - F.col("l.at") <= stale)
    exit_at = F.when(F.col("o").isNotNull(), F.col(f"o.k.{at}")).when(fresh, F.col("l.at"))
    exit_bid = F.when(F.col("o").isNotNull(), F.col("o.bid")).when(fresh, F.col("l.bid"))
    filled = F.col("i").isNotNull()
    price = exit_bid * (1 - slip)
    return y.select(
        *keys, filled.alias("filled"), F.when(~filled, "no_executable_subthreshold_ask").when(exit_bid.isNull(), "no_executable_close_exit").alias("reason"), F.col(f"i.k.{at}").alias("entry_at"), F.col("i.ask").alias("entry_ask"), F.col("i.price").alias("entry_price"), F.col("i.shares").alias("shares"), (F.col("i.shares") * F.col("i.price")).alias("invested_notional"), F.when(filled, F.col("target_price")).alias("target_price"), (F.col("i.price") * (1 - stop_pct / 100)).alias("stop_price"),
        exit_at.alias("exit_at"), exit_bid.alias("exit_bid"), price.alias("exit_price"), F.when(F.col("o").isNotNull(), F.col("o.why")).when(fresh, "time").alias("exit_reason"), ((price / F.col("i.price") - 1) * 100).alias("return_pct"), (F.col("i.shares") * (price - F.col("i.price"))).alias("pnl_usd"), "max_bid_after_entry", "min_bid_after_entry", "max_quote_gap_seconds", F.coalesce(F.col("_short") | (filled & F.col("l").isNull()), F.lit(False)).alias("capacity_shortfall"),
    )


def minute_summary(bars: DataFrame, by: list[str], at: str) -> DataFrame:
    """by and the shape of its minute bars: counts, first open, last close, extremes, return, volatility, and bars and volume by session.

    Bars have open, high, low, close, volume, trade_count and session; prices that aren't
    positive don't count.
    """
    good = lambda c: F.when(F.col(c) > 0, F.col(c))
    w = W.partitionBy(*by).orderBy(at).rowsBetween(W.unboundedPreceding, -1)
    x = bars.withColumn("_r", F.log(good("close") / F.last(good("close"), ignorenulls=True).over(w)))
    label = F.coalesce("session", F.lit("unknown"))
    each = bars.groupBy(*by, label.alias("_s")).agg(F.count("*").alias("n"), F.sum("volume").alias("v")).groupBy(*by)
    maps = each.agg(*(F.map_from_entries(F.sort_array(F.collect_list(F.struct("_s", c)))).alias(n) for c, n in (("n", "session_bar_counts"), ("v", "session_volume"))))
    out = x.groupBy(*by).agg(
        F.count("*").alias("bar_count"), F.min(at).alias("first_at"), F.max(at).alias("last_at"), F.min_by("open", F.when(F.col("open") > 0, F.col(at))).alias("first_open"), F.max_by("close", F.when(F.col("close") > 0, F.col(at))).alias("last_close"), F.max(good("high")).alias("high"), F.min(good("low")).alias("low"),
        F.when(F.count("_r") >= 2, F.stddev_samp("_r")).otherwise(0.0).alias("realized_vol"), F.coalesce(F.max(F.abs("_r")), F.lit(0.0)).alias("max_abs_one_min_log_return"), F.sum("volume").alias("volume"), F.sum("trade_count").alias("trade_count"),
    )
    return out.withColumn("return_pct", (F.try_divide(F.col("last_close"), F.col("first_open")) - 1) * 100).join(maps, by)


def microstructure(seconds: DataFrame, by: list[str]) -> DataFrame:
    """by and the shape of its second rows (as ``second_summary`` makes them): active seconds, totals, busiest second, spreads and depth."""
    spread = F.when(F.col("min_spread") >= 0, F.col("min_spread"))
    n = lambda c: F.count(F.when(F.col(c) > 0, 1))
    return seconds.groupBy(*by).agg(
        F.count("*").alias("active_seconds"), n("trade_count").alias("trade_seconds"), n("quote_updates").alias("quote_seconds"), *(F.sum(c).alias(c) for c in ("trade_count", "trade_volume", "quote_updates")), F.max("trade_count").alias("max_trades_per_second"), F.max("trade_volume").alias("max_volume_per_second"),
        F.median(spread).alias("median_spread"), F.percentile(spread, 0.9).alias("p90_spread"), F.median("bid_size_shares").alias("median_bid_depth_shares"), F.median("ask_size_shares").alias("median_ask_depth_shares"),
    )
