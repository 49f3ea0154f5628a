"""The execution backtest and the entry assessment on small tapes whose results are plain."""

import datetime as dt

from pyspark.sql import functions as F

import pytest

from tidemark.operators import backtest, tape
from tidemark.sources.shared import Scratch

D = dt.date


@pytest.fixture
def cut(spark):
    with Scratch(spark, "test") as s:
        yield s.cut


def us(day: dt.date, clock: str) -> int:
    """Epoch microseconds of a UTC clock time."""
    h, m, s = clock.split(":")
    at = dt.datetime(day.year, day.month, day.day, int(h), int(m), tzinfo=dt.UTC)
    return int(at.timestamp()) * 1_000_000 + round(float(s) * 1e6)


def frames(spark, daily, trades=(), quotes=(), assets=None):
    assets = assets or sorted({(r[0], True, True, "active") for r in daily})
    t = spark.createDataFrame([(s, d, us(d, c), i, float(p), n) for i, (s, d, c, p, n) in enumerate(trades)], "symbol string, trade_date date, at long, seq long, price double, size long")
    q = spark.createDataFrame([(s, d, us(d, c), i, float(b), bs, float(a), asz) for i, (s, d, c, b, bs, a, asz) in enumerate(quotes)], "symbol string, trade_date date, at long, seq long, bid_price double, bid_size_shares long, ask_price double, ask_size_shares long")
    bars = t.groupBy("symbol", "trade_date", (F.expr("at div 60000000") * 60_000_000).alias("at")).agg(F.max_by("price", F.struct(t["at"], "seq")).alias("close"), F.sum("size").alias("volume"))
    d = spark.createDataFrame(daily, "symbol string, trade_date date, open double, high double, close double, raw_open double, raw_close double")
    a = spark.createDataFrame(assets, "symbol string, fractionable boolean, tradable boolean, status string")
    return {"daily": d, "bars": bars, "trades": t, "quotes": q, "calendar": backtest.sessions(d, "trade_date"), "assets": a}


def test_sessions_follow_both_zones(spark):
    days = spark.createDataFrame([(D(2026, 1, 5),), (D(2026, 3, 10),), (D(2026, 6, 1),), (D(2026, 6, 1),)], "day date")
    got = {r.trade_date: r for r in backtest.sessions(days).collect()}
    winter, gap, summer = got[D(2026, 1, 5)], got[D(2026, 3, 10)], got[D(2026, 6, 1)]
    assert winter.open_at == us(D(2026, 1, 5), "14:30:0") and winter.preopen_at == us(D(2026, 1, 5), "14:0:0")
    # in March New York is ahead of London's change: the decision comes after the open, orders wait for the decision
    assert gap.open_at == us(D(2026, 3, 10), "13:30:0") and gap.preopen_enter == gap.preopen_at + 5_000_000
    assert summer.midday_at == us(D(2026, 6, 1), "16:0:0") and summer.exit_by == us(D(2026, 6, 1), "19:55:0")
    assert summer.preopen_enter == summer.open_at + 5_000_000 and len(got) == 3


def test_universe_takes_the_last_day_with_data(spark):
    a, b, c, late = D(2026, 1, 5), D(2026, 1, 8), D(2026, 1, 9), D(2026, 1, 25)
    bar = lambda s, d, close, scale=1.0: (s, d, 10.0, 12.0, close, 10.0 / scale if scale else 0.0, close / scale if scale else 0.0)
    m = frames(spark, [bar("A", a, 9.0), bar("A", b, 11.0), bar("B", a, 5.0), bar("B", c, 6.0), bar("A", c, 7.0), bar("C", b, 3.0), bar("C", c, 4.0, 1.5), bar("D", b, 2.0), bar("D", c, 2.5, 0), bar("X", b, 1.0), bar("X", c, 1.0), bar("A", late, 8.0)], assets=[(s, True, True, "active") for s in "AABCD"])
    got = {(r.symbol, r.trade_date): (r.prior_close, r.eligible) for r in backtest.day_universe(m["daily"], m["calendar"], m["assets"]).collect()}
    # B lacks the 8th, so it has no prior close on the 9th; D has no scale; the 25th is too late; X is not listed
    assert got == {("A", b): (9.0, True), ("A", c): (11.0, True), ("C", c): (3.0, False), ("D", c): (2.0, True)}


def test_triggers_and_trades(spark, cut):
    p, d = D(2026, 1, 5), D(2026, 1, 6)
    bar = lambda s, day, high, close: (s, day, 10.0, high, close, 10.0, close)
    daily = [bar(s, p, 10.0, 10.0) for s in "ABCE"] + [bar(s, d, 12.0, 11.8) for s in "ABC"] + [bar("E", d, 11.0, 11.0)]
    trades = [
        ("A", d, "10:00:0.5", 10.0, 4000), ("A", d, "10:00:0.9", 10.5, 100), ("A", d, "14:00:0.999", 15.0, 100), ("A", d, "14:00:1", 99.0, 5000), ("A", d, "08:59:59", 1.0, 5000),
        ("B", d, "10:00:0", 10.0, 0), ("B", d, "15:00:0", 11.5, 10), ("B", d, "17:00:0.2", 11.6, 10), ("B", d, "17:00:1", 50.0, 10),
        ("C", d, "16:59:59", 11.6, 10), ("E", d, "16:00:0", 20.0, 10),
    ]
    quotes = [
        ("A", d, "10:00:0.1", 9.9, 10, 10.0, 10), ("A", d, "10:00:0.2", 9.0, 10, 11.0, 10), ("A", d, "10:00:0.3", 10.0, 10, 10.4, 10), ("A", d, "10:00:7", 10.0, 10, 9.0, 10), ("A", d, "10:00:8", 10.0, 10, 10.1, 10),
        ("A", d, "14:30:4", 10.0, 900, 10.1, 900), ("A", d, "14:30:5", 10.0, 900, 10.1, 9), ("A", d, "14:30:6", 10.0, 900, 10.1, 900), ("A", d, "15:0:0", 12.6, 3, 12.7, 900), ("A", d, "15:10:0", 12.5, 900, 12.7, 900),
        ("B", d, "17:00:5", 11.5, 900, 12.0, 900), ("B", d, "17:30:0", 11.6, 900, 12.7, 900), ("B", d, "20:54:30", 11.8, 900, 12.0, 900), ("B", d, "20:56:0", 1.0, 900, 12.0, 900),
    ]
    m = frames(spark, daily, trades, quotes, [("A", True, True, "active"), ("B", False, None, "inactive"), ("C", True, True, "active"), ("E", True, True, "active")])
    x = backtest.backtest(*(m[k] for k in ("daily", "bars", "trades", "quotes", "calendar", "assets")), reps=50, write=cut)
    got = {(r.strategy, r.symbol): r for r in x.triggers.collect()}
    assert set(got) == {("preopen", "A"), ("midday", "B"), ("midday", "C")}
    f = got["preopen", "A"].features
    # the second's least spread is 0.1 of 10.0 and 9.9, over the middle of its last quote
    assert f.trade_volume == 4200 and f.trade_seconds == 2 and f.quote_count == 4 and f.quote_seconds == 2
    assert abs(f.median_spread_bps - (0.1 / 10.2 + 0.1 / 10.05) / 2 * 1e4) < 1e-9
    # B's price is the last trade of the decision's second, C's the last bar's close; equal signals are ordered by symbol
    assert [(got["midday", s].rank, round(got["midday", s].signal_value, 9)) for s in "BC"] == [(1, 16.0), (2, 16.0)]
    t = {r.symbol: r for r in x.trades.collect()}
    a, b, c = t["A"], t["B"], t["C"]
    # the first quotes come too early or lie too thin; the first bid at the target is too small
    assert a.entry_at == us(d, "14:30:6") / 1e6 and a.exit_reason == "target" and a.exit_at == us(d, "15:10:0") / 1e6 and a.capacity_shortfall
    assert abs(a.pnl_usd - 500 / (10.1 * 1.0005) * (12.5 * 0.9995 - 10.1 * 1.0005)) < 1e-9 and a.pnl_0bps > a.pnl_usd > a.pnl_10bps
    assert b.shares == 41 and b.exit_reason == "time" and b.exit_bid == 11.8 and b.quality_flags == ["point_in_time_tradability_unverified", "inactive_current_asset"]
    assert not c.filled and c.unfilled_reason == "no_executable_subthreshold_ask" and c.pnl_usd is None
    days = {r.trade_date: r for r in x.days.collect()}
    assert (days[p].status, days[p].reason) == ("skipped", "no_prior_session")
    assert (days[d].eligible_symbol_count, days[d].preopen_trigger_count, days[d].midday_trigger_count, days[d].selected_trade_count, days[d].filled_trade_count) == (4, 1, 2, 3, 2)
    s = {r.strategy: r for r in x.summary.collect()}
    assert (s["midday"].trigger_count, s["midday"].entry_fill_count, s["midday"].fill_rate) == (2, 1, 0.5) and s["preopen"].target_count == 1 and not s["preopen"].window_gate_passed


def test_decision_after_the_open_has_no_preopen_triggers(spark, cut):
    p, d = D(2026, 3, 9), D(2026, 3, 10)
    daily = [("A", x, 10.0, 10.0, 10.0, 10.0, 10.0) for x in (p, d)]
    m = frames(spark, daily, [("A", d, "10:00:0", 10.0, 5000), ("A", d, "10:00:5", 20.0, 5000)], [("A", d, "10:00:0", 10.0, 9, 10.01, 9)])
    x = backtest.backtest(*(m[k] for k in ("daily", "bars", "trades", "quotes", "calendar", "assets")), reps=10, write=cut)
    assert x.triggers.where("strategy = 'preopen'").count() == 0 and x.days.where("preopen_skipped_not_before_open").count() == 2


def test_empty_tape(spark, cut):
    m = frames(spark, [("A", D(2026, 1, 5), 1.0, 1.0, 1.0, None, None)])
    none = {k: v.where("false") for k, v in m.items()}
    x = backtest.backtest(*(none[k] for k in ("daily", "bars", "trades", "quotes", "calendar", "assets")), reps=10, write=cut)
    assert [f.count() for f in x] == [0, 0, 0, 0]


def assess(spark, events, quotes, trades, **options):
    """Assessments of events (key, open, cross, threshold, session open, flags), times as UTC clocks of one day."""
    d = D(2026, 4, 20)
    at = lambda c: us(d, c) * 1000
    e = spark.createDataFrame([(k, at(o), at(c), float(t), so, float(t), f) for k, o, c, t, so, f in events], "k string, open_ns long, cross_ns long, threshold double, session_open double, adjusted_threshold double, quality_flags array<string>")
    q = spark.createDataFrame([(k, at(c), i, float(b), float(a), n) for i, (k, c, b, a, n) in enumerate(quotes)], "k string, at long, seq long, bid_price double, ask_price double, ask_size_shares long")
    t = spark.createDataFrame([(k, at(c), i, float(p)) for i, (k, c, p) in enumerate(trades)], "k string, at long, seq long, price double")
    return {r.k: r for r in tape.entry_assessment(e, q, t, ["k"], "at", "seq", **options).collect()}


def test_entry_assessment_of_each_outcome(spark):
    o = "13:30:0"
    events = [("good", o, "13:31:0", 15, 10.0, None), ("gap", o, "13:31:0", 15, 15.0, ["old", "old"]), ("early", o, "13:29:0", 15, None, None), ("none", o, "13:31:0", 15, 10.0, None), ("dear", o, "13:31:0", 15, 10.0, None), ("bare", o, "13:31:0", 15, 10.0, None), ("brief", o, "13:30:20", 15, 10.0, None)]
    q = lambda k: [(k, "13:30:5", 9.9, 10.0, 100), (k, "13:30:40", 10.4, 10.5, 100)]
    quotes = [*q("good"), *q("gap"), *q("bare"), *q("brief"), ("early", "13:28:0", 9.9, 10.0, 100), ("dear", "13:30:5", 15.0, 15.0, 100)]
    trades = [(k, "13:30:10", 10.0) for k in ("good", "gap", "brief", "none", "dear", "early")] + [("bare", "13:30:10", 9.99), ("bare", "13:30:5", 12.0)]
    got = assess(spark, events, quotes, trades)
    good = got["good"]
    assert good.purchase_feasible and good.primary_actionable and good.exclusion_reason is None and good.quality_flags == []
    assert (good.opportunity_seconds, good.first_entry_ask, good.first_entry_notional, good.seconds_entry_to_threshold, good.seconds_open_to_threshold) == (55.0, 10.0, 500.0, 50.0, 60.0)
    assert (good.interval_count, good.regular_quote_count, good.regular_trade_count) == (2, 2, 1) and len(good.window_metrics) == 16
    assert {k: r.exclusion_reason for k, r in got.items()} == {"good": None, "gap": "opened_at_or_above_threshold", "early": "threshold_at_or_before_open", "none": "no_displayed_subthreshold_ask_at_primary_notional", "dear": "no_displayed_subthreshold_ask_at_primary_notional", "bare": "no_confirmed_purchase_at_primary_notional", "brief": "manual_duration_or_edge_gate_not_met"}
    assert got["gap"].quality_flags == ["old", "opened_at_or_above_adjusted_threshold"] and not got["gap"].purchase_feasible and got["brief"].purchase_feasible
    assert "no_regular_session_quotes_before_threshold" in got["none"].quality_flags and got["none"].window_metrics is None
    # bare: 13:30:10 is below the ask, 13:30:5 is at the interval's start and not after it
    assert got["bare"].regular_trade_count == 1


def test_entry_windows_start_at_the_london_clocks(spark):
    events = [("a", "13:30:0", "19:0:0", 15, 10.0, None)]
    quotes = [("a", "13:30:5", 9.9, 10.0, 100)]
    trades = [("a", c, 10.0) for c in ("13:31:0", "16:0:4", "16:0:5", "18:30:0")]
    m = {r.window: r for r in assess(spark, events, quotes, trades)["a"].window_metrics if r.level == 500.0}
    d = D(2026, 4, 20)
    # 14, 17 and 19 o'clock in London are 13, 16 and 18 UTC in April; the first lies before the open
    assert {w: r.first_confirmed_at // 1000 for w, r in m.items()} == {"after_open": us(d, "13:31:0"), "preopen_1400_bst": us(d, "13:31:0"), "midday_1700_bst": us(d, "16:0:5"), "afternoon_1900_bst": us(d, "18:30:0")}
    assert m["afternoon_1900_bst"].total_displayed_seconds == 3595.0
