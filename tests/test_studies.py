"""Entry, execution, matching and context operators against loops in plain Python."""

import hashlib
import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from tidemark.operators import context, evaluate, matching, tape
from tidemark.plans import routes

NS = 1_000_000_000


def entry(spark, quotes, trades, **options):
    q = spark.createDataFrame([("A", int(t * NS), i, b, a, n) for i, (t, b, a, n) in enumerate(quotes)], "symbol string, at long, seq long, bid_price double, ask_price double, ask_size_shares long")
    q = q.withColumns({"o": F.lit(0).cast("long"), "c": F.lit(100 * NS).cast("long"), "thr": F.lit(12.5)})
    t = spark.createDataFrame([("A", int(t * NS), i, p) for i, (t, p) in enumerate(trades)], "symbol string, at long, seq long, price double")
    return {r.level: r for r in tape.entry_feasibility(q, t, ["symbol"], "at", "seq", "o", "c", "thr", **options).collect()}


def test_entry_opportunity_of_one_standing_ask(spark):
    # an ask from second 10 on is usable from the reaction delay's end or its own start until the crossing
    got = entry(spark, [(10, 9.9, 10.0, 200)], [(20, 10.0), (30, 10.5)])
    assert got[500.0].manually_actionable and got[500.0].total_displayed_seconds == 90 and got[500.0].first_actionable_at == 20 * NS
    assert got[1000.0].displayed and got[5000.0].displayed is False and got[5000.0].total_displayed_seconds == 0
    assert got[500.0].first_confirmed_edge_pct == pytest.approx(25)


def test_entry_needs_a_strictly_later_trade_and_time(spark):
    at_start = entry(spark, [(10, 9.9, 10.0, 200)], [(10, 10.0)])
    assert at_start[500.0].displayed and not at_start[500.0].mechanically_purchasable
    early = entry(spark, [(1, 9.9, 10.0, 200)], [(3, 10.0)])
    assert not early[500.0].mechanically_purchasable
    short = entry(spark, [(10, 9.9, 10.0, 200), (30, 9.9, 13.0, 200)], [(20, 10.0)])
    assert short[500.0].mechanically_purchasable and not short[500.0].manually_actionable
    cheap = entry(spark, [(10, 9.9, 10.0, 200)], [(20, 9.0)])
    assert not cheap[500.0].mechanically_purchasable
    free = entry(spark, [(10, 9.9, 10.0, 200)], [], need_trade=False)
    assert free[500.0].manually_actionable and free[500.0].first_actionable_at == 10 * NS


def test_entry_segments_break_on_thin_asks(spark):
    got = entry(spark, [(10, 9.9, 10.0, 200), (40, 9.9, 10.0, 20), (50, 9.9, 10.0, 200)], [(60, 11.0)])
    assert (got[500.0].total_displayed_seconds, got[500.0].max_contiguous_displayed_seconds) == (80, 50)
    assert got[100.0].max_contiguous_displayed_seconds == 90 and got[500.0].first_actionable_segment_seconds == 50


def plain_simulation(quotes, slip, target, notional=500.0, stop_pct=5.0, start=0, close=100, stale=60):
    state, chosen, last, short = None, None, None, False
    for t, _, bid, bs, ask, asz in sorted(quotes):
        if bid <= 0 or ask < bid or t > close or chosen:
            continue
        if state is None:
            fill = ask * (1 + slip / 1e4)
            shares = notional / fill
            if t < start or ask >= target or ask * asz + 1e-9 < notional or ask * asz + 1e-9 < shares * ask:
                continue
            state = (t, fill, shares, fill * (1 - stop_pct / 100))
        enough = bs + 1e-9 >= state[2]
        if enough:
            last = (t, bid)
        if bid >= target or bid <= state[3]:
            if enough:
                chosen = (t, bid, "target" if bid >= target else "stop")
            else:
                short = True
    if state is None:
        return (False, None, None)
    if chosen is None and last and close - last[0] <= stale:
        chosen = (*last, "time")
    return (True, chosen and chosen[2], chosen and round(state[2] * (chosen[1] * (1 - slip / 1e4) - state[1]), 6))


def test_scenarios_equal_a_loop(spark):
    rnd = random.Random(9)
    rows = []
    for k in range(60):
        p = 40 + rnd.random() * 5
        for t in sorted(rnd.sample(range(120), rnd.randint(1, 25))):
            p *= 1 + rnd.gauss(0.01, 0.04)
            rows.append((k, t, len(rows), round(p - rnd.random() * 0.4 + 0.1, 3), rnd.choice([1, 20, 400]), round(p, 3), rnd.choice([1, 30, 400])))
    q = spark.createDataFrame(rows, "k long, t long, seq long, bid_price double, bid_size_shares long, ask_price double, ask_size_shares long").withColumns({"a": F.lit(10), "z": F.lit(100), "prior": F.lit(40.0)})
    got = {(r.k, r.slip_bps): (r.filled, r.exit_reason, None if r.pnl_usd is None else round(r.pnl_usd, 6)) for r in tape.simulate_scenarios(q, ["k"], "t", "seq", "a", "z", "prior").collect()}
    for k in range(60):
        for slip in (0.0, 10.0):
            want = plain_simulation([r[1:] for r in rows if r[0] == k], slip, 50.0, start=10)
            assert got[k, slip][:2] == want[:2], (k, slip)
            assert got[k, slip][2] == pytest.approx(want[2], abs=1e-5) if want[2] is not None else got[k, slip][2] is None


def cohort(n_days=3, per_day=14, seed=4):
    rnd = random.Random(seed)
    rows = []
    for d in range(n_days):
        for s in range(per_day):
            price, dollars, vol = math.exp(rnd.gauss(2, 0.5)), math.exp(rnd.gauss(12, 0.8)), abs(rnd.gauss(0.04, 0.01)) + 0.01
            rows.append(dict(id=100 * d + s, symbol=f"S{s}", exchange=rnd.choice("NQ"), event_date=f"2026-01-0{d + 1}", prior_close=price, median_dollar_volume_10=dollars, realized_vol_10=vol, atr_pct_10=vol * rnd.uniform(0.8, 1.2), prior_day_return=rnd.gauss(0, 0.03), momentum_10=rnd.gauss(0, 0.1), log_prior_close=math.log(price), log_median_dollar_volume_10=math.log(dollars), log_listing_sessions=math.log(rnd.randint(50, 500)), corporate_action_45d=rnd.random() < 0.2, no_threshold_hit=rnd.random() < 0.9, is_event=s < 3))
            rows[-1]["price_band"] = next(b for b, e in zip(["lt_0_5", "0_5_1", "1_2", "2_5", "5_10", "10_20", "20_50", "gte_50"], [0.5, 1, 2, 5, 10, 20, 50, 1e18], strict=True) if price < e)
    return rows


def plain_match(rows, cfg):
    uses, picks, few = {}, [], {}
    bands = ["lt_0_5", "0_5_1", "1_2", "2_5", "5_10", "10_20", "20_50", "gte_50"]
    for day in sorted({r["event_date"] for r in rows}):
        events = [r for r in rows if r["event_date"] == day and r["is_event"]]
        pool = [r for r in rows if r["event_date"] == day and not r["is_event"] and r["no_threshold_hit"]]
        centre = {f: statistics.median(r[f] for r in pool) for f in matching.FEATURES}
        scale = {f: max(1.4826 * statistics.median(abs(r[f] - centre[f]) for r in pool), 1e-6) for f in matching.FEATURES}
        used = set()
        far = lambda e: sum(abs((e[f] - centre[f]) / scale[f]) for f in matching.FEATURES)  # noqa: B023, E731
        for e in sorted(events, key=lambda e: (-far(e), e["id"])):
            good = []
            for c in pool:
                if c["symbol"] in {x["symbol"] for x in events}:
                    continue
                d = {f: (c[f] - e[f]) / scale[f] for f in matching.FEATURES}
                action = c["corporate_action_45d"] != e["corporate_action_45d"]
                score = math.sqrt(sum(w * d[f] ** 2 for f, (w, _) in matching.FEATURES.items()) + cfg.exchange_penalty * (c["exchange"] != e["exchange"]) + cfg.action_penalty * action)
                ratio = lambda f, lim: lim[0] <= c[f] / e[f] <= lim[1]  # noqa: B023, E731
                ok = ratio("prior_close", cfg.price_ratio) and ratio("median_dollar_volume_10", cfg.dollar_volume_ratio) and ratio("realized_vol_10", cfg.volatility_ratio) and abs(bands.index(c["price_band"]) - bands.index(e["price_band"])) <= cfg.band_distance and not action
                ok = ok and all(abs(d[f]) <= most for f, (_, most) in matching.FEATURES.items()) and score <= cfg.most_score
                if ok:
                    good.append((score, hashlib.sha256(f"{e['id']}|{c['symbol']}".encode()).hexdigest(), c))
            n = 0
            for score, _, c in sorted(good, key=lambda x: x[:2]):
                if n < cfg.controls and c["id"] not in used and uses.get(c["symbol"], 0) < cfg.symbol_uses:
                    n += 1
                    used.add(c["id"])
                    uses[c["symbol"]] = uses.get(c["symbol"], 0) + 1
                    picks.append((e["id"], c["id"], n, round(score, 9)))
            if n < cfg.controls:
                few[e["id"]] = (n, len(good))
    return picks, few


def test_balanced_match_equals_a_loop(spark):
    rows = cohort()
    df = spark.createDataFrame(rows)
    for cfg in (matching.BalanceConfig(), matching.BalanceConfig(controls=2, symbol_uses=2, most_score=6.0, price_ratio=(0.2, 5.0), band_distance=3)):
        picks, few = matching.balanced_match(df.where("is_event").drop("is_event", "no_threshold_hit"), df.where("not is_event").drop("is_event"), cfg)
        want, short = plain_match(rows, cfg)
        assert sorted((r.event, r.control, r["rank"], round(r.score, 9)) for r in picks.collect()) == sorted(want)
        got = few.collect()
        assert {r.event: (r.selected, r.accepted) for r in got} == short
        report = matching.balance_report(df.where("is_event").drop("is_event", "no_threshold_hit"), df.where("not is_event").drop("is_event"), cfg).first()
        assert report.matched_pair_count == len(want) and report.positive_events_with_shortfall == len(short)
        assert report.gate_status == ("passed" if want else "failed") and all(report[f"max_abs_z_{f}"] <= most + 1e-9 for f, (_, most) in matching.FEATURES.items())
        assert not want or report.maximum_match_score == pytest.approx(max(p[3] for p in want))
        assert all((r.reason == "no_strong_control") == (r.selected == 0) for r in got) and all(len(r.nearest or []) <= 5 for r in got)


def test_greedy_within_equals_a_loop(spark):
    rnd = random.Random(3)
    rows = [(k, e, e % 5, c, c % 6, rnd.randint(0, 2), rnd.randint(0, 1), rnd.randint(0, 9), f"{rnd.random():.9f}") for k in (1, 2) for e in range(6) for c in rnd.sample(range(20), 12)]
    cols = "k long, event long, event_order long, control long, day long, tier_rank int, weekday_rank int, distance long, tie string"
    got = {tuple(r) for r in matching.greedy_within(spark.createDataFrame(rows, cols), "k", 3).collect()}
    want = set()
    for k in (1, 2):
        uses = {}
        for _, e in sorted({(r[2], r[1]) for r in rows if r[0] == k}):
            days, picked = set(), []
            for r in sorted((r for r in rows if r[:2] == (k, e)), key=lambda r: (uses.get(r[3], 0) > 0, uses.get(r[3], 0), *r[5:])):
                if len(days) < 3 and r[4] not in days:
                    days.add(r[4])
                    picked.append((k, e, r[3], len(days), uses.get(r[3], 0)))
            for p in picked:
                uses[p[2]] = uses.get(p[2], 0) + 1
            want |= set(picked)
    assert got == want


def test_window_metrics_equal_a_loop(spark):
    rnd = random.Random(12)
    steps = sorted(rnd.sample(range(1500), 1300))
    rows = []
    for m in steps:
        c = 50 + 10 * math.sin(m / 90) + rnd.random()
        rows.append(("A", m, c, c + rnd.random(), c - rnd.random(), c + rnd.gauss(0, 0.2), rnd.random() * 100, rnd.randint(0, 9), rnd.random() * 50))
    bars = spark.createDataFrame(rows, "k string, m long, open double, high double, low double, close double, quote_volume double, trade_count long, taker_quote double")
    ends = [m for m in steps if m > 1200][:4]
    samples = spark.createDataFrame([(i, "A", m) for i, m in enumerate([*ends, 5000])], "sample_id long, k string, m long")
    windows = [1, 15, 240, 1300]
    got = {(r.sample_id, r.window): r for r in context.window_metrics(samples, bars, "k", "m", windows).collect()}
    assert len(got) == 4 * len(ends)
    by = {r[1]: r for r in rows}
    for i, end in enumerate(ends):
        for w in windows:
            seg = [by[m] for m in range(end - w + 1, end + 1) if m in by]
            r, closes = got[i, w], [x[5] for x in seg]
            assert r.observed_fraction == pytest.approx(len(seg) / w) and r.quote_volume == pytest.approx(sum(x[6] for x in seg))
            high, low = max(x[3] for x in seg), min(x[4] for x in seg)
            assert r.range == pytest.approx((high / low - 1) * 100) and r.since_high == end - max(x[1] for x in seg if x[3] == high)
            old = by.get(end - w)
            assert (r.ret is None) == (old is None) and (old is None or r.ret == pytest.approx((closes[-1] / old[5] - 1) * 100))
            if len(closes) > 1:
                assert r.max_drawdown == pytest.approx(min(c / max(closes[: j + 1]) - 1 for j, c in enumerate(closes)) * 100)
                assert r.max_runup == pytest.approx(max(c / min(closes[: j + 1]) - 1 for j, c in enumerate(closes)) * 100)
                rets = [math.log(b / a) for a, b in zip(closes, closes[1:], strict=False)]
                assert r.positive_return_fraction == pytest.approx(sum(x > 0 for x in rets) / len(rets))
                if len(closes) >= max(5, int(w * 0.8)):
                    assert r.realized_vol == pytest.approx(statistics.stdev(rets) * math.sqrt(w) * 100)
            if len(closes) >= 6:
                stride = math.ceil(len(closes) / 600)
                y = [math.log(c) for c in closes[::stride]]
                x = [j * stride for j in range(len(y))]
                slope, _ = statistics.linear_regression(x, y)
                assert r.trend == pytest.approx(math.expm1(slope * 1440) * 100, rel=1e-6)
                assert r.trend_r2 == pytest.approx(statistics.correlation(x, y) ** 2, abs=1e-9)
            else:
                assert r.trend is None


def test_daily_bound_equals_the_generator(spark):
    rnd = random.Random(1)
    rows = [("a", f"2026-01-{d:02d}", rnd.gauss(5, 20)) for d in range(1, 25)] + [("b", f"2026-01-{d:02d}", 1.0) for d in range(1, 6)]
    df = spark.createDataFrame(rows, "s string, day string, pnl double")
    got = {r.s: r for r in evaluate.daily_lower_bound(df, ["s"], "day", "pnl", 300, {"a": 1701}).collect()}
    values, draw = [r[2] for r in rows if r[0] == "a"], random.Random(1701)
    means = sorted(sum(values[draw.randrange(24)] for _ in range(24)) / 24 for _ in range(300))
    assert got["a"].lower == pytest.approx(means[int(0.025 * 300) - 1]) and got["b"].lower is None and got["b"].days == 5


def test_validation_statuses(spark):
    rows = [(g, int(i == 0), f"S{g % 60}", f"2026-0{1 + g % 6}-{1 + g % 28:02d}", i == 0 or (g + i) % 9 == 0) for g in range(400) for i in range(5)]
    df = spark.createDataFrame(rows, "match_group_id long, label int, symbol string, event_date string, hit boolean")
    r = evaluate.validate_rule(df, F.col("hit"), "R", reps=200, draws=200).first()
    assert r.status == "pass" and r.groups == 400 and r.symbols == 60 and r.eligible_months == 6 and r.p == pytest.approx(1 / 201)
    assert evaluate.validate_rule(df.where("match_group_id < 50"), F.col("hit"), "R", reps=200, draws=200).first().status == "fail"
    with_text = evaluate.concentration(spark.createDataFrame([("b", 1.0), ("a", 1.0), ("c", 0.5)], "symbol string, difference double"), "symbol").first()
    assert with_text.top_key == "a" and with_text.top_share == pytest.approx(0.4)


def test_routes(spark, tmp_path):
    rows = [(i, "s", f"2026-01-{1 + i % 9:02d}", float(i), i % 2 == 0, f"SYM{i}", None if i % 3 else "Acme") for i in range(60)]
    spark.createDataFrame(rows, "id long, scan_id string, event_date string, high_vs_prior_close_pct double, currently_tradable boolean, symbol string, company string").write.parquet(f"{tmp_path}/results.parquet")
    got = routes.read(spark, str(tmp_path), "results", search="acme", minimum_gain=30.0, currently_tradable=True).collect()
    assert [r.id for r in got] == [r[0] for r in sorted((r for r in rows if r[3] >= 30 and r[4] and r[6]), key=lambda r: (r[2], r[3]), reverse=True)]
    with pytest.raises(KeyError):
        routes.read(spark, str(tmp_path), "results", nonsense=1)
    jobs = spark.createDataFrame([("j", "a", "failed"), ("k", "b", "running")], "id string, source_id string, status string")
    sources = spark.createDataFrame([("a", "completed"), ("b", "completed"), ("c", "running")], "id string, status string")
    assert [routes.may_create(jobs, sources, s) for s in "abc"] == [True, False, False]
    assert {r.id: r.status for r in routes.retried(jobs, "j").collect()} == {"j": "queued", "k": "running"}


def plain_controls(events, grid, splits, horizons, prior, before, after, least, controls, liquidity, observed):
    """Picks and rejection counts by loops: anchors day by day, quality step by step, controls event by event."""
    day = lambda sec: sec // 86400
    offsets = (0, -15, 15, -30, 30, -45, 45, -60, 60)
    tiers = [(0, True), (0, False), (15, True), (15, False), (30, None), (60, None)]
    far = max(horizons)
    rejected, candidates = {}, {}
    for symbol, event, sec in events:
        for d, split in splits.items():
            for o in offsets:
                anchor = d * 86400 + sec % 86400 + 60 * o
                if splits.get(day(anchor)) != splits[day(sec)] or any(k == symbol and abs(anchor - at) < 86400 for k, _, at in events):
                    continue
                step, rows = anchor // 3600, grid[symbol]
                at = lambda a, z: [rows.get(i) for i in range(a, z + 1)]  # noqa: B023, E731
                local, history = at(step - max(far, before), step + after), at(step - far - prior, step - far - 1)
                entries = [at(step - h - liquidity, step - h - 1) for h in horizons]
                if local[0] is None or local[-1] is None:
                    reason = "outside_loaded_range"
                elif not all(r and r[0] for r in local):
                    reason = "missing_local_minutes"
                elif any(r[1] for r in local):
                    reason = "near_25pct_crossing"
                elif None in history or sum(r[0] for r in history) / prior < observed:
                    reason = "insufficient_prior_history"
                elif not all(r and r[0] for e in entries for r in e):
                    reason = "missing_entry_liquidity"
                else:
                    reason = "below_entry_liquidity_floor" if min(sum(r[2] for r in e) for e in entries) < least else "pass"
                if reason != "pass":
                    rejected[event, reason] = rejected.get((event, reason), 0) + 1
                    continue
                same = (day(anchor) - day(sec)) % 7 == 0
                apart = abs((anchor - sec + 43200) % 86400 - 43200) // 60
                tier = next(i for i, (most, weekday) in enumerate(tiers) if apart <= most and weekday in (None, same))
                tie = hashlib.sha256(f"{event}|{anchor}".encode()).hexdigest()
                candidates.setdefault((symbol, event, sec), []).append((tier, 0 if same else 1, abs(day(anchor) - day(sec)), tie, step, day(anchor)))
    picks, uses = set(), {}
    for (symbol, event, _), rows in sorted(candidates.items(), key=lambda x: (x[0][2], x[0][1])):
        days, mine = set(), []
        for r in sorted(rows, key=lambda r: (uses.get((symbol, r[4]), 0) > 0, uses.get((symbol, r[4]), 0), *r[:4])):
            if len(days) < controls and r[5] not in days:
                days.add(r[5])
                mine.append((symbol, event, r[4], len(days), uses.get((symbol, r[4]), 0)))
        for m in mine:
            uses[symbol, m[2]] = uses.get((symbol, m[2]), 0) + 1
        picks |= set(mine)
    return picks, rejected


def test_matched_controls_equal_a_loop_for_any_layout(spark):
    from tidemark.operators import cohorts, splits

    rnd = random.Random(11)
    first = 20_000 * 24
    grid = {k: {first + i: (rnd.random() < 0.985, rnd.random() < 0.004, rnd.random() * 100) for i in range(24 * 24)} for k in (1, 2)}
    events = [(k, 10 * k + i, (first + rnd.randrange(30, 24 * 22)) * 3600 + rnd.choice([0, 600, 1800])) for k in (1, 2) for i in range(7)]
    counts = {}
    for *_, sec in events:
        counts[sec // 86400] = counts.get(sec // 86400, 0) + 1
    of = {r.day: r.split for r in splits.chronological(spark.createDataFrame(list(counts.items()), "day long, n long"), "day", "n").collect()}
    want, rejected = plain_controls(events, grid, of, (1, 2), 24, 1, 1, 60.0, 3, 2, 0.9)
    e = spark.createDataFrame(events, "k long, event long, sec long")
    g = spark.createDataFrame([(k, s, *r) for k, rows in grid.items() for s, r in rows.items()], "k long, step long, observed boolean, crossing boolean, quote_volume double")
    for a, b in ((e, g), (e.repartition(5), g.repartition(7, "quote_volume"))):
        picks, refused = cohorts.matched_controls(a, b, "k", "step", (1, 2), 24, 1, 1, 60.0, 3, 3600, 2, 0.9)
        assert {tuple(r) for r in picks.collect()} == want and want
        assert {(r.event, r.reason): r.n for r in refused.collect()} == rejected and len({r for _, r in rejected}) >= 3


def test_baseline_rows_have_all_offsets_and_horizons(spark):
    from tidemark.operators import cohorts

    rnd = random.Random(5)
    rows, price = [], 50.0
    for m in range(900):
        price *= 1 + rnd.gauss(0, 0.004)
        if rnd.random() < 0.99 or m in (700, 640):
            rows.append(("A", m, price, price * 1.003, price * 0.996, price * (1 + rnd.gauss(0, 0.001)), rnd.random() * 100, rnd.randint(1, 9), rnd.random() * 50))
    bars = spark.createDataFrame(rows, "k string, m long, open double, high double, low double, close double, quote_volume double, trade_count long, taker_quote double")
    samples = spark.createDataFrame([("s1", "A", 640, 700, "event"), ("s2", "A", 641, 660, "control")], "sample_id string, k string, baseline long, cross long, sample_type string")
    offsets, horizons = (240, 60, 0), (15, 30)
    got = cohorts.baseline_context(samples, bars, "k", "m", offsets, horizons, 100, windows=(24, 72), day=24, hour=4, same=(2, 4), horizon=8, liquidity=1).collect()
    assert {(r.sample_id, r.baseline_snapshot_offset_minutes, r.pre_cross_horizon_minutes) for r in got} == {(s, o, h) for s in ("s1", "s2") for o, h in [(o, None) for o in offsets] + [(None, h) for h in horizons]}
    by = {r[1]: r for r in rows}
    for r in got:
        base, cross = (640, 700) if r.sample_id == "s1" else (641, 660)
        at = (base - r.baseline_snapshot_offset_minutes if r.pre_cross_horizon_minutes is None else cross - r.pre_cross_horizon_minutes) - 1
        assert (r.entry_price is None) == (at not in by) and (at not in by or r.entry_price == by[at][5])
        if at in by:
            assert r.quote_volume_72m == pytest.approx(sum(by[m][6] for m in range(at - 71, at + 1) if m in by))
        if r.pre_cross_horizon_minutes is not None:
            assert r.decision_stage == "pre_cross" and r.outcome_baseline_to_cross_observed_fraction is None and r.outcome_snapshot_to_cross_max_gain_pct is None
            continue
        seg, ahead = ([by[m] for m in range(base, z + 1) if m in by] for z in (cross, base + 99))
        assert r.decision_stage == ("baseline_start" if r.baseline_snapshot_offset_minutes == 0 else "pre_baseline")
        assert r.outcome_baseline_to_cross_observed_fraction == pytest.approx(len(seg) / (cross - base + 1)) and r.outcome_next_8h_from_baseline_observed_fraction == pytest.approx(len(ahead) / 100)
        if base in by:
            assert r.outcome_baseline_to_cross_max_gain_from_baseline_minute_low_pct == pytest.approx((max(x[3] for x in seg) / by[base][4] - 1) * 100)
            assert r.outcome_next_8h_from_baseline_max_drawdown_from_baseline_minute_close_pct == pytest.approx((min(x[4] for x in ahead) / by[base][5] - 1) * 100)
        if at in by:
            assert r.outcome_snapshot_to_cross_max_gain_pct == pytest.approx((max(x[3] for x in seg) / by[at][5] - 1) * 100)


def test_samples_of_one_step_share_their_row(spark, monkeypatch):
    from tidemark.operators import context, ranges

    rnd = random.Random(3)
    rows = [(k, m, p := 50 + rnd.random(), p * 1.01, p * 0.99, p, rnd.random() * 100, 3, 1.0) for k in (1, 2) for m in range(300) if m != 280]
    bars = spark.createDataFrame(rows, "k long, m long, open double, high double, low double, close double, quote_volume double, trade_count long, taker_quote double")
    assert sorted(map(tuple, ranges.block_table(bars, "k", "m", lambda df: df).collect()), key=str) == sorted(map(tuple, ranges.blocks(bars, "k", "m").collect()), key=str)
    samples = spark.createDataFrame([(i, 1 + i % 2, (270, 280, None)[i % 3], 272 + i) for i in range(18)], "sample_id long, k long, m long, anchor long")
    seen, whole = [], context._ten_days
    monkeypatch.setattr(context, "_ten_days", lambda places, *a: (seen.append(places.count()), whole(places, *a))[1])
    got = {r.sample_id: r for r in context.ten_day_context(samples, bars, "k", "m", None, (24, 72), 10, 24, 4, (2, 4), (24,), horizon=8, liquidity=1).collect()}
    assert seen == [6] and sorted(got) == list(range(18))
    close = {(r[0], r[1]): r[5] for r in rows}
    for i, r in got.items():
        assert (r.k, r.m, r.anchor) == (1 + i % 2, (270, 280, None)[i % 3], 272 + i)
        assert r.entry_price == close.get((r.k, r.m)) and (r.feature_quality_status == "missing_decision_bar") == (r.m != 270)
        if r.m == 270:
            top = max(x[3] for x in rows if x[0] == r.k and 271 <= x[1] <= min(r.anchor, 278))
            assert r.outcome_to_anchor_max_gain_pct == pytest.approx((top / r.entry_price - 1) * 100)


def plain_sellability(events, quotes, trades, wide, notional, need_trade):
    want = {}
    for e, k, cross, thr in events:
        end, mine = cross + wide, sorted((q[1:] for q in quotes if q[0] == k), key=lambda q: q[:2])
        before, later = [q for q in mine if q[0] <= cross], [q for q in mine if cross < q[0] <= end]
        states = [(cross, -1, *before[-1][2:])] if before else []
        states += later
        near = [t for t in trades if t[0] == k and cross <= t[1] <= end]
        hits = [t for t in near if t[3] >= thr]
        spans, first, shown = [], None, False
        for i, (start, _, bid, size) in enumerate(states):
            stop = states[i + 1][0] if i + 1 < len(states) else end
            if bid >= thr:
                deep = bid * size >= notional
                shown = shown or deep
                if deep and first is None and (not need_trade or any(start < t[1] <= stop for t in hits)):
                    first = (start, bid, bid * size)
                if spans and start <= spans[-1][1]:
                    spans[-1][1] = stop
                else:
                    spans.append([start, stop])
        status = "confirmed_sellable" if first else "displayed_bid_only" if shown else "trade_only" if hits else "not_confirmed"
        want[e] = (status, *(first or (None, None, None)), sum(b - a for a, b in spans) / NS, max((b - a for a, b in spans), default=0) / NS, max((s[2] for s in states), default=0.0), max((s[2] * s[3] for s in states), default=0.0), states[0][2] if states else None, max((t[3] for t in near), default=0.0), len(hits), sum(t[4] for t in hits))
    return want


@pytest.mark.parametrize(("seed", "need_trade"), [(1, True), (2, True), (3, False)])
def test_sellability_equals_a_loop_without_pairs(spark, seed, need_trade):
    from tidemark.operators import cohorts

    rnd, wide = random.Random(seed), 20
    when = lambda: rnd.randrange(0, 90) * NS // 2 + 1_700_000_000 * NS
    quotes = [(k, when(), i, float(rnd.randint(8, 13)), rnd.randint(1, 9)) for k in (1, 2) for i in range(60)]
    trades = [(k, when() + rnd.choice([0, 1]), i, float(rnd.randint(8, 13)), rnd.randint(0, 5)) for k in (1, 3) for i in range(25)]
    events = [(i, rnd.choice([1, 2, 3, 4]), when(), float(rnd.randint(9, 13))) for i in range(60)]
    q = spark.createDataFrame(quotes, "k long, at long, seq long, bid_price double, bid_size_shares long")
    t = spark.createDataFrame(trades, "k long, at long, seq long, price double, size long")
    x = cohorts.sellability_study(spark.createDataFrame(events, "event long, k long, cross long, threshold double"), q, t, "k", wide, 40.0, need_trade)
    got = {r.event: (r.status, r.first_confirmed_exit_at, r.first_confirmed_exit_bid, r.first_confirmed_exit_notional, r.displayed_seconds, r.max_contiguous_displayed_seconds, r.max_bid_price, r.max_bid_notional, r.active_bid_at_cross_price, r.max_trade_price_after_cross, r.trade_count_at_or_above_threshold, r.trade_volume_at_or_above_threshold) for r in x.collect()}
    want = plain_sellability(events, quotes, trades, wide * NS, 40.0, need_trade)
    assert got == want and len({v[0] for v in want.values()}) >= 2
    # an interval join would cut spans by a sequence of buckets and meet every event with every quote of its window
    assert "sequence(" not in x._jdf.queryExecution().optimizedPlan().toString()
