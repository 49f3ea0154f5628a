"""Operators on hand-made rows, and against loops in plain Python."""

import functools
import io
import math
import random
import uuid
import zipfile

import pytest
from pyspark.sql import functions as F

from tidemark.functions import scalar
from tidemark.operators import evaluate, matching, ordered, splits, surge, tape
from tidemark.sources import readers, writers
from tidemark.streaming import stateful


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_scalars(spark):
    s = "2026-07-15T13:30:00.123456789Z"
    ns = one(spark, scalar.ts_ns(F.lit(s)))
    assert ns % 10**9 == 123456789 and one(spark, scalar.ns_text(F.lit(ns))) == s
    assert one(spark, scalar.ts_ns(F.lit("2026-07-15T13:30:00Z"))) % 10**9 == 0
    for name in ("a", "scan:SYM:2026-01-01:rolling-480m"):
        assert one(spark, scalar.uuid5(F.lit(name))) == str(uuid.uuid5(uuid.NAMESPACE_URL, name))
    assert one(spark, scalar.pct_change(F.lit(0.0), F.lit(5.0))) is None
    assert one(spark, scalar.safe_ratio(F.lit(1.0), F.lit(0.0))) is None
    assert one(spark, scalar.number_or(F.lit("x"), 0.0)) == 0 and one(spark, scalar.number_or(F.lit("NaN"))) is None
    assert one(spark, scalar.epoch_millis(F.lit(1_735_689_600_000_000))) == 1_735_689_600_000 == one(spark, scalar.epoch_millis(F.lit(1_735_689_600_000)))
    assert [one(spark, scalar.price_band_index(F.lit(p))) for p in (0.4, 0.5, 7.0, 99.0)] == [0, 1, 4, 7]
    assert one(spark, scalar.symbol_like(F.lit("BRK.B"))) and not one(spark, scalar.symbol_like(F.lit("12345678X")))
    assert one(spark, scalar.session_label(F.lit("2026-07-15 13:30:00").cast("timestamp"))) == "regular"
    summer = one(spark, F.date_format(scalar.local_clock_utc(F.lit("2026-07-15").cast("date"), 14, 0, "Europe/London"), "HH:mm"))
    winter = one(spark, F.date_format(scalar.local_clock_utc(F.lit("2026-01-15").cast("date"), 14, 0, "Europe/London"), "HH:mm"))
    assert (summer, winter) == ("13:00", "14:00")


def test_surge_takes_the_latest_low_and_the_first_cross(spark):
    bars = [(1, 0, 12.0, 10.0), (1, 5, 11.0, 10.0), (1, 7, 12.4, 11.0), (1, 9, 12.5, 12.0), (1, 11, 20.0, 12.0), (2, 3, 9.0, 5.0)]
    df = spark.createDataFrame(bars, "symbol long, minute long, high double, low double")
    got = surge.first_rolling_surge(df, ["symbol"], "minute", F.expr("minute div 1440")).collect()
    assert [tuple(r) for r in got] == [(1, 0, 9, 12.5, 10.0, 5)]


def test_surge_equals_a_loop_in_batch_and_stream(spark, tmp_path):
    rnd = random.Random(4)
    rows = [(s, m, p + rnd.random(), p) for s in (1, 2) for m in sorted(rnd.sample(range(4000), 300)) for p in [rnd.choice([8.0, 9.0, 10.0, 10.5])]]
    want = set()
    for s in (1, 2):
        done, mine = set(), [r for r in rows if r[0] == s]
        for _, m, high, _ in mine:
            past = [(lo, -u) for _, u, _, lo in mine if m - 479 <= u < m]
            if past and m // 1440 not in done and high + 1e-15 >= min(past)[0] * 1.25:
                done.add(m // 1440)
                want.add((s, m // 1440, m, high, min(past)[0], -min(past)[1]))
    df = spark.createDataFrame(rows, "symbol long, minute long, high double, low double")
    assert {tuple(r) for r in surge.first_rolling_surge(df, ["symbol"], "minute", F.expr("minute div 1440")).collect()} == want
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    q = stateful.surges(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")).writeStream.format("memory").queryName("surges").option("checkpointLocation", f"{tmp_path}/cp").start()
    q.processAllAvailable()
    q.stop()
    assert {tuple(r) for r in spark.table("surges").collect()} == want


def test_session_detector_keeps_a_touch_that_is_lost(spark):
    rows = [(1, 0, 10.0, 11.0, 9.0, 10.0, 5), (1, 60, 10.0, 12.5, 9.0, 10.0, 5), (1, 660, 10.0, 12.5, 9.0, 9.5, 5)]
    df = spark.createDataFrame(rows, "day long, at long, open double, high double, low double, close double, n long").withColumn("pc", F.lit(10.0))
    r = surge.session_detector(df, ["day"], "at", "pc").first()
    assert (r.cross_at, r.peak_at, r.max_gap_minutes, r.last_close, r.flags) == (60, 60, 9, 9.5, "possible_halt_or_illiquidity")


def test_asof_strict_and_inclusive(spark):
    left = spark.createDataFrame([(1, 10, 0), (1, 11, 1), (1, 9, 2)], "k long, t long, id long")
    right = spark.createDataFrame([(1, 10, 1, 5.0), (1, 10, 2, 6.0)], "k long, t long, seq long, p double")
    get = lambda **o: {r.id: r.r_p for r in ordered.asof_join(left, right, ["k"], "t", ["p"], "seq", **o).collect()}
    assert get() == {0: 6.0, 1: 6.0, 2: None} and get(strict=True) == {0: None, 1: 6.0, 2: None}
    assert get(tolerance=0) == {0: 6.0, 1: None, 2: None}


def test_interval_join_equals_a_loop(spark):
    rnd = random.Random(2)
    spans = [(rnd.randint(0, 2), a, a + rnd.randint(0, 50)) for a in (rnd.randint(-100, 900) for _ in range(60))]
    points = [(rnd.randint(0, 2), rnd.randint(-120, 1000)) for _ in range(80)]
    s, p = spark.createDataFrame(spans, "k long, lo long, hi long"), spark.createDataFrame(points, "k long, at long")
    got = sorted(tuple(r) for r in ordered.interval_join(p, s, "k", "at", "lo", "hi", 20).select("k", "at", "lo", "hi").collect())
    assert got == sorted((k, t, a, b) for k, t in points for q, a, b in spans if q == k and a < t <= b)


def test_quote_states(spark):
    q = spark.createDataFrame([(1, 5, 1), (1, 5, 2), (1, 9, 3)], "k long, t long, seq long")
    keep = ordered.state_intervals(q, ["k"], "t", "seq", F.lit(20)).select("seq", "start", "stop").collect()
    assert [tuple(r) for r in sorted(keep)] == [(1, 5, 5), (2, 5, 9), (3, 9, 20)]
    assert ordered.state_intervals(q, ["k"], "t", "seq", F.lit(20), keep_empty=False).count() == 2


def test_segments_break_on_gaps_and_thin_spans(spark):
    s = spark.createDataFrame([(1, 0, 10, 500.0), (1, 11, 20, 500.0), (1, 20, 25, 50.0), (1, 25, 30, 500.0), (1, 40, 50, 500.0)], "k long, a long, b long, size double")
    got = {r.level: (r.segments, r.total, r.longest) for r in tape.opportunity_segments(s, ["k"], "a", "b", "size", [100.0, 10.0], 2).collect()}
    assert got == {100.0: (3, 35, 20), 10.0: (2, 40, 30)}


def test_simulator_stop_before_target_and_stale_close(spark):
    cols = "k long, t long, seq long, bid double, ask double, lim double"
    run = lambda rows, **o: tape.simulate_execution(spark.createDataFrame(rows, cols).withColumn("close_at", F.lit(200)), ["k"], "t", "seq", "bid", "ask", "lim", F.lit(12.5), slip_bps=0, close=F.col("close_at"), **o).first()
    assert run([(1, 1, 1, 9.9, 10.0, 11.0), (1, 2, 2, 9.4, 9.5, 11.0), (1, 3, 3, 13.0, 13.1, 11.0)]).reason == "stop"
    hit = run([(1, 1, 1, 9.9, 10.0, 11.0), (1, 2, 2, 12.5, 12.6, 11.0)])
    assert (hit.reason, hit.exit_at, hit.entry_price) == ("target", 2, 10.0)
    assert run([(1, 1, 1, 9.9, 10.0, 11.0)]).reason == "no_executable_close_exit"
    assert run([(1, 1, 1, 9.9, 10.0, 11.0), (1, 150, 2, 10.5, 10.6, 11.0)]).reason == "time"


def test_opportunity_segments_do_not_depend_on_the_order_of_ties(spark):
    rows = [(1, a, a + 10, size) for a in range(0, 60, 5) for size in (5.0, 200.0, 50.0)]
    want = None
    for seed in range(4):
        random.Random(seed).shuffle(rows)
        s = spark.createDataFrame(rows, "k long, a long, b long, size double").coalesce(1)
        got = sorted(map(tuple, tape.opportunity_segments(s, ["k"], "a", "b", "size", [100.0, 10.0], 2).collect()))
        want = want or got
        assert got == want


def test_vwap_partial_fill(spark):
    df = spark.createDataFrame([(1, 1, 10.0, 100.0), (1, 2, 20.0, 100.0)], "k long, i long, p double, v double")
    r = tape.vwap_to_target(df, ["k"], ["i"], "p", F.col("v"), 150.0).first()
    assert r.reached and r.sold == 150 and r.vwap == pytest.approx(150 / (10 + 2.5))


def test_vwap_target_reached_exactly(spark):
    # the cents add up to the target, the doubles to the last bit below it
    v = [79719.74, 45229.86, 110405.58, 88873.41, 111905.12, 63866.29]
    df = spark.createDataFrame([(1, i, 10.0, x) for i, x in enumerate(v)], "k long, i long, p double, v double").coalesce(1)
    assert functools.reduce(lambda a, b: a + b, v) < 500000 and sum(round(x * 100) for x in v) == 50_000_000
    assert tape.vwap_to_target(df, ["k"], ["i"], "p", F.col("v"), 500000).first().reached
    assert not tape.vwap_to_target(df, ["k"], ["i"], "p", F.col("v"), 500000.01).first().reached


def test_greedy_match_equals_a_loop(spark):
    rnd = random.Random(7)
    pairs = [(e % 3, e, c, c % 4, round(rnd.random(), 3)) for e in range(12) for c in rnd.sample(range(20), 8)]
    config = matching.MatchConfig(weights={}, controls=2, symbol_uses=3)
    got = [tuple(r) for r in matching.greedy_global(spark.createDataFrame(pairs, "grp long, event long, control long, symbol long, score double"), "grp", config).collect()]
    used, uses, want = set(), {}, []
    for e in sorted({(g, e) for g, e, *_ in pairs}):
        n = 0
        for _, _, c, s, score in sorted((p for p in pairs if p[1] == e[1]), key=lambda p: (p[4], p[2])):
            if n < 2 and c not in used and uses.get(s, 0) < 3:
                n += 1
                used.add(c)
                uses[s] = uses.get(s, 0) + 1
                want.append((e[1], c, n, score))
    assert sorted(got) == sorted(want)


def plain_greedy(pairs, controls, symbol_uses):
    used, uses, want = set(), {}, set()
    events = {}
    for p in pairs:
        events.setdefault(p[:2], []).append(p)
    for key in sorted(events):
        n = 0
        for _, e, c, s, score in sorted(events[key], key=lambda p: (p[4], p[2])):
            if n < controls and c not in used and uses.get(s, 0) < symbol_uses:
                n += 1
                used.add(c)
                uses[s] = uses.get(s, 0) + 1
                want.add((e, c, n, score))
    return want


@pytest.mark.parametrize(("seed", "controls", "symbol_uses"), [(1, 3, 4), (2, 1, 1), (3, 5, 10**6), (4, 2, 2)])
def test_greedy_rounds_equal_a_loop_under_contention(spark, seed, controls, symbol_uses):
    # many events want the same few controls and symbols, days share symbols, scores tie
    rnd = random.Random(seed)
    pairs = [(d, 100 * d + e, 1000 * d + c, c % 7, rnd.randint(0, 6) / 2) for d in range(5) for e in range(20) for c in rnd.sample(range(30), 12)]
    df = spark.createDataFrame(pairs, "day long, event long, control long, symbol long, score double").repartition(5)
    config = matching.MatchConfig(weights={}, controls=controls, symbol_uses=symbol_uses)
    picks = matching.greedy_global(df, "day", config)
    assert {tuple(r) for r in picks.collect()} == plain_greedy(pairs, controls, symbol_uses)
    assert matching.greedy_global(df.where("day > 9"), "day", config).count() == 0


def test_greedy_rounds_leave_no_scratch_tables(spark, tmp_path, monkeypatch):
    from tidemark.sources import shared

    monkeypatch.setattr(shared, "folder", lambda spark: f"file://{tmp_path}")
    df = spark.createDataFrame([(1, e, c, 0, 0.5 + c) for e in range(4) for c in range(4)], "day long, event long, control long, symbol long, score double")
    picks = matching.greedy_global(df, "day", matching.MatchConfig(weights={}, controls=1, symbol_uses=3))
    assert {(r.event, r.control) for r in picks.collect()} == {(0, 0), (1, 1), (2, 2)}
    assert len(list(tmp_path.glob("*.parquet"))) == 1


def test_candidate_quality_does_not_depend_on_how_anchors_lie(spark, sf):
    from tidemark.operators import cohorts
    from tidemark.plans import studies
    from tidemark.plans.features import samples

    grid = studies._hour_grid(spark, sf)
    plain = samples(spark, sf).select("symbol", "step", F.col("sample_id").alias("event"), F.lit("x").alias("other"))
    # anchors straight out of a join and an exchange, some of them repeated
    anchors = plain.union(plain.where("event % 3 = 0")).repartition(5).join(plain.select("event").distinct(), "event").repartition(7, "other")
    key = ("symbol", "step", "event", "reason", "observed_fraction", "minimum_liquidity")
    args = (grid, "symbol", "step", "step", (1, 2), 24, 1, 1, 100.0, 2, 0.6)
    once = {tuple(r[k] for k in key) for r in cohorts.candidate_quality(plain, *args).collect()}
    many = cohorts.candidate_quality(anchors, *args).collect()
    assert {tuple(r[k] for k in key) for r in many} == once and len(many) == anchors.count()
    rows = {(r.symbol, r.step): r for r in grid.collect()}
    for symbol, step, _, reason, _, _ in once:
        at = lambda a, z: [rows.get((symbol, s)) for s in range(step + a, step + z + 1)]  # noqa: B023, E731
        near, past = at(-2, 1), at(-26, -3)
        if None in near:
            want = "outside_loaded_range"
        elif not all(r.observed for r in near):
            want = "missing_local_minutes"
        elif any(r.crossing for r in near):
            want = "near_25pct_crossing"
        elif None in past or sum(r.observed for r in past) / 24 < 0.6:
            want = "insufficient_prior_history"
        elif not all(r.observed for r in at(-4, -3) + at(-3, -2)):
            want = "missing_entry_liquidity"
        else:
            want = "below_entry_liquidity_floor" if min(sum(r.quote_volume for r in at(-4, -3)), sum(r.quote_volume for r in at(-3, -2))) < 100 else "pass"
        assert reason == want


def test_rules_treat_null_as_false(spark):
    df = spark.createDataFrame([(7.0, 4.0, None, 0.5), (7.0, None, 12.0, 0.2)], "close_vs_1440m_low_pct double, quote_volume_60m_vs_prior_7d_same_time double, max_runup_720m_pct double, volatility_1d_to_7d_ratio double")
    assert [(r.C2, r.C4) for r in evaluate.default_rules().evaluate(df).collect()] == [(True, False), (False, False)]


def test_statistics_are_reproducible(spark):
    g = spark.createDataFrame([(i % 7, float(i % 3) - 0.5) for i in range(70)], "c long, difference double")
    a, b = (evaluate.cluster_bootstrap(g.repartition(n), "c", 500).first() for n in (1, 5))
    assert a == b and a.lo <= a.hi
    rows = spark.createDataFrame([(i // 4, i % 4 == 0, i % 4 == 0 or i % 9 == 0) for i in range(400)], "grp long, e boolean, r boolean")
    assert evaluate.randomisation(rows, "grp", F.col("e"), F.col("r"), 500).first().p == pytest.approx(1 / 501)


def test_splits(spark):
    days = lambda counts: [r.split[0] for r in sorted(splits.chronological(spark.createDataFrame(list(enumerate(counts)), "day long, n long"), "day", "n").collect())]
    assert "".join(days([10] * 20)) == "d" * 14 + "v" * 3 + "s" * 3
    assert days([100, 1, 1]) == ["d", "v", "s"] and days([5, 5]) == ["d", "v"] and days([5]) == ["d"]


def test_archives_and_checksums(spark, tmp_path):
    for day, header in (("2024-12-31", False), ("2025-01-01", True)):
        buf = io.BytesIO()
        with zipfile.ZipFile(buf, "w") as z:
            stamp = "1735689600000000" if header else "1735603200000"
            z.writestr("a.csv", ("open_time,open,high,low,close\n" if header else "") + f"{stamp},1,2,0.5,1.5,10,{stamp},15,3,1,1,0\n")
        (tmp_path / f"ABC-1m-{day}.zip").write_bytes(buf.getvalue())
    k = readers.read_kline_archives(spark, f"{tmp_path}/*.zip")
    assert sorted((r.symbol, r.open_time, r.close) for r in k.collect()) == [("ABC", 1735603200000, 1.5), ("ABC", 1735689600000, 1.5)]
    sums = k.select("path", "sha256").limit(1)
    assert sorted(r.ok for r in readers.verify_checksums(k, sums).collect()) == [False, True]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(i, i % 10, 30) for i in range(200)], "id long, grp long, size long")
    parts = writers.grouped_parts(df, "grp", "size", 1500, buckets=2)
    assert parts.groupBy("grp").agg(F.count_distinct("part").alias("n")).where("n > 1").count() == 0
    assert writers.manifest(parts, "part", "size").agg(F.max("bytes")).first()[0] <= 1500
    uneven = df.withColumn("size", F.col("grp") * 15)
    assert writers.manifest(writers.grouped_parts(uneven, "grp", "size", 2700, buckets=1), "part", "size").agg(F.max("bytes")).first()[0] <= 2700
    with pytest.raises(Exception, match="larger than the limit"):
        writers.grouped_parts(df, "grp", "size", 100).collect()
    writers.write_parquet(df, f"{tmp_path}/t", "overwrite")
    new = spark.createDataFrame([(5, 99, 1), (777, 1, 1)], df.schema)
    writers.write_upsert(df, f"{tmp_path}/u", ["id"])
    for _ in range(2):  # a replay leaves the same rows
        writers.write_upsert(new, f"{tmp_path}/u", ["id"])
    assert writers.read_versioned(spark, f"{tmp_path}/u").count() == 201
    # a version whose write did not commit is never read
    new.write.parquet(f"{tmp_path}/u/v=9")
    (tmp_path / "u" / "v=9" / "_SUCCESS").unlink()
    assert writers.current_version(spark, f"{tmp_path}/u") == 3
    twice = spark.createDataFrame([(5, 1, 1), (5, 2, 2)], df.schema)
    assert ordered.upsert(df, twice, ["id"], ["size"]).where("id = 5").first().grp == 2
    writers.write_csv(df.withColumn("m", F.struct("id")), f"{tmp_path}/c", single=True)
    assert spark.read.option("header", True).csv(f"{tmp_path}/c").where("m = '{\"id\":5}'").count() == 1
    assert writers.pending(df, df.where("id < 150"), ["id"]).count() == 50


def test_stream_rollup_equals_batch(spark, sf, tmp_path):
    ev = spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    ev.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = stateful.with_event_time(spark.readStream.schema(ev.schema).parquet(f"{tmp_path}/in"), delay="400 days")
    q = stateful.rollup(stream, ["event_type"], "value", "1 day").writeStream.outputMode("complete").format("memory").queryName("roll").option("checkpointLocation", f"{tmp_path}/cp").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("roll").collect())) == sorted(map(tuple, stateful.rollup(ev, ["event_type"], "value", "1 day").collect()))
    assert stateful.sessions(ev, ["user_id"]).agg(F.sum("n")).first()[0] == ev.count()




def test_greedy_match_has_all_customers_as_events(spark, sf):
    from tidemark.plans import cohort

    c = cohort.customers(spark, sf)
    pairs = matching.caliper_pairs(c, c, "grp", cohort.CONFIG).withColumn("symbol", F.col("control") % 50)
    got = {tuple(r) for r in cohort.t01(spark, sf).collect()}
    assert got == {tuple(r) for r in matching.greedy_global(pairs, "grp", cohort.CONFIG).collect()}
    assert any(r[0] % 10 for r in got)


def test_greedy_caliper_never_holds_all_pairs(spark, tmp_path, monkeypatch):
    from tidemark.sources import shared

    monkeypatch.setattr(shared, "folder", lambda spark: f"file://{tmp_path}")
    rnd = random.Random(5)
    c = spark.createDataFrame([(i, i % 2, rnd.uniform(100, 120), i % 6) for i in range(60)], "id long, grp long, price double, symbol long")
    config = matching.MatchConfig(weights={"price": 1.0}, ratios={"price": (0.5, 2.0)}, most_score=9.0, controls=3, symbol_uses=4)
    pairs = [tuple(r) for r in matching.caliper_pairs(c, c, "grp", config, carry=("symbol",)).select("grp", "event", "control", "symbol", "score").collect()]
    rows, cut = [], shared.Scratch.cut
    monkeypatch.setattr(shared.Scratch, "cut", lambda self, df: (out := cut(self, df), rows.append(out.count()))[0])
    monkeypatch.setattr(matching, "MOST_PAIRS", 320)
    monkeypatch.setattr(matching, "MOST_EVENTS", 25)
    got = matching.greedy_caliper(c, c, "grp", config)
    assert {tuple(r) for r in got.collect()} == plain_greedy(pairs, 3, 4)
    assert max(rows) < len(pairs) / 4
    assert len(list(tmp_path.glob("*.parquet"))) == 1


def test_bootstrap_and_randomisation_draw_as_often_as_the_reference(spark, sf):
    from tidemark.plans import cohort

    boot = evaluate.cluster_bootstrap(cohort.groups(spark, sf), "symbol", reps=10_000).first()
    assert tuple(cohort.a20(spark, sf).first()) == (round(boot.lo, 6), round(boot.hi, 6), boot.clusters)
    drawn = evaluate.randomisation(cohort.grouped(spark, sf), "grp", F.col("is_event"), F.col("rule"), reps=50_000).first()
    assert cohort.a21(spark, sf).first() == drawn


def test_weighted_replicates_agree_with_drawing_clusters(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    sums, sizes = rng.normal(0.3, 1.0, 250), rng.integers(1, 6, 250)
    rows = [(f"c{i}", float(s / n)) for i, (s, n) in enumerate(zip(sums, sizes, strict=True)) for _ in range(n)] + [(None, 50.0)]
    got = evaluate.cluster_bootstrap(spark.createDataFrame(rows, "c string, difference double"), "c", 4000).first()
    values = [sums[p].sum() / sizes[p].sum() for p in rng.integers(0, 250, (4000, 250))]
    lo, hi = np.quantile(values, [0.025, 0.975])
    assert got.clusters == 250 and abs(got.lo - lo) < 0.1 * (hi - lo) and abs(got.hi - hi) < 0.1 * (hi - lo)
    one = evaluate.cluster_bootstrap(spark.createDataFrame([("a", 1.0), ("a", 2.0)], "c string, difference double"), "c", 50).first()
    assert (one.lo, one.hi, one.clusters) == (None, None, 1)
    weights = [r.weight for r in evaluate.replicate_weights(spark.createDataFrame([(f"k{i}",) for i in range(40)], "c string"), 1000, 1).collect()]
    shares = [weights.count(k) / len(weights) for k in range(5)]
    assert len(weights) == 40_000 and all(abs(a - math.exp(-1) / math.factorial(k)) < 0.01 for k, a in enumerate(shares))


def test_a_hot_key_is_split_by_time_without_changing_results(spark):
    rnd = random.Random(8)
    key = lambda: rnd.choice(["hot"] * 8 + ["cold", None])
    left = spark.createDataFrame([(key(), rnd.randrange(3000), i) for i in range(300)], "k string, t long, id long")
    right = spark.createDataFrame([(key(), rnd.randrange(0, 3000, 7), i, rnd.random()) for i in range(60)], "k string, t long, seq long, p double")
    for options in ({}, {"strict": True}, {"tolerance": 40}):
        get = lambda **o: sorted((str(r.k), r.t, r.id, r.r_t, r.r_p) for r in ordered.asof_join(left, right, ["k"], "t", ["p"], "seq", **options, **o).collect())  # noqa: B023, E731
        assert get(width=50) == get() == get(width=10_000)
    prices = left.withColumn("price", F.abs(F.xxhash64("id") % 100) + 1.0)
    every = lambda **o: sorted(tuple(map(str, r)) for r in ordered.running_extremes(prices, ["k"], ["t", "id"], "price", **o).collect())
    assert every(width=70) == every()


def test_caliper_pairs_of_a_grid_equal_all_pairs(spark):
    rnd = random.Random(12)
    rows = [(i, i % 3, rnd.choice([None, 0.0, -3.0]) if i % 29 == 0 else math.exp(rnd.gauss(2, 1)), rnd.gauss(0, 5) if i % 31 else None) for i in range(240)]
    df = spark.createDataFrame(rows, "id long, grp long, price double, volume double")
    for most in (0.4, 1.5, float("inf")):
        config = matching.MatchConfig(weights={"price": 2.0, "volume": 0.5}, ratios={"price": (0.5, 2.0)}, most_score=most)
        got = {(r.event, r.control): r.score for r in matching.caliper_pairs(df, df, "grp", config).collect()}
        scales = {r.grp: (r._s_price, r._s_volume) for r in matching.robust_scales(df, ["grp"], ["price", "volume"]).collect()}
        want = {}
        for e, g, p, v in rows:
            for c, h, q, w in rows:
                if e != c and g == h and None not in (p, v, q, w) and p != 0 and 0.5 <= q / p <= 2.0:
                    score = math.sqrt(2 * ((q - p) / scales[g][0]) ** 2 + 0.5 * ((w - v) / scales[g][1]) ** 2)
                    if score <= most:
                        want[e, c] = score
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want) and want
