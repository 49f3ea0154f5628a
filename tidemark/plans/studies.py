"""Queries over whole studies: entries, executions, backtests, matched cohorts, validation, each with its oracle where SQL can express it."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import scalar
from tidemark.operators import evaluate, features, matching, tape
from tidemark.plans.catalog import query
from tidemark.plans.tables import TICKS, daily_orders, load, rounded, ticks

#: Open, crossing and threshold of the entry study, in seconds.
OPEN, CROSS, LIMIT = 1704110400, 1706000000, 60.0


def quotes(spark, sf, unit: int = 1):
    """Views as quotes: bid a bit below the ask, sizes by the key."""
    q = ticks(spark, sf, "view").withColumn("symbol", F.col("symbol") % 40)
    return q.select("symbol", (F.col("us") * unit).alias("at"), "seq", (F.col("price") - F.col("seq") % 3).alias("bid_price"), (F.col("seq") % 90 + 1).alias("bid_size_shares"), F.col("price").alias("ask_price"), (F.col("seq") % 70).alias("ask_size_shares"))


def entry_inputs(spark, sf):
    ns = F.lit(1_000_000_000).cast("long")
    q = quotes(spark, sf, 1000).withColumns({"open_ns": F.lit(OPEN) * ns, "cross_ns": (F.lit(CROSS) + F.col("symbol")) * ns, "threshold": F.lit(LIMIT)})
    t = ticks(spark, sf, "purchase").select((F.col("symbol") % 40).alias("symbol"), (F.col("us") * 1000).alias("at"), "seq", "price")
    return q, t


@query(
    "t05_entry_feasibility",
    f"""WITH q AS (SELECT symbol % 40 AS symbol, us * 1000 AS t_, seq, price - seq % 3 AS bid, price AS ask, seq % 70 AS size, {OPEN} * 1000000000::BIGINT AS o, ({CROSS} + symbol % 40) * 1000000000::BIGINT AS c FROM ({TICKS}) WHERE kind = 'view'), t AS (SELECT symbol % 40 AS symbol, us * 1000 AS t_, price FROM ({TICKS}) WHERE kind = 'purchase'),
    i AS (SELECT symbol, t_ AS start, coalesce(lead(t_) OVER (PARTITION BY symbol ORDER BY t_, seq), c) AS stop, bid, ask, size, o, c FROM q WHERE t_ >= o AND t_ < c),
    s AS (SELECT *, ask * size AS notional, o + 5000000000 AS from_ FROM i WHERE stop > start AND ask > 0 AND size > 0 AND (bid <= 0 OR ask >= bid) AND ask < {LIMIT} AND ask * size >= 100),
    k AS (SELECT s.symbol, s.start, min(t.t_) AS confirm FROM s JOIN t ON t.symbol = s.symbol AND t.t_ > s.start AND t.t_ <= s.stop AND t.t_ < s.c AND t.t_ >= s.from_ AND t.price + 1e-12 >= s.ask GROUP BY 1, 2),
    x AS (SELECT s.*, k.confirm, l.level, notional + 1e-9 >= l.level AS ok, greatest(s.start, from_) AS b, stop AS e FROM s LEFT JOIN k ON k.symbol = s.symbol AND k.start = s.start CROSS JOIN (SELECT unnest([100.0, 500.0, 1000.0, 5000.0]) AS level) l WHERE stop > from_),
    y AS (SELECT *, CASE WHEN ok AND NOT coalesce(lag(ok) OVER w AND b - lag(e) OVER w <= 2000000, FALSE) THEN 1 ELSE 0 END AS fresh FROM x WINDOW w AS (PARTITION BY symbol, level ORDER BY start)),
    z AS (SELECT *, sum(fresh) OVER (PARTITION BY symbol, level ORDER BY start ROWS UNBOUNDED PRECEDING) AS g FROM y),
    seg AS (SELECT symbol, level, g, (max(e) - min(b)) / 1e9 AS seconds, max(notional) AS notional, min(ask) AS ask, min(confirm) AS confirm, arg_min(ask, (confirm, b)) FILTER (confirm IS NOT NULL) AS confirm_ask FROM z WHERE ok GROUP BY 1, 2, 3),
    f AS (SELECT symbol, level, count(*) AS segments, sum(seconds) AS total, max(seconds) AS longest, max(notional) AS notional, min(ask) AS ask, min(confirm) AS confirm, arg_min(confirm_ask, confirm) FILTER (confirm IS NOT NULL) AS confirm_ask, min(confirm) FILTER (seconds + 1e-12 >= 30) AS act, arg_min(seconds, confirm) FILTER (confirm IS NOT NULL AND seconds + 1e-12 >= 30) AS act_seconds FROM seg GROUP BY 1, 2)
    SELECT a.symbol, CAST(a.level AS DOUBLE) AS level, f.segments IS NOT NULL AS displayed, f.confirm IS NOT NULL AS mechanically_purchasable, f.act IS NOT NULL AS manually_actionable, round(coalesce(total, 0), 3) AS total_displayed_seconds, round(coalesce(longest, 0), 3) AS max_contiguous_displayed_seconds, round(coalesce(notional, 0), 4) AS max_displayed_ask_notional, ask AS minimum_displayed_ask, confirm AS first_confirmed_at, confirm_ask AS first_confirmed_ask, round(({LIMIT} / confirm_ask - 1) * 100, 4) AS first_confirmed_edge_pct, act AS first_actionable_at, round(act_seconds, 3) AS first_actionable_segment_seconds
    FROM (SELECT DISTINCT q.symbol, l.level FROM q CROSS JOIN (SELECT unnest([100.0, 500.0, 1000.0, 5000.0]) AS level) l) a LEFT JOIN f USING (symbol, level)""",
)
def t05(spark, sf):
    x = tape.entry_feasibility(*entry_inputs(spark, sf), ["symbol"], "at", "seq", "open_ns", "cross_ns", "threshold")
    r = lambda c, d: F.round(c, d).alias(c)
    return x.select("symbol", "level", "displayed", "mechanically_purchasable", "manually_actionable", r("total_displayed_seconds", 3), r("max_contiguous_displayed_seconds", 3), r("max_displayed_ask_notional", 4), "minimum_displayed_ask", "first_confirmed_at", "first_confirmed_ask", r("first_confirmed_edge_pct", 4), "first_actionable_at", r("first_actionable_segment_seconds", 3))


@query("x09_entry_flags")
def x09(spark, sf):
    q, t = entry_inputs(spark, sf)
    levels = tape.entry_feasibility(q, t, ["symbol"], "at", "seq", "open_ns", "cross_ns", "threshold")
    seen = q.groupBy("symbol").agg(F.count_if((F.col("at") >= F.col("open_ns")) & (F.col("at") < F.col("cross_ns"))).alias("quotes"), F.max("open_ns").alias("o"), F.max("cross_ns").alias("c"))
    traded = t.groupBy("symbol").agg(F.count("*").alias("trades"))
    x = levels.join(seen, "symbol").join(traded, "symbol", "left").na.fill(0, ["trades"])
    return tape.entry_flags(x, ["symbol"], 500.0, F.col("o"), F.col("c"), F.col("quotes"), F.col("trades")).withColumn("quality_flags", F.concat_ws(",", "quality_flags"))


SIM = f"""q AS (SELECT symbol % 40 AS symbol, us / 1e6 AS t_, seq, price - seq % 3 AS bid, seq % 90 + 1 AS bs, price AS ask, seq % 70 AS asz FROM ({TICKS}) WHERE kind = 'view'), v AS (SELECT q.*, s.slip_bps FROM q CROSS JOIN (SELECT unnest([0.0, 10.0])::DOUBLE AS slip_bps) s WHERE bid > 0 AND ask > 0 AND ask >= bid AND t_ >= {OPEN} AND t_ <= {CROSS}),
    c AS (SELECT *, ask * (1 + slip_bps / 10000) AS fill, 500 / (ask * (1 + slip_bps / 10000)) AS shares FROM v),
    n AS (SELECT symbol, slip_bps, arg_min({{'t_': t_, 'seq': seq, 'ask': ask, 'fill': fill, 'shares': shares}}, (t_, seq)) AS i FROM c WHERE ask < 50 AND ask * asz + 1e-9 >= 500 AND ask * asz + 1e-9 >= shares * ask GROUP BY 1, 2),
    a AS (SELECT c.*, n.i, bid >= 50 AS won, bid <= n.i.fill * 0.95 AS lost, bs + 1e-9 >= n.i.shares AS deep FROM c JOIN n USING (symbol, slip_bps) WHERE (t_, seq) >= (n.i.t_, n.i.seq)),
    o AS (SELECT symbol, slip_bps, arg_min({{'t_': t_, 'seq': seq, 'bid': bid, 'why': CASE WHEN won THEN 'target' ELSE 'stop' END}}, (t_, seq)) AS o FROM a WHERE (won OR lost) AND deep GROUP BY 1, 2),
    h AS (SELECT a.*, o.o FROM a LEFT JOIN o USING (symbol, slip_bps) WHERE o.o IS NULL OR (a.t_, a.seq) <= (o.o.t_, o.o.seq)),
    g AS (SELECT symbol, slip_bps, any_value(i) AS i, any_value(o) AS o, arg_max({{'t_': t_, 'bid': bid}}, (t_, seq)) FILTER (deep) AS l, max(bid) AS top, min(bid) AS low FROM h GROUP BY 1, 2),
    e AS (SELECT d.symbol, d.slip_bps, i, top, low, CASE WHEN o IS NOT NULL THEN o.why WHEN l IS NOT NULL AND {CROSS} - l.t_ <= 86400 THEN 'time' END AS exit_reason, CASE WHEN o IS NOT NULL THEN o.bid WHEN l IS NOT NULL AND {CROSS} - l.t_ <= 86400 THEN l.bid END AS exit_bid FROM (SELECT DISTINCT q.symbol, s.slip_bps FROM q CROSS JOIN (SELECT unnest([0.0, 10.0])::DOUBLE AS slip_bps) s) d LEFT JOIN g USING (symbol, slip_bps))"""


def simulated(spark, sf):
    q = quotes(spark, sf).withColumns({"at": F.col("at") / 1e6, "from_": F.lit(float(OPEN)), "close_": F.lit(float(CROSS)), "prior": F.lit(40.0)})
    return tape.simulate_scenarios(q, ["symbol"], "at", "seq", "from_", "close_", "prior", stale=86400.0)


@query(
    "t03_friction_scenarios",
    f"WITH {SIM} SELECT symbol, slip_bps, i IS NOT NULL AS filled, CASE WHEN i IS NULL THEN 'no_executable_subthreshold_ask' WHEN exit_bid IS NULL THEN 'no_executable_close_exit' END AS reason, round(i.t_, 6) AS entry_at, i.ask AS entry_ask, round(i.fill, 6) AS entry_price, exit_reason, exit_bid, round((exit_bid * (1 - slip_bps / 10000) / i.fill - 1) * 100, 6) AS return_pct, round(i.shares * (exit_bid * (1 - slip_bps / 10000) - i.fill), 4) AS pnl_usd, top AS max_bid_after_entry, low AS min_bid_after_entry FROM e",
)
def t03(spark, sf):
    x = simulated(spark, sf)
    return x.select("symbol", "slip_bps", "filled", "reason", F.round("entry_at", 6).alias("entry_at"), "entry_ask", F.round("entry_price", 6).alias("entry_price"), "exit_reason", "exit_bid", F.round("return_pct", 6).alias("return_pct"), F.round("pnl_usd", 4).alias("pnl_usd"), "max_bid_after_entry", "min_bid_after_entry")


def trades(spark, sf):
    """Orders as trades of two strategies."""
    k = F.col("o_orderkey")
    pnl = (F.col("o_totalprice") % 1000) - 450
    filled, open_ = k % 7 != 0, k % 350 == 1
    return load(spark, sf, "orders").select(F.when(F.col("o_custkey") % 2 == 0, "preopen").otherwise("midday").alias("strategy"), F.col("o_orderdate").cast("date").cast("string").alias("trade_date"), k.alias("rank"), filled.alias("filled"), F.when(filled & ~open_, F.round(pnl, 2)).alias("pnl_usd"), F.when(filled & ~open_, F.round(pnl / 5, 3)).alias("return_pct"), F.get(F.array(F.lit("target"), F.lit("stop"), F.lit("time")), (k % 3).cast("int")).alias("exit_reason"), F.round(pnl + 1, 2).alias("pnl_0bps"), F.when(k % 11 != 0, F.round(pnl - 1, 2)).alias("pnl_10bps"), (k % 4 == 0).alias("selected"))


@query("a22_daily_lower_bound")
def a22(spark, sf):
    # orders of a month stand for a market day
    t = trades(spark, sf).withColumn("trade_date", F.substring("trade_date", 1, 7))
    return rounded(evaluate.daily_lower_bound(t, ["strategy"], "trade_date", "pnl_usd", seeds={"preopen": 1701}))


TRADES = "SELECT CASE WHEN o_custkey % 2 = 0 THEN 'preopen' ELSE 'midday' END AS strategy, CAST(o_orderdate AS DATE) AS trade_date, o_orderkey AS rank, o_orderkey % 7 <> 0 AS filled, CASE WHEN o_orderkey % 7 <> 0 AND o_orderkey % 350 <> 1 THEN round(o_totalprice % 1000 - 450, 2) END AS pnl, CASE WHEN o_orderkey % 7 <> 0 AND o_orderkey % 350 <> 1 THEN round((o_totalprice % 1000 - 450) / 5, 3) END AS ret, ['target', 'stop', 'time'][o_orderkey % 3 + 1] AS why, round(o_totalprice % 1000 - 449, 2) AS p0, CASE WHEN o_orderkey % 11 <> 0 THEN round(o_totalprice % 1000 - 451, 2) END AS p10, o_orderkey % 4 = 0 AS selected FROM orders"


@query(
    "a23_backtest_summary",
    f"""WITH t AS ({TRADES}), d AS (SELECT * FROM t WHERE pnl IS NOT NULL), b AS (SELECT strategy, count(*) AS trigger_count, count(*) FILTER (selected) AS selected_count, count(*) FILTER (filled) AS entry_fill_count, round(sum(p0) FILTER (filled), 2) AS total_pnl_0bps_each_side, round(sum(p10) FILTER (filled), 2) AS total_pnl_10bps_each_side, count(p10) FILTER (filled) AS resolved_trades_10bps_each_side FROM t GROUP BY 1),
    s AS (SELECT strategy, count(*) AS resolved_trade_count, count(*) FILTER (why = 'target') AS target_count, round(avg(CASE WHEN pnl > 0 THEN 1.0 ELSE 0.0 END), 6) AS win_rate, round(avg(ret), 6) AS mean_return_pct, round(median(ret), 6) AS median_return_pct, round(sum(pnl), 2) AS total_pnl_usd, round(sum(pnl) FILTER (pnl > 0) / abs(sum(pnl) FILTER (pnl < 0)), 6) AS profit_factor, count(DISTINCT trade_date) AS market_days_with_resolved_trades FROM d GROUP BY 1),
    y AS (SELECT strategy, trade_date, sum(pnl) AS p FROM d GROUP BY 1, 2), e AS (SELECT strategy, trade_date, p, sum(p) OVER (PARTITION BY strategy ORDER BY trade_date ROWS UNBOUNDED PRECEDING) AS eq FROM y), f AS (SELECT strategy, round(-max(greatest(0, pk) - eq), 2) AS max_drawdown_usd FROM (SELECT *, max(eq) OVER (PARTITION BY strategy ORDER BY trade_date ROWS UNBOUNDED PRECEDING) AS pk FROM e) GROUP BY 1),
    r AS (SELECT strategy, max(n) AS max_consecutive_losses FROM (SELECT strategy, g, count(*) FILTER (pnl < 0) AS n FROM (SELECT *, sum(CASE WHEN pnl < 0 THEN 0 ELSE 1 END) OVER (PARTITION BY strategy ORDER BY trade_date, rank ROWS UNBOUNDED PRECEDING) AS g FROM d) GROUP BY 1, 2) GROUP BY 1),
    rd AS (SELECT strategy, max(n) AS max_consecutive_losing_days FROM (SELECT strategy, g, count(*) FILTER (p < 0) AS n FROM (SELECT *, sum(CASE WHEN p < 0 THEN 0 ELSE 1 END) OVER (PARTITION BY strategy ORDER BY trade_date ROWS UNBOUNDED PRECEDING) AS g FROM y) GROUP BY 1, 2) GROUP BY 1),
    k AS (SELECT strategy, sum(pnl) AS best FROM (SELECT *, row_number() OVER (PARTITION BY strategy ORDER BY pnl DESC, trade_date, rank) AS k FROM d) WHERE k <= 3 GROUP BY 1)
    SELECT strategy, trigger_count, selected_count, entry_fill_count, resolved_trade_count, target_count, win_rate, mean_return_pct, median_return_pct, total_pnl_usd, profit_factor, market_days_with_resolved_trades, max_drawdown_usd, max_consecutive_losses, max_consecutive_losing_days, round(total_pnl_usd - best, 2) AS pnl_without_top3_winners_usd, total_pnl_0bps_each_side, total_pnl_10bps_each_side, resolved_trades_10bps_each_side, round((entry_fill_count - resolved_trade_count) / entry_fill_count, 6) AS unresolved_exit_rate,
    resolved_trade_count >= 30 AS minimum_30_resolved_trades, market_days_with_resolved_trades >= 15 AS minimum_15_trading_days, total_pnl_usd > 0 AS positive_primary_pnl, profit_factor >= 1.25 AS profit_factor_at_least_1_25, max_drawdown_usd >= -5000 AS drawdown_within_5000, max_consecutive_losses <= 10 AS maximum_10_consecutive_losses, (entry_fill_count - resolved_trade_count) / entry_fill_count <= 0.01 AS unresolved_exit_rate_at_most_1pct
    FROM b JOIN s USING (strategy) JOIN f USING (strategy) JOIN r USING (strategy) JOIN rd USING (strategy) JOIN k USING (strategy)""",
)
def a23(spark, sf):
    t = trades(spark, sf)
    x = evaluate.backtest_summary(t.select("strategy", "selected"), t, reps=200, seeds={"preopen": 1701})
    r = lambda c, d: F.round(c, d).alias(c)
    return x.select("strategy", "trigger_count", "selected_count", "entry_fill_count", "resolved_trade_count", "target_count", r("win_rate", 6), r("mean_return_pct", 6), r("median_return_pct", 6), r("total_pnl_usd", 2), r("profit_factor", 6), "market_days_with_resolved_trades", r("max_drawdown_usd", 2), "max_consecutive_losses", "max_consecutive_losing_days", r("pnl_without_top3_winners_usd", 2), r("total_pnl_0bps_each_side", 2), r("total_pnl_10bps_each_side", 2), "resolved_trades_10bps_each_side", r("unresolved_exit_rate", 6), "minimum_30_resolved_trades", "minimum_15_trading_days", "positive_primary_pnl", "profit_factor_at_least_1_25", "drawdown_within_5000", "maximum_10_consecutive_losses", "unresolved_exit_rate_at_most_1pct")


# --- matched cohorts ------------------------------------------------------------------


def cohort(spark, sf):
    """Daily features of order priorities and statuses as symbols, as events (days of high totals) and candidates."""
    o = load(spark, sf, "orders").select(F.concat_ws("/", "o_orderpriority", "o_orderstatus", F.col("o_custkey") % 3).alias("symbol"), F.col("o_orderdate").cast("date").alias("day"), "o_orderkey", "o_totalprice")
    d = o.groupBy("symbol", F.date_trunc("month", "day").cast("date").alias("day")).agg(F.min_by("o_totalprice", "o_orderkey").alias("open"), F.max("o_totalprice").alias("high"), F.min("o_totalprice").alias("low"), F.max_by("o_totalprice", "o_orderkey").alias("close"), F.count("*").alias("n"))
    f = features.daily_features(d, ["symbol"], "day")
    f = f.select(F.concat_ws("@", "symbol", "day").alias("id"), "symbol", F.substring("symbol", 1, 1).alias("exchange"), F.col("day").cast("string").alias("event_date"), "prior_close", F.col("no_hit").alias("no_threshold_hit"), F.col("median_dollar_volume").alias("median_dollar_volume_10"), F.coalesce("realized_vol", F.lit(0.0)).alias("realized_vol_10"), F.col("atr_pct").alias("atr_pct_10"), F.col("prior_return").alias("prior_day_return"), F.col("momentum").alias("momentum_10"), "price_band", "log_prior_close", F.col("log_median_dollar_volume").alias("log_median_dollar_volume_10"), "log_listing_sessions", F.lit(False).alias("corporate_action_45d"), (F.col("high") >= F.col("prior_close") * 5).alias("is_event"))
    ids = f.select("id", F.xxhash64("id").alias("key"))
    f = f.join(ids, "id").drop("id").withColumnRenamed("key", "id")
    return f.where("is_event").drop("is_event", "no_threshold_hit"), f.where(~F.col("is_event")).drop("is_event")


LOOSE = matching.BalanceConfig(controls=2, symbol_uses=4, price_ratio=(0.05, 20.0), dollar_volume_ratio=(0.05, 20.0), volatility_ratio=(0.2, 5.0), band_distance=8, most_score=6.0)


@query("t01_balanced_match")
def t01(spark, sf):
    picks, _ = matching.balanced_match(*cohort(spark, sf), LOOSE)
    return rounded(picks)


@query("a30_balance_gates")
def a30(spark, sf):
    x = matching.balance_report(*cohort(spark, sf), LOOSE)
    return rounded(x.withColumns({"gate_violations": F.concat_ws(",", "gate_violations"), "rejection_reason_totals": F.to_json("rejection_reason_totals")}))


@query("t01_shortfalls")
def t01_shortfalls(spark, sf):
    _, few = matching.balanced_match(*cohort(spark, sf), LOOSE)
    return few.select("event_date", "event", "reason", "selected", "accepted", "candidates", F.to_json("rejections").alias("rejections"), F.size("nearest").alias("nearest"))


@query("t02_tiered_controls")
def t02(spark, sf):
    """Anchors of sign-ups on the days of other events, clear of known events, ranked by use, tier, weekday, distance and hash."""
    t = ticks(spark, sf)
    e = t.where("kind = 'signup'").select("symbol", F.col("seq").alias("event"), "sec")
    dates = e.select(F.expr("sec div 86400 * 86400").alias("date_start")).distinct()
    a = matching.anchors(e, "symbol", "sec", dates, [0, -15, 15, -30, 30, -45, 45, -60, 60], t.where("kind in ('signup', 'error')").select("symbol", "sec"), 86400)
    a = a.join(e.select("event", "sec"), "event").withColumn("offset", ((F.pmod(F.col("anchor") - F.col("sec") + 43200, F.lit(86400)) - 43200) / 60).cast("int"))
    x = matching.anchor_candidates(a, "sec", "anchor", F.col("offset"))
    x = x.select("symbol", "event", F.col("sec").alias("event_order"), scalar.floor_div(F.col("anchor"), 60).alias("control"), "day", "tier_rank", "weekday_rank", "distance", scalar.tie_break(F.col("event"), F.col("anchor")).alias("tie"))
    return matching.greedy_within(x, "symbol", 5)


@query("x05_external_validation")
def x05(spark, sf):
    """Both frozen rules over groups of orders, with the frozen criteria and draws."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    first = F.min(k).over(W.partitionBy("o_custkey"))
    rows = load(spark, sf, "orders").select(c.alias("match_group_id"), F.when(k == first, 1).otherwise(0).alias("label"), F.concat(F.lit("S"), c % 60).alias("symbol"), F.col("o_orderdate").cast("date").cast("string").alias("event_date"), F.lit("pass").alias("feature_quality_status"), F.lit(None).cast("boolean").alias("pseudo_window_contaminated_control"), (F.col("o_totalprice") / 30000).alias("close_vs_1440m_low_pct"), (F.col("o_totalprice") / 50000).alias("quote_volume_60m_vs_prior_7d_same_time"), (F.col("o_totalprice") / 20000).alias("max_runup_720m_pct"), (k % 10 / 10).alias("volatility_1d_to_7d_ratio"))
    return rounded(evaluate.external_validation(rows))


@query(
    "a26_snapshot_summary",
    f"""WITH t AS (SELECT symbol % 20 AS symbol, us * 1000 AS t_, seq, price, seq % 50 AS size FROM ({TICKS}) WHERE kind = 'purchase' AND price > 0), q AS (SELECT symbol % 20 AS symbol, us * 1000 AS t_, seq, price - 1 AS b, seq % 30 AS bs, price AS a FROM ({TICKS}) WHERE kind = 'view' AND price > 1),
    ts AS (SELECT symbol, t_ // 1000000000 AS s, arg_max(price, (t_, seq)) AS c, max(price) AS h, sum(size) AS v, count(*) AS n FROM t GROUP BY 1, 2), qs AS (SELECT symbol, t_ // 1000000000 AS s, arg_max({{'b': b, 'a': a, 'bs': bs}}, (t_, seq)) AS l, count(*) AS u FROM q GROUP BY 1, 2),
    x AS (SELECT coalesce(ts.symbol, qs.symbol) AS symbol, coalesce(ts.s, qs.s) AS s, c, h, v, n, l, u FROM ts FULL JOIN qs ON ts.symbol = qs.symbol AND ts.s = qs.s), y AS (SELECT * FROM x WHERE s <= 1704500000 + symbol),
    r AS (SELECT symbol, ln(c / lag(c) OVER (PARTITION BY symbol ORDER BY s)) AS r FROM y WHERE c IS NOT NULL), rv AS (SELECT symbol, round(sqrt(coalesce(sum(r * r), 0)), 6) AS realized_volatility_second_log FROM r GROUP BY 1)
    SELECT symbol, count(*) AS active_seconds, count(n) AS trade_seconds, count(u) AS quote_seconds, CAST(coalesce(sum(v), 0) AS BIGINT) AS trade_volume, max(h) AS high, arg_max(c, s) FILTER (c IS NOT NULL) AS last_trade_price, round(median(1 / ((l.a + l.b) / 2) * 10000), 4) AS median_spread_bps, arg_max(l.b, s) FILTER (l IS NOT NULL) AS last_bid, count(*) FILTER (s > 1704500000 + symbol - 300) AS trailing_300s_active_seconds, coalesce(any_value(realized_volatility_second_log), 0) AS realized_volatility_second_log FROM y LEFT JOIN rv USING (symbol) GROUP BY 1""",
)
def a26(spark, sf):
    x = ticks(spark, sf).withColumns({"symbol": F.col("symbol") % 20, "at": F.col("us") * 1000})
    t = x.where("kind = 'purchase' and price > 0").select("symbol", "at", "seq", "price", (F.col("seq") % 50).alias("size"))
    q = x.where("kind = 'view' and price > 1").select("symbol", "at", "seq", (F.col("price") - 1).alias("bid_price"), (F.col("seq") % 30).alias("bid_size_shares"), F.col("price").alias("ask_price"), F.lit(1).cast("long").alias("ask_size_shares"), F.lit(1.0).alias("spread"))
    s = tape.second_summary(t, q, ["symbol"], "at", "seq")
    y = tape.snapshot_summary(s, ["symbol"], F.lit(1704500000) + F.col("symbol"), F.lit(50.0))
    return y.select("symbol", "active_seconds", "trade_seconds", "quote_seconds", "trade_volume", "high", "last_trade_price", F.round("median_spread_bps", 4).alias("median_spread_bps"), "last_bid", "trailing_300s_active_seconds", F.round("realized_volatility_second_log", 6).alias("realized_volatility_second_log"))


@query(
    "x06_session_scan",
    f"""WITH b AS (SELECT symbol % 20 AS symbol, sec // 86400 AS day, sec // 60 * 60 AS t_, arg_min(price, (us, seq)) AS open, max(price) AS high, min(price) AS low, arg_max(price, (us, seq)) AS close, count(*) AS n FROM ({TICKS}) WHERE price > 0 GROUP BY 1, 2, 3), k AS (SELECT symbol, day, arg_max(close, t_) AS close FROM b GROUP BY 1, 2), c AS (SELECT symbol, day, lag(close) OVER (PARTITION BY symbol ORDER BY day) AS prior FROM k),
    r AS (SELECT b.*, prior, prior * 1.25 AS thr, day * 86400 + 34200 AS o FROM b JOIN c USING (symbol, day) WHERE prior > 0 AND t_ >= day * 86400 + 34200 AND t_ < day * 86400 + 57600)
    SELECT symbol, day, round(any_value(thr), 6) AS threshold_price, max(high) AS session_high, min(low) AS session_low, arg_max(close, t_) AS session_close, CAST(sum(n) AS BIGINT) AS session_trade_count, round((arg_min(open, t_) / any_value(prior) - 1) * 100, 6) AS opening_gap_pct, round((max(high) / any_value(prior) - 1) * 100, 6) AS high_vs_prior_close_pct, (min(t_) FILTER (high >= thr) - any_value(o)) // 60 AS minutes_from_open_to_cross, (min(t_) FILTER (high = mh) - any_value(o)) // 60 AS minutes_from_open_to_peak
    FROM (SELECT *, max(high) OVER (PARTITION BY symbol, day) AS mh FROM r) GROUP BY 1, 2 HAVING max(high) >= any_value(thr)""",
)
def x06(spark, sf):
    """Session gainers: each symbol's regular bars against its prior close."""
    from tidemark.operators import surge

    b = surge.bars(ticks(spark, sf).where("price > 0").withColumn("symbol", F.col("symbol") % 20), ["symbol"], F.expr("sec div 60 * 60"), "price", ["us", "seq"], "at").withColumn("day", F.expr("at div 86400"))
    x = surge.session_scan(b.withColumn("volume", F.col("n")), ["symbol"], "day", "at", F.col("day") * 86400 + 34200, F.col("day") * 86400 + 57600)
    r = lambda c: F.round(c, 6).alias(c)
    return x.where("qualifies").select("symbol", "day", r("threshold_price"), "session_high", "session_low", "session_close", "session_trade_count", r("opening_gap_pct"), r("high_vs_prior_close_pct"), "minutes_from_open_to_cross", "minutes_from_open_to_peak")


# --- cohorts of surges ------------------------------------------------------------------


@query(
    "x01_surge_scan",
    f"""WITH t AS (SELECT symbol % 10 AS symbol, us // 1000 AS ms, seq, price, (seq % 7 + 1)::DOUBLE AS size, seq % 2 = 0 AS seller FROM ({TICKS}) WHERE price > 0), b AS (SELECT symbol, ms // 60000 AS minute, max(price) AS high, min(price) AS low FROM t GROUP BY 1, 2),
    x AS (SELECT *, min({{{{'l': low, 'm': -minute}}}}) OVER (PARTITION BY symbol ORDER BY minute RANGE BETWEEN 479 PRECEDING AND 1 PRECEDING) AS base FROM b),
    e AS (SELECT symbol, minute // 1440 AS day, minute, base.l AS base_low, -base.m AS base_minute, base.l * 1.25 AS threshold FROM x WHERE base IS NOT NULL AND high + 1e-15 >= base.l * 1.25 QUALIFY row_number() OVER (PARTITION BY symbol, minute // 1440 ORDER BY minute) = 1),
    a AS (SELECT e.symbol, e.day, max(t.ms) AS baseline_ms FROM e JOIN t ON t.symbol = e.symbol AND t.ms // 60000 = e.base_minute AND abs(t.price - base_low) <= 1e-12 * base_low GROUP BY 1, 2),
    c AS (SELECT e.symbol, e.day, min(t.ms) AS cross_ms, arg_min(t.price, (t.ms, t.seq)) AS crossing_trade_price FROM e JOIN t ON t.symbol = e.symbol AND t.ms // 60000 = e.minute AND t.price + 1e-12 * base_low >= threshold GROUP BY 1, 2),
    s AS (SELECT c.symbol, c.day, sum(t.price * t.size) FILTER (t.seller) AS sold, min(t.ms) FILTER (t.seller) AS first_at FROM c JOIN t ON t.symbol = c.symbol AND t.ms >= c.cross_ms AND t.ms <= c.cross_ms + 86400000 GROUP BY 1, 2)
    SELECT e.symbol, e.day, e.minute, e.base_minute, e.base_low, a.baseline_ms, c.cross_ms, c.crossing_trade_price, round(coalesce(sold, 0), 4) AS seller_notional_any_price, first_at AS first_seller_exit_at, coalesce((cross_ms - baseline_ms) / 1000 > 0 AND (cross_ms - baseline_ms) / 1000 <= 28800, FALSE) AS exact_window_pass, coalesce((cross_ms - baseline_ms) / 1000 > 0 AND (cross_ms - baseline_ms) / 1000 <= 28800, FALSE) AND coalesce(sold, 0) >= 100 AS sellability_pass
    FROM e LEFT JOIN a USING (symbol, day) LEFT JOIN c USING (symbol, day) LEFT JOIN s USING (symbol, day)""".replace("{{", "{").replace("}}", "}"),
)
def x01(spark, sf):
    from tidemark.operators import cohorts

    t = ticks(spark, sf).where("price > 0").select((F.col("symbol") % 10).alias("symbol"), F.expr("us div 1000").alias("ms"), "seq", "price", (F.col("seq") % 7 + 1).cast("double").alias("size"), (F.col("seq") % 2 == 0).alias("seller"))
    b = t.groupBy("symbol", F.expr("ms div 60000").alias("minute")).agg(F.max("price").alias("high"), F.min("price").alias("low"))
    x = cohorts.surge_scan(b, t, "symbol", "scan", confirm_s=86400, target=100.0)
    return x.select("symbol", "day", "minute", "base_minute", "base_low", "baseline_ms", "cross_ms", "crossing_trade_price", F.round("seller_notional_any_price", 4).alias("seller_notional_any_price"), "first_seller_exit_at", "exact_window_pass", "sellability_pass")


def _hour_grid(spark, sf):
    from tidemark.operators import ordered, surge
    from tidemark.plans.features import bars

    grid = ordered.dense_grid(bars(spark, sf), ["symbol"], "step", 1)
    return surge.crossing_mask(grid, ["symbol"], "step", 3, 30.0)


@query(
    "j10_candidate_quality",
    f"""WITH b AS (SELECT symbol % 8 AS symbol, sec // 3600 AS step, max(price) AS high, min(price) AS low, sum(price) AS q FROM ({TICKS}) WHERE price > 0 GROUP BY 1, 2), r AS (SELECT symbol, min(step) AS a, max(step) AS z FROM b GROUP BY 1), g AS (SELECT r.symbol, s.step FROM r, LATERAL (SELECT unnest(generate_series(r.a, r.z)) AS step) s),
    d AS (SELECT g.symbol, g.step, b.high, b.low, b.q, b.low IS NOT NULL AS seen FROM g LEFT JOIN b USING (symbol, step)), m AS (SELECT *, coalesce(sum(seen::INT) OVER w = 2 AND high >= min(low) OVER w * 30, FALSE) AS crossing FROM d WINDOW w AS (PARTITION BY symbol ORDER BY step ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING)),
    n AS (SELECT seq AS event, symbol % 8 AS symbol, sec // 3600 AS step FROM ({TICKS}) WHERE kind = 'signup'),
    k AS (SELECT n.event, r.a, r.z, n.step, count(*) FILTER (m.step BETWEEN n.step - 2 AND n.step + 1 AND seen) AS lo, count(*) FILTER (m.step BETWEEN n.step - 2 AND n.step + 1 AND crossing) AS lc, count(*) FILTER (m.step BETWEEN n.step - 26 AND n.step - 3 AND seen) AS ho, count(*) FILTER (m.step BETWEEN n.step - 4 AND n.step - 3 AND seen) AS e1, count(*) FILTER (m.step BETWEEN n.step - 3 AND n.step - 2 AND seen) AS e0, sum(m.q) FILTER (m.step BETWEEN n.step - 4 AND n.step - 3) AS q1, sum(m.q) FILTER (m.step BETWEEN n.step - 3 AND n.step - 2) AS q0 FROM n JOIN r ON r.symbol = n.symbol LEFT JOIN m ON m.symbol = n.symbol AND m.step BETWEEN n.step - 26 AND n.step + 1 GROUP BY 1, 2, 3, 4),
    c AS (SELECT event, CASE WHEN step - 2 < a OR step + 1 > z THEN 'outside_loaded_range' WHEN lo < 4 THEN 'missing_local_minutes' WHEN lc > 0 THEN 'near_25pct_crossing' WHEN step - 26 < a OR ho / 24 < 0.6 THEN 'insufficient_prior_history' WHEN e0 < 2 OR e1 < 2 THEN 'missing_entry_liquidity' WHEN least(q0, q1) < 100 THEN 'below_entry_liquidity_floor' ELSE 'pass' END AS reason, ho / 24 AS share, least(q0, q1) AS low FROM k)
    SELECT event, reason, CASE WHEN reason IN ('pass', 'below_entry_liquidity_floor') THEN round(share, 6) END AS observed_fraction, CASE WHEN reason IN ('pass', 'below_entry_liquidity_floor') THEN round(low, 4) END AS minimum_liquidity FROM c""",
)
def j10(spark, sf):
    from tidemark.operators import cohorts
    from tidemark.plans.features import samples

    x = cohorts.candidate_quality(samples(spark, sf).withColumnRenamed("sample_id", "event"), _hour_grid(spark, sf), "symbol", "step", "step", (1, 2), 24, 1, 1, 100.0, 2, 0.6)
    return x.select("event", "reason", F.round("observed_fraction", 6).alias("observed_fraction"), F.round("minimum_liquidity", 4).alias("minimum_liquidity"))


@query("x02_matched_controls")
def x02(spark, sf):
    from tidemark.operators import cohorts, surge
    from tidemark.plans.features import bars

    # every first surge of a key and day is an event
    e = surge.first_rolling_surge(bars(spark, sf), ["symbol"], "step", F.expr("step div 24"), 3, 300.0)
    e = e.select("symbol", (F.col("step") * 100 + F.col("symbol")).alias("event"), (F.col("step") * 3600).alias("sec"))
    picks, _ = cohorts.matched_controls(e, _hour_grid(spark, sf), "symbol", "step", (1, 2), 24, 1, 1, 0.0, 5, 3600, 2, 0.5)
    return picks


@query(
    "a33_window_audit",
    f"""WITH b AS (SELECT symbol % 8 AS symbol, sec // 3600 AS step, max(price) AS high, min(price) AS low FROM ({TICKS}) WHERE price > 0 GROUP BY 1, 2), s AS (SELECT seq AS sample_id, symbol % 8 AS symbol, sec // 3600 - 12 AS a, sec // 3600 AS z, seq % 2 = 0 AS control FROM ({TICKS}) WHERE kind = 'signup'),
    x AS (SELECT s.*, b.high, min(b.low) OVER (PARTITION BY sample_id ORDER BY b.step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS base FROM s JOIN b ON b.symbol = s.symbol AND b.step BETWEEN s.a AND s.z), y AS (SELECT sample_id, count(*) AS n, max((high / base - 1) * 100) AS g FROM x GROUP BY 1)
    SELECT sample_id, round(coalesce(n, 0) / 13, 6) AS observed, CASE WHEN n > 0 THEN coalesce(g >= 25, FALSE) END AS crossed, round(g, 4) AS gain, control AND (coalesce(coalesce(g >= 25, FALSE), TRUE) OR coalesce(n, 0) / 13 < 0.99) AS contaminated FROM s LEFT JOIN y USING (sample_id)""",
)
def a33(spark, sf):
    from tidemark.operators import cohorts
    from tidemark.plans.features import bars, samples

    s = samples(spark, sf).withColumns({"a": F.col("step") - 12, "sample_type": F.when(F.col("sample_id") % 2 == 0, "control").otherwise("event")})
    x = cohorts.pseudo_window_audit(s, bars(spark, sf), "symbol", "step", "a", "step", longest=13)
    return x.select("sample_id", F.round("pseudo_window_observed_fraction", 6).alias("observed"), F.col("pseudo_window_crossing_detected").alias("crossed"), F.round("pseudo_window_max_sequential_gain_pct", 4).alias("gain"), F.col("pseudo_window_contaminated_control").alias("contaminated"))


#: The reference's offsets and horizons with hours for minutes and a shorter history.
X04_OFFSETS, X04_HORIZONS = (240, 168, 120, 72, 48, 24, 12, 8, 6, 3, 1, 0), (1, 2, 3, 4, 6, 8)
X04 = ["entry_price", "ret_24m_pct", "quote_volume_72m", "outcome_baseline_to_cross_observed_fraction", "outcome_baseline_to_cross_max_gain_from_baseline_minute_low_pct", "outcome_baseline_to_cross_max_drawdown_from_baseline_minute_close_pct", "outcome_next_8h_from_baseline_observed_fraction", "outcome_next_8h_from_baseline_max_gain_from_baseline_minute_low_pct", "outcome_next_8h_from_baseline_max_drawdown_from_baseline_minute_close_pct", "outcome_snapshot_to_cross_max_gain_pct"]


@query(
    "x04_baseline_context",
    f"""WITH b AS (SELECT symbol % 8 AS symbol, sec // 3600 AS step, max(price) AS high, min(price) AS low, arg_max(price, (us, seq)) AS close, sum(price) AS quote_volume FROM ({TICKS}) WHERE price > 0 GROUP BY 1, 2), s AS (SELECT seq AS sample_id, symbol % 8 AS symbol, sec // 3600 - 6 AS baseline, sec // 3600 AS crossing, seq % 2 = 0 AS control FROM ({TICKS}) WHERE kind = 'signup'),
    k AS (SELECT unnest({list(X04_OFFSETS)}) AS before_, TRUE AS early UNION ALL SELECT unnest({list(X04_HORIZONS)}), FALSE), r AS (SELECT s.*, early, before_, CASE WHEN early THEN baseline ELSE crossing END - before_ - 1 AS at_ FROM s CROSS JOIN k),
    e AS (SELECT r.*, c.close AS entry_price, (c.close / l.close - 1) * 100 AS ret FROM r LEFT JOIN b c ON c.symbol = r.symbol AND c.step = r.at_ LEFT JOIN b l ON l.symbol = r.symbol AND l.step = r.at_ - 24),
    v AS (SELECT r.sample_id, r.early, r.before_, sum(b.quote_volume) FILTER (b.step > at_ - 72) AS q, count(*) AS seen FROM r JOIN b ON b.symbol = r.symbol AND b.step <= at_ AND b.step > at_ - 240 GROUP BY 1, 2, 3),
    x AS (SELECT s.sample_id, b.high, min(b.low) OVER (PARTITION BY s.sample_id ORDER BY b.step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS base FROM s JOIN b ON b.symbol = s.symbol AND b.step BETWEEN baseline AND crossing),
    a AS (SELECT s.sample_id, control AND (n IS NULL OR g >= 25 OR n / 7 < 0.99) AS bad FROM s LEFT JOIN (SELECT sample_id, count(*) AS n, coalesce(max((high / base - 1) * 100), 0) AS g FROM x GROUP BY 1) USING (sample_id)),
    m AS (SELECT s.sample_id, count(*) FILTER (b.step <= crossing) AS n7, max(b.high) FILTER (b.step <= crossing) AS top7, min(b.low) FILTER (b.step <= crossing) AS floor7, count(*) AS n8, max(b.high) AS top8, min(b.low) AS floor8, max(b.low) FILTER (b.step = baseline) AS low, max(b.close) FILTER (b.step = baseline) AS close FROM s JOIN b ON b.symbol = s.symbol AND b.step BETWEEN baseline AND baseline + 7 GROUP BY 1)
    SELECT e.sample_id, CASE WHEN early THEN 'baseline_start' ELSE 'pre_cross_snapshot' END AS analysis_alignment, CASE WHEN NOT early THEN 'pre_cross' WHEN before_ = 0 THEN 'baseline_start' ELSE 'pre_baseline' END AS decision_stage, CASE WHEN early THEN before_ END AS baseline_snapshot_offset_minutes, CASE WHEN NOT early THEN before_ END AS pre_cross_horizon_minutes, a.bad AS pseudo_window_contaminated_control,
    CASE WHEN a.bad THEN 'contaminated_control' WHEN entry_price IS NULL THEN 'missing_decision_bar' WHEN seen / 240 >= 0.995 THEN 'pass' WHEN seen / 240 >= 0.98 THEN 'warning' ELSE 'insufficient_history' END AS feature_quality_status,
    round(entry_price, 5) AS entry_price, round(CASE WHEN entry_price IS NOT NULL THEN ret END, 5) AS ret_24m_pct, round(CASE WHEN entry_price IS NOT NULL THEN q END, 5) AS quote_volume_72m,
    round(CASE WHEN early THEN coalesce(n7, 0) / 7 END, 5) AS outcome_baseline_to_cross_observed_fraction, round(CASE WHEN early THEN (top7 / low - 1) * 100 END, 5) AS outcome_baseline_to_cross_max_gain_from_baseline_minute_low_pct, round(CASE WHEN early THEN (floor7 / close - 1) * 100 END, 5) + 0.0 AS outcome_baseline_to_cross_max_drawdown_from_baseline_minute_close_pct,
    round(CASE WHEN early THEN coalesce(n8, 0) / 8 END, 5) AS outcome_next_8h_from_baseline_observed_fraction, round(CASE WHEN early THEN (top8 / low - 1) * 100 END, 5) AS outcome_next_8h_from_baseline_max_gain_from_baseline_minute_low_pct, round(CASE WHEN early THEN (floor8 / close - 1) * 100 END, 5) + 0.0 AS outcome_next_8h_from_baseline_max_drawdown_from_baseline_minute_close_pct, round(CASE WHEN early THEN (top7 / entry_price - 1) * 100 END, 5) AS outcome_snapshot_to_cross_max_gain_pct
    FROM e JOIN a USING (sample_id) LEFT JOIN v USING (sample_id, early, before_) LEFT JOIN m USING (sample_id)""",
)
def x04(spark, sf):
    from tidemark.operators import cohorts
    from tidemark.plans.features import COARSE, DAY, bars, samples

    s = samples(spark, sf).select("sample_id", "symbol", (F.col("step") - 6).alias("baseline"), F.col("step").alias("cross"), F.when(F.col("sample_id") % 2 == 0, "control").otherwise("event").alias("sample_type"))
    x = cohorts.baseline_context(s, bars(spark, sf), "symbol", "step", X04_OFFSETS, X04_HORIZONS, 8, windows=(24, 72), day=DAY, hour=COARSE, same=(2, 4), horizon=8, liquidity=1)
    return rounded(x.select("sample_id", "analysis_alignment", "decision_stage", "baseline_snapshot_offset_minutes", "pre_cross_horizon_minutes", "pseudo_window_contaminated_control", "feature_quality_status", *X04), 5)


@query(
    "x07_sellability_study",
    f"""WITH e AS (SELECT seq AS event, symbol % 40 AS symbol, us * 1000 AS t0, us * 1000 + 172800000000000 AS t1, 30.0 AS thr FROM ({TICKS}) WHERE kind = 'signup'), q AS (SELECT symbol % 40 AS symbol, us * 1000 AS t, seq, price - seq % 3 AS bid, seq % 90 + 1 AS size FROM ({TICKS}) WHERE kind = 'view'), p AS (SELECT symbol % 40 AS symbol, us * 1000 AS t, seq, price, seq % 9 AS size FROM ({TICKS}) WHERE kind = 'purchase'),
    a AS (SELECT e.event, t0, t1, thr, t0 AS start, -1 AS seq, arg_max(q.bid, (q.t, q.seq)) AS bid, arg_max(q.size, (q.t, q.seq)) AS size FROM e JOIN q ON q.symbol = e.symbol AND q.t <= e.t0 GROUP BY 1, 2, 3, 4), l AS (SELECT e.event, t0, t1, thr, q.t AS start, q.seq, q.bid, q.size FROM e JOIN q ON q.symbol = e.symbol AND q.t > e.t0 AND q.t <= e.t1),
    s AS (SELECT *, coalesce(lead(start) OVER (PARTITION BY event ORDER BY start, seq), t1) AS stop FROM (SELECT * FROM a UNION ALL SELECT * FROM l)),
    n AS (SELECT e.event, p.* FROM e JOIN p ON p.symbol = e.symbol AND p.t >= e.t0 AND p.t <= e.t1), c AS (SELECT s.*, EXISTS (SELECT 1 FROM n WHERE n.event = s.event AND n.price >= thr AND n.t > s.start AND n.t <= s.stop) AS sure FROM s),
    g AS (SELECT event, max(bid) AS max_bid, bool_or(bid >= thr AND bid * size >= 500) AS shown, min(start) FILTER (bid >= thr AND bid * size >= 500 AND sure) AS first_at, arg_min(bid, start) FILTER (bid >= thr AND bid * size >= 500 AND sure) AS first_bid, sum(stop - start) FILTER (bid >= thr) / 1e9 AS displayed FROM c GROUP BY 1), h AS (SELECT event, count(*) FILTER (price >= 30) AS hits, CAST(coalesce(sum(size) FILTER (price >= 30), 0) AS BIGINT) AS volume FROM n GROUP BY 1)
    SELECT e.event, e.symbol, CASE WHEN first_at IS NOT NULL THEN 'confirmed_sellable' WHEN coalesce(shown, FALSE) THEN 'displayed_bid_only' WHEN coalesce(hits, 0) > 0 THEN 'trade_only' ELSE 'not_confirmed' END AS status, first_at AS first_confirmed_exit_at, first_bid AS first_confirmed_exit_bid, round(coalesce(displayed, 0), 3) AS displayed_seconds, coalesce(max_bid, 0) AS max_bid_price, coalesce(hits, 0) AS trade_count_at_or_above_threshold, coalesce(volume, 0) AS trade_volume_at_or_above_threshold FROM e LEFT JOIN g USING (event) LEFT JOIN h USING (event)""",
)
def x07(spark, sf):
    from tidemark.operators import cohorts

    e = ticks(spark, sf, "signup").select(F.col("seq").alias("event"), (F.col("symbol") % 40).alias("symbol"), (F.col("us") * 1000).alias("cross"), F.lit(30.0).alias("threshold"))
    q = quotes(spark, sf, 1000).select("symbol", "at", "seq", "bid_price", "bid_size_shares")
    t = ticks(spark, sf, "purchase").select((F.col("symbol") % 40).alias("symbol"), (F.col("us") * 1000).alias("at"), "seq", "price", (F.col("seq") % 9).alias("size"))
    x = cohorts.sellability_study(e, q, t, "symbol", 172800)
    return x.select("event", "symbol", "status", "first_confirmed_exit_at", "first_confirmed_exit_bid", F.round("displayed_seconds", 3).alias("displayed_seconds"), "max_bid_price", "trade_count_at_or_above_threshold", "trade_volume_at_or_above_threshold")


@query("j24_midday_candidates", "WITH d AS (SELECT o_custkey % 50 AS symbol, CAST(o_orderdate AS DATE) AS day, max(o_totalprice) AS high, arg_max(o_totalprice, o_orderkey) AS close FROM orders GROUP BY 1, 2), p AS (SELECT symbol, arg_min(close, day) AS close FROM d GROUP BY 1), t AS (SELECT symbol, arg_max(high, day) AS high, arg_max(close, day) AS price FROM d GROUP BY 1), x AS (SELECT symbol, price AS decision_price, p.close AS prior_close, (price / p.close - 1) * 100 AS signal_value FROM p JOIN t USING (symbol) WHERE t.high >= p.close * (1 + 13.776879223878035 / 100)) SELECT symbol, decision_price, prior_close, round(signal_value, 6) AS signal_value, CAST(row_number() OVER (ORDER BY signal_value DESC, symbol) AS INTEGER) AS rank FROM x WHERE signal_value > 13.776879223878035")
def j24(spark, sf):
    from tidemark.operators import cohorts

    d = load(spark, sf, "orders").groupBy((F.col("o_custkey") % 50).alias("symbol"), F.col("o_orderdate").cast("date").alias("day")).agg(F.max("o_totalprice").alias("high"), F.max_by("o_totalprice", "o_orderkey").alias("close"))
    prior, today = d.groupBy("symbol").agg(F.min_by("close", "day").alias("close")), d.groupBy("symbol").agg(F.max_by("high", "day").alias("high"), F.max_by("close", "day").alias("price"))
    x = cohorts.day_candidates(prior, today, prior, today.select("symbol", "price"))
    return x.withColumn("signal_value", F.round("signal_value", 6))


@query(
    "a24_minute_summary",
    f"""WITH b AS (SELECT symbol % 20 AS symbol, sec // 60 AS t_, arg_min(price, (us, seq)) AS open, max(price) AS high, min(price) AS low, arg_max(price, (us, seq)) AS close, sum(seq % 5) AS volume, count(*) AS n FROM ({TICKS}) GROUP BY 1, 2), x AS (SELECT *, ln(close / lag(close) OVER (PARTITION BY symbol ORDER BY t_)) AS r, CASE WHEN t_ % 1440 < 720 THEN 'premarket' ELSE 'regular' END AS s FROM b WHERE close > 0),
    m AS (SELECT symbol, string_agg(s || '=' || n || '/' || v, ',' ORDER BY s) AS sessions FROM (SELECT symbol, s, count(*) AS n, CAST(sum(volume) AS BIGINT) AS v FROM x GROUP BY 1, 2) GROUP BY 1)
    SELECT symbol, count(*) AS bar_count, arg_min(open, t_) AS first_open, arg_max(close, t_) AS last_close, max(high) AS high, min(low) AS low, round(CASE WHEN count(r) >= 2 THEN stddev_samp(r) ELSE 0 END, 6) AS realized_vol, round(max(abs(r)), 6) AS max_abs, CAST(sum(volume) AS BIGINT) AS volume, any_value(sessions) AS sessions FROM x JOIN m USING (symbol) GROUP BY 1""",
)
def a24(spark, sf):
    from tidemark.operators import surge

    t = ticks(spark, sf).withColumn("symbol", F.col("symbol") % 20)
    b = surge.bars(t, ["symbol"], F.expr("sec div 60"), "price", ["us", "seq"], "at").withColumnRenamed("n", "trade_count")
    v = t.groupBy("symbol", F.expr("sec div 60").alias("at")).agg(F.sum(F.col("seq") % 5).alias("volume"))
    b = b.join(v, ["symbol", "at"]).where("close > 0").withColumn("session", F.when(F.col("at") % 1440 < 720, "premarket").otherwise("regular"))
    x = tape.minute_summary(b, ["symbol"], "at")
    each = F.transform(F.map_entries("session_bar_counts"), lambda e: F.concat(e["key"], F.lit("="), e["value"], F.lit("/"), F.element_at("session_volume", e["key"])))
    return x.select("symbol", "bar_count", "first_open", "last_close", "high", "low", F.round("realized_vol", 6).alias("realized_vol"), F.round("max_abs_one_min_log_return", 6).alias("max_abs"), "volume", F.concat_ws(",", each).alias("sessions"))


@query(
    "a25_second_microstructure",
    f"""WITH q AS (SELECT symbol % 20 AS symbol, us // 1000000 AS s, min(CASE WHEN seq % 9 = 0 THEN NULL ELSE seq % 4 END)::DOUBLE AS spread, arg_max(seq % 30, (us, seq)) AS bs, count(*) AS u FROM ({TICKS}) WHERE kind = 'view' GROUP BY 1, 2), t AS (SELECT symbol % 20 AS symbol, us // 1000000 AS s, sum(seq % 50) AS v, count(*) AS n FROM ({TICKS}) WHERE kind = 'purchase' GROUP BY 1, 2),
    x AS (SELECT coalesce(t.symbol, q.symbol) AS symbol, coalesce(n, 0) AS n, coalesce(v, 0) AS v, coalesce(u, 0) AS u, spread, bs FROM t FULL JOIN q ON t.symbol = q.symbol AND t.s = q.s)
    SELECT symbol, count(*) AS active_seconds, count(*) FILTER (n > 0) AS trade_seconds, count(*) FILTER (u > 0) AS quote_seconds, CAST(sum(n) AS BIGINT) AS trade_count, CAST(sum(v) AS BIGINT) AS trade_volume, max(n) AS max_trades_per_second, CAST(max(v) AS BIGINT) AS max_volume_per_second, median(spread) AS median_spread, round(quantile_cont(spread, 0.9), 6) AS p90_spread, median(bs) AS median_bid_depth_shares FROM x GROUP BY 1""",
)
def a25(spark, sf):
    x = ticks(spark, sf).withColumns({"symbol": F.col("symbol") % 20, "at": F.col("us") * 1000})
    t = x.where("kind = 'purchase'").select("symbol", "at", "seq", "price", (F.col("seq") % 50).alias("size"))
    q = x.where("kind = 'view'").select("symbol", "at", "seq", F.col("price").alias("bid_price"), (F.col("seq") % 30).alias("bid_size_shares"), F.col("price").alias("ask_price"), F.lit(1).cast("long").alias("ask_size_shares"), F.when(F.col("seq") % 9 != 0, (F.col("seq") % 4).cast("double")).alias("spread"))
    y = tape.microstructure(tape.second_summary(t, q, ["symbol"], "at", "seq"), ["symbol"])
    return y.select("symbol", "active_seconds", "trade_seconds", "quote_seconds", "trade_count", "trade_volume", "max_trades_per_second", "max_volume_per_second", "median_spread", F.round("p90_spread", 6).alias("p90_spread"), "median_bid_depth_shares")
