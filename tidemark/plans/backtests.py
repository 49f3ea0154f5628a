"""Queries over the execution backtest and the entry assessment: events as the tape of stocks, ten users each, on New York days."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import backtest, tape
from tidemark.plans.catalog import query
from tidemark.plans.tables import rounded, ticks
from tidemark.sources.shared import Scratch

#: An order may leave on the close's last quote if that is at most three hours old: the tape is thin.
STALE = 10_800.0


def market(spark, sf) -> dict:
    """trades, quotes, minute bars, daily bars, assets and calendar of the tape."""
    t = ticks(spark, sf).withColumns({"symbol": F.expr("symbol div 10"), "trade_date": F.to_date(F.from_utc_timestamp(F.timestamp_micros("us"), "America/New_York"))}).withColumnRenamed("us", "at")
    seq = F.col("seq")
    trades = t.where(F.col("kind").isin("purchase", "click", "error")).select("symbol", "trade_date", "at", "seq", "price", (seq % 90 * 20).alias("size"))
    quotes = t.where(F.col("kind").isin("view", "signup")).select("symbol", "trade_date", "at", "seq", (F.col("price") - seq % 3).alias("bid_price"), (seq % 90 + 1).alias("bid_size_shares"), F.col("price").alias("ask_price"), (seq % 70).alias("ask_size_shares"))
    key = F.struct("at", "seq")
    bars = trades.groupBy("symbol", "trade_date", (F.expr("at div 60000000") * 60_000_000).alias("at")).agg(F.max_by("price", F.struct(trades["at"], "seq")).alias("close"), F.sum("size").alias("volume"))
    daily = trades.groupBy("symbol", "trade_date").agg(F.min_by("price", key).alias("open"), F.max("price").alias("high"), F.max_by("price", key).alias("close"))
    split = F.when((F.col("symbol") + F.day("trade_date")) % 11 == 0, 1.5).otherwise(1.0)
    daily = daily.withColumns({"raw_open": F.col("open") / split, "raw_close": F.col("close") / split})
    s = F.col("symbol")
    assets = t.where(s % 13 != 12).select("symbol").distinct().select("symbol", (s % 3 != 0).alias("fractionable"), (s % 5 != 0).alias("tradable"), F.when(s % 4 == 1, "inactive").otherwise("active").alias("status"))
    return {"trades": trades, "quotes": quotes, "bars": bars, "daily": daily, "assets": assets, "calendar": backtest.sessions(daily, "trade_date")}


def run(spark, sf, part: str):
    """One part of the backtest; what several parts read is written in between."""
    m = market(spark, sf)
    with Scratch(spark, "backtest") as s:
        x = backtest.backtest(*(m[k] for k in ("daily", "bars", "trades", "quotes", "calendar", "assets")), stale=STALE, write=s.cut)
        return s.keep(s.cut(getattr(x, part)))


# All events lie in one January: New York is five hours behind, London is at UTC.
HOUR = 3_600_000_000
MARKET = f"""e AS MATERIALIZED (SELECT user_id // 10 AS symbol, event_id AS seq, epoch_us(ts) AS us, CAST(ts - INTERVAL 5 HOUR AS DATE) AS d, value AS price, event_type AS kind FROM events),
    t AS MATERIALIZED (SELECT symbol, d, us, seq, price, seq % 90 * 20 AS size FROM e WHERE kind IN ('purchase', 'click', 'error')),
    q AS MATERIALIZED (SELECT symbol, d, us, seq, price - seq % 3 AS bid, seq % 90 + 1 AS bs, price AS ask, seq % 70 AS asz FROM e WHERE kind IN ('view', 'signup')),
    b AS MATERIALIZED (SELECT symbol, d, us // 60000000 * 60000000 AS m, arg_max(price, (us, seq)) AS c, sum(size) AS v FROM t GROUP BY 1, 2, 3),
    dl AS MATERIALIZED (SELECT symbol, d, max(price) AS h, arg_min(price, (us, seq)) AS o, arg_max(price, (us, seq)) AS c FROM t WHERE symbol % 13 <> 12 GROUP BY 1, 2),
    dd AS MATERIALIZED (SELECT DISTINCT d FROM dl), pr AS MATERIALIZED (SELECT x.d, max(y.d) AS p FROM dd x JOIN dd y ON y.d < x.d AND y.d >= x.d - 10 GROUP BY 1),
    u AS MATERIALIZED (SELECT dl.symbol, dl.d, dl.h, y.c AS pc, (dl.symbol + day(dl.d)) % 11 <> 0 AS eligible, epoch_us(CAST(dl.d AS TIMESTAMP)) AS z FROM dl JOIN pr USING (d) JOIN dl y ON y.symbol = dl.symbol AND y.d = pr.p),
    ok AS MATERIALIZED (SELECT * FROM u WHERE eligible),
    act AS MATERIALIZED (SELECT DISTINCT ok.symbol, ok.d, pc, z FROM ok JOIN b ON b.symbol = ok.symbol AND b.d = ok.d AND v > 0 AND m >= z + 9 * {HOUR} AND m < z + 14 * {HOUR} + 1000000),
    ts_ AS MATERIALIZED (SELECT t.symbol, t.d, us // 1000000 AS s, arg_max(price, (us, seq)) AS l, sum(size) AS v FROM t JOIN act USING (symbol, d) WHERE price > 0 AND size > 0 AND us >= z + 9 * {HOUR} AND us < z + 14 * {HOUR} + 1000000 GROUP BY 1, 2, 3),
    rv AS MATERIALIZED (SELECT symbol, d, CAST(sum(v) AS BIGINT) AS volume, count(*) AS n, sqrt(coalesce(sum(r * r), 0)) AS rv FROM (SELECT *, ln(l / lag(l) OVER (PARTITION BY symbol, d ORDER BY s)) AS r FROM ts_) GROUP BY 1, 2),
    qs AS MATERIALIZED (SELECT q.symbol, q.d, us // 1000000 AS s, min(ask - bid) / arg_max((ask + bid) / 2, (us, seq)) * 1e4 AS bps FROM q JOIN act USING (symbol, d) WHERE bid > 0 AND ask >= bid AND us >= z + 9 * {HOUR} AND us < z + 14 * {HOUR} + 1000000 GROUP BY 1, 2, 3),
    sp AS MATERIALIZED (SELECT symbol, d, median(bps) AS bps FROM qs GROUP BY 1, 2),
    pre AS MATERIALIZED (SELECT symbol, d, pc, z, ((ln(1 + volume) - 8.18382400) / 4.74614788 - (ln(1 + bps) - 6.35332542) / 1.52922959 + (rv - 0.18287512) / 0.22326549) / 3 AS signal_value FROM act JOIN rv USING (symbol, d) JOIN sp USING (symbol, d)),
    lb AS MATERIALIZED (SELECT ok.symbol, ok.d, arg_max(b.c, m) AS c FROM ok JOIN b USING (symbol, d) WHERE m >= z + 14.5 * {HOUR} AND m < z + 17 * {HOUR} GROUP BY 1, 2),
    lt AS MATERIALIZED (SELECT ok.symbol, ok.d, arg_max(price, (us, seq)) AS c FROM ok JOIN t USING (symbol, d) WHERE price > 0 AND us >= z + 17 * {HOUR} AND us < z + 17 * {HOUR} + 1000000 GROUP BY 1, 2),
    mid AS MATERIALIZED (SELECT ok.symbol, ok.d, pc, z, (coalesce(lt.c, lb.c) / pc - 1) * 100 AS signal_value FROM ok JOIN lb USING (symbol, d) LEFT JOIN lt USING (symbol, d) WHERE pc > 0),
    raw AS MATERIALIZED (SELECT 'preopen' AS strategy, *, z + 52205000000 AS from_ FROM pre WHERE signal_value >= {backtest.PREOPEN_THRESHOLD} UNION ALL SELECT 'midday', *, z + 61205000000 FROM mid WHERE signal_value > {backtest.MIDDAY_THRESHOLD_PCT}),
    g AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY strategy, d ORDER BY signal_value DESC, symbol) AS rank FROM raw)"""

RUN = f"""{MARKET},
    v AS MATERIALIZED (SELECT g.strategy, g.d, g.symbol, pc * 1.25 AS target, (z + 75300000000) / 1e6 AS by_, g.symbol % 3 <> 0 AS part, q.us / 1e6 AS us, q.seq, bid, bs, ask, asz, slip FROM g JOIN q ON q.symbol = g.symbol AND q.d = g.d CROSS JOIN (SELECT unnest([0.0, 5.0, 10.0])::DOUBLE AS slip) WHERE rank <= 5 AND bid > 0 AND ask > 0 AND ask >= bid AND us >= from_ AND us <= z + 75300000000),
    c AS MATERIALIZED (SELECT *, ask * (1 + slip / 10000) AS fill, CASE WHEN part THEN 500 / (ask * (1 + slip / 10000)) ELSE floor(500 / (ask * (1 + slip / 10000))) END AS shares FROM v),
    n AS MATERIALIZED (SELECT strategy, d, symbol, slip, arg_min({{'us': us, 'seq': seq, 'ask': ask, 'fill': fill, 'shares': shares}}, (us, seq)) AS i FROM c WHERE ask < target AND ask * asz + 1e-9 >= 500 AND shares > 0 AND ask * asz + 1e-9 >= shares * ask GROUP BY 1, 2, 3, 4),
    a AS MATERIALIZED (SELECT c.*, n.i, bid >= target AS won, bid <= n.i.fill * 0.95 AS lost, bs + 1e-9 >= n.i.shares AS deep FROM c JOIN n USING (strategy, d, symbol, slip) WHERE (us, seq) >= (n.i.us, n.i.seq)),
    o AS MATERIALIZED (SELECT strategy, d, symbol, slip, arg_min({{'us': us, 'seq': seq, 'bid': bid, 'why': CASE WHEN won THEN 'target' ELSE 'stop' END}}, (us, seq)) AS o FROM a WHERE (won OR lost) AND deep GROUP BY 1, 2, 3, 4),
    h AS MATERIALIZED (SELECT a.*, o.o FROM a LEFT JOIN o USING (strategy, d, symbol, slip) WHERE o.o IS NULL OR (a.us, a.seq) <= (o.o.us, o.o.seq)),
    w AS MATERIALIZED (SELECT strategy, d, symbol, slip, any_value(i) AS i, any_value(o) AS o, any_value(by_) AS by_, arg_max({{'us': us, 'bid': bid}}, (us, seq)) FILTER (deep) AS l FROM h GROUP BY 1, 2, 3, 4),
    x AS MATERIALIZED (SELECT *, CASE WHEN o IS NOT NULL THEN o.why WHEN by_ - l.us <= {STALE} THEN 'time' END AS why, CASE WHEN o IS NOT NULL THEN o.bid WHEN by_ - l.us <= {STALE} THEN l.bid END AS bid FROM w),
    y AS MATERIALIZED (SELECT *, bid * (1 - slip / 10000) AS out_, i.shares * (bid * (1 - slip / 10000) - i.fill) AS pnl FROM x),
    tr AS MATERIALIZED (SELECT g.strategy, g.d, g.symbol, g.rank, m.i IS NOT NULL AS filled, m.i, m.why, m.bid, (m.out_ / m.i.fill - 1) * 100 AS ret, m.pnl, p0.pnl AS pnl_0bps, p10.pnl AS pnl_10bps FROM g LEFT JOIN y m ON m.strategy = g.strategy AND m.d = g.d AND m.symbol = g.symbol AND m.slip = 5 LEFT JOIN y p0 ON p0.strategy = g.strategy AND p0.d = g.d AND p0.symbol = g.symbol AND p0.slip = 0 LEFT JOIN y p10 ON p10.strategy = g.strategy AND p10.d = g.d AND p10.symbol = g.symbol AND p10.slip = 10 WHERE g.rank <= 5)"""


@query("x10_triggers", f"WITH {MARKET} SELECT strategy, CAST(d AS VARCHAR) AS trade_date, symbol, rank, rank <= 5 AS selected, round(signal_value, 6) AS signal_value, pc AS prior_close FROM g")
def x10_triggers(spark, sf):
    x = run(spark, sf, "triggers")
    return x.select("strategy", F.col("trade_date").cast("string").alias("trade_date"), "symbol", F.col("rank").cast("long").alias("rank"), "selected", F.round("signal_value", 6).alias("signal_value"), "prior_close")


@query(
    "x10_trades",
    f"WITH {RUN} SELECT strategy, CAST(d AS VARCHAR) AS trade_date, symbol, rank, filled, CASE WHEN NOT filled THEN 'no_executable_subthreshold_ask' WHEN bid IS NULL THEN 'no_executable_close_exit' END AS unfilled_reason, round(i.us, 6) AS entry_at, round(i.fill, 6) AS entry_price, round(i.shares, 6) AS shares, why AS exit_reason, bid AS exit_bid, round(ret, 6) AS return_pct, round(pnl, 4) AS pnl_usd, round(pnl_0bps, 4) AS pnl_0bps, round(pnl_10bps, 4) AS pnl_10bps, concat_ws(',', CASE WHEN symbol % 5 = 0 THEN 'point_in_time_tradability_unverified' END, CASE WHEN symbol % 4 = 1 THEN 'inactive_current_asset' END) AS quality_flags FROM tr",
)
def x10_trades(spark, sf):
    x = run(spark, sf, "trades")
    r = lambda c, d: F.round(c, d).alias(c)
    return x.select("strategy", F.col("trade_date").cast("string").alias("trade_date"), "symbol", F.col("rank").cast("long").alias("rank"), "filled", "unfilled_reason", r("entry_at", 6), r("entry_price", 6), r("shares", 6), "exit_reason", "exit_bid", r("return_pct", 6), r("pnl_usd", 4), r("pnl_0bps", 4), r("pnl_10bps", 4), F.concat_ws(",", "quality_flags").alias("quality_flags"))


@query(
    "x10_days",
    f"""WITH {RUN}, uc AS MATERIALIZED (SELECT d, count(*) FILTER (eligible) AS n, count(*) FILTER (NOT eligible) AS x FROM u GROUP BY 1), gc AS MATERIALIZED (SELECT d, count(*) FILTER (strategy = 'preopen') AS p, count(*) FILTER (strategy = 'midday') AS m FROM g GROUP BY 1), tc AS MATERIALIZED (SELECT d, count(*) AS n, count(*) FILTER (filled) AS f FROM tr GROUP BY 1)
    SELECT CAST(k.d AS VARCHAR) AS trade_date, FALSE AS preopen_skipped_not_before_open, coalesce(uc.n, 0) AS eligible_symbol_count, coalesce(uc.x, 0) AS adjustment_excluded, CASE WHEN uc.n IS NULL THEN 'skipped' ELSE 'completed' END AS status, CASE WHEN uc.n IS NULL THEN 'no_prior_session' END AS reason, coalesce(p, 0) AS preopen_trigger_count, coalesce(m, 0) AS midday_trigger_count, coalesce(tc.n, 0) AS selected_trade_count, coalesce(tc.f, 0) AS filled_trade_count
    FROM (SELECT DISTINCT d FROM t) k LEFT JOIN uc USING (d) LEFT JOIN gc USING (d) LEFT JOIN tc USING (d)""",
)
def x10_days(spark, sf):
    return run(spark, sf, "days").withColumn("trade_date", F.col("trade_date").cast("string"))


@query("x10_backtest")
def x10_backtest(spark, sf):
    """The summary and gates of both strategies, with 10 000 draws of days."""
    return rounded(run(spark, sf, "summary"))


def entry_events(m: dict):
    """Events of the tape: days of eligible stocks with a trade at 1.25 of the prior close, with their open, crossing and session open."""
    key, day = F.struct("at", "seq"), backtest.DAY_KEY
    s = backtest.day_universe(m["daily"], m["calendar"], m["assets"]).where("eligible").select(*day, "open_at", "pre_from", "close_at", (F.col("prior_close") * 1.25).alias("threshold"))
    t = m["trades"].join(s, day).where((F.col("at") >= F.col("pre_from")) & (F.col("at") < F.col("close_at")))
    x = t.groupBy(*day).agg(F.min(F.when(F.col("price") >= F.col("threshold"), F.col("at"))).alias("cross"), F.min_by("price", F.when(F.col("at") >= F.col("open_at"), key)).alias("session_open"), F.max("open_at").alias("o"), F.max("threshold").alias("threshold")).where("cross is not null")
    noted = F.when(F.col("symbol") % 4 == 1, F.array(F.lit("thin_tape"), F.lit("opened_at_or_above_adjusted_threshold")))
    return x.select(*day, (F.col("o") * 1000).alias("open_ns"), (F.col("cross") * 1000).alias("cross_ns"), "threshold", "session_open", F.col("threshold").alias("adjusted_threshold"), noted.alias("quality_flags"))


def assessed(spark, sf):
    m = market(spark, sf)
    ns = F.col("at") * 1000
    with Scratch(spark, "entry") as s:
        events = s.cut(entry_events(m))
        x = tape.entry_assessment(events, m["quotes"].withColumn("at", ns), m["trades"].withColumn("at", ns), backtest.DAY_KEY, "at", "seq")
        return s.keep(s.cut(x)).withColumn("trade_date", F.col("trade_date").cast("string"))


LEVELS = "(SELECT unnest([100.0, 500.0, 1000.0, 5000.0])::DOUBLE AS level)"
ENTRY = f"""{MARKET[:MARKET.index(",\n    act AS")]},
    ev AS MATERIALIZED (SELECT symbol, d, (any_value(z) + 52200000000) * 1000 AS o, min(us) FILTER (price >= pc * 1.25) * 1000 AS c, any_value(pc) * 1.25 AS thr, arg_min(price, (us, seq)) FILTER (us >= z + 52200000000) AS so, any_value(z) * 1000 AS zn FROM ok JOIN t USING (symbol, d) WHERE us >= z + 9 * {HOUR} AND us < z + 21 * {HOUR} GROUP BY 1, 2 HAVING min(us) FILTER (price >= pc * 1.25) IS NOT NULL),
    ins AS MATERIALIZED (SELECT symbol, d, us * 1000 AS a, coalesce(lead(us * 1000) OVER (PARTITION BY symbol, d ORDER BY us, seq), c) AS b, bid, ask, asz, o, c, thr, zn FROM q JOIN ev USING (symbol, d) WHERE us * 1000 >= o AND us * 1000 < c),
    sp AS MATERIALIZED (SELECT *, ask * asz AS notional FROM ins WHERE b > a AND ask > 0 AND asz > 0 AND (bid <= 0 OR ask >= bid) AND ask < thr AND ask * asz >= 100),
    hit AS MATERIALIZED (SELECT sp.symbol, sp.d, sp.a, t.us * 1000 AS at_, t.price + 1e-12 >= sp.ask AS fits FROM sp JOIN t ON t.symbol = sp.symbol AND t.d = sp.d AND t.us * 1000 > sp.a AND t.us * 1000 <= sp.b AND t.us * 1000 < sp.c),
    wn AS MATERIALIZED (SELECT symbol, d, w.name AS win, greatest(o, CASE w.name WHEN 'after_open' THEN o ELSE zn + w.h * {HOUR} * 1000 END) + 5000000000 AS f FROM ev CROSS JOIN (SELECT unnest(['after_open', 'preopen_1400_bst', 'midday_1700_bst', 'afternoon_1900_bst']) AS name, unnest([0, 14, 17, 19]) AS h) w),
    k AS MATERIALIZED (SELECT wn.symbol, wn.d, win, hit.a, min(at_) AS confirm FROM wn JOIN hit ON hit.symbol = wn.symbol AND hit.d = wn.d AND fits AND at_ >= f GROUP BY 1, 2, 3, 4),
    cell AS MATERIALIZED (SELECT sp.symbol, sp.d, wn.win, l.level, sp.ask, sp.notional, sp.thr, sp.c, wn.f, greatest(sp.a, f) AS s, sp.b AS e, sp.a, k.confirm, notional + 1e-9 >= l.level AS fit FROM sp JOIN wn ON wn.symbol = sp.symbol AND wn.d = sp.d LEFT JOIN k ON k.symbol = sp.symbol AND k.d = sp.d AND k.win = wn.win AND k.a = sp.a CROSS JOIN {LEVELS} l WHERE sp.b > f),
    runs AS MATERIALIZED (SELECT *, sum(CASE WHEN fit AND NOT coalesce(pf AND s - pe <= 2000000, FALSE) THEN 1 ELSE 0 END) OVER (PARTITION BY symbol, d, win, level ORDER BY a ROWS UNBOUNDED PRECEDING) AS i FROM (SELECT *, lag(fit) OVER v AS pf, lag(e) OVER v AS pe FROM cell WINDOW v AS (PARTITION BY symbol, d, win, level ORDER BY a))),
    seg AS MATERIALIZED (SELECT symbol, d, win, level, i, (max(e) - min(s)) / 1e9 AS seconds, max(notional) AS notional, min(ask) AS ask, min(confirm) AS confirm, arg_min(ask, (confirm, s)) FILTER (confirm IS NOT NULL) AS cask, any_value(thr) AS thr, any_value(c) AS c, any_value(f) AS f FROM runs WHERE fit GROUP BY 1, 2, 3, 4, 5),
    fin AS MATERIALIZED (SELECT symbol, d, win, level, sum(seconds) AS total, max(seconds) AS longest, max(notional) AS notional, min(ask) AS ask, min(confirm) AS confirm, arg_min(cask, confirm) FILTER (confirm IS NOT NULL) AS cask, min(confirm) FILTER (seconds + 1e-12 >= 30 AND (thr / cask - 1) * 100 + 1e-12 >= 0) AS act, arg_min({{'s': seconds, 'k': cask}}, confirm) FILTER (confirm IS NOT NULL AND seconds + 1e-12 >= 30) AS x, any_value(thr) AS thr, any_value(c) AS c, any_value(f) AS f FROM seg GROUP BY 1, 2, 3, 4)"""


@query(
    "x09_entry_assessment",
    f"""WITH {ENTRY}, n AS (SELECT symbol, d, count(*) AS n FROM ins GROUP BY 1, 2), ni AS (SELECT symbol, d, count(*) AS n FROM sp GROUP BY 1, 2), nt AS (SELECT symbol, d, count(*) AS n FROM hit GROUP BY 1, 2),
    r AS (SELECT ev.*, fin.total IS NOT NULL AS shown, fin.confirm IS NOT NULL AS bought, fin.act IS NOT NULL AS acted, coalesce(so >= ev.thr, FALSE) AS gapped, ev.c <= ev.o AS early, fin.act, fin.x, fin.confirm, coalesce(n.n, 0) AS nq, coalesce(ni.n, 0) AS ni, coalesce(nt.n, 0) AS nt FROM ev LEFT JOIN fin ON fin.symbol = ev.symbol AND fin.d = ev.d AND win = 'after_open' AND level = 500 LEFT JOIN n ON n.symbol = ev.symbol AND n.d = ev.d LEFT JOIN ni ON ni.symbol = ev.symbol AND ni.d = ev.d LEFT JOIN nt ON nt.symbol = ev.symbol AND nt.d = ev.d)
    SELECT symbol, CAST(d AS VARCHAR) AS trade_date, o AS open_ns, c AS cross_ns, round(thr, 6) AS raw_threshold_price, round((c - o) / 1e9, 6) AS seconds_open_to_threshold, bought AND NOT gapped AND NOT early AS purchase_feasible, acted AND NOT gapped AND NOT early AS primary_actionable, act AS first_entry_at, CASE WHEN act IS NOT NULL THEN x.k END AS first_entry_ask, CASE WHEN act IS NOT NULL THEN 500.0::DOUBLE END AS first_entry_notional, CASE WHEN act IS NOT NULL THEN round((thr / x.k - 1) * 100, 4) END AS first_entry_gross_edge_pct, CASE WHEN act IS NOT NULL THEN round(x.s, 6) END AS opportunity_seconds, round((c - confirm) / 1e9, 6) AS seconds_entry_to_threshold, ni AS interval_count, nq AS regular_quote_count, nt AS regular_trade_count,
    array_to_string(list_sort(list_distinct([y FOR y IN [CASE WHEN symbol % 4 = 1 THEN 'thin_tape' END, CASE WHEN gapped OR symbol % 4 = 1 THEN 'opened_at_or_above_adjusted_threshold' END, CASE WHEN early THEN 'threshold_reached_at_or_before_regular_open' END, CASE WHEN nq = 0 THEN 'no_regular_session_quotes_before_threshold' END, CASE WHEN NOT shown THEN 'no_subthreshold_ask_at_primary_notional' WHEN NOT bought THEN 'subthreshold_ask_not_trade_confirmed' WHEN NOT acted THEN 'entry_opportunity_below_manual_duration_or_edge_gate' END] IF y IS NOT NULL])), ',') AS quality_flags,
    CASE WHEN acted AND NOT gapped AND NOT early THEN NULL WHEN gapped THEN 'opened_at_or_above_threshold' WHEN early THEN 'threshold_at_or_before_open' WHEN NOT shown THEN 'no_displayed_subthreshold_ask_at_primary_notional' WHEN NOT bought THEN 'no_confirmed_purchase_at_primary_notional' ELSE 'manual_duration_or_edge_gate_not_met' END AS exclusion_reason FROM r""",
)
def x09_assessment(spark, sf):
    x = assessed(spark, sf).drop("window_metrics")
    r = lambda c, d: F.round(c, d).alias(c)
    short = {"raw_threshold_price": 6, "seconds_open_to_threshold": 6, "first_entry_gross_edge_pct": 4, "opportunity_seconds": 6, "seconds_entry_to_threshold": 6}
    return x.select(*(r(c, short[c]) if c in short else F.array_join(c, ",").alias(c) if c == "quality_flags" else c for c in x.columns))


@query(
    "x09_entry_windows",
    f"""WITH {ENTRY}, has AS (SELECT DISTINCT q.symbol, q.d FROM q JOIN ev USING (symbol, d))
    SELECT h.symbol, CAST(h.d AS VARCHAR) AS trade_date, wn.win AS "window", l.level, fin.total IS NOT NULL AS displayed, fin.confirm IS NOT NULL AS mechanically_purchasable, fin.act IS NOT NULL AS manually_actionable, round(coalesce(total, 0), 6) AS total_displayed_seconds, round(coalesce(longest, 0), 6) AS max_contiguous_displayed_seconds, round(coalesce(notional, 0), 4) AS max_displayed_ask_notional, fin.ask AS minimum_displayed_ask, fin.confirm AS first_confirmed_at, fin.cask AS first_confirmed_ask, fin.act AS first_actionable_at, round((fin.confirm - fin.f) / 1e9, 6) AS seconds_to_first_confirmed
    FROM has h JOIN wn USING (symbol, d) CROSS JOIN {LEVELS} l LEFT JOIN fin ON fin.symbol = h.symbol AND fin.d = h.d AND fin.win = wn.win AND fin.level = l.level""",
)
def x09_windows(spark, sf):
    x = assessed(spark, sf).select("symbol", "trade_date", F.explode("window_metrics").alias("m")).select("symbol", "trade_date", "m.*")
    r = lambda c, d: F.round(c, d).alias(c)
    return x.select("symbol", "trade_date", "window", "level", "displayed", "mechanically_purchasable", "manually_actionable", r("total_displayed_seconds", 6), r("max_contiguous_displayed_seconds", 6), r("max_displayed_ask_notional", 4), "minimum_displayed_ask", "first_confirmed_at", "first_confirmed_ask", "first_actionable_at", r("seconds_to_first_confirmed", 6))
