"""Universe projections and filters: symbol classes, tradable symbols, valid quotes, normalised ticks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import scalar

# Assets pegged to money, and suffixes of leveraged tokens.
STABLE = ("USDT", "USDC", "FDUSD", "TUSD", "USDP", "DAI", "EUR", "GBP", "TRY", "BRL", "AUD")
LEVERAGED = ("UP", "DOWN", "BULL", "BEAR")


def classify_symbols(symbols: DataFrame) -> DataFrame:
    """Adds spot, stable_like and leveraged to rows with base_asset, permissions and permission_sets."""
    has = lambda c: F.coalesce(c, F.lit(False))
    spot = has(F.array_contains("permissions", "SPOT")) | has(F.exists("permission_sets", lambda x: has(F.array_contains(x, "SPOT"))))
    lever = F.lit(False)
    for s in LEVERAGED:
        lever = lever | F.col("base_asset").endswith(s)
    return symbols.withColumns({"spot": spot, "stable_like": F.col("base_asset").isin(*STABLE), "leveraged": lever})


def tradable(symbols: DataFrame, quotes: list[str]) -> DataFrame:
    """One trading spot symbol with limit orders for each base asset: the earliest of the quote list, then by name."""
    x = symbols.where(F.col("quote_asset").isin(*quotes) & (F.col("status") == "TRADING") & F.col("spot") & F.array_contains("order_types", "LIMIT"))
    rank = F.array_position(F.array(*map(F.lit, quotes)), F.col("quote_asset"))
    return x.groupBy("base_asset").agg(F.min_by(F.struct(*[c for c in symbols.columns if c != "base_asset"]), F.struct(rank.alias("r"), "symbol")).alias("s")).select("base_asset", "s.*")


def valid_ask(bid: Column, ask: Column, size: Column) -> Column:
    """An ask that can be bought: positive price and size, not crossed."""
    return (ask > 0) & (size > 0) & ((bid <= 0) | (ask >= bid))


def valid_bid(bid: Column, ask: Column) -> Column:
    return (bid > 0) & (ask >= bid)


def valid_both(bid: Column, ask: Column) -> Column:
    return (bid > 0) & (ask > 0) & (ask >= bid)


def spread(bid: Column, ask: Column) -> Column:
    """Null unless both sides are there."""
    return F.when(valid_both(bid, ask), ask - bid)


def complete_bars(bars: DataFrame, at: str, cutoff: Column, seconds: int = 60) -> DataFrame:
    """Bars that end no later than the cutoff; a bar that overlaps it is a leak and goes."""
    return bars.where(F.col(at) + seconds <= cutoff)


def quality_status(observed: Column, liquid: Column, bar: Column) -> Column:
    """The status ladder of a feature row."""
    return F.when(bar.isNull(), "missing_decision_bar").when((observed >= 0.995) & liquid, "pass").when(observed >= 0.98, "warning").otherwise("insufficient_history")


def preopen_summary(ticks: DataFrame, by: list[str], second: str, order: list[str]) -> DataFrame:
    """by, volume, median over seconds of the least spread to the last quote's middle (basis points), realised log volatility of last trades by second, and counts of traded seconds, quotes and quoted seconds.

    ticks has price and size for trades, bid and ask for quotes, null otherwise. A quote
    counts with a positive bid and an ask that isn't below it.
    """
    from tidemark.operators.features import log_returns

    key, quote = F.struct(*order), valid_both(F.col("bid"), F.col("ask"))
    sec = ticks.groupBy(*by, second).agg(F.max_by("price", F.when(F.col("price").isNotNull(), key)).alias("last"), F.sum("size").alias("volume"), F.min(F.when(quote, F.col("ask") - F.col("bid"))).alias("_least"), F.max_by((F.col("ask") + F.col("bid")) / 2, F.when(quote, key)).alias("_mid"), F.count_if(quote).alias("_n"))
    vol = log_returns(sec.where("last is not null"), by, [second], "last").groupBy(*by).agg(F.sqrt(F.coalesce(F.sum(F.col("r") * F.col("r")), F.lit(0.0))).alias("realized_vol"))
    out = sec.groupBy(*by).agg(F.sum("volume").alias("volume"), F.median(F.col("_least") / F.col("_mid") * 1e4).alias("median_spread_bps"), F.count("last").alias("trade_seconds"), F.sum("_n").alias("quote_count"), F.count("_mid").alias("quote_seconds"))
    return out.join(vol, by, "left")


def action_dates(actions: DataFrame, keys: list[str], dates: list[str]) -> DataFrame:
    """symbol, dates: the set of action dates by the first known key and the first date that parses."""
    day = F.coalesce(*(F.expr(f"try_cast({d} as date)") for d in dates))
    return actions.select(F.coalesce(*keys).alias("symbol"), day.alias("d")).where("symbol is not null and d is not null").groupBy("symbol").agg(F.sort_array(F.collect_set("d")).alias("dates"))


# --- normalised rows ----------------------------------------------------------

# Names of a kline's fields and their places in a raw row.
KLINE_FIELDS = {"open": 1, "high": 2, "low": 3, "close": 4, "volume": 5, "quote_volume": 7, "trade_count": 8, "taker_buy_base_volume": 9, "taker_buy_quote_volume": 10}


def parse_klines(rows: DataFrame, raw: str = "row") -> DataFrame:
    """symbol, interval, open and close time as ISO text, and typed fields of raw kline arrays (array of text); a field that isn't a number is an error."""
    at = lambda i: F.get(raw, F.lit(i))
    time = lambda i: scalar.iso_text(F.timestamp_millis(at(i).cast("long")))
    typed = [at(i).cast("long" if k == "trade_count" else "double").alias(k) for k, i in KLINE_FIELDS.items()]
    return rows.select("symbol", "interval", time(0).alias("open_time"), time(6).alias("close_time"), *typed)


def _text(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(""))


def _flags(c: str) -> Column:
    return F.coalesce(F.col(c), F.array().cast("array<string>"))


def _session(t: str) -> Column:
    return scalar.session_label(F.timestamp_seconds(scalar.floor_div(scalar.ts_ns(F.col(t)), 1_000_000_000)))


def normalize_trades(raw: DataFrame, window: str) -> DataFrame:
    """Trades from raw rows (symbol, t, p, s, x, c, i, z): missing numbers are 0, missing texts empty, the session by the clock."""
    return raw.select(
        "symbol", F.col("t").alias("timestamp"), scalar.number_or(F.col("p"), 0.0).alias("price"), F.coalesce(F.col("s").try_cast("long"), F.lit(0).cast("long")).alias("size_shares"), _text("x").alias("exchange"), _flags("c").alias("conditions"), _text("i").alias("trade_id"), _text("z").alias("tape"),
        _session("t").alias("session"), F.lit(window).alias("source_window"), scalar.json_text("c", "i", "p", "s", "t", "x", "z").alias("raw_json"),
    )


def normalize_quotes(raw: DataFrame, window: str, day: Column) -> DataFrame:
    """Quotes from raw rows (symbol, t, bp, bs, bx, ap, as, ax, c, z): sizes in shares, the spread only where both sides are there."""
    bid, ask = scalar.number_or(F.col("bp"), 0.0), scalar.number_or(F.col("ap"), 0.0)
    whole = lambda c: F.coalesce(F.col(c).try_cast("long"), F.lit(0).cast("long"))
    return raw.select(
        "symbol", F.col("t").alias("timestamp"), bid.alias("bid_price"), whole("bs").alias("bid_size_raw"), scalar.quote_size_shares(F.col("bs"), day).alias("bid_size_shares"), _text("bx").alias("bid_exchange"), ask.alias("ask_price"), whole("as").alias("ask_size_raw"), scalar.quote_size_shares(F.col("as"), day).alias("ask_size_shares"), _text("ax").alias("ask_exchange"),
        F.when((ask != 0) & (bid != 0), ask - bid).alias("spread"), _flags("c").alias("conditions"), _text("z").alias("tape"), _session("t").alias("session"), F.lit(window).alias("source_window"),
    )


def normalize_bars(raw: DataFrame, window: str, timeframe: str, adjustment: str) -> DataFrame:
    """Bars from raw rows (symbol, t, o, h, l, c, v, n, vw)."""
    num = {"open": "o", "high": "h", "low": "l", "close": "c", "vwap": "vw"}
    whole = {"volume": "v", "trade_count": "n"}
    return raw.select(
        "symbol", F.col("t").alias("timestamp"), *(scalar.number_or(F.col(v), 0.0).alias(k) for k, v in num.items()), *(F.coalesce(F.col(v).try_cast("long"), F.lit(0).cast("long")).alias(k) for k, v in whole.items()), F.lit(timeframe).alias("timeframe"), F.lit(adjustment).alias("adjustment"), _session("t").alias("session"), F.lit(window).alias("source_window")
    )


# --- filters --------------------------------------------------------------------


def regular_bars(bars: DataFrame, at: str, opens: str, closes: str) -> DataFrame:
    """Bars from a session's open until before its close whose prices are all positive."""
    ok = (F.col(at) >= F.col(opens)) & (F.col(at) < F.col(closes))
    for c in ("open", "high", "low", "close"):
        ok = ok & (F.col(c) > 0)
    return bars.where(ok)


def day_high_prefilter(daily: DataFrame, by: list[str], day: str, rise_pct: float = 25.0) -> DataFrame:
    """Days whose high reaches the prior row's close by ``rise_pct``; the first day of a key has no prior close and goes."""
    from pyspark.sql import Window as W

    x = daily.withColumn("prior_close", F.lag("close").over(W.partitionBy(*by).orderBy(day)))
    return x.where((F.col("prior_close") > 0) & (F.col("high") >= F.col("prior_close") * (1 + rise_pct / 100)))


def before_ns(rows: DataFrame, at: str, end_ns: Column) -> DataFrame:
    """Rows strictly before an exclusive end, compared in whole nanoseconds."""
    return rows.where(F.col(at).cast("long") < end_ns.cast("long"))


def split_sane(scale: Column, low: float = 0.9, high: float = 1.1) -> Column:
    """Whether an adjustment scale is near 1 or unknown."""
    return scale.isNull() | scale.between(low, high)


def eligible_samples(rows: DataFrame, status: str = "feature_quality_status", label: str = "label", contaminated: str = "pseudo_window_contaminated_control") -> DataFrame:
    """Samples of quality pass, without contaminated controls (null counts as clean), in groups of one event and at least one control."""
    x = rows.where((F.col(status) == "pass") & ~((F.col(label) == 0) & F.coalesce(F.col(contaminated), F.lit(False))))
    groups = x.groupBy("match_group_id").agg(F.count_if(F.col(label) == 1).alias("_e"), F.count_if(F.col(label) == 0).alias("_c")).where("_e = 1 and _c >= 1")
    return x.join(groups.select("match_group_id"), "match_group_id", "left_semi")


# What disqualifies an event from the clean tier, and what does so for a pair.
DISQUALIFYING = ("unverified", "unavailable", "truncated", "missing", "recovered", "error")
UNVERIFIED_ACTION = "corporate_actions_point_in_time_publication_unverified"


def positive_tier(flags: Column, scale: Column) -> Column:
    """primary_clean, or extended for a scale off 1 or a disqualifying flag; flags are a list."""
    return F.when(~F.coalesce(split_sane(scale), F.lit(True)), "extended").when(scalar.any_flag_like(flags, list(DISQUALIFYING)), "extended").otherwise("primary_clean")


def cohort_flags(pairs: DataFrame) -> DataFrame:
    """Adds cohort_core_usable and cohort_primary_clean to rows with trades, quotes, currently_tradable, positive_tier and the three flag lists."""
    usable = (F.coalesce("trades", F.lit(0)) > 0) & (F.coalesce("quotes", F.lit(0)) > 0)
    core = usable & F.coalesce("currently_tradable", F.lit(True))
    every = scalar.flag_union(F.col("pair_flags"), F.col("observation_flags"), F.col("assessment_flags"))
    return pairs.withColumns({"control_usable_ticks": usable, "cohort_core_usable": core, "cohort_primary_clean": core & (F.col("positive_tier") == "primary_clean") & ~scalar.any_flag_like(every, [UNVERIFIED_ACTION])})


def allow_list(rows: DataFrame, allowed: list[str]) -> DataFrame:
    """The allowed columns that are there, by name."""
    return rows.select(*(c for c in sorted(allowed) if c in rows.columns))


def flatten(rows: DataFrame, column: str, prefix: str) -> DataFrame:
    """A struct's fields as prefixed columns; nested ones as JSON text."""
    from pyspark.sql import types as T

    nested = (T.StructType, T.ArrayType, T.MapType)
    out = [(F.to_json(F.col(column)[f.name]).alias(f"{prefix}_{f.name}_json") if isinstance(f.dataType, nested) else F.col(column)[f.name].alias(f"{prefix}_{f.name}")) for f in rows.schema[column].dataType.fields]
    return rows.select(*(c for c in rows.columns if c != column), *out)


def search(rows: DataFrame, text: str, columns: list[str]) -> DataFrame:
    """Rows with a text in one of the columns, whatever the case."""
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.contains(F.lower(F.col(c).cast("string")), F.lit(text.lower())), F.lit(False))
    return rows.where(hit)


# --- samples --------------------------------------------------------------------


def event_samples(events: DataFrame, split: Column) -> DataFrame:
    """A sample of each event: baseline and cross minute, duration and how the baseline was resolved.

    events has id, symbol, first_cross_time, first_cross_trade_time, baseline_time,
    baseline_trade_time (timestamps), baseline_trade_unresolved and
    minutes_baseline_open_to_cross_open. No baseline, or a duration outside 1..480
    minutes, is an error.
    """
    cross = F.date_trunc("minute", F.coalesce("first_cross_trade_time", "first_cross_time"))
    traded = F.col("baseline_trade_time").isNotNull() & ~F.coalesce("baseline_trade_unresolved", F.lit(False))
    none = F.raise_error(F.concat(F.lit("event without a baseline time: "), F.col("id").cast("string"))).cast("timestamp")
    baseline = F.date_trunc("minute", F.when(traded, F.col("baseline_trade_time")).when(F.col("baseline_time").isNotNull(), F.col("baseline_time")).otherwise(none))
    minutes = F.coalesce(F.col("minutes_baseline_open_to_cross_open").cast("long"), scalar.floor_div(F.unix_seconds(cross) - F.unix_seconds(baseline), 60))
    far = F.raise_error(F.concat(F.lit("duration outside 1..480 minutes: "), F.col("id").cast("string"))).cast("long")
    minutes = F.when(minutes.between(1, 480), minutes).otherwise(far)
    return events.select(
        F.concat(F.lit("event:"), "id").alias("sample_id"), F.col("id").cast("string").alias("match_group_id"), F.lit("event").alias("sample_type"), F.lit(1).alias("label"), split.alias("split"), F.col("symbol").cast("string").alias("symbol"), F.col("id").cast("string").alias("event_id"), F.lit(None).cast("string").alias("control_id"), F.lit(None).cast("int").alias("control_rank"),
        baseline.alias("baseline_anchor_time"), cross.alias("cross_anchor_time"), minutes.alias("baseline_to_cross_minutes"), F.when(traded, "resolved_trade_minute").otherwise("scanner_minute_fallback").alias("baseline_resolution"),
    )


def control_samples(matches: DataFrame, samples: DataFrame) -> DataFrame:
    """A sample of each matched control (control_id, event_id, split, symbol, control_anchor_time, control_rank): its pseudo-baseline lies the event's duration before its anchor. Matches without an event go."""
    e = samples.select(F.col("event_id").alias("_event"), "baseline_to_cross_minutes")
    x = matches.withColumn("event_id", F.col("event_id").cast("string")).join(e, F.col("event_id") == F.col("_event"))
    cross = F.date_trunc("minute", F.col("control_anchor_time"))
    return x.select(
        F.concat(F.lit("control:"), "control_id").alias("sample_id"), F.col("event_id").alias("match_group_id"), F.lit("control").alias("sample_type"), F.lit(0).alias("label"), "split", F.col("symbol").cast("string").alias("symbol"), "event_id", F.col("control_id").cast("string").alias("control_id"), F.col("control_rank").cast("int").alias("control_rank"),
        F.timestamp_seconds(F.unix_seconds(cross) - F.col("baseline_to_cross_minutes") * 60).alias("baseline_anchor_time"), cross.alias("cross_anchor_time"), "baseline_to_cross_minutes", F.lit("pseudo_baseline_same_event_duration").alias("baseline_resolution"),
    )


def validate_design(purpose: str, expected_purpose: str, window_minutes: int, threshold_pct: float, contamination_before: int, contamination_after: int) -> None:
    """Raises ValueError unless a source fits the frozen design: its purpose, 480 minutes, 25 % and at least 480 minutes of distance."""
    wrong = [m for ok, m in ((purpose == expected_purpose, f"purpose {purpose}"), (window_minutes == 480, f"window {window_minutes}"), (abs(threshold_pct - 25.0) < 1e-12, f"threshold {threshold_pct}"), (min(contamination_before, contamination_after) >= 480, "contamination below 480 minutes")) if not ok]
    if wrong:
        raise ValueError("source does not fit the design: " + ", ".join(wrong))


def asset_universe(assets: DataFrame, classes: tuple[str, ...] = ("us_equity",), exclude: tuple[str, ...] = ("OTC",)) -> DataFrame:
    """Assets of a class, not over the counter, whose symbol looks like a stock's; of equal symbols the active one, then the smallest id."""
    x = assets.where(F.col("class").isin(*classes) & ~F.coalesce(F.upper("exchange").isin(*exclude), F.lit(False)) & scalar.symbol_like(F.col("symbol")))
    rest = F.struct(*[c for c in assets.columns if c != "symbol"])
    return x.groupBy("symbol").agg(F.min_by(rest, F.struct((F.col("status") != "active").alias("inactive"), "id")).alias("_a")).select("symbol", "_a.*")


# The components of the frozen score: mean, deviation and sign of each.
SCORE = {"log1p_trade_volume": (8.18382400, 4.74614788, 1), "log1p_median_spread_bps": (6.35332542, 1.52922959, -1), "realized_second_log_vol": (0.18287512, 0.22326549, 1)}


def frozen_score(volume: Column, spread_bps: Column, vol: Column) -> Column:
    """Mean of the signed z-scores of log volume, log spread and volatility; negative inputs count as zero."""
    zero = F.lit(0.0)
    value = {"log1p_trade_volume": F.log1p(F.greatest(volume.cast("double"), zero)), "log1p_median_spread_bps": F.log1p(F.greatest(spread_bps, zero)), "realized_second_log_vol": F.greatest(vol, zero)}
    return sum((sign * (value[k] - mean) / sd for k, (mean, sd, sign) in SCORE.items()), F.lit(0.0)) / len(SCORE)


def files_of(events: DataFrame, files: DataFrame, kind: str, marker: str) -> DataFrame:
    """Events with their files of a kind whose path holds a marker."""
    f = files.where((F.col("kind") == kind) & F.contains(F.col("path"), F.lit(marker)))
    return events.join(f, "event_id")


def without_positives(pool: DataFrame, positives: DataFrame, by: list[str], used: DataFrame | None = None) -> DataFrame:
    """Candidates whose symbol has no positive on the day; used stock-days go as well."""
    left = pool.join(positives.select("symbol", *by).distinct(), ["symbol", *by], "left_anti")
    return left if used is None else left.join(used.select("symbol", *by).distinct(), ["symbol", *by], "left_anti")


def stalled_jobs(jobs: DataFrame, now: Column, minutes: int = 20) -> DataFrame:
    """Running jobs whose heartbeat is older than ``minutes``, and those that never had one and started before that, each once."""
    running = jobs.where("status = 'running'")
    old = now - F.expr(f"INTERVAL {minutes} MINUTES")
    return running.where(F.col("heartbeat_at") < old).unionByName(running.where(F.col("heartbeat_at").isNull() & (F.coalesce(F.col("started_at"), F.col("created_at")) < old))).dropDuplicates(["id"])


def rejection_counts(rows: DataFrame, by: str, reasons: str) -> DataFrame:
    """by, counts: how often each reason of the lists occurs, as a map in order of the reasons' names."""
    x = rows.select(by, F.explode(reasons).alias("_r")).groupBy(by, "_r").agg(F.count("*").alias("_n"))
    return x.groupBy(by).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("_r", "_n")))).alias("counts"))


def universe_hash(symbols: DataFrame, column: str = "symbol") -> DataFrame:
    """sha256: of the sorted distinct symbols as a compact JSON list; the list is one row, so it is for universes of a bounded size."""
    return symbols.agg(F.sha2(F.to_json(F.array_sort(F.collect_set(column))), 256).alias("sha256"))
