"""Column builders: guarded arithmetic, time codecs, hashes and small classifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def pct_change(old: Column, new: Column) -> Column:
    """Percent change; null unless the old value is positive."""
    return F.when(old > 0, (new / old - 1) * 100)


def safe_ratio(a: Column, b: Column) -> Column:
    """a / b; null for a null or zero denominator and for results that aren't finite."""
    q = F.try_divide(a, b)
    return F.when(~F.isnan(q) & (F.abs(q) < float("inf")), q)


def number_or(value: Column, default: float | None = None) -> Column:
    """A finite double from any value; else the default."""
    x = value.try_cast("double")
    ok = F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)
    return ok if default is None else F.coalesce(ok, F.lit(float(default)))


def ts_ns(text: Column) -> Column:
    """Epoch nanoseconds of an RFC-3339 UTC string with up to nine fractional digits."""
    frac = F.regexp_extract(text, r"\.(\d{1,9})", 1)
    whole = F.to_timestamp(F.regexp_replace(text, r"\.\d+", ""))
    return F.unix_seconds(whole) * F.lit(1_000_000_000).cast("long") + F.rpad(frac, 9, "0").cast("long")


def floor_div(value: Column, by: int) -> Column:
    """The quotient of longs, rounded down and exact (a division in doubles is not, for nanoseconds)."""
    value, by = value.cast("long"), F.lit(by).cast("long")
    return F.call_function("div", value - F.pmod(value, by), by)


def ns_text(ns: Column) -> Column:
    """RFC-3339 text with nine fractional digits of epoch nanoseconds."""
    rest = F.pmod(ns, F.lit(1_000_000_000).cast("long"))
    seconds = floor_div(ns, 1_000_000_000)
    return F.concat(F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("."), F.lpad(rest.cast("string"), 9, "0"), F.lit("Z"))


def epoch_millis(value: Column) -> Column:
    """Milliseconds from archive stamps that are milliseconds or, above ten trillion, microseconds."""
    return F.when(value > 10_000_000_000_000, floor_div(value, 1000)).otherwise(value).cast("long")


def uuid5(name: Column, namespace_hex: str = "6ba7b8119dad11d180b400c04fd430c8") -> Column:
    """Name-based UUID (version 5); the default namespace is the standard one for URLs."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace_hex)), F.encode(name, "utf-8")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def tie_break(*parts: Column, sep: str = "|") -> Column:
    """A deterministic order for ties: SHA-256 of the parts."""
    return F.sha2(F.concat_ws(sep, *parts), 256)


# Edges and names of the price bands.
PRICE_EDGES = (0.5, 1, 2, 5, 10, 20, 50)
PRICE_BANDS = ("lt_0_5", "0_5_1", "1_2", "2_5", "5_10", "10_20", "20_50", "gte_50")


def price_band_index(price: Column) -> Column:
    """Number of band edges at or below a price; null for null."""
    return sum((F.when(price >= e, 1).otherwise(0) for e in PRICE_EDGES), F.lit(0)) + F.when(price.isNull(), None).otherwise(0)


def price_band(price: Column) -> Column:
    """The name of a price's band; null for null."""
    return F.get(F.array(*map(F.lit, PRICE_BANDS)), price_band_index(price))


def band_distance(a: Column, b: Column) -> Column:
    """How many bands two band names lie apart; an unknown name counts as band 999."""
    place = lambda c: F.when(F.array_position(F.array(*map(F.lit, PRICE_BANDS)), c) > 0, F.array_position(F.array(*map(F.lit, PRICE_BANDS)), c) - 1).otherwise(F.lit(999))
    return F.abs(place(a) - place(b))


# Fixed value: the pattern of stock symbols.
SYMBOL_PATTERN = r"^[A-Z][A-Z0-9.\-]{0,14}$"


def symbol_like(text: Column) -> Column:
    """True for strings that look like a stock symbol once trimmed and upper-cased."""
    return F.coalesce(F.upper(F.trim(text)).rlike(SYMBOL_PATTERN), F.lit(False))


# Names of the sessions of a trading day, and the minutes of the local day at which they end.
SESSIONS = (("overnight", 240), ("premarket", 570), ("regular", 960), ("afterhours", 1200), ("overnight", 1440))


def session_label(ts: Column, zone: str = "America/New_York") -> Column:
    """The session of an instant by the local clock; null for null."""
    local = F.from_utc_timestamp(ts, zone)
    minute = F.hour(local) * 60 + F.minute(local)
    out = None
    for name, end in SESSIONS:
        out = F.when(minute < end, name) if out is None else out.when(minute < end, name)
    return out


def local_ns(day: Column, hour: int, minute: int, zone: str) -> Column:
    """Epoch nanoseconds of a wall-clock time of a day in a zone."""
    return F.unix_seconds(local_clock_utc(day, hour, minute, zone)) * F.lit(1_000_000_000).cast("long")


def quote_size_shares(size: Column, day: Column, shares_from: str = "2025-11-03") -> Column:
    """Shares of a quoted size: round lots of 100 before the given day, shares from then on; null counts as none."""
    size = F.coalesce(size.try_cast("long"), F.lit(0).cast("long"))
    return F.when(day >= F.lit(shares_from).cast("date"), size).otherwise(size * 100)


def interval_return(longer: Column, shorter: Column) -> Column:
    """Percent return of the earlier part of a longer interval, from the returns of the whole and of its later part; null unless both factors are positive."""
    a, b = 1 + longer / 100, 1 + shorter / 100
    return F.when((a > 0) & (b > 0), (a / b - 1) * 100)


def earlier_rate(last: Column, whole: Column, parts: int) -> Column:
    """The last part's amount against the mean of the ``parts`` before it, of a whole that holds both; null unless those hold something."""
    before = whole - last
    return F.when(before > 0, last / (before / parts))


def finite_text(value: Column) -> Column:
    """A double fit for JSON: null for NaN and infinities."""
    return F.when(~F.isnan(value) & (F.abs(value) < float("inf")), value)


def iso_text(ts: Column) -> Column:
    """ISO-8601 text of an instant in UTC, with microseconds only where there are some."""
    micros = F.pmod(F.unix_micros(ts), F.lit(1_000_000).cast("long"))
    head = F.date_format(F.date_trunc("second", ts), "yyyy-MM-dd'T'HH:mm:ss")
    return F.concat(head, F.when(micros > 0, F.concat(F.lit("."), F.lpad(micros.cast("string"), 6, "0"))).otherwise(""), F.lit("+00:00"))


def match_tier(offset_minutes: Column, same_weekday: Column) -> Column:
    """Closeness of a control's clock and weekday to its event's."""
    # Names of the tiers, best first, as TIERS below.
    d = F.abs(offset_minutes)
    return F.when((d == 0) & same_weekday, TIERS[0]).when(d == 0, TIERS[1]).when((d <= 15) & same_weekday, TIERS[2]).when(d <= 15, TIERS[3]).when(d <= 30, TIERS[4]).otherwise(TIERS[5])


# Names of the match tiers, best first.
TIERS = ("exact_clock_same_weekday", "exact_clock", "within_15m_same_weekday", "within_15m", "within_30m", "within_60m")


def any_flag_like(flags: Column, tokens: list[str]) -> Column:
    """Whether some flag contains one of the tokens, whatever the case; false for null or no flags."""
    hit = lambda f: F.greatest(*(F.contains(F.lower(f), F.lit(t)) for t in tokens), F.lit(False))
    return F.coalesce(F.exists(flags, hit), F.lit(False))


def flag_list(text: Column) -> Column:
    """Flags from text that is a JSON list or one bare flag; empty for null and blank."""
    bare = F.trim(text)
    parsed = F.from_json(bare, "array<string>", {"mode": "PERMISSIVE"})
    return F.when(F.coalesce(bare, F.lit("")) == "", F.array().cast("array<string>")).when(bare.startswith("[") & parsed.isNotNull(), parsed).otherwise(F.array(bare))


def flag_union(*flags: Column) -> Column:
    """Sorted distinct flags of several lists; null lists are empty."""
    return F.array_sort(F.array_distinct(F.array_compact(F.flatten(F.array(*(F.coalesce(f, F.array().cast("array<string>")) for f in flags))))))


def invalid_symbols(message: Column) -> Column:
    """Sorted distinct symbols that an error message rejects ("invalid symbol(s): A, B")."""
    # Fixed value: the pattern of the message.
    lists = F.regexp_extract_all(message, F.lit(r"""(?i)invalid\s+symbol(?:\(s\)|s)?\s*:\s*([^"}\]\n]+)"""), F.lit(1))
    each = F.flatten(F.transform(lists, lambda x: F.split(x, ",")))
    plain = F.transform(each, lambda x: F.upper(F.regexp_replace(F.trim(F.try_url_decode(F.regexp_replace(x, r"\+", "%2B"))), r"""^['"]+|['"]+$""", "")))
    return F.array_sort(F.array_distinct(F.filter(plain, lambda x: x != "")))


def json_object(text: Column, schema: str) -> Column:
    """A struct, list or map parsed from JSON text; an empty one of the type where the text is null or malformed."""
    parsed = F.from_json(text, schema)
    if schema.startswith("array"):
        return F.coalesce(parsed, F.array().cast(schema))
    if schema.startswith("map"):
        return F.coalesce(parsed, F.create_map().cast(schema))
    return parsed


def local_clock_utc(day: Column, hour: int, minute: int, zone: str) -> Column:
    """The UTC instant of a wall-clock time of a day in a zone."""
    return F.to_utc_timestamp(F.to_timestamp(F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit(f" {hour:02d}:{minute:02d}:00"))), zone)


def candle_parts(o: Column, h: Column, low: Column, c: Column) -> dict[str, Column]:
    """Body and wick shares of a bar's range; null for a flat bar."""
    span = F.when(h > low, h - low)
    return {"body": F.abs(c - o) / span, "upper_wick": (h - F.greatest(o, c)) / span, "lower_wick": (F.least(o, c) - low) / span}


def json_text(*columns: str) -> Column:
    """Compact JSON of columns in sorted order."""
    return F.to_json(F.struct(*sorted(columns)))


def safe_name(text: Column) -> Column:
    return F.regexp_replace(text, r"[^A-Za-z0-9._-]+", "_")


def weighted_distance(deltas: list[Column], weights: list[float], penalties: list[tuple[Column, float]] = ()) -> Column:
    """Root of the weighted squares of deltas plus a weight for each true penalty; a null delta gives null."""
    total = sum((d * d * w for d, w in zip(deltas, weights, strict=True)), F.lit(0.0))
    for condition, weight in penalties:
        total = total + F.when(condition, weight).otherwise(0.0)
    return F.sqrt(total)


def adjusted_skew(x: Column) -> Column:
    """Sample skewness with the bias correction; null below three values."""
    n = F.count(x)
    return F.when(n > 2, F.skewness(x) * F.sqrt(n * (n - 1.0)) / (n - 2))
