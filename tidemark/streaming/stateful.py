"""Structured Streaming forms: second rollups, session windows, and a keyed surge detector."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def with_event_time(df: DataFrame, ts: str = "ts", delay: str = "10 minutes") -> DataFrame:
    """A watermark on a timestamp column (zone-less ones are cast, as watermarks refuse them)."""
    return df.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)


def rollup(df: DataFrame, by: list[str], price: str, every: str = "1 second", ts: str = "ts", seq: str = "event_id") -> DataFrame:
    """Open, high, low, close, count of tumbling windows; batch and stream alike."""
    key = F.struct(ts, seq)
    x = df.groupBy(F.window(ts, every), *by).agg(F.min_by(price, key).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, key).alias("close"), F.count("*").alias("n"))
    return x.select(*by, F.col("window.start").alias("start"), "open", "high", "low", "close", "n")


def sessions(df: DataFrame, by: list[str], gap: str = "30 minutes", ts: str = "ts") -> DataFrame:
    """Session windows that end after a gap."""
    x = df.groupBy(F.session_window(ts, gap), *by).agg(F.count("*").alias("n"))
    return x.select(*by, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("stop"), "n")


def surges(bars: DataFrame, by: str = "symbol", window: int = 480, rise: float = 1.25) -> DataFrame:
    """First rolling surge of each key and day on a stream of bars (symbol, minute, high, low), for input in order of minutes within a key only.

    A bar that comes late is judged against newer lows, and a key's state stays for good:
    where bars may be late or keys end, use ``surges_by_event_time``. State for a key is a monotonic list of (minute, low), at most ``window`` entries, and
    the last day that surged.
    """

    def step(key, frames, state: GroupState):
        held, day = ([], -1)
        if state.exists:
            minutes, lows, day = state.get
            held = list(zip(minutes, lows, strict=True))
        out = []
        pdf = pd.concat(list(frames)).sort_values("minute")
        for r in pdf.itertuples(index=False):
            held = [h for h in held if h[0] >= r.minute - (window - 1)]
            if held and r.minute // 1440 > day and r.high + 1e-15 >= held[0][1] * rise:
                day = r.minute // 1440
                out.append((key[0], day, r.minute, r.high, held[0][1], held[0][0]))
            while held and held[-1][1] >= r.low:
                held.pop()
            held.append((r.minute, r.low))
        state.update(([int(m) for m, _ in held], [float(v) for _, v in held], int(day)))
        yield pd.DataFrame(out, columns=["symbol", "day", "minute", "high", "base_low", "base_minute"])

    return bars.select(by, "minute", "high", "low").groupBy(by).applyInPandasWithState(step, f"{by} long, day long, minute long, high double, base_low double, base_minute long", "minutes array<long>, lows array<double>, day long", "append", GroupStateTimeout.NoTimeout)


def surges_by_event_time(bars: DataFrame, by: str = "symbol", ts: str = "ts", window: int = 480, rise: float = 1.25) -> DataFrame:
    """First rolling surge of each key and day on a stream with a watermark, whatever the order in which bars arrive.

    bars has ts (the minute as a timestamp, under a watermark), high and low. A bar waits in
    the state until the watermark has passed it, so late bars within the delay take their
    place; later ones are dropped as the stream's own rule does. A key leaves the state when
    the watermark is a window beyond its last bar and beyond the day of its last surge: until
    then a further bar of that day may come, and must not be a first surge again.
    """

    def step(key: tuple, frames, state: GroupState):
        minutes, lows, day, at, highs_, lows_ = state.get if state.exists else ([], [], -1, [], [], [])
        held = list(zip(minutes, lows, strict=True))
        wait = list(zip(at, highs_, lows_, strict=True))
        for pdf in frames:
            wait += [(int(m), float(h), float(lo)) for m, h, lo in zip(pdf["minute"], pdf["high"], pdf["low"], strict=True)]
        mark = state.getCurrentWatermarkMs() // 60_000
        out, later = [], []
        for minute, high, low in sorted(wait):
            if minute >= mark:
                later.append((minute, high, low))
                continue
            held = [x for x in held if x[0] >= minute - (window - 1)]
            if held and minute // 1440 > day and high + 1e-15 >= held[0][1] * rise:
                day = minute // 1440
                out.append((key[0], day, minute, high, held[0][1], held[0][0]))
            while held and held[-1][1] >= low:
                held.pop()
            held.append((minute, low))
        ends = max([m + window + 1 for m, _ in held] + [(day + 1) * 1440])
        if not later and ends <= mark:
            state.remove()
        else:
            state.update(([m for m, _ in held], [v for _, v in held], int(day), [m for m, *_ in later], [h for _, h, _ in later], [v for *_, v in later]))
            # wake when the watermark passes the first waiting bar, or all that the key may still need
            wake = (min(m for m, *_ in later) + 1 if later else ends) * 60_000
            state.setTimeoutTimestamp(max(wake, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["symbol", "day", "minute", "high", "base_low", "base_minute"])

    x = bars.select(by, ts, F.expr(f"unix_seconds({ts}) div 60").alias("minute"), "high", "low")
    return x.groupBy(by).applyInPandasWithState(step, f"{by} long, day long, minute long, high double, base_low double, base_minute long", "minutes array<long>, lows array<double>, day long, at array<long>, highs array<double>, waiting array<double>", "append", GroupStateTimeout.EventTimeTimeout)


def idempotent_sink(path: str, keys: list[str]):
    """A foreachBatch function: each epoch overwrites its own folder, so a replayed epoch leaves the same rows."""

    def write(df: DataFrame, epoch: int) -> None:
        df.dropDuplicates(keys).write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return write


def upsert_sink(path: str, keys: list[str], order: list[str], compact_after: int = 50):
    """A foreachBatch function that adds each epoch to a versioned table by deterministic keys: replays and rows repeated in later epochs leave one row.

    An epoch writes its own rows only; once ``compact_after`` deltas have come together, a
    new base takes them in.
    """
    from tidemark.sources.versions import compact, deltas_behind, write_upsert

    def write(df: DataFrame, epoch: int) -> None:
        write_upsert(df, path, keys, order)
        if deltas_behind(df.sparkSession, path) >= compact_after:
            compact(df.sparkSession, path)

    return write
