"""Seconds of trades and quotes on a stream: one row for each key and second, whatever the order in which ticks arrive.

A ``StatefulProcessor`` holds a map from second to summary for each key. Of two ticks the
earlier in (nanosecond, sequence) opens, the later closes or stands, so a second is the same for
any order of arrival. Event-time timers end a second: one timer a key stands at the end of its
oldest open second, and when the watermark passes it all ended seconds are emitted and leave the
state. What the state holds is the seconds between the watermark and the newest tick, and a key
without open seconds has no state at all.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

NS = 1_000_000_000
#: Columns of a tick stream after ``ticks``.
TICK = "symbol string, ts timestamp, at long, seq long, quote boolean, price double, size long, bid_price double, bid_size_shares long, ask_price double, ask_size_shares long, spread double"
#: A second's row; the same as ``tape.second_summary`` makes of a batch.
SECOND = "symbol string, second long, trade_open double, trade_high double, trade_low double, trade_close double, trade_volume long, trade_count long, bid_price double, bid_size_shares long, ask_price double, ask_size_shares long, min_spread double, quote_updates long"
_STATE = "first_at long, first_seq long, open double, last_at long, last_seq long, close double, high double, low double, volume long, trades long, quote_at long, quote_seq long, bid double, bid_size long, ask double, ask_size long, spread double, quotes long"
_FIELDS = [f.split()[0] for f in _STATE.split(", ")]


def ticks(trades: DataFrame, quotes: DataFrame, by: str = "symbol", at: str = "at", seq: str = "seq", delay: str = "10 seconds") -> DataFrame:
    """Both inputs as one stream of ticks under a watermark on their time (at, epoch nanoseconds)."""
    none = lambda t: F.lit(None).cast(t)
    head = [F.col(by).cast("string").alias("symbol"), F.timestamp_micros(F.expr(f"{at} div 1000")).alias("ts"), F.col(at).cast("long").alias("at"), F.col(seq).cast("long").alias("seq")]
    sides = ("bid_price", "double"), ("bid_size_shares", "long"), ("ask_price", "double"), ("ask_size_shares", "long"), ("spread", "double")
    t = trades.select(*head, F.lit(False).alias("quote"), F.col("price").cast("double").alias("price"), F.col("size").cast("long").alias("size"), *(none(k).alias(c) for c, k in sides))
    q = quotes.select(*head, F.lit(True).alias("quote"), none("double").alias("price"), none("long").alias("size"), *(F.col(c).cast(k).alias(c) for c, k in sides))
    return t.unionByName(q).withWatermark("ts", delay)


def merged(a: dict | None, b: dict) -> dict:
    """Two summaries of one second as one; neither order nor grouping matters."""
    if a is None:
        return b
    least = lambda f: min((v for v in (a[f], b[f]) if v is not None), default=None)
    most = lambda f: max((v for v in (a[f], b[f]) if v is not None), default=None)

    def pick(at: str, seq: str, later: bool) -> dict:
        if a[at] is None or b[at] is None:
            return b if a[at] is None else a
        return b if ((b[at], b[seq]) >= (a[at], a[seq])) == later else a

    first, last, quote = pick("first_at", "first_seq", False), pick("last_at", "last_seq", True), pick("quote_at", "quote_seq", True)
    out = {f: first[f] for f in ("first_at", "first_seq", "open")} | {f: last[f] for f in ("last_at", "last_seq", "close")} | {f: quote[f] for f in ("quote_at", "quote_seq", "bid", "bid_size", "ask", "ask_size")}
    return out | {"high": most("high"), "low": least("low"), "spread": least("spread"), "volume": a["volume"] + b["volume"], "trades": a["trades"] + b["trades"], "quotes": a["quotes"] + b["quotes"]}


def summarised(pdf: pd.DataFrame) -> dict[int, dict]:
    """Second -> summary of a frame of ticks of one key."""
    pdf = pdf.assign(second=pdf["at"] // NS).sort_values(["at", "seq"], kind="stable")
    out: dict[int, dict] = {}
    none = dict.fromkeys(_FIELDS) | {"volume": 0, "trades": 0, "quotes": 0}
    plain = lambda v, kind: None if pd.isna(v) else kind(v)
    for (second, quote), g in pdf.groupby(["second", "quote"], sort=False):
        head, tail = g.iloc[0], g.iloc[-1]
        own = dict(none)
        if quote:
            own |= {"quote_at": int(tail["at"]), "quote_seq": int(tail["seq"]), "bid": plain(tail["bid_price"], float), "bid_size": plain(tail["bid_size_shares"], int), "ask": plain(tail["ask_price"], float), "ask_size": plain(tail["ask_size_shares"], int), "spread": plain(g["spread"].min(), float), "quotes": len(g)}
        else:
            own |= {"first_at": int(head["at"]), "first_seq": int(head["seq"]), "open": plain(head["price"], float), "last_at": int(tail["at"]), "last_seq": int(tail["seq"]), "close": plain(tail["price"], float), "high": plain(g["price"].max(), float), "low": plain(g["price"].min(), float), "volume": int(g["size"].sum()), "trades": len(g)}
        out[int(second)] = merged(out.get(int(second)), own)
    return out


class SecondProcessor(StatefulProcessor):
    """State of a key: its open seconds, and the time at which its one timer stands."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getMapState("open", "second long", _STATE)
        self.timer = handle.getValueState("timer", "ms long")

    def _stand(self, ms: int) -> None:
        """Puts the key's timer at ms, if it isn't at an earlier time."""
        held = self.timer.get() if self.timer.exists() else None
        if held is None or ms < held[0]:
            if held is not None:
                self.handle.deleteTimer(held[0])
            self.handle.registerTimer(ms)
            self.timer.update((ms,))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        seen = [s for pdf in rows for s in summarised(pdf).items()]
        # ticks of a second that has been emitted are behind the watermark and were dropped before
        for second, summary in seen:
            held = dict(zip(_FIELDS, self.open.getValue((second,)), strict=True)) if self.open.containsKey((second,)) else None
            new = merged(held, summary)
            self.open.updateValue((second,), tuple(new[f] for f in _FIELDS))
        if seen:
            self._stand((min(s for s, _ in seen) + 1) * 1000)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        ended, wait = [], None
        for (second,), value in list(self.open.iterator()):
            if (second + 1) * 1000 <= mark:
                v = dict(zip(_FIELDS, value, strict=True))
                ended.append((key[0], second, v["open"], v["high"], v["low"], v["close"], v["volume"], v["trades"], v["bid"], v["bid_size"], v["ask"], v["ask_size"], v["spread"], v["quotes"]))
                self.open.removeKey((second,))
            else:
                wait = second if wait is None else min(wait, second)
        self.timer.clear()
        if wait is not None:
            self._stand((wait + 1) * 1000)
        if ended:
            yield pd.DataFrame(sorted(ended), columns=[f.split()[0] for f in SECOND.split(", ")])

    def close(self) -> None:
        """Nothing is held outside the state."""


def second_stream(trades: DataFrame, quotes: DataFrame, by: str = "symbol", at: str = "at", seq: str = "seq", delay: str = "10 seconds") -> DataFrame:
    """The rows of ``tape.second_summary`` on streams of trades and quotes, each once the watermark has passed its second.

    Ticks may come in any order within the delay; later ones are dropped, as the stream's own
    rule is. A tick whose second has ended is late. Needs the RocksDB state store
    (spark.sql.streaming.stateStore.providerClass).
    """
    x = ticks(trades, quotes, by, at, seq, delay)
    return x.groupBy("symbol").transformWithStateInPandas(SecondProcessor(), SECOND, "append", "eventTime")
