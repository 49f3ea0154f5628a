"""Ordered operators: as-of and interval joins, islands, grids, running extremes, streaks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def carried(rows: DataFrame, by: list[str], bucket: str, value: Column) -> DataFrame:
    """by, bucket, _carry: for each bucket of a key the latest value (an aggregate over a bucket, null if it has none) of the buckets before it.

    The ordered window runs over one row a bucket, whatever the rows of a key.
    """
    each = rows.groupBy(*by, bucket).agg(value.alias("_own"))
    w = W.partitionBy(*by).orderBy(bucket).rowsBetween(W.unboundedPreceding, -1)
    return each.select(*by, bucket, F.last("_own", ignorenulls=True).over(w).alias("_carry"))


def asof_join(left: DataFrame, right: DataFrame, by: list[str], ts: str, values: list[str], seq: str, strict: bool = False, tolerance=None, prefix: str = "r_", width: int | None = None) -> DataFrame:
    """Each left row with the latest right row of its key at or before its time (before, if strict).

    One union and one window: a single shuffle by key, no join, linear in the rows.
    ``seq`` breaks ties among right rows of equal time (the largest wins). With a ``width`` (of a
    numeric time) a key is split into buckets of that width, which are windows of their own;
    what stood at a bucket's start comes from the buckets before it. So a key with most of the
    rows is spread over the cluster.
    """
    extra = [c for c in left.columns if c not in (*by, ts)]
    side = F.lit(0 if strict else 2)
    a = left.select(*by, ts, side.alias("_side"), F.lit(None).cast("long").alias("_seq"), F.struct(*extra).alias("_left") if extra else F.struct(F.lit(1).alias("_one")).alias("_left"), F.lit(None).cast(right.select(F.struct(ts, *values)).schema[0].dataType).alias("_right"))
    b = right.select(*by, ts, F.lit(1).alias("_side"), F.col(seq).cast("long").alias("_seq"), F.lit(None).cast(a.schema["_left"].dataType).alias("_left"), F.struct(ts, *values).alias("_right"))
    both, keys = a.unionByName(b), [*by]
    if width is not None:
        both, keys = both.withColumn("_b", F.floor(F.col(ts) / width)), [*by, "_b"]
    w = W.partitionBy(*keys).orderBy(ts, "_side", "_seq").rowsBetween(W.unboundedPreceding, W.currentRow)
    got = both.withColumn("_here", F.last("_right", ignorenulls=True).over(w)).where("_left is not null")
    if width is not None:
        before = carried(both, by, "_b", F.max_by("_right", F.when(F.col("_right").isNotNull(), F.struct(ts, "_seq"))))
        # null keys are keys of their own in a window, so they are here
        same = F.col("_b") == F.col("_b2")
        for c in by:
            same = same & F.col(c).eqNullSafe(F.col(f"_k_{c}"))
        before = before.withColumnsRenamed({c: f"_k_{c}" for c in by} | {"_b": "_b2"})
        got = got.join(before, same, "left").withColumn("_here", F.coalesce("_here", "_carry"))
    got = got.withColumn("_right", F.col("_here"))
    if tolerance is not None:
        got = got.withColumn("_right", F.when(F.col(ts) - F.col(f"_right.{ts}") <= tolerance, F.col("_right")))
    out = [F.col(f"_left.{c}").alias(c) for c in extra]
    return got.select(*by, ts, *out, F.col(f"_right.{ts}").alias(f"{prefix}{ts}"), *(F.col(f"_right.{v}").alias(f"{prefix}{v}") for v in values))


def interval_join(points: DataFrame, spans: DataFrame, by: str, at: str, lo: str, hi: str, bucket: int, how: str = "inner", open_start: bool = True) -> DataFrame:
    """Points with the spans of their key that hold them: lo < at <= hi (lo <= at if not open_start).

    Spans are cut into buckets of the axis, so the join is a hash join on (key, bucket)
    whatever the number of rows of a key; ``bucket`` should be near a span's length.
    """
    s = spans.withColumn("_b", F.explode(F.sequence(F.floor(F.col(lo) / bucket), F.floor(F.col(hi) / bucket))))
    p = points.withColumn("_b", F.floor(F.col(at) / bucket))
    inside = (F.col(at) > F.col(lo) if open_start else F.col(at) >= F.col(lo)) & (F.col(at) <= F.col(hi))
    s = s.withColumnRenamed(by, "_k")
    return p.join(s, (p[by] == s["_k"]) & (p["_b"] == s["_b"]) & inside, how).drop(s["_b"]).drop("_b", "_k")


def state_intervals(quotes: DataFrame, by: list[str], ts: str, seq: str, end: Column, keep_empty: bool = True) -> DataFrame:
    """Adds start and stop: a row's state lasts until the next row of its key, the last until ``end``."""
    w = W.partitionBy(*by).orderBy(ts, seq)
    out = quotes.withColumn("start", F.col(ts)).withColumn("stop", F.coalesce(F.lead(ts).over(w), end))
    return out.where("stop >= start" if keep_empty else "stop > start")


def islands(spans: DataFrame, by: list[str], start: str, stop: str, gap: int = 0) -> DataFrame:
    """Adds island: the number of the run of spans of a key that touch or lie within ``gap``."""
    w = W.partitionBy(*by).orderBy(start, stop)
    before = F.max(stop).over(w.rowsBetween(W.unboundedPreceding, -1))
    fresh = F.when(before.isNull() | (F.col(start) > before + gap), 1).otherwise(0)
    return spans.withColumn("_new", fresh).withColumn("island", F.sum("_new").over(w)).drop("_new")


def merged_duration(spans: DataFrame, by: list[str], start: str, stop: str, gap: int = 0) -> DataFrame:
    """by, segments, total, longest: the union of spans of each key."""
    each = islands(spans, by, start, stop, gap).groupBy(*by, "island").agg((F.max(stop) - F.min(start)).alias("d"))
    return each.groupBy(*by).agg(F.count("*").alias("segments"), F.sum("d").alias("total"), F.max("d").alias("longest"))


def dense_grid(rows: DataFrame, by: list[str], at: str, step: int) -> DataFrame:
    """All grid points of each key between its first and last row, with observed true where a row is."""
    bounds = rows.groupBy(*by).agg(F.min(at).alias("_a"), F.max(at).alias("_b"))
    grid = bounds.select(*by, F.explode(F.sequence("_a", "_b", F.lit(step))).alias(at))
    return grid.join(rows.withColumn("observed", F.lit(True)), [*by, at], "left").withColumn("observed", F.coalesce("observed", F.lit(False)))


def running_extremes(rows: DataFrame, by: list[str], order: list[str], price: str, width: int | None = None) -> DataFrame:
    """by, max_drawdown, max_runup: extremes of price against its running high and low.

    With a ``width`` of the first order column (a number) a key is split into buckets that
    are windows of their own, and the highs and lows of the buckets before are looked up.
    """
    keys = [*by]
    if width is not None:
        rows, keys = rows.withColumn("_b", F.floor(F.col(order[0]) / width)), [*by, "_b"]
    w = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    x = rows.withColumn("_hi", F.max(price).over(w)).withColumn("_lo", F.min(price).over(w))
    if width is not None:
        each = rows.groupBy(*keys).agg(F.max(price).alias("_h"), F.min(price).alias("_l"))
        older = W.partitionBy(*by).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
        each = each.select(*keys, F.max("_h").over(older).alias("_h"), F.min("_l").over(older).alias("_l")).withColumnsRenamed({c: f"_k_{c}" for c in keys})
        same = F.lit(True)
        for c in keys:
            same = same & F.col(c).eqNullSafe(F.col(f"_k_{c}"))
        x = x.join(each, same, "left").withColumns({"_hi": F.greatest("_hi", "_h"), "_lo": F.least("_lo", "_l")})
    return x.groupBy(*by).agg(F.min(F.try_divide(F.col(price), F.col("_hi")) - 1).alias("max_drawdown"), F.max(F.try_divide(F.col(price), F.col("_lo")) - 1).alias("max_runup"))


def max_gap(rows: DataFrame, by: list[str], at: str, first: Column, last: Column) -> DataFrame:
    """by, max_gap: the longest stretch without a row, both boundaries included."""
    w = W.partitionBy(*by).orderBy(at)
    x = rows.withColumn("_d", F.col(at) - F.coalesce(F.lag(at).over(w), first))
    return x.groupBy(*by).agg(F.greatest(F.max("_d"), F.max(last) - F.max(at)).alias("max_gap"))


def longest_streak(rows: DataFrame, by: list[str], order: list[str], hit: Column) -> DataFrame:
    """by, streak: the longest run of consecutive rows for which hit is true."""
    w = W.partitionBy(*by).orderBy(*order)
    x = rows.withColumn("_h", F.when(hit, 1).otherwise(0)).withColumn("_g", F.sum(1 - F.col("_h")).over(w.rowsBetween(W.unboundedPreceding, 0)))
    return x.groupBy(*by, "_g").agg(F.sum("_h").alias("n")).groupBy(*by).agg(F.max("n").alias("streak"))


def equity_drawdown(rows: DataFrame, by: list[str], order: list[str], pnl: str) -> DataFrame:
    """by, total, drawdown: the deepest fall of the running sum from its peak (the peak starts at 0)."""
    w = W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    x = rows.withColumn("_e", F.sum(pnl).over(w)).withColumn("_p", F.greatest(F.lit(0.0), F.max("_e").over(w)))
    return x.groupBy(*by).agg(F.sum(pnl).alias("total"), F.max(F.col("_p") - F.col("_e")).alias("drawdown"))


def top_k(rows: DataFrame, by: list[str], order: list, k: int, name: str = "rank") -> DataFrame:
    """The first k rows of each key in an order, with their rank; a group limit runs before the shuffle."""
    return rows.withColumn(name, F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col(name) <= k)


def prior_sessions(rows: DataFrame, by: list[str], day: str, n: int) -> DataFrame:
    """by, day, prior_day, k: the n sessions of the key before each of its sessions, the nearest first; one window, no join."""
    w = W.partitionBy(*by).orderBy(day)
    each = F.array(*(F.struct(F.lag(day, k).over(w).alias("prior_day"), F.lit(k).alias("k")) for k in range(1, n + 1)))
    return rows.withColumn("_p", each).select(*by, day, F.inline("_p")).where("prior_day is not null")


def latest(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """One row for each key: the last in an order (dedupe keep-last)."""
    return top_k(rows, keys, order, 1, "_rank").drop("_rank")


def upsert(existing: DataFrame, new: DataFrame, keys: list[str], order: list | None = None) -> DataFrame:
    """existing with new's rows in place of those with equal keys; of new rows with one key, the last in ``order`` stays.

    Without an order the largest row by all its columns stays, so the result does not
    depend on partitions. new wins by an anti join, so existing rows are never sorted;
    nulls in keys are distinct as in SQL.
    """
    last = [F.desc(c) for c in (order or [c for c in new.columns if c not in keys])]
    once = latest(new, keys, last or [F.lit(1)])
    return existing.join(once.select(*keys), keys, "left_anti").unionByName(once, allowMissingColumns=True)
