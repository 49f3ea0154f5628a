"""Range folds: metrics of any stretch of a key's steps put together from a few ready blocks instead of its rows.

Each key's steps are covered by aligned blocks of the sizes ``SIZES``, each the fold of the
blocks it holds, so all of them are a seventh more rows than the bars. A stretch of n steps is
cut into at most 14 blocks a size (7 at either end), some 30 for ten days of minutes, whatever
the number of rows between. The fold is associative, not only a sum: the deepest fall of two
neighbours is that of either or from the older one's highest close to the newer one's lowest,
returns include the one between neighbours, and the line through ln(close) moves the newer
one's row numbers by the older one's rows.

One exchange of the bars by (key, largest block) serves all sizes: a size groups what is
already together.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Block sizes in steps; each divides the next.
SIZES = (1, 8, 64, 512, 4096)
SUMS = ("quote_volume", "trade_count", "taker_quote")
#: What a fold holds: rows, extremes and where they are last, sums, first open, first and last close, deepest fall and highest rise, returns, and the sums of the line through ln(close).
FOLD = ("n", "high", "hi_at", "low", "lo_at", *SUMS, "open", "first", "last", "cmax", "cmin", "dd", "ru", "nr", "s", "s2", "up", "sy", "siy", "syy")


def leaves(bars: DataFrame, at: str) -> DataFrame:
    """Each bar as the fold of its own step (columns FOLD and _m); what the bars don't have is null."""
    have = lambda c: F.col(c) if c in bars.columns else F.lit(None).cast("double")
    close = have("close").cast("double")
    y = F.when(close > 0, F.log(close))
    alone = F.when(close > 0, F.lit(0.0))
    zero, none = F.lit(0).cast("long"), F.lit(0.0)
    own = {
        "n": F.lit(1).cast("long"), "high": have("high"), "hi_at": F.col(at), "low": have("low"), "lo_at": F.col(at), **{c: have(c) for c in SUMS}, "open": have("open"), "first": close, "last": close, "cmax": close, "cmin": close,
        "dd": alone, "ru": alone, "nr": zero, "s": none, "s2": none, "up": zero, "sy": y, "siy": y * 0.0, "syy": y * y,
    }
    return bars.select(*(c for c in bars.columns if c not in (*own, at, "close")), F.col(at).alias("_m"), *(e.alias(k) for k, e in own.items()))


def fold(parts: DataFrame, by: list[str], order: Column) -> DataFrame:
    """by and the fold of each group's parts (FOLD) in their order; parts must not overlap."""
    w = W.partitionBy(*by).orderBy(order)
    older = w.rowsBetween(W.unboundedPreceding, -1)
    x = parts.withColumns({"_o": order, "_max": F.max("cmax").over(older), "_min": F.min("cmin").over(older), "_last": F.lag("last").over(w), "_off": F.coalesce(F.sum("n").over(older), F.lit(0))})
    c = F.col
    x = x.withColumn("_r", F.when((c("_last") > 0) & (c("first") > 0), F.log(c("first") / c("_last"))))
    met = lambda own, e: F.sum(c(own) + F.coalesce(e, F.lit(0))).alias(own)
    return x.groupBy(*by).agg(
        F.sum("n").alias("n"),
        F.max("high").alias("high"),
        F.max_by("hi_at", F.struct("high", "hi_at")).alias("hi_at"),
        F.min("low").alias("low"),
        F.max_by("lo_at", F.struct(-c("low"), "lo_at")).alias("lo_at"),
        *(F.sum(k).alias(k) for k in SUMS),
        F.min_by("open", "_o").alias("open"),
        F.min_by("first", "_o").alias("first"),
        F.max_by("last", "_o").alias("last"),
        F.max("cmax").alias("cmax"),
        F.min("cmin").alias("cmin"),
        F.least(F.min("dd"), F.min(F.when(c("_max") > 0, c("cmin") / c("_max") - 1))).alias("dd"),
        F.greatest(F.max("ru"), F.max(F.when(c("_min") > 0, c("cmax") / c("_min") - 1))).alias("ru"),
        met("nr", F.when(c("_r").isNotNull(), 1)),
        met("s", c("_r")),
        met("s2", c("_r") * c("_r")),
        met("up", F.when(c("_r") > 0, 1)),
        F.sum("sy").alias("sy"),
        F.sum(c("siy") + c("_off") * c("sy")).alias("siy"),
        F.sum("syy").alias("syy"),
    )


def blocks(bars: DataFrame, by: str, at: str, longest: int | None = None) -> DataFrame:
    """by, size, start and the fold of each block that holds a bar, of all sizes up to the longest stretch asked for."""
    sizes = [s for s in SIZES if s <= (longest or SIZES[-1])]
    start = lambda c, s: (F.col(c) - F.pmod(c, F.lit(s))).cast("long")
    top = leaves(bars, at).withColumn("_top", start("_m", SIZES[-1])).repartition(by, "_top")
    level = top.withColumn("start", F.col("_m").cast("long")).drop("_m")
    out = [level.withColumn("size", F.lit(1))]
    for s in sizes[1:]:
        level = fold(level.withColumn("_s", start("start", s)), [by, "_top", "_s"], F.col("start")).withColumnRenamed("_s", "start")
        out.append(level.withColumn("size", F.lit(s)))
    return reduce(DataFrame.unionByName, (x.select(by, "size", "start", *FOLD) for x in out))


def block_table(bars: DataFrame, by: str, at: str, write: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``blocks`` of all sizes as a table that ``write`` makes, a size at a time from the one below, so that no plan holds more than one size."""
    start = lambda c, s: (F.col(c) - F.pmod(c, F.lit(s))).cast("long")
    level = write(leaves(bars, at).withColumnRenamed("_m", "start").select(by, F.lit(1).alias("size"), F.col("start").cast("long").alias("start"), *FOLD))
    out = [level]
    for s in SIZES[1:]:
        level = write(fold(level.withColumn("_s", start("start", s)), [by, "_s"], F.col("start")).select(by, F.lit(s).alias("size"), F.col("_s").alias("start"), *FOLD))
        out.append(level)
    return write(reduce(DataFrame.unionByName, out))


def cut(low: Column, high: Column, longest: int | None = None) -> Column:
    """An array of (size, start) of the blocks that make up the steps low to high, both inside; none if high is less."""
    sizes = [s for s in SIZES if s <= (longest or SIZES[-1])]
    a = [(-(F.floor(-low / F.lit(s))) * s).cast("long") for s in sizes]
    b = [(F.floor((high + 1) / F.lit(s)) * s).cast("long") for s in sizes]
    none = F.array().cast("array<bigint>")
    run = lambda x, y, s: F.when(x < y, F.sequence(x, y - s, F.lit(s).cast("long"))).otherwise(none)
    parts = []
    for i, s in enumerate(sizes):
        whole = run(a[i], b[i], s)
        if i + 1 < len(sizes):
            # larger blocks take the middle
            starts = F.when(a[i + 1] < b[i + 1], F.concat(run(a[i], a[i + 1], s), run(b[i + 1], b[i], s))).otherwise(whole)
        else:
            starts = whole
        parts.append(_sized(starts, s))
    return F.concat(*parts)


def _sized(starts: Column, size: int) -> Column:
    return F.transform(starts, lambda x: F.struct(F.lit(size).alias("size"), x.alias("start")))


def pieces(ranges: DataFrame, tree: DataFrame, by: str, low: str, high: str, longest: int | None = None) -> DataFrame:
    """ranges (their columns but low and high) with the blocks of each, a row for each that holds a bar; start tells their order."""
    keep = [c for c in ranges.columns if c not in (low, high)]
    each = ranges.select(*keep, F.inline(cut(F.col(low), F.col(high), longest)))
    return each.join(tree, [by, "size", "start"])


def fold_ranges(ranges: DataFrame, tree: DataFrame, ids: list[str], by: str, low: str, high: str, longest: int | None = None) -> DataFrame:
    """ids and the fold of each range (ids, by, low, high; both ends inside) that holds a bar.

    Ranges are few bytes that become many rows, so they are dealt by their first id before
    they are cut; where the blocks are small enough to be broadcast, nothing is dealt again.
    """
    tasks = int(ranges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = ranges.select(*ids, by, low, high).repartition(tasks, ids[0])
    return fold(pieces(dealt, tree, by, low, high, longest), ids, F.col("start"))


def line(n: Column, sy: Column, siy: Column, syy: Column) -> tuple[Column, Column]:
    """(slope, r2) of the line through n values y over their row numbers 0 .. n - 1."""
    n = n.cast("double")
    sxx = n * (n * n - 1) / 12
    sxy = siy - sy * (n - 1) / 2
    return sxy / sxx, sxy * sxy / (sxx * (syy - sy * sy / n))


def ranks(bars: DataFrame, by: str, at: str) -> DataFrame:
    """by, at, rank of each bar among its key's, from 0: numbers inside a largest block, moved by the rows of the blocks before."""
    x = bars.select(by, at, F.floor(F.col(at) / SIZES[-1]).alias("_top"))
    sizes = x.groupBy(by, "_top").agg(F.count("*").alias("_n"))
    before = sizes.select(by, "_top", F.coalesce(F.sum("_n").over(W.partitionBy(by).orderBy("_top").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    own = x.withColumn("_i", F.row_number().over(W.partitionBy(by, "_top").orderBy(at)) - 1)
    return own.join(before, [by, "_top"]).select(by, at, (F.col("_i") + F.col("_before")).alias("rank"))
