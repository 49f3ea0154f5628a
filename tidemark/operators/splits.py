"""Temporal splits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


# Names of the splits, in time order.
SPLITS = ("discovery", "validation", "sealed_test")


def chronological(counts: DataFrame, day: str, n: str, shares: tuple[float, float] = (0.70, 0.85)) -> DataFrame:
    """day, n, split: whole days to discovery, validation and confirmation by the events before them.

    Discovery also needs more than two days left, validation more than one; with fewer than
    three days they map in order. counts has a row a day, so its single ordered window is
    bounded by the calendar.
    """
    w = W.orderBy(day)
    x = counts.withColumn("_before", F.sum(n).over(w.rowsBetween(W.unboundedPreceding, 0)) - F.col(n))
    x = x.withColumn("_left", F.row_number().over(W.orderBy(F.desc(day)))).withColumn("_i", F.row_number().over(w))
    every = W.partitionBy()
    x = x.withColumn("_total", F.sum(n).over(every)).withColumn("_days", F.count("*").over(every))
    names = SPLITS
    by_share = F.when((F.col("_before") < F.col("_total") * shares[0]) & (F.col("_left") > 2), names[0]).when((F.col("_before") < F.col("_total") * shares[1]) & (F.col("_left") > 1), names[1]).otherwise(names[2])
    few = F.when(F.col("_i") == 1, names[0]).when(F.col("_i") == 2, names[1]).otherwise(names[2])
    x = x.withColumn("split", F.when(F.col("_days") < 3, few).otherwise(by_share))
    # repair: no split may stay empty; the last day is sealed, the day before it validates and the first discovers if none does
    has = lambda k: F.count(F.when(F.col("split") == names[k], 1)).over(every) > 0
    fix = F.when((F.col("_days") < 3), F.col("split")).when(~has(2) & (F.col("_left") == 1), names[2]).when(~has(1) & (F.col("_left") == 2), names[1]).when(~has(0) & (F.col("_i") == 1), names[0])
    return x.withColumn("split", F.coalesce(fix, "split")).select(day, n, "split")


def split_summary(days: DataFrame, day: str, n: str) -> DataFrame:
    """split, start_date, end_date, event_dates, events of each split; splits without days stay, with nulls and zeros."""
    spark = days.sparkSession
    names = spark.createDataFrame([(s, i) for i, s in enumerate(SPLITS)], "split string, _i int")
    each = days.groupBy("split").agg(F.min(day).alias("start_date"), F.max(day).alias("end_date"), F.count("*").alias("event_dates"), F.sum(n).alias("events"))
    return names.join(each, "split", "left").na.fill(0, ["event_dates", "events"]).drop("_i")


def fixed(day, first: str = "2026-06-09", second: str = "2026-06-24"):
    """Split by fixed last days (fixed values)."""
    return F.when(day <= F.lit(first).cast("date"), SPLITS[0]).when(day <= F.lit(second).cast("date"), SPLITS[1]).otherwise(SPLITS[2])
