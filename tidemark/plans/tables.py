"""Views of the driver tables as market series: users are symbols, events are ticks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DAY = 86400


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ticks(spark: SparkSession, sf_dir: str, kind: str | None = None) -> DataFrame:
    """symbol, seq, us (epoch microseconds), sec, price, kind."""
    e = load(spark, sf_dir, "events")
    if kind:
        e = e.where(F.col("event_type") == kind)
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    return e.select(F.col("user_id").alias("symbol"), F.col("event_id").alias("seq"), us.alias("us"), F.expr("unix_micros(cast(ts as timestamp)) div 1000000").alias("sec"), F.col("value").alias("price"), F.col("event_type").alias("kind"))


#: The same view for the oracles.
TICKS = "SELECT user_id AS symbol, event_id AS seq, epoch_us(ts) AS us, epoch_us(ts) // 1000000 AS sec, value AS price, event_type AS kind FROM events"


def daily_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol (priority), day, open, high, low, close, n of orders as daily bars."""
    o = load(spark, sf_dir, "orders").select("o_orderpriority", F.col("o_orderdate").cast("date").alias("day"), "o_orderkey", "o_totalprice")
    return o.groupBy(F.col("o_orderpriority").alias("symbol"), "day").agg(F.min_by("o_totalprice", "o_orderkey").alias("open"), F.max("o_totalprice").alias("high"), F.min("o_totalprice").alias("low"), F.max_by("o_totalprice", "o_orderkey").alias("close"), F.count("*").alias("n"))


DAILY = "SELECT o_orderpriority AS symbol, CAST(o_orderdate AS DATE) AS day, arg_min(o_totalprice, o_orderkey) AS open, max(o_totalprice) AS high, min(o_totalprice) AS low, arg_max(o_totalprice, o_orderkey) AS close, count(*) AS n FROM orders GROUP BY 1, 2"


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, so engines that sum in another order agree; a negative zero becomes zero."""
    return df.select(*((F.round(c, digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))
