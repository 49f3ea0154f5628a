"""Sources: landed Parquet and JSON, zipped header-optional CSV archives, layered scans, grouped payloads."""

from __future__ import annotations

import hashlib
import io
import zipfile

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.scalar import epoch_millis
from tidemark.operators.ordered import latest

#: Columns of a kline archive, in file order.
KLINE_COLUMNS = ["open_time", "open", "high", "low", "close", "volume", "close_time", "quote_volume", "trade_count", "taker_buy_base_volume", "taker_buy_quote_volume", "ignore"]
KLINE_DDL = "open_time long, open double, high double, low double, close double, volume double, close_time long, quote_volume double, trade_count long, taker_buy_base_volume double, taker_buy_quote_volume double"


def read_table(spark: SparkSession, path: str, columns: list[str] | None = None, where=None, order=(), limit: int | None = None, offset: int = 0) -> DataFrame:
    """A Parquet scan with projection, filter, order, limit and offset; the first two reach the scan."""
    df = spark.read.parquet(path)
    df = df.where(where) if where is not None else df
    df = df.select(*columns) if columns else df
    df = df.orderBy(*order) if order else df
    df = df.offset(offset) if offset else df
    return df.limit(limit) if limit is not None else df


def archive_path(root: str, kind: str, symbol: str, day: str, interval: str | None = None) -> str:
    """Where an archive of a symbol and day lies below a root."""
    parts = [root.rstrip("/"), kind, symbol, *([interval] if interval else [])]
    stem = "-".join([symbol, interval or kind, day])
    return "/".join([*parts, f"{stem}.zip"])


def read_kline_archives(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """symbol, klines, sha256 and path of zipped CSV archives, with or without a header row.

    Archives are read as binary files and unzipped in the tasks, one file at a time; rows
    whose numbers don't parse (headers) are dropped, and counted by ``archive_report``.
    Stamps may be milli- or microseconds.
    """
    df = _raw_klines(spark, paths)
    typed = [F.col(c.split()[0]).try_cast(c.split()[1]).alias(c.split()[0]) for c in KLINE_DDL.split(", ")]
    df = df.select("path", "sha256", F.regexp_extract("path", r"([^/]+)-[^/]*?-\d{4}-\d{2}-\d{2}\.zip$", 1).alias("symbol"), *typed)
    df = df.where("open_time is not null and close is not null")
    return df.withColumns({c: epoch_millis(F.col(c)) for c in ("open_time", "close_time")})


def archive_report(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """path, sha256, zip_ok, rows, header (whether the first row is one) and rejected (other rows that don't parse) of each archive."""
    schema = pa.schema([("path", pa.string()), ("sha256", pa.string()), ("zip_ok", pa.bool_()), ("rows", pa.int64()), ("header", pa.bool_()), ("rejected", pa.int64())])

    def number(x):
        try:
            return float(x) == float(x)
        except ValueError:
            return False

    def check(batches):
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                ok, good, bad, header = True, 0, 0, False
                try:
                    with zipfile.ZipFile(io.BytesIO(content)) as z:
                        ok = z.testzip() is None
                        for name in z.namelist():
                            for k, line in enumerate(io.TextIOWrapper(z.open(name), "utf-8")):
                                cells = line.rstrip("\r\n").split(",")
                                if len(cells) > 4 and number(cells[0]) and number(cells[4]):
                                    good += 1
                                elif k == 0:
                                    header = True
                                else:
                                    bad += 1
                except (zipfile.BadZipFile, UnicodeDecodeError):
                    ok = False
                yield pa.RecordBatch.from_pydict({"path": [path], "sha256": [hashlib.sha256(content).hexdigest()], "zip_ok": [ok], "rows": [good], "header": [header], "rejected": [bad]}, schema)

    return spark.read.format("binaryFile").load(paths).select("path", "content").mapInArrow(check, "path string, sha256 string, zip_ok boolean, rows long, header boolean, rejected long")


def _raw_klines(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """The text cells of all archives' rows."""
    schema = pa.schema([("path", pa.string()), ("sha256", pa.string()), *((c, pa.string()) for c in KLINE_COLUMNS)])

    def unzip(batches):
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                digest = hashlib.sha256(content).hexdigest()
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for name in z.namelist():
                        with z.open(name) as f:
                            rows = []
                            for line in io.TextIOWrapper(f, "utf-8"):
                                cells = (line.rstrip("\r\n").split(",") + [None] * 12)[:12]
                                rows.append((path, digest, *cells))
                                if len(rows) == 65536:
                                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows, strict=True)], schema=schema)
                                    rows = []
                            if rows:
                                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows, strict=True)], schema=schema)

    return spark.read.format("binaryFile").load(paths).select("path", "content").mapInArrow(unzip, ", ".join(f"{f.name} string" for f in schema))


def verify_checksums(archives: DataFrame, expected: DataFrame) -> DataFrame:
    """path, ok: archives against a table of expected SHA-256 sums; a missing sum is not ok."""
    return archives.select("path", "sha256").distinct().join(expected.withColumnRenamed("sha256", "want"), "path", "left").select("path", F.coalesce(F.col("sha256") == F.col("want"), F.lit(False)).alias("ok"))


def layered(primary: DataFrame, fallback: DataFrame, keys: list[str], at: str, day=None, read_order: str | None = None) -> DataFrame:
    """Rows of the primary layer, and of the fallback for the units (key and day) of which the primary has none.

    A unit never mixes layers: the archive of a day is taken or left as a whole. Without a
    day the unit is the key and the place itself. Of repeated rows of a layer the last in
    ``read_order`` stays (the largest by all columns without one).
    """
    unit = (day if day is not None else F.col(at)).alias("_unit")
    a = primary.withColumn("_unit", unit)
    b = fallback.withColumn("_unit", unit).join(a.select(*keys, "_unit").distinct(), [*keys, "_unit"], "left_anti")
    both = a.withColumn("layer", F.lit("archive")).unionByName(b.withColumn("layer", F.lit("fallback")), allowMissingColumns=True)
    order = [F.desc(read_order)] if read_order else [F.desc(c) for c in sorted(primary.columns) if c not in (*keys, at)]
    return latest(both, [*keys, at], order or [F.col("layer")]).drop("_unit")


def layer_manifest(rows: DataFrame, wanted: DataFrame, keys: list[str], day) -> DataFrame:
    """keys, day, source (archive, fallback or missing) and rows of every wanted unit."""
    got = rows.groupBy(*keys, day.alias("day")).agg(F.first("layer").alias("source"), F.count("*").alias("rows"))
    return wanted.join(got, [*keys, "day"], "left").withColumns({"source": F.coalesce("source", F.lit("missing")), "rows": F.coalesce("rows", F.lit(0).cast("long"))})


def requested_symbols(bars: DataFrame, requested: DataFrame, rejected: DataFrame) -> DataFrame:
    """Bars of requested symbols; symbols without bars, rejected ones too, stay as a row of nulls."""
    ok = requested.join(rejected, "symbol", "left_anti")
    return requested.join(bars.join(ok, "symbol", "left_semi"), "symbol", "left")


def grouped_payload(df: DataFrame, column: str, kind: str = "action_type") -> DataFrame:
    """Rows of a map from kind to a list of structs, the kind filled in where a struct has none."""
    x = df.select(F.explode(column).alias("_kind", "_rows")).select("_kind", F.explode("_rows").alias("_r")).select("_kind", "_r.*")
    return x.withColumn(kind, F.coalesce(kind, "_kind") if kind in x.columns else F.col("_kind")).drop("_kind")


# --- landed pages of paged interfaces ---------------------------------------------
# There is no network in the engine: pages are landed as rows (key, page, rows array) and
# scanned with the paged interface's own rules.


def read_symbol_master(spark: SparkSession, path: str) -> DataFrame:
    """A row for each symbol of landed symbol-master JSON (an object with a list of symbols)."""
    raw = spark.read.option("multiLine", True).json(path)
    s = F.col("s")
    fields = {f.name for f in raw.schema["symbols"].dataType.elementType.fields}
    take = lambda name, default: s[name] if name in fields else default
    none = F.lit(None)
    return raw.select(F.explode("symbols").alias("s")).select(
        s["symbol"].alias("symbol"), s["baseAsset"].alias("base_asset"), s["quoteAsset"].alias("quote_asset"), s["status"].alias("status"), take("permissions", none.cast("array<string>")).alias("permissions"), take("permissionSets", none.cast("array<array<string>>")).alias("permission_sets"), take("orderTypes", none.cast("array<string>")).alias("order_types")
    )


def read_json_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Landed JSON lines or documents (assets, calendars) under a declared schema; fields that don't fit are null."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def paged_klines(pages: DataFrame, key: str, start_ms: int, end_ms: int, step_ms: int) -> DataFrame:
    """Typed klines of landed pages (key, page, rows: array of text arrays) with start <= open_time < end.

    Pages are checked in order within a key: a page whose last row does not lie beyond that
    of the page before is an error, as the scan would not have advanced.
    """
    at = lambda x, i: F.get(x, F.lit(i))
    last = at(F.element_at("rows", -1), 0).cast("long")
    w = Window.partitionBy(key).orderBy("page")
    stuck = F.raise_error(F.concat(F.lit("pages did not advance: "), F.col(key).cast("string"))).cast("long")
    p = pages.where(F.size("rows") > 0).withColumn("_last", last).withColumn("_before", F.lag("_last").over(w))
    p = p.withColumn("_last", F.when(F.col("_before").isNotNull() & (F.col("_last") + step_ms <= F.col("_before")), stuck).otherwise(F.col("_last")))
    rows = p.where("_last is not null").select(key, F.explode("rows").alias("r"))
    typed = [at("r", i).try_cast(c.split()[1]).alias(c.split()[0]) for i, c in enumerate(KLINE_DDL.split(", "))]
    return rows.select(key, *typed).where((F.col("open_time") >= start_ms) & (F.col("open_time") < end_ms))


def paged_trades(pages: DataFrame, key: str, start_ms: int, end_ms: int, max_pages: int = 500, page_size: int = 1000) -> tuple[DataFrame, DataFrame]:
    """(trades, state) of landed trade pages (key, page from 1, rows: array of structs with a, T, p, q, m).

    Trades of the first ``max_pages`` pages with start <= T <= end, prices and quantities as
    doubles. state has pages, rows and truncated: whether the page limit ended the scan
    while the last page was full and had not passed the end.
    """
    p = pages.where(F.col("page") <= max_pages)
    last = F.element_at("rows", -1)
    done = (F.size("rows") < page_size) | F.coalesce(last["T"] > end_ms, F.lit(True))
    w = Window.partitionBy(key).orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
    # pages after the one that ended the scan were never asked for
    p = p.withColumn("_done", done).withColumn("_over", F.coalesce(F.max("_done").over(w), F.lit(False))).where(~F.col("_over"))
    inside = F.filter("rows", lambda r: (r["T"] >= start_ms) & (r["T"] <= end_ms))
    trades = p.select(key, F.explode(inside).alias("t")).select(key, F.col("t.a").alias("trade_id"), F.col("t.T").alias("ms"), F.col("t.p").cast("double").alias("price"), F.col("t.q").cast("double").alias("size"), F.col("t.m").alias("seller"))
    state = p.groupBy(key).agg(F.count("*").alias("pages"), F.sum(F.size(inside)).alias("rows"), (F.max("page") == max_pages).alias("_full"), F.max_by("_done", "page").alias("_ended"))
    return trades, state.select(key, "pages", "rows", (F.col("_full") & ~F.col("_ended")).alias("truncated"))


def tick_scan(ticks: DataFrame, symbol: str, start_ns: int, end_ns: int, at: str = "ts_ns") -> DataFrame:
    """Ticks of a symbol with start <= at < end; both predicates reach the scan."""
    return ticks.where((F.col("symbol") == symbol) & (F.col(at) >= start_ns) & (F.col(at) < end_ns))


def pages_of(df: DataFrame, order: list[str], size: int = 1000):
    """Lists of at most ``size`` rows in an order, fetched partition by partition: no more than one partition is at the driver."""
    held: list = []
    for row in df.orderBy(*order).toLocalIterator(prefetchPartitions=False):
        held.append(row)
        if len(held) == size:
            yield held
            held = []
    if held:
        yield held


def lookup(cache: DataFrame, keys: DataFrame, on: list[str], negatives_only: str | None = None) -> DataFrame:
    """Cached rows of the wanted keys; with ``negatives_only`` those whose flag column is true."""
    x = cache.join(keys.select(*on).distinct(), on, "left_semi")
    return x.where(F.coalesce(negatives_only, F.lit(False))) if negatives_only else x
