"""Paged interfaces as a Spark data source: ``spark.read.format("pages")`` and ``spark.readStream.format("pages")``.

What a paged interface answered is landed as one JSON document a page, in
``<path>/<symbol>/<yyyy-mm-dd>/<number>.json``. A batch scan has a partition for each symbol
and day and applies the interface's own rules while it pages: rows outside the asked time
leave, a page must lie beyond the one before it, and a unit ends at the first page that is
not full or passes the end; a scan that reaches ``maxPages`` while more was to come marks the
rows of its last page as ``truncated``. One page is in memory at a time.

Filters on symbol and time are pushed into the scan where the session allows it
(spark.sql.python.filterPushdown.enabled, and the option pushdown, which ``scan_pages`` sets):
units outside them are never planned, and none of their files is opened. A stream's offset
names the last landed page of each symbol, and a trigger takes what has landed since the one
before, a partition for each symbol and day. Pages of a symbol must land in their order.

Options: path; kind (trades, quotes or klines); symbols (comma-separated; all without);
startMs, endMs (of trades and quotes the end is part of the scan, of klines it is not);
pageSize (1000), maxPages (500; batch scans only).

Defined cases: a missing or empty folder has no units; empty pages end a unit; fields that
are missing are null; a number that does not parse is null.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.pandas.types import from_arrow_schema

DAY_MS = 86_400_000

# The fields of a page's rows by kind, with the columns they become; klines are lists, in this order.
FIELDS = {
    "trades": {"a": ("trade_id", pa.int64()), "T": ("ms", pa.int64()), "p": ("price", pa.float64()), "q": ("size", pa.float64()), "m": ("seller", pa.bool_())},
    "quotes": {"a": ("quote_id", pa.int64()), "T": ("ms", pa.int64()), "bp": ("bid_price", pa.float64()), "bs": ("bid_size", pa.int64()), "ap": ("ask_price", pa.float64()), "as": ("ask_size", pa.int64())},
    "klines": {i: x for i, x in enumerate([("ms", pa.int64()), ("open", pa.float64()), ("high", pa.float64()), ("low", pa.float64()), ("close", pa.float64()), ("volume", pa.float64()), ("close_ms", pa.int64()), ("quote_volume", pa.float64()), ("trade_count", pa.int64())])},
}
_CASTS = {pa.int64(): int, pa.float64(): float, pa.bool_(): bool}


def schema_of(kind: str) -> pa.Schema:
    return pa.schema([("symbol", pa.string()), *FIELDS[kind].values(), ("page", pa.int32()), ("truncated", pa.bool_())])


class Landed:
    """Pages below a folder, on any file system pyarrow knows."""

    def __init__(self, path: str):
        self.files, self.root = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)

    def _names(self, *parts: str) -> list[str]:
        found = self.files.get_file_info(fs.FileSelector("/".join([self.root, *parts]), allow_not_found=True))
        return sorted(f.base_name for f in found)

    def symbols(self) -> list[str]:
        return self._names()

    def days(self, symbol: str) -> list[str]:
        return self._names(symbol)

    def pages(self, symbol: str, day: str) -> list[int]:
        return [int(n[:-5]) for n in self._names(symbol, day) if n.endswith(".json") and n[:-5].isdigit()]

    def page(self, symbol: str, day: str, number: int) -> list:
        with self.files.open_input_stream(f"{self.root}/{symbol}/{day}/{number:06d}.json") as f:
            return json.loads(f.read())


def _day_start(day: str) -> int:
    return int(datetime.fromisoformat(day).replace(tzinfo=UTC).timestamp() * 1000)


def _value(x, kind: pa.DataType):
    try:
        return None if x is None else _CASTS[kind](x)
    except ValueError:
        return None


class Scan:
    """The options of a scan and the rules by which a page's rows become a batch."""

    def __init__(self, options):
        self.path, self.kind = options["path"], options.get("kind", "trades")
        self.symbols = {s for s in options.get("symbols", "").split(",") if s} or None
        whole = lambda name, default: int(options.get(name, default))
        self.page_size, self.max_pages = whole("pageSize", 1000), whole("maxPages", 500)
        # both ends are part of the range from here on
        self.low = whole("startMs", -(2**62))
        self.high = whole("endMs", 2**62) - (self.kind == "klines")
        self.schema = schema_of(self.kind)

    def narrow(self, f: Filter) -> bool:
        """Takes a filter into the scan; whether it is fully applied there."""
        column = ".".join(getattr(f, "attribute", ()))
        if column == "symbol" and isinstance(f, (EqualTo, In)):
            wanted = {f.value} if isinstance(f, EqualTo) else set(f.value)
            self.symbols = wanted if self.symbols is None else self.symbols & wanted
        elif column == "ms" and isinstance(f, (EqualTo, GreaterThanOrEqual, GreaterThan, LessThanOrEqual, LessThan)):
            if isinstance(f, (EqualTo, GreaterThanOrEqual, GreaterThan)):
                self.low = max(self.low, f.value + isinstance(f, GreaterThan))
            if isinstance(f, (EqualTo, LessThanOrEqual, LessThan)):
                self.high = min(self.high, f.value - isinstance(f, LessThan))
        else:
            return False
        return True

    def batch(self, symbol: str, rows: list, page: int, truncated: bool) -> pa.RecordBatch:
        key = list(FIELDS[self.kind])[0 if self.kind == "klines" else 1]
        get = (lambda r, k: r[k] if k < len(r) else None) if self.kind == "klines" else (lambda r, k: r.get(k))
        kept = [r for r in rows if self.low <= int(get(r, key)) <= self.high]
        columns = [pa.array([symbol] * len(kept), pa.string())]
        columns += [pa.array([_value(get(r, k), kind) for r in kept], kind) for k, (_, kind) in FIELDS[self.kind].items()]
        columns += [pa.array([page] * len(kept), pa.int32()), pa.array([truncated] * len(kept), pa.bool_())]
        return pa.RecordBatch.from_arrays(columns, schema=self.schema)

    def last(self, rows: list) -> tuple[int, int]:
        """(time, id) of a page's last row; a kline's id is its time."""
        row = rows[-1]
        return (int(row[0]), int(row[0])) if self.kind == "klines" else (int(row["T"]), int(row["a"]))


class Unit(InputPartition):
    """The pages of one symbol and day; with numbers, those only."""

    def __init__(self, symbol: str, day: str, numbers: list[int] | None = None):
        self.symbol, self.day, self.numbers = symbol, day, numbers


class PagesReader(DataSourceReader):
    def __init__(self, scan: Scan):
        self.scan = scan

    def partitions(self) -> list[Unit]:
        landed, scan = Landed(self.scan.path), self.scan
        names = landed.symbols() if scan.symbols is None else sorted(scan.symbols)
        return [Unit(s, d) for s in names for d in landed.days(s) if _day_start(d) <= scan.high and _day_start(d) + DAY_MS > scan.low] or [Unit("", "")]

    def read(self, partition: Unit) -> Iterator[pa.RecordBatch]:
        if not partition.day:
            return
        landed, scan, before = Landed(self.scan.path), self.scan, None
        for taken, number in enumerate(landed.pages(partition.symbol, partition.day), 1):
            rows = landed.page(partition.symbol, partition.day, number)
            if not rows:
                return
            place = scan.last(rows)
            if before is not None and place <= before:
                raise ValueError(f"pages of {partition.symbol} did not advance on {partition.day}")
            before = place
            over = len(rows) < scan.page_size or place[0] > scan.high
            yield scan.batch(partition.symbol, rows, number, taken == scan.max_pages and not over)
            if over or taken == scan.max_pages:
                return


class PushedReader(PagesReader):
    """Takes filters; Spark refuses such a reader where pushdown into Python sources is off."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        return (f for f in filters if not self.scan.narrow(f))


class PagesStreamReader(DataSourceStreamReader):
    """Offsets are {symbol: {day, page}}, the last page that has landed; symbols that are not in one have none yet.

    An offset depends on the folder alone, so a restarted stream goes on from what its
    checkpoint has, and a replayed epoch reads the same pages.
    """

    def __init__(self, scan: Scan):
        self.scan = scan

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        landed, scan, found = Landed(self.scan.path), self.scan, {}
        for symbol in landed.symbols() if scan.symbols is None else sorted(scan.symbols):
            for day in reversed(landed.days(symbol)):
                if numbers := landed.pages(symbol, day):
                    found[symbol] = {"day": day, "page": numbers[-1]}
                    break
        return found

    def partitions(self, start: dict, end: dict) -> list[Unit]:
        landed, units = Landed(self.scan.path), []
        for symbol, stop in sorted(end.items()):
            after = start.get(symbol, {"day": "", "page": 0})
            for day in landed.days(symbol):
                if after["day"] <= day <= stop["day"]:
                    numbers = [n for n in landed.pages(symbol, day) if (after["day"], after["page"]) < (day, n) <= (stop["day"], stop["page"])]
                    if numbers:
                        units.append(Unit(symbol, day, numbers))
        return units

    def read(self, partition: Unit) -> Iterator[pa.RecordBatch]:
        landed = Landed(self.scan.path)
        for number in partition.numbers:
            if rows := landed.page(partition.symbol, partition.day, number):
                yield self.scan.batch(partition.symbol, rows, number, False)

    def commit(self, end: dict) -> None:
        """Nothing to do: pages stay where they landed."""


class PagesSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "pages"

    def schema(self):
        return from_arrow_schema(schema_of(self.options.get("kind", "trades")))

    def reader(self, schema) -> PagesReader:
        return (PushedReader if self.options.get("pushdown") == "true" else PagesReader)(Scan(self.options))

    def streamReader(self, schema) -> PagesStreamReader:
        return PagesStreamReader(Scan(self.options))


def register(spark: SparkSession) -> None:
    """Makes the format known to a session."""
    spark.dataSource.register(PagesSource)


def scan_pages(spark: SparkSession, path: str, kind: str = "trades", **options) -> DataFrame:
    """A batch scan of landed pages; options as the module says."""
    register(spark)
    pushdown = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    return spark.read.format("pages").options(path=path, kind=kind, pushdown=pushdown, **{k: str(v) for k, v in options.items()}).load()


def stream_pages(spark: SparkSession, path: str, kind: str = "trades", **options) -> DataFrame:
    """A stream of landed pages; options as the module says."""
    register(spark)
    return spark.readStream.format("pages").options(path=path, kind=kind, **{k: str(v) for k, v in options.items()}).load()


def land_pages(rows: DataFrame, path: str, at: str, seq: str, page_size: int = 1000, kind: str = "trades", key: str = "symbol") -> DataFrame:
    """Writes rows as landed pages of at most ``page_size`` rows and returns symbol, day, page and rows of each.

    rows has the key, at (epoch ms), seq and the kind's fields by their names in a page.
    Numbers of a page are by (at, seq) within key and day. A page is written by one task
    under its final name, so a repeated task writes the same file again.
    """
    day = F.date_format(F.timestamp_millis(F.col(at)), "yyyy-MM-dd")
    place = F.row_number().over(Window.partitionBy(key, "day").orderBy(at, seq)) - 1
    x = rows.withColumn("day", day).withColumn("page", (F.floor(place / page_size) + 1).cast("int"))
    names = list(FIELDS[kind])
    body = F.array(*(F.col(f"_{i}") for i in names)) if kind == "klines" else F.struct(*names)
    # a page's rows are at most page_size
    pages = x.groupBy(F.col(key).cast("string").alias("symbol"), "day", "page").agg(F.sort_array(F.collect_list(F.struct(at, seq, body.alias("body")))).alias("rows"))
    pages = pages.select("symbol", "day", "page", F.to_json(F.col("rows.body")).alias("body"), F.size("rows").alias("rows"))

    def write(batches):
        landed = Landed(path)
        for batch in batches:
            for symbol, day, page, body in zip(*(batch.column(c).to_pylist() for c in ("symbol", "day", "page", "body")), strict=True):
                landed.files.create_dir(f"{landed.root}/{symbol}/{day}", recursive=True)
                with landed.files.open_output_stream(f"{landed.root}/{symbol}/{day}/{page:06d}.json") as f:
                    f.write(body.encode())
            yield batch.select(["symbol", "day", "page", "rows"])

    return pages.mapInArrow(write, "symbol string, day string, page int, rows int")
