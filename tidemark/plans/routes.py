"""Named read queries over a study's tables: each filters, orders and cuts one table.

A route names its table, which filters it takes and how they compare, its order, and the
most rows it gives. Tables are Parquet below a folder; filters that aren't given don't apply.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Route:
    """How a read query goes: compare maps a filter's name to (column, comparison)."""

    table: str
    order: tuple[tuple[str, bool], ...]
    compare: dict[str, tuple[str, str]] = field(default_factory=dict)
    always: dict[str, object] = field(default_factory=dict)
    search: tuple[str, ...] = ()
    most: int | None = None


UP, DOWN = True, False
#: Comparisons by name: of a column and the value given.
COMPARE = {
    "equals": lambda c, v: c == v,
    "at_least": lambda c, v: c >= v,
    "below": lambda c, v: c < v,
    "one_of": lambda c, v: c.isin(*v),
    "none_of": lambda c, v: ~c.isin(*v),
    "missing": lambda c, v: c.isNull() if v else c.isNotNull(),
}
_of = lambda *names: {n: (n, "equals") for n in names}

# Tables, orders and limits of the read interface.
ROUTES = {
    "scans": Route("scans", (("created_at", DOWN),), most=50),
    "scan": Route("scans", (), _of("id"), most=1),
    "results": Route("results", (("event_date", DOWN), ("high_vs_prior_close_pct", DOWN)), {**_of("scan_id", "currently_tradable"), "minimum_gain": ("high_vs_prior_close_pct", "at_least")}, search=("symbol", "company"), most=5000),
    "result_bars": Route("bars", (("ts", UP),), _of("result_id")),
    "export": Route("results", (("event_date", UP), ("symbol", UP)), _of("scan_id")),
    "research_jobs": Route("research_jobs", (("created_at", DOWN),), most=50),
    "research_events": Route("research_events", (("event_date", DOWN), ("symbol", UP)), _of("research_job_id", "eligible", "status"), most=5000),
    "research_files": Route("research_files", (("created_at", UP),), {**_of("research_job_id", "research_event_id"), "kinds": ("kind", "one_of"), "other_than": ("kind", "none_of"), "job_level": ("research_event_id", "missing")}),
    "control_pairs": Route("control_pairs", (("event_date", DOWN), ("positive_symbol", UP), ("control_rank", UP)), _of("control_job_id"), most=5000),
    "control_observations": Route("control_observations", (("event_date", DOWN), ("symbol", UP)), _of("control_job_id", "status"), most=5000),
    "control_diagnostics": Route("control_diagnostics", (("event_date", DOWN), ("positive_symbol", UP)), _of("control_job_id"), most=5000),
    "entry_assessments": Route("entry_assessments", (("event_date", DOWN), ("symbol", UP)), _of("entry_job_id", "primary_actionable"), most=5000),
    "entry_files": Route("entry_files", (("created_at", UP),), _of("entry_job_id", "kind")),
    "backtest_trades": Route("backtest_trades", (("trade_date", DOWN), ("strategy", UP), ("rank", UP)), _of("backtest_job_id"), most=5000),
    "backtest_files": Route("backtest_files", (("created_at", UP),), _of("backtest_job_id", "kind")),
    "sellable_events": Route("events", (("event_date", UP), ("symbol", UP)), _of("scan_id"), {"sellability_pass": True}),
    "candidate_events": Route("events", (("event_date", UP), ("symbol", UP)), _of("scan_id")),
    "decisions": Route("decisions", (("symbol", UP), ("decision_time", UP)), _of("scan_id")),
    "event_minutes": Route("minutes", (("open_time", UP),), _of("event_id")),
    "event_trades": Route("trades", (("trade_time", UP),), _of("event_id")),
}


def select(df: DataFrame, route: Route, search: str | None = None, limit: int | None = None, offset: int = 0, **filters) -> DataFrame:
    """A route over its table's rows; an unknown filter is an error, a limit never exceeds the route's own."""
    for column, value in route.always.items():
        df = df.where(F.col(column) == value)
    for name, value in filters.items():
        column, how = route.compare[name]
        df = df.where(COMPARE[how](F.col(column), value))
    if search and route.search:
        hit = F.lit(False)
        for column in route.search:
            hit = hit | F.coalesce(F.contains(F.lower(column), F.lit(search.lower())), F.lit(False))
        df = df.where(hit)
    if route.order:
        df = df.orderBy(*(F.asc(c) if up else F.desc(c) for c, up in route.order))
    most = min(x for x in (limit, route.most, 2**31 - 1) if x is not None)
    df = df.offset(offset) if offset else df
    return df.limit(most) if most < 2**31 - 1 else df


def read(spark: SparkSession, folder: str, name: str, **options) -> DataFrame:
    """A named route over the tables of a folder."""
    route = ROUTES[name]
    return select(spark.read.parquet(f"{folder}/{route.table}.parquet"), route, **options)


def may_create(jobs: DataFrame, sources: DataFrame, source: str, key: str = "source_id") -> bool:
    """Whether a job may be created: its source is completed, and no job of it is active or completed."""
    ready = sources.where((F.col("id") == source) & (F.col("status") == "completed")).limit(1)
    twin = jobs.where((F.col(key) == source) & F.col("status").isin("queued", "running", "completed")).limit(1)
    return not ready.isEmpty() and twin.isEmpty()


def retried(jobs: DataFrame, job: str) -> DataFrame:
    """The jobs with one set back to queued, if it had failed; others stay as they are."""
    again = (F.col("id") == job) & (F.col("status") == "failed")
    return jobs.withColumn("status", F.when(again, "queued").otherwise(F.col("status")))
