"""Market data from a vendor: one task for each table and trade date, through a fetcher that is handed in.

``fetch(table, date)`` gives rows as dictionaries; it runs on executors, so it must be picklable. Values may be of any
type: they travel as text and Spark casts them to the table's types (``conform``).
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..errors import ApiError
from .indicators import update_indicators
from .tables import SPECS, SYNC_ORDER, Store, conform

Fetch = Callable[[str, str | None], Iterable[dict]]
LOG = "table_name string, date string, n_rows long, error string, batch string, at timestamp"
DATES = 50  # fetched and committed together
AFTER = {"daily": ("suspend_d",)}  # order beyond what a table needs: a new day's suspensions come before its bars


def retried(call: Callable, *args, tries: int = 3, delay: float = 5.0, sleep: Callable[[float], None] = time.sleep):
    """call(*args), again after delay, 2 delay, 4 delay ...; ApiError when all tries failed."""
    for attempt in range(tries):
        try:
            return call(*args)
        except Exception as problem:  # whatever the vendor's client raises
            if attempt + 1 == tries:
                raise ApiError(f"gave up after {tries} tries: {problem}") from problem
            sleep(delay * 2**attempt)


class Day(InputPartition):
    def __init__(self, date: str | None):
        self.date = date


def text(value) -> str | None:
    """A value as text; None and NaN are nulls."""
    return None if value is None or value != value else str(value)


def vendor_source(fetch: Fetch, *, tries: int = 3, delay: float = 5.0, pause: float = 0.4) -> type[DataSource]:
    """A data source ``market_vendor`` with options table and dates (comma-separated; none for undated tables).

    Its columns are the table's, all as text, and two more: asked_date, and failure. A date whose fetch keeps
    failing gives one row with the failure's text instead of its rows, so other dates of the same job are kept.
    """

    class Vendor(DataSource):
        @classmethod
        def name(cls) -> str:
            return "market_vendor"

        def schema(self):
            return ", ".join(f"`{c}` string" for c in SPECS[self.options["table"]].columns) + ", asked_date string, failure string"

        def reader(self, schema):
            table, dates = self.options["table"], self.options.get("dates", "")
            names = SPECS[table].columns

            class Reader(DataSourceReader):
                def partitions(self):
                    return [Day(d) for d in dates.split(",") if d] or [Day(None)]

                def read(self, partition) -> Iterator[tuple]:
                    def rows():
                        return [tuple(text(row.get(n)) for n in names) for row in fetch(table, partition.date)]

                    try:
                        for row in retried(rows, tries=tries, delay=delay):
                            yield (*row, partition.date, None)
                    except ApiError as problem:
                        yield (*[None] * len(names), partition.date, str(problem))
                    time.sleep(pause)

            return Reader()

    return Vendor


def raw(spark: SparkSession, table: str, dates: Iterable[str] = ()) -> DataFrame:
    return spark.read.format("market_vendor").options(table=table, dates=",".join(dates)).load()


def log_of(store: Store) -> DataFrame:
    """The commits of single dates: how many rows were stored, or why none were."""
    path = store.path("sync_log")
    return store.spark.read.schema(LOG).parquet(path) if store.exists("sync_log") else store.spark.createDataFrame([], LOG)


def missing_days(store: Store, table: str, days: list[str]) -> list[str]:
    """Days without a commit; where no day has one, those after the table's latest date."""
    own = log_of(store).where(F.col("table_name") == table)
    done = {r[0] for r in own.where("error is null").select("date").distinct().collect()}  # a row for each day of the calendar at most
    if done or not own.isEmpty():
        return [d for d in days if d not in done]
    latest = store.latest(table) or ""
    return [d for d in days if d > latest]


def bring_days(store: Store, table: str, days: list[str], per_batch: int = DATES) -> dict:
    """Fetches days in batches; each batch's good days are stored and every day of it is logged, before the next begins.

    A day that was stored but not logged, because the process broke off in between, is asked for again; then
    its rows repeat keys, and the table's repeated rows are removed (the last ones stay).
    """
    spec, stored, failed = SPECS[table], 0, {}
    for at in range(0, len(days), per_batch):
        part, name = days[at : at + per_batch], uuid.uuid4().hex
        staged = f"{store.root}/staged-{table}-{name}"
        raw(store.spark, table, part).write.parquet(staged)
        got = store.spark.read.parquet(staged)
        per_day = got.groupBy("asked_date").agg(F.count(F.when(F.col("failure").isNull(), 1)).alias("n"), F.max("failure").alias("failure")).collect()  # a row a day
        found = {r.asked_date: r for r in per_day}
        again = spec.date_col and store.exists(table) and not store.load(table).where(F.col(spec.date_col).isin(part)).isEmpty()
        good = conform(got.where("failure is null"), spec)
        stored += store.save(table, good)
        if again:
            store.deduplicate(table)
        rows = [(table, d, found[d].n if d in found else 0, found[d].failure if d in found else None, name) for d in part]
        log = store.spark.createDataFrame(rows, LOG.rpartition(", ")[0]).withColumn("at", F.current_timestamp()).coalesce(1)
        store.save("sync_log", log)
        store.delete(staged)
        failed |= {r[1]: r[3] for r in rows if r[3] is not None}
    return {"rows": stored} | ({"failed": failed} if failed else {})


def bring(store: Store, table: str, days: list[str], derived: dict[str, Callable[[Store], DataFrame | int]]) -> dict:
    spec = SPECS[table]
    if table in derived:
        made = derived[table](store)
        return {"rows": made if isinstance(made, int) else store.save(table, made, "replace")}
    if spec.date_col is None or table == "trade_cal":
        got = raw(store.spark, table)
        staged = f"{store.root}/staged-{table}-{uuid.uuid4().hex}"
        got.write.parquet(staged)
        got = store.spark.read.parquet(staged)
        problem = got.agg(F.max("failure")).first()[0]
        try:
            if problem:
                raise ApiError(problem)
            return {"rows": store.save(table, conform(got, spec), "replace")}
        finally:
            store.delete(staged)
    done = bring_days(store, table, missing_days(store, table, days))
    if done.get("failed") and not done["rows"]:
        return {"error": next(iter(done["failed"].values())), **done}
    return done


def levels(tables: list[str]) -> list[list[str]]:
    """Tables that don't wait for one another, level by level, in their given order."""
    depth: dict[str, int] = {}

    def of(table: str) -> int:
        if table not in depth:
            depth[table] = 1 + max((of(t) for t in (*SPECS[table].needs, *AFTER.get(table, ())) if t in tables), default=-1)
        return depth[table]

    return [[t for t in tables if of(t) == level] for level in range(1 + max(map(of, tables), default=-1))]


def sync(store: Store, days: Iterable[str], tables: Iterable[str] = SYNC_ORDER, derived: dict[str, Callable[[Store], DataFrame | int]] | None = None, *, parallel: int = 4) -> dict[str, dict]:
    """Brings tables up to date: each takes the open days that it has no commit of.

    A table whose needs are missing brings those first. Tables that don't wait for one another run side by side, each
    in its own pool of a fair scheduler. ``derived`` tables are worked out from the store and never asked of the
    vendor: by default tech_indicator, from the bars behind its states. The result has for each table rows, or an error
    that stopped it, and the days that failed, which the next call asks for again; other tables go on.
    """
    days = sorted(days)
    derived = {"tech_indicator": update_indicators, **(derived or {})}
    wanted: list[str] = []

    def want(table: str) -> None:
        for need in SPECS[table].needs:
            if need not in wanted and not store.exists(need):
                want(need)
        if table not in wanted:
            wanted.append(table)

    asked = list(tables)
    for table in asked:
        want(table)
    done: dict[str, dict] = {}

    def one(table: str) -> dict:
        store.spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"sync-{table}")
        try:
            return bring(store, table, days, derived)
        except Exception as problem:  # one table's failure is its own
            return {"error": str(problem)}
        finally:
            store.spark.sparkContext.setLocalProperty("spark.scheduler.pool", None)

    with ThreadPoolExecutor(parallel) as pool:
        for level in levels(wanted):
            for table, result in zip(level, list(pool.map(inheritable_thread_target(store.spark)(one), level))):
                done[table] = result
    return {t: done[t] for t in wanted}


def safe_end(has_data: Callable[[str], bool], open_days: Iterable[str], back: int = 5) -> str | None:
    """The latest of the last open days for which a probe finds data."""
    return next((d for d in sorted(open_days, reverse=True)[:back] if has_data(d)), None)
