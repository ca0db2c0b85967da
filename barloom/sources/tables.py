"""Market tables: declared schemas, keys and date columns, and the Parquet store that holds them."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass
from functools import reduce
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window, functions as F
from pyspark.sql.types import StructType

from ..functions.columns import require
from ..operators.windows import adjusted_prices


@dataclass(frozen=True)
class TableSpec:
    name: str
    ddl: str
    keys: tuple[str, ...]
    date_col: str | None = None
    needs: tuple[str, ...] = ()

    @property
    def schema(self) -> StructType:
        return StructType.fromDDL(self.ddl)

    @property
    def columns(self) -> list[str]:
        return [c.split()[0].strip("`") for c in self.ddl.split(", ")]


TEXTS = "symbol name area industry fullname enname cnspell market exchange curr_type list_status list_date delist_date is_hs act_name act_ent_type"
INDICATORS = "dif dea macd_hist k d j rsi6 rsi14 rsi24 ma5 ma10 ma20 ma60 boll_upper boll_mid boll_lower atr14"


def _typed(names: str, kind: str) -> str:
    return ", ".join(f"`{n}` {kind}" for n in names.split())


_BAR = "ts_code string, trade_date string, "
SPECS = {
    s.name: s
    for s in (
        TableSpec("stock_basic", "ts_code string, " + _typed(TEXTS, "string"), ("ts_code",)),
        TableSpec("trade_cal", "exchange string, cal_date string, is_open int, pretrade_date string", ("cal_date", "exchange"), "cal_date"),
        TableSpec("daily", _BAR + _typed("open high low close pre_close change pct_chg vol amount", "double"), ("ts_code", "trade_date"), "trade_date", ("stock_basic", "trade_cal")),
        TableSpec("adj_factor", _BAR + "adj_factor double", ("ts_code", "trade_date"), "trade_date", ("daily",)),
        TableSpec("daily_basic", _BAR + _typed("dv_ttm dv_ratio pb pe pe_ttm total_mv turnover_rate volume_ratio", "double"), ("ts_code", "trade_date"), "trade_date", ("daily",)),
        TableSpec("suspend_d", _BAR + "suspend_type string, suspend_timing string", ("ts_code", "trade_date", "suspend_type"), "trade_date", ("stock_basic",)),
        TableSpec("tech_indicator", _BAR + _typed(INDICATORS, "double"), ("ts_code", "trade_date"), "trade_date", ("daily", "adj_factor")),
    )
}
#: Tables that are views of others: the one that tells whether there is any, the view of a store, and all that it is made of.
VIEWS: dict[str, tuple[str, Callable[[Store], DataFrame], tuple[str, ...]]] = {}
#: What strategies read of each table.
MARKET = {
    "daily": (*"ts_code trade_date open high low close pre_close pct_chg vol amount".split(),), "adj_factor": ("ts_code", "trade_date", "adj_factor"),
    "daily_basic": (*"ts_code trade_date dv_ttm dv_ratio pb pe pe_ttm total_mv turnover_rate".split(),), "suspend_d": ("ts_code", "trade_date", "suspend_type"),
    "trade_cal": ("exchange", "cal_date", "is_open"), "stock_basic": (*"ts_code symbol name list_status list_date delist_date".split(),),
}
SYNC_ORDER = ("stock_basic", "trade_cal", "suspend_d", "daily", "adj_factor", "daily_basic", "tech_indicator")


def flag(column: Column) -> Column:
    """0 or 1 from the spellings that open-day flags come in: 1, "1", "1.0", true."""
    return F.when(F.lower(F.trim(column.cast("string"))).isin("1", "1.0", "true"), 1).when(column.isNotNull(), 0)


def conform(df: DataFrame, spec: TableSpec, also: Iterable[Column] = ()) -> DataFrame:
    """df with the table's columns and types, and ``also``; missing columns become nulls, bad numbers too."""
    have, cols = {c.lower(): c for c in df.columns}, []
    for f in spec.schema:
        if f.name.lower() not in have:
            cols.append(F.lit(None).cast(f.dataType).alias(f.name))
            continue
        c = F.col(f"`{have[f.name.lower()]}`")
        if f.name == "is_open":
            c = flag(c)
        elif f.name.endswith("_date"):
            c = F.lpad(F.regexp_replace(c.cast("string"), r"\.0$", ""), 8, "0")
        else:
            c = c.try_cast(f.dataType)
        cols.append(c.alias(f.name))
    return df.select(*cols, *also)


def condition(filters: Mapping[str, object]) -> Column:
    """A conjunction: a list means one of its values, anything else equality."""
    parts = [F.col(k).isin(list(v)) if isinstance(v, (list, tuple, set)) else F.col(k) == F.lit(v) for k, v in filters.items()]
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def kinds_of(files: DataFrame, spec: TableSpec) -> dict[str, list[str]]:
    """The paths of Parquet files (a frame of Spark's binaryFile source) by the types that they give the declared columns.

    Footers are read in tasks: directly where the path's store can be opened from there, else from the contents
    that Spark reads. The driver gets no more than the paths, and those only if there are several kinds.
    """
    wanted = {c.lower() for c in spec.columns}

    def kind(schema: pa.Schema) -> str:
        return ", ".join(sorted(f"{f.name} {f.type}" for f in schema if f.name.lower() in wanted))

    def by_path(batches):
        for batch in batches:
            found = []
            for path in batch.column(0).to_pylist():
                fs, name = pa.fs.FileSystem.from_uri(quote(path, safe=":/%"))
                with fs.open_input_file(name) as f:
                    found.append(kind(pq.read_schema(f)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string())], ["path", "kind"])

    def by_content(batches):
        for batch in batches:
            found = [kind(pq.read_schema(pa.BufferReader(x.as_buffer()))) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string())], ["path", "kind"])

    def kinds(found: DataFrame) -> dict[str, list[str]]:
        names = [r[0] for r in found.select("kind").distinct().collect()]
        paths = {k: [] for k in names}
        if len(names) > 1:
            for r in found.collect():
                paths[r.kind].append(r.path)
        return paths

    paths = files.select("path").repartition(files.sparkSession.sparkContext.defaultParallelism)
    try:
        return kinds(paths.mapInArrow(by_path, "path string, kind string"))
    except PySparkException as problem:
        if "ArrowInvalid" not in str(problem) and "OSError" not in str(problem):
            raise
        return kinds(files.select("path", "content").mapInArrow(by_content, "path string, kind string"))


class Store:
    """Parquet tables below a folder (any path that Spark reads), schemas united by column name."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def exists(self, table: str) -> bool:
        fs, p = self._fs(self.path(VIEWS[table][0] if self._is_view(table) else table))
        return fs.exists(p) and any(s.getPath().getName().endswith(".parquet") or s.isDirectory() for s in fs.listStatus(p))

    def _is_view(self, table: str) -> bool:
        return table in VIEWS and self.exists(VIEWS[table][0])

    def delete(self, path: str) -> None:
        fs, p = self._fs(path)
        fs.delete(p, True)

    def load(self, table: str, **filters) -> DataFrame:
        spec = SPECS[table]
        if self._is_view(table):
            return conform(VIEWS[table][1](self), spec).where(condition(filters))
        if not self.exists(table):
            return self.spark.createDataFrame([], spec.schema)
        return self._whole(table).where(condition(filters))

    def _whole(self, table: str, also: Iterable[Column] = ()) -> DataFrame:
        """All files with the declared columns: one scan for each schema that occurs, which tasks find in the files' footers."""
        spec, path = SPECS[table], self.path(table)
        files = self.spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").load(path)
        kinds = kinds_of(files, spec)
        read = self.spark.read.option("recursiveFileLookup", "true").parquet
        if len(kinds) <= 1:
            return conform(read(path), spec, also)
        return reduce(DataFrame.unionByName, (conform(read(*paths), spec, also) for paths in kinds.values()))

    def scan(self, table: str, columns: Iterable[str], start: str | None = None, end: str | None = None, codes: DataFrame | None = None) -> DataFrame:
        """Columns of a date range, optionally for the ts_codes of a frame only; a missing table is empty."""
        spec, df = SPECS[table], self.load(table)
        if spec.date_col and start:
            df = df.where(F.col(spec.date_col) >= start)
        if spec.date_col and end:
            df = df.where(F.col(spec.date_col) <= end)
        if codes is not None:
            df = df.join(codes.select("ts_code").distinct(), "ts_code", "left_semi")
        return df.select(*columns)

    def save(self, table: str, df: DataFrame, mode: str = "append") -> int:
        """Rows written; an empty frame changes nothing. The frame is computed once, into a staged copy.

        ``append`` moves the copy's files to the table; ``replace`` sets the old table aside, moves the copy in and
        drops the old one, so at any time one of the two is whole.
        """
        if mode not in ("append", "replace"):
            raise ValueError(f"unknown mode {mode!r}")
        staged = f"{self.root}/staged-{table}-{uuid.uuid4().hex}"
        seen = Observation()
        df.observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(staged)
        rows = seen.get["n"]
        fs, new = self._fs(staged)
        _, old = self._fs(self.path(table))
        if rows and mode == "append":
            fs.mkdirs(old)
            for status in fs.listStatus(new):
                if status.getPath().getName().endswith(".parquet"):
                    fs.rename(status.getPath(), self._fs(f"{self.path(table)}/{status.getPath().getName()}")[1])
        elif rows:
            _, aside = self._fs(f"{self.root}/old-{table}-{uuid.uuid4().hex}")
            if fs.exists(old):
                fs.rename(old, aside)
            fs.rename(new, old)
            fs.delete(aside, True)
        fs.delete(new, True)
        return rows

    def count(self, table: str) -> int:
        return self.load(table).count() if self.exists(table) else 0

    def latest(self, table: str) -> str | None:
        date = SPECS[table].date_col
        return self.load(table).agg(F.max(date)).first()[0] if date and self.exists(table) else None

    def drop(self, table: str) -> None:
        for name in (table, *(VIEWS[table][2] if table in VIEWS else ())):
            self.delete(self.path(name))

    def deduplicate(self, table: str) -> int:
        """Keeps the last row of each key in file order; returns how many went. Only files that hold a row to go are written anew.

        The new files come in before the old ones go: what breaks off in between leaves repeated rows, never fewer.
        """
        if self._is_view(table) or not self.exists(table):
            return 0
        order = {"_at": "file_modification_time", "_file": "file_path", "_row": "row_index"}
        places = [F.col(f"_metadata.{c}").alias(n) for n, c in order.items()]
        raw, gone = self._whole(table, places), f"{self.root}/gone-{table}-{uuid.uuid4().hex}"
        last = Window.partitionBy(*SPECS[table].keys).orderBy(*(F.desc_nulls_last(c) for c in order))
        keys = raw.select(*SPECS[table].keys, *order).withColumn("_place", F.row_number().over(last))
        seen = Observation()
        keys.where("_place > 1").select("_file", "_row").observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(gone)
        losers = self.spark.read.schema("_file string, _row long").parquet(gone)
        if seen.get["n"]:
            files = losers.select("_file").distinct()
            kept = raw.join(files, "_file", "left_semi").join(losers, ["_file", "_row"], "left_anti").drop(*order)
            old = [r[0] for r in files.collect()]  # names of the files to be replaced
            self.save(table, kept)
            for file in old:
                self.delete(file)
        self.delete(gone)
        return seen.get["n"]

    def deduplicate_all(self) -> dict[str, int]:
        return {t: self.deduplicate(t) for t in SPECS}

    def market(self, start: str, end: str, columns: Mapping[str, Iterable[str]] = MARKET) -> dict[str, DataFrame]:
        """The tables that strategies need, with their columns in a range of dates; bars carry prices adjusted to their last factor in it.

        A missing table is empty; a column that is not declared is an error.
        """
        for table, names in columns.items():
            require(self.spark.createDataFrame([], SPECS[table].schema), list(names), table)
        found = {t: self.scan(t, names, start, end) for t, names in columns.items()}
        return found | {"daily": adjusted_prices(found["daily"], found["adj_factor"])}

    def arrange(self, table: str, buckets: int = 64, years: Iterable[str] | None = None) -> DataFrame:
        """A copy of a table by instrument, partitioned by year and bucketed by ts_code, as a table of Spark's catalog.

        Windows and joins by ts_code over such copies need no exchange, and dates prune whole years; for joins by ts_code
        and trade_date spark.sql.requireAllClusterKeysForCoPartition has to be false. With ``years``, these alone are
        written again, each in place of its old partition.
        """
        name, spec = self.arranged_name(table), SPECS[table]
        df = self.load(table).withColumn("year", F.substring(spec.date_col, 1, 4))
        if years is None:
            self.spark.sql(f"drop table if exists {name}")
            df = df.repartition(buckets, "ts_code")
            df.write.mode("overwrite").format("parquet").partitionBy("year").bucketBy(buckets, "ts_code").sortBy("ts_code", "trade_date").option("path", f"{self.root}/arranged/{table}").saveAsTable(name)
        else:
            fresh = df.where(F.col("year").isin(list(years))).repartition(buckets, "ts_code")
            self.arranged(table, buckets)
            mode = "spark.sql.sources.partitionOverwriteMode"  # inserts take it from the session alone
            before = self.spark.conf.get(mode)
            self.spark.conf.set(mode, "dynamic")
            try:
                fresh.write.insertInto(name, overwrite=True)
            finally:
                self.spark.conf.set(mode, before)
        return self.arranged(table, buckets)

    def arranged_name(self, table: str) -> str:
        return f"arranged_{table}_{zlib.crc32(self.root.encode()):08x}"

    def arranged(self, table: str, buckets: int = 64) -> DataFrame:
        """The copy that ``arrange`` wrote; a session whose catalog doesn't know it yet registers it from its folder."""
        name = self.arranged_name(table)
        if not self.spark.catalog.tableExists(name):
            self.spark.sql(
                f"create table {name} ({SPECS[table].ddl}, year string) using parquet partitioned by (year) clustered by (ts_code) sorted by (ts_code, trade_date) into {buckets} buckets location '{self.root}/arranged/{table}'"
            )
            self.spark.sql(f"msck repair table {name}")
        return self.spark.table(name)

    def status(self) -> DataFrame:
        return table_status({t: self.load(t) for t in SPECS})

    def is_trade_day(self, date: str) -> bool:
        return bool(self.load("trade_cal").where((F.col("cal_date") == date) & (F.col("is_open") == 1)).limit(1).count())

    def query(self, table: str, where: str = "", limit: int = 10) -> DataFrame:
        """``where``: comma-separated column=value; limit 0 means all rows."""
        if not self.exists(table):
            raise FileNotFoundError(self.path(table))
        df = self.load(table).where(condition(dict(p.split("=", 1) for p in where.split(",") if p)))
        return df.limit(limit) if limit else df

    def export_csv(self, df: DataFrame, path: str) -> None:
        df.write.mode("overwrite").option("header", True).csv(path)


def keep_last(df: DataFrame, keys: Iterable[str], order: Iterable[str]) -> DataFrame:
    """The last row of each key in the given order."""
    name = "_place"
    last = Window.partitionBy(*keys).orderBy(*(F.desc_nulls_last(c) for c in order))
    return df.withColumn(name, F.row_number().over(last)).where(F.col(name) == 1).drop(name)


def table_status(tables: Mapping[str, DataFrame]) -> DataFrame:
    parts = []
    for name, df in tables.items():
        date = SPECS[name].date_col
        parts.append(df.agg(F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("n_rows"), (F.max(date) if date else F.lit(None).cast("string")).alias("latest_date")))
    all_of = reduce(DataFrame.unionByName, parts)
    return all_of.withColumn("state", F.when(F.col("n_rows") > 0, "ok").otherwise("empty"))
