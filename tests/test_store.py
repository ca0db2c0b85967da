"""The store: files of many schemas, repeated rows by file, the market bundle, copies arranged by instrument."""

import os
import re

import pytest

from barloom.operators import windows as w
from barloom.plans.strategies import MomentumReversal, ValueLowVol
from barloom.sources.tables import SPECS, Store, kinds_of

BAR = "ts_code string, trade_date string, open double, high double, low double, close double, vol double, amount double"


def bars(codes, days, price=10.0):
    return [(c, d, price, price + 1, price - 1, price + i % 7, 100.0, 1000.0) for c in codes for i, d in enumerate(days)]


def files(store, table):
    return {f for _, _, names in os.walk(store.path(table)) for f in names if f.endswith(".parquet")}


def test_kinds_of_files(spark, tmp_path):
    store, path = Store(spark, str(tmp_path / "a b")), str(tmp_path / "a b" / "daily")
    for i, kind in enumerate(("double", "string", "int", "float")):
        spark.sql(f"select concat('c', id) as ts_code, '2024010{i + 1}' as trade_date, cast(id as {kind}) as close, id as other from range(6)").repartition(3).write.mode("append").parquet(path)
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(path)
    kinds = kinds_of(found, SPECS["daily"])
    assert len(kinds) == 4 and sum(map(len, kinds.values())) == len(files(store, "daily"))
    got = store.load("daily", ts_code="c3").select("trade_date", "close", "vol").collect()
    assert sorted(map(tuple, got)) == [(f"2024010{i}", 3.0, None) for i in (1, 2, 3, 4)]
    assert store.load("daily").columns == SPECS["daily"].columns


def test_only_files_with_repeated_rows_are_written_anew(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    save = lambda rows: store.save("daily", spark.createDataFrame(rows, BAR).coalesce(1))
    save(bars(["a"], ["20240102", "20240103"]))
    save(bars(["b"], ["20240102", "20240103"]))
    untouched = files(store, "daily")
    assert store.deduplicate("daily") == 0 and files(store, "daily") == untouched
    save(bars(["a"], ["20240103"], 50.0))
    newest = files(store, "daily") - untouched
    assert store.deduplicate_all() == {t: int(t == "daily") for t in SPECS}
    left = files(store, "daily")
    assert len(left & untouched) == 1 and newest <= left
    assert {(r.ts_code, r.trade_date): r.open for r in store.load("daily").collect()} == {("a", "20240102"): 10.0, ("a", "20240103"): 50.0, ("b", "20240102"): 10.0, ("b", "20240103"): 10.0}
    assert not [f for f in os.listdir(tmp_path) if "-" in f]


def test_market_bundle(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    store.save("daily", spark.createDataFrame(bars(["a"], ["20240102", "20240103", "20240104"]), BAR))
    store.save("adj_factor", spark.createDataFrame([("a", "20240102", 1.0), ("a", "20240103", 2.0), ("a", "20240104", 4.0)], "ts_code string, trade_date string, adj_factor double"))
    early = store.market("20240101", "20240103")
    assert {r.trade_date: r.adj_open for r in early["daily"].collect()} == {"20240102": 5.0, "20240103": 10.0}
    assert {r.trade_date: r.adj_open for r in store.market("20240101", "20240104")["daily"].collect()}["20240102"] == 2.5
    assert early["suspend_d"].count() == 0 and "industry" not in early["stock_basic"].columns
    with pytest.raises(ValueError, match="daily lacks nothing_such"):
        store.market("20240101", "20240104", {"daily": ["nothing_such"]})


@pytest.fixture
def one_partitioning(spark):
    name = "spark.sql.requireAllClusterKeysForCoPartition"
    spark.conf.set(name, "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset(name)
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_arranged_tables_need_no_exchange_by_code(spark, tmp_path, one_partitioning):
    store = Store(spark, str(tmp_path))
    days = [f"2023{m:02}{d:02}" for m in range(1, 13) for d in range(1, 15)] + ["20240102", "20240103", "20240104"]
    codes = [f"{i:06}.SH" for i in range(6)]
    store.save("daily", spark.createDataFrame(bars(codes, days), BAR))
    store.save("adj_factor", spark.createDataFrame([(c, d, 1.0 + i / 10) for i, c in enumerate(codes) for d in days], "ts_code string, trade_date string, adj_factor double"))
    store.save("daily_basic", spark.createDataFrame([(c, d, 1.0, 2.0 + i, 9.0 + i) for i, c in enumerate(codes) for d in days], "ts_code string, trade_date string, dv_ttm double, pb double, pe_ttm double"))
    tables = {t: store.arrange(t, 4) for t in ("daily", "adj_factor", "daily_basic")}
    adjusted = w.adjusted_prices(tables["daily"], tables["adj_factor"].drop("year"))
    assert "Exchange" not in plan_of(adjusted.withColumn("ret", w.simple_return()))
    dates = spark.createDataFrame([("20240103",)], "trade_date string")
    plain = {t: store.load(t) for t in tables}
    for strategy in (MomentumReversal(momentum_days=20), ValueLowVol(lookback_days=20)):
        market = {t: df.drop("year") for t, df in tables.items()}
        signals = strategy.signals(market, dates)
        by_code = re.findall(r"hashpartitioning\(ts_code#\d+(?:, trade_date#\d+)?, \d+\)", plan_of(signals))
        assert len(by_code) <= 1, plan_of(signals)
        assert sorted(map(tuple, signals.collect())) == sorted(map(tuple, strategy.signals(plain, dates).collect())) != []
    scan = plan_of(tables["daily"].where("year = '2024'"))
    assert "PartitionFilters: [isnotnull(year" in scan and "SelectedBucketsCount" in plan_of(tables["daily"].groupBy("ts_code").count())
    # a year that grew is written in its place, and a session that doesn't know the table finds it
    store.save("daily", spark.createDataFrame(bars(codes, ["20240105"]), BAR))
    spark.sql(f"drop table {store.arranged_name('daily')}")
    before = {f for f in files(store, "arranged/daily/year=2023")}
    assert store.arrange("daily", 4, ["2024"]).count() == store.count("daily") == len(codes) * (len(days) + 1)
    assert {f for f in files(store, "arranged/daily/year=2023")} == before
    for t in tables:
        spark.sql(f"drop table if exists {store.arranged_name(t)}")
