"""The backtest makes bars once for all strategies, and what it reads off them equals the tables joined one by one."""

import functools

import pytest
from pyspark.sql import DataFrame, functions as F

from barloom.operators import simulate, windows as w
from barloom.plans import catalog, strategies
from barloom.sources.adapter import Market

SMALL = "/root/testdata/sf0.001"


def same(a, b):
    assert a.columns == b.columns and sorted(map(repr, a.collect())) == sorted(map(repr, b.collect()))


@pytest.mark.parametrize("name", ["backtest_trades", "backtest_equity"])
def test_a_backtest_reads_lines_once_more_when_signals_are_there(spark, name):
    plan = catalog.QUERIES[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("lineitem.parquet]") == 1


def test_measures_need_one_exchange_of_the_bars(spark):
    m = Market(spark, SMALL)
    dates = spark.createDataFrame([("19950131",)], "trade_date string")
    plan = strategies.measured(catalog.BACKTESTED, m.bars(), m.stock_basic, dates)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("REPARTITION_BY_COL") == 1 and plan.count("Exchange hashpartitioning") <= 3  # the others are of stock_basic and dates


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Lines without supplier, without date and without orderkey among those of sf0.001."""
    path = str(tmp_path_factory.mktemp("odd"))
    lines = spark.read.parquet(f"{SMALL}/lineitem.parquet")
    more = lines.limit(300).withColumns({
        "l_suppkey": F.when(F.col("l_linenumber") != 1, F.col("l_suppkey")), "l_shipdate": F.when(F.col("l_linenumber") != 2, F.col("l_shipdate")),
        "l_orderkey": F.when(F.col("l_linenumber") != 3, F.col("l_orderkey")),
    })
    lines.unionByName(more).write.parquet(f"{path}/lineitem.parquet")
    for name in ("orders", "supplier"):
        spark.read.parquet(f"{SMALL}/{name}.parquet").write.parquet(f"{path}/{name}.parquet")
    return Market(spark, path)


def test_bars_side_by_side_equal_joined_tables(odd):
    same(odd.bars().select(odd.daily.columns), odd.daily)
    names = ["ts_code", "trade_date", "factor", "adj_open", "adj_close"]
    same(w.adjusted_prices(odd.bars()).select(names), w.adjusted_prices(odd.daily, odd.adj_factor).select(names))
    same(odd.bars().where("basic is not null").select("ts_code", F.col("basic.as_of_date").alias("trade_date"), *(f"basic.{c}" for c in odd.daily_basic.columns[2:])), odd.daily_basic)
    names = ["ts_code", "trade_date", "can_buy", "can_sell"]
    bars = w.adjusted_prices(odd.bars())
    same(simulate.prepared_bars(bars, None, simulate.Costs()).select(names), simulate.prepared_bars(bars.drop("suspended"), odd.suspend_d, simulate.Costs()).select(names))
    codes = odd.stock_basic.limit(3).select("ts_code")
    same(odd.bars(codes), odd.bars().join(codes, "ts_code", "left_semi").select(odd.bars().columns))


def test_signals_of_runs_equal_each_strategy(odd):
    dates = catalog.month_ends(odd)
    runs = catalog.BACKTESTED | {"volatile": strategies.MomentumReversal(volatility_weight=0.2, skip_days=1), "loose": strategies.VolumePriceBreakout(volume_multiplier=0.1, min_pct_chg=-50.0)}
    each = [s.signals(odd.tables(), dates).select(F.lit(n).alias("run_id"), "signal_date", "ts_code", "weight") for n, s in runs.items()]
    found = strategies.signals_of_runs(runs, strategies.measured(runs, odd.bars(), odd.stock_basic, dates))
    assert {r.run_id for r in found.select("run_id").distinct().collect()} >= {"dividend", "value", "momentum", "volatile", "loose"}
    same(found, functools.reduce(DataFrame.unionByName, each))


def test_factors_fill_both_ways(spark):
    rows = [("a", f"2024010{i}", v) for i, v in enumerate((None, None, 2.0, None, 3.0, None))] + [("b", "20240101", None)]
    df = spark.createDataFrame(rows, "ts_code string, trade_date string, f double").withColumn("f", w.fill_both_ways("f"))
    assert [r.f for r in df.orderBy("ts_code", "trade_date").collect()] == [2.0, 2.0, 2.0, 2.0, 3.0, 3.0, None]
