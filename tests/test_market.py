"""Hand-checked cases of the market operators."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.functions.columns import active_universe, limit_flags
from barloom.operators import calendar, cross, kernels, simulate, windows as w
from barloom.plans import screeners, strategies
from barloom.sources.tables import SPECS, Store, conform, keep_last

DAYS = ["20240102", "20240103", "20240104", "20240105"]
FREE = simulate.Costs(commission_rate=0, min_commission=0, stamp_duty_rate=0, slippage_rate=0, lot_size=1)


def bars(spark, rows):
    """rows: code, date, open, close, pre_close."""
    df = spark.createDataFrame(rows, "ts_code string, trade_date string, open double, close double, pre_close double")
    return df.withColumns({"high": F.greatest("open", "close"), "low": F.least("open", "close"), "pct_chg": (F.col("close") / F.col("pre_close") - 1) * 100, "vol": F.lit(100.0), "amount": F.lit(1e6), "adj_open": F.col("open"), "adj_close": F.col("close")})


def one_stock(spark, opened=10.0, closed=10.0, without=None):
    return bars(spark, [("000001.SZ", d, opened if d == DAYS[1] else 10.0, closed if d == DAYS[1] else 10.0, 10.0) for d in DAYS if d != without])


def run(spark, df, costs=FREE, suspended=(), signals=None, cash=10_000.0):
    signals = [(d, "000001.SZ", 1.0) for d in DAYS] if signals is None else signals
    sig = spark.createDataFrame([("r", *s) for s in signals], "run_id string, signal_date string, ts_code string, weight double")
    marks = spark.createDataFrame([("r", d) for d in DAYS], "run_id string, signal_date string")
    days = spark.createDataFrame([(d,) for d in DAYS], "trade_date string")
    off = spark.createDataFrame([("000001.SZ", d, "S") for d in suspended], "ts_code string, trade_date string, suspend_type string")
    result = simulate.simulate(sig, marks, df, days, off, cash, costs).cache()
    return simulate.equity_of(result).orderBy("trade_date").collect(), simulate.trades_of(result).orderBy("trade_date").collect()


def test_signals_trade_on_the_next_day(spark):
    equity, trades = run(spark, one_stock(spark))
    assert [(t.signal_date, t.trade_date, t.side, t.shares) for t in trades] == [("20240102", "20240103", "buy", 1000.0)]
    assert [e.equity for e in equity] == [10_000.0] * 4


def test_costs_lower_equity_and_cash_stays_positive(spark):
    equity, trades = run(spark, one_stock(spark), simulate.Costs(lot_size=1))
    assert equity[-1].equity < 10_000 and all(e.cash >= -1e-9 and math.isclose(e.equity, e.cash + e.positions_value) for e in equity)


@pytest.mark.parametrize("opened, closed, suspended, bought", [(11.0, 11.0, (), False), (10.0, 11.0, (), True), (10.0, 10.0, (DAYS[1],), False)])
def test_limits_and_suspensions_block(spark, opened, closed, suspended, bought):
    _, trades = run(spark, one_stock(spark, opened, closed), suspended=suspended, signals=[(DAYS[0], "000001.SZ", 1.0)])
    assert bool(trades) == bought


def test_missing_bars_keep_the_last_close(spark):
    equity, _ = run(spark, one_stock(spark, without="20240104"))
    assert [e.equity for e in equity] == [10_000.0] * 4


def test_an_empty_signal_sells_everything(spark):
    _, trades = run(spark, one_stock(spark), signals=[(DAYS[0], "000001.SZ", 1.0)])
    assert [(t.trade_date, t.side, t.shares) for t in trades] == [("20240103", "buy", 1000.0), ("20240104", "sell", 1000.0)]


def test_metrics(spark):
    curve = [100.0, 110.0, 99.0, 120.0]
    equity = spark.createDataFrame([("r", d, v) for d, v in zip(DAYS, curve)], "run_id string, trade_date string, equity double")
    trades = spark.createDataFrame([("r", 50.0), ("r", -20.0)], "run_id string, gross_amount double")
    got = simulate.metrics(equity, trades, 100.0).first()
    ret = np.diff(curve) / curve[:-1]
    assert math.isclose(got.total_return, 0.2) and math.isclose(got.annual_return, 1.2 ** (252 / 3) - 1) and math.isclose(got.max_drawdown, 99 / 110 - 1)
    assert math.isclose(got.sharpe, ret.mean() / ret.std() * math.sqrt(252)) and math.isclose(got.turnover, 70 / np.mean(curve)) and got.trade_count == 2


def test_metrics_in_one_pass(spark):
    kind = "what string, " + simulate.TRADES + ", positions_value double, equity double"
    rows = [("equity", "r", None, d, *[None] * 7, v, 0.0, v) for d, v in zip(DAYS, (100.0, 110.0, 99.0, 120.0))]
    rows = rows + [("trade", "r", DAYS[0], DAYS[1], "a", "buy", 1.0, 1.0, g, 0.0, 0.0, 0.0, 1.0, None, None) for g in (50.0, -20.0)]
    rows = [r if len(r) == 15 else (*r[:4], *[None] * 8, *r[-3:]) for r in rows]
    result = spark.createDataFrame(rows, kind)
    one, two = simulate.metrics_of(result, 100.0).first(), simulate.metrics(simulate.equity_of(result).withColumn("equity", F.col("equity")), simulate.trades_of(result), 100.0).first()
    assert all(math.isclose(a, b) for a, b in zip(one[1:], two[1:])) and one.trade_count == 2


def test_percentile_rank_and_minmax(spark):
    values = [1.0, 2.0, 2.0, None, 5.0, float("inf")]
    df = spark.createDataFrame([("d", str(i), v) for i, v in enumerate(values)], "trade_date string, ts_code string, v double")
    got = df.select("ts_code", cross.percentile_rank("v").alias("a"), cross.percentile_rank("v", False).alias("b"), cross.minmax("v").alias("c")).orderBy("ts_code").collect()
    assert [r.a for r in got] == [0.25, 0.625, 0.625, 0, 1, 0]
    assert [r.b for r in got] == [1, 0.625, 0.625, 0, 0.25, 0]
    assert [r.c for r in got] == [0, 0.25, 0.25, 0, 1, 0]


def looped_cap(weights, cap):
    left, out, rest = dict(weights), {}, 1.0
    while left:
        total = sum(left.values())
        over = [k for k, v in left.items() if total and v / total * rest > cap + 1e-15]
        if not over:
            return out | {k: v / total * rest if total else 0.0 for k, v in left.items()}
        for k in over:
            out[k] = cap
            rest -= cap
            del left[k]
    return out


def test_weight_cap_equals_a_loop(spark):
    rng = np.random.default_rng(3)
    rows = [(f"d{i}", f"c{j}", float(v)) for i in range(40) for j, v in enumerate(rng.pareto(1, rng.integers(1, 9)))]
    rows += [("a", "x", 100.0), ("a", "y", 1.0), ("a", "z", 1.0)]
    df = spark.createDataFrame(rows, "trade_date string, ts_code string, score double")
    for cap in (0.2, 0.6):
        got = {(r.trade_date, r.ts_code): r.weight for r in cross.target_weights(df, "score", 20, cap).collect()}
        for day in {r[0] for r in rows}:
            total = sum(s for d, _, s in rows if d == day)
            for code, v in looped_cap({c: s / total for d, c, s in rows if d == day}, cap).items():
                assert math.isclose(got[day, code], v, abs_tol=1e-9)
    assert cross.top_n(df, "score", 0).count() == 0


def test_forward_adjustment_fills_gaps(spark):
    daily = bars(spark, [("a", d, 12.0, 12.0, 12.0) for d in DAYS])
    daily = daily.drop("adj_open", "adj_close")
    factors = spark.createDataFrame([("a", DAYS[1], 1.0), ("a", DAYS[2], 2.0)], "ts_code string, trade_date string, adj_factor double")
    got = w.adjusted_prices(daily, factors).orderBy("trade_date").collect()
    assert [r.factor for r in got] == [1, 1, 2, 2] and [r.adj_close for r in got] == [6, 6, 12, 12]
    assert w.adjusted_prices(w.adjusted_prices(daily, factors), factors).count() == 4


def test_as_of_takes_whole_rows(spark):
    left = spark.createDataFrame([("a", d) for d in DAYS], "ts_code string, trade_date string")
    right = spark.createDataFrame([("a", "20240103", 1.0, 2.0), ("a", "20240105", None, 3.0), ("b", "20240101", 9.0, 9.0)], "ts_code string, trade_date string, x double, y double")
    got = w.as_of(left, right, ["x", "y"]).orderBy("trade_date").collect()
    assert [(r.as_of_date, r.x, r.y) for r in got] == [(None, None, None), ("20240103", 1.0, 2.0), ("20240103", 1.0, 2.0), ("20240105", None, 3.0)]


def test_kernels_from_first_principles():
    x = np.array([1.0, 2, 3, 4, 5])
    assert np.allclose(kernels.ema(x, 3)[2:], [2, 3, 4]) and np.isnan(kernels.ema(x, 3)[:2]).all() and np.isnan(kernels.ema(x, 6)).all()
    assert kernels.rsi(np.arange(10.0), 6)[-1] == 100 and np.isnan(kernels.rsi(np.full(10, 5.0), 6)).all()
    k, d, j = kernels.kdj(np.full(12, 2.0), np.full(12, 1.0), np.full(12, 2.0))
    assert k[8] == d[8] == j[8] == 50 and math.isclose(k[9], 50 * 2 / 3 + 100 / 3)
    assert np.isnan(kernels.atr(x + 1, x - 1, x)).all()
    flat = kernels.atr(np.full(20, 3.0), np.full(20, 1.0), np.full(20, 2.0))
    assert np.isnan(flat[:13]).all() and np.allclose(flat[13:], 2)
    frame = pd.DataFrame({"ts_code": "a", "trade_date": [f"d{i:02d}" for i in range(40)], "high": 2.0, "low": 1.0, "close": np.linspace(1, 2, 40)})
    first, second = kernels.recursive_indicators(frame), kernels.recursive_indicators(frame.sample(frac=1, random_state=1))
    assert first["dea"].notna().idxmax() == 33 and first.reset_index(drop=True).equals(second.reset_index(drop=True))


def test_calendar(spark):
    dates = spark.createDataFrame([(d,) for d in ("20241230", "20241231", "20250102", "20250131", "20250203")], "trade_date string")
    got = lambda f: sorted(r[0] for r in calendar.rebalance_dates(dates, f).collect())
    assert got("monthly") == ["20241231", "20250131"] and got("weekly") == ["20250102", "20250131"] and len(got("daily")) == 4
    back = spark.createDataFrame([("20240229",)], "d string").select(calendar.years_before(F.col("d"), 2).alias("d")).first()[0]
    assert back == "20220228" and calendar.history_start("20240131", 120) == "20230205"


def test_strategies_on_three_instruments(spark):
    closes = {"000001.SZ": (10, 10.1, 10.2, 10.3), "000002.SZ": (10, 12, 9, 13), "600000.SH": (10, 10, 10.1, 10.1)}
    daily = bars(spark, [(c, d, float(v), float(v), 10.0) for c, vs in closes.items() for d, v in zip(DAYS, vs)]).drop("adj_open", "adj_close")
    market = {
        "daily": daily, "adj_factor": daily.select("ts_code", "trade_date", F.lit(1.0).alias("adj_factor")),
        "daily_basic": spark.createDataFrame([("000001.SZ", DAYS[3], 5.0, 2.0, 9.0, 1.0), ("000002.SZ", DAYS[3], 6.0, 3.0, 12.0, 1.0), ("600000.SH", DAYS[3], 1.0, 1.0, 6.0, 1.0)], "ts_code string, trade_date string, dv_ttm double, pb double, pe_ttm double, total_mv double"),
        "stock_basic": spark.createDataFrame([(c, "L", "20000101", None) for c in closes], "ts_code string, list_status string, list_date string, delist_date string"),
    }
    at = spark.createDataFrame([(DAYS[3],)], "trade_date string")
    pick = lambda s: {r.ts_code: r.weight for r in s.signals(market, at).collect()}
    assert pick(strategies.DividendLowVol(1, 3, 0, 0.7, 0.3, 0.0)) == {"000001.SZ": 1.0}
    assert pick(strategies.ValueLowVol(1, 3, 0, 0.5, 0.3, 0.2)) == {"600000.SH": 1.0}
    assert pick(strategies.MomentumReversal()) == {} and pick(strategies.VolumePriceBreakout()) == {}
    assert strategies.strategy("value-low-vol", top_n=3, other=1, lookback_days=None).top_n == 3
    with pytest.raises(ValueError):
        strategies.register("value-low-vol", strategies.ValueLowVol)
    with pytest.raises(ValueError):
        strategies.strategy("none")


def test_limits_and_universe(spark):
    df = spark.createDataFrame([("300001.SZ", 11.5, 10.0, 15.0), ("600001.SH", 11.0, 10.0, 1.0), ("600002.SH", None, 10.0, -10.0), ("600003.SH", 9.0, 0.0, 0.0)], "ts_code string, open double, pre_close double, pct_chg double")
    assert [(r.limit_up, r.limit_down) for r in limit_flags(df).orderBy("ts_code").collect()] == [(False, False), (True, False), (False, True), (False, False)]
    stocks = spark.createDataFrame([("a", "L", None, None), ("b", "L", "20200101.0", None), ("c", "D", None, None), ("d", "L", None, "20190101")], "ts_code string, list_status string, list_date string, delist_date string")
    dates = spark.createDataFrame([("20191231",), ("20200101",)], "trade_date string")
    assert sorted(map(tuple, active_universe(stocks, dates).collect())) == [("20191231", "a"), ("20200101", "a"), ("20200101", "b")]


def test_codes_of_many_suppliers_differ(spark):
    from barloom.sources.adapter import code

    n = spark.range(0, 200_000, 7).select(code(F.col("id")).alias("c"))
    assert n.distinct().count() == n.count()


def test_a_cap_of_zero_is_no_cap(spark):
    df = spark.createDataFrame([("a", "20240102", 0.7), ("b", "20240102", 0.3)], "ts_code string, trade_date string, weight double")
    assert sorted(r.weight for r in cross.capped(df, 0).collect()) == [0.3, 0.7]


def test_store(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    assert store.load("daily").count() == 0 and not store.exists("daily") and store.latest("daily") is None
    rows = spark.createDataFrame([("a", "20240102", 1), ("a", "20240103", 2)], "ts_code string, trade_date string, close int")
    assert store.save("daily", rows.limit(0)) == 0 and store.save("daily", rows) == 2 and store.save("daily", rows.where("close = 2")) == 1
    assert store.count("daily") == 3 and store.latest("daily") == "20240103" and store.deduplicate("daily") == 1 and store.count("daily") == 2
    assert store.load("daily", ts_code=["a"], close=2).count() == 1 and store.scan("daily", ["close"], "20240103", "20240103").columns == ["close"]
    assert store.query("daily", "trade_date=20240102", 0).count() == 1 and {r.state for r in store.status().collect()} == {"ok", "empty"}
    cal = conform(spark.createDataFrame([("SSE", "20240102", "1.0"), ("SSE", "20240103", "0")], "exchange string, cal_date string, is_open string"), SPECS["trade_cal"])
    store.save("trade_cal", cal, "replace")
    assert store.is_trade_day("20240102") and not store.is_trade_day("20240103")
    store.drop("daily")
    assert not store.exists("daily")


def test_screeners_and_chart(spark):
    daily = bars(spark, [("a", DAYS[0], 10.0, 10.0, 10.0), ("a", DAYS[1], 10.0, 11.0, 10.0), ("b", DAYS[1], 5.0, 5.0, 5.0)]).withColumn("vol", F.when(F.col("trade_date") == DAYS[1], 300.0).otherwise(100.0))
    stocks = spark.createDataFrame([("a", "1", "Alpha", "L"), ("b", "2", "Beta <b>", "L")], "ts_code string, symbol string, name string, list_status string")
    assert [(r.ts_code, r.vol_ratio) for r in screeners.volume_surge(daily, stocks).collect()] == [("a", 3.0)]
    assert screeners.resolve_one(stocks, "Alp")["ts_code"] == "a" and screeners.resolve_one(stocks, "2")["name"] == "Beta <b>"
    with pytest.raises(ValueError):
        screeners.resolve_one(stocks, "nothing")
    page = screeners.kline_html({"ts_code": "b", "name": "Beta <b>"}, screeners.kline(daily).where("ts_code = 'b'"))
    assert "Beta &lt;b&gt;" in page and "reset" in page and "20240103" in page
    assert keep_last(daily, ["ts_code"], ["trade_date"]).count() == 2


def test_calendar_gaps(spark):
    cal = spark.createDataFrame([(f"2024010{i}", 1) for i in range(1, 8)], "cal_date string, is_open int")
    daily = spark.createDataFrame([("20240101",), ("20240104",), ("20240106",)], "trade_date string")
    got = sorted((r.first_date, r.last_date, r.n_days) for r in screeners.calendar_gaps(cal, daily).collect())
    assert got == [("20240102", "20240103", 2), ("20240105", "20240105", 1), ("20240107", "20240107", 1)]
