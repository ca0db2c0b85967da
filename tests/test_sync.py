"""Synchronisation: values of any type, days that fail, what is asked for again, tables side by side."""

import math
import random

from barloom.operators.resume import INDICATORS, indicators
from barloom.operators.windows import indicator_prices
from barloom.sources import vendor
from barloom.sources.indicators import states_of, update_indicators
from barloom.sources.tables import Store

DAYS = ["20240102", "20240103", "20240104"]


def odd_types(table, date):
    if table == "trade_cal":
        flags = ["1", "1.0", True, 1, 1.0, "0", 0, False, None, math.nan]
        return [{"exchange": "SSE", "cal_date": 20240101 + i if i % 2 else f"{20240101 + i}.0", "is_open": x} for i, x in enumerate(flags)]
    if table == "stock_basic":
        return [{"ts_code": "a", "name": "Alpha", "list_date": 20200101.0, "delist_date": None, "list_status": "L"}]
    return [{"ts_code": "a", "trade_date": int(date), "close": "1.5", "open": 2, "high": "bad", "low": math.nan, "vol": True, "unknown": 1}]


def test_values_of_any_type(spark, tmp_path):
    spark.dataSource.register(vendor.vendor_source(odd_types, tries=1, pause=0))
    store = Store(spark, str(tmp_path))
    got = vendor.sync(store, DAYS[:1], ["daily"])
    assert got == {"stock_basic": {"rows": 1}, "trade_cal": {"rows": 10}, "daily": {"rows": 1}}
    flags = store.load("trade_cal").select("cal_date", "is_open").orderBy("cal_date").collect()
    assert [r.is_open for r in flags] == [1, 1, 1, 1, 1, 0, 0, 0, None, None] and flags[0].cal_date == "20240101"
    bar = store.load("daily").first()
    assert (bar.trade_date, bar.close, bar.open, bar.high, bar.low, bar.vol) == ("20240102", 1.5, 2.0, None, None, None)
    assert store.load("stock_basic").first().list_date == "20200101"


def test_a_failing_day_is_asked_for_again(spark, tmp_path):
    calls = tmp_path / "calls"

    def fetch(table, date):
        with open(calls, "a") as log:
            log.write(f"{table} {date}\n")
        if date == "20240103" and not (tmp_path / "well").exists():
            raise OSError("down")
        return [] if date == "20240104" else [{"ts_code": "a", "trade_date": date, "suspend_type": "S"}, {"ts_code": "b", "trade_date": date, "suspend_type": "R"}]

    spark.dataSource.register(vendor.vendor_source(fetch, tries=1, pause=0))
    store = Store(spark, str(tmp_path / "data"))
    spark.createDataFrame([("a",)], "ts_code string").write.parquet(store.path("stock_basic"))
    got = vendor.sync(store, DAYS, ["suspend_d"])["suspend_d"]
    assert got["rows"] == 2 and list(got["failed"]) == ["20240103"] and "down" in got["failed"]["20240103"]
    assert {(r.date, r.n_rows, r.error is None) for r in vendor.log_of(store).collect()} == {("20240102", 2, True), ("20240103", 0, False), ("20240104", 0, True)}
    calls.write_text("")
    (tmp_path / "well").touch()
    assert vendor.sync(store, DAYS, ["suspend_d"])["suspend_d"] == {"rows": 2}
    assert calls.read_text() == "suspend_d 20240103\n" and store.count("suspend_d") == 4
    assert vendor.sync(store, DAYS, ["suspend_d"])["suspend_d"] == {"rows": 0}
    store.delete(store.path("sync_log"))  # as if the process had ended before the last commit
    vendor.bring_days(store, "suspend_d", ["20240103"], 1)
    assert store.count("suspend_d") == 4


def test_levels():
    assert vendor.levels(["stock_basic", "trade_cal", "suspend_d", "daily", "adj_factor", "daily_basic", "tech_indicator"]) == [
        ["stock_basic", "trade_cal"], ["suspend_d"], ["daily"], ["adj_factor", "daily_basic"], ["tech_indicator"]
    ]
    assert vendor.levels(["daily_basic"]) == [["daily_basic"]] and vendor.levels([]) == []


BAR = "ts_code string, trade_date string, high double, low double, close double"


def series(codes, n, seed=1):
    r, rows = random.Random(seed), []
    for c in codes:
        price = 20.0
        for i in range(n):
            price = max(1.0, price + r.gauss(0, 1))
            rows.append((c, f"{20200101 + 100 * (i // 28) + i % 28}", price + r.random(), price - r.random(), price))
    return rows


def table_of(df):
    return {(r.ts_code, r.trade_date): [r[c] for c in INDICATORS] for r in df.collect()}


def same(a, b):
    assert set(a) == set(b)
    for key, row in a.items():
        for name, x, y in zip(INDICATORS, row, b[key]):
            assert (x is None) == (y is None) and (x is None or abs(x - y) <= 1e-9 * max(1, abs(x))), (key, name, x, y)


def test_incremental_indicators_equal_full_ones(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    rows = series(["a", "b"], 120) + series(["young"], 14) + series(["none"], 3) + series(["zero"], 70)

    def factor(code, date):  # a changes its factor twice, zero ends on 0
        return 0.0 if code == "zero" and date >= "20200311" else 1.0 if code != "a" or date < "20200210" else 1.25 if date < "20200415" else 1.3

    def add(some):
        store.save("daily", spark.createDataFrame(some, BAR))
        store.save("adj_factor", spark.createDataFrame([(c, d, factor(c, d)) for c, d, *_ in some], "ts_code string, trade_date string, adj_factor double"))

    def check():
        full = indicators(indicator_prices(store.load("daily"), store.load("adj_factor")))
        same(table_of(store.load("tech_indicator")), table_of(full))

    cuts = ["", "20200107", "20200205", "20200312", "20200420", "99999999"]
    for low, high in zip(cuts, cuts[1:]):
        add([r for r in rows if low <= r[1] < high and (r[0] != "b" or r[1] > "20200120")])
        assert update_indicators(store) >= 0
        check()
    assert states_of(store).where("ts_code = 'a'").first().n == 120
    assert update_indicators(store) == 0  # nothing new
    check()
    add([(*r[:2], *r[2:]) for r in rows if r[0] == "b" and r[1] <= "20200120"])  # history that comes late: b alone is folded anew
    assert update_indicators(store) == 116  # the first four have no indicator
    check()
    add([("young", "20200115", 30.0, 20.0, 25.0)])  # the seed's ATR counts from now on
    assert update_indicators(store) == 1
    check()
    # an update that breaks off before its states are in is done again
    spark.read.parquet(store.path("tech_raw") + "/batch=1").write.parquet(f"{store.path('tech_raw')}/batch=99")
    check()
    update_indicators(store, full=True)
    check()
    store.drop("tech_indicator")
    assert not store.exists("tech_indicator") and store.count("tech_indicator") == 0
