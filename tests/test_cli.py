"""Commands over a small store: screen, verify, signals to files, charts, logs."""

import csv
import json
import logging
import random

import pytest

from barloom import cli
from barloom.logs import NAME
from barloom.plans import screeners
from barloom.plans.strategies import with_names
from barloom.sources import sinks
from barloom.sources.indicators import update_indicators
from barloom.sources.tables import Store


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    store = Store(spark, str(tmp_path_factory.mktemp("market")))
    r, days = random.Random(2), [f"2024{m:02}{d:02}" for m in range(1, 7) for d in range(1, 21)]
    rows = []
    for i, code in enumerate(("600001.SH", "000002.SZ", "300003.SZ")):
        price = 10.0 + i
        for d in days:
            before, price = price, max(1.0, price * (1 + r.gauss(0.002, 0.02)))
            rows.append((code, d, before, price * 1.01, price * 0.99, price, before, (price / before - 1) * 100, r.uniform(900, 2000), 1e6))
    rows.append(("600001.SH", "20240621", 10.0, 20.0, 9.0, 19.0, 10.0, 90.0, 100.0, 1e6))  # beyond the limit, alone on its day
    names = "ts_code string, trade_date string, open double, high double, low double, close double, pre_close double, pct_chg double, vol double, amount double"
    store.save("daily", spark.createDataFrame(rows, names))
    store.save("daily", spark.createDataFrame(rows[:2], names))  # repeated
    store.save("adj_factor", spark.createDataFrame([(x[0], x[1], 1.0) for x in rows[:-1]], "ts_code string, trade_date string, adj_factor double"))
    store.save("daily_basic", spark.createDataFrame([(x[0], x[1], 1.0, 2.0 + len(x[0]), 9.0) for x in rows], "ts_code string, trade_date string, dv_ttm double, pb double, pe_ttm double"))
    store.save("stock_basic", spark.createDataFrame([(c, c[:6], n, "L") for c, n in (("600001.SH", "Old"), ("600001.SH", "New"), ("600001.SH", "Aaa"), ("000002.SZ", "Two"), ("300003.SZ", " "))], "ts_code string, symbol string, name string, list_status string").coalesce(1))
    store.save("trade_cal", spark.createDataFrame([("SSE", d, 1) for d in [*days, "20240621", "20240622", "20240623"]], "exchange string, cal_date string, is_open int"))
    update_indicators(store)
    return store


def run(store, spark, *args):
    cli.main(["--data", store.root, *args], spark)


def test_verify_and_dedup(store, spark, capsys):
    report = {(r.check, r.table_name): r for r in screeners.verification({t: store.load(t) for t in cli.SPECS}, {t: s.keys for t, s in cli.SPECS.items()}, {t: s.date_col for t, s in cli.SPECS.items()}).collect()}
    assert (report["duplicates", "daily"].n, report["duplicates", "daily"].level) == (2, "error")
    assert report["duplicates", "suspend_d"].n == 0 and report["duplicates", "suspend_d"].first_date is None and report["duplicates", "stock_basic"].n == 2
    gap = report["days without bars", "daily"]
    assert (gap.n, gap.first_date, gap.last_date) == (2, "20240622", "20240623")
    assert report["instruments of the latest day", "daily"].level == "error" and report["moves beyond limits", "daily"].n == 1
    assert report["missing dates", "adj_factor"].first_date == "20240621" and ("missing dates", "daily_basic") not in report
    run(store, spark, "data", "verify")
    assert "days without bars" in capsys.readouterr().out
    run(store, spark, "data", "dedup", "daily")
    assert "daily: 2 rows removed" in capsys.readouterr().out


def test_screen(store, spark, tmp_path, capsys):
    frames = [store.load(t).where("trade_date < '20240621'") if t != "stock_basic" else store.load(t) for t in ("daily", "tech_indicator", "daily_basic", "stock_basic")]
    every = screeners.trend_pullback(*frames, min_score=0)
    for as_of in ("20240620", "20240515", "20240418"):
        latest = screeners.latest_candidates(*frames, 0, 0, as_of).collect()
        assert sorted(map(tuple, latest)) == sorted(map(tuple, every.where(f"trade_date = '{as_of}'").collect()))
        assert [r.signal_score for r in latest] == sorted((r.signal_score for r in latest), reverse=True)
        assert screeners.latest_candidates(*frames, 0, 1, as_of).collect() == latest[:1]
    assert screeners.latest_candidates(*frames, 0, 0, "20240101").collect() == []
    run(store, spark, "screen", "--min-score", "0", "--csv", str(tmp_path / "x" / "found.csv"))
    assert next(csv.reader(open(tmp_path / "x" / "found.csv")))[:2] == ["ts_code", "name"]


def test_signals_to_files(store, spark, tmp_path, capsys):
    out = {"csv": str(tmp_path / "s.csv"), "json": str(tmp_path / "s.json")}
    run(store, spark, "--log", str(tmp_path / "logs" / "a.log"), "strategy", "signals", "momentum-reversal", "--date", "20240620", "--csv", out["csv"], "--json", out["json"])
    told = json.loads(open(out["json"]).read())
    assert told["parameters"]["momentum_days"] == 60 and told["signals"] and abs(sum(s["weight"] for s in told["signals"]) - 1) < 1e-12
    rows = list(csv.DictReader(open(out["csv"])))
    assert [r["ts_code"] for r in rows] == [s["ts_code"] for s in told["signals"]]
    assert {s["ts_code"]: s["name"] for s in told["signals"]}["600001.SH"] == "Aaa" and (tmp_path / "logs" / "a.log").exists()
    logging.getLogger(NAME).handlers.clear()


def test_last_name(spark):
    stocks = spark.createDataFrame([("a", "Old", "1"), ("a", "New", "3"), ("a", "Aaa", "2"), ("a", " ", "4")], "ts_code string, name string, since string")
    signals = spark.createDataFrame([("a",), ("b",)], "ts_code string")
    assert sorted(map(tuple, with_names(signals, stocks, "since").collect())) == [("a", "New"), ("b", None)]
    assert with_names(signals, stocks.coalesce(1)).where("ts_code = 'a'").first().name == "Aaa"


def test_chart_defaults(store, spark):
    assert cli.chart_range(store, "", "", "20240622") == ("20220622", "20240622") and cli.chart_range(store, "", "20240229") == ("20220228", "20240229")
    assert cli.chart_range(Store(spark, store.root + "/none"), "", "", "20240105") == ("20220105", "20240105") and cli.chart_range(store, "1", "2") == ("1", "2")
    assert cli.chart_file("60/00:1.SH", "20220101", "20240101") == "charts/kline_60_00_1.SH_20220101_20240101.html"
    with pytest.raises(ValueError, match="no bars"):
        run(store, spark, "chart", "Two", "--start", "19000101", "--end", "19000102")


def test_reports(spark, tmp_path):
    runs = screeners.grid(lookback_days=[20, 60], top_n=[5])
    ranked = spark.createDataFrame([("2", 1, 0.5), ("1", 2, 0.1)], "run_id string, place int, sharpe double")
    assert sinks.best_parameters(ranked, runs, 1) == [{"place": 1, "run_id": "2", "parameters": {"lookback_days": 60, "top_n": 5}, "metrics": {"sharpe": 0.5}}]
    sinks.write_json(str(tmp_path / "a" / "b.json"), {"runs": ranked, "note": "ü"})
    assert json.loads((tmp_path / "a" / "b.json").read_text())["runs"][1]["run_id"] == "1"
    with pytest.raises(ValueError, match="more than 1 rows"):
        sinks.rows_of(ranked, 1)
