"""Configuration, vendor source, synchronisation, streaming and command line."""

import pytest
from pyspark.sql import functions as F

from barloom import cli, config
from barloom.errors import ApiError, ConfigError
from barloom.sources import vendor
from barloom.sources.tables import Store
from barloom.streaming import bars


def test_config(tmp_path):
    file = tmp_path / "c.json"
    file.write_text('{"data": {"dir": "${HOME_DIR}/x"}, "api": {"token": "${SECRET}"}}')
    got = config.load(str(file), {"HOME_DIR": "/h", "SECRET": "abcdefgh"})
    assert got == {"data": {"dir": "/h/x"}, "api": {"token": "abcdefgh"}} and config.masked(got)["api"]["token"] == "********efgh"
    assert config.put(got, "data.dir", "/y")["data"]["dir"] == "/y"
    with pytest.raises(ConfigError):
        config.load(str(file), {})
    for text in ("data:\n  dir: x\n", "[1]"):
        file.write_text(text)
        with pytest.raises(ConfigError):
            config.raw(str(file))


def test_config_set(tmp_path, capsys):
    file = tmp_path / "c.json"
    file.write_text('{"data": {"dir": "${HOME_DIR_OF_TEST}"}, "api": {"token": "abcdefgh"}}')
    with pytest.raises(ConfigError):  # the setting is written; showing it needs the variable
        cli.main(["config", str(file), "--set", "api.token", "12345678"])
    cli.main(["config", str(file), "--set", "data.dir", "/x"])
    assert config.raw(str(file)) == {"data": {"dir": "/x"}, "api": {"token": "12345678"}} and "********5678" in capsys.readouterr().out


def test_store_of_files_with_different_types(spark, tmp_path):
    store, path = Store(spark, str(tmp_path)), str(tmp_path / "trade_cal")
    for ddl, row in (
        ("exchange string, cal_date string, is_open int", ("SSE", "20240102", 1)),
        ("exchange string, cal_date string, is_open string", ("SSE", "20240103", "1.0")),
        ("cal_date string, is_open double, exchange string, pretrade_date string", ("20240103", 0.0, "SSE", "20240102")),
    ):
        spark.createDataFrame([row], ddl).write.mode("append").parquet(path)
    got = {tuple(r) for r in store.load("trade_cal").select("cal_date", "is_open", "pretrade_date").collect()}
    assert got == {("20240102", 1, None), ("20240103", 0, "20240102"), ("20240103", 1, None)}
    assert store.deduplicate("trade_cal") == 1
    assert sorted(tuple(r) for r in store.load("trade_cal").select("cal_date", "is_open", "pretrade_date").collect()) == [("20240102", 1, None), ("20240103", 0, "20240102")]


def calendar_and_bars(table, date):
    """A vendor whose bars end on 20240103."""
    if table == "trade_cal":
        return [{"exchange": "SSE", "cal_date": d, "is_open": int(d != "20240101")} for d in ("20240101", "20240102", "20240103", "20240104")]
    if table == "stock_basic":
        return [{"ts_code": "a", "symbol": "1", "name": "Alpha", "list_status": "L"}]
    return [{"ts_code": "a", "trade_date": date, "close": 2.0}] if table == "daily" and date < "20240104" else []


def test_sync_command(spark, tmp_path, capsys):
    cli.main(["--data", str(tmp_path), "data", "sync", "daily", "--fetch", f"{__name__}:calendar_and_bars", "--end", "20240104"], spark)
    out = capsys.readouterr().out.split("\n")
    assert "trade_cal: 4" in out and "stock_basic: 1" in out and "daily: 2" in out
    store = Store(spark, str(tmp_path))
    assert sorted(r.trade_date for r in store.load("daily").collect()) == ["20240102", "20240103"] and store.count("stock_basic") == 1
    with pytest.raises(ConfigError):
        cli.main(["--data", str(tmp_path), "data", "sync"], spark)


def test_retries():
    calls, waits = [], []

    def flaky(x):
        calls.append(x)
        if len(calls) < 3:
            raise OSError("down")
        return x

    assert vendor.retried(flaky, 1, sleep=waits.append) == 1 and waits == [5.0, 10.0]
    with pytest.raises(ApiError):
        vendor.retried(lambda: 1 / 0, tries=2, sleep=waits.append)
    assert vendor.safe_end(lambda d: d <= "3", "12345") == "3"


def test_sync_and_command_line(spark, tmp_path, capsys):
    def fetch(table, date):
        with open(tmp_path / "calls", "a") as log:
            log.write(f"{table} {date}\n")
        if table == "daily_basic":
            raise OSError("no such table")
        if table == "stock_basic":
            return [{"ts_code": "a", "symbol": "1", "name": "Alpha", "list_status": "L"}]
        if table == "trade_cal":
            return [{"exchange": "SSE", "cal_date": d, "is_open": 1} for d in ("20240102", "20240103")]
        return [{"ts_code": "a", "trade_date": date, "open": 1.0, "high": 2.0, "low": 1.0, "close": 2.0, "adj_factor": 1.0, "suspend_type": "R"}]

    spark.dataSource.register(vendor.vendor_source(fetch, tries=1, pause=0))
    store = Store(spark, str(tmp_path))
    names = ["stock_basic", "trade_cal", "suspend_d", "daily", "daily_basic"]
    got = vendor.sync(store, ["20240102", "20240103"], names)
    assert got["daily"] == {"rows": 2} and "error" in got["daily_basic"] and list(got) == names
    assert vendor.sync(store, ["20240102", "20240103"], ["adj_factor", "tech_indicator"])["tech_indicator"] == {"rows": 0}  # too few bars
    calls = (tmp_path / "calls").read_text().split("\n")
    assert calls.count("daily 20240102") == calls.count("daily 20240103") == 1 and not any("tech_indicator" in c for c in calls)
    assert vendor.sync(store, ["20240103", "20240104"], ["daily"]) == {"daily": {"rows": 1}} and store.latest("daily") == "20240104"
    run = lambda *a: cli.main(["--data", str(tmp_path), *a], spark)
    run("cal", "20240103")
    run("strategy", "list")
    run("chart", "Alpha", "--output", str(tmp_path / "c.html"))
    text = capsys.readouterr().out
    assert text.startswith("open") and "dividend-low-vol" in text and "Alpha" in (tmp_path / "c.html").read_text()


def test_streaming_bars_equal_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = bars.event_bars(bars.event_stream(spark, str(tmp_path / "in"), events.schema), late="3650 days")
    query = stream.writeStream.outputMode("complete").format("memory").queryName("bars").start()
    query.processAllAvailable()
    query.stop()
    assert sorted(map(tuple, spark.table("bars").collect())) == sorted(map(tuple, bars.event_bars(events).collect()))
    assert bars.user_sessions(events).agg(F.sum("n")).first()[0] == events.count()
