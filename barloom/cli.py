"""Command line: python -m barloom.cli (config | data | cal | strategy | chart) ..."""

from __future__ import annotations

import argparse
import datetime
import importlib
import json
import re
from pathlib import Path

from pyspark.sql import SparkSession, functions as F

from . import config
from .errors import ConfigError
from .logs import log_to
from .operators.calendar import history_start, latest_open
from .plans import screeners, strategies
from .sources import sinks, vendor
from .sources.tables import MARKET, SPECS, SYNC_ORDER, Store


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="barloom")
    p.add_argument("--data", default="data", help="folder of the market tables")
    p.add_argument("--log", help="file that a log is written to as well")
    p.add_argument("--log-level", default="INFO")
    sub = p.add_subparsers(dest="command", required=True)
    c = sub.add_parser("config", help="show settings, tokens masked, or set one of them")
    c.add_argument("file")
    c.add_argument("--set", nargs=2, metavar=("KEY", "VALUE"), help="a dotted key such as data.dir")
    d = sub.add_parser("data", help="sync, status, verify, query, dedup (of all tables if none is named) or clean")
    d.add_argument("action", choices=["sync", "status", "verify", "query", "dedup", "clean"])
    d.add_argument("--fetch", help="module:function that gives the vendor's rows of (table, date)")
    d.add_argument("--start", default="", help="first day to bring (YYYYMMDD)")
    d.add_argument("--end", default="", help="last day to bring; today if none is given")
    d.add_argument("table", nargs="?")
    d.add_argument("--filter", default="")
    d.add_argument("--limit", type=int, default=10)
    d.add_argument("--export")
    d.add_argument("--force", action="store_true")
    k = sub.add_parser("cal", help="is a date a trading day?")
    k.add_argument("date")
    s = sub.add_parser("strategy", help="list, explain or signals")
    s.add_argument("action", choices=["list", "explain", "signals"])
    s.add_argument("name", nargs="?")
    s.add_argument("--date")
    s.add_argument("--top-n", type=int)
    s.add_argument("--lookback-days", type=int)
    s.add_argument("--csv", help="file for the signals")
    s.add_argument("--json", help="file for the strategy, its parameters and the signals")
    n = sub.add_parser("screen", help="candidates of the latest market date")
    n.add_argument("--min-score", type=float, default=70)
    n.add_argument("--max-rows", type=int, default=30)
    n.add_argument("--csv")
    h = sub.add_parser("chart", help="write a candlestick page")
    h.add_argument("stock")
    h.add_argument("--start", default="", help="two years before the end if none is given")
    h.add_argument("--end", default="", help="the latest open day if none is given")
    h.add_argument("--limit", type=int, default=500)
    h.add_argument("--output", help="charts/kline_CODE_START_END.html if none is given")
    return p


def synchronised(store: Store, fetch: str | None, start: str, end: str, tables) -> dict[str, dict]:
    """Brings the calendar, then the tables for its open days from start to the last day for which the vendor has bars."""
    module, _, name = (fetch or "").partition(":")
    if not name:
        raise ConfigError("sync needs --fetch module:function")
    call = getattr(importlib.import_module(module), name)
    store.spark.dataSource.register(vendor.vendor_source(call))
    done = vendor.sync(store, [], ["trade_cal"])
    last = end or datetime.date.today().strftime("%Y%m%d")
    open_days = store.load("trade_cal").where((F.col("is_open") == 1) & F.col("cal_date").between(start, last))
    days = sorted(r[0] for r in open_days.select("cal_date").distinct().collect())  # one for each day of the calendar
    safe = vendor.safe_end(lambda day: bool(list(vendor.retried(call, "daily", day))), days)
    return done | vendor.sync(store, [d for d in days if safe and d <= safe], [t for t in tables if t != "trade_cal"])


def chart_range(store: Store, start: str, end: str, today: str | None = None) -> tuple[str, str]:
    """The asked range; by default the two years up to the latest open day (today where there is no calendar)."""
    today = today or datetime.date.today().strftime("%Y%m%d")
    end = end or latest_open(store.load("trade_cal"), today) or today
    if not start:
        day = datetime.datetime.strptime(end, "%Y%m%d")
        leap = (day.month, day.day) == (2, 29)
        start = day.replace(year=day.year - 2, day=28 if leap else day.day).strftime("%Y%m%d")
    return start, end


def chart_file(code: str, start: str, end: str) -> str:
    """A name for a chart's file: what isn't a letter, digit, dot, hyphen or underscore becomes an underscore."""
    return str(Path("charts") / ("_".join(["kline", re.sub(r"[^A-Za-z0-9_.-]+", "_", code), start, end]) + ".html"))


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    a = parser().parse_args(argv)
    log = log_to(a.log, a.log_level)
    if a.command == "config":
        if a.set:
            config.save(a.file, config.put(config.raw(a.file), *a.set))
        print(json.dumps(config.masked(config.load(a.file)), indent=2))
        return
    if a.command == "strategy" and a.action != "signals":
        for name in strategies.names() if a.action == "list" else [a.name]:
            print(json.dumps(strategies.explain(name), ensure_ascii=False) if a.action == "explain" else f"{name}: {strategies.explain(name)['description']}")
        return
    spark = spark or SparkSession.builder.appName("barloom").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    store = Store(spark, a.data)
    if a.command == "data":
        if a.action == "sync":
            for table, result in synchronised(store, a.fetch, a.start, a.end, [a.table] if a.table else SYNC_ORDER).items():
                print(f"{table}: {result.get('error') or result['rows']}")
                if "error" in result:
                    log.error("%s: %s", table, result["error"])
                else:
                    log.info("%s: %d rows", table, result["rows"])
                for day, why in result.get("failed", {}).items():
                    log.warning("%s of %s: %s", table, day, why)
        elif a.action == "verify":
            tables = {t: store.load(t) for t in SPECS}
            screeners.verification(tables, {t: s.keys for t, s in SPECS.items()}, {t: s.date_col for t, s in SPECS.items()}).show(1000, truncate=False)
        elif a.action == "status":
            store.status().show(truncate=False)
        elif a.action == "dedup":
            for table in [a.table] if a.table else SPECS:
                print(f"{table}: {store.deduplicate(table)} rows removed")
        elif a.action == "clean":
            if not a.force:
                raise SystemExit("clean needs --force")
            store.drop(a.table)
        else:
            found = store.query(a.table, a.filter, a.limit)
            store.export_csv(found, a.export) if a.export else found.show(max(a.limit, 20), truncate=False)
    elif a.command == "cal":
        print("open" if store.is_trade_day(a.date) else "closed")
    elif a.command == "strategy":
        chosen = strategies.strategy(a.name, top_n=a.top_n, lookback_days=a.lookback_days)
        window = max([v for k, v in vars(chosen).items() if k.endswith("_days")], default=60)
        columns = {t: MARKET[t] for t in ("daily", "adj_factor", "daily_basic", "stock_basic")}
        market = store.market(history_start(a.date, window), a.date, columns)
        at = spark.createDataFrame([(a.date,)], "trade_date string")
        found = strategies.with_names(chosen.signals(market, at), market["stock_basic"]).orderBy("place")
        if a.csv:
            sinks.write_csv(found, a.csv)
        if a.json:
            sinks.write_json(a.json, {"strategy": a.name, "date": a.date, "parameters": dict(vars(chosen)), "signals": found})
        found.show(100, truncate=False)
    elif a.command == "screen":
        found = screeners.latest_candidates(*(store.load(t) for t in ("daily", "tech_indicator", "daily_basic", "stock_basic")), a.min_score, a.max_rows)
        if a.csv:
            sinks.write_csv(found, a.csv)
        found.show(max(a.max_rows, 100), truncate=False)
    else:
        who = screeners.resolve_one(store.load("stock_basic"), a.stock)
        start, end = chart_range(store, a.start, a.end)
        bars = screeners.kline(store.load("daily", ts_code=who["ts_code"]), start, end, a.limit)
        page = screeners.kline_html(who, bars)
        output = Path(a.output or chart_file(who["ts_code"], start, end))
        output.parent.mkdir(parents=True, exist_ok=True)
        output.write_text(page, encoding="utf-8")
        print(output)


if __name__ == "__main__":
    main()
