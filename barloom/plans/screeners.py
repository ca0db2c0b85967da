"""Screeners, data verification, chart data and the parameter grid."""

from __future__ import annotations

import html
import itertools
import json
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions.columns import number, points, tags
from ..operators import windows as w
from ..operators.calendar import numbered
from .strategies import r6


def volume_surge(daily: DataFrame, stock_basic: DataFrame, threshold: float = 2.0) -> DataFrame:
    """Instruments whose volume grew by the threshold over the market's previous date, with a rising price.

    Evaluated for every date of the market, not for the last one alone.
    """
    pairs = numbered(daily.select("trade_date").distinct()).select("trade_date", "prev_date").where("prev_date is not null")
    before = daily.select("ts_code", F.col("trade_date").alias("prev_date"), F.col("vol").alias("vol_before"))
    named = stock_basic.groupBy("ts_code").agg(F.max("name").alias("name"))
    df = daily.join(pairs, "trade_date").join(before, ["ts_code", "prev_date"]).withColumn("growth", F.try_divide("vol", "vol_before"))
    df = df.where((F.col("growth") >= threshold) & (F.col("pct_chg") > 0)).join(named, "ts_code", "left")
    whole = lambda c: F.bround(c).cast("bigint")
    return df.select(
        "ts_code", F.coalesce("name", F.lit("")).alias("name"), "trade_date", whole("vol").alias("vol_today"), whole("vol_before").alias("vol_prev"),
        r6("growth").alias("vol_ratio"), "close", r6("pct_chg").alias("pct_chg"),
    )


def trigger_ratio(found: DataFrame, daily: DataFrame) -> DataFrame:
    """Share of the instruments traded on a date that a screener found."""
    traded = daily.groupBy("trade_date").agg(F.countDistinct("ts_code").alias("traded"))
    return traded.join(found.groupBy("trade_date").agg(F.count(F.lit(1)).alias("hits")), "trade_date", "left").select(
        "trade_date", F.coalesce("hits", F.lit(0)).alias("hits"), "traded", r6(F.coalesce("hits", F.lit(0)) / F.col("traded")).alias("share")
    )


TECH = ("ma5", "ma20", "ma60", "rsi6", "rsi14", "dif", "dea", "macd_hist")


def named_stocks(stock_basic: DataFrame) -> DataFrame:
    return stock_basic.groupBy("ts_code").agg(F.max("name").alias("name"), F.max("list_status").alias("list_status"))


def trend_pullback(daily: DataFrame, tech: DataFrame, basics: DataFrame, stock_basic: DataFrame, min_score: float = 70) -> DataFrame:
    """Uptrends that fell back to their 20-bar mean and turned up again, by an eight-part score; for every date of the market."""
    usable = daily.where("close > 0 and vol > 0")
    bars = w.screen_windows(usable)
    pairs = numbered(daily.select("trade_date").distinct()).select("trade_date", "prev_date").where("prev_date is not null")
    earlier = usable.select("ts_code", F.col("trade_date").alias("prev_date"), F.col("close").alias("prev_close"))
    tech = tech.select("ts_code", "trade_date", *(r6(c).alias(c) for c in TECH))
    tech_before = tech.select("ts_code", F.col("trade_date").alias("prev_date"), F.col("ma5").alias("prev_ma5"), F.col("macd_hist").alias("prev_hist"))
    df = (
        bars.join(pairs, "trade_date").join(earlier, ["ts_code", "prev_date"]).join(tech, ["ts_code", "trade_date"]).join(tech_before, ["ts_code", "prev_date"], "left")
        .join(basics.select("ts_code", "trade_date", "turnover_rate", "volume_ratio"), ["ts_code", "trade_date"], "left").join(named_stocks(stock_basic), "ts_code", "left")
    )
    return rebounds(df, min_score)


def latest_candidates(daily: DataFrame, tech: DataFrame, basics: DataFrame, stock_basic: DataFrame, min_score: float = 70, max_rows: int = 30, as_of: str = "99999999") -> DataFrame:
    """The same screen for the market's latest date (up to ``as_of``) alone, best first; ``max_rows`` of 0 or less means all.

    The latest date and the one before are scalar subqueries over distinct dates, so the scans of indicators and
    fundamentals read these dates only; of an instrument's bars no more than the last 60 are shuffled, and plain
    aggregates over them replace windows over all history. With fewer than two dates there are no rows.
    """
    daily = daily.where(F.col("trade_date") <= as_of)
    two = daily.select("trade_date").distinct().orderBy(F.desc("trade_date")).limit(2)
    latest = two.agg(F.max("trade_date")).scalar()
    before = two.agg(F.when(F.count(F.lit(1)) == 2, F.min("trade_date"))).scalar()
    usable = daily.where("close > 0 and vol > 0")
    place = F.row_number().over(Window.partitionBy("ts_code").orderBy(F.desc("trade_date")))
    last = usable.select("ts_code", "trade_date", "vol", "high", "low").withColumn("place", place).where("place <= 60")
    up_to = lambda n, c: F.when(F.col("place") <= n, F.col(c))
    history = last.groupBy("ts_code").agg(
        F.avg(up_to(5, "vol")).alias("vol_ma5"), F.avg(up_to(20, "vol")).alias("vol_ma20"), F.max(up_to(20, "high")).alias("high_20"), F.min(up_to(5, "low")).alias("low_5"), F.count(F.lit(1)).alias("n_60")
    )
    earlier = usable.where(F.col("trade_date") == before).select("ts_code", F.col("close").alias("prev_close"))
    tech = tech.where((F.col("trade_date") == latest) | (F.col("trade_date") == before)).select("ts_code", "trade_date", *(r6(c).alias(c) for c in TECH))
    now = tech.where(F.col("trade_date") == latest).drop("trade_date")
    then = tech.where(F.col("trade_date") == before).select("ts_code", F.col("ma5").alias("prev_ma5"), F.col("macd_hist").alias("prev_hist"))
    today = basics.where(F.col("trade_date") == latest).select("ts_code", "turnover_rate", "volume_ratio")
    df = (
        usable.where(F.col("trade_date") == latest).join(history, "ts_code").join(earlier, "ts_code").join(now, "ts_code").join(then, "ts_code", "left")
        .join(today, "ts_code", "left").join(named_stocks(stock_basic), "ts_code", "left")
    )
    best = rebounds(df, min_score).orderBy(F.desc("signal_score"), F.desc_nulls_last("upside_room_pct"), F.desc_nulls_last("vol_ratio_5"), "ts_code")
    return best.limit(max_rows) if max_rows > 0 else best


def rebounds(df: DataFrame, min_score: float) -> DataFrame:
    """Scores bars that carry their windows, indicators, fundamentals, names and the day before; those that pass, with reasons."""
    c = F.col
    df = df.withColumns({
        "vol_ratio_5": r6(F.try_divide("vol", "vol_ma5")), "upside_room_pct": r6((F.try_divide("high_20", "close") - 1) * 100),
        "ma20_gap_pct": r6((F.try_divide("close", "ma20") - 1) * 100), "name": F.coalesce("name", F.lit("")), "list_status": F.coalesce("list_status", F.lit("")),
    })
    df = df.where((c("n_60") >= 60) & ~c("name").contains("ST") & c("list_status").isin("", "L")).na.drop(subset=["ma5", "ma20", "ma60", "rsi6", "rsi14", "macd_hist"])
    score = points(
        ((c("ma20") > c("ma60")) & (c("close") > c("ma20")), 20),
        (c("close").between(c("ma20") * 0.995, c("ma20") * 1.08), 15),
        ((c("low_5") <= c("ma20") * 1.025) & (c("close") <= c("high_20") * 0.98), 15),
        ((c("close") > c("open")) & r6("pct_chg").between(0.2, 5.5), 15),
        ((c("close") > c("ma5")) & (c("prev_close") <= c("prev_ma5")), 10),
        (c("vol_ratio_5").between(1.05, 2.6), 10),
        (c("rsi14").between(45, 70) & (c("rsi6") > c("rsi14")), 10),
        ((c("macd_hist") > F.coalesce("prev_hist", F.lit(-999999.0))) & (c("dif") >= c("dea")), 5),
    )
    df = df.withColumn("signal_score", score)
    df = df.where((c("signal_score") >= min_score) & (c("close") > c("ma20")) & (c("ma20") > c("ma60")) & (c("low_5") <= c("ma20") * 1.04) & (c("close") <= c("high_20") * 0.985))
    reason = tags(
        (c("ma20_gap_pct").between(-0.5, 8), "20线"), (c("upside_room_pct") >= 2, "空间"), (c("vol_ratio_5").between(1.05, 2.6), "放量"),
        (c("rsi6") > c("rsi14"), "动能"), (c("macd_hist") > 0, "MACD+"),
    )
    return df.select(
        "ts_code", "name", "trade_date", "signal_score", "close", r6("pct_chg").alias("pct_chg"), "upside_room_pct", "ma20_gap_pct", "vol_ratio_5",
        r6("volume_ratio").alias("volume_ratio"), r6("turnover_rate").alias("turnover_rate"), "rsi6", "rsi14", "macd_hist", reason.alias("signal_reason"),
    )


def overview(df: DataFrame, name: str, keys: tuple[str, ...], date: str | None) -> DataFrame:
    """Rows, rows beyond the first of their key, and the range of dates, from one pass: counts by key, then their sums."""
    by_key = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), *([F.min(date).alias("_low"), F.max(date).alias("_high")] if date and date not in keys else []))
    low, high = ("_low", "_high") if date and date not in keys else (date, date)
    dates = (F.min(low), F.max(high)) if date else (F.lit(None).cast("string"),) * 2
    return by_key.agg(
        F.lit(name).alias("table_name"), F.coalesce(F.sum("_n"), F.lit(0)).alias("n_rows"), F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicates"), dates[0].alias("first_date"), dates[1].alias("last_date")
    )


ALIGNED = ("adj_factor", "daily_basic", "tech_indicator")
RECENT = 60  # calendar days that alignment and moves are checked over


def verification(tables: dict[str, DataFrame], keys: dict[str, tuple[str, ...]], dates: dict[str, str | None]) -> DataFrame:
    """A report on all tables: check, table_name, level (ok, info, error), n, first_date, last_date.

    Repeated keys of each table; runs of open days without bars; the latest day's instruments against the days before;
    dates that tables of the last 60 days lack or have beyond the bars'; moves beyond the limits of the boards.
    """
    row = lambda check, name, level, n, low, high: [F.lit(check).alias("check"), (F.lit(name) if isinstance(name, str) else name).alias("table_name"), level.alias("level"), n.cast("long").alias("n"), low.alias("first_date"), high.alias("last_date")]
    c, daily = F.col, tables["daily"]
    wrong = lambda n, how="error": F.when(n > 0, how).otherwise("ok")
    parts = [overview(df, t, keys[t], dates[t]).select(*row("duplicates", c("table_name"), wrong(c("duplicates")), c("duplicates"), c("first_date"), c("last_date"))) for t, df in tables.items()]
    gaps = calendar_gaps(tables["trade_cal"], daily)
    parts.append(gaps.select(*row("days without bars", "daily", F.lit("error"), c("n_days"), c("first_date"), c("last_date"))))
    counts = daily_counts(daily).orderBy(F.desc("trade_date")).limit(1)
    parts.append(counts.select(*row("instruments of the latest day", "daily", c("level"), c("n"), c("trade_date"), c("trade_date"))))
    start = F.date_format(F.date_sub(F.to_date(daily.agg(F.max("trade_date")).scalar(), "yyyyMMdd"), RECENT), "yyyyMMdd")
    recent = lambda df: df.where(c("trade_date") >= start)
    apart = alignment(recent(daily), {t: recent(tables[t]) for t in ALIGNED if t in tables}).groupBy("table_name", "kind").agg(F.count(F.lit(1)).alias("n"), F.min("trade_date").alias("low"), F.max("trade_date").alias("high"))
    for kind, how in (("missing", "error"), ("extra", "info")):
        own = apart.where(c("kind") == kind)
        parts.append(own.select(*row(f"{kind} dates", c("table_name"), F.lit(how), c("n"), c("low"), c("high"))))
    moves = recent(daily).where(beyond_limits(0.5)).agg(F.count(F.lit(1)).alias("n"), F.min("trade_date").alias("low"), F.max("trade_date").alias("high"))
    parts.append(moves.select(*row("moves beyond limits", "daily", wrong(c("n"), "info"), c("n"), c("low"), c("high"))))
    return reduce(DataFrame.unionByName, parts)


def calendar_gaps(trade_cal: DataFrame, daily: DataFrame) -> DataFrame:
    """Runs of open days without any bar (islands over the position in the calendar)."""
    days = numbered(trade_cal.where("is_open = 1").select(F.col("cal_date").alias("trade_date")).distinct())
    missing = days.join(daily.select("trade_date").distinct(), "trade_date", "left_anti")
    island = F.col("pos") - F.row_number().over(Window.orderBy("pos"))
    return missing.withColumn("island", island).groupBy("island").agg(
        F.min("trade_date").alias("first_date"), F.max("trade_date").alias("last_date"), F.count(F.lit(1)).alias("n_days")
    ).drop("island")


def alignment(daily: DataFrame, others: dict[str, DataFrame]) -> DataFrame:
    """Dates that daily has and another table lacks, and the other way round."""
    own, parts = daily.select("trade_date").distinct(), []
    for name, df in others.items():
        there = df.select("trade_date").distinct()
        parts.append(own.join(there, "trade_date", "left_anti").select(F.lit(name).alias("table_name"), F.lit("missing").alias("kind"), "trade_date"))
        parts.append(there.join(own, "trade_date", "left_anti").select(F.lit(name).alias("table_name"), F.lit("extra").alias("kind"), "trade_date"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def daily_counts(daily: DataFrame) -> DataFrame:
    """Instruments per date against the mean of up to five dates before (three at least): below 0.8 error, below 0.95 info."""
    n = daily.groupBy("trade_date").agg(F.countDistinct("ts_code").alias("n"))
    five = Window.orderBy("trade_date").rowsBetween(-5, -1)
    n = n.withColumn("usual", F.when(F.count("n").over(five) >= 3, F.avg("n").over(five)))
    level = F.when(F.col("n") < 0.8 * F.col("usual"), "error").when(F.col("n") < 0.95 * F.col("usual"), "info").otherwise("ok")
    return n.select("trade_date", "n", r6("usual").alias("usual"), level.alias("level"))


def first_day_of_year(daily: DataFrame) -> DataFrame:
    n = daily.groupBy("trade_date").agg(F.countDistinct("ts_code").alias("n"))
    return n.groupBy(F.substring("trade_date", 1, 4).alias("year")).agg(F.min("trade_date").alias("first_date"), F.min_by("n", "trade_date").alias("n"))


def beyond_limits(slack: float) -> Column:
    """Moves that exceed a board's daily limit, 10 or 20 per cent, by more than ``slack``."""
    board, move = F.substring("ts_code", 1, 2), F.abs("pct_chg")
    return board.isin("60", "00") & (move > 10 + slack) | board.isin("30", "68") & (move > 20 + slack)


def abnormal_moves(daily: DataFrame, start: str, limit: float = 11.0) -> DataFrame:
    """Main-board moves beyond the daily limit."""
    main = F.substring("ts_code", 1, 2).isin("60", "00")
    return daily.where((F.col("trade_date") >= start) & main & (F.abs("pct_chg") > limit)).select("ts_code", "trade_date", r6("pct_chg").alias("pct_chg"))


def resolve(stock_basic: DataFrame, query: str) -> DataFrame:
    """Instruments that a text names: exact code, symbol or name; else names that contain it; else the code itself."""
    q = query.strip()
    exact = (F.upper("ts_code") == q.upper()) | (F.col("symbol") == q) | (F.col("name") == q)
    ranked = stock_basic.select("ts_code", "symbol", "name", F.when(exact, 0).when(F.col("name").contains(q), 1).alias("rank")).where("rank is not null")
    best = ranked.agg(F.min("rank").alias("best"))
    return ranked.join(best, F.col("rank") == F.col("best")).select("ts_code", "symbol", "name")


def resolve_one(stock_basic: DataFrame, query: str) -> dict[str, str]:
    found = resolve(stock_basic, query).orderBy("ts_code").limit(11).collect()
    if len(found) > 1:
        raise ValueError(f"{query!r} could be " + ", ".join(f"{r.ts_code} {r.name}" for r in found))
    if found:
        return found[0].asDict()
    if "." in query:
        return {"ts_code": query.strip().upper(), "symbol": query.split(".")[0], "name": ""}
    raise ValueError(f"nothing is called {query!r}")


def kline(daily: DataFrame, start: str = "", end: str = "99999999", limit: int = 500) -> DataFrame:
    """The last bars of each instrument in a range, with numbers coerced and duplicates of a date dropped (last kept)."""
    cols = ["open", "high", "low", "close", "vol", "amount", "pct_chg"]
    df = daily.where(F.col("trade_date").between(start, end)).select("ts_code", "trade_date", *(number(c).alias(c) for c in cols), F.monotonically_increasing_id().alias("_at"))
    df = df.na.drop(subset=["open", "high", "low", "close"])
    df = df.groupBy("ts_code", "trade_date").agg(F.max(F.struct("_at", *cols)).alias("r")).select("ts_code", "trade_date", *(f"r.{c}" for c in cols))
    place = F.row_number().over(Window.partitionBy("ts_code").orderBy(F.desc("trade_date")))
    return df.withColumn("place", place).where(F.col("place") <= limit).drop("place")


def kline_html(identity: dict[str, str], bars: DataFrame) -> str:
    """A self-contained page with a zoomable candlestick chart of a few hundred bars."""
    rows = [[r.trade_date, r.open, r.high, r.low, r.close, r.vol] for r in bars.orderBy("trade_date").collect()]
    if not rows:
        raise ValueError(f"{identity['ts_code']} has no bars in this range")
    title = html.escape(f"{identity['ts_code']} {identity.get('name') or ''}".strip())
    return PAGE.replace("@TITLE@", title).replace("@ROWS@", json.dumps(rows).replace("</", "<\\/"))


PAGE = """<!doctype html><meta charset="utf-8"><title>@TITLE@</title><h1>@TITLE@</h1>
<div id="tip"></div><canvas id="chart" width="1200" height="640" style="border:1px solid #ccc"></canvas>
<button id="reset">reset</button><script>
const rows = @ROWS@, cv = document.getElementById("chart"), g = cv.getContext("2d"), tip = document.getElementById("tip");
let from = 0, upto = rows.length, drag = null;
function draw() {
  const part = rows.slice(from, upto), W = cv.width, H = cv.height * 0.75, step = W / Math.max(1, part.length);
  const hi = Math.max(...part.map(r => r[2])), lo = Math.min(...part.map(r => r[3])), vmax = Math.max(...part.map(r => r[5] || 0), 1);
  const y = p => 20 + (hi - p) / (hi - lo || 1) * (H - 40);
  g.clearRect(0, 0, W, cv.height); g.fillStyle = "#333"; g.fillText("high " + hi, 4, 14); g.fillText("low " + lo, 4, H - 4);
  part.forEach((r, i) => {
    const x = i * step + step / 2, up = r[4] >= r[1]; g.strokeStyle = g.fillStyle = up ? "#c33" : "#393";
    g.beginPath(); g.moveTo(x, y(r[2])); g.lineTo(x, y(r[3])); g.stroke();
    g.fillRect(x - step * 0.35, Math.min(y(r[1]), y(r[4])), step * 0.7, Math.max(1, Math.abs(y(r[1]) - y(r[4]))));
    const v = (r[5] || 0) / vmax * (cv.height - H - 10); g.fillRect(x - step * 0.35, cv.height - v, step * 0.7, v);
  });
}
cv.onwheel = e => { e.preventDefault(); const n = upto - from, d = Math.round(n * 0.1) * (e.deltaY < 0 ? 1 : -1); if (n - 2 * d >= 10) { from = Math.max(0, from + d); upto = Math.min(rows.length, upto - d); draw(); } };
cv.onmousedown = e => { drag = [e.offsetX, from, upto]; }; window.onmouseup = () => { drag = null; };
cv.onmousemove = e => {
  const n = upto - from, r = rows[from + Math.floor(e.offsetX / cv.width * n)]; if (r) tip.textContent = `${r[0]} open ${r[1]} high ${r[2]} low ${r[3]} close ${r[4]} vol ${r[5]}`;
  if (drag) { const m = Math.round((drag[0] - e.offsetX) / cv.width * n); const f = Math.min(Math.max(0, drag[1] + m), rows.length - n); upto = f + n; from = f; draw(); }
};
document.getElementById("reset").onclick = () => { from = 0; upto = rows.length; draw(); }; draw();
</script>"""


def grid(**choices) -> list[dict]:
    """All combinations of parameters, numbered from 1."""
    keys = list(choices)
    return [{"run_id": str(i), **dict(zip(keys, values))} for i, values in enumerate(itertools.product(*choices.values()), 1)]


def ranked_runs(metrics: DataFrame) -> DataFrame:
    """Runs that traded, best first: Sharpe, annual return, drawdown, then low turnover and run_id."""
    order = Window.orderBy(F.desc("sharpe"), F.desc("annual_return"), F.desc("max_drawdown"), F.asc("turnover"), F.asc("run_id"))
    return metrics.where("trade_count > 0").withColumn("place", F.row_number().over(order))


def simulated_grid(spark: SparkSession, market: dict[str, DataFrame], runs: list[dict], rebalances: DataFrame, days: DataFrame, cash: float = 1_000_000.0) -> DataFrame:
    """Metrics of many dividend-low-vol runs in one job: factors are computed once for each lookback, weights differ by run."""
    from ..operators import cross
    from ..operators.simulate import metrics_of, simulate
    from .strategies import adjusted, base_frame

    parts = []
    for lookback in sorted({r["lookback_days"] for r in runs}):
        base = base_frame(market, rebalances, lookback, 0.0).select("ts_code", "trade_date", "amount", "dv_ttm", "pb", "volatility")
        own = [(r["run_id"], float(r["min_amount"]), *map(float, r["weights"]), int(r["top_n"])) for r in runs if r["lookback_days"] == lookback]
        params = spark.createDataFrame(own, "run_id string, min_amount double, w_div double, w_vol double, w_val double, n int")
        rows = base.join(F.broadcast(params), F.col("amount") >= F.col("min_amount"))  # a row for each run of the grid
        rows = rows.withColumn("by", F.concat_ws("|", "run_id", "trade_date"))
        score = cross.percentile_rank("dv_ttm", date="by") * F.col("w_div") - cross.minmax("volatility", "by") * F.col("w_vol") + cross.percentile_rank("pb", False, "by") * F.col("w_val")
        rows = rows.withColumn("score", r6(score))
        place = F.row_number().over(Window.partitionBy("by").orderBy(F.desc("score"), "ts_code"))
        rows = cross.score_weights(rows.withColumn("place", place).where(F.col("place") <= F.col("n")), "score", "by")
        parts.append(rows.select("run_id", F.col("trade_date").alias("signal_date"), "ts_code", "weight"))
    signals = parts[0]
    for p in parts[1:]:
        signals = signals.unionByName(p)
    ids = spark.createDataFrame([(r["run_id"],) for r in runs], "run_id string")
    marks = rebalances.select(F.col("trade_date").alias("signal_date")).crossJoin(F.broadcast(ids))  # runs by rebalance dates
    result = simulate(signals, marks, adjusted(market), days, market["suspend_d"], cash)
    return metrics_of(result, cash)
