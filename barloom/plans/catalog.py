"""All registered queries of the market model with their SQL twins."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions.columns import active_universe, limit_flags, open_gap, suspended_flag
from ..operators import calendar, cross, kernels, resume, simulate, windows as w
from ..sources.adapter import CTES, Market
from ..sources.tables import SPECS, Store, conform, keep_last, table_status
from ..streaming.bars import event_bars, user_sessions
from . import screeners
from .strategies import DividendLowVol, MomentumReversal, ValueLowVol, VolumePriceBreakout, base_frame, measured, r6, signals_of_runs, with_names

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
FLAGSHIP = "sig_dividend_low_vol"
KEY = ["ts_code", "trade_date"]


def query(sql: str | None = None, recursive: bool = False):
    """Registers a function of the market under its name, with the SQL that follows the shared relations."""

    def register(f: Callable[[Market], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Market(spark, sf_dir))
        if sql:
            ORACLE_SQL[f.__name__] = f"with {'recursive ' if recursive else ''}{CTES}{sql}"
        return f

    return register


def cols(df: DataFrame, **named: Column | str) -> DataFrame:
    return df.select(*KEY, *(r6(c).alias(n) for n, c in named.items()))


def month_ends(m: Market) -> DataFrame:
    return calendar.rebalance_dates(m.days, "monthly")


def rounded(signals: DataFrame) -> DataFrame:
    return signals.withColumn("weight", r6("weight"))


def adjusted(m: Market) -> DataFrame:
    return w.adjusted_prices(m.daily, m.adj_factor)


# Scans, joins, scalar functions


@query("select ts_code, trade_date, round(close, 6) as close, vol from daily where ts_code in ('60000000000004.SH', '00000000000001.SZ', '30000000000006.SH') and trade_date between '19940101' and '19961231'")
def scan_filter_in(m):
    picked = m.daily.where(F.col("ts_code").isin("60000000000004.SH", "00000000000001.SZ", "30000000000006.SH") & F.col("trade_date").between("19940101", "19961231"))
    return picked.select(*KEY, r6("close").alias("close"), "vol")


@query(" union all ".join(
    f"select '{t}' as table_name, count(*) as n_rows, {d} as latest_date, case when count(*) > 0 then 'ok' else 'empty' end as state from {t}"
    for t, d in (("stock_basic", "cast(null as varchar)"), ("trade_cal", "max(cal_date)"), ("daily", "max(trade_date)"), ("adj_factor", "max(trade_date)"), ("daily_basic", "max(trade_date)"), ("suspend_d", "max(trade_date)"))
))
def status(m):
    return table_status(m.tables())


@query("select ts_code, trade_date, round((open/nullif(pre_close, 0) - 1)*100, 6) as gap, coalesce((open/nullif(pre_close,0)-1)*100, pct_chg) >= lim - 0.01 as limit_up, coalesce((open/nullif(pre_close,0)-1)*100, pct_chg) <= -lim + 0.01 as limit_down from (select *, case when ts_code like '30%' or ts_code like '68%' then 20 else 10 end as lim from daily)")
def limit_flag(m):
    return limit_flags(m.daily).select(*KEY, r6(open_gap()).alias("gap"), "limit_up", "limit_down")


@query("select d.ts_code, d.trade_date, s.ts_code is not null as suspended from daily d left join (select distinct ts_code, trade_date from suspend_d where suspend_type = 'S') s using (ts_code, trade_date)")
def suspend_flag(m):
    return suspended_flag(m.daily, m.suspend_d).select(*KEY, "suspended")


@query("select m.trade_date, s.ts_code from month_ends m join stock_basic s on s.list_status = 'L' and (s.list_date is null or s.list_date <= m.trade_date) and (s.delist_date is null or s.delist_date >= m.trade_date)")
def universe(m):
    return active_universe(m.stock_basic, month_ends(m))


ASOF = "last_basic as (select d.ts_code, d.trade_date, b.trade_date as as_of_date, b.dv_ttm, b.pb, b.pe_ttm, b.total_mv from daily d asof left join daily_basic b on d.ts_code = b.ts_code and d.trade_date >= b.trade_date)"


@query(f", {ASOF} select ts_code, trade_date, as_of_date, round(dv_ttm, 6) as dv_ttm, round(pe_ttm, 6) as pe_ttm from last_basic")
def asof_basic(m):
    df = w.as_of(m.daily.select(*KEY), m.daily_basic, ["dv_ttm", "pe_ttm"])
    return df.select(*KEY, "as_of_date", r6("dv_ttm").alias("dv_ttm"), r6("pe_ttm").alias("pe_ttm"))


@query("select d.ts_code, count(*) as bars, max(s.name) as name from daily d join stock_basic s using (ts_code) where s.name not like '%ST%' and not exists (select 1 from suspend_d x where x.ts_code = d.ts_code and x.trade_date = d.trade_date and x.suspend_type = 'S') group by 1")
def active_bars(m):
    off = m.suspend_d.where("suspend_type = 'S'").select(*KEY)
    named = m.stock_basic.where(~F.col("name").contains("ST")).select("ts_code", "name")
    return m.daily.join(off, KEY, "left_anti").join(named, "ts_code").groupBy("ts_code").agg(F.count(F.lit(1)).alias("bars"), F.max("name").alias("name"))


@query("select ts_code, symbol, name from stock_basic where name like '%Supplier#0000000%'")
def resolve_stock(m):
    return screeners.resolve(m.stock_basic, "Supplier#0000000")


# Adjustment and windows


@query("select ts_code, trade_date, round(factor, 6) as factor from filled")
def factor_ffill(m):
    return cols(adjusted(m), factor="factor")


# Prices are products and quotients in the same order on both sides, so they need no rounding.
@query("select ts_code, trade_date, adj_open, adj_high, adj_low, adj_close from adjusted")
def adjusted_ohlc(m):
    return adjusted(m).select(*KEY, "adj_open", "adj_high", "adj_low", "adj_close")


RET = "ret as (select *, adj_close / lag(adj_close) over (partition by ts_code order by trade_date) - 1 as ret from adjusted)"


def window_sql(body: str, source: str = "ret") -> str:
    return f", {RET} select ts_code, trade_date, {body} from {source} window t as (partition by ts_code order by trade_date)"


def rows(n: int) -> str:
    return f"over (partition by ts_code order by trade_date rows between {n - 1} preceding and current row)"


def prior(n: int) -> str:
    return f"over (partition by ts_code order by trade_date rows between {n} preceding and 1 preceding)"


@query(window_sql("round(ret, 6) as ret"))
def daily_return(m):
    return cols(adjusted(m), ret=w.simple_return())


@query(window_sql(f"round(case when count(ret) {rows(20)} >= 2 then stddev_pop(ret) {rows(20)} end, 6) as vol20"))
def trailing_vol(m):
    return cols(adjusted(m).withColumn("ret", w.simple_return()), vol20=w.trailing_volatility("ret", 20))


@query(window_sql(", ".join(f"round(case when count(close) {rows(n)} >= {n} then avg(close) {rows(n)} end, 6) as ma{n}" for n in (5, 10, 20, 60))))
def sma_bundle(m):
    return cols(m.daily, **{f"ma{n}": w.sma("close", n) for n in (5, 10, 20, 60)})


@query(window_sql(", ".join(f"round(case when count(close) {rows(20)} >= 20 then avg(close) {rows(20)} {s} end, 6) as boll_{n}" for n, s in (("upper", f"+ 2*stddev_pop(close) {rows(20)}"), ("mid", ""), ("lower", f"- 2*stddev_pop(close) {rows(20)}")))))
def bollinger(m):
    up, mid, down = w.bollinger("close")
    return cols(m.daily, boll_upper=up, boll_mid=mid, boll_lower=down)


TR = "greatest(high - low, abs(high - lag(close) over t), abs(low - lag(close) over t))"


@query(window_sql(f"round({TR}, 6) as tr"))
def true_range(m):
    return cols(m.daily, tr=w.true_range())


@query(window_sql(f"round(avg(vol) {rows(5)}, 6) as vol_ma5, round(avg(vol) {rows(20)}, 6) as vol_ma20, max(high) {rows(20)} as high_20, min(low) {rows(5)} as low_5, count(*) {rows(60)} as n_60"))
def vol_features(m):
    return w.screen_windows(m.daily).select(*KEY, r6("vol_ma5").alias("vol_ma5"), r6("vol_ma20").alias("vol_ma20"), "high_20", "low_5", "n_60")


MOMENTUM = "case when lag(adj_close, 65) over t > 0 then round(lag(adj_close, 5) over t / lag(adj_close, 65) over t - 1, 6) end"
REVERSAL = "case when lag(adj_close, 5) over t > 0 then round(adj_close / lag(adj_close, 5) over t - 1, 6) end"


@query(window_sql(f"{MOMENTUM} as momentum, {REVERSAL} as reversal, round(stddev_pop(ret) {rows(65)}, 6) as volatility"))
def momentum_features(m):
    df = adjusted(m).withColumn("ret", w.simple_return())
    return cols(df, momentum=w.momentum("adj_close", 60, 5, 0), reversal=w.reversal("adj_close", 5), volatility=F.stddev_pop("ret").over(w.last_rows(65)))


BREAKOUT = f"case when row_number() over t > 20 and max(adj_close) {prior(20)} > 0 then round(adj_close / max(adj_close) {prior(20)} - 1, 6) end"
VOLUME = f"case when row_number() over t > 20 and avg(vol) {prior(5)} > 0 then round(vol / avg(vol) {prior(5)}, 6) end"


@query(window_sql(f"{BREAKOUT} as breakout, {VOLUME} as volume_ratio"))
def breakout_features(m):
    return cols(adjusted(m), breakout=w.breakout("adj_close", 20, 5), volume_ratio=w.volume_ratio("vol", 20, 5))


# Recursive indicators; the twins are recursive queries over the row number

SERIES = "s as (select ts_code, trade_date, high, low, close, row_number() over t as i, lag(close) over t as c1, close - lag(close) over t as step from daily window t as (partition by ts_code order by trade_date))"


def ema_sql(name: str, source: str, value: str, n: int, first: int) -> str:
    """EMA of source.value whose first value is at row ``first``."""
    seed = first + n - 1
    return f"""{name} as (select ts_code, cast({seed} as bigint) as i, avg({value}) as v from {source} where i between {first} and {seed} group by 1 having count(*) = {n}
    union all select e.ts_code, x.i, (2.0/{n + 1})*x.{value} + (1 - 2.0/{n + 1})*e.v from {name} e join {source} x on x.ts_code = e.ts_code and x.i = e.i + 1)"""


def wilder_sql(name: str, value: str, n: int, first: int) -> str:
    seed = first + n - 1
    return f"""{name} as (select ts_code, cast({seed} as bigint) as i, avg({value}) as v from sx where i between {first} and {seed} group by 1 having count(*) = {n}
    union all select e.ts_code, x.i, (1.0/{n})*x.{value} + (1 - 1.0/{n})*e.v from {name} e join sx x on x.ts_code = e.ts_code and x.i = e.i + 1)"""


DOUBLE = "cast(2 as double)"


@query(
    f", {SERIES}, {ema_sql('e12', 's', 'close', 12, 1)}, {ema_sql('e26', 's', 'close', 26, 1)}, df as (select a.ts_code, a.i, a.v - b.v as dif from e12 a join e26 b using (ts_code, i)), {ema_sql('de', 'df', 'dif', 9, 26)} "
    "select s.ts_code, s.trade_date, round(df.dif, 6) as dif, round(de.v, 6) as dea, round(2*(df.dif - de.v), 6) as macd_hist from s left join df using (ts_code, i) left join de using (ts_code, i)",
    recursive=True,
)
def ema_macd(m):
    return recursive(m, "dif", "dea", "macd_hist")


def recursive(m: Market, *names: str) -> DataFrame:
    """The named recursive indicators of unadjusted bars."""
    kinds = "ts_code string, trade_date string, " + ", ".join(f"{c} double" for c in kernels.RECURSIVE)
    bars = m.daily.select(*KEY, "high", "low", "close")
    return cols(bars.groupBy("ts_code").applyInPandas(kernels.recursive_indicators, kinds), **{n: n for n in names})


def rsi_part(n: int) -> str:
    return f"round(case when d{n}.v > 0 then 100 - 100/(1 + u{n}.v/d{n}.v) when u{n}.v > 0 then 100 end, 6) as rsi{n}"


SX = f"sx as (select s.*, greatest(step, 0) as up, greatest(-step, 0) as down, coalesce(greatest(high - low, abs(high - c1), abs(low - c1)), high - low) as tr, count(*) over (partition by ts_code) as n from s)"


@query(
    f", {SERIES}, {SX}, " + ", ".join(wilder_sql(f"{k}{n}", v, n, 2) for n in (6, 14, 24) for k, v in (("u", "up"), ("d", "down")))
    + f" select s.ts_code, s.trade_date, {', '.join(rsi_part(n) for n in (6, 14, 24))} from s "
    + " ".join(f"left join {k}{n} on {k}{n}.ts_code = s.ts_code and {k}{n}.i = s.i" for n in (6, 14, 24) for k in "ud"),
    recursive=True,
)
def rsi(m):
    return recursive(m, "rsi6", "rsi14", "rsi24")


@query(
    f", {SERIES}, {SX}, {wilder_sql('a', 'tr', 14, 1)} select s.ts_code, s.trade_date, round(case when sx.n > 14 then a.v end, 6) as atr14 from s join sx using (ts_code, i) left join a using (ts_code, i)",
    recursive=True,
)
def atr(m):
    return recursive(m, "atr14")


OSCILLATOR = f"""r as (select *, case when max(high) {prior(9)} = min(low) {prior(9)} then 50 else (close - min(low) {prior(9)})/(max(high) {prior(9)} - min(low) {prior(9)})*100 end as rsv from s),
    kd as (select ts_code, cast(9 as bigint) as i, cast(50 as double) as k, cast(50 as double) as d from s where i = 9
    union all select kd.ts_code, r.i, kd.k*2/3 + r.rsv/3, kd.d*2/3 + (kd.k*2/3 + r.rsv/3)/3 from kd join r on r.ts_code = kd.ts_code and r.i = kd.i + 1)"""


@query(
    f", {SERIES}, {OSCILLATOR} select s.ts_code, s.trade_date, round(kd.k, 6) as k, round(kd.d, 6) as d, round(3*kd.k - 2*kd.d, 6) as j from s left join kd using (ts_code, i)",
    recursive=True,
)
def kdj(m):
    return recursive(m, "k", "d", "j")


# Cross-sections


def rank_sql(v: str, high: bool, by: str = "trade_date") -> str:
    """Percentile rank with mean ranks of ties, 0 for null."""
    return f"case when {v} is not null then (rank() over (partition by {by} order by {v} {'asc' if high else 'desc'} nulls last) + (count({v}) over (partition by {by}, {v}) - 1)/2.0)/count({v}) over (partition by {by}) else 0 end"


def minmax_sql(v: str) -> str:
    return f"coalesce(case when max({v}) over (partition by trade_date) > min({v}) over (partition by trade_date) then ({v} - min({v}) over (partition by trade_date))/(max({v}) over (partition by trade_date) - min({v}) over (partition by trade_date)) end, 0)"


for _high in (True, False):
    _name = "pct_rank_high" if _high else "pct_rank_low"

    def _rank(m, high=_high):
        return cols(m.daily_basic, rank=cross.percentile_rank("pe_ttm", high))

    _rank.__name__ = _name
    query(f"select ts_code, trade_date, round({rank_sql('pe_ttm', _high)}, 6) as rank from daily_basic")(_rank)


@query(f"select ts_code, trade_date, round({minmax_sql('pe_ttm')}, 6) as scaled from daily_basic")
def minmax(m):
    return cols(m.daily_basic, scaled=cross.minmax("pe_ttm"))


def weights_sql(scored: str, n: int, cap: float | None) -> str:
    """From ``scored`` (ts_code, trade_date, score) to target weights."""
    steps = f"""top as (select * from (select *, row_number() over (partition by trade_date order by score desc nulls last, ts_code) as place from {scored}) where place <= {n}),
    wt as (select *, case when sum(greatest(score, 0)) over (partition by trade_date) > 0 then greatest(score, 0)/sum(greatest(score, 0)) over (partition by trade_date) else 1.0/count(*) over (partition by trade_date) end as weight from top)"""
    if cap is None:
        return steps + " select trade_date as signal_date, ts_code, round(weight, 6) as weight, score, place from wt"
    return steps + f""", wo as (select *, row_number() over (partition by trade_date order by weight desc, ts_code) - 1 as before, sum(weight) over (partition by trade_date order by weight desc, ts_code rows between current row and unbounded following) as tail from wt),
    wf as (select *, case when weight/nullif(tail, 0)*(1 - before*{cap}) <= {cap} + 1e-15 then before end as ok from wo), wk as (select *, min(ok) over (partition by trade_date) as k from wf),
    wx as (select *, max(case when before = k then tail end) over (partition by trade_date) as kt from wk)
    select trade_date as signal_date, ts_code, round(case when k is null or before < k then case when weight > 0 then {cap} else 0 end else coalesce(weight/nullif(kt, 0), 0)*greatest(1 - k*{cap}, 0) end, 6) as weight, score, place from wx"""


def weighted(m: Market, cap: float | None) -> DataFrame:
    df = m.daily_basic.withColumn("score", r6(F.col("turnover_rate") - 2.5))
    return cross.target_weights(df, "score", 4, cap).select(F.col("trade_date").alias("signal_date"), "ts_code", r6("weight").alias("weight"), "score", "place")


SCORES = ", scored as (select ts_code, trade_date, round(turnover_rate - 2.5, 6) as score from daily_basic), "


@query(SCORES + weights_sql("scored", 4, None))
def target_weights(m):
    return weighted(m, None)


@query(SCORES + weights_sql("scored", 4, 0.3))
def weight_cap(m):
    return weighted(m, 0.3)


# Calendar


@query(""", w as (select ts_code, trade_date, case when isnan(turnover_rate) then null else greatest(turnover_rate/40 - 0.05, 0) end as w from daily_basic), t as (select *, sum(w) over (partition by trade_date) as total from w)
select ts_code, trade_date, round(case when total > 1 then w/total else w end, 6) as weight from t where w > 0""")
def clean_weights(m):
    return cols(cross.cleaned(m.daily_basic.select(*KEY, (F.col("turnover_rate") / 40 - 0.05).alias("weight"))), weight="weight")


@query("select distinct cal_date as trade_date from trade_cal where is_open = 1 and cal_date between '19930101' and '19971231'")
def trade_dates(m):
    return calendar.open_dates(m.trade_cal, m.daily, "19930101", "19971231")


def _rebalance(frequency: str, key: str) -> None:
    def run(m):
        return calendar.rebalance_dates(m.daily.select("trade_date").distinct(), frequency)

    run.__name__ = f"rebalance_{frequency}"
    query(f"select max(trade_date) as trade_date from (select distinct trade_date from daily where trade_date < (select max(trade_date) from daily)) group by {key}")(run)


_rebalance("monthly", "substr(trade_date, 1, 6)")
_rebalance("weekly", "strftime(strptime(trade_date, '%Y%m%d'), '%G%V')")
_rebalance("daily", "trade_date")

# Strategies

LISTED = "s.list_status = 'L' and (s.list_date is null or s.list_date <= r.trade_date) and (s.delist_date is null or s.delist_date >= r.trade_date)"


def base_sql(lookback: int, amount: float) -> str:
    return f""", {RET}, {ASOF}, rv as (select ts_code, trade_date, amount, round(case when count(ret) {rows(lookback)} >= 2 then stddev_pop(ret) {rows(lookback)} end, 6) as volatility from ret),
    base as (select r.*, a.dv_ttm, a.pb, a.pe_ttm, a.total_mv from rv r join month_ends using (trade_date) join stock_basic s on s.ts_code = r.ts_code and {LISTED}
    join last_basic a on a.ts_code = r.ts_code and a.trade_date = r.trade_date where r.amount >= {amount} and a.as_of_date is not null and r.volatility is not null), """


@query(base_sql(120, 50) + f"scored as (select ts_code, trade_date, round({rank_sql('dv_ttm', True)}*0.6 - {minmax_sql('volatility')}*0.3 + {rank_sql('pb', False)}*0.1, 6) as score from base), " + weights_sql("scored", 5, None))
def sig_dividend_low_vol(m):
    return rounded(DividendLowVol(min_amount=50).signals(m.tables(), month_ends(m)))


@query(base_sql(60, 0) + f"scored as (select ts_code, trade_date, round({rank_sql('pb', False)}*0.45 + {rank_sql('pe_ttm', False)}*0.35 - {minmax_sql('volatility')}*0.2 + {rank_sql('total_mv', False)}*0.0, 6) as score from base), " + weights_sql("scored", 20, 0.3))
def sig_value_low_vol(m):
    return rounded(ValueLowVol(max_weight_per_stock=0.3).signals(m.tables(), month_ends(m)))


@query(f""", {RET}, f as (select ts_code, trade_date, amount, {MOMENTUM} as momentum, {REVERSAL} as reversal from ret window t as (partition by ts_code order by trade_date)),
base as (select r.*, -r.reversal as fall from f r join month_ends using (trade_date) join stock_basic s on s.ts_code = r.ts_code and {LISTED} where momentum is not null and reversal is not null),
scored as (select ts_code, trade_date, round({rank_sql('momentum', True)}*0.7 + {rank_sql('fall', True)}*0.3, 6) as score from base), """ + weights_sql("scored", 20, None))
def sig_momentum_reversal(m):
    return rounded(MomentumReversal().signals(m.tables(), month_ends(m)))


@query(f""", f as (select ts_code, trade_date, amount, pct_chg, {BREAKOUT} as breakout, {VOLUME} as volume_ratio from adjusted window t as (partition by ts_code order by trade_date)),
base as (select r.* from f r join month_ends using (trade_date) join stock_basic s on s.ts_code = r.ts_code and {LISTED} where breakout > 0 and volume_ratio >= 1.2 and pct_chg >= 0),
scored as (select ts_code, trade_date, round({rank_sql('breakout', True)}*0.6 + {rank_sql('volume_ratio', True)}*0.4, 6) as score from base), """ + weights_sql("scored", 20, None))
def sig_breakout(m):
    return rounded(VolumePriceBreakout(volume_multiplier=1.2).signals(m.tables(), month_ends(m)))


# Screeners and verification

FACTORED = """priced as (select ts_code, trade_date, d.high*f.adj_factor/f.last as high, d.low*f.adj_factor/f.last as low, d.close*f.adj_factor/f.last as close
from daily d join (select a.*, last_value(a.adj_factor) over (partition by ts_code order by trade_date rows between unbounded preceding and unbounded following) as last from adj_factor a semi join daily using (ts_code, trade_date)) f
using (ts_code, trade_date) where f.last <> 0)"""

PAIRS = "days as (select trade_date, lag(trade_date) over (order by trade_date) as prev_date, row_number() over (order by trade_date) - 1 as pos from (select distinct trade_date from daily))"
SURGE = f""", {PAIRS}, surge as (select d.ts_code, coalesce(s.name, '') as name, d.trade_date, cast(d.vol as bigint) as vol_today, cast(p.vol as bigint) as vol_prev, round(d.vol/nullif(p.vol, 0), 6) as vol_ratio,
d.close, round(d.pct_chg, 6) as pct_chg from daily d join days y using (trade_date) join daily p on p.ts_code = d.ts_code and p.trade_date = y.prev_date left join stock_basic s on s.ts_code = d.ts_code where d.vol/nullif(p.vol, 0) >= 2 and d.pct_chg > 0) """


@query(SURGE + "select * from surge")
def screen_volume_surge(m):
    return screeners.volume_surge(m.daily, m.stock_basic)


@query(SURGE + "select trade_date, count(s.ts_code) as hits, traded, round(count(s.ts_code)/traded, 6) as share from (select trade_date, count(distinct ts_code) as traded from daily group by 1) left join surge s using (trade_date) group by trade_date, traded")
def screen_trigger_share(m):
    return screeners.trigger_ratio(screeners.volume_surge(m.daily, m.stock_basic), m.daily)


TECH = ", ".join(wilder_sql(f"{k}{n}", v, n, 2) for n in (6, 14) for k, v in (("u", "up"), ("d", "down")))


TREND_SQL = f""", {SERIES}, {SX}, {PAIRS}, {TECH}, {ema_sql('e12', 's', 'close', 12, 1)}, {ema_sql('e26', 's', 'close', 26, 1)}, df as (select a.ts_code, a.i, a.v - b.v as dif from e12 a join e26 b using (ts_code, i)), {ema_sql('de', 'df', 'dif', 9, 26)},
    tech as (select s.ts_code, s.trade_date, {', '.join(f"round(case when s.i >= {n} then avg(close) over (partition by s.ts_code order by s.trade_date rows between {n - 1} preceding and current row) end, 6) as ma{n}" for n in (5, 20, 60))}, {rsi_part(6)}, {rsi_part(14)},
      round(df.dif, 6) as dif, round(de.v, 6) as dea, round(2*(df.dif - de.v), 6) as macd_hist from s {' '.join(f"left join {k}{n} on {k}{n}.ts_code = s.ts_code and {k}{n}.i = s.i" for n in (6, 14) for k in "ud")} left join df on df.ts_code = s.ts_code and df.i = s.i left join de on de.ts_code = s.ts_code and de.i = s.i),
    bars as (select *, avg(vol) {rows(5)} as vol_ma5, max(high) {rows(20)} as high_20, min(low) {rows(5)} as low_5, count(*) {rows(60)} as n_60 from daily where close > 0 and vol > 0),
    f as (select b.*, p.close as prev_close, t.* exclude (ts_code, trade_date), q.ma5 as prev_ma5, q.macd_hist as prev_hist, x.turnover_rate, x.volume_ratio, coalesce(n.name, '') as name, coalesce(n.list_status, '') as list_status,
      round(b.vol/nullif(b.vol_ma5, 0), 6) as vol_ratio_5, round((b.high_20/nullif(b.close, 0) - 1)*100, 6) as upside_room_pct, round((b.close/nullif(t.ma20, 0) - 1)*100, 6) as ma20_gap_pct
      from bars b join days y using (trade_date) join bars p on p.ts_code = b.ts_code and p.trade_date = y.prev_date join tech t on t.ts_code = b.ts_code and t.trade_date = b.trade_date
      left join tech q on q.ts_code = b.ts_code and q.trade_date = y.prev_date left join daily_basic x on x.ts_code = b.ts_code and x.trade_date = b.trade_date left join stock_basic n on n.ts_code = b.ts_code
      where b.n_60 >= 60 and t.ma5 is not null and t.ma20 is not null and t.ma60 is not null and t.rsi6 is not null and t.rsi14 is not null and t.macd_hist is not null and coalesce(n.name, '') not like '%ST%' and coalesce(n.list_status, '') in ('', 'L')),
    g as (select *, case when ma20 > ma60 and close > ma20 then 20 else 0 end + case when close between ma20*0.995 and ma20*1.08 then 15 else 0 end + case when low_5 <= ma20*1.025 and close <= high_20*0.98 then 15 else 0 end
      + case when close > open and round(pct_chg, 6) between 0.2 and 5.5 then 15 else 0 end + case when close > ma5 and prev_close <= prev_ma5 then 10 else 0 end + case when vol_ratio_5 between 1.05 and 2.6 then 10 else 0 end
      + case when rsi14 between 45 and 70 and rsi6 > rsi14 then 10 else 0 end + case when macd_hist > coalesce(prev_hist, -999999) and dif >= dea then 5 else 0 end as signal_score from f)
    select ts_code, name, trade_date, signal_score, close, round(pct_chg, 6) as pct_chg, upside_room_pct, ma20_gap_pct, vol_ratio_5, round(volume_ratio, 6) as volume_ratio, round(turnover_rate, 6) as turnover_rate, rsi6, rsi14, macd_hist,
      concat_ws('/', case when ma20_gap_pct between -0.5 and 8 then '20线' end, case when upside_room_pct >= 2 then '空间' end, case when vol_ratio_5 between 1.05 and 2.6 then '放量' end, case when rsi6 > rsi14 then '动能' end, case when macd_hist > 0 then 'MACD+' end) as signal_reason
    from g where close > ma20 and ma20 > ma60 and low_5 <= ma20*1.04 and close <= high_20*0.985 and """


@query(TREND_SQL + "signal_score >= 50", recursive=True)
def screen_trend_pullback(m):
    return screeners.trend_pullback(m.daily, resume.indicators(m.daily), m.daily_basic, m.stock_basic, 50)


AS_OF, LEAST = "19970412", 20


@query(TREND_SQL + f"signal_score >= {LEAST} and trade_date = (select max(trade_date) from daily where trade_date <= '{AS_OF}') order by signal_score desc, upside_room_pct desc, vol_ratio_5 desc, ts_code limit 5", recursive=True)
def screen_latest_candidates(m):
    return screeners.latest_candidates(m.daily, resume.indicators(m.daily), m.daily_basic, m.stock_basic, LEAST, 5, AS_OF)


VERIFIED = (("daily", KEY), ("adj_factor", KEY), ("daily_basic", KEY), ("suspend_d", [*KEY, "suspend_type"]))


@query(" union all ".join(f"select '{t}' as table_name, count(*) as n_rows, count(*) - count(distinct ({', '.join(k)})) as duplicates, min(trade_date) as first_date, max(trade_date) as last_date from {t}" for t, k in VERIFIED))
def verify_overview(m):
    out = None
    for name, keys in VERIFIED:
        part = screeners.overview(getattr(m, name), name, tuple(keys), "trade_date")
        out = part if out is None else out.unionByName(part)
    return out


@query(""", o as (select cal_date, row_number() over (order by cal_date) as pos from (select distinct cal_date from trade_cal where is_open = 1)), miss as (select *, pos - row_number() over (order by pos) as island from o where cal_date not in (select trade_date from daily where vol > 100))
select min(cal_date) as first_date, max(cal_date) as last_date, count(*) as n_days from miss group by island""")
def verify_calendar_gaps(m):
    return screeners.calendar_gaps(m.trade_cal, m.daily.where("vol > 100"))


@query(" union all ".join(
    f"select '{t}' as table_name, 'missing' as kind, trade_date from (select distinct trade_date from daily) where trade_date not in (select trade_date from {t}) union all select '{t}', 'extra', trade_date from (select distinct trade_date from {t}) where trade_date not in (select trade_date from daily)"
    for t in ("adj_factor", "daily_basic", "suspend_d")
))
def verify_alignment(m):
    return screeners.alignment(m.daily, {t: getattr(m, t) for t in ("adj_factor", "daily_basic", "suspend_d")})


REPORTED = {"stock_basic": ("ts_code",), "trade_cal": ("cal_date", "exchange"), "daily": tuple(KEY), "adj_factor": tuple(KEY), "daily_basic": tuple(KEY), "suspend_d": (*KEY, "suspend_type"), "tech_indicator": tuple(KEY)}
DATED = dict.fromkeys(REPORTED, "trade_date") | {"stock_basic": None, "trade_cal": "cal_date"}
REPORT_SQL = f""", {FACTORED}, tech_indicator as (select ts_code, trade_date from (select *, row_number() over (partition by ts_code order by trade_date) as i from priced) where i >= 5),
ov as ({" union all ".join(f"select '{t}' as table_name, count(*) - count(distinct ({', '.join(k)})) as n, min({DATED[t] or 'cast(null as varchar)'}) as first_date, max({DATED[t] or 'cast(null as varchar)'}) as last_date from {t}" for t, k in REPORTED.items())}),
o as (select cal_date, row_number() over (order by cal_date) as pos from (select distinct cal_date from trade_cal where is_open = 1)), miss as (select *, pos - row_number() over (order by pos) as island from o where cal_date not in (select trade_date from daily)),
n as (select trade_date, count(distinct ts_code) as n from daily group by 1), u as (select *, case when count(n) over p >= 3 then avg(n) over p end as usual from n window p as (order by trade_date rows between 5 preceding and 1 preceding)),
st as (select strftime(strptime(max(trade_date), '%Y%m%d') - interval 60 day, '%Y%m%d') as s from daily), rd as (select distinct trade_date from daily, st where trade_date >= s),
al as ({" union all ".join(f"select '{t}' as table_name, 'missing dates' as kind, 'error' as level, trade_date from rd where trade_date not in (select trade_date from {t}) union all select '{t}', 'extra dates', 'info', trade_date from (select distinct trade_date from {t}, st where trade_date >= s) where trade_date not in (select trade_date from rd)" for t in screeners.ALIGNED)}),
mv as (select trade_date from daily, st where trade_date >= s and (substr(ts_code, 1, 2) in ('60', '00') and abs(pct_chg) > 10.5 or substr(ts_code, 1, 2) in ('30', '68') and abs(pct_chg) > 20.5))
select 'duplicates' as "check", table_name, case when n > 0 then 'error' else 'ok' end as level, n, first_date, last_date from ov
union all select 'days without bars', 'daily', 'error', count(*), min(cal_date), max(cal_date) from miss group by island
union all select * from (select 'instruments of the latest day', 'daily', case when n < 0.8*usual then 'error' when n < 0.95*usual then 'info' else 'ok' end, n, trade_date, trade_date as d2 from u order by trade_date desc limit 1)
union all select kind, table_name, level, count(*), min(trade_date), max(trade_date) from al group by all
union all select 'moves beyond limits', 'daily', case when count(*) > 0 then 'info' else 'ok' end, count(*), min(trade_date), max(trade_date) from mv"""


@query(REPORT_SQL)
def verify_report(m):
    tables = m.tables() | {"tech_indicator": resume.indicators(w.indicator_prices(m.daily, m.adj_factor))}
    return screeners.verification(tables, REPORTED, DATED)


@query(""", n as (select trade_date, count(distinct ts_code) as n from daily group by 1), u as (select *, case when count(n) over p >= 3 then avg(n) over p end as usual from n window p as (order by trade_date rows between 5 preceding and 1 preceding))
select trade_date, n, round(usual, 6) as usual, case when n < 0.8*usual then 'error' when n < 0.95*usual then 'info' else 'ok' end as level from u""")
def verify_daily_counts(m):
    return screeners.daily_counts(m.daily)


@query(", n as (select trade_date, count(distinct ts_code) as n from daily group by 1) select substr(trade_date, 1, 4) as year, min(trade_date) as first_date, min_by(n, trade_date) as n from n group by 1")
def first_days(m):
    return screeners.first_day_of_year(m.daily)


@query("select ts_code, trade_date, round(pct_chg, 6) as pct_chg from daily where trade_date >= '19940101' and substr(ts_code, 1, 2) in ('60', '00') and abs(pct_chg) > 5")
def verify_abnormal_moves(m):
    return screeners.abnormal_moves(m.daily, "19940101", 5.0)


@query("select ts_code, max(trade_date) as trade_date, arg_max(vol, trade_date) as vol, count(*) as bars from daily group by 1")
def dedup_keep_last(m):
    last = keep_last(m.daily.select(*KEY, "vol"), ["ts_code"], ["trade_date"])
    return last.join(m.daily.groupBy("ts_code").agg(F.count(F.lit(1)).alias("bars")), "ts_code")


@query("select ts_code, trade_date, open, high, low, close, vol from (select *, row_number() over (partition by ts_code order by trade_date desc) as place from daily where trade_date >= '19950101') where place <= 60")
def kline_window(m):
    df = screeners.kline(m.daily, "19950101", limit=60)
    return df.select(*KEY, "open", "high", "low", "close", "vol")


# The store, names and events


def scratch(m: Market) -> str:
    """A new folder that all executors share: below spark.checkpoint.dir, or the warehouse where that is unset."""
    conf = m.spark.conf
    root = conf.get("spark.checkpoint.dir", None) or m.spark.sparkContext.getConf().get("spark.checkpoint.dir") or conf.get("spark.sql.warehouse.dir")
    return f"{root.rstrip('/')}/market-{uuid.uuid4().hex}"


@query("select ts_code, trade_date, close, vol, adj_open, adj_close from (select *, last_value(factor) over (partition by ts_code order by trade_date rows between unbounded preceding and unbounded following) as last2, "
       "open*factor/nullif(last2, 0) as adj_open, close*factor/nullif(last2, 0) as adj_close from (select d.*, coalesce(last_value(f.adj_factor ignore nulls) over (partition by d.ts_code order by d.trade_date rows unbounded preceding), "
       "first_value(f.adj_factor ignore nulls) over (partition by d.ts_code order by d.trade_date rows between current row and unbounded following)) as factor "
       "from (select * from daily where trade_date between '19950601' and '19970315') d left join adj_factor f using (ts_code, trade_date)))")
def stored_bundle(m):
    """The market bundle of a range of dates from a store that the tables were saved to, bars twice with repeats removed again."""
    store = Store(m.spark, scratch(m))
    for table in ("daily", "adj_factor", "daily_basic", "suspend_d", "trade_cal", "stock_basic"):
        store.save(table, conform(getattr(m, table), SPECS[table]))
    store.save("daily", store.load("daily").where("trade_date between '19960101' and '19960331'"))
    store.deduplicate_all()
    return store.market("19950601", "19970315")["daily"].select(*KEY, "close", "vol", "adj_open", "adj_close")


@query(f", {FACTORED} select ts_code, trade_date, high, low, close from priced")
def indicator_adjusted(m):
    return w.indicator_prices(m.daily, m.adj_factor).select(*KEY, "high", "low", "close")


@query(f", {RET}, f as (select ts_code, trade_date, {MOMENTUM} as momentum, {REVERSAL} as reversal from ret window t as (partition by ts_code order by trade_date)), "
       f"base as (select r.*, -r.reversal as fall from f r join month_ends using (trade_date) join stock_basic s on s.ts_code = r.ts_code and {LISTED} where momentum is not null and reversal is not null), "
       f"scored as (select ts_code, trade_date, round({rank_sql('momentum', True)}*0.7 + {rank_sql('fall', True)}*0.3, 6) as score from base), top as (select * from scored qualify row_number() over (partition by trade_date order by score desc, ts_code) <= 3), "
       "named as (select ts_code, arg_max(name, symbol) as name from stock_basic where trim(name) <> '' and name not like 'ST%' group by 1) select trade_date as signal_date, t.ts_code, name, score from top t left join named n using (ts_code)")
def signal_names(m):
    named = m.stock_basic.withColumn("name", F.when(F.col("name").startswith("ST"), " ").otherwise(F.col("name")))
    return with_names(MomentumReversal(top_n=3).signals(m.tables(), month_ends(m)), named, "symbol").select("signal_date", "ts_code", "name", "score")


@query("select c.cal_date, o.cal_date as open_date from (select distinct cal_date from trade_cal) c asof left join (select distinct cal_date from trade_cal where is_open = 1) o on c.cal_date >= o.cal_date")
def last_open_days(m):
    return calendar.last_open_days(m.trade_cal)


@query("select date_trunc('day', ts) as start, event_type, round(arg_min(value, (ts, event_id)), 6) as open, round(max(value), 6) as high, round(min(value), 6) as low, round(arg_max(value, (ts, event_id)), 6) as close, count(*) as n from events group by 1, 2")
def daily_event_bars(m):
    df = event_bars(m._read("events"))
    return df.select("start", "event_type", *(r6(c).alias(c) for c in ("open", "high", "low", "close")), "n")


@query("""select user_id, min(ts) as start, max(ts) + interval 30 minute as "end", count(*) as n, round(sum(value), 4) as total
from (select *, sum(fresh) over (partition by user_id order by ts, event_id) as session from (select *, case when lag(ts) over u + interval 30 minute > ts then 0 else 1 end as fresh from events window u as (partition by user_id order by ts, event_id))) group by user_id, session""")
def event_sessions(m):
    df = user_sessions(m._read("events"))
    return df.select("user_id", "start", "end", "n", F.round("total", 4).alias("total"))


# Simulation and metrics

EQUITY_SQL = ", eq as (select cast(o_custkey % 50 as varchar) as run_id, strftime(o_orderdate, '%Y%m%d') as trade_date, sum(floor(o_totalprice)) as flow from orders group by 1, 2), cv as (select run_id, trade_date, 1e8 + sum(case when cast(trade_date as int) % 3 = 0 then -flow else flow end) over (partition by run_id order by trade_date) as equity from eq)"


def order_equity(m: Market) -> DataFrame:
    """A curve for each of fifty groups of customers: order totals that come in and go out."""
    flow = m._read("orders").groupBy((F.col("o_custkey") % 50).cast("string").alias("run_id"), F.date_format("o_orderdate", "yyyyMMdd").alias("trade_date")).agg(F.sum(F.floor("o_totalprice")).alias("flow"))
    signed = F.when(F.col("trade_date").cast("int") % 3 == 0, -F.col("flow")).otherwise(F.col("flow"))
    run = Window.partitionBy("run_id").orderBy("trade_date").rowsBetween(Window.unboundedPreceding, 0)
    return flow.select("run_id", "trade_date", (F.lit(1e8) + F.sum(signed).over(run)).alias("equity"))


@query(EQUITY_SQL + " select run_id, trade_date, round(equity, 6) as equity, round(max(equity) over x, 6) as peak, round(equity/max(equity) over x - 1, 6) as drawdown from cv window x as (partition by run_id order by trade_date rows unbounded preceding)")
def drawdown_curve(m):
    return simulate.drawdowns(order_equity(m)).select("run_id", "trade_date", *(r6(c).alias(c) for c in ("equity", "peak", "drawdown")))


METRIC_SQL = EQUITY_SQL + """, st as (select *, equity/lag(equity) over (partition by run_id order by trade_date) - 1 as ret, equity/max(equity) over (partition by run_id order by trade_date rows unbounded preceding) - 1 as dd from cv),
mt as (select run_id, arg_max(equity, trade_date)/1e8 - 1 as total_return, count(*) as days, min(dd) as max_drawdown, avg(ret) as mean, stddev_pop(ret) as dev, count(ret) as n, avg(equity) as level from st group by 1),
tr as (select run_id, sum(abs(flow)) as gross, count(*) as trade_count from eq group by 1),
mr as (select run_id, round(total_return, 6) as total_return, round(case when total_return <= -1 then -1 else pow(1 + total_return, 252.0/greatest(days - 1, 1)) - 1 end, 6) as annual_return, round(max_drawdown, 6) as max_drawdown,
round(case when n > 1 and dev > 0 then mean/dev*sqrt(252.0) else 0 end, 6) as sharpe, round(gross/level, 6) as turnover, trade_count from mt join tr using (run_id)) """


def order_metrics(m: Market) -> DataFrame:
    trades = m._read("orders").groupBy((F.col("o_custkey") % 50).cast("string").alias("run_id"), F.date_format("o_orderdate", "yyyyMMdd").alias("trade_date")).agg(F.sum(F.floor("o_totalprice")).alias("gross_amount"))
    found = simulate.metrics(order_equity(m), trades, 1e8)
    return found.select("run_id", *(r6(c).alias(c) for c in ("total_return", "annual_return", "max_drawdown", "sharpe", "turnover")), "trade_count")


@query(METRIC_SQL + "select * from mr")
def perf_metrics(m):
    return order_metrics(m)


@query(METRIC_SQL + "select *, cast(row_number() over (order by sharpe desc, annual_return desc, max_drawdown desc, turnover, run_id) as integer) as place from mr where trade_count > 0")
def grid_rank(m):
    return screeners.ranked_runs(order_metrics(m))


BACKTESTED = {"dividend": DividendLowVol(min_amount=50), "value": ValueLowVol(), "momentum": MomentumReversal(), "breakout": VolumePriceBreakout(volume_multiplier=1.2)}
MOST_CODES = 1_000_000  # so many instruments are broadcast at the most


def stored(m: Market, df: DataFrame) -> DataFrame:
    """``df`` as a table in a scratch folder, so that what reads it several times makes it once."""
    path = scratch(m)
    df.write.parquet(path)
    return m.spark.read.schema(df.schema).parquet(path)


def backtest(m: Market) -> DataFrame:
    """Bars are made twice: of all instruments for the signals, of which rows at rebalance dates are kept, and of the
    instruments picked then (top_n of a run for each date at most) for the simulation."""
    days = stored(m, calendar.open_dates(m.trade_cal))  # those of daily
    dates = stored(m, calendar.rebalance_dates(days, "monthly"))
    signals = stored(m, signals_of_runs(BACKTESTED, stored(m, measured(BACKTESTED, m.bars(), m.stock_basic, dates))))
    marks = dates.select(F.explode(F.array(*map(F.lit, BACKTESTED))).alias("run_id"), F.col("trade_date").alias("signal_date"))
    codes = signals.select("ts_code").distinct()
    bars = m.bars(F.broadcast(codes) if codes.count() <= MOST_CODES else codes)
    return simulate.simulate(signals, marks, w.adjusted_prices(bars), days, None)


@query()
def backtest_equity(m):
    return simulate.equity_of(backtest(m))


@query()
def backtest_trades(m):
    return simulate.trades_of(backtest(m))


@query()
def backtest_metrics(m):
    return simulate.metrics_of(backtest(m), 1_000_000.0)


@query()
def grid_metrics(m):
    weights = [(0.6, 0.3, 0.1), (0.5, 0.4, 0.1), (0.7, 0.2, 0.1)]
    runs = screeners.grid(lookback_days=[40, 60, 120], min_amount=[0, 20, 50], weights=weights, top_n=[5])
    found = screeners.simulated_grid(m.spark, m.tables(), runs, month_ends(m), calendar.open_dates(m.trade_cal))
    return screeners.ranked_runs(found)


ALL_WILDER = ", ".join(wilder_sql(f"{k}{n}", v, n, 2) for n in (6, 14, 24) for k, v in (("u", "up"), ("d", "down")))
INDICATOR_SQL = (
    f", {FACTORED}, {SERIES.replace('from daily', 'from priced')}, {SX}, {ALL_WILDER}, {wilder_sql('a', 'tr', 14, 1)}, {ema_sql('e12', 's', 'close', 12, 1)}, {ema_sql('e26', 's', 'close', 26, 1)}, "
    f"df as (select a.ts_code, a.i, a.v - b.v as dif from e12 a join e26 b using (ts_code, i)), {ema_sql('de', 'df', 'dif', 9, 26)}, {OSCILLATOR}"
    f" select s.ts_code, s.trade_date, round(df.dif, 6) as dif, round(de.v, 6) as dea, round(2*(df.dif - de.v), 6) as macd_hist, round(kd.k, 6) as k, round(kd.d, 6) as d, round(3*kd.k - 2*kd.d, 6) as j, "
    + ", ".join(rsi_part(n) for n in (6, 14, 24)) + ", "
    + ", ".join(f"round(case when s.i >= {n} then avg(s.close) over (partition by s.ts_code order by s.trade_date rows between {n - 1} preceding and current row) end, 6) as ma{n}" for n in (5, 10, 20, 60)) + ", "
    + ", ".join(f"round(case when s.i >= 20 then avg(s.close) over b {x} end, 6) as boll_{n}" for n, x in (("upper", "+ 2*stddev_pop(s.close) over b"), ("mid", ""), ("lower", "- 2*stddev_pop(s.close) over b")))
    + ", round(case when sx.n > 14 then a.v end, 6) as atr14 from s join sx on sx.ts_code = s.ts_code and sx.i = s.i "
    + " ".join(f"left join {x} on {x}.ts_code = s.ts_code and {x}.i = s.i" for x in ("df", "de", "kd", "a", *(f"{k}{n}" for n in (6, 14, 24) for k in "ud")))
    + " window b as (partition by s.ts_code order by s.trade_date rows between 19 preceding and current row) qualify s.i >= 5"
)


@query(INDICATOR_SQL, recursive=True)
def tech_indicator(m):
    return cols(resume.indicators(w.indicator_prices(m.daily, m.adj_factor)), **{c: c for c in resume.INDICATORS})


@query(INDICATOR_SQL, recursive=True)
def tech_incremental(m):
    """The same table in three parts, each going on from the states that the one before left."""
    bars = resume.products(m.daily, m.adj_factor)
    states, rows = m.spark.createDataFrame([], resume.STATE), []
    for start, end in (("0", "19940101"), ("19940101", "19970101"), ("19970101", "9")):
        found, states = resume.rows_and_states(resume.resume(bars.where((F.col("trade_date") >= start) & (F.col("trade_date") < end)), states))
        rows.append(found)
    return cols(resume.adjusted_view(rows[0].unionByName(rows[1]).unionByName(rows[2]), states), **{c: c for c in resume.INDICATORS})
