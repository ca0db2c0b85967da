"""Stock-picking strategies: signals for all rebalance dates in one plan, and a registry for further ones."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import asdict, dataclass, fields
from functools import reduce
from typing import ClassVar

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.columns import active, require
from ..operators import cross, windows as w

DIGITS = 6  # factors are rounded before ranking, so that equal values tie on any engine


def r6(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, DIGITS)


@dataclass(frozen=True)
class DividendLowVol:
    """High dividend yield, low volatility, low price to book."""

    top_n: int = 5
    lookback_days: int = 120
    min_amount: float = 50000.0
    dividend_weight: float = 0.6
    volatility_weight: float = 0.3
    value_weight: float = 0.1
    max_weight_per_stock: float | None = None
    fundamental: ClassVar[bool] = True

    def measures(self, rows: w.Rows = w.ROWS) -> dict[str, Column]:
        return {"volatility": r6(w.trailing_volatility("ret", self.lookback_days, rows))}

    def signals(self, market: dict[str, DataFrame], dates: DataFrame) -> DataFrame:
        return self.chosen(base_frame(market, dates, self.lookback_days, self.min_amount))

    def chosen(self, base: DataFrame) -> DataFrame:
        dividend = "dv_ttm" if "dv_ttm" in base.columns else "dv_ratio"
        score = cross.percentile_rank(dividend) * self.dividend_weight - cross.minmax("volatility") * self.volatility_weight
        if "pb" in base.columns:
            score = score + cross.percentile_rank("pb", False) * self.value_weight
        return picked(base, score, self)


@dataclass(frozen=True)
class ValueLowVol:
    """Low price to book and earnings, low volatility."""

    top_n: int = 20
    lookback_days: int = 60
    min_amount: float = 0.0
    pb_weight: float = 0.45
    pe_weight: float = 0.35
    volatility_weight: float = 0.2
    size_weight: float = 0.0
    max_weight_per_stock: float | None = None
    fundamental: ClassVar[bool] = True

    def measures(self, rows: w.Rows = w.ROWS) -> dict[str, Column]:
        return {"volatility": r6(w.trailing_volatility("ret", self.lookback_days, rows))}

    def signals(self, market: dict[str, DataFrame], dates: DataFrame) -> DataFrame:
        return self.chosen(base_frame(market, dates, self.lookback_days, self.min_amount))

    def chosen(self, base: DataFrame) -> DataFrame:
        earnings = "pe_ttm" if "pe_ttm" in base.columns else "pe"
        score = (
            cross.percentile_rank("pb", False) * self.pb_weight + cross.percentile_rank(earnings, False) * self.pe_weight
            - cross.minmax("volatility") * self.volatility_weight + cross.percentile_rank("total_mv", False) * self.size_weight
        )
        return picked(base, score, self)


@dataclass(frozen=True)
class MomentumReversal:
    """Strong over the middle term, weak over the last days."""

    top_n: int = 20
    momentum_days: int = 60
    reversal_days: int = 5
    skip_days: int = 0
    min_amount: float = 0.0
    momentum_weight: float = 0.7
    reversal_weight: float = 0.3
    volatility_weight: float = 0.0
    max_weight_per_stock: float | None = None
    fundamental: ClassVar[bool] = False

    def measures(self, rows: w.Rows = w.ROWS) -> dict[str, Column]:
        m, r, s = self.momentum_days, self.reversal_days, self.skip_days
        found = {"momentum": r6(w.momentum("adj_close", m, r, s, rows)), "reversal": r6(w.reversal("adj_close", r, rows))}
        return found | ({"volatility": r6(rows.over(F.stddev_pop, "ret", 1 - m - r, 0))} if self.volatility_weight else {})

    def signals(self, market: dict[str, DataFrame], dates: DataFrame) -> DataFrame:
        full = adjusted(market).withColumn("ret", w.simple_return()).withColumns(self.measures())
        return self.chosen(eligible(full, market, dates, self.min_amount))

    def chosen(self, base: DataFrame) -> DataFrame:
        base = base.na.drop(subset=["momentum", "reversal"]).withColumn("fall", -F.col("reversal"))
        score = cross.percentile_rank("momentum") * self.momentum_weight + cross.percentile_rank("fall") * self.reversal_weight
        if self.volatility_weight:
            score = score - cross.minmax("volatility") * self.volatility_weight
        return picked(base, score, self)


@dataclass(frozen=True)
class VolumePriceBreakout:
    """A new high on unusual volume."""

    top_n: int = 20
    breakout_days: int = 20
    volume_days: int = 5
    volume_multiplier: float = 2.0
    min_pct_chg: float = 0.0
    min_amount: float = 0.0
    breakout_weight: float = 0.6
    volume_weight: float = 0.4
    max_weight_per_stock: float | None = None
    fundamental: ClassVar[bool] = False

    def measures(self, rows: w.Rows = w.ROWS) -> dict[str, Column]:
        b, v = self.breakout_days, self.volume_days
        return {"breakout": r6(w.breakout("adj_close", b, v, rows)), "volume_ratio": r6(w.volume_ratio("vol", b, v, rows))}

    def signals(self, market: dict[str, DataFrame], dates: DataFrame) -> DataFrame:
        return self.chosen(eligible(adjusted(market).withColumns(self.measures()), market, dates, self.min_amount))

    def chosen(self, base: DataFrame) -> DataFrame:
        base = base.where((F.col("breakout") > 0) & (F.col("volume_ratio") >= self.volume_multiplier) & (F.col("pct_chg") >= self.min_pct_chg))
        score = cross.percentile_rank("breakout") * self.breakout_weight + cross.percentile_rank("volume_ratio") * self.volume_weight
        return picked(base, score, self)


def adjusted(market: dict[str, DataFrame]) -> DataFrame:
    require(market["daily"], ["ts_code", "trade_date", "close"], "daily")
    return w.adjusted_prices(market["daily"], market["adj_factor"])


def eligible(bars: DataFrame, market: dict[str, DataFrame], dates: DataFrame, min_amount: float) -> DataFrame:
    """Bars on the dates, of instruments listed then and with enough turnover; windows come before this filter.

    A stock_basic that is missing or has no rows excludes nothing. The dates are broadcast: they are at most a row for
    each day of a calendar. So bars stay dealt by instrument, and those of other dates go before any further exchange.
    """
    bars = listed(bars.join(F.broadcast(dates.select("trade_date").distinct()), "trade_date", "left_semi"), market.get("stock_basic"))
    return bars.where(F.col("amount") >= min_amount) if min_amount > 0 else bars


def listed(bars: DataFrame, stocks: DataFrame | None) -> DataFrame:
    if stocks is None or stocks.isEmpty():
        return bars
    cols = ["list_status", "list_date", "delist_date"]
    return bars.join(stocks.select("ts_code", *cols).dropDuplicates(["ts_code"]), "ts_code").where(active(F.col("trade_date"))).drop(*cols)


def base_frame(market: dict[str, DataFrame], dates: DataFrame, lookback: int, min_amount: float) -> DataFrame:
    """Bars of the dates with their last known fundamentals and trailing volatility; rows without volatility go."""
    bars = adjusted(market).withColumn("ret", w.simple_return()).withColumn("volatility", r6(w.trailing_volatility("ret", lookback)))
    basics = [c for c in market["daily_basic"].columns if c not in ("ts_code", "trade_date")]
    bars = eligible(bars, market, dates, min_amount)
    found = w.as_of(bars, market["daily_basic"], basics)
    return found.where("as_of_date is not null").na.drop(subset=["volatility"])


def measured(runs: dict[str, object], bars: DataFrame, stock_basic: DataFrame, dates: DataFrame) -> DataFrame:
    """What several strategies, by run_id, need of the bars on the dates, in one pass. bars: with adj_factor and basic (a
    struct, null where there is no row of fundamentals) beside each, as Market.bars() gives them."""
    full = w.adjusted_prices(bars).withColumn("ret", w.simple_return()).select("*", w.carried("basic").alias("_known"))
    basics = [c for c in bars.schema["basic"].dataType.names if c != "as_of_date"]
    full = full.withColumns({"rated": F.col("_known.as_of_date").isNotNull()} | {f"basic_{c}": F.col(f"_known.{c}") for c in basics})
    steps = w.Steps()
    found = {f"{run}_{n}": c for run, s in runs.items() for n, c in s.measures(steps).items()}
    found |= {c: steps.back(c, 0) for c in ("amount", "pct_chg", "rated", *(f"basic_{c}" for c in basics))}
    rows = steps.groups(full, dates).groupBy("ts_code", F.col("_date").alias("trade_date")).agg(*(c.alias(n) for n, c in found.items()))
    return listed(rows, stock_basic)


def signals_of_runs(runs: dict[str, object], base: DataFrame) -> DataFrame:
    """run_id, signal_date, ts_code, weight of each run from what measured() gives."""
    parts = []
    for run, s in runs.items():
        rows = base.where(F.col("amount") >= s.min_amount) if s.min_amount > 0 else base
        own = [F.col(f"{run}_{n}").alias(n) for n in s.measures()]
        if s.fundamental:
            basics = [F.col(c).alias(c.removeprefix("basic_")) for c in base.columns if c.startswith("basic_")]
            rows = rows.where("rated").select("ts_code", "trade_date", *basics, *own).na.drop(subset=["volatility"])
        else:
            rows = rows.select("ts_code", "trade_date", "pct_chg", *own)
        parts.append(s.chosen(rows).select(F.lit(run).alias("run_id"), "signal_date", "ts_code", "weight"))
    return reduce(DataFrame.unionByName, parts)


def picked(base: DataFrame, score: Column, params) -> DataFrame:
    base = base.withColumn("score", r6(score))
    chosen = cross.target_weights(base, "score", params.top_n, params.max_weight_per_stock)
    return chosen.select(F.col("trade_date").alias("signal_date"), "ts_code", "weight", "score", "place")


Strategy = Callable[..., object]
_registry: dict[str, Strategy] = {}


def register(name: str, factory: Strategy) -> None:
    if name in _registry:
        raise ValueError(f"strategy {name!r} is registered already")
    _registry[name] = factory


def names() -> list[str]:
    return sorted(_registry)


def strategy(name: str, **params):
    """A strategy by name; parameters it doesn't know and those that are None are left out."""
    if name not in _registry:
        raise ValueError(f"unknown strategy {name!r}; known: {', '.join(names())}")
    known = {f.name for f in fields(_registry[name])}
    return _registry[name](**{k: v for k, v in params.items() if k in known and v is not None})


def explain(name: str) -> dict[str, object]:
    return {"name": name, "description": (_registry[name].__doc__ or "").strip(), "defaults": asdict(_registry[name]())}


for _name, _factory in (("dividend-low-vol", DividendLowVol), ("value-low-vol", ValueLowVol), ("momentum-reversal", MomentumReversal), ("volume-price-breakout", VolumePriceBreakout)):
    register(_name, _factory)


def with_names(signals: DataFrame, stock_basic: DataFrame, order: str | None = None) -> DataFrame:
    """Signals with the last name of each ts_code, blank ones aside: last by the column ``order``, or in the order of the table's rows."""
    place = F.col(order) if order else F.monotonically_increasing_id()
    named = stock_basic.select("ts_code", "name", place.alias("_at")).where(F.trim("name") != "").groupBy("ts_code").agg(F.max_by("name", "_at").alias("name"))
    return signals.join(named, "ts_code", "left")
