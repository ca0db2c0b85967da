"""Time-series windows over the bars of one instrument; all are counted in rows, not in days."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

def by_code():
    return Window.partitionBy("ts_code").orderBy("trade_date")


def last_rows(n: int):
    return by_code().rowsBetween(-(n - 1), 0)


def prior_rows(n: int):
    return by_code().rowsBetween(-n, -1)


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


class Rows:
    """What measures read of an instrument's rows, for each row, by windows."""

    def over(self, agg: Callable[[Column], Column], c: str, low: int, high: int) -> Column:
        return agg(F.col(c)).over(by_code().rowsBetween(low, high))

    def back(self, c: str, n: int) -> Column:
        return F.lag(c, n).over(by_code()) if n else F.col(c)

    def place(self) -> Column:
        return F.row_number().over(by_code())


class Steps(Rows):
    """The same for rows on a few dates, as aggregates over what groups() gives: a sliding window begins anew for each row,
    so where few rows are wanted it does most of its work in vain. Looks back only."""

    def __init__(self):
        self.most = 0

    def over(self, agg: Callable[[Column], Column], c: str, low: int, high: int) -> Column:
        self.most = max(self.most, -low)
        return agg(F.when(F.col("_step").between(-high, -low), F.col(c)))

    def back(self, c: str, n: int) -> Column:
        return self.over(F.max, c, -n, -n)

    def place(self) -> Column:
        return self.back("_place", 0)

    def groups(self, bars: DataFrame, dates: DataFrame) -> DataFrame:
        """Rows of bars once for each row of their instrument on one of the dates (_date) that they lie _step rows before, up to
        the most that was asked for. The dates are broadcast: they are at most a row for each day of a calendar."""
        on = F.broadcast(dates.select("trade_date", F.lit(True).alias("_on")).distinct())
        df = bars.join(on, "trade_date", "left").withColumn("_place", F.row_number().over(by_code()))
        mark = F.when(F.col("_on"), F.struct(F.col("_place").alias("place"), F.col("trade_date").alias("date")))
        df = df.withColumn("_marks", F.collect_list(mark).over(by_code().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
        near = F.filter("_marks", lambda x: x["place"].between(F.col("_place"), F.col("_place") + self.most))
        df = df.withColumn("_mark", F.explode(near)).withColumns({"_date": F.col("_mark.date"), "_step": F.col("_mark.place") - F.col("_place")})
        return df.drop("_on", "_marks", "_mark")


ROWS = Rows()


def ratio(a: Column, b: Column) -> Column:
    """a / b - 1, null where b isn't positive."""
    return F.when(b > 0, a / b - 1)


def simple_return(c: Column | str = "adj_close") -> Column:
    return F.try_divide(col(c), F.lag(c).over(by_code())) - 1


def trailing_volatility(ret: str, n: int, rows: Rows = ROWS) -> Column:
    """Population deviation of the last n returns, once there are max(1, min(n, 2))."""
    return F.when(rows.over(F.count, ret, 1 - n, 0) >= max(1, min(n, 2)), rows.over(F.stddev_pop, ret, 1 - n, 0))


def sma(c: str, n: int) -> Column:
    return F.when(F.count(c).over(last_rows(n)) >= n, F.avg(c).over(last_rows(n)))


def bollinger(c: str, n: int = 20, k: float = 2.0) -> tuple[Column, Column, Column]:
    w = last_rows(n)
    full, mid, dev = F.count(c).over(w) >= n, F.avg(c).over(w), F.stddev_pop(c).over(w)
    return F.when(full, mid + k * dev), F.when(full, mid), F.when(full, mid - k * dev)


def true_range(high: str = "high", low: str = "low", close: str = "close") -> Column:
    before = F.lag(close).over(by_code())
    return F.greatest(F.col(high) - F.col(low), F.abs(F.col(high) - before), F.abs(F.col(low) - before))


def momentum(c: str, m: int, r: int, s: int, rows: Rows = ROWS) -> Column:
    return ratio(rows.back(c, r + s), rows.back(c, r + s + m))


def reversal(c: str, r: int, rows: Rows = ROWS) -> Column:
    return ratio(rows.back(c, 0), rows.back(c, r))


def breakout(c: str, b: int, v: int, rows: Rows = ROWS) -> Column:
    """Close over the highest of the b bars before, with more than max(b, v) bars of history."""
    return F.when(rows.place() > max(b, v), ratio(rows.back(c, 0), rows.over(F.max, c, -b, -1)))


def volume_ratio(vol: str, b: int, v: int, rows: Rows = ROWS) -> Column:
    usual = rows.over(F.avg, vol, -v, -1)
    return F.when((rows.place() > max(b, v)) & (usual > 0), rows.back(vol, 0) / usual)


def screen_windows(df: DataFrame) -> DataFrame:
    """Trailing volume means, extremes and history counts of the trend screener."""
    return df.withColumns({
        "vol_ma5": F.avg("vol").over(last_rows(5)), "vol_ma20": F.avg("vol").over(last_rows(20)),
        "high_20": F.max("high").over(last_rows(20)), "low_5": F.min("low").over(last_rows(5)), "n_60": F.count(F.lit(1)).over(last_rows(60)),
    })


def fill_both_ways(c: str) -> Column:
    """Forward fill, then backward fill, within an instrument. Where the first finds nothing, what follows first is the
    first of all, which one pass over the instrument gives."""
    return F.coalesce(carried(c), F.first(c, ignorenulls=True).over(by_code().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))


def carried(c: str) -> Column:
    """The last value on or before each row."""
    return F.last(c, ignorenulls=True).over(by_code().rowsBetween(Window.unboundedPreceding, 0))


def adjusted_prices(daily: DataFrame, factors: DataFrame | None = None) -> DataFrame:
    """Forward-adjusted prices, relative to each instrument's last factor in the frame; done once only. Without a table
    of factors, daily has them beside its bars (adj_factor)."""
    if {"adj_open", "adj_close"} <= set(daily.columns):
        return daily
    if factors is not None:
        daily = daily.join(factors.select("ts_code", "trade_date", "adj_factor"), ["ts_code", "trade_date"], "left")
    df = daily.withColumn("factor", fill_both_ways("adj_factor")).drop("adj_factor")
    last = F.last("factor").over(by_code().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    df = df.withColumn("last_factor", F.when(last != 0, last))
    return df.withColumns({f"adj_{c}": F.col(c) * F.col("factor") / F.col("last_factor") for c in ("open", "high", "low", "close")}).drop("last_factor")


def indicator_prices(daily: DataFrame, factors: DataFrame) -> DataFrame:
    """Adjusted prices for indicators: bars with a factor only, no filling; instruments whose last factor is 0 are left out."""
    df = daily.join(factors.select("ts_code", "trade_date", "adj_factor"), ["ts_code", "trade_date"])
    df = df.withColumn("last_factor", F.last("adj_factor").over(by_code().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).where("last_factor <> 0")
    return df.withColumns({c: F.col(c) * F.col("adj_factor") / F.col("last_factor") for c in ("open", "high", "low", "close")}).drop("last_factor", "adj_factor")


def as_of(left: DataFrame, right: DataFrame, columns: list[str]) -> DataFrame:
    """Each left row with the last right row of its ts_code on or before its trade_date (whole rows, no bound).

    Both sides are tagged and united, and one window carries the last right row forward: one shuffle
    by ts_code, no range join.
    """
    row = F.struct(F.col("trade_date").alias("as_of_date"), *columns)
    both = left.select("*", F.lit(1).alias("_side"), F.lit(None).cast(right.select(row.alias("r")).schema["r"].dataType).alias("_row"))
    tagged = right.select("ts_code", "trade_date", F.lit(0).alias("_side"), row.alias("_row"))
    both = both.unionByName(tagged, allowMissingColumns=True)
    w = Window.partitionBy("ts_code").orderBy("trade_date", "_side").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("_row", F.last("_row", ignorenulls=True).over(w)).where("_side = 1").select(*left.columns, "_row.*")
