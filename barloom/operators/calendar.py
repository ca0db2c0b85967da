"""Trading calendars and rebalance dates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def open_dates(trade_cal: DataFrame, daily: DataFrame | None = None, start: str = "", end: str = "99999999") -> DataFrame:
    """Open days of any exchange; days with bars where there is no calendar."""
    days = trade_cal.where("is_open = 1").select(F.col("cal_date").alias("trade_date")).distinct()
    if daily is not None and trade_cal.isEmpty():
        days = daily.select("trade_date").distinct()
    return days.where(F.col("trade_date").between(start, end))


def iso_week(date: Column) -> Column:
    d = F.to_date(date, "yyyyMMdd")
    return F.expr("0") + F.extract(F.lit("YEAROFWEEK"), d) * 100 + F.weekofyear(d)


def period(frequency: str) -> Column:
    d = F.col("trade_date")
    if frequency == "monthly":
        return F.substring(d, 1, 6)
    if frequency == "weekly":
        return iso_week(d).cast("string")
    if frequency == "daily":
        return d
    raise ValueError(f"unknown frequency {frequency!r}")


def rebalance_dates(dates: DataFrame, frequency: str) -> DataFrame:
    """The last date of each period; the final date of all is no candidate."""
    last = dates.agg(F.max("trade_date").alias("_last"))
    return dates.join(last, F.col("trade_date") < F.col("_last")).groupBy(period(frequency).alias("_p")).agg(F.max("trade_date").alias("trade_date")).select("trade_date")


def numbered(dates: DataFrame) -> DataFrame:
    """Dates with their position and predecessor: a calendar is short (days, not rows), so one window over it is small."""
    w = Window.orderBy("trade_date")
    return dates.select("trade_date", (F.row_number().over(w) - 1).alias("pos"), F.lag("trade_date").over(w).alias("prev_date"), F.lead("trade_date").over(w).alias("next_date"))


def latest_open(trade_cal: DataFrame, today: str) -> str | None:
    return trade_cal.where((F.col("is_open") == 1) & (F.col("cal_date") <= today)).agg(F.max("cal_date")).first()[0]


def last_open_days(trade_cal: DataFrame) -> DataFrame:
    """Each calendar day with the latest open day on or before it (a window over the calendar, which is short)."""
    days = trade_cal.groupBy("cal_date").agg(F.max("is_open").alias("is_open"))
    upto = Window.orderBy("cal_date").rowsBetween(Window.unboundedPreceding, 0)
    return days.select("cal_date", F.last(F.when(F.col("is_open") == 1, F.col("cal_date")), ignorenulls=True).over(upto).alias("open_date"))


def years_before(date: Column, years: int) -> Column:
    """The same day years ago; Feb 29 becomes Feb 28."""
    return F.date_format(F.add_months(F.to_date(date, "yyyyMMdd"), -12 * years), "yyyyMMdd")


def history_start(date: str, window: int) -> str:
    """Where to begin loading so that ``window`` bars before the date are there: max(3 w, w + 30) calendar days."""
    import datetime

    days = max(3 * window, window + 30)
    return (datetime.datetime.strptime(date, "%Y%m%d") - datetime.timedelta(days=days)).strftime("%Y%m%d")
