"""Scalar expressions of the market model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def require(df: DataFrame, columns: list[str], table: str) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"{table} lacks {', '.join(missing)}")


def date_text(c: Column) -> Column:
    return F.lpad(F.regexp_replace(c.cast("string"), r"\.0$", ""), 8, "0")


def number(c: str) -> Column:
    return F.expr(f"try_cast({c} as double)")


def active(date: Column, prefix: str = "") -> Column:
    """Listed on a date, by the list status of today."""
    c = lambda n: F.col(prefix + n)
    return (c("list_status") == "L") & (c("list_date").isNull() | (date_text(c("list_date")) <= date)) & (c("delist_date").isNull() | (date_text(c("delist_date")) >= date))


def active_universe(stock_basic: DataFrame, dates: DataFrame) -> DataFrame:
    """(trade_date, ts_code) of all listed instruments on each date.

    The dates, a short calendar, are one sorted array from a scalar subquery; each instrument takes the part of it
    that lies within its listing. No join by ranges.
    """
    days = dates.agg(F.array_sort(F.collect_set("trade_date"))).scalar()
    low, high = F.coalesce(date_text(F.col("list_date")), F.lit("")), F.coalesce(date_text(F.col("delist_date")), F.lit("~"))
    listed = stock_basic.where("list_status = 'L'").select("ts_code", low.alias("_from"), high.alias("_to")).withColumn("_days", days)
    before = F.size(F.filter("_days", lambda d: d < F.col("_from")))
    upto = F.size(F.filter("_days", lambda d: d <= F.col("_to")))
    part = F.slice("_days", before + 1, F.greatest(upto - before, F.lit(0)))
    return listed.select("ts_code", F.explode(part).alias("trade_date")).select("trade_date", "ts_code")


def open_gap(opened: str = "open", before: str = "pre_close") -> Column:
    return F.when(F.col(before) > 0, (F.col(opened) / F.col(before) - 1) * 100)


def limit_flags(df: DataFrame, buffer: float = 0.01) -> DataFrame:
    """limit_up: buying at the open is blocked; limit_down: selling is."""
    limit = F.when(F.col("ts_code").startswith("30") | F.col("ts_code").startswith("68"), 20.0).otherwise(10.0)
    gap = F.coalesce(open_gap(), F.col("pct_chg"))
    return df.withColumns({"limit_up": F.coalesce(gap >= limit - buffer, F.lit(False)), "limit_down": F.coalesce(gap <= -limit + buffer, F.lit(False))})


def suspended_flag(bars: DataFrame, suspend_d: DataFrame) -> DataFrame:
    off = suspend_d.where("suspend_type = 'S'").select("ts_code", "trade_date").distinct().withColumn("_off", F.lit(True))
    return bars.join(off, ["ts_code", "trade_date"], "left").withColumn("suspended", F.coalesce("_off", F.lit(False))).drop("_off")


def tags(*pairs: tuple[Column, str]) -> Column:
    """The names of the conditions that hold, joined by a slash."""
    return F.concat_ws("/", *(F.when(c, F.lit(t)) for c, t in pairs))


def points(*pairs: tuple[Column, int]) -> Column:
    return sum((F.when(c, n).otherwise(0) for c, n in pairs), F.lit(0))
