"""Cross-sections: ranks, scaling, selection and capped weights within a date."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

DATE = "trade_date"


def finite(c: str) -> Column:
    return F.when(~F.isnan(c) & (F.abs(F.col(c)) < float("inf")), F.col(c))


def percentile_rank(c: str, high_is_good: bool = True, date: str = DATE) -> Column:
    """Mean rank of ties over the number of values; 0 for null and infinite values."""
    v = finite(c)
    w = Window.partitionBy(date).orderBy(v.asc_nulls_last() if high_is_good else v.desc_nulls_last())
    ties = F.count(v).over(Window.partitionBy(date, v))
    return F.when(v.isNotNull(), (F.rank().over(w) + (ties - 1) / 2) / F.count(v).over(Window.partitionBy(date))).otherwise(0.0)


def minmax(c: str, date: str = DATE) -> Column:
    """(x - min) / (max - min); 0 where all are equal or x is null."""
    v, w = finite(c), Window.partitionBy(date)
    low, high = F.min(v).over(w), F.max(v).over(w)
    return F.coalesce(F.when(high > low, (v - low) / (high - low)), F.lit(0.0))


def top_n(df: DataFrame, score: str, n: int, date: str = DATE) -> DataFrame:
    if n <= 0:
        return df.withColumn("place", F.lit(0)).where(F.lit(False))
    order = Window.partitionBy(date).orderBy(F.desc_nulls_last(score), "ts_code")
    return df.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n)


def score_weights(df: DataFrame, score: str, date: str = DATE) -> DataFrame:
    """Weights in proportion to positive scores, equal ones where no score is positive."""
    w = Window.partitionBy(date)
    part = F.greatest(F.col(score), F.lit(0.0))
    total = F.sum(part).over(w)
    return df.withColumn("weight", F.when(total > 0, part / total).otherwise(1 / F.count(F.lit(1)).over(w)))


def capped(df: DataFrame, cap: float | None, date: str = DATE) -> DataFrame:
    """Weights pinned at ``cap`` (none, 0 or less: no cap); the rest shares what remains in proportion.

    In order of weight, the pinned ones are the shortest prefix k after which the largest other weight,
    scaled to what remains, fits under the cap, so two running windows replace the usual loop.
    """
    if cap is None or cap <= 0:
        return df
    order = Window.partitionBy(date).orderBy(F.desc("weight"), "ts_code")
    tail = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    before = F.row_number().over(order) - 1
    fits = F.try_divide(F.col("weight"), tail) * (1 - before * cap) <= cap + 1e-15
    df = df.withColumns({"_before": before, "_tail": tail}).withColumn("_k", F.min(F.when(fits, F.struct("_before", "_tail"))).over(Window.partitionBy(date)))
    pinned = F.col("_k").isNull() | (F.col("_before") < F.col("_k._before"))
    rest = F.coalesce(F.try_divide(F.col("weight"), F.col("_k._tail")), F.lit(0.0)) * F.greatest(1 - F.col("_k._before") * cap, F.lit(0.0))
    return df.withColumn("weight", F.when(pinned, F.when(F.col("weight") > 0, F.lit(cap)).otherwise(0.0)).otherwise(rest)).drop("_before", "_tail", "_k")


def cleaned(df: DataFrame, date: str | list[str] = DATE) -> DataFrame:
    """Non-negative weights, scaled down where they sum to more than 1; zeros are dropped."""
    w = F.when(~F.isnan("weight"), F.greatest(F.col("weight"), F.lit(0.0)))
    df = df.withColumn("weight", w)
    total = F.sum("weight").over(Window.partitionBy(date))
    return df.withColumn("weight", F.when(total > 1, F.col("weight") / total).otherwise(F.col("weight"))).where("weight > 0")


def target_weights(df: DataFrame, score: str, n: int, cap: float | None = None, date: str = DATE) -> DataFrame:
    return capped(score_weights(top_n(df, score, n, date), score, date), cap, date)
