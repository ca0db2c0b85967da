"""The stored indicator table: rows that are written once, in batches, and a state for each instrument.

``tech_raw/batch=N`` holds the rows of one update at unadjusted scale; ``tech_state`` names for each instrument the
batches that count and the last factor. The table tech_indicator is a view of both. An update writes its batch first
and swaps the states in last: one that breaks off leaves the old states, and the next writes the same batch again.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, functions as F

from ..operators.resume import INDICATORS, RAW, STATE, adjusted_view, products, resume, rows_and_states
from .tables import VIEWS, Store

MARKS = "first_batch long, batch long"


def states_of(store: Store) -> DataFrame:
    path = store.path("tech_state")
    if not store.exists("tech_state"):
        return store.spark.createDataFrame([], f"{STATE}, {MARKS}")
    return store.spark.read.schema(f"{STATE}, {MARKS}").parquet(path)


def changed(bars: DataFrame, states: DataFrame) -> DataFrame:
    """Instruments (ts_code) whose bars up to their state's date aren't as many as the state has seen: history came late or went."""
    known = states.select("ts_code", "last_date", "n")
    seen = bars.select("ts_code", "trade_date").join(known, "ts_code").where(F.col("trade_date") <= F.col("last_date")).groupBy("ts_code").agg(F.count(F.lit(1)).alias("seen"))
    return known.join(seen, "ts_code", "left").where(F.coalesce("seen", F.lit(0)) != F.col("n")).select("ts_code")


def update_indicators(store: Store, full: bool = False) -> int:
    """Folds the bars behind each instrument's state, or all bars where there is none; returns the rows written.

    Instruments whose earlier bars changed in number are folded anew over their whole history, all of them with ``full``.
    """
    spark, states = store.spark, states_of(store)
    bars = products(store.load("daily"), store.load("adj_factor"))
    number = (states.agg(F.max("batch")).first()[0] or 0) + 1
    if full:
        held = states.where(F.lit(False))
    else:
        anew = changed(bars, states).withColumn("anew", F.lit(True))
        bars = bars.join(states.select("ts_code", "last_date"), "ts_code", "left").join(anew, "ts_code", "left")
        bars = bars.where(F.col("anew") | F.col("last_date").isNull() | (F.col("trade_date") > F.col("last_date"))).drop("anew", "last_date")
        held = states.join(anew, "ts_code", "left_anti")
    names = [c.split()[0] for c in STATE.split(", ")]
    staged = f"{store.root}/staged-tech-{uuid.uuid4().hex}"
    resume(bars, held.select(names)).write.parquet(staged)
    rows, after = rows_and_states(spark.read.schema(f"{RAW}, {STATE.split(', ', 1)[1]}").parquet(staged))
    rows = rows.where(F.coalesce(*INDICATORS).isNotNull())
    rows.write.mode("overwrite").parquet(f"{store.path('tech_raw')}/batch={number}")
    kept = held.select("ts_code", "first_batch")
    after = after.join(kept, "ts_code", "left").withColumns({"first_batch": F.coalesce("first_batch", F.lit(number)), "batch": F.lit(number).cast("long")})
    written = spark.read.schema(RAW).parquet(f"{store.path('tech_raw')}/batch={number}").count()
    store.save("tech_state", after, "replace")
    store.delete(staged)
    return written


def indicator_view(store: Store) -> DataFrame:
    """tech_indicator as it stands after the last update."""
    states = states_of(store)
    rows = store.spark.read.schema(f"{RAW}, batch long").parquet(store.path("tech_raw"))
    rows = rows.join(states.select("ts_code", "first_batch", F.col("batch").alias("last_batch")), "ts_code").where(F.col("batch").between(F.col("first_batch"), F.col("last_batch")))
    return adjusted_view(rows, states)


VIEWS["tech_indicator"] = ("tech_state", indicator_view, ("tech_raw", "tech_state"))
