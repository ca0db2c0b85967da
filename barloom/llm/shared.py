"""What several operators of this subpackage use: the shared folder, written tables, components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; one of our own only where it is unset."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
    return spark.sparkContext.getCheckpointDir()


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: cuts the lineage and survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def gathered(df: DataFrame, *by: str) -> DataFrame:
    """``df`` dealt anew by the columns ``by``, for tables much smaller than what they are made from.

    Adaptive execution joins small partitions and splits large ones, so few tasks write files of a useful size. Without
    native libraries Hadoop's local file system starts processes (chmod) for each file that an executor writes; one that
    is just being started shows the executor's whole memory as its own.
    """
    return df.hint("rebalance", *by)


def fresh(df: DataFrame, wanted: str) -> str:
    """A column name starting with ``wanted`` that ``df`` has not (letter case aside)."""
    have = {c.lower() for c in df.columns}
    while wanted.lower() in have:
        wanted += "_"
    return wanted


def components(edges: DataFrame) -> DataFrame:
    """Connected components of undirected ``edges`` (a long, b long): rows (id, component_id).

    component_id is the smallest id of the component; only ids with an edge to another id appear.
    Alternating large-star and small-star steps, written to the shared folder, until the
    edge set stops changing; nothing but two checksums comes to the driver each time.
    """
    live = written(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges"
    )
    seen = None
    while True:
        now = live.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen or not now[0]:
            return live.select(F.col("a").alias("id"), F.col("b").alias("component_id")).unionByName(
                live.select(F.col("b").alias("id"), F.col("b").alias("component_id")).distinct()
            )
        seen, live = now, written(star_round(live), "edges")


def star_round(edges: DataFrame) -> DataFrame:
    """A large-star and a small-star step over edges with a > b."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
    large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
    low = large.groupBy("a").agg(F.min("b").alias("m"))
    moved = F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))
    small = large.join(low, "a").select(F.explode(F.when(F.col("b") == F.col("m"), F.slice(moved, 1, 1)).otherwise(moved)).alias("e"))
    return small.select("e.a", "e.b").distinct()


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def frequent(df: DataFrame, count: str, most: int, size: Column | None = None, most_size: int = 0) -> DataFrame:
    """The rows with the largest counts, ``most`` at the most: all whose count reaches a threshold.

    With ``size``, a row's size, they have ``most_size`` together at the most as well. The threshold comes from a
    histogram of sixteenths of octaves (a thousand rows at most), so nothing is sorted and no task gathers the rows.
    """
    step = F.floor(F.log2(F.col(count).cast("double")) * 16).cast("int")
    steps = df.groupBy(step.alias("b")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.lit(0) if size is None else size).alias("size"))
    total = total_size = 0
    least = None
    for bucket, n, many in sorted(steps.collect(), reverse=True):
        total, total_size = total + n, total_size + many
        if total > most or total_size > most_size:
            break
        least = bucket
    return df.where(F.lit(False) if least is None else step >= least)
