"""Exact top-k search by integer inner product, block at a time.

The candidates are cut into blocks by ranges of their id. A block keeps each term's maximum (and
minimum, for negative query weights) and a forward index of its vectors. The sum of a query's weighted term
maxima bounds its scores in a block. First each query scores the one block with its highest bound, which gives a
k-th score to start from. Then chunks of queries name the blocks whose bounds reach that score for any of them;
up to here they met the blocks' maxima only. Those blocks alone are sent to the chunk, in groups; a query goes
through them in the order of their bounds and stops where one falls below the k-th score so far. A ranking
window merges the k rows per query and group.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from .shared import written

SUMMARIES = 1024  # blocks whose maxima a task holds


def quantised(vectors: DataFrame, scale: int) -> DataFrame:
    """id and whole components floor(scale * x) as doubles, which hold those beyond a long too; rows that can't take part are left out."""
    scaled = lambda v: F.lit(float(scale)) * v.cast("double")
    x = F.transform("vector", lambda v: F.when(F.abs(scaled(v)) < 2.0**53, F.floor(scaled(v)).cast("double")).otherwise(scaled(v)))
    usable = (
        F.col("id").isNotNull() & F.col("vector").isNotNull() & (F.size("vector") > 0)
        & F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) < float("inf")))
    )
    return vectors.where(usable).select("id", x.alias("x"), F.size("vector").alias("dim"))


def products(x: np.ndarray, q: np.ndarray, largest: float) -> np.ndarray:
    """The exact inner products of rows and a query; as Python integers where a long may be too small."""
    if largest < 2.0**53:
        return (x @ q).astype(np.int64)
    if largest < 2.0**62:
        return x.astype(np.int64) @ q.astype(np.int64)
    whole = np.vectorize(int, otypes=[object])
    return whole(x) @ whole(q)


def pack_blocks(batches, block: int):
    """Rows sorted by length and id -> blocks of ``block`` rows of one length at the most."""
    number, rest = TaskContext.get().partitionId() << 32, None
    for batch in chain(batches, [None]):
        parts = [*([] if rest is None else [rest]), *([] if batch is None else [pa.Table.from_batches([batch])])]
        if not parts:
            return
        table = pa.concat_tables(parts)
        dims = table["dim"].to_numpy()
        runs = np.r_[0, np.flatnonzero(np.diff(dims)) + 1, len(dims)]
        cuts = [*chain.from_iterable(range(i, j, block) for i, j in zip(runs[:-1].tolist(), runs[1:].tolist())), len(dims)]
        whole = cuts if batch is None else cuts[:-1]  # the last one may go on
        out = []
        for i, j in zip(whole[:-1], whole[1:]):
            part = table.slice(i, j - i).combine_chunks()
            x = part["x"].combine_chunks().flatten().to_numpy().reshape(j - i, -1)
            out.append((int(dims[i]), number, part["id"].to_numpy().tobytes(), x.tobytes(), x.max(axis=0).tobytes(), x.min(axis=0).tobytes()))
            number += 1
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out) if out else [[]] * 6, BLOCK_KINDS)], BLOCK_NAMES)
        rest = table.slice(cuts[-2] if len(cuts) > 1 else 0)


BLOCK_NAMES = ["dim", "block", "ids", "x", "high", "low"]
BLOCK_KINDS = [pa.int32(), pa.int64(), *[pa.binary()] * 4]


def bounds(q: np.ndarray, blocks: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """What no score of a query in a block exceeds, and what no magnitude of a sum exceeds: queries by blocks."""
    high, low = (np.stack([np.frombuffer(v) for v in blocks[c]]) for c in ("high", "low"))
    dim = q.shape[1]
    with np.errstate(over="ignore", invalid="ignore"):
        largest = np.outer(np.abs(q).max(axis=1), np.maximum(np.abs(high), np.abs(low)).max(axis=1)) * dim
        most = np.maximum(q, 0) @ high.T + np.minimum(q, 0) @ low.T
        most = most + np.where(largest < 2.0**53, 0, largest * dim * 2.0**-50)  # what rounding takes
    return np.nan_to_num(most, nan=np.inf, posinf=np.inf), largest


def matrix(vectors: pd.Series) -> np.ndarray:
    return np.stack(vectors.to_numpy()).astype(np.float64)


def best_block(queries: pd.DataFrame, blocks: pd.DataFrame) -> pd.DataFrame:
    """Each query's block of the highest bound among these."""
    if not len(queries) or not len(blocks):
        return pd.DataFrame({"id": [], "part": [], "block": [], "bound": []})
    most, _ = bounds(matrix(queries["x"]), blocks)
    at = most.argmax(axis=1)
    return pd.DataFrame({"id": queries["id"], "part": queries["part"], "block": blocks["block"].to_numpy()[at], "bound": most.max(axis=1)})


def first_floor(queries: pd.DataFrame, blocks: pd.DataFrame, k: int) -> pd.DataFrame:
    """A double that each query's k-th best score is not below, from one block; -infinity where that has less than k."""
    floors = np.full(len(queries), -np.inf)
    if len(queries) and len(blocks):
        q, row = matrix(queries["x"]), blocks.iloc[0]
        x, ids = np.frombuffer(row["x"]).reshape(-1, q.shape[1]), np.frombuffer(row["ids"], np.int64)
        _, largest = bounds(q, blocks.iloc[:1])
        for i, own in enumerate(queries["id"].to_numpy(np.int64)):
            score = np.sort(products(x, q[i], largest[i, 0])[ids != own])
            if len(score) >= k:
                kth = int(score[-k])
                floors[i] = float(kth) if abs(kth) < 1 << 53 else float(kth - (abs(kth) >> 50))
    return pd.DataFrame({"id": queries["id"], "floor": floors})


def needed_blocks(queries: pd.DataFrame, blocks: pd.DataFrame) -> pd.DataFrame:
    """The blocks that may hold one of the k best of any of these queries."""
    if not len(queries) or not len(blocks):
        return pd.DataFrame({"part": [], "block": []})
    most, _ = bounds(matrix(queries["x"]), blocks)
    names = blocks["block"].to_numpy()[(most >= queries["floor"].to_numpy()[:, None]).any(axis=0)]
    return pd.DataFrame({"part": np.full(len(names), queries["part"].iloc[0]), "block": names})


def search_blocks(queries: pd.DataFrame, blocks: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k best candidates for each query among these blocks, without those below the query's floor."""
    out = {"query_id": [], "id": [], "score": []}
    if len(queries) and len(blocks):
        q = matrix(queries["x"])
        most, largest = bounds(q, blocks)
        xs = [np.frombuffer(v).reshape(-1, q.shape[1]) for v in blocks["x"]]
        ids = [np.frombuffer(v, np.int64) for v in blocks["ids"]]
        for i, (own, floor) in enumerate(zip(queries["id"].to_numpy(np.int64), queries["floor"].to_numpy())):
            best_id, best, kth = np.zeros(0, np.int64), np.zeros(0, np.int64), floor
            for b in np.argsort(-most[i], kind="stable"):
                if most[i, b] < kth:
                    break
                score = products(xs[b], q[i], largest[i, b])
                keep = (ids[b] != own) & (score >= kth)
                best_id, best = np.r_[best_id, ids[b][keep]], np.r_[best, score[keep]]
                top = np.argsort(best_id, kind="stable")
                top = top[np.argsort(-best[top], kind="stable")][:k]
                best_id, best = best_id[top], best[top]
                kth = best[-1] if len(best) == k else floor
            out["query_id"].append(np.full(len(best), own))
            out["id"].append(best_id)
            out["score"].append(best.astype(np.int64))
    return pd.DataFrame({n: np.concatenate([np.zeros(0, np.int64), *v]) for n, v in out.items()})


def exact_top_k(
    vectors: DataFrame, queries: DataFrame, *, k: int = 10, scale: int = 1024, block: int = 1024, group: int = 32, chunk: int = 4096
) -> DataFrame:
    """Each query's k best candidates by the inner product of components floor(scale * x).

    vectors, queries: (id long, vector array). Gives query_id, rank (from 1), id, score; ties go to
    the smaller id, then repeat in arbitrary but complete order for repeated rows. A candidate with the query's own id isn't
    a candidate; of queries that repeat an id the smallest vector counts. Vectors that are null or
    empty or hold null, NaN or infinite components, and rows without id take no part; vectors meet those
    of their own length only. A score among the k best that doesn't fit a long raises an error. Empty tables give no rows.

    A task holds ``chunk`` queries and ``group`` blocks of ``block`` rows, however often an id repeats.
    """
    rows = quantised(vectors, scale)
    rows = rows.repartitionByRange("dim", "id", F.xxhash64("x")).sortWithinPartitions("dim", "id").select("dim", "id", "x")
    blocks = written(rows.mapInArrow(lambda b: pack_blocks(b, block), "dim int, block long, ids binary, x binary, high binary, low binary"), "blocks")
    asked = quantised(queries, scale).groupBy("id").agg(F.min("x").alias("x"))
    n = max(1, -(-asked.count() // chunk))
    asked = written(asked.select("id", "x", F.size("x").alias("dim"), F.pmod(F.xxhash64("id"), F.lit(n)).cast("int").alias("part")), "queries")
    total = blocks.count()
    halls, groups = max(1, -(-total // SUMMARIES)), max(1, -(-total // group))
    of = lambda count: F.pmod(F.xxhash64("block"), F.lit(count)).cast("int")
    every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    summaries = blocks.select("dim", "block", "high", "low", of(halls).alias("hall"), every(n).alias("part")).groupBy("hall", "part", "dim")

    met = asked.withColumn("hall", every(halls)).groupBy("hall", "part", "dim").cogroup(summaries)
    best = met.applyInPandas(best_block, "id long, part int, block long, bound double")
    best = written(best.groupBy("id", "part").agg(F.max_by("block", F.struct("bound", "block")).alias("block")), "best-blocks")
    seeds = blocks.select("dim", "block", "ids", "x", "high", "low").join(best.select("block", "part").distinct(), "block")
    seeded = asked.join(best, ["id", "part"]).groupBy("block", "part", "dim").cogroup(seeds.groupBy("block", "part", "dim"))
    asked = written(asked.join(seeded.applyInPandas(lambda a, b: first_floor(a, b, k), "id long, floor double"), "id"), "queries")

    met = asked.withColumn("hall", every(halls)).groupBy("hall", "part", "dim").cogroup(summaries)
    needed = written(met.applyInPandas(needed_blocks, "part int, block long").withColumn("grp", of(groups)), "needed-blocks")
    found = (
        asked.join(needed.select("part", F.col("grp").alias("grp")).distinct(), "part").groupBy("grp", "part", "dim")
        .cogroup(blocks.join(needed, "block").groupBy("grp", "part", "dim"))
        .applyInPandas(lambda a, b: search_blocks(a, b, k), "query_id long, id long, score long")
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")
