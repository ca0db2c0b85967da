"""Centroid clustering with a vantage-point tree over the centroids.

Each round builds the tree of the current centroids on the driver (there are k of them), broadcasts it, and
assigns every vector by a best-first branch-and-bound of its own: of the nodes that it hasn't entered, a
vector enters the one with the smallest lower bound, until that bound exceeds the radius of its best
centroid so far. A bound equal to the radius is still entered, so centroids as near as the best one are all
met and the smallest number wins. Distances to vantage points and in leaves are exact integers; only bounds
use floating point, with a margin. Vectors of a batch walk together: those that enter the same node at the
same step are measured in one array operation. Tasks return sums and counts by centroid; the new centroids
are exact floors of the mean.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .shared import written

SMALL = 1 << 27  # magnitude below which squared distances of up to 128 components fit 64 bits
LARGEST = 1 << 60
MARGIN = 1e-9  # relative, far above the rounding of a square root
CELLS = 1 << 22  # of the matrix of bounds


@dataclass
class Node:
    """A vantage centroid with two children, each with the range of its distances from the vantage; or a leaf of centroids."""

    numbers: list[int]
    children: list[tuple[int, float, float]] = field(default_factory=list)


def vantage_tree(centroids: list[list[int]], leaf: int = 4) -> list[Node]:
    """Nodes, the root first. The vantage is the set's smallest number; the others are halved by their distance from it."""
    nodes: list[Node] = []

    def build(numbers: list[int]) -> int:
        at = len(nodes)
        nodes.append(Node(numbers))
        if len(numbers) <= leaf:
            return at
        vantage, *rest = numbers
        away = {i: float(sum((a - b) ** 2 for a, b in zip(centroids[vantage], centroids[i]))) ** 0.5 for i in rest}
        rest.sort(key=lambda i: (away[i], i))
        nodes[at].numbers = [vantage]
        for part in (rest[: (len(rest) + 1) // 2], rest[(len(rest) + 1) // 2 :]):
            if part:
                low, high = away[part[0]], away[part[-1]]
                nodes[at].children.append((build(sorted(part)), low, high))
        return at

    if centroids:
        build(list(range(len(centroids))))
    return nodes


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows to one point; both of 64-bit integers, or of Python's."""
    d = x - c
    return np.einsum("ij,ij->i", d, d) if d.dtype == np.int64 else (d * d).sum(axis=1)


def nearest(x: np.ndarray, centroids: np.ndarray, nodes: list[Node]) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each row (ties: the smallest number) and its squared distance."""
    rows = max(1, CELLS // max(1, len(nodes)))
    parts = [walk(x[i : i + rows], centroids, nodes) for i in range(0, len(x), rows)]
    return tuple(np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, np.int64) for i in (0, 1))


def walk(x: np.ndarray, centroids: np.ndarray, nodes: list[Node]) -> tuple[np.ndarray, np.ndarray]:
    if x.size and max(int(abs(x).max()), int(abs(centroids).max())) >= SMALL:
        x, centroids = x.astype(object), centroids.astype(object)
    who, best = np.full(len(x), -1, np.int64), np.zeros(len(x), x.dtype)
    radius = np.full(len(x), np.inf)
    bound = np.full((len(x), len(nodes)), np.inf)
    bound[:, 0] = 0
    live = np.arange(len(x))
    while len(live):
        enter = bound[live].argmin(axis=1)
        low = bound[live, enter]
        go = (low < np.inf) & (low <= radius[live] * (1 + MARGIN))  # inclusive: ties have to be met
        live, enter, low = live[go], enter[go], low[go]
        for at in np.unique(enter).tolist():
            mine = live[enter == at]
            bound[mine, at] = np.inf
            for number in nodes[at].numbers:
                d = squared(x[mine], centroids[number])
                better = (who[mine] < 0) | (d < best[mine]) | (d == best[mine]) & (number < who[mine])
                rows = mine[better]
                who[rows], best[rows] = number, d[better]
                radius[rows] = np.sqrt(d[better].astype(float))
            away = np.sqrt(d.astype(float)) if nodes[at].children else None
            for child, near, far in nodes[at].children:
                gap = np.maximum(near - away, away - far) * (1 - MARGIN) - MARGIN * away
                bound[mine, child] = np.maximum(np.maximum(low[enter == at], gap), 0)
    return who, best


def quantised(vectors: pa.Array, dims: int, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Which vectors take part (``dims`` components, all there and finite), and floor(scale * x) of those."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    sizes = np.array(vectors.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False), np.int64)
    rows = np.flatnonzero(sizes == dims)
    flat = vectors.take(pa.array(rows)).flatten().cast(pa.float64()).fill_null(np.nan)
    x = flat.to_numpy(zero_copy_only=False).reshape(len(rows), dims)
    there = np.isfinite(x).all(axis=1)
    rows, x = rows[there], np.floor(x[there] * scale)
    if x.size and not abs(x).max() < LARGEST:
        raise OverflowError("a component is so large that distances don't fit a long")
    return rows, x.astype(np.int64)


def first_centroids(vectors: DataFrame, k: int, dims: int, scale: int, seed: int) -> list[list[int]]:
    """The k vectors that take part with the smallest hashes of seed and vec_id; repeated ids in order of their components."""
    x = F.transform("vector", lambda v: v.cast("double"))
    usable = (F.size("vector") == dims) & ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    drawn = vectors.where(usable).select(x.alias("x"), F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit("null"))), 256).alias("h"))
    rows = drawn.orderBy("h", "x").limit(k).collect()
    return [[int(np.floor(v * scale)) for v in r.x] for r in rows]


def cluster_vectors(vectors: DataFrame, *, k: int = 16, rounds: int = 3, dims: int = 64, scale: int = 64, seed: int = 1) -> DataFrame:
    """Clusters the vectors that have exactly ``dims`` components, none null or not finite.

    vectors: vec_id, vector (array of numbers). Components become floor(scale * x), in double precision. Gives a
    row for each vector that takes part: vec_id, cluster (from 0), distance (squared), cluster_inertia and inertia
    (distances summed over its cluster and over all), centroid_sha256 (of its final centroid's components in
    decimal, joined by commas). The first centroids are the k vectors with the smallest sha256 of
    "seed:vec_id"; each of the rounds assigns every vector and moves each centroid to the exact floor of its
    vectors' mean; a centroid without vectors stays. Ties go to the smaller number.

    Null vectors and those of other sizes take no part. A null vec_id counts as "null" and is kept; repeated rows
    each count and each give a row. Fewer vectors than k make fewer clusters; without any there are no rows. Other
    columns aren't returned. A distance or a sum that doesn't fit a long raises an error.

    What the driver holds is k centroids and k * dims sums; the tree is broadcast with k * dims numbers.
    """
    spark = vectors.sparkSession
    vectors = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "vector")
    centroids = first_centroids(vectors, k, dims, scale, seed)

    def assignment(step):
        """step(rows, numbers of their clusters, distances, quantised vectors) for each batch, with the current tree."""
        shared = spark.sparkContext.broadcast((centroids, vantage_tree(centroids)))

        def run(batches):
            held, nodes = shared.value
            points = np.array(held, np.int64).reshape(-1, dims)
            yield from step((batch, *assigned(batch, points, nodes)) for batch in batches)

        def assigned(batch, points, nodes):
            rows, x = quantised(batch.column(1), dims, scale)
            return rows, x, *nearest(x, points, nodes)

        return run, shared

    def sums(found):
        """Each cluster's count and sums over a task's vectors, in decimal."""
        count, total = np.zeros(len(centroids), object), np.zeros((len(centroids), dims), object)
        for _, _, x, cluster, _ in found:
            for c in np.unique(cluster).tolist():
                mine = x[cluster == c]
                exact = mine if abs(mine).max() < SMALL else mine.astype(object)  # a batch has fewer than 2**35 rows
                count[c] += len(mine)
                total[c] += exact.sum(axis=0).astype(object)
        used = [c for c in range(len(centroids)) if count[c]]
        cols = [pa.array(used, pa.int32()), pa.array([int(count[c]) for c in used], pa.int64()), pa.array([[str(v) for v in total[c]] for c in used], pa.list_(pa.string()))]
        yield pa.RecordBatch.from_arrays(cols, ["cluster", "n", "sums"])

    for _ in range(rounds if centroids else 0):
        run, shared = assignment(sums)
        parts = vectors.mapInArrow(run, "cluster int, n long, sums array<string>")
        parts = parts.select("cluster", "n", F.posexplode("sums").alias("at", "s")).groupBy("cluster", "at")
        moved = parts.agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()  # k * dims rows
        centroids = [list(c) for c in centroids]
        for r in moved:
            centroids[r["cluster"]][r["at"]] = int(r["s"]) // r["n"]
        shared.destroy()

    def rows_of(found):
        for batch, rows, _, cluster, distance in found:
            if len(distance) and int(distance.max()) >= 1 << 63:
                raise OverflowError("a squared distance doesn't fit a long")
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows)), pa.array(cluster.astype(np.int32)), pa.array(distance.astype(np.int64))], ["vec_id", "cluster", "distance"]
            )

    run, shared = assignment(rows_of)
    done = written(vectors.mapInArrow(run, "vec_id long, cluster int, distance long"), "clusters")
    shared.destroy()
    inertia = {r["cluster"]: int(r["s"]) for r in done.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}  # k rows
    whole = sum(inertia.values())
    digests = [(c, own, whole, hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()) for c, own in sorted(inertia.items())]
    facts = spark.createDataFrame(digests, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return done.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
