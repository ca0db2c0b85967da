"""Embedding near-duplicates: Euclidean p-stable hashing, followed by exact cosine checks.

Normalised vectors are projected on random directions, shifted and quantised to a width; ``k`` such
numbers make a bucket of a table, and ``tables`` tables are kept. Two unit vectors at distance c meet
in one number with p(c) = 1 - 2 N(-w/c) - 2c / (sqrt(2 pi) w) (1 - exp(-w^2 / 2c^2)), so in some table
with 1 - (1 - p**k)**tables: 0.993 at a cosine of 0.98 for the values given below, of which orthogonal vectors
meet in a table with a chance of 5e-7.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .shared import components, fresh, written

TILE = 2048
TILE_KEYS = ["bucket", "t", "one", "two"]


def bucket_keys(x: np.ndarray, k: int, tables: int, width: float, seed: int) -> np.ndarray:
    """A 64-bit bucket for each unit vector (rows of x) and table."""
    rng = np.random.default_rng([seed, x.shape[1]])
    directions = rng.standard_normal((x.shape[1], k * tables))
    cell = np.floor((x @ directions + rng.uniform(0, width, k * tables)) / width).astype(np.int64)
    weights = rng.integers(1, 1 << 62, k * tables, dtype=np.int64) | 1
    return (cell * weights).reshape(len(x), tables, k).sum(axis=2)


def units(column) -> np.ndarray:
    x = np.stack(list(column)).astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def whole_groups(batches, names: list[str]):
    """Tables of whole groups, with each group's first row, from batches of rows sorted by the columns ``names``."""
    rest = None
    for batch in batches:
        table = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
        starts = group_starts(table, names)
        if len(starts) > 1:
            yield table.slice(0, starts[-1]), starts[:-1]
        rest = table.slice(starts[-1] if len(starts) else 0)
    if rest is not None and len(rest):
        yield rest, group_starts(rest, names)


def group_starts(table: pa.Table, names: list[str]) -> np.ndarray:
    changed = np.zeros(max(0, len(table) - 1), bool)
    for name in names:
        column = table[name].to_numpy()
        changed |= column[1:] != column[:-1]
    return np.r_[0, np.flatnonzero(changed) + 1][: len(table)]


def compare_tile(left: tuple, right: tuple | None, table: int, cosine: float) -> list[tuple]:
    """Links between two sides of a tile, or within ``left``: weights of partners for each vector, and edges that join what is linked.

    A side: ids, copies, bucket keys, unit vectors. A pair counts in the first table only where its two vectors meet;
    pairs that have met before aren't compared again.
    """
    ids, copies, a, x = left
    others, other_copies, b, y = right or left
    apart = np.ones((len(ids), len(others)), bool)
    for t in range(table):
        apart &= a[:, None, t] != b[None, :, t]
    if right is None:
        apart = np.triu(apart, 1)
    if apart.mean() > 0.05:
        one, two = np.nonzero(apart & (x @ y.T >= cosine))
    else:
        one, two = np.nonzero(apart)
        hit = np.concatenate([np.zeros(0, bool), *((x[one[i : i + 8192]] * y[two[i : i + 8192]]).sum(axis=1) >= cosine for i in range(0, len(one), 8192))])
        one, two = one[hit], two[hit]
    if not len(one):
        return []
    n, m = np.bincount(one, other_copies[two], len(ids)), np.bincount(two, copies[one], len(others))
    out = [(ids, ids, n.astype(np.int64)), (others, others, m.astype(np.int64))]
    group = np.arange(len(others))
    cuts = np.flatnonzero(np.diff(one)) + 1
    for i, hits in zip(one[np.r_[0, cuts]], np.split(two, cuts)):  # merges each row's partners; edges only between what was apart
        names = np.unique(group[hits])
        out.append((np.full(len(names), ids[i]), others[names], np.zeros(len(names), np.int64)))
        if len(names) > 1:
            group[np.isin(group, names)] = names[0]
    return out


def compare_tiles(batches, cosine: float):
    """Rows of tiles, sorted by tile: those that link, and the links."""
    for table, starts in whole_groups(batches, TILE_KEYS):
        table = table.combine_chunks()
        ids, copies, sub, one, two, t = (table[c].to_numpy() for c in ("id", "copies", "sub", "one", "two", "t"))
        keys, x = table["keys"].combine_chunks(), table["x"].combine_chunks()
        found = [(np.zeros(0, np.int64),) * 3]
        for i, j in zip(starts, [*starts[1:], len(table)]):
            vectors = x.slice(i, j - i).flatten().to_numpy().reshape(j - i, -1)
            vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)
            vectors = vectors / np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))
            side = ids[i:j], copies[i:j], keys.slice(i, j - i).flatten().to_numpy().reshape(j - i, -1), vectors
            if one[i] == two[i]:
                found += compare_tile(side, None, t[i], cosine)
                continue
            first = sub[i:j] == one[i]
            if first.any() and not first.all():
                found += compare_tile(tuple(c[first] for c in side), tuple(c[~first] for c in side), t[i], cosine)
        id_, other, n = (np.concatenate(c) for c in zip(*found))
        keep = (id_ != other) | (n > 0)
        yield pa.RecordBatch.from_arrays([pa.array(c[keep], pa.int64()) for c in (id_, other, n)], ["id", "other", "n"])


def near_duplicate_vectors(
    vectors: DataFrame, *, cosine: float = 0.98, k: int = 20, tables: int = 24, width: float = 2.0, seed: int = 5
) -> DataFrame:
    """Links vectors of one label with a cosine (double precision) of ``cosine`` or more.

    vectors: vec_id, embedding, label; other columns come back unchanged. Adds n_links (other vectors
    linked directly), component_id (smallest vec_id reachable by links) and kept (vec_id is
    component_id). Pairs come from the hash tables, so a share of links may be missed (see above);
    none below the threshold is given. Equal vectors of a label are one class: its members are all
    linked, whatever the tables say.

    A null, empty, all-zero vector or one with null, NaN or infinite components, and a null label:
    n_links 0, component_id = vec_id, kept. Vectors meet those of their own length only. A null vec_id: n_links 0,
    component_id and kept null, no part in links. Rows that repeat a vec_id count as one vector by any of their embeddings, each
    row with the links of all. An empty table gives no rows.
    """
    number = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) < float("inf")))
    usable = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & number & F.exists("embedding", lambda v: v != 0)
    good = vectors.where(usable).select("vec_id", "label", F.transform("embedding", lambda v: v.cast("double")).alias("x"))
    classes = written(
        good.groupBy("label", "x").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("copies")).withColumn("cls", F.xxhash64("label", "x")),
        "vector-classes",
    )
    members = good.select("vec_id", "label", "x").join(classes.where("copies > 1").select("label", "x", "id", "copies"), ["label", "x"]).select("vec_id", "id", "copies")

    def hashed(batches):
        for batch in batches:
            frame = batch.to_pandas()
            for dim, part in frame.groupby(frame["x"].map(len)):
                keys = bucket_keys(units(part["x"]), k, tables, width, seed)
                yield pa.RecordBatch.from_pandas(pd.DataFrame({"id": part["id"].to_numpy(), "cls": part["cls"].to_numpy(), "label": part["label"].to_numpy(), "dim": dim, "keys": list(keys)}), preserve_index=False).select(["id", "cls", "label", "dim", "keys"])

    keys = written(
        classes.select("id", "cls", F.col("label").cast("string").alias("label"), "x").mapInArrow(hashed, "id long, cls long, label string, dim long, keys array<long>"), "vector-keys"
    )
    rows = keys.select("id", "cls", "label", "dim", F.posexplode("keys").alias("t", "key"))
    place = ["label", "dim", "t", "key"]
    sizes = rows.groupBy(*place).agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    rows = written(rows.join(sizes, place).select("id", "cls", F.xxhash64(*place).alias("bucket"), "t", "size"), "vector-buckets")
    parts = F.ceil(F.col("size") / TILE).cast("int")
    tiles = rows.withColumn("sub", F.pmod(F.xxhash64("id", "t"), parts).cast("int")).select(
        "*", F.explode(F.sequence(F.lit(0), parts - 1)).alias("with_sub")
    ).select("id", "cls", "bucket", "t", "sub", F.least("sub", "with_sub").alias("one"), F.greatest("sub", "with_sub").alias("two"))
    payload = classes.select("id", "cls", "x", "copies").join(keys.select("id", "cls", "keys"), ["id", "cls"])
    found = written(
        tiles.join(payload, ["id", "cls"]).select(*TILE_KEYS, "sub", "id", "copies", "keys", "x").repartition(*TILE_KEYS).sortWithinPartitions(*TILE_KEYS)
        .mapInArrow(lambda batches: compare_tiles(batches, cosine), "id long, other long, n long"),
        "vector-links",
    )
    counts = found.groupBy("id").agg(F.sum("n").alias("n"))
    links = found.where("id <> other").select(F.col("id").alias("a"), F.col("other").alias("b"))
    linked = components(links.unionByName(members.where("vec_id <> id").select(F.col("vec_id").alias("a"), F.col("id").alias("b"))))
    per_id = (
        good.select("vec_id").distinct()
        .join(members.groupBy("vec_id").agg(F.min("id").alias("rep"), F.sum(F.col("copies") - 1).alias("same")), "vec_id", "left")
        .withColumn("id", F.coalesce("rep", "vec_id"))
        .join(counts, "id", "left")
        .join(linked.withColumnRenamed("id", "vec_id"), "vec_id", "left")
        .select(F.col("vec_id").alias("key"), (F.coalesce("n", F.lit(0)) + F.coalesce("same", F.lit(0))).alias("links"), F.col("component_id").alias("comp"))
    )
    key = fresh(vectors, "key_of_links")
    per_id = per_id.withColumnRenamed("key", key)
    out = vectors.join(per_id, vectors["vec_id"] == per_id[key], "left")
    comp = F.coalesce(per_id["comp"], vectors["vec_id"])
    names = [fresh(vectors, c) for c in ("n_links", "component_id", "kept")]
    return out.select(
        *(vectors[c] for c in vectors.columns), F.coalesce(per_id["links"], F.lit(0)).alias(names[0]), comp.alias(names[1]), (vectors["vec_id"] == comp).alias(names[2])
    )
