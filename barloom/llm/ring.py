"""Sharding on a consistent-hash ring with virtual nodes and bounded loads, by DataFrame functions only.

The ring has 2**16 cells. A row's cell comes from a hash of its id; each shard owns the cells behind its
virtual nodes. Loads are bounded: the rows of a cell go to the cell's shard as long as it has room; what
overflows continues clockwise to the next virtual node of a shard with room. Only the number of rows of
each cell (65,536 numbers at most, whatever the input) comes to the driver, which lays out the overflow;
a row's place within its cell then tells its shard and slot.
"""

from __future__ import annotations

import bisect
import hashlib
import json

from pyspark.sql import DataFrame, Window, functions as F

from .shared import fresh

CELL_BITS = 16


def nodes(shards: int, virtual: int) -> list[tuple[int, int]]:
    """(cell, shard) of all virtual nodes in ring order."""
    spot = lambda s, v: int(hashlib.sha256(f"{s}/{v}".encode()).hexdigest(), 16) % (1 << CELL_BITS)
    return sorted((spot(s, v), s) for s in range(shards) for v in range(virtual))


def layout(loads: dict[int, int], shards: int, virtual: int, slack: float) -> list[tuple[int, int, int, int, int]]:
    """(cell, first place, past the last place, shard, slot of the first) of each run of rows."""
    total = sum(loads.values())
    if slack:
        room = [-(-int(total * (1 + slack)) // shards)] * shards
    else:
        room = [total // shards + (s < total % shards) for s in range(shards)]
    ring = nodes(shards, virtual)
    spots, ahead = [c for c, _ in ring], list(range(len(ring)))

    def open_from(i: int) -> int:
        """The next node at or after i, clockwise, whose shard has room; passed nodes are skipped from then on."""
        path = []
        while room[ring[i][1]] == 0 or ahead[i] != i:
            path.append(i)
            i = ahead[i] if ahead[i] != i else (i + 1) % len(ring)
        for j in path:
            ahead[j] = i
        return i

    used, runs = [0] * shards, []
    for cell in sorted(loads):
        left, at = loads[cell], 0
        i = bisect.bisect_left(spots, cell) % len(ring)
        while left:
            i = open_from(i)
            shard = ring[i][1]
            n = min(left, room[shard])
            runs.append((cell, at, at + n, shard, used[shard]))
            room[shard] -= n
            used[shard] += n
            at, left = at + n, left - n
    return runs


def ring_shards(docs: DataFrame, *, shards: int = 40, virtual_nodes: int = 128, slack: float = 0.0, seed: int = 9) -> DataFrame:
    """Puts each row of docs (doc_id, text, ...) into a shard; adds size, text_crc32, shard and slot.

    size: UTF-8 bytes of the text (null: none) plus 16. slot: gapless from 0 in each shard. With
    ``slack`` 0 the numbers of rows in two shards differ by one at most; with a slack of e no shard
    takes more than (1 + e) times the mean, and a change of the number of shards moves the fewer rows
    the larger e is.

    The ring key is doc_id with the text's checksum, so rows that only share an id spread as well. Within a
    cell rows are ordered by doc_id, checksum, size, and a hash of their columns without maps and variants. Rows equal in all
    columns share a cell, overflow like others and take neighbouring places in it: whichever of them takes
    which slot, the result is the same table. A null doc_id is a key of its own. An empty table gives no
    rows. Added columns that clash get an underscore.
    """
    size, crc, shard, slot, cell, place = (fresh(docs, c) for c in ("size", "text_crc32", "shard", "slot", "ring_cell", "ring_place"))
    text = F.coalesce("text", F.lit(""))
    rows = docs.withColumns({size: F.octet_length(text).cast("long") + 16, crc: F.crc32(F.encode(text, "UTF-8"))})
    key = F.xxhash64(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.col(crc))
    rows = rows.withColumn(cell, F.shiftrightunsigned(key, 64 - CELL_BITS).cast("int"))

    loads = {r[0]: r[1] for r in rows.groupBy(cell).count().collect()}
    runs = json.dumps(layout(loads, shards, virtual_nodes, slack))
    plan = docs.sparkSession.range(1).select(F.explode(F.from_json(F.lit(runs), "array<array<long>>")).alias("r"))
    plan = plan.select(*(F.col("r")[i].alias(f"plan_{n}") for i, n in enumerate(("cell", "from", "to", "shard", "slot"))))
    plain = [f"`{f.name}`" for f in docs.schema if not any(kind in f.dataType.simpleString() for kind in ("map<", "variant"))]  # others have no hash
    order = Window.partitionBy(cell).orderBy("doc_id", crc, size, F.xxhash64(*plain))
    ranked = rows.withColumn(place, F.row_number().over(order) - 1)
    inside = (ranked[cell] == plan["plan_cell"]) & (ranked[place] >= plan["plan_from"]) & (ranked[place] < plan["plan_to"])
    return ranked.join(F.broadcast(plan), inside).select(
        *(ranked[c] for c in docs.columns), ranked[size], ranked[crc],
        plan["plan_shard"].cast("int").alias(shard), (plan["plan_slot"] + ranked[place] - plan["plan_from"]).alias(slot),
    )
