"""Language-model scores by context-tree weighting over bytes.

Each byte is eight binary decisions, so there is one binary context tree for each of the 255 places in
a byte's decision path. A node stands for up to ``DEPTH`` preceding bytes and holds the counts of zeros
and ones of all training texts there. Its weighted probability is half its own Krichevsky-Trofimov
block probability and half the product of its children's; a decision's probability mixes the estimates
of all depths of its path that training texts reached with the posterior weights that follow, and a byte's code length is the sum
over its eight decisions.

Counts of (context, byte) grams are sufficient, so the corpus is reduced to distinct grams by partial
and final aggregation. Trees are worked out in groups that share their last two bytes, or three or four where
more than ``SPLIT`` distinct grams share fewer; the nodes above such groups are put together by aggregation. Groups are
dealt to packs of about as many grams, since most groups are small. What
lies above two bytes (one byte of context or none: 65,280 nodes at most) is one small table. Texts are then scored by
looking up their grams: the most frequent ones in a table of bounded size that every task gets, all
others by a join.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import textcodes as tc
from .bpe import slices
from .shared import frequent, written

DEPTH = 6
HEAD = 1 << 21, 1 << 20  # the most grams and words that the broadcast tables hold
SPLIT = 1 << 16  # more grams than this that share their last bytes go to groups by one byte more
HELD = 500_000  # codes that a task gathers before it merges them into those it keeps; when these are as many, it hands the rarer half on
END = 0xFF  # ends a text and stands before it; no byte of UTF-8
MASK = np.uint64((1 << 8 * (DEPTH + 1)) - 1)  # a gram's bytes
HALF = np.log(0.5)
NO_ID = -(1 << 63)  # stands for a null doc_id within a job


def log_gamma(x: np.ndarray) -> np.ndarray:
    """ln of the gamma function for x >= 0.5: recurrence up to 8, then Stirling's series."""
    x, shift = np.asarray(x, float).copy(), np.zeros(np.shape(x))
    for _ in range(8):
        low = x < 8
        shift[low] += np.log(x[low])
        x[low] += 1
    y = 1 / (x * x)
    return (x - 0.5) * np.log(x) - x + 0.9189385332046727 + (1 / 12 - y * (1 / 360 - y * (1 / 1260 - y / 1680))) / x - shift


KNOWN = log_gamma(np.arange(1 << 14) + 0.5), log_gamma(np.arange(1 << 14) + 1.0)  # for the counts that most nodes have


def kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """ln of the Krichevsky-Trofimov probability of a block with so many zeros and ones."""
    zeros, ones = np.asarray(zeros, float), np.asarray(ones, float)
    both = zeros + ones
    few = both < len(KNOWN[0])
    out = np.empty(both.shape)
    z, o = zeros[few].astype(np.int64), ones[few].astype(np.int64)
    out[few] = KNOWN[0][z] + KNOWN[0][o] - 1.1447298858494002 - KNOWN[1][z + o]
    z, o = zeros[~few], ones[~few]
    out[~few] = log_gamma(z + 0.5) + log_gamma(o + 0.5) - 1.1447298858494002 - log_gamma(z + o + 1.0)
    return out


def grams(b: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The code of each byte with its DEPTH preceding bytes (the byte itself lowest), for all texts, each with
    its end; and where each text's codes begin."""
    n = len(offsets) - 1
    after = offsets[1:] + np.arange(1, n + 1) * (DEPTH + 1)  # where the room of the text's bytes and DEPTH + 1 ends ends
    own = np.ones(len(b) + n * (DEPTH + 1), bool)
    for i in range(1, DEPTH + 1):
        own[after - i] = False
    byte = own.copy()
    byte[after - DEPTH - 1] = False
    padded = np.full(7 + len(own), END, np.uint8)
    padded[7:][byte] = b
    eights = np.ndarray(len(own), ">u8", padded, strides=(1,))  # each place's byte and the seven before it, as one number
    return eights.astype(np.uint64)[own] & MASK, np.r_[0, np.cumsum(np.diff(offsets) + 1)]


def words(b: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """63-bit hashes of all words of all texts, and where each text's begin."""
    out = []
    for i in range(len(offsets) - 1):
        text = b[offsets[i] : offsets[i + 1]]
        out.append(tc.span_hashes(text, *tc.word_spans(text)))
    return np.concatenate([*out, np.zeros(0, tc.U)]) >> np.uint64(1), np.r_[0, np.cumsum([len(x) for x in out])].astype(np.int64)


def is_held_out(ids: list) -> np.ndarray:
    return np.array([zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2 for i in ids], bool)


def lowered(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    offsets, b = tc.texts(column)
    return tc.LOWER[b[offsets[0] : offsets[-1]]], offsets - offsets[0]


def code_counts(docs: DataFrame) -> DataFrame:
    """kind (0: gram, 1: word), code, n in training texts, n_all."""

    def counted(codes: np.ndarray, held: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        marked = np.sort(codes << np.uint64(1) | held.astype(np.uint64))
        codes = marked >> np.uint64(1)
        edge = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]][: len(codes)])
        every = np.diff(np.r_[edge, len(codes)])
        return codes[edge], every - added((marked & np.uint64(1)).astype(np.int64), np.r_[edge, len(codes)]), every

    def run(batches):
        forget_tables()  # of an earlier job in the same worker
        kept: list[list] = [[], []]  # by kind: first those merged, then those of single slices
        merged = [0, 0]

        def merge(kind: int) -> tuple:
            parts = [np.concatenate(c) for c in zip(*kept[kind])]
            kept[kind].clear()
            merged[kind] = 0
            return gathered(*parts)

        def handed_on(kind: int, codes: np.ndarray, n: np.ndarray, n_all: np.ndarray):
            for at in range(0, len(codes), 1 << 17):
                cut = slice(at, at + (1 << 17))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(codes[cut]), kind, np.int32)), pa.array(codes[cut].view(np.int64)), pa.array(n[cut]), pa.array(n_all[cut])],
                    ["kind", "code", "n", "n_all"],
                )

        for batch in batches:
            for part in slices(batch, 1, 1 << 19):
                b, offsets = lowered(part.column(1))
                held = is_held_out(part.column(0).to_pylist())
                for kind, (codes, begins) in enumerate((grams(b, offsets), words(b, offsets))):
                    kept[kind].append(counted(codes, np.repeat(held, np.diff(begins))))
                    if sum(len(c[0]) for c in kept[kind]) - merged[kind] > HELD:
                        whole = merge(kind)
                        if len(whole[0]) > HELD:
                            often = whole[2] > np.partition(whole[2], len(whole[2]) - HELD // 2)[len(whole[2]) - HELD // 2]
                            yield from handed_on(kind, *(c[~often] for c in whole))
                            whole = tuple(c[often] for c in whole)
                        kept[kind].append(whole)
                        merged[kind] = len(whole[0])
        for kind in (0, 1):
            if kept[kind]:
                yield from handed_on(kind, *merge(kind))

    rows = docs.select("doc_id", "text").mapInArrow(run, "kind int, code long, n long, n_all long")
    return rows.groupBy("kind", "code").agg(F.sum("n").alias("n"), F.sum("n_all").alias("n_all"))


def gathered(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys in order, with sums of the values."""
    if not len(keys):
        return keys, *values
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    edge = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[edge], *(np.add.reduceat(v[order], edge) for v in values)


class Trees:
    """All nodes of depth ``base`` and more below as many last bytes, of one group of grams or several.

    ``above`` has those from depth two to ``base``, on the path to these bytes: depth, node, zeros, ones, weight.
    ``level`` has each depth's nodes: node, zeros, ones, weighted, weight.
    """

    def __init__(self, codes: np.ndarray, n: np.ndarray, base: int = 2, above: pd.DataFrame | None = None):
        self.codes = codes.astype(np.uint64)
        self.level, self.places, self.base = {}, {}, base
        for depth in range(2, base if above is not None else 2):
            rows = above[above["depth"] == depth].sort_values("node")
            node, zeros, ones, weight = (rows[c].to_numpy() for c in ("node", "zeros", "ones", "weight"))
            self.level[depth] = node.astype(np.uint64), zeros, ones, None, weight
        rows, many, at = self.codes, n.astype(float), np.arange(len(codes))
        before = None
        for depth in range(DEPTH, base - 1, -1):
            # Distinct contexts with their byte, in order: the nodes of each place in a byte's path are runs of them.
            keys = rows & np.uint64((1 << 8 * (depth + 1)) - 1)
            order = np.argsort(keys)
            keys = keys[order]
            edge = np.r_[True, keys[1:] != keys[:-1]][: len(keys)]
            up = np.empty(len(keys), np.int64)
            up[order] = np.cumsum(edge) - 1
            rows, many, at = keys[edge], np.add.reduceat(many[order], np.flatnonzero(edge)), up[at]
            x, runs, starts, found = rows & np.uint64(0xFF), [], [], []
            for j in range(8):
                path = rows >> np.uint64(8 - j)
                first = np.r_[True, path[1:] != path[:-1]]
                start = np.flatnonzero(first)
                ones = np.add.reduceat(many * (x >> np.uint64(7 - j) & np.uint64(1)), start)
                node = rows[start] >> np.uint64(8) << np.uint64(8) | np.uint64(1 << j) | x[start] >> np.uint64(8 - j)
                found.append((node, np.add.reduceat(many, start) - ones, ones))
                runs.append(np.cumsum(first) - 1)
                starts.append(start)
            node, zeros, ones = (np.concatenate(c) for c in zip(*found))
            ends = np.cumsum([0] + [len(s) for s in starts])
            own = kt(zeros, ones)
            if before:
                log_w, child_starts, child_ends = before
                children = np.concatenate([
                    np.bincount(runs[j][up[child_starts[j]]], log_w[child_ends[j] : child_ends[j + 1]], len(starts[j])) for j in range(8)
                ])
                weighted = np.logaddexp(HALF + own, HALF + children)
                weight = np.exp(HALF + own - weighted)
            else:
                weighted, weight = own, np.ones(len(node))
            before = weighted, starts, ends
            self.level[depth] = node, zeros, ones, weighted, weight
            self.places[depth] = at, [runs[j] + ends[j] for j in range(8)]

    def nodes_of(self, depth: int, j: int, place: np.ndarray) -> np.ndarray:
        """Each gram's node of a depth at the j-th place of its byte's path."""
        if depth >= self.base:
            at, runs = self.places[depth]
            return runs[j][at]
        context = self.codes >> np.uint64(8) & np.uint64((1 << 8 * depth) - 1)
        return np.searchsorted(self.level[depth][0], context << np.uint64(8) | place.astype(np.uint64))

    def probabilities(self, top: np.ndarray) -> np.ndarray:
        """log10 of each gram's byte; top: [last byte or 256 for none][place] -> (estimate of a one, weight, count)."""
        x = (self.codes & np.uint64(0xFF)).astype(np.int64)
        last = (self.codes >> np.uint64(8) & np.uint64(0xFF)).astype(np.int64)
        total = np.zeros(len(x))
        for j in range(8):
            place, bit = 1 << j | x >> (8 - j), (x >> (7 - j)) & 1
            q = np.full(len(x), np.nan)
            for depth in range(DEPTH, 1, -1):
                _, zeros, ones, _, weight = self.level[depth]
                at = self.nodes_of(depth, j, place)
                many = zeros[at] + ones[at]
                q = mixed(q, (np.where(bit == 1, ones[at], zeros[at]) + 0.5) / (many + 1), weight[at], many > 0)
            for who in (last, np.full(len(x), 256)):
                one, weight, many = (top[who, place, i] for i in range(3))
                q = mixed(q, np.where(bit == 1, one, 1 - one), weight, many > 0)
            total += np.log10(np.where(np.isnan(q), 0.5, q))
        return total


def mixed(below: np.ndarray, own: np.ndarray, weight: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """A node's probability from its own estimate and its child's; nodes that training never met don't take part (NaN)."""
    return np.where(seen, np.where(np.isnan(below), own, weight * own + (1 - weight) * below), np.nan)


def weighted_nodes(batches):
    """Nodes with their weighted probability and their own estimate's weight, from counts and the sum of their children's ln."""
    for rows in batches:
        own = kt(rows["zeros"].to_numpy(), rows["ones"].to_numpy())
        rows["weighted"] = np.logaddexp(HALF + own, HALF + rows["below"].to_numpy())
        rows["weight"] = np.exp(HALF + own - rows["weighted"])
        yield rows[["depth", "node", "zeros", "ones", "weighted", "weight"]]


NODE = "depth int, node long, zeros double, ones double, weighted double, weight double"
NODE_NAMES = [c.split()[0] for c in NODE.split(", ")]


def parents(nodes: DataFrame, depth: int) -> DataFrame:
    """The nodes of a depth from all those one deeper."""
    node = F.shiftright("node", 8).bitwiseAND(F.lit((1 << 8 * depth) - 1)) * 256 + F.col("node").bitwiseAND(F.lit(0xFF))
    rows = nodes.groupBy(node.alias("node")).agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"), F.sum("weighted").alias("below"))
    return rows.withColumn("depth", F.lit(depth)).mapInPandas(weighted_nodes, NODE)


def grouped(grams_: DataFrame, split: int) -> tuple[DataFrame, int]:
    """Grams with base (number of last bytes that their group shares) and grp (these bytes), and the largest base."""
    last = lambda n: F.shiftright("code", 8).bitwiseAND(F.lit((1 << 8 * n) - 1))
    out, most = grams_.withColumn("base", F.lit(2)), 2
    for n in (2, 3):
        large = written(out.where(F.col("base") == n).groupBy(last(n).alias("large")).agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > split).select("large"), "large-groups")
        if large.isEmpty():
            break
        out = out.join(large, last(n) == F.col("large"), "left").withColumn("base", F.when(F.col("large").isNotNull(), n + 1).otherwise(F.col("base"))).drop("large")
        most = n + 1
    return out.withColumn("grp", F.when(F.col("base") == 2, last(2)).when(F.col("base") == 3, last(3)).otherwise(last(4))), most


def upper_nodes(rows: pd.DataFrame) -> np.ndarray:
    """rows: last (byte), place, zeros, ones, below (sum of the children's ln) -> the table ``top`` of Trees.probabilities."""
    n, below = np.zeros((257, 256, 2)), np.zeros((257, 256))
    last, place = rows["last"].to_numpy(np.int64), rows["place"].to_numpy(np.int64)
    n[last, place] = rows[["zeros", "ones"]].to_numpy(float)
    below[last, place] = rows["below"].to_numpy(float)
    n[256] = n[:256].sum(axis=0)
    top = np.zeros((257, 256, 3))
    top[:, :, 2] = n.sum(axis=2)
    for part in (slice(0, 256), slice(256, 257)):
        own = kt(n[part, :, 0], n[part, :, 1])
        weighted = np.logaddexp(HALF + own, HALF + below[part])
        top[part, :, 0] = (n[part, :, 1] + 0.5) / (n[part].sum(axis=2) + 1)
        top[part, :, 1] = np.exp(HALF + own - weighted)
        if part.start == 0:
            below[256] = weighted.sum(axis=0)
    return top


class Table:
    """Codes with a value each, the most frequent last; what finds its place taken by a later one goes to a further, smaller level."""

    def __init__(self, codes: np.ndarray, values: np.ndarray):
        self.levels, by = [], 0x9E3779B97F4A7C15
        while len(codes):
            bits = max(4, (len(codes) - 1).bit_length())
            spot = self.spots(codes, by, bits)
            keys, found = np.zeros(1 << bits, np.uint64), np.full(1 << bits, np.nan)
            keys[spot], found[spot] = codes, values
            self.levels.append((by, bits, keys, found))
            left = keys[spot] != codes
            codes, values, by = codes[left], values[left], by * 0xC2B2AE3D27D4EB4F + 2 & (1 << 64) - 1 | 1

    @staticmethod
    def spots(codes: np.ndarray, by: int, bits: int) -> np.ndarray:
        return ((codes ^ codes >> np.uint64(29)) * np.uint64(by) >> np.uint64(64 - bits)).astype(np.int64)

    def find(self, codes: np.ndarray) -> np.ndarray:
        """Each code's value, NaN where it isn't here."""
        out = np.full(len(codes), np.nan)
        for begin in range(0, len(codes), 1 << 16):  # parts that stay in the processor's cache
            part = codes[begin : begin + (1 << 16)]
            open_ = np.arange(begin, begin + len(part))
            for by, bits, keys, found in self.levels:
                spot = self.spots(part, by, bits)
                out[open_] = np.where(keys.take(spot) == part, found.take(spot), np.nan)
                miss = np.isnan(out[open_])
                open_, part = open_[miss], part[miss]
                if not len(part):
                    break
        return out


_tables: list = [None, None]


def forget_tables():
    """A function of the module, since a nested one would be sent with its own copy of the list."""
    _tables[:] = None, None


def tables_of(shared) -> list[Table]:
    if _tables[0] is not shared.value:
        _tables[:] = shared.value, [Table(c, v) for c, v in shared.value]
    return _tables[1]


def score(docs: DataFrame, *, split: int = SPLIT) -> DataFrame:
    """Scores every whole text by a model of those whose crc32(doc_id as text) mod 7 isn't 2.

    docs: doc_id, text. Gives doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and bits_per_byte.
    A-Z are lower-cased. base_score: log10 by add-one word counts (words and one end a text). score:
    log10 probability of all bytes and the end by the weighted context trees; bits_per_byte: its code
    length over bytes and end.

    Null or empty texts have the end alone. A null doc_id counts as the empty text for the split and is
    a training text. Rows may repeat; each gives a row and each counts in training. Without training texts every decision
    has probability one half. An empty table gives no rows. Other columns aren't returned.

    A group of trees has ``split`` grams at the most, unless they share four bytes of context, and a pack of groups about as many;
    the scores don't depend on it.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    counts = written(code_counts(docs), "code-counts")
    word_rows, gram_rows = counts.where("kind = 1"), counts.where("kind = 0")
    n_docs, n_train = docs.select(
        F.count(F.lit(1)), F.coalesce(F.sum((F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 7 != 2).cast("long")), F.lit(0))
    ).first()
    words_n, words_v = word_rows.select(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum((F.col("n") > 0).cast("long")), F.lit(0))).first()
    n, v = words_n + n_train, words_v + (n_train > 0)

    packs = 1 + gram_rows.count() // split
    gram_rows, most = grouped(gram_rows, split)
    gram_rows = gram_rows.withColumn("pack", F.pmod(F.xxhash64("base", "grp"), F.lit(packs)))

    def upper(frame: pd.DataFrame) -> pd.DataFrame:
        base = int(frame["base"].iloc[0])
        node, zeros, ones, weighted, weight = Trees(frame["code"].to_numpy(np.int64), frame["n"].to_numpy(np.int64), base).level[base]
        return pd.DataFrame({"depth": np.full(len(node), base, np.int32), "node": node.astype(np.int64), "zeros": zeros, "ones": ones, "weighted": weighted, "weight": weight})

    nodes = gram_rows.select("base", "pack", "code", "n").groupBy("base", "pack").applyInPandas(lambda f: upper(f), NODE)
    if most > 2:
        nodes = written(nodes, "nodes")
        for depth in range(most - 1, 1, -1):
            nodes = written(nodes.unionByName(parents(nodes.where(F.col("depth") == depth + 1), depth)), "nodes")
    last, place = F.shiftright("node", 8).bitwiseAND(F.lit(0xFF)), F.col("node").bitwiseAND(F.lit(0xFF))
    top = nodes.where("depth = 2").groupBy(last.alias("last"), place.alias("place")).agg(*(F.sum(c).alias(c) for c in ("zeros", "ones")), F.sum("weighted").alias("below")).toPandas()
    top = spark.sparkContext.broadcast(upper_nodes(top))

    def lower(frame: pd.DataFrame, above: pd.DataFrame | None = None) -> pd.DataFrame:
        if not len(frame):
            return pd.DataFrame({"kind": [], "code": [], "n_all": [], "value": []})
        base = int(frame["base"].iloc[0])
        logs = Trees(frame["code"].to_numpy(np.int64), frame["n"].to_numpy(np.int64), base, above).probabilities(top.value)
        return pd.DataFrame({"kind": np.zeros(len(logs), np.int32), "code": frame["code"], "n_all": frame["n_all"], "value": logs})

    schema = "kind int, code long, n_all long, value double"
    parts = gram_rows.select("base", "pack", "code", "n", "n_all").groupBy("base", "pack")
    if most == 2:
        values = parts.applyInPandas(lambda f: lower(f), schema)
    else:
        below = gram_rows.where("base > 2").select("base", "pack", "grp").distinct().withColumn("depth", F.explode(F.sequence(F.lit(2), F.col("base") - 1)))
        below = below.select(F.col("base").alias("base"), F.col("pack").alias("pack"), "depth", F.expr("grp & (shiftleft(1L, 8 * depth) - 1)").alias("path")).distinct()
        paths = nodes.where(F.col("depth") < most).withColumn("path", F.shiftright("node", 8)).select(*NODE_NAMES, "path")
        above = below.join(paths, ["depth", "path"]).select("base", "pack", *NODE_NAMES)
        values = parts.cogroup(above.groupBy("base", "pack")).applyInPandas(lambda f, g: lower(f, g), schema)
    values = written(values.unionByName(word_rows.select("kind", "code", "n_all", F.col("n").cast("double").alias("value"))), "code-values")
    head = []
    for kind in (0, 1):
        rows = frequent(values.where(F.col("kind") == kind), "n_all", HEAD[kind]).select("code", "value", "n_all").toArrow()
        order = np.argsort(rows["n_all"].to_numpy(), kind="stable")
        head.append((rows["code"].to_numpy().view(np.uint64)[order], rows["value"].to_numpy()[order]))
    shared = spark.sparkContext.broadcast(head)

    def look_up(batches):
        """A row of sums for each text (kind -1) and a row for each of its codes that the tables don't have."""
        tables = tables_of(shared)
        for batch in batches:
            for part in slices(batch, 1, 1 << 19):
                b, offsets = lowered(part.column(1))
                rows = part.num_rows
                names = [i & (1 << 64) - 1 for i in part.column(0).to_pylist()]
                texts = np.array([zlib.crc32(b[i:j]) | (j - i & 0xFFFFFFFF) << 32 for i, j in zip(offsets[:-1].tolist(), offsets[1:].tolist())], np.uint64)
                key = tc.mix(tc.mix(texts) + np.array(names, np.uint64)).view(np.int64)
                sums, more = [], [(np.full(rows, -1, np.int32), key, np.arange(rows))]
                for kind, (codes, begins) in enumerate((grams(b, offsets), words(b, offsets))):
                    value = tables[kind].find(codes)
                    lost = np.flatnonzero(np.isnan(value))
                    value[lost] = 0
                    sums += [added(np.log10(value + 1), begins), added((value > 0).astype(np.int64), begins), np.diff(begins)] if kind else [added(value, begins)]
                    more.append((np.full(len(lost), kind, np.int32), codes[lost].view(np.int64), np.searchsorted(begins, lost, "right") - 1))
                kind, code, doc = (np.concatenate(c) for c in zip(*more))
                s, base, known, tokens = sums
                ids = np.array(names, np.uint64).view(np.int64)
                own = pa.StructArray.from_arrays([pa.array(x) for x in (s, base, known, tokens, np.diff(offsets))], ["s", "b", "known", "tokens", "bytes"])
                at = pa.array(np.where(kind == -1, doc, 0), mask=kind != -1)
                yield pa.RecordBatch.from_arrays([pa.array(ids[doc]), pa.array(key[doc]), pa.array(kind), pa.array(code), own.take(at)], ["id", "key", "kind", "code", "own"])

    own = "struct<s:double,b:double,known:long,tokens:long,bytes:long>"
    rows = docs.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id"), "text").mapInArrow(look_up, f"id long, key long, kind int, code long, own {own}")
    place = F.when(F.col("kind") == 1, -1 - F.col("code")).otherwise(F.col("code")).alias("place")  # one number sorts faster than two
    rows = rows.select("id", "key", "kind", place, "own").join(values.select(place, "value"), "place", "left")
    found, is_gram, is_word = F.coalesce("value", F.lit(0.0)), F.col("kind") == 0, F.col("kind") == 1
    rows = rows.groupBy("id", "key").agg(
        F.count("own").alias("copies"),
        F.sum(F.when(is_gram, found).otherwise(F.col("own.s"))).alias("s"),
        F.sum(F.when(is_word, F.log10(found + 1)).otherwise(F.col("own.b"))).alias("b"),
        F.sum(F.when(is_word, (found > 0).cast("long")).otherwise(F.col("own.known"))).alias("known"),
        F.sum("own.tokens").alias("tokens"), F.sum("own.bytes").alias("bytes"),
    ).withColumn("doc_id", F.when(F.col("id") != NO_ID, F.col("id")))
    each = lambda c: F.col(c) / F.col("copies")
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 7 == 2
    base = each("b") + F.lit(float(np.log10(n_train + 1))) - (each("tokens") + 1) * F.lit(float(np.log10(n + v + 1)))
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(
        "doc_id", held.alias("held_out"), (each("tokens") + 1).cast("long").alias("n_tokens"), (each("known") + int(n_train > 0)).cast("long").alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"), base.alias("base_score"), each("s").alias("score"),
        (-each("s") / F.lit(float(np.log10(2))) / (each("bytes") + 1)).alias("bits_per_byte"),
    )


def added(values: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Sums between neighbouring begins."""
    full = begins[1:] > begins[:-1]
    out = np.zeros(len(begins) - 1, values.dtype)
    if full.any():
        out[full] = np.add.reduceat(values, begins[:-1][full])
    return out
