"""N-gram Jaccard join: documents linked by the Jaccard similarity of their word-shingle sets.

Method: universe-partition pigeonhole. The shingle universe is hashed into segments; the number of
segments follows from the size band. Two sets within the threshold differ in at most H shingles, so
with values that sum to H + 1 + e over the segments, either a segment of value 2 differs in at most
one shingle (both sides index it with its one-deletion neighbourhood), or 1 + e segments of value 1
are equal. Each document may then leave out e segments of value 1, those that most documents share:
the first of 1 + e equal segments in any order that only content decides is indexed on both sides.
The order is by the segments' frequency in the whole corpus, so a passage that many documents share
fills no buckets. How many segments get value 2 and how large e is, is chosen for each band by the
cost that a bounded sample of the band shows. Sets are compared exactly afterwards, so the segments
only have to lose nothing.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from . import textcodes as tc
from .bpe import slices
from .shared import components, frequent, fresh, gathered, written

PARITY = 16  # longs of parity bits, a lower bound of the symmetric difference
BROADCAST_IDS = 1_000_000
SAMPLE = 512, 1 << 19  # the most sets and shingles of a band in the sample that tells the cost
OFTEN = 4  # a segment counts as shared by many from so many sets on
HEAD = 1 << 20  # the most segments whose frequency the tasks get to know
SHORT = tc.U(24)  # bits left out of a segment's key where only its frequency matters
FIRST = 16  # the smallest keys of a set that its rows carry along, by which a pair that shares many keys is met about once
SLICE = 1 << 19  # bytes of text that a task works on at once, but for single longer texts


@dataclass(frozen=True)
class Bands:
    """Size bands and, for each band, the segments: ``double`` of value 2, the rest of value 1, ``spare`` = e."""

    num: int
    den: int
    low: tuple[int, ...]
    double: tuple[int, ...]
    spare: tuple[int, ...]

    @classmethod
    def make(cls, num: int, den: int, largest: int, ratio: float = 1.5) -> Bands:
        low = [1]
        while low[-1] <= largest:
            low.append(max(low[-1] + 1, math.floor(low[-1] * ratio)))
        bands = cls(num, den, tuple(low), (0,) * (len(low) - 1), (0,) * (len(low) - 1))
        return replace(bands, spare=tuple((h + 4) // 4 for h in bands.most()))

    def bound(self, size, band):
        """The most shingles in which a set of this size can differ from a linked, not smaller set of the band."""
        partner = np.minimum(np.array(self.low)[np.asarray(band) + 1] - 1, size * self.den // self.num)
        return (self.den - self.num) * (size + partner) // (self.den + self.num)

    def most(self) -> list[int]:
        """The bound of each band's largest sets: H."""
        own = np.arange(len(self.low) - 1)
        return self.bound(np.array(self.low)[1:] - 1, own).tolist()

    def options(self, band: int) -> list[tuple[int, int]]:
        """What double and spare may be for a band."""
        h = self.most()[band]
        return sorted({(d, e) for e in ((h + 4) // 4, h + 1) for d in (0, (h + 2) // 4, (h + 1 + e) // 2)})

    def keys(self, edges: np.ndarray, items: np.ndarray, often: tuple[np.ndarray, np.ndarray] | None) -> tuple[np.ndarray, np.ndarray]:
        """Index keys of many sets: (set, key). ``often``: sorted segments that many sets share, and a level for each.

        Set i has the distinct hashes ``items[edges[i]:edges[i + 1]]``. Without ``often``, all segments of value 1,
        in the short form in which they are counted, and nothing else.
        """
        low, double, spare = np.array(self.low), np.array(self.double), np.array(self.spare)
        size = np.diff(edges)
        own = np.searchsorted(low, size, "right") - 1
        sets, bands = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for step in range(len(low)):
            band = own + step
            at = np.flatnonzero((size > 0) & (band + 1 < len(low)))
            at = at[(step == 0) | (size[at] * self.den // self.num >= low[band[at]])]
            if not len(at):
                break
            at = at[self.bound(size[at], band[at]) > 0]  # otherwise only equal sets link, which are one class already
            sets.append(at)
            bands.append(band[at])
        sets, bands = np.concatenate(sets), np.concatenate(bands)
        if not len(sets):
            return np.zeros(0, np.int64), np.zeros(0, tc.U)
        d, segments = double[bands], np.array(self.most())[bands] + 1 + spare[bands] - double[bands]
        base = np.r_[0, np.cumsum(segments)]
        n = size[sets]
        row = np.repeat(np.arange(len(sets)), n)
        item = items[np.repeat(edges[sets] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())]
        mixed = tc.mix(item + bands[row].astype(tc.U))
        segment = ((mixed >> tc.U(20)) % segments[row].astype(tc.U)).astype(np.int64)
        cell = base[row] + segment
        total = np.zeros(base[-1], tc.U)
        np.add.at(total, cell, mixed)
        owner = np.repeat(np.arange(len(sets)), segments)
        number = np.arange(base[-1]) - base[owner]
        name = tc.mix(number.astype(tc.U) + ((bands[owner] + 1).astype(tc.U) << tc.U(32)))
        whole, single = tc.mix(total ^ name), number >= d[owner]
        if often is None:
            return sets[owner[single]], whole[single] >> SHORT
        far = segment < d[row]
        cells = np.flatnonzero(single)
        level = np.zeros(len(cells), np.int64)
        if len(often[0]):
            short = whole[cells] >> SHORT
            near = np.minimum(np.searchsorted(often[0], short), len(often[0]) - 1)
            level = np.where(often[0][near] == short, often[1][near], 0)
        count = np.bincount(cell, minlength=base[-1])[cells]
        rank = (level.astype(tc.U) << tc.U(56)) | ((255 - np.minimum(count, 255)).astype(tc.U) << tc.U(48)) | (whole[cells] >> tc.U(16))
        cells = cells[np.lexsort((rank, owner[cells]))]
        of = owner[cells]
        place = np.arange(len(cells)) - np.searchsorted(of, np.arange(len(sets)))[of]
        cells = cells[place < (self.bound(n, bands) + 1 - 2 * d)[of]]
        return (
            np.r_[sets[owner[cells]], sets[owner[~single]], sets[row[far]]],
            np.r_[whole[cells], whole[~single], tc.mix((total[cell[far]] - mixed[far]) ^ name[cell[far]])],
        )


def levels(counts: np.ndarray) -> np.ndarray:
    return np.minimum(255, 4 * np.log2(np.maximum(counts, 1))).astype(np.int64)


def sets_of_batch(batch: pa.RecordBatch, k: int):
    """For slices of a batch (id, text): the slice, edges and sorted distinct shingle hashes of its sets."""
    for part in slices(batch, 1, SLICE):
        offsets, b = tc.texts(part.column(1))
        b, offsets = tc.LOWER[b[offsets[0] : offsets[-1]]], offsets - offsets[0]
        starts, ends = tc.word_spans_of_texts(b, offsets)
        words = tc.span_hashes(b, starts, ends)
        first = np.searchsorted(starts, offsets)
        yield part, *tc.shingle_sets(words, first, k)


def signatures(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, n_shingles, a 128-bit hash of the set (n_shingles 0: none) and its parity bits."""

    def run(batches):
        for batch in batches:
            for part, edges, u in sets_of_batch(batch, k):
                n, row = np.diff(edges), np.repeat(np.arange(part.num_rows), np.diff(edges))
                cols = [tc.sums(u, edges), tc.sums(tc.mix(u + tc.U(77)), edges)]
                cell = (tc.mix(u ^ tc.U(0x5851F42D4C957F2D)) % tc.U(64 * PARITY)).astype(np.int64)
                odd = np.bincount(row * 64 * PARITY + cell, minlength=part.num_rows * 64 * PARITY) & 1
                cols += list(np.packbits(odd.astype(bool)).view(np.int64).reshape(part.num_rows, PARITY).T)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(n), *(pa.array(np.ascontiguousarray(x).view(np.int64)) for x in cols)],
                    ["doc_id", "n_shingles", "h1", "h2", *MARKS],
                )

    kinds = ", ".join(f"{m} long" for m in MARKS)
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id long, n_shingles long, h1 long, h2 long, {kinds}")


MARKS = [f"p{j}" for j in range(PARITY)]


def allocated(docs: DataFrame, reps: DataFrame, bands: Bands, k: int) -> Bands:
    """The bands with the cheapest allocation: keys to shuffle and pairs to compare, as a sample of each band shows them.

    The sample has about ``SAMPLE`` sets and shingles of a band; it only bears on the cost, never on results.
    """
    sets = {r[0]: r[1] for r in reps.groupBy("band").count().collect()}
    if not sets:
        return bands
    share = [min(1.0, min(SAMPLE[0], max(8, SAMPLE[1] // top)) / sets.get(b, 1)) for b, top in enumerate(bands.low[1:])]
    some = F.element_at(F.array(*(F.lit(int(x * (1 << 30))) for x in share)), F.col("band") + 1)
    wanted = reps.where(F.pmod(F.xxhash64(F.lit(3), "rep"), F.lit(1 << 30)) < some).select(F.col("rep").alias("doc_id"), "band")

    def items(batches):
        for batch in batches:
            for part, edges, u in sets_of_batch(batch, k):
                flat = pa.LargeListArray.from_arrays(pa.array(edges), pa.array(u.view(np.int64))).cast(pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([part.column(2), flat], ["band", "items"])

    def measure(rows: pa.Table) -> pa.Table:
        b = rows["band"][0].as_py()
        own = sorted((np.array(x.as_py(), np.int64).view(tc.U) for x in rows["items"]), key=lambda x: (len(x), x[:1].tolist()))
        edges, flat, out = np.r_[0, np.cumsum([len(x) for x in own])], np.concatenate(own), []
        times = sets[b] / len(own)
        for d, e in bands.options(b):
            tried = replace(bands, double=tuple(d if i == b else x for i, x in enumerate(bands.double)), spare=tuple(e if i == b else x for i, x in enumerate(bands.spare)))
            every = tried.keys(edges, flat, None)[1]
            seen, n = np.unique(every, return_counts=True)
            keys = tried.keys(edges, flat, (seen, np.where(n > 1, levels(n), 0)))[1]
            n = np.unique(keys, return_counts=True)[1].astype(float)
            out.append({"band": b, "double": d, "spare": e, "cost": (len(keys) + len(every) / 2) * times + (n * (n - 1) / 2).sum() * times * times / 4})
        return pa.Table.from_pylist(out, pa.schema([("band", pa.int32()), ("double", pa.int32()), ("spare", pa.int32()), ("cost", pa.float64())]))

    found = docs.join(F.broadcast(wanted), "doc_id").select("doc_id", "text", "band").mapInArrow(items, "band int, items array<long>")
    found = found.groupBy("band").applyInArrow(measure, "band int, double int, spare int, cost double")
    double, spare = list(bands.double), list(bands.spare)
    for r in found.groupBy("band").agg(F.min(F.struct("cost", "double", "spare")).alias("r")).collect():
        double[r["band"]], spare[r["band"]] = r["r"]["double"], r["r"]["spare"]
    return replace(bands, double=tuple(double), spare=tuple(spare))


def often_shared(docs: DataFrame, k: int, bands: Bands) -> tuple[np.ndarray, np.ndarray]:
    """The segments that most sets share, counted over all sets: sorted keys and levels, ``HEAD`` at the most."""

    def run(batches):
        for batch in batches:
            for _, edges, u in sets_of_batch(batch, k):
                yield pa.RecordBatch.from_arrays([pa.array(bands.keys(edges, u, None)[1].view(np.int64))], ["key"])

    counts = docs.select("doc_id", "text").mapInArrow(run, "key long").groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    found = frequent(written(gathered(counts.where(F.col("n") >= OFTEN), "key"), "segments"), "n", HEAD).toArrow()
    keys = found["key"].to_numpy().view(tc.U)
    order = np.argsort(keys)
    return keys[order], levels(found["n"].to_numpy()[order])


def index_keys(docs: DataFrame, k: int, bands: Bands, often: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """Rows (key, id): the index of all sets, one row for each key of a set."""
    shared = docs.sparkSession.sparkContext.broadcast(often)

    def run(batches):
        for batch in batches:
            for part, edges, u in sets_of_batch(batch, k):
                own, keys = bands.keys(edges, u, shared.value)
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), part.column(0).take(pa.array(own))], ["key", "id"])

    return docs.select("doc_id", "text").mapInArrow(run, "key long, id long")


def sets_of(docs: DataFrame, k: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            for part, edges, u in sets_of_batch(batch, k):
                flat = pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.array(u.view(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column(0), flat], ["id", "items"])

    return docs.select("doc_id", "text").mapInArrow(run, "id long, items array<long>")


def may_link(x: str, y: str, num: int, den: int) -> Column:
    """Sizes and parity bits of the rows x and y allow a link: each differing shingle flips one bit at most."""
    a, b = F.col(f"{x}.size"), F.col(f"{y}.size")
    odd = sum((F.bit_count(F.col(f"{x}.{m}").bitwiseXOR(F.col(f"{y}.{m}"))) for m in MARKS), F.lit(0))
    return (a * den >= b * num) & (b * den >= a * num) & (odd * (den + num) <= (a + b) * (den - num))


def verified(pairs: DataFrame, docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough, compared whole. The sets are shuffled once for both sides and not written."""
    pairs = written(pairs, "to-verify")
    ids = written(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "ids")
    wanted = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    sets = sets_of(docs.join(wanted, "doc_id", "left_semi"), k).repartition("id")
    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("items").alias("x")), "a").join(
        sets.select(F.col("id").alias("b"), F.col("items").alias("y")), "b"
    )
    shared = F.size(F.array_intersect("x", "y"))
    return both.where(shared * (den + num) >= (F.size("x") + F.size("y")) * num).select("a", "b").distinct()


def leading_pairs(rows: DataFrame, marks: DataFrame, seed: int, num: int, den: int) -> DataFrame:
    """For each component the likeliest one to join: (comp, into, a, b), one row for each component at the most.

    rows: key, id, comp. In each bucket one member leads each component, and one component, drawn anew for each
    bucket and seed, stands first; each other one may join it or it them, by a fixed rank that only falls from
    comp to into, so there are no cycles. Of the pairs that may link by size and parity a component
    gets the one met most often.
    """
    leads = rows.groupBy("key", "comp").agg(F.min(F.struct(F.xxhash64(F.lit(seed), "id").alias("o"), "id"))["id"].alias("lead"))
    drawn = F.struct(F.xxhash64(F.lit(-seed), "key", "comp").alias("r"), F.col("comp").alias("other"), F.col("lead").alias("b"))
    met = leads.join(leads.groupBy("key").agg(F.min(drawn).alias("first")), "key").where("comp <> first.other")
    ahead = F.xxhash64("comp") > F.xxhash64("first.other")
    met = met.select(F.when(ahead, F.struct("comp", F.col("first.other").alias("into"))).otherwise(F.struct(F.col("first.other").alias("comp"), F.col("comp").alias("into"))).alias("c"), F.greatest("lead", "first.b").alias("a"), F.least("lead", "first.b").alias("b"))
    met = met.groupBy("c.comp", "c.into", "a", "b").agg(F.count(F.lit(1)).alias("n"))
    for side in "ab":
        met = met.join(marks.select(F.col("id").alias(side), F.struct("size", *MARKS).alias(f"m{side}")), side)
    met = met.where(may_link("ma", "mb", num, den))
    best = met.groupBy("comp").agg(F.max(F.struct("n", "into", "a", "b")).alias("p"))
    return best.select("comp", "p.into", "p.a", "p.b")


def united(rows: DataFrame, up: DataFrame) -> DataFrame:
    """rows (key, id, comp) with the components of ``up`` (comp, into) joined, in buckets that still hold several.

    Four steps up are followed; what lies farther stays apart, which costs comparisons but no links.
    """
    for _ in range(2):
        above = up.select(F.col("comp").alias("into"), F.col("into").alias("top"))
        up = up.join(above, "into", "left").select("comp", F.coalesce("top", "into").alias("into"))
    rows = rows.join(up, "comp", "left").select("key", "id", F.coalesce("into", "comp").alias("comp"))
    apart = rows.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high").select("key")
    return rows.join(apart, "key", "left_semi")


def met_pairs(rows: DataFrame, marks: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b), a > b, of ids of different components in one bucket that may link by size and parity.

    rows: key, id, comp. Near copies share most of their keys. Each row carries its id's ``FIRST`` smallest keys, and a
    bucket leaves a pair out that shares a smaller one of these, since it is met there: each pair comes at least once, and
    those with many keys in common about once.
    """
    first = rows.groupBy("id").agg(F.slice(F.sort_array(F.collect_set("key")), 1, FIRST).alias("first"))
    rows = written(gathered(rows.join(marks, "id").join(first, "id"), "key"), "marked")
    x, y = rows.alias("x"), rows.alias("y")
    here = F.coalesce(F.array_min(F.array_intersect("x.first", "y.first")), F.col("x.key")) >= F.col("x.key")
    pairs = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.comp") < F.col("y.comp")) & may_link("x", "y", num, den) & here)
    return pairs.select(F.greatest("x.id", "y.id").alias("a"), F.least("x.id", "y.id").alias("b"))


def ngram_jaccard_join(docs: DataFrame, *, words: int = 5, num: int = 80, den: int = 100, rounds: int = 3) -> DataFrame:
    """Links documents whose sets of ``words``-word shingles have den * |x & y| >= num * |x | y|.

    docs: doc_id, text; other columns, of any name, come back unchanged. Adds n_shingles (set size) and
    component_id (smallest doc_id reachable by links). Shingles are compared by 64-bit hashes.

    Equal sets are one class from the start, so copies cost one row each. In each of ``rounds``, every
    component compares one leader with one leader of another component that shares its buckets, and what
    links is united. Then members of one bucket which no link joins yet are compared with one another
    behind an exact lower bound of their difference; no link that could join components is lost. No bucket is capped.

    Null or empty text, or white space alone: n_shingles 0, component_id = doc_id, no link. A null
    doc_id: component_id null, no link. Rows of one doc_id count as one document, by any of their
    texts. An empty table gives an empty result.
    """
    size_name, comp_name = fresh(docs, "n_shingles"), fresh(docs, "component_id")
    sig = written(gathered(signatures(docs, words), "doc_id"), "signatures")
    known = sig.where("n_shingles > 0 and doc_id is not null")
    bands = Bands.make(num, den, known.agg(F.max("n_shingles")).first()[0] or 0)
    reps = known.groupBy("h1", "h2").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("n_shingles").alias("size"))
    below = F.filter(F.array(*map(F.lit, bands.low)), lambda x: x <= F.col("size"))
    reps = written(reps.withColumn("band", F.size(below) - 1), "classes")
    plain = docs.select("doc_id", "text").where("doc_id is not null")
    bands = allocated(plain, reps, bands, words)

    copies = reps.where("copies > 1").select("h1", "h2", "rep")
    several = known.groupBy("doc_id").agg(F.min("h1").alias("x"), F.max("h1").alias("y")).where("x <> y").select("doc_id")
    others = known.join(copies, ["h1", "h2"]).where("doc_id <> rep").select("doc_id", "rep")
    same = others.join(several, "doc_id", "left_semi").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    spare = written(others.join(several, "doc_id", "left_anti").select("doc_id").distinct(), "spare")
    singles = plain.join(F.broadcast(spare) if spare.count() <= BROADCAST_IDS else spare, "doc_id", "left_anti")
    marks = known.select(F.col("doc_id").alias("id"), F.col("n_shingles").alias("size"), *MARKS)

    bucket = Window.partitionBy("key")
    met = index_keys(singles, words, bands, often_shared(singles, words, bands))
    met = met.withColumn("other", F.min("id").over(bucket) != F.max("id").over(bucket)).where("other").drop("other")
    rows = written(gathered(met.withColumn("comp", F.col("id")), "key"), "met")
    links, tested = same, None
    for turn in range(rounds):
        pairs = written(leading_pairs(rows, marks, turn + 1, num, den), "pairs")
        tested = pairs.select("a", "b") if tested is None else tested.unionByName(pairs.select("a", "b"))
        good = written(gathered(verified(pairs.select("a", "b").distinct(), docs, words, num, den), "a", "b"), "links")
        links = links.unionByName(good)
        rows = written(gathered(united(rows, pairs.join(good, ["a", "b"]).select("comp", "into")), "key"), "apart")

    pairs = written(met_pairs(rows, marks, num, den).distinct(), "pairs")
    linked = components(links.unionByName(verified(pairs.join(tested.distinct(), ["a", "b"], "left_anti"), docs, words, num, den)))

    label = (
        sig.join(copies, ["h1", "h2"], "left")
        .select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.coalesce("rep", "doc_id")).otherwise(F.col("doc_id")).alias("id"))
        .join(linked, "id", "left")
        .select("doc_id", "n_shingles", F.coalesce("component_id", F.when(F.col("doc_id").isNotNull(), F.col("id"))).alias("component_id"))
    )
    if set(docs.columns) == {"doc_id", "text"}:
        return label
    key = fresh(docs, "id_of_label")
    label = label.groupBy(F.col("doc_id").alias(key)).agg(F.max("n_shingles").alias(size_name), F.min("component_id").alias(comp_name))
    return docs.join(label, docs["doc_id"].eqNullSafe(label[key]), "left").drop(key)
