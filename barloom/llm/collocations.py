"""Phrase collocations by partitioning (SON): shards are mined completely at a lowered support, then candidates are counted.

The texts of a language are dealt into N shards of bounded size. With support s, a shard reports every phrase
that it holds at least t = ceil(s / N) times: a phrase that no shard reports has at most N * (t - 1) < s
occurrences. What the shards report also bounds a phrase's count from above, by its reported counts and t - 1
for each shard that is silent; the union of all phrases whose bound reaches s are the candidates. In a second
pass over all shards the candidates are counted exactly, by their texts; a bitmap of fixed size tells the tasks
which phrases may be candidates, and what gets through it by chance falls short of the support or is counted
exactly as well. Both passes deal the texts anew, so that each phrase's count leaves a shard once. Within a shard phrases grow word by word (only what is frequent is extended), and are told
apart by numbers that follow from the words themselves, not by hashes.
"""

import hashlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from . import textcodes as tc
from .bpe import slices
from .shared import written

U = np.uint64
SHARD = 64 << 20  # bytes of text in a shard
LEAST = 4  # shards of a language that has an eighth of those bytes for each
BITS = 1 << 27  # of the bitmap at the most; it has 16 for each candidate below that
LANGS = 10_000  # languages whose table is broadcast

BREAK = np.zeros(256, bool)
BREAK[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
GAP = BREAK.copy()
GAP[[0x20, 0x09]] = True


def spans(column: pa.Array) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """The words of a slice of texts: their codes, the coded words, and whether the next word is in the same piece."""
    offsets, b = tc.texts(column)
    base, b = offsets[0], tc.LOWER[b[offsets[0] : offsets[-1]]]
    offsets = offsets - base
    word, edge = np.r_[False, ~GAP[b], False], np.zeros(len(b) + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(word[1:] & (~word[:-1] | edge))
    sizes = np.flatnonzero(word[:-1] & (~word[1:] | edge)) - starts
    marks = np.union1d(np.flatnonzero(BREAK[b]), offsets)
    piece = np.searchsorted(marks, starts, "right")
    at = np.r_[0, np.cumsum(sizes)].astype(np.int64)
    coded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(at), pa.py_buffer(b[word[1:-1]])]).dictionary_encode()
    return coded.indices.to_numpy(), coded.dictionary.to_pylist(), np.r_[piece[1:] == piece[:-1], False][: len(piece)]


class Words:
    """The words of texts one after another: numbers by a dictionary, and which have their right neighbour in the same piece.

    Texts come in slices, whose bytes are let go; four bytes and a flag stay for each word.
    """

    def __init__(self, columns: Iterable[pa.Array]):
        known: dict[bytes, int] = {}
        self.words: list[bytes] = []
        numbers, joined, hashes, first, total = [np.zeros(0, np.int32)], [np.zeros(0, bool)], [np.zeros(0, U)], [np.zeros(0, np.int64)], 0
        for column in columns:
            codes, table, near = spans(column)
            new = [w for w in table if w not in known]
            known.update(zip(new, range(len(known), len(known) + len(new))))
            number = np.array([known[w] for w in table], np.int32)
            if new:
                ends = np.cumsum([len(w) for w in new])
                hashes.append(tc.span_hashes(np.frombuffer(b"".join(new), np.uint8), np.r_[0, ends[:-1]], ends))
                # codes are numbered as they appear
                fresh = np.flatnonzero(np.diff(np.maximum.accumulate(codes), prepend=-1))
                first.append(total + fresh[number >= len(self.words)])
            self.words += new
            numbers.append(number[codes])
            joined.append(near)
            total += len(codes)
        self.number, self.joined, self.hash, self.first = map(np.concatenate, (numbers, joined, hashes, first))

    def hashes(self, at: np.ndarray, size: int, seed: U) -> np.ndarray:
        """64-bit hashes of the phrases of ``size`` words that begin at words ``at``."""
        h = np.full(len(at), U(size)) * U(tc.BASE) + seed
        for i in range(size):
            h = tc.mix(h + self.hash[self.number[at + i]] * U(2 * i + 3))
        return h

    def phrases(self, longest: int, keep: Callable) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(words, where phrases first begin, their counts), for phrases of 1 to ``longest`` words, in parts.

        keep(size, first, counts) says which of some distinct phrases go on; a phrase of more words is looked at
        only where both its parts without the last and without the first word went on. Phrases are numbered
        from the pair of numbers of these two parts; pairs are sorted in parts by their first number.
        """
        counts = np.bincount(self.number, minlength=len(self.words))
        kept = keep(1, self.first, counts)
        yield 1, self.first[kept], counts[kept]
        ids = np.where(kept, np.cumsum(kept) - 1, -1).astype(np.int32)[self.number]
        parts = 8 if len(ids) > 1 << 20 else 1
        for size in range(2, longest + 1):
            longer, n = np.full(len(ids), -1, np.int32), 0
            live = (ids[:-1] >= 0) & (ids[1:] >= 0) & self.joined[:-1]
            for part in range(parts):
                at = np.flatnonzero(live & ((ids[:-1] & parts - 1) == part))
                pair = ids[at].astype(np.int64) << 32 | ids[at + 1]
                order = np.argsort(pair, kind="stable")
                new = np.r_[True, np.diff(pair[order]) != 0][: len(order)]
                first, counts = at[order[new]], np.diff(np.flatnonzero(np.r_[new, True]))
                kept = keep(size, first, counts)
                yield size, first[kept], counts[kept]
                longer[at[order]] = np.where(kept, n + np.cumsum(kept) - 1, -1)[np.cumsum(new) - 1] if len(at) else 0
                n += int(kept.sum())
            if not n:
                return
            ids = longer

    def texts(self, at: np.ndarray, size: int) -> list[bytes]:
        words, number = self.words, self.number
        return [b" ".join([words[j] for j in number[i : i + size]]) for i in at.tolist()]


def language_seed(lang: str) -> U:
    return U(int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little"))


def words_of(batches: Iterator[pa.RecordBatch]) -> Words:
    return Words(part.column(0) for batch in batches for part in slices(batch.select(["text"]), 0))


def candidates_of(dealt: DataFrame, longest: int, support: int) -> DataFrame:
    """Hashes (h) of all phrases of up to ``longest`` words that may occur ``support`` times in their language.

    dealt: lang, shard, n_shards, text. A hash stands for a phrase and its language; phrases that share one add up, so none is lost.
    """

    def mine(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lang, parts = key[0].as_py(), key[2].as_py()
        least, seed = -(-support // parts), language_seed(lang)
        words = words_of(batches)
        for size, at, counts in words.phrases(longest, lambda size, first, counts: counts >= least):
            base = np.full(len(at), parts * (least - 1), np.int64)
            yield pa.RecordBatch.from_pydict({"h": words.hashes(at, size, seed).view(np.int64), "more": (counts - (least - 1)).astype(np.int64), "base": base})

    reported = dealt.groupBy("lang", "shard", "n_shards").applyInArrow(mine, "h long, more long, base long")
    bound = reported.groupBy("h").agg(F.sum("more").alias("more"), F.max("base").alias("base"))
    return bound.where(F.col("more") + F.col("base") >= support).select("h")


def bitmap(candidates: DataFrame, n: int) -> np.ndarray:
    """A bit for each candidate's hash; 64-bit words of it are put together by Spark, BITS / 64 of them at the most."""
    bits = min(BITS, 1 << max(16, (16 * n).bit_length()))
    slots = candidates.select(F.col("h").bitwiseAND(bits - 1).alias("slot"))
    filled = slots.groupBy(F.expr("shiftright(slot, 6)").alias("at")).agg(F.expr("bit_or(shiftleft(1L, cast(slot & 63L as int)))").alias("bits")).toArrow()
    out = np.zeros(bits >> 6, np.int64)
    out[filled["at"].to_numpy()] = filled["bits"].to_numpy()
    return out.view(U)


def collocations(docs: DataFrame, *, longest: int = 5, support: int = 100, scale: int = 1000, cover: int = 100, top: int | None = 2000, shard_bytes: int = SHARD) -> DataFrame:
    """Phrases of 2 to ``longest`` words that occur at least ``support`` times in their language, by the strength of their weakest cut.

    docs: text, lang (null: ``und``). Texts are lower-cased (A-Z), split at ``.,;:!?`` and line ends into pieces and at
    blanks and tabs into words; a null or empty text has none. With n words in the language and f(phrase) contiguous
    occurrences within pieces (overlaps count), a phrase with a = f(phrase) that is cut after its first k words has
    l = f(first part), r = f(rest) and the score floor(scale * a * n / (l * r)); its lowest-scoring cut counts, the
    smallest k of equal ones. A phrase that lies contiguously within a longer one with 100 * f(longer) >= cover * a is left
    out. Gives lang, rank (from 1), phrase, a, l, r, n, score, by descending score, then a, then phrase; ``top`` rows of
    each language, None for all. All arithmetic is exact (38 digits).

    Repeated rows each count. An empty table, or one without frequent phrases, gives no rows. Other columns are left out.
    A text longer than ``shard_bytes`` is a shard of its own. When a language has more than ``support`` shards, they
    report all their phrases, which then is a plain count of hashes.
    """
    spark = docs.sparkSession
    docs = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    sizes = docs.groupBy("lang").agg(F.sum(F.octet_length("text").cast("long")).alias("bytes"))
    shards = F.greatest(F.lit(1), F.ceil(F.col("bytes") / shard_bytes), F.least(F.lit(LEAST), F.ceil(8 * F.col("bytes") / shard_bytes)))
    langs = written(sizes.select("lang", shards.cast("int").alias("n_shards")), "langs")
    few = langs.count() <= LANGS
    texts = docs.where("text <> ''").join(F.broadcast(langs) if few else langs, "lang")
    # by the row's place: copies don't meet in one shard
    dealt = texts.select("lang", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.col("n_shards")).cast("int").alias("shard"), "n_shards", "text")
    found = written(candidates_of(dealt, longest, support), "candidates")
    shared = spark.sparkContext.broadcast(bitmap(found, found.count()))

    def count(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, lang = shared.value, key[0].as_py()
        mask, seed = U(len(bits) * 64 - 1), language_seed(key[0].as_py())
        words = words_of(batches)

        def may_be(size, first, counts):
            slot = words.hashes(first, size, seed) & mask
            return (bits[slot >> U(6)] >> (slot & U(63)) & U(1)).astype(bool)

        def rows(size, phrases, counts):
            cols = [pa.array([lang] * len(phrases), pa.string()), pa.array(np.full(len(phrases), size, np.int32)), pa.array(phrases, pa.binary()).cast(pa.string()), pa.array(counts, pa.int64())]
            return pa.RecordBatch.from_arrays(cols, ["lang", "words", "phrase", "n"])

        yield rows(0, [b""], [len(words.number)])
        for size, at, counts in words.phrases(longest, may_be):
            yield rows(size, words.texts(at, size), counts.astype(np.int64))

    counted = dealt.groupBy("lang", "shard", "n_shards").applyInArrow(count, "lang string, words int, phrase string, n long").groupBy("lang", "words", "phrase").agg(F.sum("n").alias("n"))
    counted = written(counted.where(F.col("n") >= F.when(F.col("words") > 0, support).otherwise(1)), "phrases")
    return ranked(counted, scale, cover, top, few)


def ranked(counted: DataFrame, scale: int, cover: int, top: int | None, few: bool) -> DataFrame:
    """Scores, covered phrases left out, the best of each language. counted: lang, words (0: all words of the language), phrase, n."""
    totals = counted.where("words = 0").select("lang", F.col("n").alias("total"))
    phrases = counted.where("words > 0").select("lang", "words", "phrase", "n")
    long = phrases.where("words > 1")
    split = F.split("phrase", " ")
    inner = long.where("words > 2").select(
        "lang", "n", F.explode(F.array(F.array_join(F.slice(split, 1, F.col("words") - 1), " "), F.array_join(F.slice(split, 2, F.col("words") - 1), " "))).alias("phrase")
    )  # what any longer phrase covers, one of one more word covers as well
    inner = inner.groupBy("lang", "phrase").agg(F.max("n").alias("cover"))
    long = long.join(inner, ["lang", "phrase"], "left").where(F.coalesce(100 * F.col("cover") < cover * F.col("n"), F.lit(True))).drop("cover")
    cuts = long.withColumn("parts", F.split("phrase", " ")).select(
        "lang", "phrase", F.col("n").alias("a"), "words", "parts", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k")
    )
    cuts = cuts.select(
        "lang", "phrase", "a", "k", F.array_join(F.slice("parts", 1, F.col("k")), " ").alias("first"), F.array_join(F.slice("parts", F.col("k") + 1, F.col("words") - F.col("k")), " ").alias("rest")
    )
    known = phrases.select("lang", F.col("phrase").alias("first"), F.col("n").alias("l"))
    cuts = cuts.join(known, ["lang", "first"]).join(known.withColumnsRenamed({"first": "rest", "l": "r"}), ["lang", "rest"])
    cuts = cuts.join(F.broadcast(totals) if few else totals, "lang")
    exact = lambda c: F.col(c).cast("decimal(38,0)")
    cuts = cuts.withColumn("over", exact("a") * exact("total") * scale).withColumn("under", exact("l") * exact("r")).withColumn("score", F.expr("over div under"))
    lowest = cuts.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r", F.col("total").alias("n"))).alias("s")).select("lang", "phrase", "s.*")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    best = lowest.withColumn("rank", F.row_number().over(order))
    if top is not None:
        best = best.where(F.col("rank") <= top)
    return best.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
