"""Token ids in a compact binary table: canonical length-limited Huffman codes with checkpoints.

Format: a Parquet table of independent blocks, written by Spark where the path points, and a code book.
A block holds up to ``BLOCK`` ids of consecutive documents (longer documents have blocks of their own):
start (ids before it), payload (bits, high first), checkpoints (the bit offset of every ``STEP``-th id),
and for each document its doc_id, the ids here, before this block and in all. The book has one code length for each id, from which the codes follow (canonical: by length,
then id). Decoding looks up 16 bits at a time, all checkpoints of a block side by side.
"""

from __future__ import annotations

import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import textcodes as tc
from .bpe import slices
from .shared import written

LONGEST = 16
BLOCK, STEP = 1 << 16, 1 << 7
KNOWN = 1_000_000  # pieces whose ids a worker keeps
JOINED = 256  # pieces that the library encodes as one text


@lru_cache(1)
def tokenizer(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(1)
def added_tokens(path: str) -> re.Pattern | None:
    """Matches the tokenizer's added tokens, which the library looks for in raw text before all else, the longest first."""
    added = tokenizer(path).get_added_tokens_decoder().values()
    for t in added:  # others could match elsewhere, or arise where letters are lower-cased
        if t.normalized or t.lstrip or t.rstrip or t.single_word or not re.search(r"[a-z][!-&(-/:-@\[-`{-~]|[!-&(-/:-@\[-`{-~][a-z]", t.content):
            raise ValueError(f"added token {t.content!r} can't be told from the text around it")
    contents = sorted((t.content.encode() for t in added), key=len, reverse=True)
    return re.compile(b"|".join(map(re.escape, contents))) if contents else None


_known: dict[str, bytes] = {}


def encode_pieces(parts: list[str], path: str) -> list[bytes]:
    """Each piece's ids as unsigned 16-bit numbers.

    ``JOINED`` pieces at a time are one text with an added token between them, since the library takes longer for many
    short texts; it looks for added tokens before all else, so pieces don't touch.
    """
    tok = tokenizer(path)
    added = {t.content: i for i, t in tok.get_added_tokens_decoder().items()}
    plain = [w for w in parts if w not in added]
    ids_of = {w: np.array([added[w]], np.uint16).tobytes() for w in parts if w in added}
    if added:
        between, mark = min(added.items())
        texts = [between.join([*plain[i : i + JOINED], ""]) for i in range(0, len(plain), JOINED)]
        ids = np.concatenate([np.zeros(0, np.uint16), *(np.array(e.ids, np.uint16) for e in tok.encode_batch_fast(texts, add_special_tokens=False))])
        ends = np.flatnonzero(ids == mark)
        if len(ends) == len(plain):
            data, begin = ids.tobytes(), 0
            for w, end in zip(plain, (2 * ends).tolist()):
                ids_of[w], begin = data[begin:end], end + 2
            return [ids_of[w] for w in parts]
    # no added token, or one that the pieces hold otherwise
    for w, e in zip(plain, tok.encode_batch_fast(plain, add_special_tokens=False)):
        ids_of[w] = np.array(e.ids, np.uint16).tobytes()
    return [ids_of[w] for w in parts]


def encode_texts(column: pa.Array, path: str, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all texts, each with the end id, and where each text begins (n + 1)."""
    words, first = tc.pieces(column, plain=True, keep=added_tokens(path))
    table = words.dictionary.to_pylist()
    new = [w for w in table if w not in _known]
    if len(_known) + len(new) > KNOWN:  # bounds what a worker keeps
        _known.clear()
        new = table
    for at in range(0, len(new), 20_000):
        part = new[at : at + 20_000]
        _known.update(zip(part, encode_pieces(part, path)))
    coded = [_known[w] for w in table]
    n = np.array([len(x) // 2 for x in coded] + [1], np.int64)
    ids = np.r_[np.frombuffer(b"".join(coded), np.uint16), np.array([end], np.uint16)].astype(np.int64)
    edge = np.r_[0, np.cumsum(n)]
    # each text's pieces, then the end id as one more piece
    stream = np.insert(words.indices.to_numpy(), first[1:], len(table)).astype(np.int64)
    size = n[stream]
    begins = np.r_[0, np.cumsum(size)]
    at = np.repeat(edge[stream] - begins[:-1], size) + np.arange(begins[-1])
    return ids[at], begins[first + np.arange(len(first))]


def code_lengths(counts: np.ndarray, longest: int = LONGEST) -> np.ndarray:
    """Optimal code lengths up to ``longest`` for all ids with a count: package-merge."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.uint8)
    if len(used) < 2:
        out[used] = 1
        return out
    if len(used) > 1 << longest:
        raise ValueError(f"{len(used)} ids don't fit in codes of {longest} bits")
    used = used[np.argsort(counts[used], kind="stable")]
    weights = counts[used].astype(np.int64)
    lists = [(weights, np.full(len(used), True))]  # per level: weights in order, and which are single ids
    for _ in range(longest - 1):
        last = lists[-1][0]
        pairs = last[: len(last) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.r_[weights, pairs]
        order = np.argsort(both, kind="stable")
        lists.append((both[order], order < len(weights)))
    take = 2 * len(used) - 2
    for _, single in reversed(lists):
        n = int(single[:take].sum())
        out[used[:n]] += 1
        take = 2 * (take - n)
    return out


def canonical(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each id's code, and for every 16 bits the id that they begin with and its length."""
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    n = lengths[order].astype(np.int64)
    width = np.int64(1) << (LONGEST - n)
    begin = np.r_[0, np.cumsum(width)[:-1]] if len(order) else np.zeros(0, np.int64)
    codes = np.zeros(len(lengths), np.int64)
    codes[order] = begin >> (LONGEST - n)
    symbol, size = np.zeros(1 << LONGEST, np.int32), np.ones(1 << LONGEST, np.int64)
    filled = int(width.sum())
    symbol[:filled] = np.repeat(order, width)
    size[:filled] = np.repeat(n, width)
    return codes, symbol, size


def pack(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The bits of the codes one after another, and the bit offset of each STEP-th id."""
    n = lengths[ids].astype(np.int64)
    ends = np.cumsum(n)
    starts = ends - n
    word, bit = starts >> 5, starts & 31
    wide = codes[ids].astype(np.uint64) << (64 - bit - n).astype(np.uint64)  # in place within the 64 bits from its word on
    out = np.zeros((int(ends[-1]) >> 5) + 2 if len(ids) else 2, np.uint64)
    np.add.at(out, word, wide >> np.uint64(32))
    np.add.at(out, word + 1, wide & np.uint64(0xFFFFFFFF))
    return out.astype(">u4").tobytes(), starts[::STEP].astype(np.int32)


def unpack(payload: bytes, checkpoints: np.ndarray, total: int, symbol: np.ndarray, size: np.ndarray) -> np.ndarray:
    words = np.frombuffer(payload, ">u4").astype(np.int64)
    at = checkpoints.astype(np.int64)
    out = np.zeros((STEP, len(at)), np.int32)
    for i in range(STEP):
        live = len(at) if (len(at) - 1) * STEP + i < total else len(at) - 1
        at = at[:live]
        word, bit = at >> 5, at & 31
        window = ((words[word] << 32 | words[word + 1]) >> (48 - bit)) & 0xFFFF
        out[i, :live] = symbol[window]
        at = at + size[window]
    return out.T.ravel()[:total]


def write_ids(docs: DataFrame, out: str, path: str, *, end: int = 1, parts: int | None = None) -> None:
    """Encodes every whole text (null: empty) and writes blocks and book under ``out`` in ascending doc_id order.

    docs: doc_id, text; other columns are left out. Rows with a null doc_id come first; rows that repeat
    a doc_id stand side by side in order of their texts. An empty table gives an empty set of blocks.
    """
    spark = docs.sparkSession
    n = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = docs.select("doc_id", "text").repartitionByRange(n, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first())

    def encode(batches):
        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            for piece in slices(batch, 1):
                ids, begins = encode_texts(piece.column(1), path, end)
                rows = piece.num_rows
                data = pa.Array.from_buffers(
                    pa.large_binary(), rows, [None, pa.py_buffer((begins * 2).astype(np.int64)), pa.py_buffer(ids.astype("<u2"))]
                ).cast(pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(rows, part), pa.int32()), pa.array(at + begins[:-1]), piece.column(0), data], ["part", "at", "doc_id", "ids"]
                )
                at += int(begins[-1])

    ids = written(docs.mapInArrow(encode, "part int, at long, doc_id long, ids binary"), "token-ids")

    def count(batches):
        total, held, many = np.zeros(1 << 16, np.int64), [], 0
        for batch in batches:
            for x in batch.column(0):  # a document at a time
                data = np.frombuffer(x.as_buffer(), "<u2")
                if len(data) < 1 << 14:  # short ones together, in less time than a count of each takes
                    held.append(data)
                    many += len(data)
                else:
                    total += np.bincount(data, minlength=1 << 16)
                if many >= 1 << 18:
                    total += np.bincount(np.concatenate(held), minlength=1 << 16)
                    held, many = [], 0
        if held:
            total += np.bincount(np.concatenate(held), minlength=1 << 16)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], ["id", "n"])

    counts = ids.select("ids").mapInArrow(count, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    dense = np.zeros(1 << 16, np.int64)
    dense[counts["id"].to_numpy(np.int64)] = counts["n"].to_numpy(np.int64)
    lengths = code_lengths(dense)
    spark.createDataFrame([(int(i), int(lengths[i])) for i in np.flatnonzero(lengths)], "id int, length int").coalesce(1).write.parquet(f"{out}/book")
    ends = ids.groupBy("part").agg(F.max(F.col("at") + F.expr("octet_length(ids) div 2")).alias("n")).collect()  # a row for each part
    before, so_far = {}, 0
    for part, n_ids in sorted(ends):
        before[part], so_far = so_far, so_far + n_ids
    shared = spark.sparkContext.broadcast((lengths.tobytes(), before))

    def blocks(batches):
        lengths, before = np.frombuffer(shared.value[0], np.uint8), shared.value[1]
        codes = canonical(lengths)[0]
        docs, held, expected = [], [], None  # docs: (doc_id, ids here, ids of it before, all its ids)

        def cut():
            data = np.concatenate(held)
            payload, marks = pack(data, codes, lengths)
            cols = [[x] for x in (expected - len(data), [d[0] for d in docs], *([int(d[i]) for d in docs] for i in (1, 2, 3)), marks.tobytes(), payload)]
            docs.clear()
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(cols, kind)], schema=kind)

        for batch in batches:
            for part, at, doc, data in zip(*(c.to_pylist() for c in batch.columns)):
                data, start = np.frombuffer(data, "<u2").astype(np.int64), before[part] + at
                if docs and (start != expected or sum(map(len, held)) + len(data) > BLOCK):
                    yield cut()
                expected = start
                for i in range(0, len(data), BLOCK):
                    if docs and i:
                        yield cut()
                    held.append(data[i : i + BLOCK])
                    docs.append((doc, len(held[-1]), i, len(data)))
                    expected += len(held[-1])
        if docs:
            yield cut()

    longs = pa.list_(pa.int64())
    kind = pa.schema([("start", pa.int64()), ("docs", longs), ("here", longs), ("before", longs), ("whole", longs), ("checkpoints", pa.binary()), ("payload", pa.binary())])
    ids.mapInArrow(blocks, "start long, docs array<long>, here array<long>, before array<long>, whole array<long>, checkpoints binary, payload binary").write.parquet(f"{out}/blocks")


def read_ids(spark: SparkSession, out: str) -> DataFrame:
    """The documents in the files under ``out``: doc_id, start, n_tokens, ids_crc32 (of the ids as unsigned 32-bit numbers, low byte first).

    Blocks are decoded one by one. The checksum of a document that goes over several blocks is put
    together from its pieces', so no task holds more ids than a block's.
    """
    book = spark.read.parquet(f"{out}/book").toPandas()
    lengths = np.zeros(1 << 16, np.uint8)
    lengths[book["id"].to_numpy(np.int64)] = book["length"].to_numpy(np.uint8)
    shared = spark.sparkContext.broadcast(lengths.tobytes())

    def decode(batches):
        _, symbol, size = canonical(np.frombuffer(shared.value, np.uint8))
        for batch in batches:
            for start, docs, here, before, whole, marks, payload in zip(*(c.to_pylist() for c in batch.columns)):
                edge = np.r_[0, np.cumsum(here)]
                data = unpack(payload, np.frombuffer(marks, np.int32), int(edge[-1]), symbol, size).astype("<u4")
                crc = [zlib.crc32(data[a:b].tobytes()) for a, b in zip(edge[:-1], edge[1:])]
                before = np.array(before, np.int64)
                cols = [docs, start + edge[:-1] - before, before, here, whole, crc]
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in cols], ["doc_id", "start", "before", "n", "n_tokens", "crc"])

    def joined(batches):
        for batch in batches:
            crc = []
            for row in batch.column(3).to_pylist():
                so_far = row[0]["crc"]
                for piece in row[1:]:  # by linearity: the sum so far moved over as many zero bytes, and the piece's own part
                    zeros = bytes(4 * piece["n"])
                    so_far = zlib.crc32(zeros, so_far) ^ zlib.crc32(zeros) ^ piece["crc"]
                crc.append(so_far)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    pieces = spark.read.parquet(f"{out}/blocks").mapInArrow(decode, "doc_id long, start long, before long, n long, n_tokens long, crc long")
    rows = pieces.groupBy("doc_id", "start", "n_tokens").agg(F.array_sort(F.collect_list(F.struct("before", "n", "crc"))).alias("pieces"))
    return rows.mapInArrow(joined, "doc_id long, start long, n_tokens long, ids_crc32 long")
