"""Byte-level BPE encoding and decoding over a global shuffle of distinct words.

Texts are exploded into words with positions. A word here is a piece that the pre-tokenizer's pattern
can never match across (see textcodes.segment_edges), so encoding words one by one gives the text's
ids. The most frequent words of the whole corpus, ``HEAD`` words and ``HEAD_BYTES`` bytes at most, are encoded
once and reach every task as a small table; they also are the words whose copies would make hot keys. All others are
shuffled by word, encoded once each, and their ids joined back by document and position. Decoding takes each
id's bytes from the vocabulary's table, which tasks load from the rank file: a table of that size needs no join.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from . import textcodes as tc
from .shared import frequent, written

HEAD = 3 << 19  # the most frequent words that every task gets
HEAD_BYTES = 1 << 26  # their most bytes, with 16 added for each word; their ids take four times that at the very most
SLICE = 4096
NO_ID = -(1 << 63)  # stands for a null doc_id within a job


@lru_cache(2)
def encoder(path: str, pattern: str):
    """A tiktoken encoding of a rank file, and the bytes of each id."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    table = [b""] * (max(ranks.values()) + 1)
    for token, i in ranks.items():
        table[i] = token
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), table


def slices(batch: pa.RecordBatch, texts: int, most: int = 1 << 23):
    """The batch in parts of a bounded number of rows and, but for single long texts, bytes."""
    offsets, _ = tc.texts(batch.column(texts))
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, min(at + SLICE, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1))
        yield batch.slice(at, end - at)
        at = end


def word_counts(docs: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            for part in slices(batch, 0):
                words, _ = tc.pieces(part.column(0))
                n = np.bincount(words.indices.to_numpy(), minlength=len(words.dictionary))
                yield pa.RecordBatch.from_arrays([words.dictionary.cast(pa.string()), pa.array(n, pa.int64())], ["word", "n"])

    return docs.select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def encode_words(df: DataFrame, path: str, pattern: str, keep: str) -> DataFrame:
    """df: (word, ...) -> the columns of ``keep`` and ids (unsigned 32-bit numbers as bytes)."""
    names = [c.split()[0] for c in keep.split(", ")]

    def run(batches):
        enc = encoder(path, pattern)[0]
        for batch in batches:
            words = batch.column(batch.schema.get_field_index("word")).dictionary_encode()
            ids = pa.array([np.array(enc.encode_ordinary(w), "<u4").tobytes() for w in words.dictionary.to_pylist()], pa.binary())
            cols = [batch.column(batch.schema.get_field_index(n)) for n in names]
            yield pa.RecordBatch.from_arrays([*cols, ids.take(words.indices)], [*names, "ids"])

    return df.mapInArrow(run, f"{keep}, ids binary")


def varints(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers below 2**21 in one to three bytes of 7 bits, low first; and where each begins."""
    n = 1 + (x >= 1 << 7) + (x >= 1 << 14)
    at = np.r_[0, np.cumsum(n)]
    out = np.zeros(at[-1], np.uint8)
    for i in range(3):
        has = n > i
        out[at[:-1][has] + i] = (x[has] >> (7 * i) & 0x7F) | np.where(n[has] > i + 1, 0x80, 0)
    return out, at


def from_varints(b: np.ndarray) -> np.ndarray:
    ends = np.flatnonzero(b < 0x80)
    starts = np.r_[0, ends[:-1] + 1]
    out = (b[starts] & 0x7F).astype(np.int64)
    for i in (1, 2):
        has = ends - starts >= i
        out[has] |= (b[starts[has] + i].astype(np.int64) & 0x7F) << (7 * i)
    return out


class Head:
    """The frequent words' table in a task: word -> number, number -> ids."""

    def __init__(self, packed: bytes):
        table = pa.ipc.open_stream(packed).read_all()
        self.words = table["word"].combine_chunks()
        ids = table["ids"].combine_chunks()
        offsets = np.frombuffer(ids.buffers()[1], np.int32)[ids.offset : ids.offset + len(ids) + 1]
        self.ids = np.frombuffer(ids.buffers()[2] or b"", "<u4").astype(np.int64)
        self.edge = (offsets // 4).astype(np.int64)

    def gather(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the words, one after another, and each word's number of ids."""
        n = self.edge[numbers + 1] - self.edge[numbers]
        at = np.repeat(self.edge[numbers] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
        return self.ids[at], n


_heads: list = [None, None]


def head_of(shared) -> Head:
    """The table of a broadcast, built once in a worker."""
    value = shared.value
    if _heads[0] is not value:
        _heads[:] = value, Head(value)
    return _heads[1]


def bpe(docs: DataFrame, path: str, pattern: str, *, texts: bool = False) -> DataFrame:
    """Encodes every whole text and decodes the ids again.

    docs: doc_id, text. Gives doc_id, n_tokens, ids_sha256 (of the decimal ids joined by commas) and
    decoded_sha256 (of the decoded bytes); with ``texts`` also ids (array) and decoded (string). ids
    are those that tiktoken gives for the rank file at ``path`` (to be found there on every executor)
    and the pattern, without special tokens.

    A null or empty text has no ids; both hashes are then those of an empty string. Rows may repeat;
    each gives a row. A null doc_id is kept. An empty table gives no rows. Other columns of docs aren't returned.
    """
    spark = docs.sparkSession
    docs = docs.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id"), "text")
    counts = written(word_counts(docs).where("n > 1"), "word-counts")  # a word met once gains nothing there
    head = encode_words(frequent(counts, "n", HEAD, F.octet_length("word") + 16, HEAD_BYTES), path, pattern, "word string, n long").toArrow()
    head = head.sort_by([("n", "descending"), ("word", "ascending")]).select(["word", "ids"])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, head.schema) as out:
        out.write_table(head)
    shared = spark.sparkContext.broadcast(sink.getvalue().to_pybytes())

    def split(batches, cold: bool):
        """Documents as streams of word numbers (0: a rarer word), or the rarer words with positions."""
        table = head_of(shared)
        for batch in batches:
            for part in slices(batch, 1):
                offsets, b = tc.texts(part.column(1))
                words, first = tc.pieces(part.column(1))
                number = pc.index_in(words.dictionary.cast(table.words.type), table.words).fill_null(-1).to_numpy().astype(np.int64) + 1
                indices = words.indices.to_numpy()
                stream = number[indices]
                h = np.array([zlib.crc32(b[i:j]) for i, j in zip(offsets[:-1].tolist(), offsets[1:].tolist())], np.uint32).view(np.int32)
                if not cold:
                    b, at = varints(stream)
                    edge = at[first]
                    data = pa.Array.from_buffers(pa.large_binary(), part.num_rows, [None, pa.py_buffer(edge.astype(np.int64)), pa.py_buffer(b)]).cast(pa.binary())
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array(h), data], ["doc_id", "h", "stream"])
                    continue
                rare = np.flatnonzero(stream == 0)
                doc = np.searchsorted(first, rare, "right") - 1
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(doc)), pa.array(h[doc]), pa.array((rare - first[doc]).astype(np.int32)), words.dictionary.cast(pa.string()).take(pa.array(indices[rare]))],
                    ["doc_id", "h", "pos", "word"],
                )

    streams = docs.mapInArrow(lambda b: split(b, False), "doc_id long, h int, stream binary")
    rare = docs.mapInArrow(lambda b: split(b, True), "doc_id long, h int, pos int, word string")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    rare = rare.repartition(parts, "word").sortWithinPartitions("word")
    rare = encode_words(rare, path, pattern, "doc_id long, h int, pos int")
    rare = rare.repartition(parts, "doc_id", "h").groupBy("doc_id", "h").agg(F.collect_list(F.struct("pos", "ids")).alias("rare"))
    rare = rare.select("doc_id", "h", F.array_sort(F.array_distinct("rare")).alias("rare"))
    both = streams.join(rare, ["doc_id", "h"], "left")
    both = both.select(F.when(F.col("doc_id") != NO_ID, F.col("doc_id")).alias("doc_id"), "stream", F.transform("rare", lambda r: r["ids"]).alias("rare"))

    def assemble(batches):
        table, tokens = head_of(shared), encoder(path, pattern)[1]
        names = [str(i) for i in range(len(tokens))]
        for batch in batches:
            out = {"doc_id": batch.column(0), "n_tokens": [], "ids_sha256": [], "decoded_sha256": [], "ids": [], "decoded": []}
            for stream, extra in zip(batch.column(1), batch.column(2)):
                numbers = from_varints(np.frombuffer(stream.as_py(), np.uint8)) if len(stream.as_py()) else np.zeros(0, np.int64)
                ids, n = table.gather(np.maximum(numbers - 1, 0)) if len(table.words) else (np.zeros(0, np.int64), np.zeros(len(numbers), np.int64))
                holes = np.flatnonzero(numbers == 0)
                if len(holes):
                    own = [np.frombuffer(x.as_py(), "<u4") for x in extra.values]
                    ids = ids[np.repeat(numbers > 0, n)]
                    n[holes] = 0
                    before = np.r_[0, np.cumsum(n)][holes]
                    ids = np.insert(ids, np.repeat(before, [len(x) for x in own]), np.concatenate(own))
                ids = ids.tolist()
                decoded = b"".join([tokens[i] for i in ids])
                out["n_tokens"].append(len(ids))
                out["ids_sha256"].append(hashlib.sha256(",".join([names[i] for i in ids]).encode()).hexdigest())
                out["decoded_sha256"].append(hashlib.sha256(decoded).hexdigest())
                if texts:
                    out["ids"].append(ids)
                    out["decoded"].append(decoded.decode())
            yield pa.RecordBatch.from_pydict({k: v for k, v in out.items() if texts or k not in ("ids", "decoded")}, schema=kind)

    kind = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
    sql = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    if texts:
        kind = kind.append(pa.field("ids", pa.list_(pa.int32()))).append(pa.field("decoded", pa.string()))
        sql += ", ids array<int>, decoded string"
    return both.mapInArrow(assemble, sql)
