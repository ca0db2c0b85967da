"""BPE encoding and decoding with a contiguous rank array.

A word is held as its parts side by side and the ranks of the adjacent pairs: the smallest rank (the
leftmost of equal ones) is found by a scan, the boundary within that pair is deleted, and the two ranks
beside it are looked up again, until no pair has a rank. Words of the same length form a matrix, so each
step scans and shortens all of them together. Words of more than ``SHORT`` bytes, where repeated scans
would take quadratic time, go through a heap of pairs instead, with the same merges in the same order.
Tasks work on documents independently (no shuffle) and keep the ids of a bounded number of pieces.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import textcodes as tc
from .bpe import slices
from .huffman import added_tokens, tokenizer

SHORT = 128
CELLS = 1 << 20  # of a matrix of words
KNOWN = 1 << 19  # pieces whose ids a worker keeps
NONE = np.iinfo(np.int32).max


def byte_alphabet() -> dict[str, int]:
    """The character that stands for each byte in byte-level vocabularies: printable ones themselves, the others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Merges:
    """A vocabulary and its merges: what a byte starts as, and the rank and result of each pair of ids."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges") if model.get(k)]
        if model["type"] != "BPE" or odd:
            raise ValueError(f"{path} isn't a plain BPE model: {model['type']} {odd}")
        vocab, suffix = model["vocab"], model.get("end_of_word_suffix") or ""
        alphabet = byte_alphabet()
        self.bytes_of = str.maketrans({c: chr(b) for c, b in alphabet.items()})
        self.inner, self.last = np.full(256, -1, np.int64), np.full(256, -1, np.int64)
        for c, b in alphabet.items():
            self.inner[b], self.last[b] = vocab.get(c, -1), vocab.get(c + suffix, -1)
        self.pairs: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.pairs[vocab[a], vocab[b]] = rank, vocab[a + b]
        keys = np.array([a << 32 | b for a, b in self.pairs], np.int64)
        order = np.argsort(keys)
        self.keys = np.r_[keys[order], np.iinfo(np.int64).max]
        self.rank = np.r_[np.array([r for r, _ in self.pairs.values()], np.int32)[order], np.int32(NONE)]
        self.made = np.r_[np.array([i for _, i in self.pairs.values()], np.int64)[order], -1]
        self.tokens = {i: t for t, i in vocab.items()}

    def ranks(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (NONE: no merge) and result of each pair."""
        key = a << 32 | b
        at = np.searchsorted(self.keys, key)
        found = self.keys[at] == key
        return np.where(found, self.rank[at], np.int32(NONE)), np.where(found, self.made[at], -1)

    def starts(self, words: np.ndarray) -> np.ndarray:
        """Ids of the bytes of words of one length (rows)."""
        ids = self.inner[words]
        ids[:, -1] = self.last[words[:, -1]]
        return ids

    def merge_all(self, words: np.ndarray) -> list[bytes]:
        """The ids (unsigned 32-bit numbers) of words of one length, given as a matrix of bytes."""
        out = [b""] * len(words)
        parts, who = self.starts(words), np.arange(len(words))
        rank, made = self.ranks(parts[:, :-1], parts[:, 1:])
        while len(who):
            ended = rank.min(axis=1) == NONE if rank.shape[1] else np.ones(len(who), bool)
            done, size = parts[ended], 4 * parts.shape[1]
            if (done >= 0).all():
                data = done.astype("<u4").tobytes()
                for i, row in enumerate(who[ended].tolist()):
                    out[row] = data[i * size : i * size + size]
            else:  # bytes that the vocabulary lacks
                for row, ids in zip(who[ended].tolist(), done):
                    out[row] = ids[ids >= 0].astype("<u4").tobytes()
            live = ~ended
            who, parts, rank, made = who[live], parts[live], rank[live], made[live]
            if not len(who):
                break
            rows, at = np.arange(len(who)), rank.argmin(axis=1)  # the leftmost of the smallest
            parts[rows, at] = made[rows, at]
            keep = np.ones(parts.shape, bool)
            keep[rows, at + 1] = False
            parts = parts[keep].reshape(len(who), -1)
            gap = np.ones(rank.shape, bool)
            gap[rows, at] = False
            rank, made = (x[gap].reshape(len(who), -1) for x in (rank, made))
            for side in (at - 1, at):  # the pairs on both sides of the new part
                there = np.flatnonzero((side >= 0) & (side < rank.shape[1]))
                col = side[there]
                rank[there, col], made[there, col] = self.ranks(parts[there, col], parts[there, col + 1])
        return out

    def merge_long(self, word: bytes) -> bytes:
        """The ids of one long word: pairs in a heap, by rank and position."""
        ids = self.starts(np.frombuffer(word, np.uint8)[None])[0]
        ids = ids[ids >= 0].tolist()
        before, after = list(range(-1, len(ids) - 1)), [*range(1, len(ids)), -1]
        heap = [(*self.pairs[p], i, *p) for i, p in enumerate(zip(ids, ids[1:])) if p in self.pairs]
        heapq.heapify(heap)
        while heap:
            _, made, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j < 0 or ids[j] != b:  # one of the two has been merged meanwhile
                continue
            ids[i], ids[j], after[i] = made, -1, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for left in (before[i], i):
                right = after[left] if left >= 0 else -1
                if right >= 0 and (p := (ids[left], ids[right])) in self.pairs:
                    heapq.heappush(heap, (*self.pairs[p], left, *p))
        return np.array([i for i in ids if i >= 0], "<u4").tobytes()

    def encode_words(self, words: list[bytes]) -> list[bytes]:
        out = [b""] * len(words)
        lengths = np.array([len(w) for w in words], np.int64)
        for n in np.unique(lengths).tolist():
            same = np.flatnonzero(lengths == n)
            if n > SHORT:
                for i in same.tolist():
                    out[i] = self.merge_long(words[i])
                continue
            rows = max(1, CELLS // max(n, 1))
            for at in range(0, len(same), rows) if n else ():
                part = same[at : at + rows].tolist()
                matrix = np.frombuffer(b"".join([words[i] for i in part]), np.uint8).reshape(-1, n)
                for i, ids in zip(part, self.merge_all(matrix)):
                    out[i] = ids
        return out


merges = lru_cache(1)(Merges)


@lru_cache(1)
def ascii_words(path: str) -> re.Pattern | None:
    """The pre-tokenizer's pattern for lower-case ASCII, if it is a pattern whose matches are the words and nothing else changes ASCII texts."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)
    steps = [{k: v for k, v in s.items() if k in ("type", "behavior", "invert", "use_regex", "add_prefix_space")} for s in (model["pre_tokenizer"] or {}).get("pretokenizers", [])]
    plain = steps == [{"type": "Split", "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "use_regex": False}]
    if not plain or {n["type"] for n in (model["normalizer"] or {}).get("normalizers", [])} != {"NFC", "Replace", "Lowercase"}:
        return None
    pattern = model["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"].replace(r"\p{L}", "a-zA-Z").replace(r"\p{N}", "0-9")
    return None if r"\p" in pattern else re.compile(pattern)


def words_of(piece: str, tok, table: dict, plain: re.Pattern | None) -> list[bytes]:
    """The pre-tokenizer's words of a piece (lower-case but for letters beyond ASCII), as bytes."""
    if plain and piece.isascii() and piece.isprintable():
        return [w.encode() for w in plain.findall(piece)]
    text = tok.normalizer.normalize_str(piece) if tok.normalizer else piece
    return [w.translate(table).encode("latin-1") for w, _ in tok.pre_tokenizer.pre_tokenize_str(text)]


_known: dict[str, bytes] = {}


def encode_pieces(table: list[str], path: str) -> list[bytes]:
    """Each piece's ids as unsigned 32-bit numbers."""
    new = [w for w in table if w not in _known]
    if len(_known) + len(new) > KNOWN:  # bounds what a worker keeps
        _known.clear()
        new = table
    tok, m, plain = tokenizer(path), merges(path), ascii_words(path)
    whole = {t.content: i for i, t in tok.get_added_tokens_decoder().items()}
    found: dict[bytes, int] = {}
    for at in range(0, len(new), 50_000):
        part = new[at : at + 50_000]
        found.clear()
        lists = [[] if p in whole else [found.setdefault(w, len(found)) for w in words_of(p, tok, m.bytes_of, plain)] for p in part]
        ids = m.encode_words(list(found))
        for p, words in zip(part, lists):
            _known[p] = np.array([whole[p]], "<u4").tobytes() if p in whole else b"".join([ids[w] for w in words])
    return [_known[w] for w in table]


def encode_texts(column: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all texts one after another, and where each text's begin (n + 1)."""
    pieces, first = tc.pieces(column, plain=True, keep=added_tokens(path))
    coded = encode_pieces(pieces.dictionary.to_pylist(), path)
    size = np.array([len(x) // 4 for x in coded], np.int64)
    edge = np.r_[0, np.cumsum(size)]
    stream = pieces.indices.to_numpy()
    n = size[stream]
    begins = np.r_[0, np.cumsum(n)]
    ids = np.frombuffer(b"".join(coded), "<u4")
    return ids[np.repeat(edge[stream] - begins[:-1], n) + np.arange(begins[-1])], begins[first]


def token_texts(path: str) -> list[str | None]:
    """The vocabulary's text of each id, added tokens included."""
    texts = merges(path).tokens | {i: t.content for i, t in tokenizer(path).get_added_tokens_decoder().items()}
    return [texts.get(i) for i in range(max(texts) + 1)]


def decode(ids: list[int], texts: list[str | None]) -> str:
    """Without a decoder of its own, a vocabulary's tokens are put side by side with a space between them."""
    return " ".join([texts[i] for i in ids])


def rank_bpe(docs: DataFrame, path: str, *, texts: bool = False) -> DataFrame:
    """Encodes every whole text with the BPE vocabulary at ``path`` and decodes the ids again.

    docs: doc_id, text. Gives doc_id, n_tokens, ids_sha256 (of the decimal ids joined by one space) and
    decoded_sha256 (of the decoded text in UTF-8); with ``texts`` also ids (array) and decoded. The
    normaliser and the pre-tokenizer are the vocabulary's own; its added tokens are found in raw text.
    The file has to be found there on every executor, and have no decoder and no post-processing of its own.

    A null or empty text has no ids; both hashes are then those of an empty string. Rows may repeat, doc_id
    may be null; each row gives one. An empty table gives no rows. Other columns of docs aren't returned.
    A text of any length is one row of one task.
    """

    def run(batches):
        if tokenizer(path).decoder is not None:
            raise ValueError(f"{path} has a decoder, which isn't built here")
        names, numbers = token_texts(path), [str(i) for i in range(1 << 16)]
        for batch in batches:
            for part in slices(batch, 1):
                ids, begins = encode_texts(part.column(1), path)
                ids, begins = ids.tolist(), begins.tolist()
                out: dict[str, list] = {"n_tokens": [], "ids_sha256": [], "decoded_sha256": [], "ids": [], "decoded": []}
                for a, b in zip(begins[:-1], begins[1:]):
                    own = ids[a:b]
                    decoded = decode(own, names)
                    out["n_tokens"].append(b - a)
                    out["ids_sha256"].append(hashlib.sha256(" ".join([numbers[i] if i < 1 << 16 else str(i) for i in own]).encode()).hexdigest())
                    out["decoded_sha256"].append(hashlib.sha256(decoded.encode()).hexdigest())
                    if texts:
                        out["ids"].append(own)
                        out["decoded"].append(decoded)
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(out[f.name], f.type) for f in kind)], ["doc_id", *kind.names])

    kind = pa.schema([("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
    sql = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    if texts:
        kind = kind.append(pa.field("ids", pa.list_(pa.int32()))).append(pa.field("decoded", pa.string()))
        sql += ", ids array<int>, decoded string"
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text").mapInArrow(run, sql)
