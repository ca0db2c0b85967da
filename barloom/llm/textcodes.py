"""Vectorised helpers over UTF-8 bytes, for use inside Arrow functions.

Hashes are 64 bits wide; two different words or shingles of a corpus of d distinct ones share a
hash with a probability of about d*d / 2**65.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa

U = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BASE = 0x9E3779B97F4A7C15 | 1
_powers = np.ones(1, U), np.ones(1, U)


def mix(x: np.ndarray) -> np.ndarray:
    """An avalanche over 64 bits (xor-shift and multiply)."""
    x = x.astype(U, copy=True)
    for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> U(shift)
        x *= U(by)
    return x ^ (x >> U(31))


CODE = mix(np.arange(1, 257, dtype=U) * U(BASE))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < n."""
    global _powers
    if len(_powers[0]) < n:
        size = max(1 << 16, 1 << int(n - 1).bit_length())
        _powers = tuple(
            np.multiply.accumulate(np.r_[U(1), np.full(size - 1, b, U)]) for b in (U(BASE), U(pow(BASE, -1, 1 << 64)))
        )
    return _powers[0][:n], _powers[1][:n]


def texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (n + 1) and bytes of a string column, nulls as empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return offsets, np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)


def word_spans(b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes other than 0x20 and 0x09-0x0D."""
    edge = np.diff(np.r_[True, SPACE[b], True].view(np.int8))
    return np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)


def span_hashes(b: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes, from one running polynomial."""
    up, down = powers(len(b) + 1)
    run = np.zeros(len(b) + 1, U)
    np.cumsum(CODE[b] * up[:-1], out=run[1:])
    return mix((run[ends] - run[starts]) * down[starts] + (ends - starts).astype(U) * U(0xD6E8FEB86659FD93))


def distinct(x: np.ndarray) -> np.ndarray:
    """Sorted distinct values; a plain sort, which is faster here than numpy's hashing unique()."""
    x = np.sort(x)
    return x[np.r_[True, x[1:] != x[:-1]]] if len(x) else x


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles; fewer words than k make one shingle, none make none."""
    if not len(words):
        return words
    n = min(k, len(words))
    h = np.zeros(len(words) - n + 1, U)
    for i in range(n):
        h = mix(h + words[i : len(words) - n + 1 + i] * U(2 * i + 3))
    return distinct(h + U(n - k & 0xFFFF))


def word_spans_of_texts(b: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As word_spans, for texts one after another at ``offsets`` (n + 1): no word reaches over an edge."""
    word = np.r_[False, ~SPACE[b], False]
    edge = np.zeros(len(b) + 1, bool)
    edge[offsets] = True
    return np.flatnonzero(word[1:] & (~word[:-1] | edge)), np.flatnonzero(word[:-1] & (~word[1:] | edge))


def shingle_sets(words: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """As shingles, for texts whose words begin at ``first`` (n + 1): edges and, between them, each text's set."""
    count = np.diff(first)
    h = np.zeros(max(0, len(words) - k + 1), U)
    for i in range(k if len(h) else 0):
        h = mix(h + words[i : len(words) - k + 1 + i] * U(2 * i + 3))
    out = []
    for i, n in zip(first.tolist(), count.tolist()):
        out.append(np.sort(h[i : i + n - k + 1]) if n >= k else shingles(words[i : i + n], k))
    edges = np.r_[0, np.cumsum([len(x) for x in out])].astype(np.int64)
    flat = np.concatenate([*out, np.zeros(0, U)])
    keep = np.r_[True, flat[1:] != flat[:-1]][: len(flat)]
    keep[edges[:-1][np.diff(edges) > 0]] = True
    return np.r_[0, np.cumsum(keep)][edges], flat[keep]


def sums(x: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Sums modulo 2**64 between edges."""
    run = np.r_[U(0), np.cumsum(x, dtype=U)]
    return run[edges[1:]] - run[edges[:-1]]


def segment_edges(b: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where texts can be cut into pieces that a tokenizer encodes one by one.

    A cut lies before white space of one byte that follows a character which isn't white space, and at
    the edges of texts: no match of the pre-tokenizer's pattern reaches over it. ``b``: the bytes of the
    texts at ``offsets``; returns offsets of the pieces, which cover all bytes.
    """
    space = SPACE[b]
    at = np.flatnonzero(space[1:] & ~space[:-1]) + 1
    one, two, three = b[at - 1], b[np.maximum(at - 2, 0)], b[np.maximum(at - 3, 0)]
    wide = (two == 0xC2) & ((one == 0x85) | (one == 0xA0))
    wide |= (three == 0xE2) & (two == 0x80) & ((one <= 0x8A) | (one == 0xA8) | (one == 0xA9) | (one == 0xAF))
    wide |= (three == 0xE2) & (two == 0x81) & (one == 0x9F)
    wide |= ((three == 0xE1) & (two == 0x9A) | (three == 0xE3) & (two == 0x80)) & (one == 0x80)
    cut = np.zeros(len(b) + 1, bool)
    cut[at[~wide]] = cut[offsets] = True
    return np.flatnonzero(cut)


#: ASCII signs that no match of a letters-or-signs pattern shares with letters; the apostrophe isn't one.
SIGN = np.zeros(256, bool)
SIGN[[*range(33, 39), *range(40, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
LETTER = np.zeros(256, bool)
LETTER[97:123] = True


def pieces(column: pa.Array, *, plain: bool = False, keep: re.Pattern | None = None) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The pieces of all texts of a column, dictionary-encoded, and each text's first piece (n + 1).

    ``plain``: for tokenizers that ignore letter case and white space and split letters from signs; fewer
    different pieces result. With it, each match of ``keep`` (over bytes) within a text is a piece as it stands.
    """
    offsets, b = texts(column)
    base, b = offsets[0], b[offsets[0] : offsets[-1]]
    offsets = offsets - base
    edges = segment_edges(b, offsets) if len(b) else np.zeros(1, np.int64)
    if plain and len(b):
        kept = [m.span() for i, j in zip(offsets[:-1].tolist(), offsets[1:].tolist()) for m in keep.finditer(b, i, j)] if keep else []
        raw, b = b, LOWER[b]
        b[SPACE[b]] = 32
        letter, sign = LETTER[b], SIGN[b]
        cut = np.zeros(len(b) + 1, bool)
        cut[1:-1] = letter[:-1] & sign[1:] | sign[:-1] & letter[1:]
        cut[edges] = True
        for i, j in kept:
            b[i:j] = raw[i:j]
            cut[i + 1 : j], cut[i], cut[j] = False, True, True
        edges = np.flatnonzero(cut)
    arr = pa.LargeStringArray.from_buffers(len(edges) - 1, pa.py_buffer(edges.astype(np.int64)), pa.py_buffer(b))
    return arr.dictionary_encode(), np.searchsorted(edges, offsets)
