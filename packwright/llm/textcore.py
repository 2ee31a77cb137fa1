"""Vectorised UTF-8 text primitives that the Arrow-batched operators share.

Texts are handled as one byte buffer a chunk: words, lines and their 64-bit hashes
come from numpy passes over the buffer, never from a Python loop over words.
A word is a maximal run of ``[^\\x20\\x09-\\x0D]``; A-Z count as lower case.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once; a longer text is a chunk of its own.
CHUNK_BYTES = 1 << 20

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Seeds of the independent hash lanes.
_LANES = (np.uint64(0x8EBC6AF09C88C6E3), np.uint64(0x589965CC75374CC3))
_ODDS = (np.uint64(0x9FB21C651E98DF25), np.uint64(0xD6E8FEB86659FD93))
#: Spans above this many bytes are hashed as a tree of pieces of that size.
LEAF = 256
#: The first n bytes of a little-endian word of eight.
_FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (the splitmix64 constants)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x = x * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@dataclass
class Chunk:
    """Some consecutive texts of a batch: rows [first, first + len(starts)) of it."""

    first: int
    buf: np.ndarray  # uint8
    starts: np.ndarray  # int64, where each text begins in buf
    ends: np.ndarray

    def __len__(self) -> int:
        return len(self.starts)

    def text(self, i: int) -> bytes:
        return self.buf[self.starts[i] : self.ends[i]].tobytes()

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of all words, and word offsets by text (len + 1 of them)."""
        solid = ~SPACE[self.buf]
        begins, finishes = solid.copy(), solid.copy()
        if len(solid):
            begins[1:] &= ~solid[:-1]
            finishes[:-1] &= ~solid[1:]
            some = self.ends > self.starts
            s, e = self.starts[some], self.ends[some] - 1
            begins[s] = solid[s]
            finishes[e] = solid[e]
        at = np.flatnonzero(begins)
        return at, np.flatnonzero(finishes) + 1, np.searchsorted(at, np.append(self.starts, self.ends[-1:] if len(self.ends) else [0]))


class SpanHash:
    """Hashes of arbitrary byte spans of a buffer, eight bytes a step of all spans at once.

    Each step mixes the bytes into the state through a bijection of 64 bits, so there is
    no algebra over positions that texts could be made to cancel in. Lanes (``which``)
    differ in seed and multiplier.
    """

    def __init__(self, buf: np.ndarray, lower: bool, which: int = 0):
        padded = np.zeros(len(buf) + 8, np.uint8)
        padded[: len(buf)] = LOWER[buf] if lower else buf
        self.eights = np.lib.stride_tricks.as_strided(padded.view(), (len(buf) + 1, 8), (1, 1)).view("<u8").reshape(-1) if len(buf) else np.zeros(1, np.uint64)
        self.which = which

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        n = ends - starts
        far = np.flatnonzero(n > LEAF)
        if not len(far):
            return self._leaves(starts, n)
        out = np.empty(len(n), np.uint64)
        near = np.flatnonzero(n <= LEAF)
        out[near] = self._leaves(starts[near], n[near])
        pieces = -(-n[far] // LEAF)
        stops = np.cumsum(pieces)
        inner = np.arange(stops[-1]) - np.repeat(stops - pieces, pieces)
        begins = np.repeat(starts[far], pieces) + LEAF * inner
        made = self._leaves(begins, np.minimum(LEAF, np.repeat(ends[far], pieces) - begins))
        above = SpanHash(made.view(np.uint8), False, self.which).of(8 * (stops - pieces), 8 * stops)
        out[far] = mix(above ^ (n[far].astype(np.uint64) * _ODDS[1 - self.which]))
        return out

    def _leaves(self, starts: np.ndarray, n: np.ndarray) -> np.ndarray:
        odd = _ODDS[self.which]
        acc = mix(n.astype(np.uint64) + _LANES[self.which])
        acc = mix((acc ^ (self.eights[starts] & _FIRST[np.minimum(n, 8)])) * odd)
        at, more = 8, np.flatnonzero(n > 8)
        while len(more):
            left = n[more] - at
            acc[more] = mix((acc[more] ^ (self.eights[starts[more] + at] & _FIRST[np.minimum(left, 8)])) * odd)
            at += 8
            more = more[left > 8]
        return acc


def chunks(texts: pa.Array | pa.ChunkedArray, limit: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """Cut a string column into chunks; null counts as the empty text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    if not len(texts):
        return
    _, offsets, data = texts.buffers()
    offs = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, "right")) - 1)
        yield Chunk(i, raw[offs[i] : offs[j]], offs[i:j] - offs[i], offs[i + 1 : j + 1] - offs[i])
        i = j


def word_hashes(c: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each word of a chunk, and the word offsets by text."""
    s, e, offs = c.words()
    return SpanHash(c.buf, lower=True).of(s, e), offs


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n words, runs over text boundaries included.

    Runs of 1, 2, 4, ... words are hashed from halves; n is put together from those.
    """
    m = max(0, len(words) - n + 1)
    odd = np.uint64(0x9FB21C651E98DF25)
    acc, at, size, run = np.full(m, n, np.uint64), 0, 1, words
    while size <= n and m:
        if n & size:
            acc = mix(acc * odd + run[at : at + m])
            at += size
        if 2 * size <= n:
            run = mix(run[:-size] * odd + run[size:])
        size *= 2
    return acc


def shingle_sets(c: Chunk, n: int) -> list[np.ndarray]:
    """Each text's set of n-word shingles as a sorted array of hashes.

    A text with fewer than n words has its whole word sequence as its only shingle, a
    text without words the empty set.
    """
    words, offs = word_hashes(c)
    grams = gram_hashes(words, n)
    out = []
    for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True):
        if b - a >= n:
            g = np.sort(grams[a : b - n + 1])
            keep = np.empty(len(g), bool)
            keep[0] = True
            np.not_equal(g[1:], g[:-1], out=keep[1:])
            out.append(g if keep.all() else g[keep])
        else:
            out.append(gram_hashes(words[a:b], b - a) if b > a else words[a:a])
    return out
