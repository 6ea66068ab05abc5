"""Vectorised word scanning over Arrow string columns.

Every operator that works on words needs the same three things: where the words of a whole text
are, a well mixed 64-bit hash of each, and hashes of runs of consecutive words.  Doing that with
Python strings costs about a microsecond a word; here one numpy pass over the column's UTF-8
buffer does it for a whole Arrow batch, so no per-word Python object is ever made.

UTF-8 never uses an ASCII byte inside a longer sequence, so classes that are defined by ASCII
separators can be applied to bytes: bytes from 0x80 up always belong to words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U64 = np.uint64

#: Odd multipliers (fixed values): the first two are the fractional parts of the golden ratio and
#: of sqrt(3), the last two finish the mixing as in the public splitmix64 generator.
GOLDEN = 0x9E3779B97F4A7C15
ROOT3 = 0xBB67AE8584CAA73B
MIX1 = 0xBF58476D1CE4E5B9
MIX2 = 0x94D049BB133111EB

#: Most bytes of text that are scanned at once; a longer single text is scanned alone.
SCAN_BYTES = 2 << 20
#: Bytes that are hashed at once; the tables of powers are of this size.
HASH_BYTES = 256 << 10


def separators(pattern: str) -> np.ndarray:
    """Byte table, True for word bytes.

    ``space``: words are runs of anything but space and U+0009-000D.
    ``alnum``: words are runs of ASCII digits, ASCII lower-case letters and non-ASCII.
    """
    table = np.ones(256, bool)
    if pattern == "space":
        table[[0x20, *range(0x09, 0x0E)]] = False
    elif pattern == "alnum":
        table[:0x80] = False
        table[0x30:0x3A] = True
        table[0x61:0x7B] = True
    else:
        raise ValueError(f"unknown word pattern {pattern!r}")
    return table


LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

SPACE_WORDS = separators("space")
ALNUM_WORDS = separators("alnum")

#: Modulus and bases of the two word polynomials: a Mersenne prime and two fixed numbers below it.
PRIME = (1 << 31) - 1
BASES = (1812433253, 1103515245)
#: Products of a byte and a power are below 2**40, so sums of this many need no reduction.
PLAIN_SUMS = 1 << 22

_tables: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """First n powers of a base modulo PRIME."""
    table = _tables.get(base)
    if table is None or len(table) < n:
        table, step = np.ones(1, U64), base
        while len(table) < n:
            table = np.concatenate([table, table * U64(step) % U64(PRIME)])
            step = step * step % PRIME
        _tables[base] = table
    return table[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser, in place on a fresh array."""
    h = h ^ (h >> U64(30))
    h *= U64(MIX1)
    h ^= h >> U64(27)
    h *= U64(MIX2)
    h ^= h >> U64(31)
    return h


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and int64 offsets of a string array; a null text is empty."""
    if texts.null_count:
        texts = texts.fill_null("")
    if not pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.large_string())
    _, off, data = texts.buffers()
    offsets = np.frombuffer(off, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    size = int(offsets[-1])
    raw = np.frombuffer(data, np.uint8)[:size] if data is not None and size else np.zeros(0, np.uint8)
    start = int(offsets[0])
    return raw[start:], offsets - start


@dataclass
class Words:
    """Words of a batch of texts, in order.

    ``begin``/``end``: byte range of each word; ``doc``: first word of each text (n + 1 entries);
    ``hash``: 64-bit hash of each word's (folded) bytes; ``raw``: the batch's bytes as scanned.
    """

    raw: np.ndarray
    offsets: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    hash: np.ndarray

    @property
    def n_docs(self) -> int:
        return len(self.offsets) - 1

    def counts(self) -> np.ndarray:
        return np.diff(self.doc)

    def owner(self) -> np.ndarray:
        """Text number of each word."""
        return np.repeat(np.arange(self.n_docs), self.counts())

    def word(self, i: int) -> bytes:
        return self.raw[self.begin[i] : self.end[i]].tobytes()


def scan(texts: pa.Array, table: np.ndarray, lower: bool) -> Words:
    """Finds and hashes the words of every text of an array.

    Hashing goes through the bytes in blocks that end between words, so that a long text needs a
    few bytes of memory a byte of text and not dozens.
    """
    raw, offsets = buffers(texts)
    if lower:
        raw = LOWER[raw]
    n = len(raw)
    inside = np.zeros(n + 2, bool)
    inside[1:-1] = table[raw]
    # A text that ends in a word next to another text's word has no change of class there.
    cuts = offsets[1:-1]
    joined = np.unique(cuts[inside[cuts] & inside[cuts + 1]])
    begins, ends, hashes = [], [], []
    at = 0
    while at < n:
        stop = min(at + HASH_BYTES, n)
        while stop < n and inside[stop + 1]:
            gap = np.flatnonzero(~inside[stop + 1 : stop + 1 + 65536])
            stop = min(stop + (int(gap[0]) if len(gap) else 65536), n)
        first = at + (at > 0)  # a later block starts at a separator: what ended there has been seen
        edge = np.flatnonzero(inside[first + 1 : stop + 2] != inside[first : stop + 1]) + first
        begin, end = edge[0::2], edge[1::2]
        own = joined[np.searchsorted(joined, at) : np.searchsorted(joined, stop)]
        if len(own):
            begin = np.sort(np.concatenate([begin, own]))
            end = np.sort(np.concatenate([end, own]))
        begins.append(begin)
        ends.append(end)
        hashes.append(_hash(raw[at:stop], begin - at, end - at))
        at = stop
    begin = np.concatenate(begins) if begins else np.zeros(0, np.int64)
    end = np.concatenate(ends) if ends else np.zeros(0, np.int64)
    value = np.concatenate(hashes) if hashes else np.zeros(0, U64)
    return Words(raw, offsets, begin, end, np.searchsorted(begin, offsets, side="left"), value)


def _hash(raw: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Two polynomials of each word's bytes modulo a prime, mixed to 64 bits.

    Unlike one modulo a power of two they have no words that collide whatever the base is.
    """
    n = len(raw)
    byte = raw.astype(U64) + U64(1)
    both = []
    for base in BASES:
        terms = byte * powers(base, n)
        if n > PLAIN_SUMS:
            terms %= U64(PRIME)
        prefix = np.zeros(n + 1, U64)
        np.cumsum(terms, out=prefix[1:])
        # Each polynomial is moved to exponent 0 by the inverse power of its word's start.
        start = powers(pow(base, -1, PRIME), n + 1)[begin]
        both.append((prefix[end] - prefix[begin]) % U64(PRIME) * start % U64(PRIME))
    return mix(both[0] << U64(31) | both[1])


def joined_hash(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hash of two neighbouring runs; order matters."""
    h = left * U64(GOLDEN)
    h ^= h >> U64(29)
    h += right
    h *= U64(MIX1)
    h ^= h >> U64(32)
    return h


def window_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of n consecutive words, by doubling; entry i is of words i .. i + n - 1."""
    if len(h) < n:
        return np.zeros(0, U64)
    out: np.ndarray | None = None
    done, size, level = 0, 1, h
    while True:
        if n & size:
            piece = level[done:] if done else level
            out = piece if out is None else joined_hash(out[: len(piece)], piece[: len(out)])
            done += size
        size *= 2
        if size > n:
            break
        half = size // 2
        level = joined_hash(level[:-half], level[half:])
    return mix(out[: len(h) - n + 1].copy())


def window_starts(doc: np.ndarray, n: int) -> np.ndarray:
    """Positions at which a window of n words of one text starts."""
    counts = np.maximum(np.diff(doc) - n + 1, 0)
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    first = np.repeat(doc[:-1] - (np.cumsum(counts) - counts), counts)
    return first + np.arange(total)


def slices(column: pa.Array, limit: int = SCAN_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most limit bytes of text each; a longer single text makes a range alone."""
    _, offsets = buffers(column)
    i, n = 0, len(column)
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def ranges(lengths: np.ndarray) -> np.ndarray:
    """0, 1, .. length - 1 for each of the lengths, one after the other."""
    total = int(lengths.sum())
    return np.arange(total) - np.repeat(np.cumsum(lengths) - lengths, lengths)
