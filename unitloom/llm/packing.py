"""Packing of token ids into fixed-length sequences.

Two ways: best-fit-decreasing over blocks of documents as they are read (``pack_best_fit``), and
along a space-filling curve, so that documents of like content share a sequence
(``pack_along_curve``).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from ..session import small_batches
from . import words
from .bpe import default_path, encoded, encoder
from .runtime import narrow, shuffle_partitions, text_only

LENGTH = 2048
END_ID = 1
#: Tokens that best-fit-decreasing packs together.
BLOCK_TOKENS = 2 << 20


def id_type(path: str) -> np.dtype:
    """Little-endian type of the ids of a tokenizer."""
    model = encoder(path).model
    size = model.get_vocab_size() if hasattr(model, "get_vocab_size") else model.get_piece_size()
    return np.dtype("<u2") if size <= 1 << 16 else np.dtype("<u4")


class Capacities:
    """Open bins by what they have left, with the least sufficient capacity found in a tree.

    Leaves of the segment tree are capacities; a node holds the number of open bins below it.
    """

    def __init__(self, most: int) -> None:
        self.size = 1 << most.bit_length()
        self.count = [0] * (2 * self.size)
        self.bins: list[list[int]] = [[] for _ in range(most + 1)]

    def _change(self, capacity: int, by: int) -> None:
        at = capacity + self.size
        while at:
            self.count[at] += by
            at >>= 1

    def put(self, bin_: int, capacity: int) -> None:
        self.bins[capacity].append(bin_)
        self._change(capacity, 1)

    def take(self, least: int) -> tuple[int, int] | None:
        """Removes a bin of the least capacity that is large enough; (bin, capacity)."""
        at = least + self.size
        if not self.count[at]:
            # Up until a right sibling has bins, then down to its first one.
            while at > 1 and (at & 1 or not self.count[at + 1]):
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.size:
                at *= 2
                if not self.count[at]:
                    at += 1
        capacity = at - self.size
        self._change(capacity, -1)
        return self.bins[capacity].pop(), capacity


def best_fit(sizes: np.ndarray, most: int) -> list[list[int]]:
    """Items of each bin by best-fit-decreasing; no size is over most or under 1."""
    room, bins = Capacities(most), []
    for item in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[item])
        got = room.take(size)
        if got is None:
            got = len(bins), most
            bins.append([])
        bins[got[0]].append(item)
        if got[1] > size:
            room.put(got[0], got[1] - size)
    return bins


PACKED = "sequence_id long, n_tokens long, ids binary, cu_seqlens array<int>, position_resets array<int>, doc_ids array<long>, starts array<long>"


def pack_best_fit(docs: DataFrame, tokenizer: str | None = None, length: int = LENGTH, pad_id: int = 0, end_id: int | None = END_ID, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """One row for each packed sequence: a row of the id matrix and what is needed to undo it.

    ``ids``: ``length`` little-endian ids (16 bits if the vocabulary allows it, else 32), padded
    with ``pad_id`` after ``n_tokens``.  ``cu_seqlens``: 0 and the end of each segment.
    ``position_resets``: where position ids start again at 0, that is at each segment.
    ``doc_ids`` and ``starts``: the document of each segment, and its ids before the segment.

    A document is its ids and ``end_id`` (none if null).  One of more than ``length`` ids is cut
    into full sequences and a rest, so every id lies in exactly one segment.  Rests and short
    documents are packed by best-fit-decreasing in blocks of about ``block_tokens`` ids as they
    are read: no shuffle, bounded memory, and at most a few open sequences a block.
    sequence_id is unique; its high bits are the partition.

    Null and empty texts are ``end_id`` alone, and without one give no segment.  Null and repeated
    doc_ids are packed row by row.  An empty table gives no rows.
    """
    path = tokenizer or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = id_type(path)
        base = TaskContext.get().partitionId() << 40
        block = Block(kind, length, pad_id, base)
        for batch in batches:
            for i, j, ids, bound in encoded(path, batch.column(1)):
                names = batch.column(0).slice(i, j - i).to_pylist()
                for d, name in enumerate(names):
                    own = ids[bound[d] : bound[d + 1]]
                    block.add(name, own if end_id is None else np.append(own, np.uint32(end_id)))
                    if block.tokens >= block_tokens:
                        yield block.packed()
        if block.pieces:
            yield block.packed()

    return text_only(docs).mapInArrow(narrow(run), PACKED)


class Block:
    """Pieces that wait for being packed together."""

    def __init__(self, kind: np.dtype, length: int, pad_id: int, first: int) -> None:
        self.kind, self.length, self.pad, self.next = kind, length, pad_id, first
        self.pieces: list[tuple[int | None, int, np.ndarray]] = []
        self.tokens = 0

    def add(self, name: int | None, ids: np.ndarray) -> None:
        for start in range(0, len(ids), self.length):
            self.pieces.append((name, start, ids[start : start + self.length].astype(self.kind)))
        self.tokens += len(ids)

    def packed(self) -> pa.RecordBatch:
        sizes = np.fromiter((len(p[2]) for p in self.pieces), np.int64, len(self.pieces))
        bins = best_fit(sizes, self.length)
        matrix = np.full((len(bins), self.length), self.pad, self.kind)
        rows = []
        for row, items in enumerate(bins):
            ends = np.cumsum(sizes[items]).tolist()
            starts = [0, *ends[:-1]]
            for a, b, item in zip(starts, ends, items, strict=True):
                matrix[row, a:b] = self.pieces[item][2]
            rows.append((ends[-1], [0, *ends], starts, [self.pieces[x][0] for x in items], [self.pieces[x][1] for x in items]))
        n, cu, resets, names, starts = (list(x) for x in zip(*rows, strict=True))
        ids = pa.array([r.tobytes() for r in matrix], pa.binary())
        out = pa.record_batch(
            [pa.array(np.arange(len(bins)) + self.next, pa.int64()), pa.array(n, pa.int64()), ids, pa.array(cu, pa.list_(pa.int32())), pa.array(resets, pa.list_(pa.int32())), pa.array(names, pa.list_(pa.int64())), pa.array(starts, pa.list_(pa.int64()))],
            ["sequence_id", "n_tokens", "ids", "cu_seqlens", "position_resets", "doc_ids", "starts"],
        )
        self.next += len(bins)
        self.pieces, self.tokens = [], 0
        return out


def write_packed(packed: DataFrame, path: str) -> None:
    """Writes sequences where executors and readers share a path; a matrix row is one record."""
    packed.write.mode("overwrite").option("compression", "zstd").parquet(path)


def matrix(batch: pa.RecordBatch, kind: str = "<u2") -> tuple[np.ndarray, np.ndarray]:
    """Id matrix and position-id matrix of a batch of packed rows."""
    ids = np.stack([np.frombuffer(x, kind) for x in batch.column("ids").to_pylist()])
    positions = np.tile(np.arange(ids.shape[1]), (len(ids), 1))
    for row, cu in enumerate(batch.column("cu_seqlens").to_pylist()):
        for a, b in zip(cu[:-1], cu[1:], strict=True):
            positions[row, a:b] -= a
        positions[row, cu[-1] :] = 0
    return ids, positions


# --- along a space-filling curve ---------------------------------------------------------------

DIMS = 3
BITS = 10
#: Hash buckets of a document's word vector.
FEATURES = 4096
#: Cells of the curve by which text bytes are counted to deal out documents.
CELL_BITS = 12
TARGET_BYTES = 64 << 20
#: What a document counts for besides its bytes, so that many tiny ones are dealt out too.
DOCUMENT_BYTES = 256


def projection() -> np.ndarray:
    return np.random.default_rng(7).standard_normal((DIMS, FEATURES))


def coordinates(found: words.Words, table: np.ndarray) -> np.ndarray:
    """Each text's hashed word vector, scaled to mean, in few dimensions of BITS bits."""
    counts = np.maximum(found.counts(), 1)
    owner, bucket = found.owner(), (found.hash >> np.uint64(40)).astype(np.int64) % FEATURES
    out = np.empty((found.n_docs, DIMS), np.int64)
    for k in range(DIMS):
        mean = np.bincount(owner, table[k][bucket], minlength=found.n_docs) / counts
        out[:, k] = np.minimum((0.5 + np.arctan(4 * mean) / np.pi) * (1 << BITS), (1 << BITS) - 1)
    return out


def hilbert(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Place of each point on the Hilbert curve (Skilling's transposed form, 2004)."""
    x = points.T.astype(np.int64).copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            up = (x[i] & q) > 0
            t = np.where(up, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(up, x[0] ^ p, x[0] ^ t)
            x[i] ^= t
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[n - 1] & q) > 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for i in range(n):
            key = key << 1 | (x[i] >> bit & 1)
    return key


def curve_keys(texts: pa.Array, table: np.ndarray) -> np.ndarray:
    return hilbert(coordinates(words.scan(texts, words.ALNUM_WORDS, True), table))


@dataclass
class Deal:
    """Which partition each cell of the curve goes to; large cells go to several."""

    first: np.ndarray
    shares: np.ndarray
    parts: int

    def of(self, keys: np.ndarray, salt: np.ndarray) -> np.ndarray:
        cell = keys >> (DIMS * BITS - CELL_BITS)
        return self.first[cell] + (salt % self.shares[cell].astype(np.uint64)).astype(np.int64)


def deal(docs: DataFrame, target: int = TARGET_BYTES) -> Deal:
    """Cuts the curve into partitions of about equal text bytes.

    The bytes of each cell are summed over all documents; what comes to the driver is one row a
    cell, of which there are 2 ** CELL_BITS.  A cell of more than a partition's bytes, as copies
    of one text make it, is spread over several partitions by a hash of the id.
    """
    table = projection()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << CELL_BITS, np.int64)
        for batch in batches:
            for i, j in words.slices(batch.column(1)):
                texts = batch.column(1).slice(i, j - i)
                cell = curve_keys(texts, table) >> (DIMS * BITS - CELL_BITS)
                total += np.bincount(cell, np.diff(words.buffers(texts)[1]) + DOCUMENT_BYTES, minlength=len(total)).astype(np.int64)
        some = np.flatnonzero(total)
        yield pa.record_batch([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], ["cell", "n"])

    size = np.zeros(1 << CELL_BITS, np.int64)
    for row in docs.mapInArrow(narrow(run), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        size[row.cell] = row.n
    parts = max(shuffle_partitions(docs.sparkSession), -(-int(size.sum()) // target), 1)
    each = max(1, -(-int(size.sum()) // parts))
    first, shares = np.zeros(len(size), np.int64), np.ones(len(size), np.int64)
    part, room = 0, each
    for cell, n in enumerate(size.tolist()):
        if n > each:
            if room < each:
                part, room = part + 1, each
            first[cell], shares[cell] = part, -(-n // each)
            part, room = part + int(shares[cell]), each
            continue
        if n > room:
            part, room = part + 1, each
        first[cell] = part
        room -= n
    return Deal(first, shares, part + 1)


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"


def pack_along_curve(docs: DataFrame, tokenizer: str | None = None, length: int = LENGTH, end_id: int = END_ID, ids: bool = True) -> DataFrame:
    """One row for each piece of a document in a packed sequence.

    Documents are dealt out by ranges of their Hilbert keys and sorted by key in a partition, so
    neighbours on the curve, which have like words, follow each other.  They are laid end to end
    and cut every ``length`` ids.  What is left at the end of a partition goes into sequences of
    powers of two, which need no padding.

    ``ids``: the piece's little-endian ids (null if not asked for); ids_crc32 is always of 32-bit
    ids.  doc_tokens counts the document's ids with ``end_id``.  offset is the piece's place in its
    sequence; sequence_id is unique, with the partition in its high bits.

    Null and empty texts are ``end_id`` alone.  Null and repeated doc_ids are packed row by row;
    an empty table gives no rows.  Extra columns are not read.
    """
    path = tokenizer or default_path()
    small_batches(docs.sparkSession)
    plain = text_only(docs)
    plan, table = deal(plain), projection()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = id_type(path)
        end = np.array([end_id], kind).tobytes()
        for batch in batches:
            for i, j, flat, bound in encoded(path, batch.column(1)):
                names, texts = batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i)
                keys = np.concatenate([curve_keys(texts.slice(a, b - a), table) for a, b in words.slices(texts)])
                salt = words.mix(np.asarray(names.fill_null(-1).to_numpy(zero_copy_only=False), np.int64).view(np.uint64) + np.uint64(words.GOLDEN))
                raw = flat.astype(kind).tobytes()
                w = kind.itemsize
                own = [raw[a * w : b * w] + end for a, b in zip(bound[:-1].tolist(), bound[1:].tolist(), strict=True)]
                yield pa.record_batch([pa.array(plan.of(keys, salt), pa.int32()), pa.array(keys, pa.int64()), names, pa.array(own, pa.binary())], ["part", "key", "doc_id", "ids"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = id_type(path)
        sequence, at = TaskContext.get().partitionId() << 32, 0
        tail: list[tuple] = []  # pieces of the sequence that is being filled
        for batch in batches:
            out: list[tuple] = []
            for name, raw in zip(batch.column("doc_id").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                own = np.frombuffer(raw, kind)
                start = 0
                while start < len(own):
                    n = min(length - at, len(own) - start)
                    tail.append((name, start, own[start : start + n], len(own), sequence, at))
                    start, at = start + n, at + n
                    if at == length:
                        out += tail
                        tail, at, sequence = [], 0, sequence + 1
            yield pieces(out)
        yield pieces(list(recut(tail, at, sequence)))

    def pieces(rows: list[tuple]) -> pa.RecordBatch:
        crc = [zlib.crc32(r[2].astype("<u4").tobytes()) for r in rows]
        column = lambda k: pa.array([r[k] for r in rows], pa.int64())
        held = pa.array([r[2].tobytes() for r in rows], pa.binary()) if ids else pa.nulls(len(rows), pa.binary())
        return pa.record_batch([column(0), column(1), pa.array([len(r[2]) for r in rows], pa.int64()), pa.array(crc, pa.int64()), column(3), column(4), column(5), held], [x.split()[0] for x in PIECES.split(", ")])

    rows = plain.mapInArrow(narrow(encode), "part int, key long, doc_id long, ids binary")
    return rows.repartitionById(plan.parts, F.col("part")).sortWithinPartitions("key", "doc_id", "ids").mapInArrow(narrow(pack), PIECES)


def recut(tail: list[tuple], left: int, sequence: int) -> Iterator[tuple]:
    """Pieces of an unfilled sequence, cut into sequences of powers of two."""
    room = at = 0
    for name, start, own, total, _, _ in tail:
        done = 0
        while done < len(own):
            if at == room:
                if room:
                    sequence += 1
                room, at = 1 << (left.bit_length() - 1), 0
                left -= room
            n = min(room - at, len(own) - done)
            yield name, start + done, own[done : done + n], total, sequence, at
            done, at = done + n, at + n
