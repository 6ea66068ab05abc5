"""Repeated long spans by compaction of a de Bruijn graph of word windows.

The graph's edges are the windows of ``span`` consecutive words, its nodes the ``span - 1`` words
that neighbouring windows share.  Edges are never written one by one.  Each window chooses its
minimizer, the k-mer with the least hash in it, and the consecutive windows that choose the same
one make a *run*: a short path of the graph, known by the minimizer's hash, a hash of its words,
and source coordinates (document, place).  Equal windows choose equal minimizers, so a minimizer
that only one document holds rules out all of its runs.

1. An aggregate by minimizer finds those that more than one document holds, whether all their
   runs are equal, and whether the runs before and after are the same in all documents: then the
   nodes at both ends have one edge in and one edge out.  A join takes that back to the runs.
2. Compaction: such runs that follow each other in a document are one nonbranching path.  As a
   document ends, and its end counts as a branch, a nonbranching path lies whole in every document
   that holds any part of it, so each document finds the same paths by itself.
3. Where runs of one minimizer differ, which is at the ends of shared passages, runs are compared
   among each other, and of each different run the windows of its first document one by one.
4. Every path and every such window is looked up at its source coordinates, and the 128-bit digest
   of the very words there decides.  So a collision of the 64-bit hashes never removes a word;
   it can only hide that the path around it is repeated, at a chance of about 2**-53 a comparison.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import words
from .runtime import cut, dealt_anew, narrow, text_only

U64 = np.uint64
SPAN = 50
K = 24
#: Bits of a sliding key that hold the position; equal hashes go to the first position.
PLACE_BITS = 28
#: What is asked of a run: to be a span by itself, a part of a nonbranching path, or to give its
#: windows; a request is the run's place and one of these in the two lowest bits.
ALONE, INNER, WINDOWS = 0, 1, 2


def chosen(found: words.Words, span: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Window starts of a batch, and the position of the minimizer that each window chose."""
    starts = words.window_starts(found.doc, span)
    if not len(starts):
        return starts, starts
    kmer = words.window_hashes(found.hash, k)
    place = words.ranges(found.counts())[: len(kmer)].astype(U64) & U64((1 << PLACE_BITS) - 1)
    low = (kmer & ~U64((1 << PLACE_BITS) - 1)) | place
    width = span - k + 1
    size = 1
    while 2 * size <= width:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    if width > size:
        low = np.minimum(low[: len(low) - (width - size)], low[width - size :])
    least = low[starts] & U64((1 << PLACE_BITS) - 1)
    first = found.doc[:-1][np.searchsorted(found.doc, starts, side="right") - 1]
    at = first + least.astype(np.int64)
    # A text of more words than the places count wraps round; the k-mer is the next such place.
    at += -(-(np.maximum(starts - at, 0)) // (1 << PLACE_BITS)) * (1 << PLACE_BITS)
    return starts, at


class Runs:
    """Runs of a batch: first and last window, minimizer's position, document and word hash."""

    def __init__(self, found: words.Words, span: int, k: int) -> None:
        starts, at = chosen(found, span, k)
        fresh = np.ones(len(at), bool)
        fresh[1:] = at[1:] != at[:-1]
        first = np.flatnonzero(fresh)
        self.at = at[first]
        self.low = starts[first]
        self.high = starts[np.append(first[1:], len(starts)) - 1] if len(first) else starts
        self.own = np.searchsorted(found.doc, self.low, side="right") - 1
        self.place = self.at - found.doc[self.own]
        self.hash = _range_hash(found.hash, self.low, self.high + span, self.at - self.low)

    def around(self) -> np.ndarray:
        """A hash of the runs before and after each one; 0 stands for an end of the document."""
        before, after = np.zeros(len(self.at), U64), np.zeros(len(self.at), U64)
        same = self.own[1:] == self.own[:-1]
        before[1:][same] = self.hash[:-1][same]
        after[:-1][same] = self.hash[1:][same]
        return words.mix(words.joined_hash(before, after))

    def asked(self, codes: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the runs that requests are for, and what is asked of each.

        Other texts under a repeated doc_id may have no such run; their requests are left out.
        """
        order = np.lexsort((self.place, self.own))
        key = self.own[order] * (1 << 32) + self.place[order]
        want = doc * (1 << 32) + (codes >> 2)
        at = np.searchsorted(key, want)
        known = np.flatnonzero(np.append(key, -1)[at] == want)
        return order[at[known]], codes[known] & 3


def _range_hash(h: np.ndarray, low: np.ndarray, high: np.ndarray, lead: np.ndarray) -> np.ndarray:
    """Hashes of the word ranges [low, high), with the place of the minimizer in them."""
    n = high - low
    out = words.mix(n.astype(U64) * U64(words.GOLDEN) + lead.astype(U64))
    level, size = h, 1
    while size <= int(n.max(initial=0)):
        # Each range is the join of its binary parts, the largest ones last.
        take = np.flatnonzero(n & size)
        done = n[take] & (size - 1)
        out[take] = words.joined_hash(out[take], level[low[take] + done])
        size *= 2
        if size <= len(h):
            level = words.joined_hash(level[: -(size // 2)], level[size // 2 :])
    return words.mix(out)


def runs_of(docs: DataFrame, span: int, k: int, around: bool) -> DataFrame:
    """(mini, run, around, doc_id, place) of all runs; around, if asked for, in place of place."""
    kind = "mini long, run long, doc_id long, " + ("around long" if around else "place int")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for i, j in words.slices(batch.column(1)):
                found = words.scan(batch.column(1).slice(i, j - i), words.SPACE_WORDS, False)
                own = Runs(found, span, k)
                if not len(own.at):
                    continue
                mini = words.window_hashes(found.hash, k)[own.at]
                last = own.around().view(np.int64) if around else own.place.astype(np.int32)
                yield pa.record_batch([pa.array(mini.view(np.int64)), pa.array(own.hash.view(np.int64)), pa.array(ids[i:j][own.own]), pa.array(last)], ["mini", "run", "doc_id", "around" if around else "place"])

    return docs.mapInArrow(narrow(run), kind)


def requests(plain: DataFrame, span: int, k: int) -> DataFrame:
    """(id, asked): what is asked of each document's runs, in one row for each document.

    The runs of all documents are found twice, once to be counted and once to be joined, as that
    takes less disk than keeping them.
    """
    agree = lambda c: F.min(c) == F.max(c)
    known = runs_of(plain, span, k, True).groupBy("mini").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), agree("run").alias("equal"), agree("around").alias("inner"))
    known = known.where("first < last").select("mini", "equal", (F.col("equal") & F.col("inner")).alias("inner"))
    met = runs_of(plain, span, k, False).join(dealt_anew(known), "mini")
    met = cut(met.select("doc_id", "place", "inner", F.when(~F.col("equal"), F.col("run")).alias("run")))
    code = lambda kind: (F.col("place").cast("long") * 4 + kind).alias("asked")
    whole = met.where("run is null").select("doc_id", code(F.when(F.col("inner"), INNER).otherwise(ALONE)))
    mixed = met.where("run is not null").select("run", "doc_id", "place")
    ends = mixed.groupBy("run").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
    placed = mixed.join(dealt_anew(ends), "run")
    # A run of several documents is a span by itself; its first document, which does not lose it
    # whole, gives its windows.
    both = F.array(F.when(F.col("first") < F.col("last"), F.lit(ALONE)), F.when(F.col("doc_id") == F.col("first"), F.lit(WINDOWS)))
    mixed = placed.select("doc_id", "place", F.explode(F.array_compact(both)).alias("kind")).select("doc_id", code(F.col("kind")))
    return whole.unionAll(mixed).groupBy(F.col("doc_id").alias("id")).agg(F.collect_list("asked").alias("asked"))


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values of a list column one after the other, and the row of each; null is no value."""
    counts = np.asarray(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), np.int64)
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.int64), np.repeat(np.arange(len(counts)), counts)


def _spans_asked(found: words.Words, own: Runs, codes: np.ndarray, doc: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """Word ranges [a, b) of the batch that are asked for: paths, runs and single windows."""
    number, kind = own.asked(codes, doc)
    # Neighbouring inner runs of a document are one path; a run that stands alone is its own.
    inner = np.unique(number[kind == INNER])
    fresh = np.ones(len(inner), bool)
    fresh[1:] = (inner[1:] != inner[:-1] + 1) | (own.own[inner[1:]] != own.own[inner[:-1]])
    first = np.flatnonzero(fresh)
    begin = np.concatenate([inner[first], number[kind == ALONE]])
    end = np.concatenate([inner[np.append(first[1:], len(inner)) - 1] if len(first) else inner, number[kind == ALONE]])
    window = number[kind == WINDOWS]
    size = own.high[window] - own.low[window] + 1
    single = np.repeat(own.low[window], size) + words.ranges(size)
    return np.concatenate([own.low[begin], single]), np.concatenate([own.high[end], single]) + span


def _digests(found: words.Words, low: np.ndarray, high: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """128-bit digests, as two numbers each, of the words [low, high) joined by single spaces."""
    out = bytearray()
    order = np.argsort(doc, kind="stable")
    last, text, at = -1, memoryview(b""), []
    for x in order.tolist():
        d = int(doc[x])
        if d != last:
            last = d
            text = memoryview(b" ".join(found.raw[found.offsets[d] : found.offsets[d + 1]].tobytes().split()))
            base = int(found.doc[d])
            at = np.concatenate([[0], np.cumsum(found.end[base : found.doc[d + 1]] - found.begin[base : found.doc[d + 1]] + 1)]).tolist()
        out += hashlib.blake2b(text[at[low[x] - base] : at[high[x] - base] - 1], digest_size=16).digest()
    digest = np.empty((len(low), 2), np.int64)
    digest[order] = np.frombuffer(bytes(out), np.int64).reshape(-1, 2)
    return digest


SPANS = "d1 long, d2 long, doc_id long, a int, b int"


def spans_at(docs: DataFrame, span: int, k: int) -> DataFrame:
    """(d1, d2, doc_id, a, b): digests of the word ranges that docs' ``asked`` asks for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, asked = batch.column("doc_id").to_numpy(), batch.column("asked")
            for i, j in words.slices(batch.column("text")):
                found = words.scan(batch.column("text").slice(i, j - i), words.SPACE_WORDS, False)
                low, high = _spans_asked(found, Runs(found, span, k), *_lists(asked.slice(i, j - i)), span)
                doc = np.searchsorted(found.doc, low, side="right") - 1
                digest = _digests(found, low, high, doc)
                a, b = (low - found.doc[doc]).astype(np.int32), (high - found.doc[doc]).astype(np.int32)
                yield pa.record_batch([pa.array(digest[:, 0]), pa.array(digest[:, 1]), pa.array(ids[i:j][doc]), pa.array(a), pa.array(b)], ["d1", "d2", "doc_id", "a", "b"])

    return docs.select("doc_id", "text", "asked").mapInArrow(narrow(run), SPANS)


def marks(plain: DataFrame, span: int, k: int) -> DataFrame:
    """(id, a, b): for each document the word ranges to remove, as two lists."""
    # Without a checkpoint in between, one plan reads the texts' exchange again and again; the
    # spans are looked up once to be counted and once to be joined.
    asked = requests(plain, span, k)
    found = spans_at(plain.join(asked, F.col("doc_id") == F.col("id")), span, k)
    first = found.groupBy("d1", "d2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").drop("last")
    gone = found.join(dealt_anew(first), ["d1", "d2"]).where("doc_id > first")
    return gone.groupBy(F.col("doc_id").alias("id")).agg(F.collect_list("a").alias("a"), F.collect_list("b").alias("b"))


def _covered(found: words.Words, a: pa.Array, b: pa.Array) -> np.ndarray:
    """True for each word that a range to remove covers."""
    change = np.zeros(len(found.hash) + 1, np.int64)
    for column, step in ((a, 1), (b, -1)):
        places, doc = _lists(column)
        np.add.at(change, found.doc[doc] + np.minimum(places, found.counts()[doc]), step)
    return np.cumsum(change)[:-1] > 0


def remove_spans(docs: DataFrame, span: int = SPAN, k: int = K, digest: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed and the kept words joined by spaces, for every row of docs.

    Words are runs of anything but ASCII space.  A word goes if a window of ``span`` consecutive
    words covers it whose sequence also starts in a document with a smaller doc_id.  Windows are
    judged on the input.  ``digest``: the SHA-256 of the kept text takes its place.

    Null and empty texts and texts of fewer words than a window lose nothing.  Rows with a null
    doc_id neither lose words nor make others lose any.  Rows that repeat a doc_id are one
    document and should repeat its text: they don't make each other lose words, and what one of
    them loses goes at the same places of the others.  If their texts differ, ranges beyond the
    end of a text are ignored.  Extra columns are not read.
    """
    # Both joins with texts are by doc_id over the same rows, so texts are dealt out once.
    plain = text_only(docs).where("doc_id is not null")
    both = plain.join(marks(plain, span, k), F.col("doc_id") == F.col("id"), "left").select("doc_id", "text", "a", "b")
    none = F.lit(None).cast("array<int>")
    both = both.unionAll(text_only(docs).where("doc_id is null").select("doc_id", "text", none.alias("a"), none.alias("b")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in words.slices(batch.column("text")):
                part = batch.slice(i, j - i)
                found = words.scan(part.column("text"), words.SPACE_WORDS, False)
                gone = _covered(found, part.column("a"), part.column("b"))
                total = np.concatenate([[0], np.cumsum(gone)])[found.doc]
                kept = []
                for d in range(found.n_docs):
                    a, b = found.doc[d], found.doc[d + 1]
                    if total[d] == total[d + 1]:
                        text = b" ".join(found.raw[found.offsets[d] : found.offsets[d + 1]].tobytes().split())
                    else:
                        stay = np.flatnonzero(~gone[a:b]) + a
                        text = b" ".join([found.word(x) for x in stay])
                    kept.append(hashlib.sha256(text).hexdigest() if digest else text.decode())
                yield pa.record_batch([part.column("doc_id"), pa.array(found.counts(), pa.int64()), pa.array(np.diff(total), pa.int64()), pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", "kept"])

    return both.mapInArrow(narrow(run), "doc_id long, n_words long, n_removed long, kept string")
