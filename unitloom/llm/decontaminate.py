"""Benchmark decontamination by a generalised suffix automaton of the benchmark's words.

The automaton accepts every run of consecutive words of every item.  Training words are streamed
through it; at each word it holds the longest run that ends there and also occurs in an item.
Where that reaches the window length, a window of an item ends, and the state tells which items
hold it.

Most training words can't take part: a window needs every pair of its neighbouring words to be a
pair of some item.  That test is one vectorised lookup, and only stretches that pass it go through
the automaton word by word.

The benchmark is cut into blocks of bounded size.  One block's automaton is built and broadcast at
a time, and what it finds is written before the next one's turn, so neither the driver nor executors
hold more than one, however large the benchmark is; the documents are read once a block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, functions as F

from . import words
from .runtime import cut, narrow, text_only

U64 = np.uint64
WINDOW = 10
#: Bytes of item text in one automaton.
BLOCK_BYTES = 512 << 10


class Automaton:
    """Generalised suffix automaton over word numbers, with the items of each state."""

    def __init__(self, items: list[tuple[str, str | None]], window: int) -> None:
        self.window = window
        self.names = [name for name, _ in items]
        found = words.scan(pa.array([text for _, text in items], pa.large_string()), words.ALNUM_WORDS, True)
        self.vocabulary, numbers = np.unique(found.hash, return_inverse=True)
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.items: list[set[int]] = [set()]
        #: Whole short items by the state that reads them.
        self.short: dict[int, set[int]] = {}
        pairs = []
        self.least = window
        sequences = [numbers[found.doc[i] : found.doc[i + 1]].tolist() for i in range(len(items))]
        for item, sequence in enumerate(sequences):
            if sequence:
                self.least = min(self.least, len(sequence))
                self._add(sequence, item)
                pairs.append(found.hash[found.doc[item] : found.doc[item + 1]])
        for item, sequence in enumerate(sequences):
            if 0 < len(sequence) < window:
                state = 0
                for w in sequence:
                    state = self.next[state][w]
                self.short.setdefault(state, set()).add(item)
        # Items of a state are those of the states whose runs end in its run; states of runs
        # shorter than a window are not asked for theirs.
        for state in sorted(range(1, len(self.link)), key=lambda s: -self.length[s]):
            if self.length[self.link[state]] >= window:
                self.items[self.link[state]] |= self.items[state]
        self.pairs = np.unique(np.concatenate([words.window_hashes(h, 2) for h in pairs])) if pairs else np.zeros(0, U64)
        self.ending: dict[int, tuple[int, frozenset[int]]] = {}

    def _state(self, length: int) -> int:
        self.next.append({})
        self.link.append(0)
        self.length.append(length)
        self.items.append(set())
        return len(self.link) - 1

    def _clone(self, state: int, length: int, last: int, word: int) -> int:
        copy = self._state(length)
        self.next[copy] = dict(self.next[state])
        self.link[copy] = self.link[state]
        self.link[state] = copy
        while last >= 0 and self.next[last].get(word) == state:
            self.next[last][word] = copy
            last = self.link[last]
        return copy

    def _add(self, sequence: list[int], item: int) -> None:
        last = 0
        for word in sequence:
            known = self.next[last].get(word)
            if known is not None:
                if self.length[known] != self.length[last] + 1:
                    known = self._clone(known, self.length[last] + 1, last, word)
                last = known
            else:
                new = self._state(self.length[last] + 1)
                at = last
                while at >= 0 and word not in self.next[at]:
                    self.next[at][word] = new
                    at = self.link[at]
                if at >= 0:
                    met = self.next[at][word]
                    if self.length[met] != self.length[at] + 1:
                        met = self._clone(met, self.length[at] + 1, at, word)
                    self.link[new] = met
                last = new
            self.items[last].add(item)

    def _ending(self, state: int, length: int) -> tuple[int, frozenset[int]]:
        """Length and items of the longest window that ends in a match of this state and length.

        A full window is the state's suffix of that length; whole short items are looked for on
        the suffix links.
        """
        found: set[int] = set()
        most = 0
        at, size = state, length
        while at > 0:
            if at in self.short and size >= self.length[at]:
                found |= self.short[at]
                most = max(most, self.length[at])
            at = self.link[at]
            size = self.length[at] if at >= 0 else 0
        if length >= self.window:
            at = state
            while self.length[self.link[at]] >= self.window:
                at = self.link[at]
            found |= {i for i in self.items[at]}
            most = self.window
        return most, frozenset(found)

    def windows(self, sequence: list[int]) -> Iterator[tuple[int, int, frozenset[int]]]:
        """(position, window length, items) wherever a window ends; -1 is a word of no item."""
        state = size = 0
        for i, word in enumerate(sequence):
            while state and word not in self.next[state]:
                state = self.link[state]
                size = self.length[state]
            state = self.next[state].get(word, 0)
            if not state:
                size = 0
                continue
            size += 1
            key = state * (self.window + 1) + min(size, self.window)
            got = self.ending.get(key)
            if got is None:
                got = self.ending[key] = self._ending(state, size)
            if got[0]:
                yield i, *got

    def hits(self, found: words.Words) -> tuple[np.ndarray, list[tuple[int, frozenset[int]]]]:
        """Hit words of a batch, and (position, items) of each match."""
        n = len(found.hash)
        hit = np.zeros(n, bool)
        matches: list[tuple[int, frozenset[int]]] = []
        if not n or not len(self.vocabulary):
            return hit, matches
        number = np.searchsorted(self.vocabulary, found.hash)
        number[number == len(self.vocabulary)] = 0
        number[self.vocabulary[number] != found.hash] = -1
        if self.least >= 2:
            pair = words.window_hashes(found.hash, 2)
            known = _among(pair, self.pairs) & (found.owner()[1:] == found.owner()[:-1]) if n > 1 else np.zeros(0, bool)
            inside = np.zeros(n + 1, bool)
            inside[:-2] = known  # known[i]: words i and i + 1 go together
            edge = np.flatnonzero(np.diff(np.concatenate([[False], inside])))
            begin, end = edge[0::2], edge[1::2] + 1
        else:
            edge = np.flatnonzero(np.diff(np.concatenate([[False], number >= 0, [False]])))
            begin, end = edge[0::2], edge[1::2]
            begin, end = _within_texts(begin, end, found.doc)
        long = end - begin >= self.least
        for a, b in zip(begin[long].tolist(), end[long].tolist(), strict=True):
            for i, size, items in self.windows(number[a:b].tolist()):
                hit[a + i - size + 1 : a + i + 1] = True
                matches.append((a + i, items))
        return hit, matches


def _among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    at = np.searchsorted(known, values)
    at[at == len(known)] = 0
    return known[at] == values if len(known) else np.zeros(len(values), bool)


def _within_texts(begin: np.ndarray, end: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    cuts = np.unique(doc[1:-1])
    at = np.searchsorted(begin, cuts, side="right") - 1
    inner = cuts[(at >= 0) & (begin[at] < cuts) & (cuts < end[at])]
    return np.sort(np.concatenate([begin, inner])), np.sort(np.concatenate([end, inner]))


def blocks(items: DataFrame, limit: int = BLOCK_BYTES) -> Iterator[list[tuple[str, str | None]]]:
    """(item_id as text, text) of all items in blocks of bounded bytes, through a local iterator."""
    rows = items.select(F.col("item_id").cast("string"), F.col("text").cast("string")).where("item_id is not null and text is not null")
    block: list[tuple[str, str | None]] = []
    size = 0
    for name, text in rows.toLocalIterator():
        if block and size + len(text) > limit:
            yield block
            block, size = [], 0
        block.append((name, text))
        size += len(text)
    if block:
        yield block


FOUND = "doc_id long, text string, n_words long, hits array<struct<a:int,b:int>>, items array<string>"


def _scanned(docs: DataFrame, shared: Broadcast, text: bool) -> DataFrame:
    """doc_id, text (if asked for), n_words, the hit ranges of words, and item ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        kind = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))
        for batch in batches:
            for i, j in words.slices(batch.column(1)):
                part = batch.column(1).slice(i, j - i)
                found = words.scan(part, words.ALNUM_WORDS, True)
                hit, matches = own.hits(found)
                names: list[set[str]] = [set() for _ in range(found.n_docs)]
                for at, items in matches:
                    names[int(np.searchsorted(found.doc, at, side="right")) - 1].update(own.names[x] for x in items)
                ranges: list[list[dict]] = [[] for _ in range(found.n_docs)]
                for d, got in enumerate(names):
                    if got:
                        flags = np.concatenate([[False], hit[found.doc[d] : found.doc[d + 1]], [False]])
                        edge = np.flatnonzero(np.diff(flags))
                        ranges[d] = [{"a": a, "b": b} for a, b in zip(edge[0::2].tolist(), edge[1::2].tolist(), strict=True)]
                yield pa.record_batch(
                    [batch.column(0).slice(i, j - i), part if text else pa.nulls(j - i, pa.string()), pa.array(found.counts(), pa.int64()), pa.array(ranges, kind), pa.array([sorted(x) for x in names], pa.list_(pa.string()))],
                    ["doc_id", "text", "n_words", "hits", "items"],
                )

    return docs.mapInArrow(narrow(run), FOUND)


def _merged(ranges: pa.Array) -> list[list[tuple[int, int]]]:
    out = []
    for row in ranges.to_pylist():
        joined: list[tuple[int, int]] = []
        for a, b in sorted((x["a"], x["b"]) for x in row or ()):
            if joined and a <= joined[-1][1]:
                joined[-1] = (joined[-1][0], max(b, joined[-1][1]))
            else:
                joined.append((a, b))
        out.append(joined)
    return out


def findings(plain: DataFrame, items: DataFrame, window: int, limit: int) -> tuple[Automaton | None, DataFrame | None]:
    """The automaton of all items if they are one block, as usual; else what all blocks find.

    The second is (doc_id, h, hits, items), one row for each doc_id and hash of a text that any
    block hits; equal rows of a table have equal findings.
    """
    todo = blocks(items, limit)
    first, second = next(todo, []), next(todo, None)
    if second is None:
        return Automaton(first, window), None
    found = []
    for block in chain([first, second], todo):
        shared = plain.sparkSession.sparkContext.broadcast(Automaton(block, window))
        rows = _scanned(plain, shared, True).where("size(items) > 0")
        found.append(cut(rows.select("doc_id", F.xxhash64("text").alias("h"), "hits", "items")))
        shared.destroy()
    every = reduce(DataFrame.unionAll, found)
    return None, every.groupBy("doc_id", "h").agg(F.array_distinct(F.flatten(F.collect_set("hits"))).alias("hits"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"))


def scanned(docs: DataFrame, items: DataFrame, window: int = WINDOW, limit: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_words, hits and items of every row over all blocks of items; narrow if it is one."""
    plain = text_only(docs)
    automaton, found = findings(plain, items, window, limit)
    if found is None:
        return _scanned(plain, plain.sparkSession.sparkContext.broadcast(automaton), False).drop("text")
    base = plain.mapInArrow(narrow(_counted), "doc_id long, text string, n_words long").select("doc_id", F.xxhash64("text").alias("h"), "n_words")
    both = base.join(found, base["doc_id"].eqNullSafe(found["doc_id"]) & base["h"].eqNullSafe(found["h"]), "left")
    return both.select(base["doc_id"], "n_words", F.coalesce("hits", F.array()).alias("hits"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, j in words.slices(batch.column(1)):
            part = batch.column(1).slice(i, j - i)
            n = words.scan(part, words.ALNUM_WORDS, True).counts()
            yield pa.record_batch([batch.column(0).slice(i, j - i), part, pa.array(n, pa.int64())], ["doc_id", "text", "n_words"])


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, limit: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for every row of docs.

    Words are runs of digits, lower-cased Latin letters and non-ASCII.  A window is ``window``
    consecutive words of an item; an item of fewer words, but not none, is one window.  A word of
    a document is hit if it lies in an occurrence of a window.

    Null and empty texts have no words.  Items with a null id or text, or without words, have no
    windows; an empty benchmark hits nothing.  Null and repeated doc_ids come back row by row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_hit = [sum(b - a for a, b in row) for row in _merged(batch.column("hits"))]
            items = [sorted(set(x or ())) for x in batch.column("items").to_pylist()]
            digest = [hashlib.sha256(",".join(x).encode()).hexdigest() for x in items]
            yield pa.record_batch([batch.column("doc_id"), batch.column("n_words"), pa.array(n_hit, pa.int64()), pa.array([len(x) for x in items], pa.int64()), pa.array(digest, pa.string()), pa.array([x > 0 for x in n_hit], pa.bool_())], ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])

    found = scanned(docs, items, window, limit).select("doc_id", "n_words", "hits", "items")
    return found.mapInArrow(narrow(run), "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW, most_coverage: float = 0.5, limit: int = BLOCK_BYTES) -> DataFrame:
    """The rows of docs, all columns, without the spans of text that benchmark windows cover.

    A span reaches from the start of its first hit word to the end of its last.  Rows of which
    more than ``most_coverage`` of the words are hit go altogether; rows without a hit are
    returned as they are.  All items are held against the text as it came in, and coverage is
    judged and the text cut once, so the result is the same however items are cut into blocks.

    Null and empty texts have no words and stay.  Rows with a null doc_id and rows that repeat one
    are each judged by their own text.  Items with a null id or text, or without words, remove
    nothing, nor does an empty benchmark.  Columns keep their names and order, and those of items
    other than item_id and text are not read.
    """
    automaton, found = findings(text_only(docs), items, window, limit)
    names, at = docs.columns, docs.columns.index("text")
    shared = docs.sparkSession.sparkContext.broadcast(automaton) if found is None else None
    rows = docs
    if found is not None:
        both = docs.join(found.select(F.col("doc_id").alias("__ul_id"), F.col("h").alias("__ul_h"), F.col("hits").alias("__ul_hits")), docs["doc_id"].cast("long").eqNullSafe(F.col("__ul_id")) & F.xxhash64(docs["text"].cast("string")).eqNullSafe(F.col("__ul_h")), "left")
        rows = both.select(*names, "__ul_hits")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in words.slices(batch.column(at)):
                part = batch.slice(i, j - i)
                words_ = words.scan(part.column(at), words.ALNUM_WORDS, True)
                if shared is not None:
                    hit, _ = shared.value.hits(words_)
                else:
                    hit = np.zeros(len(words_.hash), bool)
                    for d, ranges in enumerate(_merged(part.column(len(names)))):
                        for a, b in ranges:
                            hit[words_.doc[d] + a : words_.doc[d] + b] = True
                    part = part.select(names)
                if not hit.any():
                    yield part
                    continue
                texts, stay = part.column(at).to_pylist(), np.ones(len(part), bool)
                for d in range(words_.n_docs):
                    own = hit[words_.doc[d] : words_.doc[d + 1]]
                    if own.any():
                        stay[d] = own.mean() <= most_coverage
                        texts[d] = _without(texts[d], own, words_, d)
                columns = [pa.array(texts, part.schema.field(at).type) if c == at else x for c, x in enumerate(part.columns)]
                yield pa.record_batch(columns, part.schema.names).filter(pa.array(stay))

    return rows.mapInArrow(narrow(run), docs.schema)


def _without(text: str, hit: np.ndarray, found: words.Words, d: int) -> str:
    raw = text.encode()
    first, base = int(found.doc[d]), int(found.offsets[d])
    edge = np.flatnonzero(np.diff(np.concatenate([[False], hit, [False]])))
    out, last = [], 0
    for a, b in zip(edge[0::2], edge[1::2], strict=True):
        out.append(raw[last : int(found.begin[first + a]) - base])
        last = int(found.end[first + b - 1]) - base
    return (b"".join(out) + raw[last:]).decode()
