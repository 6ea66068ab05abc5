"""Line deduplication over levelled sorted runs of line keys, in DataFrame functions only.

A run is a table of (key, holder, n_docs), one row for each line key of a batch of documents,
dealt and sorted by key.  A new batch is merge-anti-joined with the runs there are: keys that no
run knows yet name their holder, the others only add to the count.  The batch's own rows become a
run of level 0; once a level has ``fanout`` runs they are compacted into one run of the next.  So
a key is rewritten as often as there are levels, not as often as there are batches.

Batches must come in descending order of doc_id for the holder to be the largest one; the table
function below takes care of that.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from .runtime import cut, text_only

#: What is stripped at both ends of a line: U+0020 and U+0009-000D.
BLANKS = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LEAST_CHARS = 40
LEAST_DOCS = 5
BATCHES = 4
FANOUT = 2


def line_key(line: Column) -> Column:
    """The line stripped and with A-Z in lower case."""
    bare = F.btrim(line, F.lit(BLANKS))
    # lower() is faster than translate(), and the same on ASCII.
    return F.when(F.length(bare) == F.octet_length(bare), F.lower(bare)).otherwise(F.translate(bare, UPPER, UPPER.lower()))


def key_hash(key: Column) -> Column:
    """128 bits of a key."""
    return F.unhex(F.substring(F.sha2(key, 256), 1, 32))


def keyed_lines(docs: DataFrame, least_chars: int) -> DataFrame:
    """(doc_id, key), one row for each distinct long line key of a document."""
    # A key is never longer than its line, so most short lines end at the first test.
    lines = F.filter(F.split("text", "\n"), lambda x: F.length(x) >= least_chars)
    one = docs.where("doc_id is not null").select("doc_id", F.explode(F.array_distinct(F.transform(lines, line_key))).alias("line"))
    return one.where(F.length("line") >= least_chars).select("doc_id", key_hash(F.col("line")).alias("key"))


class LineRuns:
    """The levels of runs, and what is done with them."""

    def __init__(self, least_chars: int = LEAST_CHARS, fanout: int = FANOUT, repeats: bool = True) -> None:
        self.least_chars, self.fanout, self.repeats = least_chars, fanout, repeats
        self.levels: list[list[DataFrame]] = []

    def runs(self) -> list[DataFrame]:
        return [run for level in self.levels for run in level]

    def add(self, docs: DataFrame) -> DataFrame:
        """Adds a batch and returns its new keys (key, holder); docs: doc_id, text."""
        # Each document gives a key once, so the count is of documents; both aggregates are
        # combined before the exchange, so a line of a third of all documents is one row a task.
        lines = keyed_lines(docs, self.least_chars)
        if self.repeats:
            # Rows of one doc_id are in the same batch, and their lines count once.
            lines = lines.distinct()
        batch = lines.groupBy("key").agg(F.max("doc_id").alias("holder"), F.count("*").alias("n_docs"))
        known = [r.where("holder is not null").select("key") for r in self.runs()]
        if known:
            batch = cut(batch)
            fresh = reduce(lambda left, run: left.join(run.hint("merge"), "key", "left_anti"), known, batch)
            seen = reduce(DataFrame.unionAll, [batch.join(run.hint("merge"), "key", "left_semi") for run in known])
            batch = fresh.unionAll(seen.select("key", F.lit(None).cast("long").alias("holder"), "n_docs"))
        run = self._sorted(batch)
        self._push(run, 0)
        return run.where("holder is not null").select("key", "holder")

    def _sorted(self, rows: DataFrame) -> DataFrame:
        return cut(rows.repartition("key").sortWithinPartitions("key"))

    def _push(self, run: DataFrame, level: int) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) >= self.fanout:
            merged = self.merged(self.levels[level])
            self.levels[level] = []
            self._push(self._sorted(merged), level + 1)

    def merged(self, runs: list[DataFrame]) -> DataFrame:
        every = reduce(DataFrame.unionAll, runs)
        return every.groupBy("key").agg(F.max("holder").alias("holder"), F.sum("n_docs").alias("n_docs"))

    def common(self, least_docs: int) -> DataFrame:
        """(key, holder) of keys of at least so many documents."""
        return self.merged(self.runs()).where(F.col("n_docs") >= least_docs).select("key", "holder")


def batches_of(docs: DataFrame, n: int) -> list[DataFrame]:
    """Docs in n ranges of doc_id, the largest ids first; ranges reach the scan as filters."""
    low, high = docs.agg(F.min("doc_id"), F.max("doc_id")).first()
    if low is None:
        return [docs]
    step = max(1, -(-(high - low + 1) // n))
    return [docs.where((F.col("doc_id") >= at) & (F.col("doc_id") < at + step)) for at in range(low, high + 1, step)][::-1]


def dropped_keys(docs: DataFrame, least_chars: int, least_docs: int, batches: int) -> DataFrame:
    """(doc_id, keys): the line keys that each document loses."""
    # Only a table that repeats a doc_id pays for telling its rows apart.
    repeats = not docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").isEmpty()
    store = LineRuns(least_chars, repeats=repeats)
    for batch in batches_of(docs, batches):
        store.add(batch)
    common = cut(store.common(least_docs))
    lost = keyed_lines(docs, least_chars).join(common, "key").where("doc_id <> holder")
    return lost.groupBy("doc_id").agg(F.collect_set("key").alias("keys"))


def _kept(text: Column, keys: Column, least_chars: int) -> Column:
    """Lines of the text that stay."""
    lines = F.split(text, "\n")

    def stays(line: Column) -> Column:
        long = F.length(line) >= least_chars
        return ~F.when(long, F.array_contains(keys, key_hash(line_key(line)))).otherwise(False)

    return F.when(keys.isNull(), lines).otherwise(F.filter(lines, stays))


def line_dedup(docs: DataFrame, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS, batches: int = BATCHES) -> DataFrame:
    """Every row of docs, all columns, with n_lines, n_dropped and the kept text as ``kept_text``.

    A text is split at line feeds.  A line's key is the line stripped of ASCII white space with
    A-Z in lower case.  Keys of at least ``least_chars`` code points that occur in at least
    ``least_docs`` documents lose all their lines, except in the largest doc_id that holds them.

    A null or empty text is one empty line.  Rows with a null doc_id neither count nor lose lines.
    Rows that repeat a doc_id are one document: their lines count once and are dropped alike.
    A key of the holder stays as often as it occurs there.
    """
    source = docs.withColumn("__ul_id", F.col("doc_id").cast("long"))
    plain = text_only(docs)
    lost = dropped_keys(plain, least_chars, least_docs, batches).withColumnsRenamed({"doc_id": "__ul_lost", "keys": "__ul_keys"})
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    both = source.join(lost, F.col("__ul_id") == F.col("__ul_lost"), "left").withColumn("__ul_lines", _kept(text, F.col("__ul_keys"), least_chars))
    n = (F.length(text) - F.length(F.replace(text, F.lit("\n"))) + 1).cast("long")
    out = both.withColumns({"n_lines": n, "n_dropped": n - F.size("__ul_lines").cast("long"), "kept_text": F.array_join("__ul_lines", "\n")})
    return out.drop("__ul_id", "__ul_lost", "__ul_keys", "__ul_lines")
