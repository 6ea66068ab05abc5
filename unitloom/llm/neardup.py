"""MinHash near-duplicate groups through an LSH forest.

Each document has a set of word shingles and a MinHash signature.  The signature is laid out as
several keys ("trees"), and each tree is one sorted order of the corpus, made by one range
exchange.  Candidates of a document are its neighbours in an order: there the rows with the longest
common prefix (LCP) are the nearest ones.  How deep a prefix is needed follows from the region:
where few keys are alike, neighbours with LEAST_DEPTH equal hashes are reached; in a dense region
the ``reach`` nearest positions are taken by keys that agree much further.  Rows whose whole keys
tie are ordered further by a sketch, two bits of each of the signature's other hashes, so a region
goes as deep as the whole signature.

The sketch also leaves out pairs that can't reach the threshold (short of it by DEVIATIONS standard
deviations) and ranks the others.

Candidates are confirmed on full shingle sets, in rounds: first the best few of each document,
which joins most groups; then, for every candidate pair whose ends are still apart, the pairs of
an end and the best-linked members ("hubs") of the other side's group, and the pair itself, again
and again until that gives no new link.

Neighbourhood and "the best few" leave pairs out only where more rows share a prefix than they
hold.  All rows of such regions that are still in different groups go through an exact join on
their sets: shingles are ordered from rare to frequent, and two sets that reach the threshold share
one of their first shingles (prefix filter; the smaller set of a pair needs a shorter prefix), are
of similar size (length filter) and have enough shingles left from there on (positional filter).
So a pair that shares a prefix of LEAST_DEPTH hashes in any order is only left unconfirmed if its
ends are already known to be in one group, or, in a sparse region, by the sketch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from . import words
from .components import components
from .runtime import cut, dealt_anew, fewer, narrow, release, sent, shuffle_partitions, small, text_only, worth

U64 = np.uint64
TREES = 16
TREE_HASHES = 6
KEY_HASHES = 8
LEAST_DEPTH = 3
NEIGHBOURS = 32
#: Of a document's neighbours in one order so many are confirmed first, the most alike by sketch; the
#: others follow, as far as they are still apart by then.
BEST_OF_TREE = 6
#: Candidates of a document that are confirmed in the first rounds; the last round takes all.
BEST = (32,)
HUBS = 16
SALTS = 32
#: Of the sketch's estimate.  By the binomial law a pair right at the threshold is left out once in
#: 2.3 million at 85 percent and once in 5.2 million at 80.
DEVIATIONS = 5.5
#: Rows that one task may be given to look for neighbours across the bounds of partitions.
SEAM_ROWS = 1 << 16
#: Counters by which shingles are ordered; any order gives the same links.
COUNTERS = 1 << 16
#: Rows of a shingle for which one more salt is used.
SALT_ROWS = 2000
#: Small rows that a pair with its two sets is reckoned for when tasks are counted.
SET_ROWS = 20
SEED = 2014


def multipliers(n: int) -> np.ndarray:
    return np.random.default_rng(SEED).integers(1, 1 << 63, n, dtype=np.uint64) * U64(2) + U64(1)


def shingle_sets(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, sorted, and their bounds (n + 1 entries).

    Words are lower-cased (A-Z) runs of anything but ASCII space.  A text with fewer words than
    a shingle has its whole sequence as its one shingle; a text without words has none.
    """
    found = words.scan(texts, words.SPACE_WORDS, True)
    counts = found.counts()
    hashes = [words.window_hashes(found.hash, size)[s := words.window_starts(found.doc, size)]]
    owners = [found.owner()[s]]
    for n in range(1, size):
        if len(few := np.flatnonzero(counts == n)):
            at = found.doc[few]
            one = found.hash[at]
            for k in range(1, n):
                one = words.joined_hash(one, found.hash[at + k])
            hashes.append(words.mix(one ^ U64(n)))
            owners.append(few)
    h, own = np.concatenate(hashes), np.concatenate(owners)
    order = np.lexsort((h, own))
    h, own = h[order], own[order]
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[1:] != h[:-1]) | (own[1:] != own[:-1])
    h, own = h[fresh], own[fresh]
    return h, np.searchsorted(own, np.arange(found.n_docs + 1))


def _signed(texts: pa.Array, size: int, scale: np.ndarray) -> tuple[np.ndarray, list, list, list]:
    """Set sizes, 128-bit set keys, signatures and sketches; None where the set is empty."""
    h, bound = shingle_sets(texts, size)
    sizes = np.diff(bound)
    full = np.flatnonzero(sizes)
    keys: list = [None] * len(sizes)
    signs: list = [None] * len(sizes)
    bits: list = [None] * len(sizes)
    if len(full):
        starts = bound[:-1][full]
        pair = np.stack([np.add.reduceat(words.mix(h), starts), np.add.reduceat(words.mix(h ^ U64(words.GOLDEN)), starts)], 1)
        low = np.empty((len(full), len(scale)), ">u4")
        for k, m in enumerate(scale):
            low[:, k] = np.minimum.reduceat(((h * m) >> U64(32)).astype(np.uint32), starts)
        short = sketch(low)
        for i, row in enumerate(full):
            keys[row], signs[row], bits[row] = pair[i].tobytes(), low[i].tobytes(), short[i].tobytes()
    return sizes, keys, signs, bits


def sketch(sign: np.ndarray) -> np.ndarray:
    """The two lowest bits of each hash, four hashes to a byte."""
    low = (sign & 3).astype(np.uint8).reshape(len(sign), -1, 4)
    return low[:, :, 0] | low[:, :, 1] << 2 | low[:, :, 2] << 4 | low[:, :, 3] << 6


_DIFFERING = np.array([sum((x >> k) & 3 > 0 for k in (0, 2, 4, 6)) for x in range(256)], np.uint8)


def least_alike(percent: int, n: int = TREES * TREE_HASHES) -> int:
    """Equal 2-bit hashes that a pair at the threshold has, less DEVIATIONS standard deviations."""
    p = percent / 100 + (1 - percent / 100) / 4
    return int(n * p - DEVIATIONS * (n * p * (1 - p)) ** 0.5)


def signatures(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, n_shingles, set_key (equal for equal sets), signature, sketch; a narrow Arrow pass."""
    scale = multipliers(TREES * TREE_HASHES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in words.slices(batch.column(1)):
                n, *rest = _signed(batch.column(1).slice(i, j - i), size, scale)
                yield pa.record_batch([batch.column(0).slice(i, j - i), pa.array(n, pa.int64()), *(pa.array(x, pa.binary()) for x in rest)], ["doc_id", "n_shingles", "set_key", "signature", "sketch"])

    return text_only(docs).mapInArrow(narrow(run), "doc_id long, n_shingles long, set_key binary, signature binary, sketch binary")


def _near(tree: np.ndarray, key: np.ndarray, bits: np.ndarray, rep: np.ndarray, n: np.ndarray, percent: int, reach: int, new) -> pa.RecordBatch | None:
    """Pairs of rows at most reach apart that share a prefix; new(d) masks the pairs that count.

    The score is the number of equal 2-bit hashes; pairs for which it is out of reach are left
    out, and so are those that are among the best few of neither of their rows.
    """
    rows, reach = len(rep), min(reach, len(rep) - 1)
    if reach < 1:
        return None
    least = least_alike(percent)
    score = np.zeros((reach, rows), np.int16)  # of row i with row i + d, at (d - 1, i)
    for d in range(1, reach + 1):
        ok = tree[d:] == tree[:-d]
        ok &= 100 * np.minimum(n[d:], n[:-d]) >= percent * np.maximum(n[d:], n[:-d])
        ok &= (rep[d:] != rep[:-d]) & (key[d:, :LEAST_DEPTH] == key[:-d, :LEAST_DEPTH]).all(1)
        at = np.flatnonzero(ok)
        if len(at):
            got = TREES * TREE_HASHES - _DIFFERING[bits[at] ^ bits[at + d]].sum(1, dtype=np.int16)
            score[d - 1, at] = np.where(got >= least, got, 0)
    if not score.any():
        return None
    both = np.zeros((2 * reach, rows), np.int16)
    both[:reach] = score
    for d in range(1, reach + 1):
        both[reach + d - 1, d:] = score[d - 1, :-d]
    enough = np.sort(both, axis=0)[-min(BEST_OF_TREE, 2 * reach)]
    found = []
    for d in range(1, reach + 1):
        own = score[d - 1, :-d]
        at = np.flatnonzero((own > 0) & ((own >= enough[:-d]) | (own >= enough[d:])) & new(d))
        x, y = rep[at], rep[at + d]
        found.append((np.minimum(x, y), np.maximum(x, y), own[at]))
    return _pairs(*(np.concatenate(x) for x in zip(*found, strict=True)))


PAIRS = "a long, b long, score int, tree int, key binary, sketch binary, rep long, n long, part int"
NAMES = ["a", "b", "score", "tree", "key", "sketch", "rep", "n", "part"]


def _pairs(a: np.ndarray, b: np.ndarray, score: np.ndarray) -> pa.RecordBatch:
    none = lambda kind: pa.nulls(len(a), kind)
    return pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(score, pa.int32()), none(pa.int32()), none(pa.binary()), none(pa.binary()), none(pa.int64()), none(pa.int64()), none(pa.int32())], NAMES)


def _columns(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    key = np.frombuffer(b"".join(batch.column("key").to_pylist()), ">u4").astype(np.uint32).reshape(-1, KEY_HASHES)
    bits = np.frombuffer(b"".join(batch.column("sketch").to_pylist()), np.uint8).reshape(len(key), -1)
    return batch.column("tree").to_numpy(), key, bits, batch.column("rep").to_numpy(), batch.column("n").to_numpy()


def _within(percent: int, reach: int, level: int):
    """Neighbours inside a sorted partition; its first and last rows also go on, for the seams.

    Beyond level 0 the rows are such ends of other partitions, and pairs of one of those have been
    seen.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        carry, seen, ends = None, 0, []
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = (*_columns(batch), batch.column("part").to_numpy(zero_copy_only=False))
            if seen < reach:
                ends.append(tuple(x[: reach - seen] for x in cols))
            old = 0
            if carry is not None:
                old = len(carry[0])
                cols = tuple(np.concatenate(x) for x in zip(carry, cols, strict=True))
            rows, parts = len(cols[0]), cols[-1]

            def fresh(d: int, rows=rows, old=old, parts=parts) -> np.ndarray:
                own = np.arange(d, rows) >= old
                return own if level == 0 else own & (parts[d:] != parts[:-d])

            pairs = _near(*cols[:-1], percent, reach, fresh)
            if pairs is not None:
                yield pairs
            carry = tuple(x[-reach:] for x in cols)
            seen += batch.num_rows
        if carry is None:
            return
        tail = min(len(carry[0]), max(0, seen - reach))  # rows that are not among the first ones
        ends.append(tuple(x[len(x) - tail :] for x in carry))
        tree, key, bits, rep, n, _ = (np.concatenate(x) for x in zip(*ends, strict=True))
        key = key.astype(">u4")
        rows = len(rep)
        none = lambda kind: pa.nulls(rows, kind)
        yield pa.record_batch([none(pa.int64()), none(pa.int64()), none(pa.int32()), pa.array(tree, pa.int32()), pa.array([x.tobytes() for x in key], pa.binary()), pa.array([x.tobytes() for x in bits], pa.binary()), pa.array(rep, pa.int64()), pa.array(n, pa.int64()), pa.array(np.full(rows, part), pa.int32())], NAMES)

    return run


def neighbours(rows: DataFrame, percent: int, reach: int, parts: int, level: int = 0) -> DataFrame:
    """(a, b, score) of near rows in the order of tree, key and sketch.

    The ends of partitions are put in order again, in as many partitions as they need, until they
    fit into one.
    """
    order = ["tree", "key", "sketch", "rep"]
    dealt = rows.repartitionByRange(parts, *order) if parts > 1 else rows.repartition(1)
    found = cut(dealt.sortWithinPartitions(*order).mapInArrow(narrow(_within(percent, reach, level)), PAIRS))
    own = found.where("part is null").select("a", "b", "score")
    if parts == 1:
        return own
    seams = found.where("part is not null").select(*order, "n", "part")
    fewer = min(-(-parts * 2 * reach // SEAM_ROWS), -(-parts // 2))
    return own.unionAll(neighbours(seams, percent, reach, fewer, level + 1))


def candidates(reps: DataFrame, percent: int, reach: int = NEIGHBOURS) -> DataFrame:
    """(a, b, score) with a < b from all trees; reps: rep, n, signature, sketch."""
    width, size = 4 * TREE_HASHES, TREES * TREE_HASHES // 4
    long = F.concat("signature", F.substring("signature", 1, 4 * (KEY_HASHES - TREE_HASHES)))
    spread = reps.select("rep", "n", F.concat("sketch", "sketch").alias("bits"), long.alias("s"), F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree"))
    # The sketch begins with the first whole byte of hashes that the key doesn't have.
    turn = f"pmod(cast(ceil((tree * {TREE_HASHES} + {KEY_HASHES}) / 4) as int), {size})"
    rows = spread.select("tree", F.expr(f"substring(s, tree * {width} + 1, {4 * KEY_HASHES})").alias("key"), F.expr(f"substring(bits, {turn} + 1, {size})").alias("sketch"), "rep", "n", F.lit(0).alias("part"))
    every = neighbours(rows, percent, reach, shuffle_partitions(reps.sparkSession))
    return every.groupBy("a", "b").agg(F.max("score").alias("score"))


def _sets(docs: DataFrame, size: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in words.slices(batch.column(1)):
                h, bound = shingle_sets(batch.column(1).slice(i, j - i), size)
                yield pa.record_batch([batch.column(0).slice(i, j - i), pa.ListArray.from_arrays(pa.array(bound, pa.int32()), pa.array(h.view(np.int64)))], ["id", "s"])

    return docs.mapInArrow(narrow(run), "id long, s array<long>")


def _ends(pairs: DataFrame, name: str) -> DataFrame:
    return pairs.select(F.col("a").alias(name)).unionAll(pairs.select(F.col("b").alias(name))).distinct()


def confirm(pairs: DataFrame, sets: DataFrame, percent: int, tasks: int) -> DataFrame:
    """Pairs whose full sets overlap enough: 100 * intersection >= percent * union."""
    # Of few pairs only their own sets are dealt out.
    ends = cut(_ends(pairs, "id"), tasks)
    sets = sets.join(sent(ends), "id", "left_semi")
    a = sets.select(F.col("id").alias("a"), F.col("s").alias("sa"))
    b = sets.select(F.col("id").alias("b"), F.col("s").alias("sb"))
    both = pairs.select("a", "b").join(a, "a").join(b, "b")
    met = both.select("a", "b", F.size(F.array_intersect("sa", "sb")).cast("long").alias("i"), (F.size("sa") + F.size("sb")).cast("long").alias("t"))
    return met.where(f"100 * i >= {int(percent)} * (t - i)").select("a", "b")


def groups(docs: DataFrame, shingle: int = 5, percent: int = 80, reach: int = NEIGHBOURS) -> tuple[DataFrame, DataFrame]:
    """Sizes and keys of all documents' sets, and (id, component) of the representatives that have a link.

    A representative stands for all documents with the very same shingle set.
    """
    signed = cut(signatures(docs, shingle))
    reps = signed.where("signature is not null and doc_id is not null").groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("signature").alias("signature"), F.first("sketch").alias("sketch"))
    reps = cut(reps.drop("set_key"))
    # Signatures of all copies and the sorted orders are not held on to while sets are dealt out.
    signed = cut(signed.select("doc_id", "n_shingles", "set_key"))
    release(docs.sparkSession)
    pairs = cut(candidates(reps, percent, reach))
    release(docs.sparkSession)
    # What follows has no more rows than there are pairs, or ends of pairs that are apart and hubs.
    tasks = worth(2 * pairs.count())
    pairs = fewer(pairs, tasks)
    ends = cut(_ends(pairs, "doc_id"), tasks)
    sets = cut(_sets(text_only(docs).join(sent(ends), "doc_id", "left_semi"), shingle))
    apart, links, of, done = pairs, None, None, None
    for best in BEST:
        # The best few candidates of each document whose ends are still apart.
        sided = apart.select("a", "b", "score").unionAll(apart.select(F.col("b").alias("a"), F.col("a").alias("b"), "score"))
        ranked = sided.withColumn("k", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("score"), "b")))
        chosen = cut(ranked.where(f"k <= {best}").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), tasks)
        links, of = _linked(chosen, sets, percent, links, of, tasks)
        done = chosen if done is None else done.unionAll(chosen)
        apart = cut(_apart(apart.join(chosen, ["a", "b"], "left_anti"), of, tasks), tasks)
    # Hubs of the groups that pairs which are still apart lead to, until that gives no link; then
    # those pairs themselves, and again, until neither gives one.
    while True:
        before = links
        for to_hubs in (True, False):
            asked = _to_hubs(apart, links, of, tasks) if to_hubs else apart.select("a", "b")
            todo = cut(asked.join(done, ["a", "b"], "left_anti"), tasks)
            links, of = _linked(todo, sets, percent, links, of, tasks)
            done = done.unionAll(todo)
            if links is not before:
                apart = cut(_apart(apart, of, tasks), tasks)
                break
        if links is before:
            break
    # Rows of regions in which a window was full, or others were more alike, and that are apart.
    dense = cut(crowded(reps, of, min(BEST_OF_TREE, reach) + 1))
    if not dense.isEmpty():
        others = cut(dense.select(F.col("rep").alias("doc_id")).join(ends, "doc_id", "left_anti"))
        sets = sets.unionAll(cut(_sets(text_only(docs).join(sent(others), "doc_id", "left_semi"), shingle)))
        missed = cut(exact_pairs(sets.join(sent(dense), F.col("id") == F.col("rep")), percent).join(done, ["a", "b"], "left_anti"))
        _, of = _linked(missed, sets, percent, links, of, worth(2 * missed.count()))
    return signed, of


def _to_hubs(apart: DataFrame, links: DataFrame, of: DataFrame, tasks: int) -> DataFrame:
    """Pairs (a, b) of the ends of pairs that are apart and the hubs of the other end's group."""
    degree = links.select(F.col("a").alias("id")).unionAll(links.select(F.col("b").alias("id"))).groupBy("id").count()
    few = F.broadcast if small(of) else lambda side: side  # hubs are some of these rows
    hubs = fewer(few(of).join(degree, "id"), tasks).groupBy("component", F.pmod(F.xxhash64("id"), F.lit(HUBS)).alias("k")).agg(F.max(F.struct("count", (-F.col("id")).alias("id"))).alias("h")).select("component", (-F.col("h.id")).alias("hub"))
    leads = apart.select("a", F.col("cb").alias("component")).unionAll(apart.select(F.col("b").alias("a"), F.col("ca").alias("component"))).distinct()
    met = fewer(fewer(leads, tasks).join(few(fewer(hubs, tasks)), "component"), tasks)
    return fewer(met.where("a <> hub").select(F.least("a", "hub").alias("a"), F.greatest("a", "hub").alias("b")).distinct(), tasks)


def crowded(reps: DataFrame, of: DataFrame, full: int) -> DataFrame:
    """(rep, component) of rows that share a prefix of LEAST_DEPTH hashes with more than ``full``
    rows of more than one component."""
    width = 4 * TREE_HASHES
    prefixes = F.expr(f"transform(sequence(0, {TREES - 1}), t -> xxhash64(t, substring(signature, t * {width} + 1, {4 * LEAST_DEPTH})))")
    known = of.select(F.col("id").alias("rep"), "component")
    rows = reps.select("rep", prefixes.alias("prefixes")).join(sent(known), "rep", "left")
    inside = rows.select("rep", F.coalesce("component", "rep").alias("component"), F.explode("prefixes").alias("prefix"))
    mixed = inside.groupBy("prefix").agg(F.count("*").alias("c"), F.min("component").alias("x"), F.max("component").alias("y")).where(f"c > {int(full)} and x < y").select("prefix")
    return inside.join(sent(cut(mixed)), "prefix", "left_semi").select("rep", "component").distinct()


def _shingle_counts(sets: DataFrame) -> np.ndarray:
    """How often shingles of each counter occur; COUNTERS numbers come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            total += np.bincount(batch.column(0).flatten().to_numpy().view(U64) % U64(COUNTERS), minlength=COUNTERS)
        some = np.flatnonzero(total)
        yield pa.record_batch([pa.array(some, pa.int64()), pa.array(total[some])], ["counter", "n"])

    counted = sets.select("s").mapInArrow(narrow(run), "counter long, n long").groupBy("counter").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(COUNTERS, np.int64)
    out[counted.column("counter").to_numpy()] = counted.column("n").to_numpy()
    return out


def _prefixes(sets: DataFrame, percent: int) -> DataFrame:
    """(shingle, rep, component, n, place, short) of the first shingles of each set, rare ones first.

    A set needs n - ceil(t n) + 1 of them to meet a smaller one, and the short prefix of
    n - ceil(2 t / (1 + t) n) + 1 to be met by one of its size or larger.
    """
    shared = sets.sparkSession.sparkContext.broadcast(_shingle_counts(sets))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        many = shared.value
        for batch in batches:
            ids, component = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            lists = batch.column(2)
            h = lists.flatten().to_numpy().view(U64)
            n = lists.value_lengths().to_numpy().astype(np.int64)
            own = np.repeat(np.arange(len(n)), n)
            h = h[np.lexsort((h, many[h % U64(COUNTERS)], own))]
            place = words.ranges(n)
            long, short = (n - -(-a * n // b) + 1 for a, b in ((percent, 100), (2 * percent, 100 + percent)))
            at = np.flatnonzero(place < long[own])
            own, place = own[at], place[at]
            yield pa.record_batch([pa.array(h[at].view(np.int64)), pa.array(ids[own]), pa.array(component[own]), pa.array(n[own]), pa.array(place), pa.array(place < short[own])], ["shingle", "rep", "component", "n", "place", "short"])

    return sets.select("rep", "component", "s").mapInArrow(narrow(run), "shingle long, rep long, component long, n long, place long, short boolean")


def exact_pairs(sets: DataFrame, percent: int) -> DataFrame:
    """(a, b) with a < b: all pairs of sets of different components that can reach the threshold.

    sets: rep, component, s (the whole set).  Such a pair has an end outside of the largest
    component that holds their shingle.  Those ends go to all salts of the shingle, of which a
    frequent one has more, and the other rows to one; so a hot shingle is no single task's.
    """
    rows = cut(_prefixes(sets, percent))
    shares = rows.groupBy("shingle", "component").agg(F.count("*").alias("c"))
    held = shares.groupBy("shingle").agg(F.max(F.struct("c", "component"))["component"].alias("most"), F.count("*").alias("parts"), F.sum("c").alias("c")).where("parts > 1")
    held = held.select("shingle", "most", F.least(F.lit(SALTS), F.ceil(F.col("c") / SALT_ROWS)).cast("int").alias("salts"))
    mixed = cut(rows.join(dealt_anew(held), "shingle"))
    named = lambda side, k: side.select("shingle", "salt", *[F.col(c).alias(f"{c}_{k}") for c in ("rep", "component", "n", "place", "short")])
    x = named(mixed.where("component <> most").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))), "x")
    y = named(mixed.withColumn("salt", F.pmod(F.xxhash64("rep"), F.col("salts")).cast("int")), "y")
    # Of two sets the smaller one, by size and then by id, is met in its short prefix.
    met = "if(struct(n_x, rep_x) < struct(n_y, rep_y), short_x, short_y)"
    similar = f"100 * least(n_x, n_y) >= {int(percent)} * greatest(n_x, n_y)"
    enough = f"{100 + int(percent)} * least(n_x - place_x, n_y - place_y) >= {int(percent)} * (n_x + n_y)"
    both = x.join(y, ["shingle", "salt"]).where(f"component_x <> component_y and {met} and {similar} and {enough}")
    return both.select(F.least("rep_x", "rep_y").alias("a"), F.greatest("rep_x", "rep_y").alias("b")).distinct()


def _linked(pairs: DataFrame, sets: DataFrame, percent: int, links: DataFrame | None, of: DataFrame | None, tasks: int) -> tuple[DataFrame, DataFrame]:
    """All links so far and their components; of: the components before these pairs.

    Without a new link both come back as they are.
    """
    rows = pairs.count()
    if of is not None and not rows:
        return links, of
    # These rows carry two sets each, so they are worth more tasks.
    fresh = cut(confirm(pairs, sets, percent, tasks), worth(rows * SET_ROWS))
    release(pairs.sparkSession)
    if of is not None and fresh.isEmpty():
        return links, of
    edges = fresh if of is None else fresh.unionAll(of.where("id <> component").select(F.col("id").alias("a"), F.col("component").alias("b")))
    return fresh if links is None else links.unionAll(fresh), components(edges)


def _apart(pairs: DataFrame, of: DataFrame, tasks: int) -> DataFrame:
    """Pairs (a, b, score) whose ends are in different components, with both components."""
    of = sent(of)
    mine = of.select(F.col("id").alias("a"), F.col("component").alias("ca"))
    other = of.select(F.col("id").alias("b"), F.col("component").alias("cb"))
    known = fewer(pairs.select("a", "b", "score").join(mine, "a", "left"), tasks).join(other, "b", "left").select("a", "b", "score", F.coalesce("ca", "a").alias("ca"), F.coalesce("cb", "b").alias("cb"))
    return known.where("ca <> cb")


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs.

    Two documents are linked if 100 * |A & B| >= percent * |A | B| for their shingle sets;
    component_id is the smallest doc_id reachable over links, a document's own id included, and
    kept tells the one document of each group that has it.

    Null and empty texts, and texts without words, have n_shingles 0 and are linked with nothing.
    Rows with a null doc_id link with nothing and come back with a null component_id and kept
    true, as there is no id by which to choose another.  Rows that repeat a doc_id come
    back each with the component of its own text; links of any of them tie the id.  Extra columns
    are not read.
    """
    signed, of = groups(docs, shingle, percent)
    least = signed.where("set_key is not null and doc_id is not null").groupBy("set_key").agg(F.min("doc_id").alias("rep"))
    found = signed.select("doc_id", "n_shingles", "set_key").join(dealt_anew(least), "set_key", "left").join(sent(of).withColumnRenamed("id", "rep"), "rep", "left")
    out = found.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "rep", "doc_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_one(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs, all columns, without those whose group is kept by another document.

    Rows with a null doc_id stay.  Of rows that repeat a doc_id all stay if one of them is kept.
    """
    kept = near_duplicates(docs, shingle, percent).where("doc_id is not null").groupBy(F.col("doc_id").alias("__ul_gone")).agg(F.max("kept").alias("__ul_kept"))
    gone = kept.where("not __ul_kept").select("__ul_gone")
    return docs.join(gone, docs["doc_id"].cast("long") == F.col("__ul_gone"), "left_anti")
