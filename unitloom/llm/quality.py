"""Quality rules with adaptive thresholds, in DataFrame functions only.

Features of a text are computed inside its row, so no word is ever shuffled.  Thresholds come
from mergeable quantile sketches (KLL) of each feature for each language and source, for each
language, and for all documents: partial sketches are built on the map side, so a source with a
third of all rows costs a few kilobytes a task.

A document fails if a feature lies outside of its group's fences: the quartiles, widened by
``FENCE`` times their distance.  Ratios are compared on a logarithmic scale after one more
occurrence and one more unit were counted, so that a short text's one symbol is no outlier and a
group in which most documents have none still has a spread.  Three things keep groups sound:

- only documents that pass the base rules are sketched, and quartiles bear a quarter of bad ones;
- a group's quartiles are averaged with its language's, and a language's with those of all, as if
  those had been ``PRIOR`` documents more, so that few documents don't set a limit by themselves;
- a group's limits lie between its language's and that language's fences of twice the width: a
  mostly bad source doesn't lift its own limits far, and one that mostly repeats a text doesn't
  reject the others.  A language unlike all others is judged by its own fences too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .runtime import BROADCAST_ROWS, cut, small

#: Separators of words, as a pattern and as characters.
SPACES = r"[\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"

LEAST_WORDS = 50
MOST_REPEATED = 50
#: Widths of the distance of the quartiles, beyond them, that a feature may lie.
FENCE = 3.0
#: Documents that the parent group's quartiles count for.
PRIOR = 200
#: Features, and whether values below the lower fence fail too.
RULES = {"symbols": False, "dup_lines": False, "repeats": False, "word_length": True}
SKETCH_K = 2000
SALTS = 32


def _occurrences(text: Column) -> Column:
    """How many symbols a text has."""
    return (F.length(text) - F.length(F.regexp_replace(text, f"[{SYMBOLS}]", ""))).cast("long")


def words_of(text: Column) -> Column:
    bare = F.btrim(text, F.lit(BLANKS))
    return F.when(F.length(bare) == 0, F.array().cast("array<string>")).otherwise(F.split(bare, SPACES))


def _sorted_windows(hashes: Column) -> Column:
    """(hash, place) of a text's windows in order of hashes; empty if no two hashes are equal."""
    pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.array().cast("array<struct<h:bigint,i:int>>")).otherwise(pairs)


def _repeated_places(windows: str) -> Column:
    """Places of windows that occur twice or more: equal ones are neighbours once sorted."""
    # The array is a column of its own, as an expression would run again for each element.
    own = F.col(windows)
    same = F.transform(own, lambda x, k: F.when((F.get(own, k - 1)["h"] == x["h"]) | (F.get(own, k + 1)["h"] == x["h"]), x["i"]))
    return F.sort_array(F.filter(same, lambda i: i.isNotNull()))


def _covered(places: Column, size: int) -> Column:
    """How many words windows of so many words cover that start at the (ascending) places."""
    begin = F.struct(F.lit(-size).alias("last"), F.lit(0).alias("n"))
    step = lambda acc, i: F.struct(i.alias("last"), (acc["n"] + F.least(F.lit(size), i - acc["last"])).alias("n"))
    return F.aggregate(places, begin, step, lambda acc: acc["n"]).cast("long")


ROW = "__ul_row"


def features(docs: DataFrame, carry: bool = False) -> DataFrame:
    """doc_id, lang, source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed.

    A null text has no words; a missing lang or source column, or a null in it, is a group ''.
    ``carry``: the row itself comes along as a struct.
    """
    kept = [ROW] if carry else []
    if carry:
        docs = docs.withColumn(ROW, F.struct(*[F.col(f"`{c}`") for c in docs.columns]))
    group = lambda c: (F.coalesce(F.col(c).cast("string"), F.lit("")) if c in docs.columns else F.lit("")).alias(c)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), group("lang"), group("source"), text.alias("t"), *kept)
    own = own.select("*", words_of(F.col("t")).alias("w"))
    n = F.size("w")
    window = lambda i: F.xxhash64(F.get("w", i), F.get("w", i + 1), F.get("w", i + 2))
    hashes = F.when(n < 3, F.array().cast("array<bigint>")).otherwise(F.transform(F.sequence(F.lit(0), F.greatest(n - 3, F.lit(0))), window))
    lines = F.filter(F.split("t", "\n"), lambda x: F.length(F.btrim(x, F.lit(BLANKS))) > 0)
    own = own.select(*kept, "doc_id", "lang", "source", n.cast("long").alias("n_words"), F.length(F.array_join("w", "")).cast("long").alias("word_chars"), _occurrences(F.col("t")).alias("n_symbols"), lines.alias("l"), hashes.alias("h"))
    counted = [(F.size("l") - F.size(F.array_distinct("l"))).cast("long").alias("n_dup_lines"), F.size("l").cast("long").alias("n_lines")]
    own = own.select(*kept, "doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", *counted, _sorted_windows(F.col("h")).alias("at"))
    own = own.withColumn("n_repeat_words", _covered(_repeated_places("at"), 3)).drop("at")
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    return own.withColumn("base_failed", failed)


def _scaled() -> dict[str, Column]:
    """The compared values of RULES, on logarithmic scales."""
    odds = lambda a, b: F.log((F.col(a) + 1.0) / (F.col(b) + 1.0))
    return {"symbols": odds("n_symbols", "word_chars"), "dup_lines": odds("n_dup_lines", "n_lines"), "repeats": odds("n_repeat_words", "n_words"), "word_length": odds("word_chars", "n_words")}


def rated(docs: DataFrame, carry: bool = False) -> DataFrame:
    return features(docs, carry).withColumns({f"v_{rule}": value for rule, value in _scaled().items()})


def _quartiles(rows: DataFrame) -> DataFrame:
    """lang, source, n, and low_/high_ (quartiles) of each rule, for groups, languages and all.

    A language's row has a null source, and that of all documents a null language too.
    """
    # A filter would be moved below the features' steps and compute them in one expression.
    sketches = [F.kll_sketch_agg_double(F.when(~F.col("base_failed"), F.col(f"v_{r}")), F.lit(SKETCH_K)).alias(f"k_{r}") for r in RULES]
    merged = rows.rollup("lang", "source").agg(F.count_if(~F.col("base_failed")).alias("n"), *sketches)
    at = lambda r, q, name: F.when(F.col("n") > 0, F.kll_sketch_get_quantile_double(F.col(f"k_{r}"), F.lit(q))).otherwise(0.0).alias(f"{name}_{r}")
    return merged.select("lang", "source", "n", *[at(r, q, name) for r in RULES for q, name in ((0.25, "low"), (0.75, "high"))])


def _fence(low: Column, high: Column, width: float) -> tuple[Column, Column]:
    return low - width * (high - low), high + width * (high - low)


def _averaged(rule: str, above) -> tuple[Column, Column]:
    """A rule's quartiles, averaged with those that above(name) gives for the group above."""
    own = lambda name: above(name) + (F.col(name) - above(name)) * (F.col("n") / (F.col("n") + PRIOR))
    return own(f"low_{rule}"), own(f"high_{rule}")


def thresholds(rows: DataFrame) -> DataFrame:
    """One row for each language and source: the least and the largest value of each rule."""
    every = cut(_quartiles(rows))
    whole = every.where("lang is null").first()
    whole = whole.asDict() if whole else {f"{x}_{r}": 0.0 for r in RULES for x in ("low", "high")}
    by_lang, by_group = {}, {}
    for r in RULES:
        low, high = _averaged(r, lambda name: F.lit(whole[name]))
        (least, most), (own_least, own_most) = _fence(low, high, FENCE), _fence(F.col(f"low_{r}"), F.col(f"high_{r}"), FENCE)
        outer_least, outer_most = _fence(low, high, 2 * FENCE)
        by_lang |= {f"al_{r}": low, f"ah_{r}": high, f"l_{r}": F.least(least, own_least), f"m_{r}": F.greatest(most, own_most), f"ol_{r}": F.least(outer_least, least, own_least), f"om_{r}": F.greatest(outer_most, most, own_most)}
        above = {f"low_{r}": F.col(f"al_{r}"), f"high_{r}": F.col(f"ah_{r}")}
        least, most = _fence(*_averaged(r, above.get), FENCE)
        by_group |= {f"least_{r}": F.greatest(F.least(least, F.col(f"l_{r}")), F.col(f"ol_{r}")), f"most_{r}": F.least(F.greatest(most, F.col(f"m_{r}")), F.col(f"om_{r}"))}
    langs = every.where("lang is not null and source is null").select("lang", *[c.alias(name) for name, c in by_lang.items()])
    return every.where("source is not null").join(langs, "lang").select("lang", "source", *[c.alias(name) for name, c in by_group.items()])


def judged(rows: DataFrame, limits: DataFrame, salts: int = SALTS) -> DataFrame:
    """rows of rated() with their group's limits and kept.

    kept is false if the base rules fail, and else tells whether every value lies within the
    limits of the row's language and source.
    """
    if small(limits, BROADCAST_ROWS):
        both = rows.join(F.broadcast(limits), ["lang", "source"], "left")
    else:
        # A hot group's rows are spread over salts, and each group's limits go to all of them.
        spread = limits.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        salted = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int"))
        both = salted.join(spread, ["lang", "source", "salt"], "left").drop("salt")
    passes = ~F.col("base_failed")
    for rule, both_sides in RULES.items():
        passes = passes & F.coalesce(F.col(f"v_{rule}") <= F.col(f"most_{rule}"), F.lit(True))
        if both_sides:
            passes = passes & F.coalesce(F.col(f"v_{rule}") >= F.col(f"least_{rule}"), F.lit(True))
    return both.withColumn("kept", passes)


def quality(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept.

    One row for each row of docs, repeated and null ids included, each judged by its own text.
    Null and empty texts have no words and so fail the base rules.  A missing or null language or
    source is a group of its own; columns other than text, lang and source don't matter, whatever
    their names.  Texts of equal values are judged alike, and a table of equal values loses none.
    """
    rows = cut(rated(docs))
    return judged(rows, cut(thresholds(rows))).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of docs, all columns, that the rules keep; each row is judged by its own text.

    Features are computed twice, once for the sketches and once beside the text, so no text is
    dealt out.  Rows with a null doc_id are no documents that could be judged: they stay, but
    count in the sketches.
    """
    limits = cut(thresholds(rated(docs)))
    return judged(rated(docs, carry=True), limits).where("kept or doc_id is null").select(f"{ROW}.*")
