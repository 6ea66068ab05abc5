"""Language identification: script ranges, per-word scores, and Viterbi spans of mixed texts.

A model holds, for each language, log-probabilities of hashed byte n-grams of words.  A word's
score for a language is the sum over its n-grams.  Script ranges narrow the candidates first: a
language whose training words never use a script is not a candidate for words of that script.  A
Viterbi pass over the words of a text, with a penalty for changing the language, labels spans;
the language that covers most letters of the text is the prediction.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from . import words
from .runtime import narrow, text_only

U64 = np.uint64

#: Bound of the training sample: so many documents of each language, chosen by a hash of the id.
SAMPLE = 2000
#: Bound of what is learned: so many languages, those of the most training rows.  A table of more
#: labels than that has mostly labels that are no languages.
LANGUAGES = 200
#: Byte n-grams of words, and the hash buckets that they share.
GRAMS = (1, 2, 3, 4)
BUCKETS = 1 << 15
PENALTY = 12.0
SMOOTHING = 0.5
#: Scores (of a word for a language) that go through Viterbi together.
BATCH_SCORES = 1 << 22

# Unicode blocks by script, as first and last code point of ranges.
SCRIPTS = {
    "latin": [(0x41, 0x5A), (0x61, 0x7A), (0xC0, 0x24F), (0x1E00, 0x1EFF)],
    "greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)],
    "cyrillic": [(0x400, 0x52F)],
    "armenian": [(0x530, 0x58F)],
    "hebrew": [(0x590, 0x5FF)],
    "arabic": [(0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF)],
    "syriac": [(0x700, 0x74F)],
    "thaana": [(0x780, 0x7BF)],
    "nko": [(0x7C0, 0x7FF)],
    "devanagari": [(0x900, 0x97F)],
    "bengali": [(0x980, 0x9FF)],
    "gurmukhi": [(0xA00, 0xA7F)],
    "gujarati": [(0xA80, 0xAFF)],
    "oriya": [(0xB00, 0xB7F)],
    "tamil": [(0xB80, 0xBFF)],
    "telugu": [(0xC00, 0xC7F)],
    "kannada": [(0xC80, 0xCFF)],
    "malayalam": [(0xD00, 0xD7F)],
    "sinhala": [(0xD80, 0xDFF)],
    "thai": [(0xE00, 0xE7F)],
    "lao": [(0xE80, 0xEFF)],
    "tibetan": [(0xF00, 0xFFF)],
    "myanmar": [(0x1000, 0x109F)],
    "georgian": [(0x10A0, 0x10FF), (0x1C90, 0x1CBF)],
    "hangul": [(0x1100, 0x11FF), (0xAC00, 0xD7AF)],
    "ethiopic": [(0x1200, 0x139F)],
    "cherokee": [(0x13A0, 0x13FF)],
    "khmer": [(0x1780, 0x17FF)],
    "mongolian": [(0x1800, 0x18AF)],
    "kana": [(0x3040, 0x30FF)],
    "han": [(0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x323AF)],
}
NAMES = list(SCRIPTS)
OTHER = len(NAMES)

_TWO_BYTE = np.full(0x800, OTHER, np.uint8)
for _k, _name in enumerate(NAMES):
    for _a, _b in SCRIPTS[_name]:
        _TWO_BYTE[_a : min(_b + 1, 0x800)] = _k
_TWO_BYTE[[0xD7, 0xF7]] = OTHER


def crc_is_held_out(doc_id: Column) -> Column:
    """Whether the document belongs to the fold that nothing is learned from."""
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(4)) == 2


def letters(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Script of each byte that starts a character (OTHER if it is no letter of any range), and
    a mask of the starts."""
    n = len(raw)
    script = np.full(n, OTHER, np.uint8)
    start = (raw & 0xC0) != 0x80
    one = raw < 0x80
    script[one] = _TWO_BYTE[raw[one]]
    two = np.flatnonzero((raw >= 0xC2) & (raw < 0xE0))
    two = two[two + 1 < n]
    script[two] = _TWO_BYTE[(raw[two].astype(np.int64) & 0x1F) << 6 | raw[two + 1] & 0x3F]
    three = np.flatnonzero((raw >= 0xE0) & (raw < 0xF0))
    three = three[three + 2 < n]
    script[three] = _script(_point(raw, three, 3, 0x0F))
    four = np.flatnonzero(raw >= 0xF0)
    four = four[four + 3 < n]
    script[four] = _script(_point(raw, four, 4, 0x07))
    return script, start


def _point(raw: np.ndarray, at: np.ndarray, size: int, lead: int) -> np.ndarray:
    point = raw[at].astype(np.int64) & lead
    for k in range(1, size):
        point = point << 6 | raw[at + k] & 0x3F
    return point


_RANGES = sorted((a, b, k) for k, name in enumerate(NAMES) for a, b in SCRIPTS[name])
_FIRST, _LAST, _OF = (np.array(x) for x in zip(*_RANGES, strict=True))


def _script(point: np.ndarray) -> np.ndarray:
    at = np.maximum(np.searchsorted(_FIRST, point, side="right") - 1, 0)
    return np.where((point >= _FIRST[at]) & (point <= _LAST[at]), _OF[at], OTHER).astype(np.uint8)


def has_letter(texts: pa.Array) -> np.ndarray:
    """Whether each text has a letter of any script, by Unicode's own classes."""
    import pyarrow.compute as pc

    return np.asarray(pc.fill_null(pc.match_substring_regex(texts, r"\p{L}"), False).to_numpy(zero_copy_only=False), bool)


def grams(found: words.Words) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each n-gram of each word, a space at both of its ends, and its word."""
    # Words are laid out with one blank before each and one after the last.
    size = found.end - found.begin
    total = int(size.sum() + len(size))
    if not len(size):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    line = np.full(total + 1, 0x20, np.uint8)
    at = np.repeat(found.begin, size) + words.ranges(size)
    first = np.cumsum(size + 1) - size
    line[np.repeat(first, size) + words.ranges(size)] = found.raw[at]
    owner = np.full(total + 1, len(size) - 1, np.int64)
    owner[np.repeat(first - 1, size + 1) + words.ranges(size + 1)] = np.repeat(np.arange(len(size)), size + 1)
    blank = line == 0x20
    buckets, owners = [], []
    h = np.zeros(total + 1, np.uint32)
    inner = np.zeros(total + 1, np.int32)  # blanks among the bytes of a gram but its first and last
    for n in range(1, max(GRAMS) + 1):
        m = total + 2 - n
        h = (h[:m] * np.uint32(0x01000193)) ^ line[n - 1 : n - 1 + m]
        if n > 2:
            inner = inner[:m] + blank[n - 2 : n - 2 + m]
        if n in GRAMS:
            ok = (inner[:m] == 0) if n > 1 else ~blank[:m]
            k = np.flatnonzero(ok)
            x = (h[k] ^ (h[k] >> np.uint32(15))) * np.uint32(0x85EBCA6B)
            buckets.append((x >> np.uint32(17)).astype(np.int64) % BUCKETS)
            owners.append(owner[k])
    return np.concatenate(buckets), np.concatenate(owners)


@dataclass
class Model:
    """Languages, their log-probabilities by bucket, and the scripts that each uses."""

    langs: list[str]
    table: np.ndarray
    scripts: np.ndarray
    penalty: float = PENALTY

    def word_scores(self, found: words.Words) -> tuple[np.ndarray, np.ndarray]:
        """Scores of each word for each language, and letters of each word."""
        n = len(found.hash)
        scores = np.zeros((n, len(self.langs)), np.float32)
        bucket, owner = grams(found)
        for k in range(len(self.langs)):
            scores[:, k] = np.bincount(owner, self.table[k][bucket], minlength=n)
        script, start = letters(found.raw)
        count = np.zeros(n, np.int64)
        size = found.end - found.begin
        at = np.repeat(found.begin, size) + words.ranges(size)
        word = np.repeat(np.arange(n), size)
        is_letter = start[at] & (script[at] != OTHER)
        count += np.bincount(word[is_letter], minlength=n)
        # Script ranges: a language that never uses a word's scripts is no candidate for it.
        used = np.zeros((n, OTHER + 1), bool)
        used[word[is_letter], script[at[is_letter]]] = True
        foreign = used.astype(np.float32) @ (~self.scripts).T.astype(np.float32) > 0
        only = ~foreign.all(1)
        scores[foreign & only[:, None]] -= 1000.0
        return scores, count

    def spans(self, scores: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """Best language of each word: Viterbi with a penalty for each change, text by text.

        All texts of a batch step together, longest first, so a step is a few vector operations.
        """
        n, k = scores.shape
        labels = np.zeros(n, np.int16)
        if not n:
            return labels
        order = np.argsort(-np.diff(doc), kind="stable")
        first, size = doc[:-1][order], np.diff(doc)[order]
        live = int((size > 0).sum())
        first, size = first[:live], size[:live]
        back = np.zeros((n, k), np.int8 if k < 128 else np.int16)
        now = scores[first].astype(np.float64)
        steps = np.searchsorted(-size, -np.arange(1, int(size[0]) + 1), side="right")
        own = np.arange(k)
        for t in range(1, int(size[0])):
            m = int(steps[t])
            past = now[:m]
            best = past.argmax(1)
            jump = past[np.arange(m), best] - self.penalty
            stay = past >= jump[:, None]
            at = first[:m] + t
            back[at] = np.where(stay, own, best[:, None])
            now[:m] = np.where(stay, past, jump[:, None]) + scores[at]
        label = now.argmax(1)
        end = first + size - 1
        labels[end] = label
        for t in range(int(size[0]) - 1, 0, -1):
            m = int(steps[t])
            at = first[:m] + t
            labels[at - 1] = back[at, labels[at]]
        return labels


def _sample(docs: DataFrame, sample: int, languages: int) -> DataFrame:
    """About so many training rows of each of the most frequent languages, by a hash of doc_id."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    rows = rows.where("doc_id is not null and text is not null and lang is not null").where(~crc_is_held_out(F.col("doc_id")))
    most = rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(languages)
    share = most.select("lang", F.least(F.lit(1.0), sample / F.col("n")).alias("share"))
    return rows.join(F.broadcast(share), "lang").where(F.pmod(F.xxhash64(F.col("doc_id"), F.lit("train")), F.lit(1 << 20)) < F.col("share") * (1 << 20))


def train(docs: DataFrame, sample: int = SAMPLE, penalty: float = PENALTY, languages: int = LANGUAGES) -> Model:
    """Learns from text and lang of documents outside of the held-out fold.

    A bounded sample of rows: ``sample`` for each of at most ``languages`` languages, chosen by a
    hash of doc_id, whole texts.  What comes to the driver, and is broadcast, is at most BUCKETS
    numbers for each of these languages.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        scripts: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = np.array(batch.column(1).to_pylist(), object)
            for lang in sorted(set(langs.tolist())):
                texts = batch.column(0).filter(pa.array(langs == lang))
                table = counts.setdefault(lang, np.zeros(BUCKETS, np.int64))
                used = scripts.setdefault(lang, np.zeros(OTHER + 1, np.int64))
                for i, j in words.slices(texts):
                    found = words.scan(texts.slice(i, j - i), words.SPACE_WORDS, True)
                    table += np.bincount(grams(found)[0], minlength=BUCKETS)
                    script, start = letters(found.raw)
                    used += np.bincount(script[start], minlength=OTHER + 1)
        for lang, table in counts.items():
            some = np.flatnonzero(table)
            use = np.flatnonzero(scripts[lang])
            yield pa.record_batch([pa.array([lang] * (len(some) + len(use))), pa.array(np.concatenate([some, BUCKETS + use]), pa.int64()), pa.array(np.concatenate([table[some], scripts[lang][use]]), pa.int64())], ["lang", "bucket", "n"])

    counted = _sample(docs, sample, languages).select("text", "lang").mapInArrow(narrow(run), "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    got = counted.toArrow().to_pandas()
    langs = sorted(got["lang"].unique().tolist())
    table = np.zeros((len(langs), BUCKETS))
    scripts = np.zeros((len(langs), OTHER + 1), bool)
    for k, lang in enumerate(langs):
        own = got[got["lang"] == lang]
        bucket, n = own["bucket"].to_numpy(), own["n"].to_numpy()
        gram = bucket < BUCKETS
        row = np.full(BUCKETS, SMOOTHING)
        row[bucket[gram]] += n[gram]
        table[k] = np.log(row / row.sum())
        used = np.zeros(OTHER + 1)
        used[bucket[~gram] - BUCKETS] = n[~gram]
        scripts[k] = used > 0.001 * max(used[:OTHER].sum(), 1)
        scripts[k, OTHER] = True
    return Model(langs, table.astype(np.float32), scripts, penalty)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score, n_spans for every row; only the text is looked at.

    lang_pred is the language that most letters of the text's words are labelled with, ties to
    the first in the alphabet; ``und`` if the text is null or has no letter, or nothing was
    learned, with a score of 0.  score is that language's share of the letters.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def flush(kept: list, model: Model) -> Iterator[pa.RecordBatch]:
        if not kept:
            return
        scores = np.concatenate([x[1] for x in kept])
        letter = np.concatenate([x[2] for x in kept])
        counts = np.concatenate([x[3] for x in kept])
        known = np.concatenate([x[4] for x in kept])
        doc = np.concatenate([[0], np.cumsum(counts)])
        k, n = len(model.langs), len(counts)
        owner = np.repeat(np.arange(n), counts)
        labels = model.spans(scores, doc) if k else np.zeros(len(owner), np.int16)
        # A text whose letters are of no range still has words; they count by their number.
        weight = letter + np.repeat(np.bincount(owner, letter, minlength=n) == 0, counts)
        share = np.bincount(owner * max(k, 1) + labels, weight, minlength=n * max(k, 1)).reshape(n, max(k, 1))
        total = share.sum(1)
        best = share.argmax(1)
        change = np.ones(len(labels), bool)
        change[1:] = (labels[1:] != labels[:-1]) | (owner[1:] != owner[:-1])
        spans = np.bincount(owner[change], minlength=n)
        sure = known & (total > 0) & (k > 0)
        names = [model.langs[b] if ok else "und" for b, ok in zip(best.tolist(), sure.tolist(), strict=True)]
        score = np.where(sure, share[np.arange(n), best] / np.maximum(total, 1), 0.0)
        ids = pa.concat_arrays([x[0] for x in kept])
        yield pa.record_batch([ids, pa.array(names, pa.string()), pa.array(score, pa.float64()), pa.array(spans, pa.int64())], ["doc_id", "lang_pred", "score", "n_spans"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        kept: list = []
        size = 0
        for batch in batches:
            for i, j in words.slices(batch.column(1), 2 * words.SCAN_BYTES // max(4, len(own.langs))):
                texts = batch.column(1).slice(i, j - i)
                found = words.scan(texts, words.SPACE_WORDS, True)
                scores, letter = own.word_scores(found) if own.langs else (np.zeros((len(found.hash), 0), np.float32), np.zeros(len(found.hash), np.int64))
                kept.append((batch.column(0).slice(i, j - i), scores, letter, found.counts(), has_letter(texts)))
                size += len(found.hash) * max(1, len(own.langs))
                if size >= BATCH_SCORES:
                    yield from flush(kept, own)
                    kept, size = [], 0
        yield from flush(kept, own)

    return text_only(docs).mapInArrow(narrow(run), "doc_id long, lang_pred string, score double, n_spans long")


def identify(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, lang_pred, score, n_spans for every row of docs.

    The model is learned from rows outside of the held-out fold that have a text and a language.
    A null doc_id is in no fold: held_out is false, and the row is not learned from.  Repeated
    rows come back as often.  Extra columns are not read.
    """
    found = predict(docs, train(docs, sample))
    return found.select("doc_id", F.coalesce(crc_is_held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "lang_pred", "score", "n_spans")
