"""License scans: phrases, and an exact set-similarity join of text blocks with notice templates.

A template is met by a block of consecutive words that contains enough of its distinct words.  A
template has blocks of its own length: of the first power of two that is twice its number of words
or more, every half of that, so any passage of a template's length lies in one block whole.

The join is exact and never looks at most blocks.  Template words are ordered by the number of
documents that hold them, rarest first, counted over the whole corpus, and a block's template
words are sorted in that order.  A block that meets a template of n words with a need of m holds
one of the template's n - m + 1 first words (prefix filter), has m template words (length filter),
and from the first word that both share there are m - 1 more in the template and in the block
(positional filter).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import words
from .runtime import narrow, text_only

# Phrases whose places are counted, and their labels.
PHRASES = [("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")]

# Sentences and whole texts of well-known public license notices, and their labels.
TEMPLATES = [
    ("licensed under the apache license version 2 0", "apache"),
    ("you may not use this file except in compliance with the license", "apache"),
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit"),
    ("this work is licensed under the gnu general public license version 3", "gpl"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "gpl"),
    ("this library is free software you can redistribute it under the terms of the gnu lesser general public license", "lgpl"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("this work is licensed under a creative commons attribution 4 0 international license", "cc-by"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl"),
    ("all rights reserved no part of this publication may be reproduced without prior written permission", "reserved"),
    (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software "
        "without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit "
        "persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies "
        "or substantial portions of the Software. THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF "
        "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, "
        "WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
        "mit",
    ),
    (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this "
        "permission notice appear in all copies. THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF "
        "MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF "
        "USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
        "isc",
    ),
    (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must "
        "retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of "
        "conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND "
        "CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE "
        "DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT "
        "LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN "
        "CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
        "bsd",
    ),
    (
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, "
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
        "apache",
    ),
    (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either "
        "version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied "
        "warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public "
        "License along with this program.",
        "gpl",
    ),
    (
        "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. "
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following "
        "restrictions: The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an "
        "acknowledgment in the product documentation would be appreciated but is not required. Altered source versions must be plainly marked as such, and must not be misrepresented as "
        "being the original software. This notice may not be removed or altered from any source distribution.",
        "zlib",
    ),
    (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source "
        "code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
        "unlicense",
    ),
]

LEAST_BLOCK = 16
PERCENT = 85


def block_of(n_words: int) -> int:
    """Words of a block for a template of so many words; blocks start every half of it."""
    return max(LEAST_BLOCK, 1 << (2 * n_words - 1).bit_length())


class Templates:
    """Template words by their rank in the global order, and the templates' prefixes.

    ``sets``: ascending ranks of each template's distinct words; ``prefix``: for each block size
    and rank, the (template, place in it) that have the rank in their prefix.
    """

    def __init__(self, templates: list[tuple[str, str]], percent: int, counts: dict[int, int] | None = None) -> None:
        self.labels = [label for _, label in templates]
        hashes = [_hashes(text) for text, _ in templates]
        self.vocabulary = np.unique(np.concatenate(hashes)) if hashes else np.zeros(0, np.uint64)
        many = np.zeros(len(self.vocabulary), np.int64)
        for word, n in (counts or {}).items():
            many[word] = n
        self.rank = np.empty(len(many) + 1, np.int64)
        self.rank[np.argsort(many, kind="stable")] = np.arange(len(many))
        self.rank[-1] = len(many)
        self.sets: list[list[int]] = []
        self.need: list[int] = []
        self.prefix: dict[int, dict[int, list[tuple[int, int]]]] = {}
        for t, own in enumerate(hashes):
            ordered = np.sort(self.rank[np.searchsorted(self.vocabulary, np.unique(own))]).tolist()
            need = -(-percent * len(ordered) // 100)
            self.sets.append(ordered)
            self.need.append(need)
            if ordered:
                by_rank = self.prefix.setdefault(block_of(len(own)), {})
                for i, w in enumerate(ordered[: len(ordered) - need + 1]):
                    by_rank.setdefault(w, []).append((t, i))

    def numbers(self, found: words.Words) -> np.ndarray:
        """Template word number of each word; the number of words for any other."""
        none = len(self.vocabulary)
        if not none:
            return np.zeros(len(found.hash), np.int64)
        at = np.searchsorted(self.vocabulary, found.hash)
        at[at == none] = 0
        at[self.vocabulary[at] != found.hash] = none
        return at

    def left(self, block: list[int], size: int) -> Iterator[int]:
        """Templates of this block size that the three filters leave; block: ascending ranks."""
        by_rank, seen = self.prefix[size], set()
        for j, w in enumerate(block):
            for t, i in by_rank.get(w, ()):
                if t not in seen:
                    # The first word of both, as both are in the same order.
                    seen.add(t)
                    if len(block) >= self.need[t] and min(len(self.sets[t]) - i, len(block) - j) >= self.need[t]:
                        yield t

    def met(self, block: list[int], size: int) -> Iterator[tuple[int, float]]:
        """(template, containment) that a block of this size meets."""
        held = set(block)
        for t in self.left(block, size):
            n = sum(w in held for w in self.sets[t])
            if n >= self.need[t]:
                yield t, n / len(self.sets[t])


def _hashes(text: str) -> np.ndarray:
    return words.scan(pa.array([text]), words.ALNUM_WORDS, True).hash


def template_counts(docs: DataFrame, templates: list[tuple[str, str]]) -> dict[int, int]:
    """Number of documents that hold each template word, over all documents.

    What comes to the driver is one row for each word of the templates, however many documents.
    """
    own = Templates(templates, PERCENT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(own.vocabulary) + 1, np.int64)
        for batch in batches:
            for i, j in words.slices(batch.column(0)):
                found = words.scan(batch.column(0).slice(i, j - i), words.ALNUM_WORDS, True)
                number = own.numbers(found)
                at = np.flatnonzero(number < len(own.vocabulary))
                pairs = np.unique(found.owner()[at] * len(total) + number[at])
                total += np.bincount(pairs % len(total), minlength=len(total))
        some = np.flatnonzero(total)
        yield pa.record_batch([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], ["word", "n"])

    counted = docs.select("text").mapInArrow(narrow(run), "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return {row.word: row.n for row in counted.collect()}


def _phrase_places(found: words.Words, owner: np.ndarray, phrase: np.ndarray) -> np.ndarray:
    last = len(found.hash) - len(phrase) + 1
    if last <= 0:
        return np.zeros(0, np.int64)
    at = np.flatnonzero(found.hash[:last] == phrase[0])
    for k in range(1, len(phrase)):
        at = at[(found.hash[at + k] == phrase[k]) & (owner[at + k] == owner[at])]
    return at


COLUMNS = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def license_scan(docs: DataFrame, phrases: list[tuple[str, str]] | None = None, templates: list[tuple[str, str]] | None = None, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score for every row.

    Words are runs of digits, lower-cased Latin letters and non-ASCII.  n_base counts the places
    where a phrase's words stand one after the other; first_word and last_word are their smallest
    and largest start, null without any.  labels has the phrases' labels and those of templates
    of which some block of their length holds at least ``percent`` of the distinct words.  score is 1 with a
    phrase, else the largest such share, else 0.

    Null and empty texts have no words and no labels; templates without words are met by nothing,
    and without phrases or templates there are no labels.  Null and repeated doc_ids come back row by
    row; extra columns are not read.
    """
    phrases = PHRASES if phrases is None else phrases
    templates = TEMPLATES if templates is None else templates
    plain = text_only(docs)
    own = Templates(templates, percent, template_counts(plain, templates))
    wanted = [(_hashes(text), label) for text, label in phrases]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in words.slices(batch.column(1)):
                found = words.scan(batch.column(1).slice(i, j - i), words.ALNUM_WORDS, True)
                n, owner = found.n_docs, found.owner()
                base: list[set[str]] = [set() for _ in range(n)]
                every: list[set[str]] = [set() for _ in range(n)]
                places = np.zeros(n, np.int64)
                first, last = np.full(n, np.iinfo(np.int64).max), np.full(n, -1)
                for phrase, label in wanted:
                    at = _phrase_places(found, owner, phrase)
                    d = owner[at]
                    places += np.bincount(d, minlength=n)
                    np.minimum.at(first, d, at - found.doc[d])
                    np.maximum.at(last, d, at - found.doc[d])
                    for x in np.unique(d).tolist():
                        base[x].add(label)
                        every[x].add(label)
                score = (places > 0).astype(float)
                for d, t, share in _blocks_met(found, owner, own):
                    every[d].add(own.labels[t])
                    score[d] = max(score[d], share)
                none = places == 0
                yield pa.record_batch(
                    [
                        batch.column(0).slice(i, j - i),
                        pa.array(found.counts(), pa.int64()),
                        pa.array(places, pa.int64()),
                        pa.array(first, pa.int64(), mask=none),
                        pa.array(last, pa.int64(), mask=none),
                        pa.array([",".join(sorted(x)) for x in base], pa.string()),
                        pa.array([",".join(sorted(x)) for x in every], pa.string()),
                        pa.array(score, pa.float64()),
                    ],
                    ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"],
                )

    return plain.mapInArrow(narrow(run), COLUMNS)


def _blocks_met(found: words.Words, owner: np.ndarray, own: Templates) -> Iterator[tuple[int, int, float]]:
    """(text, template, containment) of all blocks that hold a prefix word and meet a template."""
    rank = own.rank[own.numbers(found)]
    for block, by_rank in own.prefix.items():
        asked = np.zeros(len(own.rank), bool)
        asked[list(by_rank)] = True
        at = np.flatnonzero(asked[rank])
        if not len(at):
            continue
        d, step = owner[at], block // 2
        # The two blocks with the word: the one that starts at the last multiple of step, and the one before.
        starts = ((at - found.doc[d]) // step)[:, None] - np.arange(2)[None, :]
        pairs = np.unique(np.stack([np.repeat(d, 2), starts.ravel()])[:, starts.ravel() >= 0], axis=1)
        for x, s in pairs.T.tolist():
            a = int(found.doc[x]) + s * step
            inside = rank[a : min(a + block, int(found.doc[x + 1]))]
            for t, share in own.met(np.unique(inside[inside < len(own.vocabulary)]).tolist(), block):
                yield x, t, share
