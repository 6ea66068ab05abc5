import random
import re

import pyarrow as pa
import pytest

from unitloom.llm import words as w

PATTERNS = [(w.SPACE_WORDS, r"[^\x20\x09-\x0D]+"), (w.ALNUM_WORDS, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")]


@pytest.mark.parametrize("block", [64, 256 << 10])
def test_scan_equals_regex(monkeypatch, block):
    monkeypatch.setattr(w, "HASH_BYTES", block)
    own = random.Random(3)
    for _ in range(60):
        texts = ["".join(own.choice("abé  \nXy9.") for _ in range(own.randint(0, 300))) for _ in range(4)] + [None]
        for table, pattern in PATTERNS:
            found = w.scan(pa.array(texts), table, True)
            got = [[found.word(i).decode() for i in range(found.doc[k], found.doc[k + 1])] for k in range(len(texts))]
            lower = [re.sub("[A-Z]", lambda m: m[0].lower(), x or "") for x in texts]
            assert got == [re.findall(pattern, x) for x in lower]
            by_word = {}
            for i in range(len(found.hash)):
                assert by_word.setdefault(found.word(i), found.hash[i]) == found.hash[i]
            assert len(set(by_word.values())) == len(by_word)


@pytest.mark.parametrize("n", [1, 2, 3, 8, 10, 50])
def test_window_hashes_tell_windows_apart(n):
    own = random.Random(n)
    texts = [" ".join(own.choice("ab") for _ in range(120)) for _ in range(3)]
    found = w.scan(pa.array(texts), w.SPACE_WORDS, False)
    hashes, seen = w.window_hashes(found.hash, n), {}
    for i in w.window_starts(found.doc, n):
        assert seen.setdefault(tuple(found.word(k) for k in range(i, i + n)), hashes[i]) == hashes[i]
    assert len(set(seen.values())) == len(seen)


def test_slices_cover_all_rows():
    texts = pa.array(["x" * k for k in (5, 50, 0, 200, 1)])
    assert list(w.slices(texts, 60)) == [(0, 3), (3, 4), (4, 5)]


def thue_morse(n):
    return "".join("ab"[bin(i).count("1") % 2] for i in range(n))


def test_no_word_collides_by_construction():
    # These collide under every polynomial modulo a power of two with an odd base.
    one = thue_morse(2048)
    other = one.translate(str.maketrans("ab", "ba"))
    for n in (64, 1024, 2048):
        a, b = w.scan(pa.array([one[:n], other[:n]]), w.SPACE_WORDS, False).hash
        assert a != b


def test_very_long_words_are_hashed_alike():
    long = "xyz" * (w.PLAIN_SUMS // 2)
    a, b, c = w.scan(pa.array([long, "q " + long + "z"]), w.SPACE_WORDS, False).hash[[0, 2, 1]]
    assert a != b and a == w.scan(pa.array([long]), w.SPACE_WORDS, True).hash[0] and c not in (a, b)
