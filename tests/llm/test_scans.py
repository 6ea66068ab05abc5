import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from conftest_llm import corpus, table
from pyspark.sql import functions as F

from unitloom.llm import decontaminate as D, langid, licenses, quality, words


def alnum(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_hits(text, items, window):
    ws, hit, found = alnum(text), set(), set()
    for name, item in items:
        iw = alnum(item)
        if not iw:
            continue
        k = min(window, len(iw))
        windows = {tuple(iw[i : i + k]) for i in range(len(iw) - k + 1)}
        for i in range(len(ws) - k + 1):
            if tuple(ws[i : i + k]) in windows:
                hit.update(range(i, i + k))
                found.add(name)
    return len(ws), hit, found


def test_automaton_equals_brute_force():
    own = random.Random(1)
    for _ in range(400):
        window, letters = own.choice([2, 3, 5]), "abc"[: own.choice([2, 3])]
        items = [(str(i), " ".join(own.choice(letters) for _ in range(own.choice([0, 1, 2, 4, 9, 14])))) for i in range(own.randint(0, 4))]
        texts = [" ".join(own.choice(letters + "d") for _ in range(own.randint(0, 25))) for _ in range(3)]
        found = words.scan(pa.array(texts), words.ALNUM_WORDS, True)
        hit, matches = D.Automaton(items, window).hits(found)
        for d, text in enumerate(texts):
            _, want, names = brute_hits(text, items, window)
            assert set(np.flatnonzero(hit[found.doc[d] : found.doc[d + 1]]).tolist()) == want
            assert {items[x][0] for at, got in matches if found.doc[d] <= at < found.doc[d + 1] for x in got} == names


def bench(spark, texts):
    passage = [t for t in texts if t and len(t.split()) > 60][3].split()
    rows = [(1, " ".join(passage[3:25])), (2, " ".join(passage[20:60])), (10, "two words"), (3, None), (None, "x y z"), (4, "..."), (5, "absent " * 20)]
    return spark.createDataFrame(rows, "item_id long, text string"), [(str(i), t) for i, t in rows if i is not None and t]


@pytest.mark.parametrize("limit", [1 << 20, 60])
def test_contamination_equals_brute_force(spark, limit):
    import hashlib

    texts = corpus(13)
    items, plain = bench(spark, texts)
    got = {r.doc_id: tuple(r)[1:] for r in D.contamination(table(spark, texts), items, 10, limit).collect()}
    for i, t in enumerate(texts):
        n, hit, names = brute_hits(t, plain, 10)
        assert got[i] == (n, len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit))
    assert sum(x[4] for x in got.values()) > 3


def test_decontaminated_texts_have_no_window(spark):
    texts = corpus(13)
    items, plain = bench(spark, texts)
    out = {r.doc_id: r.text for r in D.decontaminate(table(spark, texts), items).collect()}
    for i, t in enumerate(texts):
        n, hit, _ = brute_hits(t, plain, 10)
        if not hit:
            assert out[i] == t
        elif len(hit) * 2 > n:
            assert i not in out
        else:
            assert alnum(out[i]) == [w for k, w in enumerate(alnum(t)) if k not in hit]


def test_odd_contamination(spark, odd, none):
    items = spark.createDataFrame([(1, "dup text here now"), (1, "dup text here now")], "item_id long, text string").withColumn("doc_id", F.lit(3))
    got = [tuple(r) for r in D.contamination(odd, items).collect()]
    assert len(got) == 9 and sorted(r[0] for r in got if r[5]) == [4, 4, 5]
    assert D.contamination(odd, items.where("false")).where("contaminated").count() == 0
    assert D.contamination(none, items).count() == 0
    assert D.decontaminate(odd, items).columns == odd.columns and D.decontaminate(odd, items).count() == 6


def test_licenses_equal_brute_force(spark):
    texts = corpus(17) + ["This is under the MIT License and the Apache License.", "apache license " * 40, "x " * 50 + "licensed under CC BY-NC 4.0" + " y" * 90, "mit-license", "MIT\nLicense", "mit x license"]
    texts += ["x " * 37 + re.sub("[(),]", "", t) + " y" * 90 for t, _ in licenses.TEMPLATES[-7:]] + [" ".join(w for k, w in enumerate(t.split()) if k % 11) for t, _ in licenses.TEMPLATES[-7:]]
    got = {r.doc_id: tuple(r)[1:] for r in licenses.license_scan(table(spark, texts)).collect()}
    for i, t in enumerate(texts):
        ws = alnum(t)
        places = [(k, label) for phrase, label in licenses.PHRASES for k in range(len(ws)) if ws[k : k + len(phrase.split())] == phrase.split()]
        base = {x for _, x in places}
        every, score = set(base), float(bool(places))
        for template, label in licenses.TEMPLATES:
            size = licenses.block_of(len(alnum(template)))
            own = set(alnum(template))
            for s in range(0, max(len(ws), 1), size // 2):
                block = set(ws[s : s + size])
                if 100 * len(own & block) >= licenses.PERCENT * len(own):
                    every.add(label)
                    score = max(score, len(own & block) / len(own))
        at = [k for k, _ in places]
        assert got[i] == (len(ws), len(places), min(at, default=None), max(at, default=None), ",".join(sorted(base)), ",".join(sorted(every)), score)


def test_words_in_another_place_are_no_notice(spark):
    # Five words of a short notice far from each other, and a passage of a long one's length.
    texts = ["released " + "x " * 12 + "under " + "x " * 12 + "the mit " + "x " * 12 + "license", "released under the mit license", "x " * 7 + "license mit released the under"]
    got = {r.doc_id: r.labels for r in licenses.license_scan(table(spark, texts)).collect()}
    assert got == {0: "", 1: "mit", 2: "mit"}


def test_each_license_filter_rejects():
    own = licenses.Templates([("a b c d e f g h i j", "x")], 80, dict.fromkeys(range(10), 1))
    size, t = licenses.block_of(10), own.sets[0]
    assert list(own.left(t, size)) == [0] and list(own.left(t[2:], size)) == [0]
    assert list(own.left(t[3:], size)) == []  # no word of the prefix
    assert list(own.left(t[:7], size)) == []  # too few words
    other = licenses.Templates([("a b c d e f g h i j", "x"), ("k l m n o p", "y")], 80, {})
    late = sorted({w for w in other.sets[1]} | {other.sets[0][2], *other.sets[0][4:6]})
    assert len(late) >= other.need[0] and 0 not in list(other.left(late, size))  # too few words from the first shared one on


def test_odd_licenses(odd, none):
    assert licenses.license_scan(odd).count() == 9 and licenses.license_scan(none).count() == 0


def features(text):
    ws = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    count, covered = Counter(zip(ws, ws[1:], ws[2:], strict=False)), set()
    for k in range(len(ws) - 2):
        if count[tuple(ws[k : k + 3])] > 1:
            covered.update((k, k + 1, k + 2))
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(ws) < 50 or 100 * len(covered) > 50 * len(ws)
    return len(ws), sum(map(len, ws)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered), failed


def test_decontaminate_is_the_same_over_blocks(spark):
    text = " ".join(f"w{i}" for i in range(100))
    item = lambda a, b: " ".join(f"w{i}" for i in range(a, b))
    for spans, want in (([(10, 30), (21, 39)], 71), ([(0, 30), (30, 60)], None)):
        items = spark.createDataFrame([(str(k), item(*s)) for k, s in enumerate(spans)], "item_id string, text string")
        for limit in (1, 1 << 19):
            got = [len(r.text.split()) for r in D.decontaminate(table(spark, [text]), items, limit=limit).collect()]
            assert got == ([] if want is None else [want])


def test_decontamination_of_many_blocks_on_odd_rows(spark, odd):
    items = spark.createDataFrame([(1, "dup text here"), (2, "another text altogether"), (3, "no such words"), (4, None)], "item_id long, text string")
    rows = [sorted(map(str, D.decontaminate(odd, items, limit=limit).collect())) for limit in (20, 60, 1 << 20)]
    assert rows[0] == rows[1] == rows[2] and len(rows[0]) == 5
    assert D.decontaminate(odd, items, limit=20).columns == odd.columns
    assert D.decontaminate(odd, items.where("false"), limit=20).count() == 9


def test_colliding_words_are_no_hits(spark):
    one = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
    other = one.translate(str.maketrans("ab", "ba"))
    tail = " ".join(f"w{i}" for i in range(9))
    items = spark.createDataFrame([(1, f"{one} {tail}")], "item_id long, text string")
    assert [r.n_hit for r in D.contamination(table(spark, [f"{other} {tail}", f"{one} {tail}"]), items).orderBy("doc_id").collect()] == [0, 10]


def test_quality_features_equal_brute_force(spark):
    texts = corpus(19) + ["a b c " * 40, "#x&y|z <>$%* " * 30, "l\nl\n l\nl\n\n\n"]
    got = {r.doc_id: tuple(r)[1:7] for r in quality.quality(table(spark, texts)).collect()}
    assert got == {i: features(t) for i, t in enumerate(texts)}


def test_quality_rejects_outliers_alone(spark):
    clean = [t for t in corpus(19, 200) if t and len(t.split()) > 60]
    junk = " ".join(w + "###" for w in clean[0].split())
    texts = [*clean, junk]
    got = {r.doc_id: r.kept for r in quality.quality(table(spark, texts)).collect()}
    assert not got[len(clean)] and all(got[i] for i in range(len(clean)) if not features(clean[i])[5])
    kept = quality.keep_good(table(spark, texts))
    assert kept.where(F.col("doc_id") == len(clean)).count() == 0


def scaled(feature):
    n, chars, symbols, dup, repeat, lines = feature
    return [math.log((x + 1) / (y + 1)) for x, y in ((symbols, chars), (dup, lines), (repeat, n), (chars, n))]


def brute_verdicts(rows):
    """rows: (key, lang, source, text); the verdicts by exact quartiles."""
    known = {}
    for key, lang, source, text in rows:
        n, chars, symbols, dup, repeat, failed = features(text)
        lines = len([x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)])
        known[key] = (lang or "", source or "", failed, scaled((n, chars, symbols, dup, repeat, lines)))

    def quartiles(test):
        own = [v for lang, source, failed, v in known.values() if not failed and test(lang, source)]
        at = lambda xs, q: sorted(xs)[max(math.ceil(q * len(xs)), 1) - 1]
        return len(own), [(at(xs, 0.25), at(xs, 0.75)) for xs in zip(*own, strict=True)]

    def below(own, above):
        n, pairs = own
        return [tuple(y + (x - y) * (n / (n + quality.PRIOR)) for x, y in zip(p, q, strict=True)) for p, q in zip(pairs, above, strict=True)]

    def fence(p, width=quality.FENCE):
        return p[0] - width * (p[1] - p[0]), p[1] + width * (p[1] - p[0])

    out = {}
    _, whole = quartiles(lambda lang, source: True)
    for key, (lang, source, failed, values) in known.items():
        out[key] = not failed
        if failed:
            continue
        in_lang = quartiles(lambda x, _, lang=lang: x == lang)
        by_lang = below(in_lang, whole)
        own = below(quartiles(lambda x, y, lang=lang, source=source: (x, y) == (lang, source)), by_lang)
        for k, v in enumerate(values):
            fences = [fence(by_lang[k]), fence(in_lang[1][k])]
            least, most = min(f[0] for f in fences), max(f[1] for f in fences)
            outer = fence(by_lang[k], 2 * quality.FENCE)
            low = max(min(fence(own[k])[0], least), min(outer[0], least))
            high = min(max(fence(own[k])[1], most), max(outer[1], most))
            out[key] &= v <= high and (k != 3 or v >= low)
    return out


def test_verdicts_equal_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf.replace('0.001', '0.01')}/documents.parquet")
    rows = [(r.doc_id, r.lang, r.source, r.text) for r in docs.collect()]
    got = {r.doc_id: r.kept for r in quality.quality(docs).collect()}
    want = brute_verdicts(rows)
    assert got == want
    beyond = [i for i, _, _, t in rows if not want[i] and not features(t)[5]]
    assert 20 < len(beyond) < 0.1 * len(rows)
    assert sorted(r.doc_id for r in quality.keep_good(docs).collect()) == sorted(i for i, ok in want.items() if ok)


def test_a_bad_source_does_not_lift_its_limits(spark):
    clean = [t for t in corpus(19, 200) if t and len(t.split()) > 60]
    junk = [" ".join(w + "##" for w in t.split()) for t in clean[:40]]
    rows = [(i, t, "en", "good", 0) for i, t in enumerate(clean * 3)] + [(10_000 + i, t, "en", "bad", 0) for i, t in enumerate(junk)]
    out = quality.quality(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"))
    assert out.where("doc_id >= 10000 and kept").count() == 0


def test_a_source_of_copies_does_not_reject_the_others(spark):
    clean = [t for t in corpus(19, 300) if t and 60 < len(t.split()) < 200]
    # Four of five rows of a source, and a third of all, are copies of one text.
    rows = [(i, clean[i % len(clean)], "en", "a", 0) for i in range(1000)] + [(1000 + i, clean[0] if i % 5 else clean[i // 5 % len(clean)], "en", "b", 0) for i in range(700)]
    out = quality.quality(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")).where("not base_failed")
    assert out.where("not kept").count() < 0.02 * out.count()


def test_equal_texts_all_stay(spark):
    text = " ".join(f"word{i}" for i in range(80))
    assert quality.quality(table(spark, [text] * 20)).where("kept").count() == 20


def test_quality_salted_join_is_the_same(spark, docs, monkeypatch):
    want = sorted(map(tuple, quality.quality(docs).collect()))
    monkeypatch.setattr(quality, "BROADCAST_ROWS", 0)
    assert sorted(map(tuple, quality.quality(docs).collect())) == want


def test_odd_quality(odd, none):
    out = quality.quality(odd.drop("lang"))
    assert out.count() == 9 and out.where("kept").count() == 0
    assert quality.keep_good(odd).where("doc_id is null").count() == 2
    assert quality.quality(none).count() == 0 and quality.keep_good(none).count() == 0


def test_viterbi_equals_brute_force():
    own = np.random.default_rng(2)
    for _ in range(40):
        k, sizes = int(own.integers(1, 4)), own.integers(0, 6, 5)
        doc = np.concatenate([[0], np.cumsum(sizes)])
        scores = own.normal(0, 3, (int(doc[-1]), k)).astype(np.float32)
        model = langid.Model(["a", "b", "c"][:k], np.zeros((k, 1)), np.ones((k, 12), bool), 2.0)
        labels = model.spans(scores, doc)
        worth = lambda path, s: sum(s[i, x] for i, x in enumerate(path)) - 2.0 * sum(a != b for a, b in zip(path, path[1:], strict=False))
        for a, b in zip(doc[:-1], doc[1:], strict=True):
            best = max((worth(np.unravel_index(p, (k,) * (b - a)), scores[a:b]) for p in range(k ** (b - a))), default=0)
            assert worth(labels[a:b], scores[a:b]) == pytest.approx(best, abs=1e-4)


def test_held_out_accuracy(spark, sf):
    docs = spark.read.parquet(f"{sf.replace('0.001', '0.01')}/documents.parquet")
    rows = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r.held_out]
    assert len(held) > 200 and sum(r.lang == r.lang_pred for r in held) > 0.97 * len(held)


def test_mixed_texts_have_spans(spark, sf):
    docs = spark.read.parquet(f"{sf.replace('0.001', '0.01')}/documents.parquet")
    by = {r.lang: r.text for r in docs.where("n_chars > 1500").groupBy("lang").agg(F.first("text").alias("text")).collect()}
    model = langid.train(docs)
    mixed = table(spark, [by["en"][:600] + "\n" + by["de"][:1400], "... 123 !!", None, "", "Привет"])
    got = {r.doc_id: r for r in langid.predict(mixed, model).collect()}
    assert got[0].lang_pred == "de" and 0.4 < got[0].score < 1 and got[0].n_spans >= 2
    assert [got[i].lang_pred for i in (1, 2, 3)] == ["und"] * 3 and got[4].lang_pred in model.langs


def test_scripts_by_code_point():
    own = random.Random(3)
    points = [own.choice([own.randrange(0x20, 0x800), own.randrange(0x800, 0xD800), own.randrange(0xE000, 0x10000), own.randrange(0x10000, 0x33000)]) for _ in range(4000)]
    raw = np.frombuffer("".join(map(chr, points)).encode(), np.uint8)
    script, start = langid.letters(raw)
    want = [next((k for k, name in enumerate(langid.NAMES) if any(a <= p <= b for a, b in langid.SCRIPTS[name]) and p not in (0xD7, 0xF7)), langid.OTHER) for p in points]
    assert script[start].tolist() == want


def test_word_scores_and_narrowing_equal_brute_force():
    langs, own = ["aa", "bb", "cc"], np.random.default_rng(4)
    table = own.normal(-9, 2, (3, langid.BUCKETS)).astype(np.float32)
    scripts = np.zeros((3, langid.OTHER + 1), bool)
    scripts[:, langid.OTHER] = True
    scripts[0, 0] = scripts[1, 0] = scripts[2, langid.NAMES.index("cyrillic")] = True
    found = words.scan(pa.array(["alpha мир x1 தமிழ் ß", "", "мир"]), words.SPACE_WORDS, True)
    scores, count = langid.Model(langs, table, scripts).word_scores(found)

    def bucket(gram):
        h = 0
        for b in gram:
            h = (h * 0x01000193 & 0xFFFFFFFF) ^ b
        return (((h ^ h >> 15) * 0x85EBCA6B) & 0xFFFFFFFF) >> 17

    for i in range(len(found.hash)):
        word = found.word(i)
        line = b" " + word + b" "
        grams = [line[k : k + n] for n in langid.GRAMS for k in range(len(line) - n + 1) if n > 1 or line[k] != 0x20]
        plain = [sum(float(table[k][bucket(g)]) for g in grams if b" " not in g[1:-1]) for k in range(3)]
        kinds = {0 if c.isascii() or c == "ß" else langid.NAMES.index("cyrillic" if c in "мир" else "tamil") for c in word.decode() if c.isalpha() or c in "ிழ்"}
        out = [any(not scripts[k, s] for s in kinds) for k in range(3)]
        want = [p - 1000 * (o and not all(out)) for p, o in zip(plain, out, strict=True)]
        assert scores[i] == pytest.approx(want, abs=0.02)
    assert count.tolist() == [5, 3, 1, 5, 1, 3]


def test_only_the_most_frequent_labels_are_learned(spark):
    rows = [(i, f"word{i % 3} text", ["aa", "bb", "rare"][0 if i < 12 else 1 if i < 20 else 2], "s", 1) for i in range(21)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert langid.train(docs, languages=2).langs == ["aa", "bb"]


def test_odd_languages(odd, none):
    rows = langid.identify(odd).collect()
    assert len(rows) == 9 and not any(r.held_out for r in rows if r.doc_id is None)
    assert all(0 <= r.score <= 1 for r in rows)
    assert langid.identify(none).count() == 0
    assert {r.lang_pred for r in langid.predict(odd, langid.train(none)).collect()} == {"und"}
