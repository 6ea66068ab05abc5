import hashlib
import re
from collections import defaultdict

import pytest
from conftest_llm import corpus, table
from pyspark.sql import functions as F

from unitloom.llm import linededup, spans


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute_lines(rows, least_chars, least_docs):
    key = lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(" \t\n\x0b\x0c\r"))
    holders = defaultdict(set)
    for i, text in rows:
        for x in (text or "").split("\n"):
            if len(key(x)) >= least_chars:
                holders[key(x)].add(i)
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        stay = [x for x in lines if len(holders[key(x)]) < least_docs or max(holders[key(x)]) == i]
        out.append((i, len(lines), len(lines) - len(stay), "\n".join(stay)))
    return sorted(out)


@pytest.mark.parametrize("batches", [1, 3, 7])
@pytest.mark.parametrize(("chars", "least"), [(40, 5), (1, 2)])
def test_lines_equal_brute_force(spark, batches, chars, least):
    texts = corpus(9)
    got = linededup.line_dedup(table(spark, texts), chars, least, batches).select("doc_id", "n_lines", "n_dropped", "kept_text")
    assert sorted(map(tuple, got.collect())) == brute_lines(list(enumerate(texts)), chars, least)


def test_runs_are_compacted(spark):
    store = linededup.LineRuns(1, fanout=2)
    docs = table(spark, ["a\nb", "b\nc", "c\nd", "a", "e"], [9, 7, 5, 3, 1])
    new = [store.add(docs.where(F.col("doc_id") == i).select("doc_id", "text")).count() for i in (9, 7, 5, 3, 1)]
    assert new == [2, 1, 1, 0, 1]
    assert [len(level) for level in store.levels] == [1, 0, 1]
    assert store.common(2).count() == 3


def test_odd_lines(odd, none):
    out = linededup.line_dedup(odd, 5, 2)
    assert out.count() == 9 and {"key", "a", "kept_text"} <= set(out.columns)
    assert {tuple(r) for r in out.where("doc_id = 4").select("n_lines", "n_dropped", "kept_text").collect()} == {(1, 1, "")}
    assert out.where("doc_id is null").agg(F.sum("n_dropped")).first()[0] == 0
    assert linededup.line_dedup(none).count() == 0


def brute_spans(rows, span):
    first = {}
    words = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    for i, ws in words:
        for k in range(len(ws) - span + 1):
            w = tuple(ws[k : k + span])
            first[w] = min(first.get(w, i), i)
    out = []
    for i, ws in words:
        gone = set()
        for k in range(len(ws) - span + 1):
            if first[tuple(ws[k : k + span])] < i:
                gone.update(range(k, k + span))
        out.append((i, len(ws), len(gone), " ".join(w for k, w in enumerate(ws) if k not in gone)))
    return sorted(out)


@pytest.mark.parametrize(("span", "k"), [(50, 24), (12, 4), (9, 9), (5, 1)])
def test_spans_equal_brute_force(spark, span, k):
    texts = corpus(11, 160) + ["a " * 200, "b " * 3 + "a " * 120, "a b " * 60]
    got = spans.remove_spans(table(spark, texts), span, k)
    assert sorted(map(tuple, got.collect())) == brute_spans(list(enumerate(texts)), span)


def test_words_that_a_weak_hash_confuses(spark):
    one = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
    other = one.translate(str.maketrans("ab", "ba"))
    around = " ".join(f"w{i}" for i in range(30))
    got = spans.remove_spans(table(spark, [f"{around} {x} {around}" for x in (one, other, one)]), 50, 24)
    assert sorted(r[2] for r in got.collect()) == [0, 0, 61]


def test_digest_is_of_the_kept_text(docs):
    plain = {r.doc_id: r.kept for r in spans.remove_spans(docs).collect()}
    assert {r.doc_id: r.kept for r in spans.remove_spans(docs, digest=True).collect()} == {i: sha(t) for i, t in plain.items()}


def test_odd_spans(odd, none):
    got = [tuple(r) for r in spans.remove_spans(odd, 2, 1).collect()]
    assert len(got) == 9 and all(r[2] == 0 for r in got if r[0] in (None, 1, 2, 3, 4))
    assert sorted(r[1:3] for r in got if r[0] == 5) == [(3, 3), (4, 4)]
    assert spans.remove_spans(none).count() == 0


def test_rows_of_one_document_count_once(spark):
    texts = ["shared line", "shared line", "shared line", "shared line", "shared line"]
    rows = table(spark, texts, [4, 4, 4, 5, 5])
    assert linededup.line_dedup(rows, 5, 3).where("n_dropped > 0").count() == 0
    assert linededup.line_dedup(rows, 5, 2).where("n_dropped > 0").count() == 3
