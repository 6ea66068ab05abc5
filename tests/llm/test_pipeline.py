import os
import random
import zlib

import pytest
from conftest_llm import corpus
from pyspark.sql import functions as F
from test_lines_and_spans import brute_lines
from test_neardup import brute
from test_scans import alnum, brute_hits, brute_verdicts

import corpus_pipeline as pipeline
from unitloom.llm import bpe, decontaminate

NAMES = [name for name, _ in pipeline.STAGES]


def rows_of(df):
    return sorted((tuple(r) for r in df.select(*pipeline.COLUMNS).collect()), key=str)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Documents with copies, shared lines and passages, junk, benchmark passages and odd rows."""
    out, own = str(tmp_path_factory.mktemp("sf")), random.Random(21)
    texts = corpus(21, 260)
    long = [t for t in texts if t and len(t.split()) > 90]
    texts += [" ".join(w + "##" for w in t.split()) for t in long[:4]]
    passage = long[5].split()
    texts += [" ".join(passage[10:40]) + " " + " ".join(own.sample(long[7].split(), 60)), " ".join(passage[5:70]) + " tail"]
    shared = "this is a line that many of the documents of this table have in common"
    texts += [f"{' '.join(own.sample(t.split(), 70))}\n{shared}\nend {k}" for k, t in enumerate(long[:9])]
    rows = [(i, t, ["en", "de"][i % 2], "s", None if t is None else len(t)) for i, t in enumerate(texts)]
    rows += [(None, long[3], "en", "s", 1), (None, None, None, None, None), rows[40], rows[40], (9000, None, None, "s", None), (9001, "\n" * 9, "en", None, 9), (9002, "x", "fr", "s", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{out}/documents.parquet")
    items = [(1, " ".join(passage[12:38])), (2, None), (3, "three odd words"), (4, " ".join(passage[30:60]))]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{out}/benchmark.parquet")
    return out


@pytest.fixture(scope="module")
def stages(spark, folder):
    """Input and output of each stage as lists of rows, and the result of the last one."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    found = {}
    for k, (name, stage) in enumerate(pipeline.STAGES):
        out = stage(spark, docs, folder)
        if k == len(pipeline.STAGES) - 1:
            found[name] = rows_of(docs), out.collect()
        else:
            assert out.columns == pipeline.COLUMNS
            path = f"{folder}/{name}"
            out.write.parquet(path)
            found[name] = rows_of(docs), rows_of(spark.read.parquet(path))
            docs = spark.read.parquet(path)
    return found


def test_quality_stage(stages):
    before, after = stages["quality_rules"]
    verdicts = brute_verdicts([(k, r[2], r[3], r[1]) for k, r in enumerate(before)])
    assert after == [r for k, r in enumerate(before) if verdicts[k] or r[0] is None]
    assert 0 < len(after) < len(before)


def test_line_stage(stages):
    before, after = stages["line_dedup"]
    kept = {i: text for i, _, _, text in brute_lines([r[:2] for r in before if r[0] is not None], 40, 5)}
    want = []
    for i, text, *rest in before:
        new = text if text is None or i is None else kept[i]
        want.append((i, new, *rest[:-1], rest[-1] if new == text else len(new)))
    assert after == sorted(want, key=str) and after != before


def test_near_dedup_stage(stages):
    before, after = stages["near_dedup"]
    named = [r for r in before if r[0] is not None]
    ids = sorted({r[0] for r in named})
    texts = {r[0]: r[1] for r in named}
    groups = brute([texts[i] for i in ids], 5, 80)
    gone = {ids[k] for k, _, c, _ in groups if c != k}
    assert after == [r for r in before if r[0] not in gone] and gone


def test_decontamination_stage(stages, spark, folder):
    before, after = stages["benchmark_decontamination"]
    items = [(str(r.item_id), r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect() if r.text]
    left = {}
    for r in after:
        left.setdefault(r[0], []).append(r)
    cut = 0
    for r in before:
        n, hit, _ = brute_hits(r[1], items, decontaminate.WINDOW)
        if not hit:
            assert (*r[:4], r[4] if r[1] is None else len(r[1])) in left[r[0]]
        elif 2 * len(hit) > n:
            assert r[0] not in left
        else:
            cut += 1
            assert alnum(left[r[0]][0][1]) == [w for k, w in enumerate(alnum(r[1])) if k not in hit]
    assert cut and len(after) <= len(before)


def test_packing_stage(stages):
    before, pieces = stages["curve_packing"]
    model = bpe.encoder(bpe.default_path()).model
    want = sorted(([*model.encode(r[1] or "", add_special_tokens=False).ids, 1] for r in before), key=str)
    by, sequences = {}, {}
    for p in pieces:
        by.setdefault(p.doc_id, []).append(p)
        sequences.setdefault(p.sequence_id, []).append((p.offset, p.length))
    assert sum(p.length for p in pieces) == sum(map(len, want))
    for i, own in by.items():
        if sum(r[0] == i for r in before) == 1:
            ids = b"".join(p.ids for p in sorted(own, key=lambda p: p.start))
            text = next(r[1] for r in before if r[0] == i)
            expected = [*model.encode(text or "", add_special_tokens=False).ids, 1]
            import numpy as np

            kind = np.uint16 if len(ids) == 2 * len(expected) else np.uint32
            assert np.frombuffer(ids, kind).tolist() == expected
            assert all(p.doc_tokens == len(expected) for p in own)
            for p in own:
                assert p.ids_crc32 == zlib.crc32(np.array(expected[p.start : p.start + p.length], "<u4").tobytes())
    for own in sequences.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        assert at == 2048 or at & (at - 1) == 0


def test_run_is_the_stages_one_after_the_other(spark, folder, stages):
    out = pipeline.run(spark, folder)
    got = sorted((p.doc_id is None, p.doc_id or 0, p.start, p.length, p.ids_crc32) for p in out.select("doc_id", "start", "length", "ids_crc32").collect())
    _, pieces = stages["curve_packing"]
    whole = lambda rows: sorted((i or 0, n) for i, n in rows)
    assert whole({(p[1], p[4]) for p in got if p[2] == 0 and p[3] < 50}) == whole({(p.doc_id or 0, p.ids_crc32) for p in pieces if p.start == 0 and p.length < 50})
    assert sum(p[3] for p in got) == sum(p.length for p in pieces)


def test_a_failing_stage_leaves_no_folder(spark, folder, monkeypatch, tmp_path):
    def fails(spark, docs, sf_dir):
        raise ValueError("no")

    base = str(tmp_path)
    monkeypatch.setattr(pipeline, "scratch", lambda spark: base)
    monkeypatch.setattr(pipeline, "STAGES", [("first", lambda spark, docs, sf_dir: docs), ("second", fails), *pipeline.STAGES[2:]])
    with pytest.raises(ValueError, match="no"):
        pipeline.run(spark, folder)
    assert os.listdir(base) == []


@pytest.mark.parametrize("name", NAMES)
def test_stages_on_odd_and_empty_tables(spark, folder, odd, none, name):
    stage = dict(pipeline.STAGES)[name]
    clash = odd.withColumn("__ul_hits", F.lit("clash")).withColumn("__ul_row", F.lit("clash"))
    out = stage(spark, clash, folder)
    assert out.count() >= 2
    if name != NAMES[-1]:
        assert out.columns == pipeline.COLUMNS and out.where("doc_id is null").count() == 2
    assert stage(spark, none, folder).count() == 0
