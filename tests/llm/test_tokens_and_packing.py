import random
import zlib

import numpy as np
import pytest
from conftest_llm import corpus, table

from unitloom.llm import bpe, packing, tokens

ODD = list("ab Z9.,'\n\t éßñ\xa0　日<|×ȃɏ") + ["<|endoftext|>", "'s", "  ", "\r\n", " \n", "\x1c", "\x85"]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(bpe.default_path())
    return lambda t: own.encode(t or "", add_special_tokens=False).ids


def odd_texts(n, seed=1):
    own = random.Random(seed)
    return ["".join(own.choice(ODD) for _ in range(own.randint(0, 50))) for _ in range(n)] + ["", None, "word " * 5000]


def test_ids_equal_the_library(library):
    import pyarrow as pa

    texts = odd_texts(4000)
    ids, bound = bpe.Encoder(bpe.default_path()).encode(pa.array(texts))
    for i, t in enumerate(texts):
        assert ids[bound[i] : bound[i + 1]].tolist() == library(t)


def test_counts_equal_the_library(spark, library):
    texts = odd_texts(300, 2) + corpus()
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in tokens.token_counts(table(spark, texts)).collect()}
    assert got == {i: (len((t or "").encode()), len(library(t)), len(library(t)) > 1024) for i, t in enumerate(texts)}


def test_sentencepiece_counts(spark):
    import public_tokenizers
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    own = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = ["two words", "", None, "é日"]
    got = {r.doc_id: r.n_tokens for r in tokens.token_counts(table(spark, texts), path).collect()}
    assert got == {i: len(own.encode(t or "")) for i, t in enumerate(texts)}


def test_best_fit_uses_the_tightest_bin():
    own = np.random.default_rng(1)
    for _ in range(30):
        sizes = own.integers(1, 65, 80)
        left, want = [], []
        for item in np.argsort(-sizes, kind="stable"):
            fits = [b for b in range(len(left)) if left[b] >= sizes[item]]
            if fits:
                b = min(fits, key=lambda x: left[x])
            else:
                left.append(64)
                b = len(left) - 1
            left[b] -= sizes[item]
        bins = packing.best_fit(sizes, 64)
        assert sorted(i for b in bins for i in b) == list(range(80))
        want = sorted(64 - x for x in left)
        assert sorted(int(sizes[b].sum()) for b in bins) == want


def test_best_fit_round_trip(spark, library):
    texts = odd_texts(120, 3) + corpus()
    rows = packing.pack_best_fit(table(spark, texts), length=256, block_tokens=4000).toArrow().combine_chunks().to_batches()[0]
    ids, positions = packing.matrix(rows)
    got = {}
    for r, row in enumerate(rows.to_pylist()):
        assert row["n_tokens"] == row["cu_seqlens"][-1] <= 256 and row["position_resets"] == row["cu_seqlens"][:-1]
        for a, b, name, start in zip(row["cu_seqlens"][:-1], row["cu_seqlens"][1:], row["doc_ids"], row["starts"], strict=True):
            got.setdefault(name, {})[start] = ids[r, a:b].tolist()
            assert positions[r, a:b].tolist() == list(range(b - a))
    assert {i: [x for s in sorted(p) for x in p[s]] for i, p in got.items()} == {i: library(t) + [1] for i, t in enumerate(texts)}
    assert len(set(rows["sequence_id"].to_pylist())) == len(rows)


def check_pieces(rows, want, length):
    docs, sequences = {}, {}
    for r in rows:
        own = np.frombuffer(r.ids, "<u2").astype("<u4")
        assert len(own) == r.length and zlib.crc32(own.tobytes()) == r.ids_crc32
        docs.setdefault(r.doc_id, []).append((r.start, own.tolist(), r.doc_tokens))
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert set(docs) == set(want)
    for name, pieces in docs.items():
        assert [x for _, p, _ in sorted(pieces) for x in p] == want[name] and {n for *_, n in pieces} == {len(want[name])}
    for pieces in sequences.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at == length or at & (at - 1) == 0


def test_curve_round_trip(spark, library):
    texts = odd_texts(120, 4) + corpus()
    check_pieces(packing.pack_along_curve(table(spark, texts), length=256).collect(), {i: library(t) + [1] for i, t in enumerate(texts)}, 256)


def test_curve_bounds_its_batches(spark, library, tmp_path):
    from unitloom.session import BATCHES, ship

    def rows(batches):
        import pyarrow as pa

        for batch in batches:
            yield pa.record_batch([pa.array([batch.num_rows], pa.int64())], ["n"])

    held = {name: spark.conf.get(name) for name in BATCHES}
    texts = corpus()
    table(spark, [texts[i % len(texts)] for i in range(3000)]).coalesce(1).write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    try:
        for name, values in BATCHES.items():
            spark.conf.set(name, values[0])
        ship(spark)
        out = packing.pack_along_curve(docs, length=256)
        assert [spark.conf.get(name) for name in BATCHES] == ["1000", "4194304b", "256"]
        assert max(r.n for r in docs.mapInArrow(rows, "n long").collect()) <= 1000
        check_pieces(out.collect(), {i: library(texts[i % len(texts)]) + [1] for i in range(3000)}, 256)
        # A user's own values stay, and give the same pieces.
        want = sorted(map(tuple, out.drop("ids").collect()))
        for name in BATCHES:
            spark.conf.set(name, "7" if name.endswith("BatchSize") else "70")
        assert sorted(map(tuple, packing.pack_along_curve(docs, length=256).drop("ids").collect())) == want
        assert [spark.conf.get(name) for name in BATCHES] == ["70", "70", "7"]
    finally:
        for name, value in held.items():
            spark.conf.set(name, value)


def test_hot_cell_is_dealt_to_many(spark, library):
    texts = ["same text again"] * 400 + corpus()
    docs = table(spark, texts)
    plan = packing.deal(docs.select("doc_id", "text"), target=2000)
    assert int(plan.shares.max()) > 1 and plan.parts >= int((plan.first + plan.shares).max())
    check_pieces(packing.pack_along_curve(docs, length=256).collect(), {i: library(t) + [1] for i, t in enumerate(texts)}, 256)


def test_hilbert_neighbours_touch():
    side = 8
    points = np.stack(np.meshgrid(*[np.arange(side)] * 3, indexing="ij"), -1).reshape(-1, 3)
    keys = packing.hilbert(points, 3)
    assert sorted(keys.tolist()) == list(range(side**3))
    ordered = points[np.argsort(keys)]
    assert (np.abs(np.diff(ordered, axis=0)).sum(1) == 1).all()


def test_odd_packing(odd, none):
    assert tokens.token_counts(odd).count() == 9 and tokens.token_counts(none).count() == 0
    rows = packing.pack_along_curve(odd, length=64).collect()
    assert sum(r.length for r in rows) == sum(r.n_tokens + 1 for r in tokens.token_counts(odd).collect())
    best = packing.pack_best_fit(odd, length=64).collect()
    assert sum(r.n_tokens for r in best) == sum(r.length for r in rows)
    assert packing.pack_along_curve(none).count() == 0 and packing.pack_best_fit(none).count() == 0


def test_added_tokens_of_other_files(tmp_path):
    import pyarrow as pa
    from tokenizers import AddedToken, Tokenizer

    own = Tokenizer.from_file(bpe.default_path())
    own.add_special_tokens(["[PAD]", AddedToken("<sep>", lstrip=True, rstrip=True)])
    own.add_tokens(["new york", AddedToken("solo", single_word=True)])
    own.enable_truncation(4)
    own.enable_padding(length=9)
    path = str(tmp_path / "added.json")
    own.save(path)
    own.no_truncation()
    own.no_padding()
    some = random.Random(8)
    parts = ["hello", " ", "[PAD]", "world", "  ", "<sep>", "new york", "solo", "solos", "\n", "[PA", "D]", ".", "é"]
    texts = ["hello [PAD] world", None, "", *["".join(some.choice(parts) for _ in range(some.randint(0, 12))) for _ in range(500)]]
    model = bpe.Encoder(path)
    ids, bound = model.encode(pa.array(texts))
    want = [own.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert [ids[a:b].tolist() for a, b in zip(bound, bound[1:], strict=False)] == want
    assert model.lengths(pa.array(texts)).tolist() == list(map(len, want)) and len(want[0]) == 4


def test_other_splitting_patterns_are_not_cut(tmp_path):
    import pyarrow as pa
    from tokenizers import Tokenizer, pre_tokenizers

    own = Tokenizer.from_file(bpe.default_path())
    own.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
    path = str(tmp_path / "whole.json")
    own.save(path)
    texts = ["of the people by the people", "a b c", None]
    assert bpe.Encoder(path).lengths(pa.array(texts)).tolist() == [len(own.encode(t or "", add_special_tokens=False).ids) for t in texts]
