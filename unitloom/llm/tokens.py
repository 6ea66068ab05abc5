"""Token counts of whole texts: a narrow Arrow pass that returns lengths only."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .bpe import CHUNK_BYTES, default_path, encoder
from .runtime import narrow, text_only
from .words import slices


def token_counts(docs: DataFrame, tokenizer: str | None = None, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row of docs, in a pass without a shuffle.

    ``tokenizer`` is a file of the tokenizers library (.json) or of sentencepiece (.model).
    Counts are those of the library for the whole text, without added begin or end tokens,
    truncation or padding; strings of special tokens in a text are treated as the library does
    by default.  A null text counts as empty: 0 bytes, 0 tokens.  A null doc_id and repeated rows
    come back as they are; columns other than doc_id and text are not read.
    """
    path = tokenizer or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = encoder(path)
        for batch in batches:
            ids, texts = batch.columns
            for i, j in slices(texts, CHUNK_BYTES):
                part = texts.slice(i, j - i)
                n = model.lengths(part)
                size = pc.fill_null(pc.binary_length(part), 0).cast(pa.int64())
                yield pa.record_batch([ids.slice(i, j - i), size, pa.array(n, pa.int64()), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return text_only(docs).mapInArrow(narrow(run), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
