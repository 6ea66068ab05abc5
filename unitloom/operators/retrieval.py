"""Chunks, embeddings and search, within the contracts of the data model.

The contracts give shapes and bounds and no algorithm; chunking by words and exact cosine search
are this engine's choices.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import pytext as P
from ..schemas import QUESTION_LIMITS

CHUNKER, VERSION = "word_windows", "1"


class QueryInputError(ValueError):
    """A question or a top_k out of bounds."""


def check_query(question: str, top_k: int = QUESTION_LIMITS["default_top_k"]) -> tuple[str, int]:
    question = question.strip()
    if not question or len(question) > QUESTION_LIMITS["max_question_characters"]:
        raise QueryInputError("a question has 1 to 3000 characters")
    if isinstance(top_k, bool) or not QUESTION_LIMITS["min_top_k"] <= top_k <= QUESTION_LIMITS["max_top_k"]:
        raise QueryInputError("top_k is 1 to 20")
    return question, top_k


def chunks(units: DataFrame, size: int = 200) -> DataFrame:
    """Chunks of clean units: at most so many characters, cut at the last space if there is one.

    A chunk's start_char and end_char are its place in the unit; chunks of a unit are disjoint and
    leave out white space alone.
    """
    text = F.col("content")
    # White space, and as many characters as fit and end before a space or the end; else a hard cut.
    pattern = F.lit(rf"(?s)[{P.PYWS}]*[^{P.PYWS}](?:.{{0,{size - 1}}}(?=[{P.PYWS}]|\z)|.{{{size - 1}}})")
    own = units.select("clean_unit_id", "document_id", "source_id", "source_type", F.regexp_extract_all(text, pattern, F.lit(0)).alias("__all"))
    # Matches lie end to end, so places are sums of lengths within the row; nothing is dealt out.
    ends = F.aggregate("__all", F.array().cast("array<int>"), lambda acc, x: F.array_append(acc, F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0)) + F.length(x)))
    placed = own.select("*", F.posexplode(F.arrays_zip(F.col("__all"), ends.alias("__ends"))).alias("chunk_index", "c"))
    placed = placed.withColumn("part", F.regexp_replace("c.__all", rf"\A[{P.PYWS}]+", "")).withColumn("start_char", F.col("c.__ends") - F.length("part"))
    trimmed = P.strip(F.col("part"))
    return placed.select(
        F.format_string("chunk:%s:%06d", F.col("clean_unit_id"), F.col("chunk_index")).alias("chunk_id"),
        "clean_unit_id", "document_id", "source_id", "source_type", "chunk_index", trimmed.alias("content"), P.content_hash(trimmed).alias("content_hash"),
        "start_char", (F.col("start_char") + F.length(trimmed)).alias("end_char"), P.word_count(trimmed).alias("token_count"), F.lit(CHUNKER).alias("chunker_name"), F.lit(VERSION).alias("chunker_version"),
        F.current_timestamp().alias("created_at"),
    )


def embed(rows: DataFrame, provider: Callable[[Column], Column], text: str = "content") -> DataFrame:
    """rows with an embedding; the provider maps a text column to array<float>."""
    return rows.withColumn("embedding", provider(F.col(text)))


def upsert(store: DataFrame, rows: DataFrame, key: str = "chunk_id") -> DataFrame:
    """store with rows in place of those of the same key; no row is rewritten twice."""
    return store.join(rows.select(key).distinct(), key, "left_anti").unionByName(rows)


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def search(store: DataFrame, query: list[float], top_k: int, key: str = "vec_id") -> DataFrame:
    """The top_k rows by cosine, exact: one narrow pass and a top-k, no exchange of vectors."""
    vector = F.array(*[F.lit(float(x)) for x in query])
    # A vector of no length has no angle, so it is in no result.
    score = F.try_divide(_dot(F.col("embedding"), vector), F.sqrt(_dot(F.col("embedding"), F.col("embedding")) * _dot(vector, vector)))
    best = store.select(key, score.alias("vector_score")).where(F.col("vector_score").isNotNull()).orderBy(F.desc("vector_score"), key).limit(top_k)
    return best.withColumn("retrieval_rank", F.row_number().over(Window.orderBy(F.desc("vector_score"), key)))


#: Queries that are held by every task at once.
QUERY_BLOCK = 1024
DIGITS = 6


def _matrix(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors of the rows that have one of this size, and which rows they are."""
    fits = np.asarray(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)) == size
    flat = column.filter(pa.array(fits)).flatten().to_numpy(zero_copy_only=False)
    vectors = np.asarray(flat, np.float64).reshape(-1, size)
    length = np.sqrt((vectors * vectors).sum(1))
    good = np.isfinite(length) & (length > 0)
    return vectors[good] / length[good, None], np.flatnonzero(fits)[good]


def _blocks(queries: DataFrame, key: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    rows: list[tuple[int, list[float]]] = []
    for row in queries.select(key, "embedding").where("embedding is not null").toLocalIterator():
        if rows and (len(rows) == QUERY_BLOCK or len(row[1]) != len(rows[0][1])):
            yield np.array([r[0] for r in rows]), np.array([r[1] for r in rows], np.float64)
            rows = []
        rows.append((row[0], row[1]))
    if rows:
        yield np.array([r[0] for r in rows]), np.array([r[1] for r in rows], np.float64)


def search_all(store: DataFrame, queries: DataFrame, top_k: int, key: str = "vec_id") -> DataFrame:
    """(query_id, key, vector_score, retrieval_rank): the top_k rows of each query by cosine, exact.

    Queries go through in blocks; each block is one pass over the store, in which a task keeps the
    best rows of its partition for each query, so what is dealt out is top_k rows a task and query.
    Scores are rounded before they are ranked, and ties go to the smaller key.  Rows without a
    vector, of another size, or of no length are in no result.
    """
    parts = []
    for names, vectors in _blocks(queries, key):
        unit, kept = _matrix(pa.array(list(vectors), pa.list_(pa.float64())), vectors.shape[1]) if vectors.shape[1] else (vectors[:0], np.zeros(0, np.int64))
        shared = store.sparkSession.sparkContext.broadcast((names[kept], unit))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            own, targets = shared.value
            best: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0), np.zeros(0, np.int64))] * len(own)
            for batch in batches:
                vectors, rows = _matrix(batch.column(1), targets.shape[1])
                ids = np.asarray(batch.column(0).to_numpy(zero_copy_only=False))[rows]
                scores = np.round(vectors @ targets.T, DIGITS) + 0.0
                for q in range(len(own)):
                    score, id_ = np.concatenate([best[q][0], scores[:, q]]), np.concatenate([best[q][1], ids])
                    if len(score) > top_k:
                        some = np.flatnonzero(score >= np.partition(score, -top_k)[-top_k])
                        some = some[np.lexsort((id_[some], -score[some]))[:top_k]]
                        score, id_ = score[some], id_[some]
                    best[q] = score, id_
            sizes = [len(b[0]) for b in best]
            yield pa.record_batch([pa.array(np.repeat(own, sizes), pa.int64()), pa.array(np.concatenate([b[1] for b in best] or [[]]), pa.int64()), pa.array(np.concatenate([b[0] for b in best] or [[]]), pa.float64())], ["query_id", key, "vector_score"])

        parts.append(store.select(F.col(key).cast("long"), "embedding").where(f"{key} is not null").mapInArrow(run, f"query_id long, {key} long, vector_score double"))
    if not parts:
        return store.select(F.col(key).cast("long").alias("query_id"), F.col(key).cast("long"), F.lit(0.0).alias("vector_score"), F.lit(0).alias("retrieval_rank")).where("false")
    every = parts[0]
    for part in parts[1:]:
        every = every.unionAll(part)
    order = Window.partitionBy("query_id").orderBy(F.desc("vector_score"), key)
    return every.withColumn("retrieval_rank", F.row_number().over(order)).where(F.col("retrieval_rank") <= top_k)
