"""The corpus pipeline: five stages over documents, each by one operator.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read
again as the next stage's docs.  All but the last return the columns of documents; where a stage
changes a text, n_chars follows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from unitloom.llm import decontaminate, linededup, neardup, packing, quality
from unitloom.session import scratch, spread

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _with_text(docs: DataFrame, text: str) -> DataFrame:
    """docs with another column as text; n_chars is counted again where the text has changed."""
    changed = ~F.col("text").eqNullSafe(F.col(text))
    counted = docs.withColumn("n_chars", F.when(changed, F.length(text).cast("long")).otherwise(F.col("n_chars")))
    return counted.withColumn("text", F.col(text)).select(*COLUMNS)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the adaptive quality rules reject go; each row is judged by its own text.

    Null and empty texts have no words and go.  Rows with a null doc_id stay.
    """
    return quality.keep_good(docs.select(*COLUMNS))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Long lines that many documents share stay in the one with the largest doc_id.

    No row goes.  A null text stays null, and rows with a null doc_id neither count nor lose lines.
    Rows that repeat a doc_id are one document.
    """
    out = linededup.line_dedup(docs.select(*COLUMNS)).withColumn("kept_text", F.when(F.col("text").isNotNull(), F.col("kept_text")))
    return _with_text(out, "kept_text")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest doc_id of each near-duplicate group stays: five-word shingles, similarity 0.8.

    Rows with a null doc_id, and texts without words, are like nothing and stay.  Of rows that
    repeat a doc_id all stay if one does.
    """
    return neardup.keep_one(docs.select(*COLUMNS), shingle=5, percent=80)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut out of texts; texts that mostly consist of them go.

    Each row is judged by its own text; null and empty texts stay.  An empty benchmark changes
    nothing.
    """
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    out = decontaminate.decontaminate(docs.select(*COLUMNS), items)
    return out.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast("long")).otherwise(F.col("n_chars")))


def curve_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents that are left, in sequences of 2048 ids, with their ids.

    A null or empty text is its end token alone.  Every row is a document of its own.
    """
    return packing.pack_along_curve(docs.select(*COLUMNS))


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("curve_packing", curve_packing),
]

#: The quality sketches, the LSH forest and the tokenizer are out of SQL's reach; tests/llm holds
#: each stage against a brute-force version on its own input instead.
ORACLE_SQL = None


def _folder(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def _delete(spark: SparkSession, path: str) -> None:
    at, files = _folder(spark, path)
    files.delete(at, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table.

    What only earlier stages need is deleted as soon as the next one is written, and all of it if
    a stage fails; the last table is what the result is read from and goes when the session ends.
    """
    folder = f"{scratch(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    written = None
    try:
        for name, stage in STAGES[:-1]:
            out = f"{folder}/{name}"
            stage(spark, docs, sf_dir).write.parquet(out)
            docs = spread(spark.read.parquet(out))
            if written:
                _delete(spark, written)
            written = out
        result = STAGES[-1][1](spark, docs, sf_dir)
    except BaseException:
        _delete(spark, folder)
        raise
    at, files = _folder(spark, folder)
    files.deleteOnExit(at)
    return result
