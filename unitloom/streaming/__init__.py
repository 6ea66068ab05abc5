"""Continuous runs: sources come in as a stream, each micro-batch is cleaned like a batch."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.cleaner import clean
from ..session import scratch
from ..sources.service import extract


def process(sources: DataFrame, sink: Callable[[str, DataFrame, int], None], config: dict[str, object] | None = None) -> None:
    """Extracts and cleans one batch of sources and hands each table to the sink."""
    found = extract(sources)
    # All tables but two derive from the units, so each document is parsed for them once.
    units = found.units.persist()
    done = clean(units, config)
    for name, table in (("clean_units", done.units), ("dropped_units", done.dropped), ("cleaning_warnings", done.warnings), ("cleaning_stats", done.stats), ("extraction_errors", found.errors), ("cleaning_errors", done.errors)):
        sink(name, table, -1)
    units.unpersist()


def parquet_sink(folder: str) -> Callable[[str, DataFrame, int], None]:
    """Writes each table of a batch to its own folder; a batch that runs again overwrites itself."""

    def write(name: str, table: DataFrame, batch: int) -> None:
        table.write.mode("overwrite").parquet(f"{folder}/{name}/batch={batch}")

    return write


def start(sources: DataFrame, sink: Callable[[str, DataFrame, int], None], checkpoint: str, config: dict[str, object] | None = None, available_now: bool = True) -> StreamingQuery:
    """Starts the stream.  One row is one document, so a micro-batch never splits one."""

    def batch(rows: DataFrame, number: int) -> None:
        process(rows, lambda name, table, _: sink(name, table, number), config)

    writer = sources.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def shared_folder(spark: SparkSession) -> str:
    """A new folder where all executors can read and write."""
    return f"{scratch(spark)}/stream-{uuid.uuid4().hex}"


def stream_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs all documents through a stream of micro-batches and reads the statistics back."""
    from ..plans.cleaning import dirty_rows

    folder = shared_folder(spark)
    schema = spark.read.parquet(f"{sf_dir}/documents.parquet").schema
    # A table is one file or a folder of files.  Streams take a single file by a pattern alone.
    rows = spark.readStream.schema(schema).parquet(f"{sf_dir}/documents.{{parquet}}")

    def batch(docs: DataFrame, number: int) -> None:
        clean(dirty_rows(docs)).stats.write.mode("overwrite").parquet(f"{folder}/stats/batch={number}")

    query = rows.writeStream.foreachBatch(batch).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    names = ["input_units", "output_units", "dropped_units", "modified_units", "unchanged_units", "characters_before", "characters_after", "warning_count"]
    return spark.read.parquet(f"{folder}/stats").select("document_id", *[F.col(n).cast("long").alias(n) for n in names])
