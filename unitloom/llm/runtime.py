"""What the operators of this subpackage share: lineage cuts, size checks, row identity."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import scratch, spread

#: A side is broadcast only if it was counted to be at most this many rows of a few dozen bytes.
BROADCAST_ROWS = 50_000


#: Rows of a few dozen bytes that are worth a task of their own.
TASK_ROWS = 10_000


def worth(rows: int) -> int:
    """Tasks that so many small rows are worth; pass a bound that was counted."""
    return max(1, -(-rows // TASK_ROWS))


def fewer(df: DataFrame, tasks: int) -> DataFrame:
    """df in no more partitions than its rows are worth.

    A round over a few thousand rows would otherwise start as many tasks, and write as many files,
    as one over a whole corpus.  From as many tasks on as shuffles have partitions df stays as it is.
    """
    return df.coalesce(tasks) if tasks < shuffle_partitions(df.sparkSession) else df


def cut(df: DataFrame, tasks: int | None = None) -> DataFrame:
    """Checkpoints a DataFrame, in at most so many tasks, in the folder that the cluster shares.

    The folder is the session's ``spark.checkpoint.dir``.  Unlike a local checkpoint this survives
    lost executors.
    """
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(scratch(spark))
    out = (df if tasks is None else fewer(df, tasks)).checkpoint(eager=True)
    if time.monotonic() - _released >= RELEASE_S:
        del df  # else what it was made from outlives this call
        release(spark)
    return out


#: Seconds after which a cut asks the driver's JVM again to collect its garbage.
RELEASE_S = 8.0
_released = 0.0


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files and checkpoints that nothing refers to any more.

    It does so when the driver's JVM collects garbage, which a long chain of small jobs rarely
    makes it do; the files of rounds that are over would stay on the executors' disks till then.
    Call it once no name holds a frame with a large exchange any more.
    """
    global _released
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    _released = time.monotonic()


def dealt_anew(df: DataFrame) -> DataFrame:
    """An aggregate that is about to be joined with the rows it was made of.

    Without this the join takes over the aggregate's dealing, and Spark can only split a hot
    key's partition if both sides of a join are dealt out for the join itself.
    """
    return df.hint("rebalance")


Pass = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def narrow(run: Pass) -> Pass:
    """An Arrow pass that gives its memory back when its partition ends.

    Workers are kept for later tasks, and an idle one should not hold what its last task needed.
    """

    def through(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):
            ctypes.CDLL("libc.so.6").malloc_trim(0)

    return through


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """The documents table, with the asked columns only."""
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return spread(df.select(*columns) if columns else df)


def text_only(df: DataFrame) -> DataFrame:
    """doc_id and text under fixed names and types; other columns, clashing or not, stay behind.

    A column that has its type is taken as it is: an alias that does nothing stays in some copies
    of a plan and not in others, and exchanges of such copies are not reused.
    """
    own = dict(df.select("doc_id", "text").dtypes)
    typed = lambda name, kind: F.col(name) if own[name] == kind else F.col(name).cast(kind).alias(name)
    return df.select(typed("doc_id", "bigint"), typed("text", "string"))


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> bool:
    """Counts a (checkpointed) side up to the limit; True if it may be broadcast."""
    return df.limit(limit + 1).count() <= limit


def sent(df: DataFrame) -> DataFrame:
    """A (checkpointed) side of a join, marked to be broadcast if it was counted to be small.

    Spark doesn't know the size of a checkpoint, and deals out both sides before it finds out.
    """
    return F.broadcast(df) if small(df) else df


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
