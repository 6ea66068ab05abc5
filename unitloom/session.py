"""Session helpers: a tuned local session, and shipping of this package to executors."""

from __future__ import annotations

import atexit
import io
import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def local_session(cores: int | str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session with the settings that the tests and the bench use."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("unitloom")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


#: Bounds of batches: Spark's own, those of ``ship`` and those of ``small_batches``.  Batches to
#: Python workers, by Spark 10,000 rows and 64 MB, are held two or three times by each task, outside
#: of the JVM's heap.  The rows that Parquet is read by are arrays of several MB if texts are long.
BATCHES = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "2000", "1000"),
    "spark.sql.execution.arrow.maxBytesPerBatch": ("67108864b", "16777216b", "4194304b"),
    "spark.sql.parquet.columnarReaderBatchSize": ("4096", "4096", "256"),
}


def _bound(spark: SparkSession, step: int) -> None:
    """Takes the bounds of a step where the session has those of an earlier one, not a user's own."""
    for name, values in BATCHES.items():
        if spark.conf.get(name) in values[:step]:
            spark.conf.set(name, values[step])


def small_batches(spark: SparkSession) -> None:
    """Bounds batches further, for an operator that reads whole texts and deals them out.

    Arrays of over half a region of the JVM's heap are garbage that young collections seldom get
    at, and its heap grows by several times what they hold.  The bounds stay for the session, as
    plans are run later than they are made.
    """
    _bound(spark, 2)


def ship(spark: SparkSession) -> SparkSession:
    """Makes this package importable in Python workers, once for each application.

    Also bounds the batches that go there, where the session has Spark's own settings.
    """
    _bound(spark, 1)
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return spark
    root = Path(__file__).resolve().parent
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as out:
        for path in sorted(root.rglob("*.py")):
            out.write(path, path.relative_to(root.parent).as_posix())
    handle, name = tempfile.mkstemp(prefix="unitloom-", suffix=".zip")
    with os.fdopen(handle, "wb") as f:
        f.write(data.getvalue())
    context.addPyFile(name)
    atexit.register(lambda: Path(name).unlink(missing_ok=True))
    _shipped.add(context.applicationId)
    return spark


def scratch(spark: SparkSession) -> str:
    """The folder for what is written in between: the one that the cluster shares.

    It is the session's ``spark.checkpoint.dir``, or the checkpoint folder that was set by hand.
    Only a local master, as in tests, gets a temporary folder; elsewhere other machines could not
    read it.
    """
    context = spark.sparkContext
    base = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if base is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        base = tempfile.mkdtemp(prefix="unitloom-")
        context.setCheckpointDir(base)
    return base.rstrip("/")


def spread(df: DataFrame) -> DataFrame:
    """A scan of fewer partitions than there are cores, as a small file of one row group gives,
    dealt out to all of them; any other scan is left as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables."""
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))
