"""Session, table and scratch-folder helpers shared by every operator."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Two-column or wider tables up to this many rows may be broadcast; beyond it the caller must shuffle.
BROADCAST_ROWS = 2_000_000


def local_session(app: str = "textloom", cpus: int | str = "*", partitions: int = 8) -> SparkSession:
    """A local session for tests and the bench; on a cluster the caller brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Folders written by this process, to be removed by ``clear_scratch`` or at its end.
_WRITTEN: list[str] = []


def is_local(spark: SparkSession) -> bool:
    """Whether all tasks run in this process, so that they share its disk."""
    return re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master) is not None


def clear_scratch(spark: SparkSession) -> int:
    """Remove all folders that this process wrote for results that are read several times.

    DataFrames that still read them are of no use afterwards. It runs at the end of the process by itself.
    """
    n = len(_WRITTEN)
    path = spark._jvm.org.apache.hadoop.fs.Path
    while _WRITTEN:
        at = path(_WRITTEN.pop())
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    return n


def discard(df: DataFrame) -> None:
    """Remove now what ``settle`` wrote for ``df``, which nothing will read again."""
    spark = df.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path(df.settled_at)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    _WRITTEN.remove(df.settled_at)


@atexit.register
def _at_end() -> None:
    spark = SparkSession.getActiveSession() if _WRITTEN else None
    try:
        if spark is not None and not spark._jsc.sc().isStopped():
            clear_scratch(spark)
    except Exception:  # the session is gone; nothing left to ask
        pass


def scratch_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder below the cluster's shared ``spark.checkpoint.dir``.

    Only where that setting is absent and all tasks run in this process (tests, local runs) a temporary folder of this
    machine is set as it; on a cluster its executors could not read one another's folders, so RuntimeError.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = held.get() if held.isDefined() else None
    if not base and not is_local(spark):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if not base:
        base = "file://" + tempfile.mkdtemp(prefix="textloom-")
        spark.sparkContext.setCheckpointDir(base)
    _WRITTEN.append(f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}")
    return _WRITTEN[-1]


def settle(df: DataFrame, purpose: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: a cut in the lineage that survives lost executors."""
    spark = df.sparkSession
    path = scratch_dir(spark, purpose)
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.settled_at = path
    return out
