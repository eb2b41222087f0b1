"""Session settings and the shared scratch folder."""

from __future__ import annotations

import gc
import os
import time
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: list[str] = []

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Texts are costly per byte: smaller splits than the default of 128 MB keep more cores busy on a scan.
    "spark.sql.files.maxPartitionBytes": "32m",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Wide representation vectors and long texts: bound a Python batch by bytes, not only by rows. A worker holds it several times.
    "spark.sql.execution.arrow.maxBytesPerBatch": "8m",
    "spark.ui.enabled": "false",
    # No call-site record per Column call: it doubles the time to build long expressions.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def build_session(name: str = "polyview", master: str | None = None, **extra: str) -> SparkSession:
    """A session with the settings above; ``extra`` wins over them.

    The number of shuffle partitions is left to the cluster: AQE merges small
    ones, so a large value is safe on big inputs.
    """
    builder = SparkSession.builder.appName(name)
    if master is not None:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def small_batches(spark: SparkSession) -> None:
    """Bounds the Arrow batches that workers get by bytes, unless the session already does."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, "8m")


def scratch_root(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``.

    Where it is unset, a folder of the warehouse; one on a machine's own disk is
    refused unless the session runs on that machine alone.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    root = named or spark.conf.get("spark.sql.warehouse.dir") + "/_scratch"
    if not named and root.startswith(("file:", "/")) and not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"{root} is not shared by the cluster: name a shared folder in spark.checkpoint.dir")
    return root.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the scratch folder; ``clean_scratch`` removes it."""
    path = "/".join((scratch_root(spark), f"{name}-{uuid.uuid4().hex}"))
    _written.append(path)
    return path


def clean_scratch(spark: SparkSession) -> None:
    """Removes every scratch folder handed out so far; frames read from them end with it."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    while _written:
        path = jvm.org.apache.hadoop.fs.Path(_written.pop())
        path.getFileSystem(conf).delete(path, True)


def let_go(spark: SparkSession, *frames: DataFrame) -> None:
    """Removes what ``stored`` wrote for ``frames``, which nothing reads any more, and the shuffle files of all that has ended.

    Spark removes shuffle files only when the driver's garbage is collected, which may be long after their last use.
    """
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    names = {file.rsplit("/", 2)[-2] for frame in frames for file in frame.inputFiles()}
    for written in [w for w in _written if w.rsplit("/", 1)[-1] in names]:
        _written.remove(written)
        path = jvm.org.apache.hadoop.fs.Path(written)
        path.getFileSystem(conf).delete(path, True)
    for pause in (0.5, 0):  # what has only just ended is known to listeners for a moment
        gc.collect()
        jvm.System.gc()
        time.sleep(pause)


def subfolders(spark: SparkSession, root: str, committed: bool = False) -> list[str]:
    """Names of the folders under ``root``, sorted; ``committed`` keeps those whose write has ended. A missing root has none."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(path):
        return []
    found = [status.getPath() for status in files.listStatus(path) if status.isDirectory()]
    done = spark._jvm.org.apache.hadoop.fs.Path
    return sorted(f.getName() for f in found if not committed or files.exists(done(f, "_SUCCESS")))


def stored(df: DataFrame, name: str = "stage") -> DataFrame:
    """``df`` written once as Parquet to the scratch folder and read back.

    Cuts the lineage with a copy that survives lost executors; used where a
    result is read more than once and is dear to compute.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")
