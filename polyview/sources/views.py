"""Stored representations: Parquet partitioned by dataset, expert and split."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from polyview.operators.views import checked_widths
from polyview.schema import VIEW

LAYOUT = ("dataset", "expert", "split")


def write_views(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Rows are first rebalanced by folder: without it every task would write a
    small file into every folder.  AQE splits large folders over several tasks.
    """
    rows = df.select(*[f.name for f in VIEW.fields]).hint("rebalance", *[F.col(c) for c in LAYOUT])
    rows.write.mode(mode).partitionBy(*LAYOUT).parquet(path)


def save_bucketed(df: DataFrame, name: str, path: str, buckets: int, key: str = "row_id") -> DataFrame:
    """A catalog table bucketed by ``key``.

    Joins and groupings on the key then need no shuffle, however often they run.
    Rows go to their bucket before the write, so a bucket is one file.
    """
    rows = df.repartition(buckets, key)
    rows.write.bucketBy(buckets, key).sortBy(key).option("path", path).saveAsTable(name)
    return df.sparkSession.table(name)


def read_views(spark: SparkSession, path: str, dataset: str | None = None, split: str | None = None,
               experts: Sequence[str] | None = None, check: bool = False) -> DataFrame:
    """Vectors as doubles; the arguments prune folders before anything is read.

    ``check`` first measures the widths of what is left: an expert with vectors of
    several widths is an error.
    """
    views = spark.read.schema(VIEW).parquet(path)
    if dataset is not None:
        views = views.where(F.col("dataset") == dataset)
    if split is not None:
        views = views.where(F.col("split") == split)
    if experts is not None:
        views = views.where(F.col("expert").isin(*experts))
    if check:
        checked_widths(views, ("dataset", "expert"))
    return views.withColumn("vec", F.col("vec").cast("array<double>"))


def squeeze(nested: str, depth: int):
    """Drops unit dimensions: ``depth`` one-element arrays around a vector."""
    column = F.col(nested)
    for _ in range(depth):
        column = F.flatten(column)
    return column
