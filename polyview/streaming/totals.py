"""Running totals of a scoring loop: confusion counts and loss sums kept as stream state.

The state is one row per key, so it is bounded by labels², however long the
stream.  Every micro-batch publishes the totals so far as a version of its own,
named by the batch: a batch that is run again after a failure writes the same
version again and counts nothing twice.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from polyview.session import subfolders

VERSION = "version="


def versions(spark: SparkSession, out: str) -> list[int]:
    """Batches whose totals were written to their end."""
    return [int(name[len(VERSION):]) for name in subfolders(spark, out, committed=True) if name.startswith(VERSION)]


def read_version(spark: SparkSession, out: str, version: int, schema: StructType | None = None) -> DataFrame:
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(f"{out}/{VERSION}{version:012d}")


def latest_totals(spark: SparkSession, out: str) -> DataFrame:
    """The totals after the last whole batch."""
    known = versions(spark, out)
    if not known:
        raise ValueError(f"no totals under {out}")
    return read_version(spark, out, known[-1])


def merge_totals(before: DataFrame, changed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``changed`` in place of the rows of ``before`` with the same keys; NULL is a key like any other."""
    values = F.struct(*[c for c in changed.columns if c not in keys])
    both = before.select(*keys, F.lit(0).alias("__turn"), values.alias("__v")).unionByName(
        changed.select(*keys, F.lit(1).alias("__turn"), values.alias("__v"))
    )
    return both.groupBy(*keys).agg(F.max_by("__v", "__turn").alias("__v")).select(*keys, "__v.*").select(changed.columns)


def publish_totals(changed: DataFrame, version: int, out: str, keys: Sequence[str]) -> None:
    """Writes the totals after one batch: those of the version before it, with the changed rows."""
    spark = changed.sparkSession
    earlier = [v for v in versions(spark, out) if v < version]
    merged = merge_totals(read_version(spark, out, earlier[-1], changed.schema), changed, keys) if earlier else changed
    merged.coalesce(1).write.mode("overwrite").parquet(f"{out}/{VERSION}{version:012d}")


def total_stream(scored: DataFrame, keys: Sequence[str], sums: dict[str, Column], out: str, checkpoint: str,
                 available_now: bool = True) -> StreamingQuery:
    """Per ``keys``: rows as ``n`` and the given sums over the whole stream, published after every batch."""
    totals = scored.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *[F.sum(v).alias(name) for name, v in sums.items()])
    key_names = list(keys)
    writer = totals.writeStream.outputMode("update").option("checkpointLocation", checkpoint)
    writer = writer.foreachBatch(lambda changed, batch: publish_totals(changed, batch, out, key_names))
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()
