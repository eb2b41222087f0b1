"""Continuous scoring: stateless row-local operators over an unending input."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def read_stream(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def score_stream(source: DataFrame, score: Callable[[DataFrame], DataFrame], out: str, checkpoint: str,
                 available_now: bool = True) -> StreamingQuery:
    """Applies ``score`` to each micro-batch and appends to Parquet exactly once.

    ``score`` must be row-local (no shuffle, no state): the array forms of the
    gate and of the fusion are, the ranked long forms are not.
    """
    writer = score(source).writeStream.format("parquet").option("path", out)
    writer = writer.option("checkpointLocation", checkpoint).outputMode("append")
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def drain(query: StreamingQuery) -> None:
    """Waits for an ``availableNow`` run and raises its error, if any."""
    query.awaitTermination()
