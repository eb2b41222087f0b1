"""JSON-lines corpora and nested documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from polyview.schema import EXAMPLE


def write_examples(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Examples as JSON lines under ``dataset=/split=`` folders; NULL fields are written."""
    (
        df.write.mode(mode)
        .partitionBy("dataset", "split")
        .option("ignoreNullFields", "false")
        .json(path)
    )


def read_examples(spark: SparkSession, path: str, schema: StructType = EXAMPLE) -> DataFrame:
    """Reads them back; ``dataset`` and ``split`` come from the folder names."""
    partitions = StructType(schema.fields).add("dataset", "string").add("split", "string")
    return spark.read.schema(partitions).json(path)


def write_documents(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Nested documents, one JSON object per line; text stays UTF-8."""
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)


def read_documents(spark: SparkSession, path: str, schema: StructType, one_array: bool = False) -> DataFrame:
    """``one_array`` reads files that hold a single JSON array; such a file is one task."""
    return spark.read.schema(schema).option("multiLine", one_array).json(path)
