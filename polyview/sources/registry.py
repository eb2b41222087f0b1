"""Named corpora: where they lie, how they are scanned and stored."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructField, StructType

from polyview.operators.sets import union_all, union_splits
from polyview.session import subfolders, table_path

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


class Registry:
    """Names to Parquet paths.  An unknown name fails before any planning."""

    def __init__(self, spark: SparkSession, paths: Mapping[str, str], schemas: Mapping[str, StructType] | None = None):
        self.spark = spark
        self.paths = dict(paths)
        self.schemas = dict(schemas or {})

    def path(self, name: str) -> str:
        if name not in self.paths:
            raise ValueError(f"unknown corpus {name!r}; known: {sorted(self.paths)}")
        return self.paths[name]

    def scan(self, name: str) -> DataFrame:
        path = self.path(name)
        reader = self.spark.read
        if name in self.schemas:
            reader = reader.schema(self.schemas[name])
        return reader.parquet(path)

    def row_counts(self) -> DataFrame:
        """``name, n_rows`` of every corpus; answered from Parquet footers."""
        counts = [
            self.scan(name).agg(F.count(F.lit(1)).alias("n_rows")).withColumn("name", F.lit(name))
            for name in self.paths
        ]
        return union_all(*counts).select("name", "n_rows")


def driver_tables(spark: SparkSession, sf_dir: str) -> Registry:
    return Registry(spark, {name: table_path(sf_dir, name) for name in TABLES})


def is_whole(spark: SparkSession, path: str) -> bool:
    """Whether a write to ``path`` has ended: the engine leaves its marker last."""
    marker = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return marker.getFileSystem(spark._jsc.hadoopConfiguration()).exists(marker)


def ingest(df: DataFrame, path: str, force: bool = False, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Stores ``df`` unless it is there as a whole; ``force`` stores it anew, and so does a write that did not end."""
    spark = df.sparkSession
    if force or not is_whole(spark, path):
        writer = df.write.mode("overwrite")
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        writer.parquet(path)
    return spark.read.parquet(path)


def publish(df: DataFrame, root: str, by: Sequence[str]) -> DataFrame:
    """Stores results under their keys ``by`` and gives all that is stored there.

    Rows are staged and moved in when the write ends, and they replace what was stored
    under the same keys: a pass that is published again is there once, and the results
    of other passes stay.  A NULL key is a key of its own; an empty string counts as
    NULL.  Columns that only some results have are NULL for the others.
    """
    spark = df.sparkSession
    types = {f.name: f.dataType for f in df.schema.fields}
    spread = df.hint("rebalance", *[F.col(c) for c in by])
    spread.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(root)
    if not subfolders(spark, root):
        return df.limit(0)
    # keys are read as they are written, not as the numbers that their texts may look like
    found = spark.read.option("mergeSchema", True).parquet(root)
    schema = StructType([StructField(f.name, types[f.name] if f.name in by else f.dataType) for f in found.schema.fields])
    return spark.read.schema(schema).parquet(root).select(*df.columns, *[c for c in found.columns if c not in types])


SPLIT_FOLDER = "split="  # the folder of a split, named as the engine names partitions
NO_SPLIT = "__HIVE_DEFAULT_PARTITION__"  # fixed value: the engine's folder for rows without one


def store_splits(df: DataFrame, root: str, split: str = "split") -> None:
    """Writes every value of ``split`` as a table of its own under ``root``, each in as many files as its size asks for.

    A split written again replaces the stored one; the others stay.  An empty name counts as none.
    """
    kept = [c for c in df.columns if c.lower() not in (split.lower(), "split")]
    spread = df.select(*kept, F.col(split).cast("string").alias("split")).hint("rebalance", F.col("split"))
    spread.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("split").parquet(root)


def split_tables(spark: SparkSession, root: str) -> dict[str | None, DataFrame]:
    """The split tables under ``root`` by name; rows without a split have the name ``None``.

    The list of splits is that of the folder, so none is left out and none has to be
    known.  Every table has the columns it was stored with.
    """
    names = [f[len(SPLIT_FOLDER):] for f in subfolders(spark, root) if f.startswith(SPLIT_FOLDER)]
    return {None if n == NO_SPLIT else unquote(n): spark.read.parquet(f"{root}/{SPLIT_FOLDER}{n}") for n in names}


def scan_splits(spark: SparkSession, root: str) -> DataFrame:
    """All stored splits as one table."""
    return union_splits(split_tables(spark, root))
