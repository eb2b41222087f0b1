"""Expert views: one vector per (row, expert), in long, wide or catalog form."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from polyview.functions.vectors import cut
from polyview.operators.labels import expert_subset


def numbered_catalog(counts: Mapping[str, int], prefix: str = "expert_") -> dict[str, list[str]]:
    """A catalog whose experts are named by their index."""
    names, start = {}, 0
    for dimension, n in counts.items():
        names[dimension] = [f"{prefix}{i}" for i in range(start, start + n)]
        start += n
    return names


def catalog(spark: SparkSession, experts: Mapping[str, Sequence[str]]) -> DataFrame:
    """``dimension, expert, name`` with the experts numbered in the given order."""
    rows = [(dim, name) for dim, names in experts.items() for name in names]
    return spark.createDataFrame(
        [(dim, idx, name) for idx, (dim, name) in enumerate(rows)],
        "dimension string, expert int, name string",
    )


def name_experts(df: DataFrame, experts: Mapping[str, Sequence[str]], dimensions: Sequence[str] | None = None,
                 ) -> DataFrame:
    """Adds dimension and name; with ``dimensions`` only their experts are kept.

    The broadcast table is made from the literal catalog, so its size is known.
    """
    names = catalog(df.sparkSession, experts)
    if dimensions is not None:
        names = expert_subset(names, dimensions)
    return df.join(F.broadcast(names), "expert")


def explode_views(df: DataFrame, wide: str, widths: Sequence[int], keep: Sequence[str]) -> DataFrame:
    """Wide vector to one row per expert, by running offsets; row-local."""
    pieces = F.array(*cut(F.col(wide), widths))
    return df.select(*keep, F.posexplode(pieces).alias("expert", "vec"))


def explode_views_by_table(df: DataFrame, wide: str, width_table: DataFrame, keep: Sequence[str]) -> DataFrame:
    """The same with the widths taken from a table (``expert, width``), one row per expert."""
    before = Window.orderBy("expert").rowsBetween(Window.unboundedPreceding, -1)
    offsets = width_table.withColumn("start", F.coalesce(F.sum("width").over(before), F.lit(0)).cast("int"))
    pieces = offsets.agg(F.array_sort(F.collect_list(F.struct("expert", "start", "width"))).alias("p"))
    spec = F.explode(pieces.scalar()).alias("spec")
    return df.select(*keep, wide, spec).select(
        *keep,
        F.col("spec.expert").alias("expert"),
        F.slice(F.col(wide), F.col("spec.start") + 1, F.col("spec.width")).alias("vec"),
    )


def concat_views(views: DataFrame, n_experts: int, keys: Sequence[str] = ("row_id",)) -> DataFrame:
    """Long views to one wide vector per row, experts side by side in index order.

    A group holds one vector per expert; a missing or repeated expert is an error.
    """
    parts = F.array_sort(F.collect_list(F.struct("expert", "vec")))
    found = F.transform("parts", lambda p: p["expert"].cast("int"))
    whole = found == F.sequence(F.lit(0), F.lit(n_experts - 1))
    said = F.concat(F.lit("a row needs each expert once, it has: "), F.array_join(found.cast("array<string>"), " "))
    wide = F.flatten(F.transform("parts", lambda p: p["vec"]))
    checked = F.when(whole, wide).otherwise(F.raise_error(said).cast(views.schema["vec"].dataType))
    return views.groupBy(*keys).agg(parts.alias("parts")).select(*keys, checked.alias("wide"))


def view_widths(views: DataFrame, keys: Sequence[str] = ("expert",)) -> DataFrame:
    """Rows and vector width per artefact; ``width`` is NULL where rows disagree."""
    n = F.size("vec")
    return views.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.min(n).alias("min_width"),
        F.max(n).alias("max_width"),
        F.when(F.min(n) == F.max(n), F.max(n)).alias("width"),
    )


def checked_widths(views: DataFrame, keys: Sequence[str] = ("expert",)) -> list[int]:
    """The width of each artefact in order of ``keys``; ragged vectors are an error."""
    rows = view_widths(views, keys).orderBy(*keys).collect()  # one row per artefact
    ragged = [tuple(r[k] for k in keys) for r in rows if r["width"] is None]
    if ragged:
        raise ValueError(f"experts with vectors of several widths: {ragged}")
    return [r["width"] for r in rows]


def with_labels(features: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    return features.join(labels, key, "inner")


def feature_vector(columns: Sequence[str]) -> Column:
    """Named numeric columns as one vector."""
    return F.array(*[F.col(c).cast("double") for c in columns])
