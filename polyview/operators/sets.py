"""Unions of splits, corpora and result rows."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame, functions as F


def union_all(*frames: DataFrame, missing: bool = False) -> DataFrame:
    """UNION ALL by column name; duplicates stay."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=missing), frames)


def union_splits(splits: Mapping[str | None, DataFrame], split: str = "split") -> DataFrame:
    """Split tables as one; each row carries the name of its table in ``split``, first.

    Columns are matched by name, and one that a table lacks is NULL there.  A table's own
    column of that name gives way to the name of the table.  Repeated rows stay.
    """
    if not splits:
        raise ValueError("no splits to unite")
    named = [df.select(F.lit(name).cast("string").alias(split), *[c for c in df.columns if c.lower() != split.lower()]) for name, df in splits.items()]
    return union_all(*named, missing=True)


def merge_corpora(corpora: Mapping[str, DataFrame]) -> DataFrame:
    """All corpora in one table; each row carries its ``dataset``, and its ``split`` stays."""
    return union_all(*[df.withColumn("dataset", F.lit(name)) for name, df in corpora.items()])
