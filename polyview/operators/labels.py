"""Canonical examples: projections and label rules."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from polyview.schema import ABLATIONS


def canonicalise(df: DataFrame) -> DataFrame:
    """Positional rename of a two-column corpus to ``input, output``."""
    if len(df.columns) != 2:
        raise ValueError(f"expected two columns, got {df.columns}")
    return df.toDF("input", "output")


def project(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """``{new: old}`` columns only."""
    return df.select(*[F.col(old).alias(new) for new, old in names.items()])


def _lookup(mapping: Mapping) -> Column:
    return F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])


def code_to_label(code: Column, codes: Mapping[int, str]) -> Column:
    """Label of a raw code; NULL for an unknown code."""
    return F.try_element_at(_lookup(codes), code)


def corpus_code_to_label(dataset: Column, code: Column, codes: Mapping[str, Mapping[int, str]]) -> Column:
    """The same code means different labels in different corpora."""
    label = F.lit(None).cast("string")
    for name, mapping in codes.items():
        label = F.when(dataset == name, code_to_label(code, mapping)).otherwise(label)
    return label


def label_to_id(label: Column, ids: Mapping[str, int]) -> Column:
    """Id of a label; NULL for an unknown label."""
    return F.try_element_at(_lookup(ids), label)


def label_to_id_strict(label: Column, ids: Mapping[str, int]) -> Column:
    """Id of a label; an unknown or missing label fails the job."""
    problem = F.concat(F.lit("unknown label: "), F.coalesce(label, F.lit("NULL")))
    return F.coalesce(label_to_id(label, ids), F.raise_error(problem).cast("int"))


def unknown_labels(df: DataFrame, label: str, ids: Mapping[str, int]) -> DataFrame:
    """The labels a strict lookup would refuse, with their row counts."""
    bad = F.col(label).isNull() | ~F.col(label).isin(*ids)
    return df.where(bad).groupBy(label).agg(F.count(F.lit(1)).alias("n"))


def bin_score(score: Column) -> Column:
    """Below -0.1 negative, from -0.1 to below 0.1 neutral, everything else positive."""
    return (
        F.when(score < -0.1, F.lit("negative"))
        .when((score >= -0.1) & (score < 0.1), F.lit("neutral"))
        .otherwise(F.lit("positive"))
    )


def select_split(df: DataFrame, *names: str) -> DataFrame:
    """Rows of the named splits; prunes directories on a partitioned table."""
    return df.where(F.col("split").isin(*names))


def pass_splits(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """Given splits under their new names (``{old: new}``); others keep theirs."""
    split = F.col("split")
    renamed = split
    for old, new in names.items():
        renamed = F.when(split == old, F.lit(new)).otherwise(renamed)
    return df.withColumn("split", renamed)


def expert_subset(df: DataFrame, dimensions: Sequence[str]) -> DataFrame:
    return df.where(F.col("dimension").isin(*dimensions))


def ablation_dimensions(mode: str, dimensions: Sequence[str]) -> list[str]:
    """The dimensions left in after an ablation."""
    if mode not in ABLATIONS:
        raise ValueError(f"unknown ablation {mode!r}")
    return [d for d in dimensions if d != ABLATIONS[mode]]


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)
