"""Padding of ragged token sequences to the longest one of their batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from polyview.functions.text import attention_mask, pad


def batch_lengths(lengths: DataFrame, batch: str = "batch_id", length: str = "real_len") -> DataFrame:
    """Adds ``padded_len``, the longest sequence of the batch.

    Works on lengths alone: only keys and numbers are shuffled, never tokens.
    A batch holds a fixed number of rows, so each window stays small.
    """
    return lengths.withColumn("padded_len", F.max(length).over(Window.partitionBy(batch)))


def pad_rows(df: DataFrame, seq: str, filler: Column) -> DataFrame:
    """Pads ``seq`` to ``padded_len`` and adds its mask; row-local."""
    return df.withColumn(
        "attention_mask", attention_mask(F.col("real_len"), F.col("padded_len"))
    ).withColumn(seq, pad(F.col(seq), F.col("padded_len"), filler))
