"""Seeded hashing that depends on the key only, never on row or partition order."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def seeded_hash(key: list[Column | str], seed: int | str) -> Column:
    """32 hex digits from ``seed:key`` (several key columns are joined by ``:``)."""
    parts = [F.lit(str(seed))] + [F.col(k) if isinstance(k, str) else k for k in key]
    return F.md5(F.concat_ws(":", *[p.cast("string") for p in parts]))


def hex_cut(fraction: float) -> str:
    """The 8-digit prefix below which ``fraction`` of all hashes fall."""
    return f"{int(fraction * 2**32):08x}"
