"""Helpers shared by the operators: bounded batches, per-process state, small frames."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from polyview.session import small_batches  # noqa: F401

NULL_ID = -(2**63)  # stands for a NULL id inside an operator: sorts first, like NULL
SLICE_BYTES = 2 << 20  # text bytes that a worker turns into arrays at once


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def id_text(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Only ``_id`` (NULL as the smallest long) and ``_text`` (NULL as empty)."""
    return docs.select(id_column(doc_id).alias("_id"), text_column(text).alias("_text"))


def id_column(name: str) -> Column:
    return F.coalesce(F.col(f"`{name}`").cast("long"), F.lit(NULL_ID))


def text_column(name: str) -> Column:
    return F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(""))


def given_id(name: str = "_id") -> Column:
    """The id as it came in."""
    return F.when(F.col(name) != NULL_ID, F.col(name))


def text_key(text: Column) -> Column:
    """Tells rows apart that share an id but not the text."""
    return F.xxhash64(text)


def process_state(name: str, make: Callable[[], object]) -> object:
    """One object per Python worker process, shared by the tasks of a stage that it runs one after another.

    Task functions travel by value, so a module global would start anew in every task.
    A worker outlives its stage: what earlier stages kept is let go when the next one asks.
    """
    home = sys.modules.setdefault("polyview_process_state", types.ModuleType("polyview_process_state"))
    context = TaskContext.get()
    stage = context.stageId() if context else None
    if getattr(home, "stage", None) != stage or not hasattr(home, "kept"):
        home.stage, home.kept = stage, {}
    if name not in home.kept:
        home.kept[name] = make()
    return home.kept[name]


def byte_column(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column, end to end, and the offsets of its rows."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buf[offsets[0]:offsets[-1]], offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], text: str = "_text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Record batches cut so that each holds at most ``limit`` text bytes, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = byte_column(batch.column(text))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
            yield batch.slice(at, to - at)
            at = to


def list_array(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """Rows of ``counts`` consecutive ``values`` each."""
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


def bytes_array(data: np.ndarray, counts: np.ndarray) -> pa.Array:
    """Binary values of ``counts`` consecutive bytes of ``data`` each."""
    offsets = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(counts, out=offsets[1:])
    large = pa.Array.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])
    return large.cast(pa.binary())
