"""Packing of documents into sequences: shortest pack first over the histogram of lengths.

A document's ids are cut into pieces of at most one sequence.  Only the histogram
of piece lengths (at most ``capacity`` numbers) comes to the driver.  Lengths are
placed longest first, each into the shortest open pack with room for it; equal
packs are one pattern with a count, so the work follows the number of patterns
and not that of documents.  Pieces find their place by rank: the r-th piece of a
length fills the r-th slot of that length.  The task that cuts a piece counts its
rank within the part, and the counts of the parts before it are added, so ids are
written once and never shuffled.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from polyview.llm.common import byte_column, bytes_array, given_id, id_text, process_state, slices, small_batches, text_key
from polyview.llm.encoders import byte_level, with_end
from polyview.session import stored

CAPACITY = 1024
END = 0
SMALL = 1 << 21  # counts of a length in a part that may be broadcast


def patterns(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[list[int], int]]:
    """Packs as ``(lengths, count)``: longest lengths first, each into the shortest pack that has room."""
    open_packs: dict[int, list[tuple[list[int], int]]] = defaultdict(list)  # by room left
    done: list[tuple[list[int], int]] = []
    for length in sorted(histogram, reverse=True):
        if not 0 < length <= capacity:
            raise ValueError(f"length {length} does not fit {capacity}")
        left, room = histogram[length], capacity
        grown = []
        while left:
            while room >= length and not open_packs[room]:
                room -= 1
            if room < length:
                grown.append(([length], left))
                break
            pack, count = open_packs[room].pop()
            used = min(count, left)
            if count > used:
                open_packs[room].append((pack, count - used))
            grown.append(([*pack, length], used))
            left -= used
            if not left:
                break
            if room - length >= length:  # the pack may take another one of this length
                pack, count = grown.pop()
                open_packs[room - length].append((pack, count))
        for pack, count in grown:
            rest = capacity - sum(pack)
            (open_packs[rest] if rest else done).append((pack, count))
    return done + [p for packs in open_packs.values() for p in packs]


def slots(found: list[tuple[list[int], int]]) -> dict[str, np.ndarray]:
    """Where ranks of a length go: from rank ``low`` of ``length`` on, to sequence ``base`` on, at ``offset``."""
    out, used, base = [], defaultdict(int), 0
    for lengths, count in found:
        offset = 0
        for length in lengths:
            out.append((length, used[length], base, offset))
            used[length] += count
            offset += length
        base += count
    table = np.array(sorted(out), np.int64).reshape(-1, 4)
    return dict(zip(("length", "low", "base", "offset"), table.T))


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END, doc_id: str = "doc_id", text: str = "text",
           encoder: Callable = byte_level) -> DataFrame:
    """``_id, _key, start, length, doc_tokens, ids, _part, _rank``: the ids of each text and ``end``, cut every ``capacity``.

    ``_rank`` counts the pieces of a length in the part.
    """
    small_batches(docs.sparkSession)
    names = ["_id", "_key", "start", "length", "doc_tokens", "ids", "_part", "_rank"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = process_state(f"{encoder.__name__}_{path}", lambda: encoder(path))
        part, met = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in slices(batches):
            ids, totals = with_end(*encode(*byte_column(batch.column("_text"))), end)
            cuts = -(-totals // capacity)
            row = np.repeat(np.arange(batch.num_rows), cuts)
            start = (np.arange(len(row)) - np.repeat(np.cumsum(cuts) - cuts, cuts)) * capacity
            length = np.minimum(totals[row] - start, capacity)
            order = np.argsort(length, kind="stable")
            sorted_length = length[order]
            rank = np.empty(len(row), np.int64)
            rank[order] = met[sorted_length] + np.arange(len(row)) - np.searchsorted(sorted_length, sorted_length)
            met += np.bincount(length, minlength=capacity + 1)
            which = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [batch.column("_id").take(which), batch.column("_key").take(which), pa.array(start), pa.array(length), pa.array(totals[row]),
                 bytes_array(ids.astype("<u4").view(np.uint8), length * 4), pa.array(np.full(len(row), part, np.int32)), pa.array(rank)], names
            )

    rows = id_text(docs, doc_id, text).withColumn("_key", text_key(F.col("_text")))
    return rows.mapInArrow(run, "_id long, _key long, start long, length long, doc_tokens long, ids binary, _part int, _rank long")


def place(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``cut`` (a stored frame of ``pieces``) with ``sequence_id`` and ``offset``.

    The counts per length and part are broadcast if there are at most ``SMALL`` of them; else the engine joins them as it sees fit.
    """
    counts = stored(cut.groupBy("length", "_part").agg(F.count(F.lit(1)).alias("_n")), "counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("_n").alias("n")).collect()}
    table = slots(patterns(histogram, capacity))
    first = np.searchsorted(table["length"], np.arange(capacity + 2))
    upto = Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("length", "_part", F.coalesce(F.sum("_n").over(upto), F.lit(0)).alias("_before"))
    before = F.broadcast(before) if counts.count() <= SMALL else before

    @F.pandas_udf("sequence_id long, offset long")
    def slot(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        length, rank = length.to_numpy(), rank.to_numpy()
        at = np.empty(len(length), np.int64)
        for n in np.unique(length):
            own = length == n
            lo, hi = first[n], first[n + 1]
            at[own] = lo + np.searchsorted(table["low"][lo:hi], rank[own], "right") - 1
        return pd.DataFrame({"sequence_id": table["base"][at] + rank - table["low"][at], "offset": table["offset"][at]})

    ranked = cut.join(before, ["length", "_part"]).withColumn("_slot", slot("length", F.col("_rank") + F.col("_before")))
    return ranked.select(*[c for c in cut.columns if c not in ("_part", "_rank")], "_slot.sequence_id", "_slot.offset")


def sequences(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, text_key, start, length, doc_tokens, sequence_id, offset, ids``: the packed sequences, one row per piece of a document.

    ``path`` is a byte-level tokenizer file; ``end`` closes every document, so NULL
    and empty texts have one id.  ``ids`` are the piece's ids, 4 bytes each, and
    ``text_key`` tells rows apart that share an id.  A sequence holds its pieces
    without gaps from offset 0 and is padded behind them.  Repeated rows are packed
    each, in any order among themselves.  Other columns are not read; an empty table
    gives an empty result.
    """
    return place(stored(pieces(docs, path, capacity, end, doc_id, text), "pieces"), capacity).select(
        given_id().alias("doc_id"), F.col("_key").alias("text_key"), "start", "length", "doc_tokens", "sequence_id", "offset", "ids"
    )


def digests(packed_rows: DataFrame) -> DataFrame:
    """``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset`` of the rows of ``sequences``."""
    return packed_rows.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The digests of ``sequences``."""
    return digests(sequences(docs, path, capacity, end, doc_id, text))
