"""Removal of repeated passages by seed and extend.

A passage is repeated if ``window`` consecutive words (20) also start earlier: in
a document with a smaller id, or earlier in the same one.

**Copies.** A text equal to that of a smaller id repeats as a whole; its words go
without a search.

**Seeds.** ``grams`` of ``seed`` words are winnowed: of the ``window - seed + 1``
grams in a window the least hash is its anchor.  Equal windows have equal
anchors, so a window can only repeat if its anchor does.  Anchors are joined on
their hash over all documents; only a few in a hundred occur twice.

**Extension.** From every anchor that is found again the match is extended to the
left and to the right: all windows that contain the anchor, as far as the one
that begins with it and the one that ends with it, are compared by 128 bits of
hash with their counterparts around the other places of the anchor.  Matching
windows overlap, and a run of them is one maximal repeat.

**Hot passages.** No pairs are made.  It is enough to know that a window starts
earlier *somewhere*: within a batch all but the first place of a window are
settled at once, and the shuffle carries one place per window and batch.  The
same holds for anchors.  So a passage that a third of all documents share comes
to its task once per batch, not once per document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from polyview.llm.common import byte_column, given_id, id_column, list_array, slices, small_batches, text_column, text_key
from polyview.llm.words import Words, find_words, grams, sliding_min, whole

WINDOW = 20
SEED = 12
SHARES = 64  # shares into which the rows of one text are dealt
HASHES = (101, 202)  # seeds of two independent word hashes
U = np.uint64


def _batch_words(batch: pa.RecordBatch) -> Words:
    return find_words(*byte_column(batch.column("_text")))


def window_anchors(words: Words, hashes: np.ndarray, window: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """For every ``window`` words in a row: whether they lie in one row of the batch, and their anchor."""
    least = sliding_min(grams(hashes, seed), window - seed + 1)
    return whole(words.first, len(hashes), window), least


def _unique(*columns: np.ndarray) -> np.ndarray:
    """Indices that sort the columns and keep the first of equal rows."""
    order = np.lexsort(columns[::-1])
    keep = np.zeros(len(order), bool)
    keep[:1] = True
    for c in columns:
        c = c[order]
        keep[1:] |= c[1:] != c[:-1]
    return order[keep]


def _anchors(window: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            words = _batch_words(batch)
            ok, least = window_anchors(words, words.hashes(HASHES[0]), window, seed)
            at = np.flatnonzero(ok)
            row, value = words.rows()[at], least[at]
            new = np.ones(len(at), bool)
            new[1:] = (value[1:] != value[:-1]) | (row[1:] != row[:-1])
            row, value = row[new], value[new]
            pick = _unique(value, row)
            row, value = row[pick], value[pick]
            # rows of one anchor lie together now: one goes to the shuffle, with the word that others follow
            head = np.ones(len(value), bool)
            head[1:] = value[1:] != value[:-1]
            group = np.cumsum(head) - 1
            shared = np.bincount(group, minlength=1)[group] > 1 if len(group) else head
            # document by document again: neighbours with equal ids cost little in the shuffle
            order = np.argsort(row, kind="stable")
            row, value, shared, head = row[order], value[order], shared[order], head[order]
            yield pa.RecordBatch.from_arrays(
                [batch.column("_id").take(pa.array(row)), batch.column("_key").take(pa.array(row)),
                 pa.array(value.view(np.int64)), pa.array(shared), pa.array(head)],
                ["_id", "_key", "_anchor", "_shared", "_head"],
            )

    return run


def _pair(row: np.ndarray, value: np.ndarray) -> np.ndarray:
    """One number for a row of the batch and an anchor; a clash only adds a window to compare."""
    return value * U(0x9E3779B97F4A7C15) + row.astype(U) * U(0xD6E8FEB86659FD93)


def _listed(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """Row and value of all entries of a list column."""
    column = batch.column(name)
    counts = np.diff(column.offsets.to_numpy())
    return np.repeat(np.arange(batch.num_rows), counts), column.flatten().to_numpy(zero_copy_only=False)


def _in_two_places(least: np.ndarray, ok: np.ndarray, hashes: np.ndarray, rows: np.ndarray, window: int, seed: int) -> np.ndarray:
    """Pairs of row and anchor for anchors that lie in two places of their row."""
    values = grams(hashes, seed)
    pad = np.zeros(window - seed, U)
    # a gram is an anchor if it is the least of some window around it
    highest = ~sliding_min(~np.concatenate([pad, np.where(ok, least, U(0)), pad]), window - seed + 1)
    at = np.flatnonzero(highest == values)
    pairs, counts = np.unique(_pair(rows[at], values[at]), return_counts=True)
    return pairs[counts > 1]


def _windows(window: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            words = _batch_words(batch)
            first = words.hashes(HASHES[0])
            ok, least = window_anchors(words, first, window, seed)
            if not ok.any():
                continue
            rows = words.rows()
            at = np.flatnonzero(ok)
            pairs = _pair(rows[at], least[at])
            head = np.ones(len(at), bool)
            head[1:] = pairs[1:] != pairs[:-1]
            own_row, own = _listed(batch, "_anchors")
            known = np.concatenate([_pair(own_row, own.view(U)), _in_two_places(least, ok, first, rows, window, seed)])
            at = at[np.isin(pairs[head], known)[np.cumsum(head) - 1]]
            h1, h2 = grams(first, window)[at], grams(words.hashes(HASHES[1]), window)[at]
            row = rows[at]
            start = at - words.first[row]
            ids, keys = (batch.column(c).to_numpy()[row] for c in ("_id", "_key"))
            order = np.lexsort((start, keys, ids, h2, h1))
            h1, h2, row, start, ids, keys = (c[order] for c in (h1, h2, row, start, ids, keys))
            head = np.ones(len(order), bool)
            head[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
            lead = np.maximum.accumulate(np.where(head, np.arange(len(order)), 0))
            later = np.flatnonzero((ids != ids[lead]) | (keys != keys[lead]) | (start != start[lead]))
            # document by document again: neighbours with equal ids cost little in the shuffle
            lone = np.flatnonzero(head)
            lone = lone[np.argsort(row[lone], kind="stable")]
            yield _open_places(ids[lone], keys[lone], start[lone], h1[lone], h2[lone])
            later = later[np.argsort(row[later], kind="stable")]
            owner, counts = np.unique(row[later], return_counts=True)
            whose = pa.array(owner)
            yield _settled_places(batch.column("_id").take(whose), batch.column("_key").take(whose), counts, start[later])

    return run


def _open_places(ids, keys, starts, h1, h2) -> pa.RecordBatch:
    """One place of a window that may start earlier elsewhere."""
    return pa.RecordBatch.from_arrays(
        [pa.array(ids), pa.array(keys), pa.array(starts.astype(np.int32)), pa.nulls(len(ids), pa.list_(pa.int32())),
         pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64))], _PLACES
    )


def _settled_places(ids, keys, counts, starts) -> pa.RecordBatch:
    """All places in a document whose windows are known to start earlier."""
    empty = pa.nulls(len(ids), pa.int64())
    return pa.RecordBatch.from_arrays(
        [ids, keys, pa.nulls(len(ids), pa.int32()), list_array(starts.astype(np.int32), counts, pa.int32()), empty, empty], _PLACES
    )


_PLACES = ["_id", "_key", "_start", "_starts", "_h1", "_h2"]


def _cut(window: int, carried: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            words = _batch_words(batch)
            counts = words.counts
            column = batch.column("_starts")
            starts_of = np.diff(column.offsets.to_numpy())
            rows = np.repeat(np.arange(batch.num_rows), starts_of)
            begin = words.first[rows] + column.flatten().to_numpy()
            cover = np.zeros(len(words.starts) + 1, np.int32)
            np.add.at(cover, begin, 1)
            np.add.at(cover, begin + window, -1)
            gone = np.cumsum(cover)[:-1] > 0
            gone |= np.repeat(batch.column("_copy").to_numpy(zero_copy_only=False) & (counts >= window), counts)
            data = words.buf.tobytes()
            texts, digests, removed, spans = [], [], [], []
            all_starts, all_ends = words.starts.tolist(), words.ends.tolist()
            for r in range(batch.num_rows):
                lo, hi = words.first[r], words.first[r + 1]
                mask = gone[lo:hi]
                n = int(mask.sum())
                if n:
                    kept = b" ".join([data[all_starts[i]:all_ends[i]] for i in (np.flatnonzero(~mask) + lo).tolist()])
                    edge = np.diff(np.concatenate([[0], mask.astype(np.int8), [0]]))
                    spans.append([{"start": int(a), "end": int(b)} for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1))])
                    texts.append(kept)
                else:
                    kept = b" ".join([data[a:b] for a, b in zip(all_starts[lo:hi], all_ends[lo:hi])])
                    spans.append([])
                    texts.append(None)
                removed.append(n)
                digests.append(hashlib.sha256(kept).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("_id"), batch.column("_key"), pa.array(counts.astype(np.int64)), pa.array(removed, pa.int64()),
                 pa.array(digests, pa.string()), pa.array(texts, pa.binary()).cast(pa.string()), pa.array(spans, SPANS),
                 *(batch.column(c) for c in carried)],
                ["_id", "_key", "n_words", "n_removed", "kept_sha256", "kept_text", "spans", *carried],
            )

    return run


_RESULT = (
    "_id long, _key long, n_words long, n_removed long, kept_sha256 string, kept_text string, "
    "spans array<struct<start:long,end:long>>"
)
SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def substring_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, seed: int = SEED,
                    carry: bool = False) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256, kept_text, spans, text_key``: one row per input row.

    ``spans`` are the maximal repeats, as word positions ``[start, end)``;
    ``kept_text`` is what is left, joined by one space, or NULL if nothing was
    removed; the digest is that of the kept words joined by one space.  NULL and
    empty texts have no words.  A NULL id comes before all others; rows with equal
    ids are ordered by a hash of the text, and rows that repeat id and text are one
    document.  Texts shorter than ``window`` words are kept.  Other columns are not
    read; an empty table gives an empty result.  With ``carry`` the whole input row
    travels along and is returned as the struct ``row``.
    """
    if not 0 < seed < window:
        raise ValueError("a seed is shorter than a window")
    small_batches(docs.sparkSession)
    key = ["_id", "_key"]
    rows = docs.select(
        id_column(doc_id).alias("_id"), text_column(text).alias("_text"),
        *[F.col(f"`{c}`").alias(f"_c{n}") for n, c in enumerate(docs.columns) if carry and c != text],
        *([F.col(f"`{text}`").isNull().alias("_null")] if carry else []),
    ).withColumn("_key", text_key(F.col("_text")))
    carried = [c for c in rows.columns if c not in ("_id", "_key")] if carry else []
    digests = rows.select(*key, F.sha2("_text", 256).alias("_digest"))
    # first among a share of a text's rows, then among the first of each share: no text crowds a task
    share = F.pmod(F.xxhash64("_id"), F.lit(SHARES))
    early = digests.withColumn("_first", F.min("_id").over(Window.partitionBy("_digest", share)))
    heads = early.where("_id = _first").select(*key, "_digest").distinct()
    late = heads.withColumn("_first", F.min("_id").over(Window.partitionBy("_digest"))).where("_id <> _first")
    copies = early.where("_id <> _first").select(*key).unionByName(late.select(*key)).distinct().withColumn("_copy", F.lit(True))
    # one exchange of the texts by document serves all three joins
    dealt = rows.repartition(*key)
    marked = dealt.join(copies.hint("shuffle_hash"), key, "left").withColumn("_copy", F.coalesce("_copy", F.lit(False)))
    # every branch takes the same columns, else the exchange would not be shared
    searched = marked.where(~F.col("_copy")).drop("_copy")

    found = searched.mapInArrow(_anchors(window, seed), "_id long, _key long, _anchor long, _shared boolean, _head boolean")
    # what a batch has settled is dealt out by document, so that it crowds nowhere
    deal = F.when(F.col("_head"), F.col("_anchor")).otherwise(F.xxhash64(*key))
    met = F.count(F.lit(1)).over(Window.partitionBy("_deal", "_head"))
    shared = found.withColumn("_deal", deal).withColumn("_met", met).where((F.col("_met") > 1) | F.col("_shared"))
    anchored = shared.groupBy(*key).agg(F.collect_set("_anchor").alias("_anchors"))

    nothing = F.array().cast("array<long>")
    seeded = searched.join(anchored.hint("shuffle_hash"), key, "left").withColumn("_anchors", F.coalesce("_anchors", nothing))
    places = seeded.mapInArrow(_windows(window, seed), "_id long, _key long, _start int, _starts array<int>, _h1 long, _h2 long")
    place = F.struct(*key, "_start")
    settled = F.col("_start").isNull()
    deal = F.when(settled, F.xxhash64(*key)).otherwise(F.col("_h1"))
    least = F.min(place).over(Window.partitionBy("_h1", "_h2"))
    later = (
        places.withColumn("_h1", deal).withColumn("_least", least).where(settled | (place > F.col("_least")))
        .groupBy(*key).agg(F.flatten(F.collect_list(F.coalesce("_starts", F.array("_start")))).alias("_starts"))
    )

    nowhere = F.array().cast("array<int>")
    last = marked.join(later.hint("shuffle_hash"), key, "left").withColumn("_starts", F.coalesce("_starts", nowhere))
    schema = T.StructType([*T.StructType.fromDDL(_RESULT).fields, *[rows.schema[c] for c in carried]])
    cut = last.mapInArrow(_cut(window, carried), schema)
    given_text = F.when(~F.col("_null"), F.col("_text")) if carry else None
    row = [(given_text if c == text else F.col(f"_c{n}")).alias(c) for n, c in enumerate(docs.columns) if carry]
    return cut.select(
        given_id().alias("doc_id"), "n_words", "n_removed", "kept_sha256", "kept_text", "spans", F.col("_key").alias("text_key"),
        *([F.struct(*row).alias("row")] if carry else []),
    )
