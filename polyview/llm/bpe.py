"""Byte-level BPE with a two-tier lookup: a perfect hash for whole pre-tokens, a heap for the rest.

Tier one is a minimal perfect hash over the vocabulary: a cascade of bit arrays,
in which a key takes the first level where no other key has its place; the number
of set bits before it is its index.  The index leads to one vocabulary entry, and
if that equals the pre-token, its rank is the only id.  Tier two holds the bytes
of a missed pre-token as a doubly linked list and merges the neighbours of lowest
rank, leftmost first, from a heap: ``n log n`` for any length.

A batch is cut into chunks in numpy, and each distinct chunk goes through the two
tiers once among about the last two million of a worker (``encoders.Encoder``).
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator
from heapq import heapify, heappop, heappush, heapreplace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from xxhash import xxh64_intdigest

from polyview.llm.chunks import BYTE_PATTERN, ByteChunks
from polyview.llm.common import byte_column, bytes_array, given_id, id_text, process_state, slices, small_batches, text_key
from polyview.llm.encoders import KNOWN, Encoder

NEXT, LAST = list(range(1, 256)), list(range(-1, 254))  # links of the bytes of a short pre-token
SPACE_PER_KEY = 2.0  # places per key that is left, at each level


class PerfectHash:
    """``index(key)``: 0 to n - 1 for the n keys it was built from, any index or -1 for others."""

    def __init__(self, keys: list[bytes], space: float = SPACE_PER_KEY):
        if len(set(keys)) != len(keys):
            raise ValueError("keys are not distinct")
        self.levels: list[tuple[int, bytes, array]] = []
        before, left = 0, keys
        while left:
            size = max(1, int(space * len(left)))
            places = np.array([xxh64_intdigest(k, len(self.levels)) % size for k in left])
            counts = np.bincount(places, minlength=size)
            alone = counts == 1
            ranks = before + np.cumsum(alone) - alone
            self.levels.append((size, alone.astype(np.uint8).tobytes(), array("q", ranks.tolist())))
            before += int(alone.sum())
            left = [k for k, p in zip(left, places.tolist()) if counts[p] > 1]

    def index(self, key: bytes) -> int:
        for seed, (size, taken, ranks) in enumerate(self.levels):
            place = xxh64_intdigest(key, seed) % size
            if taken[place]:
                return ranks[place]
        return -1


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: base64 of the bytes and the rank in every line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class Codec:
    """Encoder and decoder for a table of ranks that holds every single byte."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = BYTE_PATTERN):
        if any(bytes([b]) not in ranks for b in range(256)):
            raise ValueError("the vocabulary must hold every single byte")
        self.ranks = ranks
        self.pair_ranks = {(a, b): ranks.get(bytes((a, b))) for a in range(256) for b in range(256)}.__getitem__
        self.hash = PerfectHash(list(ranks))
        self.entries: list[tuple[bytes, int]] = [(b"", -1)] * len(ranks)
        for token, rank in ranks.items():
            self.entries[self.hash.index(token)] = token, rank
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.encode = ByteChunks(lambda p: self.piece(p.encode()), pattern)

    def piece(self, piece: bytes) -> list[int]:
        """Ids of one pre-token."""
        token, rank = self.entries[self.hash.index(piece)]
        return [rank] if token == piece else self.merge(piece)

    def merge(self, piece: bytes) -> list[int]:
        rank_of, n = self.ranks.get, len(piece)
        after = NEXT[:n + 1] if n < len(NEXT) else list(range(1, n + 2))  # where the part that starts here ends, and the next one starts
        before = LAST[:n] if n < len(LAST) else list(range(-1, n - 1))
        rank_at = [*map(self.pair_ranks, zip(piece, piece[1:])), None]  # of the part that starts here and the next one
        heap = [rank * n + i for i, rank in enumerate(rank_at) if rank is not None]  # by rank, then by place
        heapify(heap)
        while heap:
            rank, i = divmod(heap[0], n)
            if rank_at[i] != rank:
                heappop(heap)  # one of the two parts has been merged since
                continue
            middle = after[i]
            after[i] = end = after[middle]
            rank_at[middle] = None
            if end < n:
                before[end] = i
                rank_at[i] = rank = rank_of(piece[i:after[end]])
            else:
                rank_at[i] = rank = None
            if rank is None:
                heappop(heap)
            else:
                heapreplace(heap, rank * n + i)
            if i:
                left = before[i]
                rank_at[left] = rank = rank_of(piece[left:end])
                if rank is not None:
                    heappush(heap, rank * n + left)
        ids, i = [], 0
        while i < n:
            ids.append(self.ranks[piece[i:after[i]]])
            i = after[i]
        return ids

    def decode(self, ids: bytes) -> bytes:
        return joined(self.bytes_of, ids)


def joined(bytes_of: dict[int, bytes], ids: bytes) -> bytes:
    return b"".join(map(bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


class BatchCodec(Encoder):
    """Ids of whole batches: each distinct chunk that the worker does not remember goes through the two tiers once."""

    def __init__(self, codec: Codec, known: int = 2 * KNOWN):
        self.codec, self.words, self.limit, self.special = codec, False, known, []
        self._forget()

    def _whole(self, text: bytes) -> np.ndarray:
        return np.frombuffer(self.codec.encode(text), "<u4")

    def _encoded(self, texts: list[str]) -> list[list[int]]:
        piece, find = self.codec.piece, self.codec.encode.find
        # a space and ASCII letters are one match of the pattern
        return [piece(t.encode()) if t.isascii() and t[1:].isalpha() and (t[0] == " " or t[0].isalpha())
                else [i for p in find(t) for i in piece(p.encode())] for t in texts]


def _encoder(path: str) -> BatchCodec:
    return process_state(f"bpe_{path}", lambda: BatchCodec(Codec(read_ranks(path))))


def _bytes_of(path: str) -> dict[int, bytes]:
    return process_state(f"bpe_bytes_{path}", lambda: {rank: token for token, rank in read_ranks(path).items()})


def encode(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_tokens, ids, text_key``: one row per input row, ``ids`` as little-endian unsigned 32-bit integers.

    The whole text is encoded by the ranks in ``path``, without special tokens.
    NULL and empty texts have no ids.  Nothing is shuffled; repeated rows are
    encoded each; other columns are not read.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode_rows = _encoder(path)
        for batch in slices(batches):
            ids, counts = encode_rows(*byte_column(batch.column("_text")))
            coded = bytes_array(ids.astype("<u4", copy=False).view(np.uint8), 4 * counts)
            yield pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("_key"), coded], ["_id", "_key", "ids"])

    rows = id_text(docs, doc_id, text).withColumn("_key", text_key(F.col("_text")))
    return rows.mapInArrow(run, "_id long, _key long, ids binary").select(
        given_id().alias("doc_id"), (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids", F.col("_key").alias("text_key")
    )


def decode(encoded: DataFrame, path: str, ids: str = "ids", name: str = "decoded") -> DataFrame:
    """``encoded`` with the bytes of its ids in column ``name``; NULL ids have no bytes."""
    small_batches(encoded.sparkSession)
    schema = encoded.withColumn(name, F.lit(None).cast("binary")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bytes_of = _bytes_of(path)
        for batch in batches:
            texts = [joined(bytes_of, x or b"") for x in batch.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.binary())], [*batch.schema.names, name])

    return encoded.mapInArrow(run, schema)
