"""Token ids in files of fixed-width bit-packed blocks.

Every id takes the bits that the vocabulary needs and no more.  64 ids fill
``width`` 64-bit words exactly, so packing and unpacking are 64 vectorised steps
over any number of groups, and the group of the i-th id lies at word ``i // 64 *
width``.  A block holds whole documents, about ``BLOCK`` ids; it is a row of a
Parquet file with its place in the shard, the width, the starts of its documents
and the packed words.  A shard is one file, shards follow one another in
ascending order of ids, and block offsets give access to any range of ids.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from polyview.llm.common import NULL_ID, byte_column, bytes_array, given_id, id_text, list_array, process_state, slices, small_batches, text_key
from polyview.llm.encoders import with_end, word_level
from polyview.session import stored

BLOCK = 1 << 16
GROUP = 64
SHARD = 1 << 26  # bytes of text that a shard holds, about
SMALL = 1 << 20  # shards whose places may be broadcast
SCHEMA = (
    "shard int, block int, first long, n_ids long, width int, doc_ids array<long>, text_keys array<long>, starts array<long>, words binary"
)
U = np.uint64


def bits_for(vocabulary: int) -> int:
    """Bits that hold every id below ``vocabulary``."""
    return max(1, (vocabulary - 1).bit_length())


def pack_bits(ids: np.ndarray, width: int) -> bytes:
    """``ids`` with ``width`` bits each, the last group filled with zeros."""
    if len(ids) and int(ids.max()) >> width:
        raise ValueError(f"id {int(ids.max())} needs more than {width} bits")
    full = np.zeros(-(-len(ids) // GROUP) * GROUP, U)
    full[:len(ids)] = ids
    full = full.reshape(-1, GROUP)
    words = np.zeros((len(full), width), U)
    for j in range(GROUP):
        word, shift = divmod(j * width, 64)
        words[:, word] |= full[:, j] << U(shift)
        if shift + width > 64:
            words[:, word + 1] |= full[:, j] >> U(64 - shift)
    return words.astype("<u8").tobytes()


def unpack_bits(words: bytes, width: int, start: int, stop: int) -> np.ndarray:
    """Ids ``start`` to ``stop`` of a block; only their groups are read."""
    low, high = start // GROUP, -(-stop // GROUP)
    part = np.frombuffer(words, "<u8", (high - low) * width, low * width * 8).reshape(-1, width)
    out = np.empty((high - low, GROUP), U)
    for j in range(GROUP):
        word, shift = divmod(j * width, 64)
        value = part[:, word] >> U(shift)
        if shift + width > 64:
            value = value | part[:, word + 1] << U(64 - shift)
        out[:, j] = value & U((1 << width) - 1)
    return out.ravel()[start - low * GROUP:stop - low * GROUP].astype("<u4")


class _Block:
    def __init__(self, shard: int, width: int):
        self.shard, self.width, self.number, self.first = shard, width, 0, 0
        self._new()

    def _new(self) -> None:
        self.parts: list[tuple[np.ndarray, ...]] = []  # ids, documents, keys, and how many ids each document has
        self.size = 0

    def add(self, ids: np.ndarray, docs: np.ndarray, keys: np.ndarray, counts: np.ndarray) -> None:
        self.parts.append((ids, docs, keys, counts))
        self.size += len(ids)

    def close(self) -> pa.RecordBatch:
        ids, docs, keys, counts = (np.concatenate(p) for p in zip(*self.parts))
        starts = np.cumsum(counts) - counts
        lists = [list_array(c, np.array([len(docs)]), pa.int64()) for c in (docs, keys, starts)]
        words = pack_bits(ids, self.width)
        out = pa.RecordBatch.from_arrays(
            [pa.array([self.shard], pa.int32()), pa.array([self.number], pa.int32()), pa.array([self.first], pa.int64()),
             pa.array([self.size], pa.int64()), pa.array([self.width], pa.int32()), *lists, pa.array([words], pa.binary())],
            ["shard", "block", "first", "n_ids", "width", "doc_ids", "text_keys", "starts", "words"],
        )
        self.number += 1
        self.first += self.size
        self._new()
        return out


def write_tokens(docs: DataFrame, target: str, path: str, vocabulary: int, end: int, doc_id: str = "doc_id", text: str = "text",
                 block: int = BLOCK, encoder: Callable = word_level) -> None:
    """Writes the ids of every text and ``end`` to the folder ``target``, in ascending order of ``doc_id``.

    A NULL id comes first; rows with equal ids follow a hash of their text.  NULL
    and empty texts have the end id alone.  An id beyond the vocabulary is an
    error.  Other columns are not read; an empty table gives a folder without blocks.
    """
    small_batches(docs.sparkSession)
    width = bits_for(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = process_state(f"{encoder.__name__}_{path}", lambda: encoder(path))
        open_block = _Block(TaskContext.get().partitionId(), width)
        for batch in slices(batches):
            ids, counts = with_end(*encode(*byte_column(batch.column("_text"))), end)
            docs, keys = (batch.column(c).to_numpy() for c in ("_id", "_key"))
            edges = np.concatenate([[0], np.cumsum(counts)])
            row = 0
            while row < len(docs):  # documents up to the one that fills the block
                to = min(len(docs), int(np.searchsorted(edges, edges[row] + block - open_block.size)))
                to = max(to, row + 1)
                open_block.add(ids[edges[row]:edges[to]], docs[row:to], keys[row:to], counts[row:to])
                if open_block.size >= block:
                    yield open_block.close()
                row = to
        if open_block.size:
            yield open_block.close()

    rows = id_text(docs, doc_id, text).withColumn("_key", text_key(F.col("_text")))
    size = rows.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // SHARD))
    ordered = rows.repartitionByRange(parts, "_id", "_key").sortWithinPartitions("_id", "_key")
    ordered.mapInArrow(run, SCHEMA).write.option("compression", "uncompressed").parquet(target)


def read_tokens(spark: SparkSession, source: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids, text_key`` of every document in the folder; ``start`` counts the ids before it."""
    blocks = spark.read.schema(SCHEMA).parquet(source)
    upto = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    shards = blocks.groupBy("shard").agg(F.sum("n_ids").alias("_n"))
    bases = stored(shards.select("shard", F.coalesce(F.sum("_n").over(upto), F.lit(0)).alias("_base")), "bases")
    bases = F.broadcast(bases) if bases.count() <= SMALL else bases  # beyond that the engine joins them as it sees fit
    small_batches(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = unpack_bits(row["words"], row["width"], 0, row["n_ids"])
                starts = np.array(row["starts"], np.int64)
                counts = np.diff(np.append(starts, row["n_ids"]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["doc_ids"], pa.int64()), pa.array(row["text_keys"], pa.int64()),
                     pa.array(starts + row["first"] + row["_base"]), pa.array(counts), bytes_array(ids.view(np.uint8), counts * 4)],
                    ["_id", "text_key", "start", "n_tokens", "ids"],
                )

    placed = blocks.join(bases, "shard").select("first", "n_ids", "width", "doc_ids", "text_keys", "starts", "words", "_base")
    rows = placed.mapInArrow(run, "_id long, text_key long, start long, n_tokens long, ids binary")
    return rows.select(given_id().alias("doc_id"), "start", "n_tokens", "ids", "text_key")


def read_range(spark: SparkSession, source: str, doc_id: int | None) -> DataFrame:
    """The documents of one id: blocks without it are skipped, and only its groups are unpacked."""
    wanted = NULL_ID if doc_id is None else doc_id

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                stops = [*row["starts"][1:], row["n_ids"]]
                found = [(a, b) for d, a, b in zip(row["doc_ids"], row["starts"], stops) if d == wanted]
                ids = [unpack_bits(row["words"], row["width"], a, b).tobytes() for a, b in found]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.binary())], ["ids"])

    blocks = spark.read.schema(SCHEMA).parquet(source).where(F.array_contains("doc_ids", F.lit(wanted)))
    return blocks.mapInArrow(run, "ids binary")
