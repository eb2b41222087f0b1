"""SimHash near-duplicates by anchor-point covering.

**Fingerprints.** Each shingle of words is hashed with XXH64; bit b of the
fingerprint is set if more than half of the hashes have it.

**Anchors.** The 64 bits are cut into blocks of 22, 22 and 20.  If two
fingerprints differ in at most 4 bits, then the first block differs in at most 1,
or the second in at most 1, or the third in none (2 + 2 + 1 would be 5).  In a
block the anchors are the words of a covering code: the [15, 11] Hamming code, a
perfect code of covering radius 1, on 15 bits, and all values of the others.
Each fingerprint has one home per block, the anchor within radius 1, and is
replicated to every anchor within radius plus the block's threshold.  Two
fingerprints whose blocks differ within the threshold then meet at the home of
either one, so comparing homes with all others per anchor loses no link.  A
fingerprint has about 30 replicas, and there are 589,824 anchors in all.

**Links.** An anchor's rows are compared where they lie, and a task returns only
a star per group of linked rows, not the pairs.  Crowded anchors are cut into
tiles, and every pair of tiles is compared in a task of its own.  Components of
the stars give the classes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from xxhash import xxh64_intdigest

from polyview.llm.common import byte_column, given_id, id_text, process_state, slices, small_batches, text_key
from polyview.llm.components import components
from polyview.session import stored

SHINGLE = 4
DISTANCE = 4
SEED = 42
BLOCKS = ((0, 22, 1), (22, 22, 1), (44, 20, 0))  # first bit, bits, threshold
CODE_BITS = 15
TILE = 4096  # rows of a crowded anchor that one side of a comparison holds
HASHES = 1 << 18  # hashes whose bits are counted at once
PAIRS = 1 << 21  # pairs compared at once
U = np.uint64


def shingle_hashes(text: bytes, size: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    words = text.lower().split()  # on bytes: A-Z only, and the six white-space bytes
    if len(words) <= size:
        return np.array([xxh64_intdigest(b" ".join(words), seed)] if words else [], U)
    line = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    n = len(words) - size + 1
    return np.fromiter((xxh64_intdigest(line[a:b], seed) for a, b in zip(starts[:n].tolist(), ends[size - 1:].tolist())), U, n)


def vote(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Per row of ``counts`` consecutive hashes: the bits set in more than half of them."""
    sums = np.zeros((len(counts), 64), np.int64)
    ends = np.cumsum(counts)
    for at in range(0, len(hashes), HASHES):
        block = hashes[at:at + HASHES]
        bits = np.unpackbits(block.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        row = np.searchsorted(ends, np.arange(at, at + len(block)), "right")
        starts = np.flatnonzero(np.diff(row, prepend=-1))
        sums[row[starts]] += np.add.reduceat(bits, starts, axis=0, dtype=np.int32)
    return np.packbits(sums * 2 > counts[:, None], axis=1).view(">u8").ravel().astype(U)


def _fingerprints(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            buf, offsets = byte_column(batch.column("_text"))
            data = buf.tobytes()
            counts, hashes = np.zeros(batch.num_rows, np.int64), []
            for r, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
                got = shingle_hashes(data[a:b], size)
                counts[r] = len(got)
                hashes.append(got)
            fp = vote(np.concatenate(hashes), counts)
            yield pa.RecordBatch.from_arrays(
                [batch.column("_id"), batch.column("_key"), pa.array(fp.view(np.int64))], ["_id", "_key", "_fp"]
            )

    return run


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = SHINGLE) -> DataFrame:
    """``_id, _key, _fp`` of every row; a text without words has fingerprint zero."""
    small_batches(docs.sparkSession)
    rows = id_text(docs, doc_id, text).withColumn("_key", text_key(F.col("_text")))
    return rows.mapInArrow(_fingerprints(size), "_id long, _key long, _fp long")


def _make_code() -> tuple[np.ndarray, np.ndarray]:
    """For each 15-bit word: its nearest codeword, and the up to seven at distance two (-1: none)."""
    values = np.arange(1 << CODE_BITS)
    syndrome = np.zeros(len(values), np.int64)
    for place in range(1, CODE_BITS + 1):
        syndrome ^= ((values >> (place - 1)) & 1) * place
    flip = lambda place: np.where(place > 0, 1 << np.maximum(place - 1, 0), 0)
    near = values ^ flip(syndrome)
    second = np.full((len(values), 7), -1)
    for s in range(1, CODE_BITS + 1):
        pairs = [(i, i ^ s) for i in range(1, CODE_BITS + 1) if i < i ^ s]
        at = np.flatnonzero(syndrome == s)
        for n, (i, j) in enumerate(pairs):
            second[at, n] = values[at] ^ (1 << (i - 1)) ^ (1 << (j - 1))
    return near, second


def _code() -> tuple[np.ndarray, np.ndarray]:
    return process_state("simhash_code", _make_code)


def anchors(fp: np.ndarray, blocks=BLOCKS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``row, anchor, home`` of every replica of the fingerprints ``fp`` (unsigned)."""
    near_of, second_of = _code()
    rows, keys, homes = [], [], []
    every = np.arange(len(fp))
    for n, (first, bits, threshold) in enumerate(blocks):
        value = ((fp >> U(first)) & U((1 << bits) - 1)).astype(np.int64)
        word, free = value & ((1 << CODE_BITS) - 1), value >> CODE_BITS
        put = lambda r, code, rest, home: (rows.append(r), keys.append((n << 22) | (rest << CODE_BITS) | code), homes.append(np.full(len(r), home)))  # noqa: E731, B023
        put(every, near_of[word], free, True)
        if threshold not in (0, 1):
            raise ValueError("a block's threshold is 0 or 1")
        if threshold:
            for column in second_of[word].T:
                some = np.flatnonzero(column >= 0)
                put(some, column[some], free[some], False)
            for bit in range(bits - CODE_BITS):
                put(every, near_of[word], free ^ (1 << bit), False)
    return np.concatenate(rows), np.concatenate(keys), np.concatenate(homes)


def _replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 65536):
            fp = batch.column("_fp").slice(at, 65536).to_numpy(zero_copy_only=False)
            row, key, home = anchors(fp.view(U))
            yield pa.RecordBatch.from_arrays([pa.array(key.astype(np.int32)), pa.array(home), pa.array(fp[row])], ["anchor", "home", "_fp"])


def roots(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Joins the classes of ``a[i]`` and ``b[i]`` in the forest ``parent``; roots are least members."""
    while len(a):
        for side in (a, b):
            while not np.array_equal(up := parent[side], parent[up]):
                parent[side] = parent[up]
        a, b = parent[a], parent[b]
        apart = a != b
        a, b = a[apart], b[apart]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))


def stars(group: np.ndarray, home: np.ndarray, fp: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between linked rows of a group and one of them; ``group`` is sorted, homes come first in it."""
    n = len(fp)
    last = np.searchsorted(group, group, "right")
    first = np.flatnonzero(home)
    todo = last[first] - first - 1
    parent = np.arange(n)
    total = np.cumsum(todo)
    at = 0
    while at < len(first):
        done = total[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(total, done + PAIRS, "right")))
        left = np.repeat(first[at:to], todo[at:to])
        right = left + 1 + np.arange(len(left)) - np.repeat(total[at:to] - todo[at:to] - done, todo[at:to])
        close = np.flatnonzero(np.bitwise_count(fp[left] ^ fp[right]) <= distance)
        roots(parent, left[close], right[close])
        at = to
    while not np.array_equal(up := parent[parent], parent):
        parent = up
    linked = np.flatnonzero(fp != fp[parent])
    pairs = np.unique(np.stack([fp[linked], fp[parent[linked]]], axis=1), axis=0)
    return pairs[:, 0], pairs[:, 1]


def _compare(distance: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def finish(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
            all_rows = pa.Table.from_batches(parts)
            column = lambda name: all_rows.column(name).to_numpy()
            change = np.zeros(all_rows.num_rows, bool)
            for name in ("anchor", "a", "b"):
                values = column(name)
                change[1:] |= values[1:] != values[:-1]
            a, b = stars(np.cumsum(change), column("home"), column("_fp").view(U), distance)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["u", "v"])

        for batch in batches:
            if not batch.num_rows:
                continue
            # the last group may go on in the next batch
            same = np.ones(batch.num_rows, bool)
            for name in ("anchor", "a", "b"):
                values = batch.column(name).to_numpy()
                same &= values == values[-1]
            cut = batch.num_rows - int(np.argmin(same[::-1])) if not same.all() else 0
            if cut:
                yield finish([*held, batch.slice(0, cut)])
                held = []
            held.append(batch.slice(cut))
        if held:
            yield finish(held)

    return run


def simhash_links(prints: DataFrame, distance: int = DISTANCE, tile: int = TILE) -> DataFrame:
    """``u, v``: stars that connect all distinct fingerprints in ``_fp`` that differ in at most ``distance`` bits."""
    if sum(t + 1 for *_, t in BLOCKS) <= distance:
        raise ValueError(f"the blocks cover {sum(t + 1 for *_, t in BLOCKS) - 1} differing bits, {distance} are asked for")
    keyed = prints.select("_fp").distinct().mapInArrow(_replicate, "anchor int, home boolean, _fp long")
    # at most one row per anchor of the code, so this broadcast is bounded by 589,824 rows
    crowded = keyed.groupBy("anchor").count().where(F.col("count") > tile).select("anchor", F.ceil(F.col("count") / tile).cast("int").alias("tiles"))
    tiled = keyed.join(F.broadcast(crowded), "anchor", "left").withColumn("tiles", F.coalesce("tiles", F.lit(1)))
    mine = F.pmod(F.xxhash64("_fp", F.lit(1)), F.col("tiles")).cast("int")
    spread = tiled.withColumn("mine", mine).select(
        "anchor", "home", "_fp", "mine", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("other")
    )
    dealt = spread.select("anchor", F.least("mine", "other").alias("a"), F.greatest("mine", "other").alias("b"), "home", "_fp")
    dealt = dealt.repartition("anchor", "a", "b").sortWithinPartitions("anchor", "a", "b", F.desc("home"))
    return dealt.mapInArrow(_compare(distance), "u long, v long")


def simhash_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """``doc_id, fingerprint, component_id, text_key``: one row per input row.

    Texts link when their fingerprints differ in at most ``distance`` bits; the
    component is named by the least doc_id reachable, a NULL id being the least of
    all.  NULL and empty texts and texts without words have fingerprint zero and
    link like any other.  Rows with equal fingerprints share a component without
    being compared, so repeated rows and ties cost nothing.  Other columns are not
    read; an empty table gives an empty result.
    """
    prints = stored(fingerprints(docs, doc_id, text, size), "fingerprints")
    nodes = prints.groupBy("_fp").agg(F.min("_id").alias("_least"))
    found = components(simhash_links(nodes, distance), "u", "v").select(F.col("node").alias("_fp"), "root")
    rooted = nodes.join(found, "_fp", "left").withColumn("root", F.coalesce("root", "_fp"))
    names = rooted.groupBy("root").agg(F.min("_least").alias("_component"))
    named = rooted.join(names, "root").select("_fp", "_component")
    return prints.join(named, "_fp").select(
        given_id().alias("doc_id"),
        F.lower(F.lpad(F.hex("_fp"), 16, "0")).alias("fingerprint"),
        given_id("_component").alias("component_id"),
        F.col("_key").alias("text_key"),
    )
