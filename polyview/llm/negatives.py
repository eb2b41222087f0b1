"""Hard negatives by full exact scores, looked up in tables of subset sums (the method of the Four Russians).

**Tables.** Eight components of an anchor form a group.  For every byte the table of
the group holds the sum of the components whose bits are set: 256 sums, each made
of a smaller one and one component.

**Bit planes.** A candidate's components are integers; less the least of their block
they need few bits.  Plane b holds bit b of every component, packed into one byte
per group.  The inner product is then ``sum over b of 2**b * sum over groups of
table[byte]``, plus the least times the sum of the anchor: additions and shifts of
looked-up sums, no products.  Tables of many anchors lie side by side, so one byte
looks up a row of sums at once.

**Blocks.** Rows are packed into blocks of candidates, and anchors into blocks of
their own; every block of candidates meets every block of anchors.  A meeting
returns a few rows per anchor, whatever the size of the block.  A first pass scores
rows of the anchor's label and finds the positives, a second one all others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from polyview.session import stored

SCALE = 256
GROUP = 8
BLOCK = 4096  # candidates
ANCHORS = 512  # anchors of a block
TOGETHER = 128  # anchors whose tables lie side by side
ROWS = 256  # candidates scored at once
POSITIVES = 5
NEGATIVES = 5
PERCENT = 80
LARGEST = 1 << 23  # of a component times the scale

BLOCKS = "n int, least long, bits int, width int, ids binary, labels binary, planes binary"
ANCHOR_BLOCKS = "meet int, chunk long, width int, ids binary, labels binary, vectors binary"


def whole_numbers(column: pa.ListArray, scale: int) -> np.ndarray:
    """``floor(scale * x)`` of every component, a row per vector; missing components at the end are zero."""
    counts = np.diff(column.offsets.to_numpy())
    width = -(-max(int(counts.max(initial=0)), 1) // GROUP) * GROUP
    out = np.zeros((len(counts), width), np.int64)
    values = np.floor(column.flatten().cast(pa.float64()).to_numpy() * scale)
    if len(values) and np.abs(values).max() > LARGEST:
        raise ValueError(f"a component times {scale} lies beyond {LARGEST}")
    out[np.arange(width) < counts[:, None]] = values
    return out


def bit_planes(values: np.ndarray) -> tuple[int, int, np.ndarray]:
    """The least value, the bits that the others need above it, and ``planes[bit, group, row]``."""
    least = int(values.min())
    rest = values - least
    bits = int(rest.max()).bit_length()
    planes = [np.packbits((rest >> b & 1).astype(np.uint8), axis=1, bitorder="little").T for b in range(bits)]
    return least, bits, np.array(planes, np.uint8).reshape(bits, values.shape[1] // GROUP, len(values))


def subset_sums(anchors: np.ndarray) -> np.ndarray:
    """``tables[group, byte, anchor]``: the sum of the anchor's components whose bits are set in the byte."""
    n, width = anchors.shape
    parts = anchors.reshape(n, width // GROUP, GROUP).transpose(1, 2, 0)
    out = np.zeros((width // GROUP, 1 << GROUP, n), anchors.dtype)
    for bit in range(GROUP):
        out[:, 1 << bit:2 << bit] = out[:, :1 << bit] + parts[:, bit, None]
    return out


def scores(tables: np.ndarray, sums: np.ndarray, least: int, planes: np.ndarray) -> np.ndarray:
    """Inner products, ``[row, anchor]``, from the highest plane down."""
    bits, groups, n = planes.shape
    out = np.empty((n, tables.shape[2]), np.int64)
    for at in range(0, n, ROWS):
        to = min(n, at + ROWS)
        total = np.zeros((to - at, tables.shape[2]), tables.dtype)
        found = np.empty_like(total)
        for b in range(bits - 1, -1, -1):
            total <<= 1
            for g in range(groups):
                np.take(tables[g], planes[b, g, at:to], axis=0, out=found, mode="clip")
                total += found
        out[at:to] = total
    return out + least * sums


def _candidate_blocks(scale: int, block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, block):
                part = batch.slice(at, block)
                ids, labels = (part.column(c).to_numpy() for c in ("_id", "_label"))
                order = np.lexsort((ids, labels))
                values = whole_numbers(part.column("_vector"), scale)[order]
                least, bits, planes = bit_planes(values)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([len(order)], pa.int32()), pa.array([least], pa.int64()), pa.array([bits], pa.int32()),
                     pa.array([values.shape[1]], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in (ids[order], labels[order], planes))],
                    ["n", "least", "bits", "width", "ids", "labels", "planes"],
                )

    return run


def _anchor_blocks(scale: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 32
        for batch in batches:
            meet = batch.column("_meet").to_numpy()
            edges = np.flatnonzero(np.diff(meet, prepend=-1, append=-1))
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
                for at in range(a, b, ANCHORS):
                    part = batch.slice(at, min(b, at + ANCHORS) - at)
                    values = whole_numbers(part.column("_vector"), scale)
                    data = [part.column("_id").to_numpy(), part.column("_label").to_numpy(), values]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([meet[a]], pa.int32()), pa.array([chunk], pa.int64()), pa.array([values.shape[1]], pa.int32()),
                         *(pa.array([x.tobytes()], pa.binary()) for x in data)],
                        ["meet", "chunk", "width", "ids", "labels", "vectors"],
                    )
                    chunk += 1

    return run


def _wide(planes: np.ndarray, vectors: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Planes and anchors of one width: what a side lacks is zero, so its products are."""
    groups = max(planes.shape[1], vectors.shape[1] // GROUP)
    if planes.shape[1] < groups:  # a zero is ``-least`` above the least: the anchor's components there must not count
        vectors = vectors[:, :planes.shape[1] * GROUP]
    elif vectors.shape[1] < groups * GROUP:
        vectors = np.pad(vectors, ((0, 0), (0, groups * GROUP - vectors.shape[1])))
    return planes, vectors


def _meetings(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Of every meeting: its row, the candidates' ids, labels and planes, the anchors' ids and labels, and how to score some anchors."""
    for batch in batches:
        for row in batch.to_pylist():
            ids, labels, own_ids, own_labels = (np.frombuffer(row[c], np.int64) for c in ("ids", "labels", "anchor_ids", "anchor_labels"))
            planes = np.frombuffer(row["planes"], np.uint8).reshape(row["bits"], row["width"] // GROUP, row["n"])
            vectors = np.frombuffer(row["vectors"], np.int64).reshape(len(own_ids), -1)
            planes, vectors = _wide(planes, vectors, row["least"])
            size = int(np.abs(vectors).sum(axis=1).max(initial=0)) << row["bits"]
            kind = np.int32 if size < 1 << 30 else np.int64

            def score(of: np.ndarray, lo: int = 0, hi: int | None = None, p=planes, v=vectors, k=kind, least=row["least"]) -> np.ndarray:
                some = v[of]
                return scores(subset_sums(some.astype(k)), some.sum(axis=1), least, p[:, :, lo:hi])

            yield row, ids, labels, own_ids, own_labels, score


def best(score: np.ndarray, ids: np.ndarray, group: np.ndarray, n: int) -> np.ndarray:
    """Indices of the first ``n`` of each group: higher scores first, ties by smaller id."""
    order = np.lexsort((ids, -score, group))
    group = group[order]
    place = np.arange(len(order)) - np.searchsorted(group, group)
    return order[place < n]


def _positives(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, ids, labels, own_ids, own_labels, score in _meetings(batches):
            found = []
            for label in np.intersect1d(labels, own_labels):
                anchors = np.flatnonzero(own_labels == label)
                lo, hi = np.searchsorted(labels, label), np.searchsorted(labels, label, "right")  # rows lie in order of labels
                for at in range(0, len(anchors), TOGETHER):
                    of = anchors[at:at + TOGETHER]
                    value = score(of, lo, hi)
                    other = ids[lo:hi, None] != own_ids[of]
                    least = np.where(other, value, np.iinfo(np.int64).min)
                    kth = np.partition(least, max(0, hi - lo - n), axis=0)[max(0, hi - lo - n)]
                    r, a = np.nonzero(other & (value >= kth))
                    pick = best(value[r, a], ids[lo + r], a, n)
                    found.append((of[a[pick]], ids[lo + r[pick]], value[r[pick], a[pick]]))
            if found:
                a, i, s = (np.concatenate(x) for x in zip(*found))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(a), row["chunk"])), pa.array(a.astype(np.int32)), pa.array(own_ids[a]), pa.array(i), pa.array(s)],
                    ["chunk", "place", "anchor_id", "positive_id", "positive_score"],
                )

    return run


def _negatives(n: int, percent: int):
    names = ["chunk", "place", "positive", "anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, ids, labels, own_ids, own_labels, score in _meetings(batches):
            wanted = np.array([(p["place"], p["positive"], p["positive_id"], p["positive_score"]) for p in row["positives"]], np.int64)
            wanted = wanted[wanted[:, 3] >= 0]  # no score lies between a share of a negative one and itself
            for at in range(0, len(own_ids), TOGETHER):
                mine = wanted[(wanted[:, 0] >= at) & (wanted[:, 0] < at + TOGETHER)]
                if not len(mine):
                    continue
                of, where = np.unique(mine[:, 0], return_inverse=True)
                high, low = np.full(len(of), -1), np.full(len(of), np.iinfo(np.int64).max)
                np.maximum.at(high, where, mine[:, 3])
                np.minimum.at(low, where, -(-percent * mine[:, 3] // 100))
                value = score(of)
                r, a = np.nonzero((value <= high) & (value >= low) & (labels[:, None] != own_labels[of]))
                s = value[r, a]
                order = np.argsort(a, kind="stable")
                r, a, s = r[order], a[order], s[order]
                begin = np.searchsorted(a, np.arange(len(of) + 1))
                counts = np.diff(begin)[where]
                # every pair of anchor and positive with the anchor's rows
                pair = np.repeat(np.arange(len(mine)), counts)
                entry = np.repeat(begin[where], counts) + np.arange(len(pair)) - np.repeat(np.cumsum(counts) - counts, counts)
                fits = (100 * s[entry] >= percent * mine[pair, 3]) & (s[entry] <= mine[pair, 3])
                pair, entry = pair[fits], entry[fits]
                pick = best(s[entry], ids[r[entry]], pair, n)
                pair, entry = pair[pick], entry[pick]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(pair), row["chunk"])), pa.array(mine[pair, 0].astype(np.int32)), pa.array(mine[pair, 1].astype(np.int32)),
                     pa.array(own_ids[mine[pair, 0]]), *(pa.array(x) for x in (mine[pair, 2], mine[pair, 3], ids[r[entry]], s[entry]))], names
                )

    return run


def _first(rows: DataFrame, of: list[str], score: str, name: str, n: int, rank: str) -> DataFrame:
    order = Window.partitionBy(*of).orderBy(F.desc(score), name)
    return rows.withColumn(rank, F.row_number().over(order)).where(F.col(rank) <= n)


def hard_negatives(vectors: DataFrame, is_anchor: Column, vec_id: str = "vec_id", vector: str = "embedding", label: str | Column = "label",
                   scale: int = SCALE, positives: int = POSITIVES, negatives: int = NEGATIVES, percent: int = PERCENT,
                   block: int = BLOCK) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    Components count as ``floor(scale * x)``, scores are their inner products;
    higher scores come first, ties by smaller id.  Positives of an anchor are its
    first rows of the same label and another id; negatives of a positive are the
    first rows of other labels that score at least ``percent`` hundredths of it and
    no more than it.  Rows without id, label or vector, or with a component that is
    NULL or not finite, take no part; neither do empty vectors score but zero.
    Shorter vectors end in zeros.  Rows that repeat an id take part each, as anchors
    too.  An anchor without positives, and a positive without negatives, have no
    rows.  Other columns are not read; an empty table gives an empty result.  A
    component beyond ``LARGEST`` is an error.
    """
    given = F.col(f"`{vector}`")
    named = F.col(f"`{label}`") if isinstance(label, str) else label
    sound = F.forall(given, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = vectors.select(
        F.col(f"`{vec_id}`").cast("long").alias("_id"), named.cast("long").alias("_label"), given.alias("_vector"),
        F.coalesce(is_anchor, F.lit(False)).alias("_anchor"),
    ).where(F.col("_id").isNotNull() & F.col("_label").isNotNull() & F.coalesce(sound, F.lit(False)))
    rows = stored(rows, "vectors")
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if("_anchor").alias("anchors")).first()
    meets = max(1, -(-size["anchors"] // ANCHORS))
    # dealt evenly, whatever the rows hold; a part has a few blocks
    dealt = rows.select("_id", "_label", "_vector").repartition(max(1, -(-size["n"] // (4 * block))))
    blocks = stored(dealt.mapInArrow(_candidate_blocks(scale, block), BLOCKS), "blocks")
    meet = F.pmod(F.xxhash64("_id", "_vector"), F.lit(meets)).cast("int")
    anchors = rows.where("_anchor").withColumn("_meet", meet).repartition("_meet").sortWithinPartitions("_meet")
    anchors = stored(anchors.select("_meet", "_id", "_label", "_vector").mapInArrow(_anchor_blocks(scale), ANCHOR_BLOCKS), "anchors")
    anchors = anchors.withColumnsRenamed({"ids": "anchor_ids", "labels": "anchor_labels"}).drop("width")
    sent = blocks.withColumn("meet", F.explode(F.sequence(F.lit(0), F.lit(meets - 1))))

    near = sent.join(anchors, "meet").mapInArrow(
        _positives(positives), "chunk long, place int, anchor_id long, positive_id long, positive_score long"
    )
    first = _first(near, ["chunk", "place"], "positive_score", "positive_id", positives, "positive")
    listed = first.groupBy("chunk").agg(F.collect_list(F.struct("place", "positive", "positive_id", "positive_score")).alias("positives"))
    armed = stored(anchors.join(listed, "chunk"), "armed")  # at most ANCHORS * positives entries a row
    hard = sent.join(armed, "meet").mapInArrow(
        _negatives(negatives, percent),
        "chunk long, place int, positive int, anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long",
    )
    ranked = _first(hard, ["chunk", "place", "positive"], "negative_score", "negative_id", negatives, "rank")
    return ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
