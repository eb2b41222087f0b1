"""Exact deduplication with a heavy-hitter split.

Every text is reduced to its SHA-256 digest in the JVM.  Each task sums up its
digests in a Misra-Gries summary of a fixed number of counters; merged, the
summaries hold every digest with more than ``1 / (counters + 1)`` of all rows.  These candidates are verified: their rows
are counted exactly, with partial sums before the shuffle.  The verified winners
(at most ``counters`` rows) are broadcast, so that copies of a heavy text are
settled where they are read.  All other digests are rare enough for an ordinary
shuffle, which carries a digest and an id per row.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from polyview.llm.common import given_id, id_text
from polyview.session import stored

COUNTERS = 1024  # bound of the summary, of the verified winners and of the broadcast


def shrink(counts: Counter, counters: int) -> Counter:
    """A Misra-Gries summary of at most ``counters`` entries."""
    if len(counts) <= counters:
        return counts
    cut = sorted(counts.values(), reverse=True)[counters]
    return Counter({k: v - cut for k, v in counts.items() if v > cut})


def _summaries(counters: int, key: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            for item in batch.column(key).value_counts().to_pylist():
                total[item["values"]] += item["counts"]
            total = shrink(total, counters)
        yield pa.RecordBatch.from_pydict({key: pa.array(list(total), pa.string()), "n": pa.array(list(total.values()), pa.int64())})

    return run


def heavy_keys(df: DataFrame, key: str, counters: int = COUNTERS) -> list[str]:
    """Every value of the string column ``key`` that more than ``1 / (counters + 1)`` of the rows hold, and perhaps others.

    Each task returns its summary.  Entries of all summaries are added up per value
    and the largest ``counters`` sums are kept: what the summaries have lost of a
    value is less than the share asked for, so no frequent value is among the rest.
    At most ``counters`` rows per task are shuffled, and as many come to the driver.
    """
    rows = df.select(key).mapInArrow(_summaries(counters, key), f"{key} string, n long").where(F.col(key).isNotNull())
    sums = rows.groupBy(key).agg(F.sum("n").alias("n"))
    return [r[key] for r in sums.orderBy(F.desc("n"), key).limit(counters).collect()]


def exact_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", counters: int = COUNTERS) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256``: one row per input row.

    Texts are equal when they are identical; a NULL text counts as empty.  Of equal
    texts the row with the largest id stays; a NULL id is smaller than any other
    (a group of only NULL ids keeps them all).  Rows that repeat the winning id
    with the same text are the same document and are all kept.  ``group_size``
    counts rows.  Other columns of ``docs`` are not read.  An empty table gives an
    empty result.
    """
    digests = stored(id_text(docs, doc_id, text).select("_id", F.sha2("_text", 256).alias("_digest")), "digests")
    best = [F.max("_id").alias("_keep"), F.count(F.lit(1)).alias("group_size")]
    heavy = heavy_keys(digests, "_digest", counters)
    spark = docs.sparkSession
    listed = F.broadcast(spark.createDataFrame([(k,) for k in heavy], "_digest string"))
    winners = digests.join(listed, "_digest", "left_semi").groupBy("_digest").agg(*best)
    settled = digests.join(F.broadcast(winners), "_digest")
    same = Window.partitionBy("_digest")
    rest = digests.join(listed, "_digest", "left_anti").select(
        "_digest", "_id", F.max("_id").over(same).alias("_keep"), F.count(F.lit(1)).over(same).alias("group_size")
    )
    return settled.select("_digest", "_id", "_keep", "group_size").unionByName(rest).select(
        given_id().alias("doc_id"),
        given_id("_keep").alias("keep_id"),
        "group_size",
        (F.col("_id") == F.col("_keep")).alias("kept"),
        F.col("_digest").alias("text_sha256"),
    )
