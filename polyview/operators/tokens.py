"""Vocabularies, token ids and the fitted token views.

Token tables grow with the data and a few tokens hold most of the occurrences.
So occurrences are gathered per text before anything is shuffled: a join carries
one row per text and distinct token, with the token's positions.  The engine
chooses the join by measured size and splits hot tokens (adaptive skew join).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.feature import HashingTF, IDF, IDFModel
from pyspark.sql import Column, DataFrame, functions as F, types as T

from polyview.operators.ranks import global_rank
from polyview.session import small_batches, stored

# Ids below the vocabulary.
PAD_ID, UNKNOWN_ID, FIRST_ID = 0, 1, 2

SLICE_WORDS = 1 << 18  # words that a worker turns into arrays at once


def word_slices(batches: Iterator[pa.RecordBatch], words: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Record batches cut so that each holds at most ``limit`` words, or one row."""
    for batch in batches:
        offsets = batch.column(words).offsets.to_numpy().astype(np.int64)
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
            yield batch.slice(at, to - at)
            at = to


def gathered(key: str, words: str, limit: int = SLICE_WORDS):
    """Task function of ``distinct_tokens``: what it holds follows ``limit``, not the batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in word_slices(batches, words, limit):
            lists = batch.column(words)
            sizes = np.diff(lists.offsets.to_numpy())
            flat = lists.flatten().dictionary_encode()
            row = np.repeat(np.arange(len(lists)), sizes)
            position = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            code = flat.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            order = np.argsort(row * (len(flat.dictionary) + 1) + code, kind="stable")
            row, code = row[order], code[order]
            new = np.ones(len(row), bool)
            new[1:] = (row[1:] != row[:-1]) | (code[1:] != code[:-1])
            starts = np.flatnonzero(new)
            ends = np.append(starts, len(row)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(key).take(pa.array(row[starts])), flat.dictionary.take(pa.array(code[starts])),
                 pa.ListArray.from_arrays(pa.array(ends), pa.array(position[order].astype(np.int32)))],
                [key, "token", "positions"],
            )

    return run


def distinct_tokens(df: DataFrame, key: str, words: str) -> DataFrame:
    """``key, token, positions``: one row per text and distinct word, row-local."""
    small_batches(df.sparkSession)
    schema = T.StructType([df.schema[key], T.StructField("token", T.StringType()), T.StructField("positions", T.ArrayType(T.IntegerType()))])
    return df.select(key, words).mapInArrow(gathered(key, words), schema)


def token_counts(df: DataFrame, words: str) -> DataFrame:
    """Occurrences of every token, counted before the shuffle."""
    return df.select(F.explode(words).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))


def vocabulary(counts: DataFrame) -> DataFrame:
    """Adds ``token_id``: rank by falling count, then by hash of the token.

    Buckets follow the count on a fine log scale.  Up to a count of 64 each
    bucket holds one count, and a hash prefix cuts it further, since most tokens
    are rare.
    """
    steps = F.floor(F.log2(F.col("n").cast("double")) * 64)
    rare = F.when(F.col("n") <= 64, F.substring("__hash", 1, 3)).otherwise("")
    bucket = F.concat(F.lpad((F.lit(9999) - steps).cast("string"), 4, "0"), rare)
    order = [F.col("n").desc(), F.col("__hash"), F.col("token")]
    ranked = global_rank(counts.withColumn("__hash", F.md5("token")), bucket, order, "token_id")
    return ranked.withColumn("token_id", F.col("token_id") + FIRST_ID).drop("__hash")


def repeated_keys(df: DataFrame, key: str) -> DataFrame:
    """``__again``: keys of more than one row, stored, so that the engine sees that they are few before it joins."""
    return stored(df.groupBy(F.col(key).alias("__again")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("__again"), "repeated")


def coded(key: str, words: str, limit: int = SLICE_WORDS):
    """Task function: texts as codes into the distinct words of their slice, and a row per such word."""
    names = ["slice", key, "codes", "code", "token"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 33
        for at, batch in enumerate(word_slices(batches, words, limit), first):
            lists = batch.column(words)
            flat = lists.flatten().dictionary_encode()
            offsets = lists.offsets.to_numpy()
            codes = pa.ListArray.from_arrays(pa.array(offsets - offsets[0], pa.int32()), flat.indices.cast(pa.int32()))
            n, m = len(lists), len(flat.dictionary)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, at)), batch.column(key), codes, pa.nulls(n, pa.int32()), pa.nulls(n, pa.string())], names
            )
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(m, at)), pa.nulls(m, batch.column(key).type), pa.nulls(m, codes.type),
                 pa.array(np.arange(m, dtype=np.int32)), flat.dictionary], names
            )

    return run


def _sliced_ids(df: DataFrame, key: str, words: str, known: DataFrame) -> DataFrame:
    """``key, input_ids`` row by row: the words of a slice of texts meet the vocabulary once, then their ids meet the slice."""
    small_batches(df.sparkSession)
    kind = T.StructType([
        T.StructField("slice", T.LongType()), df.schema[key], T.StructField("codes", T.ArrayType(T.IntegerType())),
        T.StructField("code", T.IntegerType()), T.StructField("token", T.StringType()),
    ])
    kind[key].nullable = True
    rows = stored(df.select(key, words).mapInArrow(coded(key, words), kind), "coded")
    texts = rows.where("codes IS NOT NULL").select("slice", key, "codes")
    found = rows.where("token IS NOT NULL").select("slice", "code", "token").join(known, "token", "left")
    found = found.select(F.col("slice").alias("of"), "code", F.coalesce("token_id", F.lit(UNKNOWN_ID).cast("bigint")).alias("id"))

    def place(left: pa.Table, right: pa.Table) -> pa.Table:
        ids = np.empty(right.num_rows, np.int64)
        ids[right.column("code").to_numpy()] = right.column("id").to_numpy()
        lists = left.column("codes").combine_chunks()
        offsets = lists.offsets.to_numpy()
        out = pa.ListArray.from_arrays(pa.array(offsets - offsets[0], pa.int32()), pa.array(ids[lists.flatten().to_numpy()]))
        return pa.table({key: left.column(key), "input_ids": out})

    schema = T.StructType([kind[key], T.StructField("input_ids", T.ArrayType(T.LongType()))])
    return texts.groupBy("slice").cogroup(found.groupBy("of")).applyInArrow(place, schema)


def encode(df: DataFrame, key: str, words: str, vocab: DataFrame) -> DataFrame:
    """``key, input_ids`` in word order; unknown words get one id, an empty or NULL text an empty list.

    Texts are encoded by slices.  Rows that share a key are one text: their words
    are gathered with their positions and put in order at the end.
    """
    known = vocab.select("token", "token_id")
    again = repeated_keys(df, key)
    full = df.where(F.coalesce(F.size(words), F.lit(0)) > 0)
    same = full[key].eqNullSafe(again["__again"])
    once = _sliced_ids(full.join(again, same, "left_anti"), key, words, known)
    joined = distinct_tokens(full.join(again, same, "left_semi"), key, words).join(known, "token", "left")
    found = F.struct("positions", F.coalesce("token_id", F.lit(UNKNOWN_ID).cast("bigint")).alias("token_id"))
    lists = joined.groupBy(key).agg(F.collect_list(found).alias("found"))
    placed = F.flatten(F.transform("found", lambda e: F.transform(e["positions"], lambda p: F.struct(p.alias("pos"), e["token_id"].alias("id")))))
    merged = lists.select(key, F.transform(F.array_sort(placed), lambda x: x["id"]).alias("input_ids"))
    empty = df.where(F.coalesce(F.size(words), F.lit(0)) <= 0).select(key, F.array().cast("array<bigint>").alias("input_ids"))
    return merged.unionByName(once).unionByName(empty)


def log_odds(train: DataFrame, words: str, label: str, n_classes: int) -> DataFrame:
    """Per token and class: smoothed log share in the class less that outside it.

    Output: ``token, n, w`` with ``w`` one weight per class.
    """
    pairs = train.select(F.col(label).alias("__label"), F.explode(words).alias("token"))
    by_class = [F.count(F.when(F.col("__label") == c, 1)).alias(f"n_{c}") for c in range(n_classes)]
    counts = pairs.groupBy("token").agg(F.count(F.lit(1)).alias("n"), *by_class)
    totals = counts.agg(
        F.struct(
            F.count(F.lit(1)).alias("size"),
            F.sum("n").alias("n"),
            *[F.sum(f"n_{c}").alias(f"n_{c}") for c in range(n_classes)],
        ).alias("t")
    )
    sized = counts.withColumn("__t", totals.scalar())

    def weight(c: int):
        inside, outside = F.col(f"n_{c}"), F.col("n") - F.col(f"n_{c}")
        all_in, all_out = F.col(f"__t.n_{c}"), F.col("__t.n") - F.col(f"__t.n_{c}")
        size = F.col("__t.size")
        return F.log((inside + 1.0) / (all_in + size)) - F.log((outside + 1.0) / (all_out + size))

    return sized.select("token", "n", F.array(*[weight(c) for c in range(n_classes)]).alias("w"))


def mean_log_odds(df: DataFrame, key: str, words: str, table: DataFrame, n_classes: int) -> DataFrame:
    """``key, s_0 ..``: class weights of a text's words, averaged over all of them.

    Words without a weight count as 0, and so does an empty or NULL text.
    """
    names = [f"s_{c}" for c in range(n_classes)]
    joined = distinct_tokens(df, key, words).join(table.select("token", "w"), "token", "left")
    n = F.size("positions")
    means = joined.groupBy(key).agg(
        *[(F.sum(F.coalesce(F.get("w", F.lit(c)), F.lit(0.0)) * n) / F.sum(n)).alias(name) for c, name in enumerate(names)]
    )
    empty = df.where(F.coalesce(F.size(words), F.lit(0)) <= 0).select(key, *[F.lit(0.0).alias(name) for name in names])
    return means.unionByName(empty)


def bucket_of(token: Column, width: int) -> Column:
    """Bucket of a token by the first eight digits of its MD5, which any engine can compute."""
    return F.conv(F.substring(F.md5(token), 1, 8), 16, 10).cast("bigint") % width


def hashed_counts(key: str, words: str, width: int, limit: int = SLICE_WORDS):
    """Task function: the buckets of each text with words, and how many of its words fall into each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in word_slices(batches, words, limit):
            lists = batch.column(words)
            flat = lists.flatten().dictionary_encode()
            digests = (hashlib.md5(w).digest() for w in flat.dictionary.cast(pa.binary()).to_pylist())
            bucket = np.fromiter((int.from_bytes(d[:4], "big") % width for d in digests), np.int64, len(flat.dictionary))
            row = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
            cells, tf = np.unique(row * width + bucket[flat.indices.to_numpy()], return_counts=True)
            texts, starts = np.unique(cells // width, return_index=True)
            pairs = pa.StructArray.from_arrays([pa.array(cells % width), pa.array(tf.astype(np.int64))], ["pos", "tf"])
            ends = np.append(starts, len(cells)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(key).take(pa.array(texts)), pa.ListArray.from_arrays(pa.array(ends), pairs)], [key, "found"]
            )

    return run


def sparse_tf_idf(df: DataFrame, key: str, words: str, width: int) -> DataFrame:
    """``key, pos, v``: hashed TF-IDF with smoothed document frequencies, only the buckets a text has.

    Counts never leave their row, except those of rows that share a key, which are
    one text.  The ``width`` document frequencies at most are sent to every task.
    """
    small_batches(df.sparkSession)
    kind = T.StructType([df.schema[key], T.StructField("found", T.ArrayType(
        T.StructType([T.StructField("pos", T.LongType()), T.StructField("tf", T.LongType())])
    ))])
    counted = stored(df.select(key, words).mapInArrow(hashed_counts(key, words, width), kind), "buckets")
    again = repeated_keys(counted, key)
    same = counted[key].eqNullSafe(again["__again"])
    once = counted.join(again, same, "left_anti").select(key, F.inline("found"))
    shared = counted.join(again, same, "left_semi").select(key, F.inline("found"))
    tf = once.unionByName(shared.groupBy(key, "pos").agg(F.sum("tf").alias("tf")))
    frequencies = tf.groupBy("pos").agg(F.count(F.lit(1)).alias("df"))
    total = df.agg(F.count(F.lit(1))).scalar()
    joined = tf.join(F.broadcast(frequencies), "pos").withColumn("total", total)
    return joined.select(key, "pos", (F.col("tf") * F.ln((F.col("total") + 1) / (F.col("df") + 1))).alias("v"))


def fit_idf(df: DataFrame, words: str, width: int) -> IDFModel:
    """Document frequencies of hashed terms: ``width`` numbers, whatever the vocabulary."""
    hashed = HashingTF(numFeatures=width, inputCol=words, outputCol="__tf").transform(df)
    return IDF(inputCol="__tf", outputCol="__tfidf").fit(hashed)


def tf_idf(df: DataFrame, words: str, model: IDFModel, width: int, name: str) -> DataFrame:
    """Adds the hashed TF-IDF vector of a text, sparse; row-local."""
    hashed = HashingTF(numFeatures=width, inputCol=words, outputCol="__tf").transform(df)
    return model.transform(hashed).withColumnRenamed("__tfidf", name).drop("__tf")
