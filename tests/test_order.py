import hashlib
import math

import pytest
from pyspark.sql import functions as F

from polyview.operators import batches, ranks
from polyview.functions import text as X
from tests.helpers import plan


def seeded(keys, seed):
    return sorted(keys, key=lambda k: (hashlib.md5(f"{seed}:{k}".encode()).hexdigest(), k))


@pytest.mark.parametrize("n,size", [(1, 0.2), (10, 0.226), (997, 0.2), (50, 0.0), (50, 1.0)])
def test_exact_split_size_and_rows(spark, n, size):
    df = spark.range(n).toDF("k")
    got = {r["k"] for r in ranks.split_exact(df, ["k"], size, 42).where("split = 'test'").collect()}
    assert got == set(seeded(range(n), 42)[: math.ceil(n * size)])


def test_exact_split_does_not_shuffle_rows(spark):
    df = spark.range(1000).toDF("k").withColumn("payload", F.lit("x"))
    assert "Exchange" not in plan(ranks.split_exact(df, ["k"], 0.2, 42))


def test_bucket_count_is_bounded(spark):
    with pytest.raises(ValueError, match="digits"):
        ranks.seeded_rank(spark.range(3).toDF("k"), ["k"], 1, digits=9)


def test_empty_split(spark):
    assert ranks.split_exact(spark.range(0).toDF("k"), ["k"], 0.2, 42).count() == 0


def test_ranks_ignore_partitioning(spark):
    want = {k: i for i, k in enumerate(seeded(range(500), 7))}
    for parts in (1, 7):
        df = spark.range(500).toDF("k").repartition(parts)
        assert {r["k"]: r["row_id"] for r in ranks.seeded_rank(df, ["k"], 7).collect()} == want
    shuffled = [r["k"] for r in ranks.seeded_shuffle(spark.range(500).toDF("k"), ["k"], 7).collect()]
    assert shuffled == seeded(range(500), 7)


def test_hash_split_matches_its_threshold(spark):
    df = ranks.split_hash(spark.range(5000).toDF("k"), ["k"], 0.2, 42)
    got = {r["k"] for r in df.where("split = 'test'").collect()}
    assert got == {k for k in range(5000) if hashlib.md5(f"42:{k}".encode()).hexdigest()[:8] < "33333333"}
    assert "Exchange" not in plan(df)


def test_row_ids_of_copies(spark):
    """One row holds most of the table; ids stay whole and unique."""
    df = spark.range(1000).select(F.when(F.col("id") < 700, "hot").otherwise(F.concat(F.lit("c"), F.col("id") % 40)).alias("t"))
    df = df.unionByName(spark.createDataFrame([(None,), (None,)], "t string"))
    rows = ranks.number_copies(df, 3, chunk=64).collect()
    assert sorted(r["row_id"] for r in rows) == list(range(1002))
    runs = {}
    for r in rows:
        runs.setdefault(r["t"], []).append(r["row_id"])
    assert all(max(v) - min(v) + 1 == len(v) for v in runs.values())
    assert len(runs["hot"]) == 700 and len(runs[None]) == 2


def test_batches_and_padding(spark):
    texts = ["a b c", "d", "e f", "g h i j", "k"]
    df = spark.createDataFrame(list(enumerate(texts)), "row_id long, text string").withColumn("w", X.tokens(F.col("text")))
    lens = ranks.mini_batches(df.select("row_id", F.size("w").alias("real_len")), 2)
    padded = batches.pad_rows(df.join(batches.batch_lengths(lens), "row_id"), "w", F.lit("_")).orderBy("row_id").collect()
    assert [r["batch_id"] for r in padded] == [0, 0, 1, 1, 2]
    assert [r["w"] for r in padded][1] == ["d", "_", "_"] and padded[2]["w"] == ["e", "f", "_", "_"]
    assert padded[1]["attention_mask"] == [1, 0, 0] and padded[4]["attention_mask"] == [1]
    capped = ranks.step_cap(lens, 2)
    assert sorted(r["row_id"] for r in capped.collect()) == [0, 1, 2, 3]
    assert ranks.step_cap(lens, None).count() == 5
