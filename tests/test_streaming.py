import pytest
from pyspark.sql import functions as F

from polyview.functions import vectors as V
from polyview.operators import routing
from polyview.streaming import totals
from polyview.streaming.scoring import drain, read_stream, score_stream
from tests.helpers import decisions_frame


def test_stream_equals_batch_over_many_files(spark, tmp_path):
    many = [[[float((i * e * 7 + c * 3) % 5) for c in range(3)] for e in range(4)] for i in range(40)]
    src = str(tmp_path / "in")
    decisions_frame(spark, many).repartition(6).write.parquet(src)

    def score(df):
        fused = routing.fuse(routing.entropy_gate(F.col("decisions"), 2), 3)
        return df.select("id", V.argmax(fused).alias("pred"))

    batch = spark.read.parquet(src)
    out, progress = str(tmp_path / "out"), str(tmp_path / "progress")
    drain(score_stream(read_stream(spark, src, batch.schema, files_per_trigger=2), score, out, progress))
    want = sorted(map(tuple, score(batch).collect()))
    assert sorted(map(tuple, spark.read.parquet(out).collect())) == want

    # A restart on the same progress folder adds only what is new.
    decisions_frame(spark, many[:3]).withColumn("id", F.col("id") + 100).write.mode("append").parquet(src)
    drain(score_stream(read_stream(spark, src, batch.schema), score, out, progress))
    assert spark.read.parquet(out).count() == 43


def test_stream_errors_surface(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.range(3).write.parquet(src)
    bad = lambda df: df.select(F.raise_error(F.lit("boom")).cast("int").alias("x"))
    with pytest.raises(Exception, match="boom"):
        drain(score_stream(read_stream(spark, src, spark.read.parquet(src).schema), bad, str(tmp_path / "o"), str(tmp_path / "p")))


def test_totals_survive_a_restart_and_a_repeated_batch(spark, tmp_path):
    src, out, progress = (str(tmp_path / n) for n in ("in", "out", "progress"))
    rows = [(i % 3, None if i % 7 == 0 else (i * i) % 3, float(i)) for i in range(60)]
    schema = "y int, pred int, nll double"
    df = spark.createDataFrame(rows, schema)
    keys = ["y", "pred"]

    def pass_over(part):
        part.repartition(2).write.mode("append").parquet(src)
        source = read_stream(spark, src, df.schema, files_per_trigger=1)
        drain(totals.total_stream(source, keys, {"nll": F.col("nll")}, out, progress))

    def found():
        return sorted(map(str, totals.latest_totals(spark, out).collect()))

    pass_over(df.where("nll < 25"))
    half = totals.versions(spark, out)
    pass_over(df.where("nll >= 25"))
    known = totals.versions(spark, out)
    assert len(half) == 2 and len(known) == 4
    want = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum("nll").alias("nll"))
    assert found() == sorted(map(str, want.collect()))

    # The last batch again, as after a failure: same version, same totals.
    changed = want.exceptAll(totals.read_version(spark, out, known[-2]))
    assert 0 < changed.count() < want.count()
    totals.publish_totals(changed, known[-1], out, keys)
    assert totals.versions(spark, out) == known and found() == sorted(map(str, want.collect()))


def test_totals_without_a_batch_are_an_error(spark, tmp_path):
    with pytest.raises(ValueError, match="no totals"):
        totals.latest_totals(spark, str(tmp_path))
