"""Queries that run the row-local operators over a file stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from polyview.functions import vectors as V
from polyview.operators import experts, labels, metrics, routing
from polyview.plans.base import q6, query, r6
from polyview.plans.routing import (
    BASE_SQL, ENTROPY_SQL, K, LABELS, METRICS_SQL, N_CLASSES, ROUTED_SQL, fitted, fused_sql, rounded, scores_sql, split_rows,
)
from polyview.session import scratch_path, table_path
from polyview.streaming.scoring import drain, read_stream, score_stream
from polyview.streaming.totals import latest_totals, total_stream


FILES_PER_TRIGGER = 64  # a backlog is worked off in batches of this size, each of them committed


def run(spark, sf_dir, name, score):
    """One ``availableNow`` pass over a table, and what it stored."""
    schema = spark.read.parquet(table_path(sf_dir, name)).schema
    source = read_stream(spark, table_path(sf_dir, f"{{{name}}}"), schema, FILES_PER_TRIGGER)  # a glob: one file or many
    out = scratch_path(spark, "stream")
    drain(score_stream(source, score, f"{out}/rows", f"{out}/progress"))
    return spark.read.parquet(f"{out}/rows")


@query(
    "stream_score",
    f"""SELECT event_id, {q6('s')} AS score,
       CASE WHEN s < -0.1 THEN 'negative' WHEN s < 0.1 THEN 'neutral' ELSE 'positive' END AS label
    FROM (SELECT event_id, (value - 50) / 50 AS s FROM events)""",
)
def stream_score(spark, sf_dir):
    score = (F.col("value") - 50) / 50

    def binned(df):
        return df.select("event_id", r6(score).alias("score"), labels.bin_score(score).alias("label"))

    return run(spark, sf_dir, "events", binned)


@query("stream_routed", ROUTED_SQL)
def stream_routed(spark, sf_dir):
    """The routed prediction on a stream, with experts fitted on the batch table."""
    model = fitted(split_rows(spark, sf_dir))

    def predicted(df):
        decided = experts.with_decisions(df, model, "embedding")
        fused = decided.withColumn("fused", routing.fuse(routing.entropy_gate(F.col("decisions"), K), N_CLASSES))
        return fused.select(
            "vec_id", F.col("label").alias("y"), V.argmax(F.col("fused")).alias("pred"), r6(F.array_max("fused")).alias("score")
        )

    return run(spark, sf_dir, "embeddings", predicted)


@query(
    "stream_metrics",
    f"""WITH {BASE_SQL}, {ENTROPY_SQL}, {fused_sql('g_entropy')}, keyed AS (SELECT 0 AS k, y, pred FROM fused_pred
    ), {scores_sql('keyed', 'k')}
    SELECT (SELECT count(*) FROM keyed) AS n, {METRICS_SQL}, {q6('(SELECT avg(-f) FROM fused WHERE class = y)')} AS loss FROM metric""",
)
def stream_metrics(spark, sf_dir):
    """Metrics of the scoring loop from running totals: rows arrive in two parts of two files, the stream is started again
    for the second, and every file is a micro-batch."""
    rows = split_rows(spark, sf_dir)
    model = fitted(rows)
    out = scratch_path(spark, "totals")
    for part in ("train", "test"):
        rows.where(F.col("split") == part).drop("split").repartition(2).write.mode("append").parquet(f"{out}/arrivals")
        source = read_stream(spark, f"{out}/arrivals", rows.drop("split").schema, 1)
        decided = experts.with_decisions(source, model, "embedding")
        fused = decided.withColumn("fused", routing.fuse(routing.entropy_gate(F.col("decisions"), K), N_CLASSES))
        scored = fused.select("y", V.argmax(F.col("fused")).alias("pred"), V.nll(F.col("fused"), F.col("y")).alias("nll"))
        drain(total_stream(scored, ["y", "pred"], {"nll": F.col("nll")}, f"{out}/totals", f"{out}/progress"))
    totals = latest_totals(spark, f"{out}/totals")
    scores = rounded(metrics.scores(totals, "y", "pred", LABELS, weight="n"))
    whole = totals.agg(F.struct(F.sum("n").alias("n"), r6(F.sum("nll") / F.sum("n")).alias("loss")).alias("t"))
    return scores.withColumn("t", whole.scalar()).select("t.n", *scores.columns, "t.loss")
