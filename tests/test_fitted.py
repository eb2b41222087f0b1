"""Queries without SQL: shape and sense of what the fitted models return."""

import math

from pyspark.sql import functions as F

from polyview.functions import vectors as V
from polyview.operators import experts, routing
from polyview.plans import QUERIES, texts
from polyview.session import stored


def test_learned_experts_and_mixture(spark, sf):
    rows = QUERIES["expert_logreg"](spark, sf).collect()
    truth = {r["doc_id"]: r["y"] for r in rows}
    assert len(rows) == 4 * len(truth) and {r["expert"] for r in rows} == {0, 1, 2, 3}
    assert all(r["pred"] in (0, 1, 2) and math.log(1 / 3) - 1e-6 <= r["lp"] <= 0 for r in rows)

    scores = {r["expert"]: r for r in QUERIES["expert_eval"](spark, sf).collect()}
    for expert, row in scores.items():
        mine = [r for r in rows if r["expert"] == expert]
        assert abs(row["accuracy"] - sum(r["pred"] == r["y"] for r in mine) / len(mine)) < 1e-9

    mixed = QUERIES["mixture_calibrate"](spark, sf).collect()
    assert {r["doc_id"]: r["y"] for r in mixed} == truth
    assert all(r["nll"] >= 0 and r["pred_mixed"] in (0, 1, 2) for r in mixed)


def test_calibration_fits_at_least_as_well_as_the_plain_fusion(spark, sf):
    """The plain fusion is one of the maps the fit may choose, so on its own rows the fit cannot lose to it."""
    gate = routing.entropy_gate(F.col("decisions"), 3)
    rows = stored(texts.learned(spark, sf).where("split = 'train'").withColumn("fused", routing.fuse(gate, 3)))
    model = experts.fit_logistic(rows, "fused", "y", max_iter=100, reg=0.0)
    mixed = experts.logistic_lp(rows, model, "fused", "mixed")
    y, plain = F.col("y"), V.log_softmax(F.col("fused"))
    fitted, fused = mixed.agg(F.avg(V.nll(F.col("mixed"), y)), F.avg(V.nll(plain, y))).first()
    assert fitted <= fused + 1e-3


def test_every_document_is_scored_as_the_test_rows_are(spark, sf):
    docs = {r["doc_id"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id").collect()}
    for name, keys in (("routed_text", 1), ("expert_logreg", 4), ("mixture_calibrate", 1)):
        some, every = QUERIES[name](spark, sf).collect(), QUERIES[f"{name}_all"](spark, sf).collect()
        assert {r["doc_id"] for r in every} == docs and len(every) == keys * len(docs)
        assert {tuple(r) for r in some} < {tuple(r) for r in every}
