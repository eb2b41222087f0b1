import math
import random

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from polyview.functions import vectors as V
from polyview.operators import experts, routing
from tests.helpers import decided, decisions_frame, log_softmax, softmax, value

E, C, K = 5, 3, 3
W_G = [0.5, -0.25, 0.75]


@pytest.fixture(scope="module")
def many():
    rng = random.Random(4)
    return [[[rng.gauss(0, 2) for _ in range(C)] for _ in range(E)] for _ in range(60)]


@pytest.fixture(scope="module")
def frame(spark, many):
    return decisions_frame(spark, many).cache()


def entropy_gate(rows, k=K):
    found = decided(rows)
    order = sorted(range(E), key=lambda e: (found[e][0], e))[:k]
    first = softmax([-h for h, _, _ in found])
    return dict(zip(order, softmax([first[e] for e in order])))


def score_gate(rows, k=K):
    score = [sum(a * b for a, b in zip(lp, W_G)) for _, _, lp in decided(rows)]
    order = sorted(range(E), key=lambda e: (-score[e], e))[:k]
    return dict(zip(order, softmax([score[e] for e in order])))


def gates(frame, column):
    rows = frame.select("id", column.alias("g")).orderBy("id").collect()
    return [{x["expert"]: x["g"] for x in r["g"]} for r in rows]


def close(a, b):
    return a.keys() == b.keys() and all(abs(a[k] - b[k]) < 1e-9 for k in a)


def test_entropy_gate(frame, many):
    got = gates(frame, routing.entropy_gate(F.col("decisions"), K))
    assert all(close(g, entropy_gate(rows)) for g, rows in zip(got, many))
    assert all(abs(sum(g.values()) - 1) < 1e-9 and len(g) == K for g in got)
    assert all(max(g.values()) / min(g.values()) <= math.e for g in got)


def test_score_gate(frame, many):
    got = gates(frame, routing.score_gate(F.col("decisions"), W_G, K))
    assert all(close(g, score_gate(rows)) for g, rows in zip(got, many))


def test_combined_gate_sums_to_two(frame, many):
    got = gates(frame, routing.combined_gate(F.col("decisions"), W_G, K))
    for g, rows in zip(got, many):
        a, b = entropy_gate(rows), score_gate(rows)
        assert close(g, {e: a.get(e, 0) + b.get(e, 0) for e in a.keys() | b.keys()})
        assert abs(sum(g.values()) - 2) < 1e-9 and K <= len(g) <= 2 * K


def test_more_k_than_experts(frame):
    assert all(len(g) == E for g in gates(frame, routing.entropy_gate(F.col("decisions"), 99)))


def test_ties_go_to_the_lower_index(spark):
    tied = decisions_frame(spark, [[[1.0, 0.0, 0.0]] * E])
    assert list(gates(tied, routing.entropy_gate(F.col("decisions"), 2))[0]) == [0, 1]
    assert list(gates(tied, routing.score_gate(F.col("decisions"), W_G, 2))[0]) == [0, 1]
    assert value(spark, V.argmax(F.col("z")), z=[1.0, 3.0, 3.0]) == 1


def test_fusion_and_dense_gate(frame, many):
    gate = routing.entropy_gate(F.col("decisions"), K)
    rows = frame.select("id", routing.fuse(gate, C).alias("f"), routing.dense_gate(gate, E).alias("d")).orderBy("id").collect()
    for r, scores in zip(rows, many):
        g = entropy_gate(scores)
        want = [sum(w * log_softmax(scores[e])[c] for e, w in g.items()) for c in range(C)]
        assert np.allclose(r["f"], want, atol=1e-9)
        assert np.allclose(r["d"], [g.get(e, 0.0) for e in range(E)], atol=1e-9)


def test_single_softmax_variant(frame, many):
    got = gates(frame, routing.entropy_gate(F.col("decisions"), K, double=False))
    for g, rows in zip(got, many):
        first = softmax([-h for h, _, _ in decided(rows)])
        total = sum(first[e] for e in g)
        assert close(g, {e: first[e] / total for e in g})


def test_unknown_mode():
    with pytest.raises(ValueError):
        routing.gate_by_mode("none", F.col("decisions"), W_G, K)


def test_refine_head(spark):
    z, w, b = [0.3, -1.0, 0.4], [[1.0, 0.5, 0.0], [0.0, 1.0, -1.0], [2.0, 0.0, 0.1]], [0.1, 0.2, -0.3]
    mixed = np.array(z) + np.array(w) @ np.array(z) + np.array(b)
    norm = (mixed - mixed.mean()) / np.sqrt(mixed.var() + 1e-5)
    assert np.allclose(value(spark, routing.refine(F.col("z"), w, b), z=z), log_softmax(list(norm)), atol=1e-9)


def test_vector_functions(spark):
    z = [1000.0, 1001.0, 999.0]
    assert np.allclose(value(spark, V.softmax(F.col("z")), z=z), softmax(z))
    lp = value(spark, V.log_softmax(F.col("z")), z=z)
    assert np.allclose(lp, log_softmax(z))
    h = value(spark, V.entropy(F.col("z")), z=[float(x) for x in lp])
    assert 0 <= h <= math.log(3)
    assert value(spark, V.entropy(F.col("z")), z=[0.0, float("-inf")]) == 0
    assert value(spark, V.last_position(F.col("z")), z=z) == 999.0
    assert spark.sql("select array() a").select(V.last_position(F.col("a"))).first()[0] is None
    assert value(spark, V.nll(F.col("z"), F.lit(2)), z=[-1.0, -2.0, -3.0]) == 3.0


def test_centroids_against_numpy(spark):
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=(200, 10)).astype("float32"), rng.integers(0, 3, 200)
    df = spark.createDataFrame([(i, x[i].tolist(), int(y[i])) for i in range(200)], "id int, v array<float>, y int")
    model = experts.fit_centroids(df, "v", "y", [4, 6], 3, 2.0)
    centers = np.array([x[y == c].astype(float).mean(0) for c in range(3)])
    assert np.allclose(model.centers, centers, atol=1e-9)
    flat = np.array([r[0] for r in df.withColumn("z", model.scores(F.col("v"))).orderBy("id").select("z").collect()])
    d = x.astype(float)[:, None, :] - centers[None]
    want = np.stack([-2.0 * (d[:, :, :4] ** 2).sum(2), -2.0 * (d[:, :, 4:] ** 2).sum(2)], 1).reshape(200, 6)
    assert np.allclose(flat, want, atol=1e-8)


def test_long_and_wide_decisions_agree(spark, many):
    long = [(i, e, z) for i, rows in enumerate(many) for e, z in enumerate(rows)]
    df = spark.createDataFrame(long, "id long, expert int, z array<double>").repartition(5)
    got = experts.gather_decisions(df, ["id"]).orderBy("id").collect()
    for r, rows in zip(got, many):
        for d, (h, expert, lp) in zip(r["decisions"], decided(rows), strict=True):
            assert d["expert"] == expert and abs(d["h"] - h) < 1e-9 and np.allclose(d["lp"], lp)


def test_model_guards(spark):
    df = spark.createDataFrame([([1.0, 2.0], 0), ([0.0, 1.0], 1)], "v array<double>, y int")
    with pytest.raises(ValueError, match="no training rows"):
        experts.fit_centroids(df.limit(0), "v", "y", [2], 3, 1.0)
    with pytest.raises(PySparkException, match="label out of range"):
        experts.fit_centroids(df, "v", "y", [2], 1, 1.0)
    with pytest.raises(ValueError, match="widths say"):
        experts.fit_centroids(df, "v", "y", [3], 2, 1.0)
    model = experts.fit_centroids(df, "v", "y", [2], 2, 1.0)
    ragged = spark.createDataFrame([([1.0],)], "v array<double>")
    with pytest.raises(PySparkException, match="must hold 2 numbers"):
        ragged.select(model.scores(F.col("v"))).collect()
    for bad in ([1.0, None], [1.0, float("nan")]):
        with pytest.raises(PySparkException, match="NULL or NaN"):
            spark.createDataFrame([(bad,)], "v array<double>").select(model.scores(F.col("v"))).collect()


def test_a_class_without_rows_is_never_predicted(spark):
    df = spark.createDataFrame([([1.0, 2.0], 0), ([0.0, 1.0], 2)], "v array<double>, y int")
    model = experts.fit_centroids(df, "v", "y", [2], 3, 1.0)
    rows = experts.with_decisions(df, model, "v").select("y", "decisions").collect()
    for r in rows:
        lp = r["decisions"][0]["lp"]
        assert lp[1] == float("-inf") and max(range(3), key=lambda c: lp[c]) == r["y"] and r["decisions"][0]["h"] >= 0


def test_scores_do_not_depend_on_the_slice(spark, monkeypatch):
    rng = np.random.default_rng(3)
    df = spark.createDataFrame([(i, rng.normal(size=4).tolist(), i % 2) for i in range(50)], "id int, v array<double>, y int")
    model = experts.fit_centroids(df, "v", "y", [2, 2], 2, 1.0)
    scored = lambda: df.withColumn("z", model.scores(F.col("v"))).orderBy("id").select("z").collect()
    whole = scored()
    monkeypatch.setattr(experts, "SLICE_CELLS", 13)
    assert scored() == whole


def test_a_label_without_a_class_is_an_error(spark):
    df = spark.createDataFrame([([-1.0, -2.0], 0), ([-1.0, -2.0], 7)], "lp array<double>, y int")
    with pytest.raises(PySparkException, match="label out of range: 7"):
        df.select(V.nll(F.col("lp"), F.col("y"))).collect()


def test_logistic_expert(spark):
    rng = np.random.default_rng(1)
    y = rng.integers(0, 3, 300)
    x = rng.normal(size=(300, 4)) + 3 * np.eye(4)[y]
    df = spark.createDataFrame([(i, x[i].tolist(), int(y[i])) for i in range(300)], "id int, v array<double>, y int")
    out = experts.logistic_lp(df, experts.fit_logistic(df, "v", "y"), "v", "lp").orderBy("id").collect()
    lp = np.array([r["lp"] for r in out])
    assert np.allclose(np.exp(lp).sum(1), 1)
    assert (lp.argmax(1) == y).mean() > 0.9
