import numpy as np
import pytest
from pyspark.sql import functions as F

from polyview.operators import steps
from polyview.operators.steps import StepModel

CLASSES, WIDTH = 3, 4


def rows_of(spark, n=60, seed=5):
    rng = np.random.default_rng(seed)
    y = rng.integers(0, CLASSES, n)
    x = rng.normal(size=(n, WIDTH)) + np.eye(CLASSES, WIDTH)[y] * 2
    return spark.createDataFrame([(i, int(c), v.tolist()) for i, (c, v) in enumerate(zip(y, x))], "row_id long, y int, v array<double>"), x, y


def plain(x, y, n_steps, rate=0.5):
    """The same fit in numpy."""
    x, w = np.c_[x, np.ones(len(x))], np.zeros((CLASSES, WIDTH + 1))
    losses = []
    for _ in range(n_steps):
        z = x @ w.T
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        losses.append(-np.log(p[np.arange(len(y)), y]).mean())
        p[np.arange(len(y)), y] -= 1
        w = w - rate * (p.T @ x) / len(x)
    return w, losses


def fit(spark, df, state, cap, **more):
    return steps.fit_steps(spark, steps.full_batch(df), "v", "y", CLASSES, WIDTH, state, cap, **more)


def test_equals_plain_steps_and_the_cap_tells(spark, tmp_path):
    df, x, y = rows_of(spark)
    for cap in (0, 2, 5):
        model = fit(spark, df.repartition(3), str(tmp_path / f"s{cap}"), cap)
        want, losses = plain(x, y, cap)
        assert np.allclose(model.weights, want, atol=1e-12) and model.step == cap
        assert cap == 0 or np.isclose(model.loss, losses[-1])
    assert losses == sorted(losses, reverse=True) and not np.allclose(want, plain(x, y, 2)[0])


def test_restart_goes_on_from_the_stored_state(spark, tmp_path):
    df, x, y = rows_of(spark)
    whole, parts = str(tmp_path / "whole"), str(tmp_path / "parts")
    want = fit(spark, df, whole, 5)
    fit(spark, df, parts, 3, every=2)
    assert steps.stored_steps(spark, parts) == [2, 3]  # every second step and the last
    asked = []

    def batch_of(step):
        asked.append(step)
        return df

    got = steps.fit_steps(spark, batch_of, "v", "y", CLASSES, WIDTH, parts, 5)
    assert asked == [3, 4] and np.allclose(got.weights, want.weights, atol=1e-12)
    assert steps.state_rows(spark, whole).count() == 5 * CLASSES * (WIDTH + 1)


def test_a_half_written_state_is_not_used(spark, tmp_path):
    df, x, y = rows_of(spark)
    state = tmp_path / "s"
    fit(spark, df, str(state), 3)
    (state / "step=000000003" / "_SUCCESS").unlink()
    assert steps.stored_steps(spark, str(state)) == [1, 2]
    assert np.allclose(fit(spark, df, str(state), 3).weights, plain(x, y, 3)[0], atol=1e-12)
    assert np.allclose(fit(spark, df, str(state), 1).weights, plain(x, y, 1)[0], atol=1e-12)  # a cap below what is stored


def test_epochs_see_every_row_once_each_up_to_the_cap(spark, tmp_path):
    df, x, y = rows_of(spark, 50)
    batch_of = steps.epoch_steps(df, 50, 3, 8, 11, 10)
    seen = [sorted(r.row_id for r in batch_of(s).collect()) for s in range(10)]
    assert sorted(sum(seen[:7], [])) == list(range(50)) and [len(s) for s in seen] == [8] * 6 + [2] + [8] * 3
    assert batch_of(10) is None  # the cap, within the second epoch
    assert steps.epoch_steps(df, 50, 1, 8, 11, 10)(7) is None  # the end of the only epoch
    model = steps.fit_steps(spark, batch_of, "v", "y", CLASSES, WIDTH, str(tmp_path / "s"), 99)
    assert model.step == 10
    lp = model.log_probabilities(F.col("v"))
    hits = df.where(F.array_position(lp, F.array_max(lp)) - 1 == F.col("y")).count()
    assert hits > 50 / CLASSES


def test_scores_equal_numpy(spark):
    df, x, y = rows_of(spark, 10)
    w = np.random.default_rng(1).normal(size=(CLASSES, WIDTH + 1))
    z = np.c_[x, np.ones(10)] @ w.T
    want = z - np.log(np.exp(z).sum(1, keepdims=True))
    got = [r.lp for r in df.orderBy("row_id").select(StepModel(w, 1).log_probabilities(F.col("v")).alias("lp")).collect()]
    assert np.allclose(got, want)


@pytest.mark.parametrize(
    "row, message",
    [
        ((0, [1.0, 2.0]), "must hold 4"),
        ((0, [1.0, None, 1.0, 1.0]), "must hold 4"),
        ((0, None), "must hold 4"),
        ((0, [1.0, float("nan"), 1.0, 1.0]), "NaN"),
        ((None, [1.0] * 4), "no label"),
        ((3, [1.0] * 4), "out of range"),
    ],
)
def test_bad_rows_are_errors(spark, tmp_path, row, message):
    df = spark.createDataFrame([row], "y int, v array<double>")
    with pytest.raises(Exception, match=message):
        fit(spark, df, str(tmp_path / "s"), 1)


def test_an_empty_batch_leaves_the_model(spark, tmp_path):
    df = spark.createDataFrame([], "y int, v array<double>")
    model = fit(spark, df, str(tmp_path / "s"), 2)
    assert model.step == 2 and model.loss is None and not model.weights.any()
    with pytest.raises(ValueError, match="shape"):
        steps.fit_steps(spark, steps.full_batch(df), "v", "y", CLASSES, WIDTH + 1, str(tmp_path / "s"), 3)
