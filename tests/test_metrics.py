import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from polyview.operators import metrics

LABELS = [0, 1, 2, 3]


@pytest.fixture(scope="module")
def pairs():
    rng = random.Random(9)
    return [(rng.choice([0, 0, 0, 0, 1, 2]), rng.choice([0, 0, 1])) for _ in range(400)]


@pytest.fixture(scope="module")
def frame(spark, pairs):
    return spark.createDataFrame([(i % 2, t, p) for i, (t, p) in enumerate(pairs)], "k int, y int, p int")


def expected(pairs, labels):
    out = {}
    for c in labels:
        tp = sum(t == c == p for t, p in pairs)
        support, predicted = sum(t == c for t, _ in pairs), sum(p == c for _, p in pairs)
        out[c] = (
            tp / predicted if predicted else 0.0,
            tp / support if support else 0.0,
            2 * tp / (support + predicted) if support + predicted else 0.0,
            support,
        )
    return out


def test_report_and_averages(frame, pairs):
    report = metrics.class_report(frame, "y", "p", LABELS)
    got = {r["label"]: (r["precision"], r["recall"], r["f1"], r["support"]) for r in report.collect()}
    want = expected(pairs, LABELS)
    assert got.keys() == want.keys()
    assert all(got[c] == pytest.approx(want[c]) for c in want)
    rows = {r["label"]: r for r in metrics.class_report_averages(report).collect()}
    assert rows["macro avg"]["f1"] == pytest.approx(sum(w[2] for w in want.values()) / 4)
    assert rows["weighted avg"]["f1"] == pytest.approx(sum(w[2] * w[3] for w in want.values()) / len(pairs))
    assert rows["macro avg"]["support"] == len(pairs)


def test_scores(frame, pairs):
    row = metrics.scores(frame, "y", "p", LABELS).first()
    want = expected(pairs, LABELS)
    acc = sum(t == p for t, p in pairs) / len(pairs)
    assert row["accuracy"] == pytest.approx(acc) == row["f1_micro"]
    assert row["f1_macro_seen"] == pytest.approx(sum(want[c][2] for c in (0, 1, 2)) / 3)
    assert row["f1_macro_fixed"] == pytest.approx(sum(w[2] for w in want.values()) / 4)
    assert row["f1_weighted"] == pytest.approx(sum(w[2] * w[3] for w in want.values()) / len(pairs))
    assert row["f1_2"] == 0 and row["f1_3"] == 0
    assert metrics.accuracy(frame, "y", "p").first()[0] == pytest.approx(acc)


def test_scores_by_key_equal_scores_of_each_part(frame):
    keyed = {r["k"]: r for r in metrics.scores(frame, "y", "p", LABELS, ["k"]).collect()}
    for k in (0, 1):
        alone = metrics.scores(frame.where(F.col("k") == k), "y", "p", LABELS).first()
        assert all(keyed[k][c] == pytest.approx(alone[c]) for c in alone.asDict())


def test_counted_rows_give_the_same_metrics(frame):
    counted = metrics.pair_counts(frame, "y", "p")
    for fn in (metrics.scores, metrics.confusion, metrics.class_report):
        plain = sorted(map(str, fn(frame, "y", "p", LABELS).collect()))
        assert sorted(map(str, fn(counted, "truth", "pred", LABELS, weight="n").collect())) == plain


def test_confusion_grid_is_whole(frame, pairs):
    cells = {(r["truth"], r["pred"]): r["n"] for r in metrics.confusion(frame, "y", "p", LABELS).collect()}
    assert cells == {(t, p): sum((t, p) == x for x in pairs) for t in LABELS for p in LABELS}
    assert sum(cells.values()) == len(pairs)
    matrix = metrics.confusion_rows(metrics.confusion(frame, "y", "p", LABELS)).orderBy("truth").collect()
    assert [r["counts"] for r in matrix] == [[cells[t, p] for p in LABELS] for t in LABELS]


def test_grid_of_an_empty_table_is_all_zeros(frame):
    cells = metrics.confusion(frame.where("y > 9"), "y", "p", LABELS).collect()
    assert len(cells) == 16 and {r["n"] for r in cells} == {0}
    assert metrics.confusion(frame.where("y > 9"), "y", "p", LABELS, ["k"]).count() == 0


def test_losses_weigh_a_short_last_batch(spark):
    rows = [(0, [-1.0, -9.0], 0), (0, [-2.0, -9.0], 0), (1, [-9.0, -6.0], 1)]
    df = spark.createDataFrame(rows, "batch_id long, lp array<double>, y int")
    row = metrics.losses(df, "lp", "y").first()
    assert row["loss_row_mean"] == pytest.approx(3.0) and row["loss_batch_mean"] == pytest.approx(3.75)


def test_a_missing_prediction_is_wrong_everywhere(spark):
    df = spark.createDataFrame([("a", "a"), ("a", None), ("b", "b")], "y string, p string")
    row = metrics.scores(df, "y", "p", ["a", "b"]).first()
    assert metrics.accuracy(df, "y", "p").first()[0] == pytest.approx(2 / 3) == row["accuracy"]
    assert row["f1_macro_seen"] == row["f1_macro_fixed"] == pytest.approx((2 / 3 + 1) / 2)
    assert row["f1_micro"] == pytest.approx(4 / 5)
    assert {r["label"] for r in metrics.class_report(df, "y", "p").collect()} == {"a", "b"}
    assert metrics.confusion(df, "y", "p", ["a", "b"]).agg(F.sum("n")).first()[0] == 2


def test_a_missing_truth_is_an_error(spark):
    df = spark.createDataFrame([("a", "a"), (None, "a")], "y string, p string")
    for frame in (metrics.accuracy(df, "y", "p"), metrics.scores(df, "y", "p", ["a"])):
        with pytest.raises(PySparkException, match="a row has no y"):
            frame.collect()


def test_a_label_out_of_range_has_no_loss(spark):
    df = spark.createDataFrame([(0, [-1.0, -2.0], 0), (0, [-1.0, -2.0], 5)], "batch_id long, lp array<double>, y int")
    with pytest.raises(PySparkException, match="label out of range: 5"):
        metrics.losses(df, "lp", "y").collect()
