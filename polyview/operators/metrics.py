"""Classification metrics.

Rows are counted once per (key, truth, prediction) with partial aggregation;
everything after that works on at most classes**2 rows per key, so a class that
holds most of the rows costs nothing extra.

One rule for NULL holds everywhere: a row without a prediction counts as wrong and
belongs to no predicted class; a row without a truth is an error.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from polyview.functions.vectors import nll

Labels = Sequence[int] | Sequence[str]


def ratio(part: Column, whole: Column) -> Column:
    """``part / whole``, and 0 where ``whole`` is 0."""
    return F.when(whole > 0, part / F.when(whole > 0, whole)).otherwise(F.lit(0.0))


def given(df: DataFrame, truth: str) -> Column:
    """The truth, or an error where there is none."""
    missing = F.raise_error(F.lit(f"a row has no {truth}")).cast(df.schema[truth].dataType)
    return F.coalesce(F.col(truth), missing)


def pair_counts(df: DataFrame, truth: str, pred: str, keys: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    """``truth, pred, n`` per key.

    ``weight`` names the count of a table that is counted already, here and in
    the metrics below: several metrics of large data then share one pass.
    """
    one = F.lit(1).cast("bigint") if weight is None else F.col(weight)
    return (
        df.select(*keys, given(df, truth).alias("truth"), F.col(pred).alias("pred"), one.alias("n"))
        .groupBy(*keys, "truth", "pred")
        .agg(F.sum("n").alias("n"))
    )


def accuracy(df: DataFrame, truth: str, pred: str, keys: Sequence[str] = ()) -> DataFrame:
    hit = given(df, truth).eqNullSafe(F.col(pred)).cast("double")
    return df.groupBy(*keys).agg(F.avg(hit).alias("accuracy"))


def confusion(df: DataFrame, truth: str, pred: str, labels: Labels, keys: Sequence[str] = (),
              weight: str | None = None) -> DataFrame:
    """One row per cell of the fixed label grid; absent cells are 0.

    The grid is unrolled from the label list for every key that has rows, added
    as zeros to the counts, and summed: no join.
    """
    def cell(t: Column, p: Column, n: Column) -> Column:
        return F.struct(t.alias("truth"), p.alias("pred"), n.cast("bigint").alias("n"))

    counts = pair_counts(df, truth, pred, keys, weight)
    zeros = [cell(F.lit(t), F.lit(p), F.lit(0)) for t in labels for p in labels]
    listed = F.col("truth").isin(*labels) & F.col("pred").isin(*labels)
    own = cell(F.col("truth"), F.col("pred"), F.col("n"))
    # each counted pair brings itself, if listed, and the zeros: one pass over the rows
    cells = counts.select(*keys, F.explode(F.concat(F.filter(F.array(own), lambda _: listed), F.array(*zeros))).alias("c"))
    if not keys:  # an empty table has a grid as well
        cells = cells.unionByName(df.sparkSession.range(1).select(F.explode(F.array(*zeros)).alias("c")))
    return cells.groupBy(*keys, "c.truth", "c.pred").agg(F.sum("c.n").alias("n"))


def confusion_rows(cells: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Array form: one row per truth label, counts in the order of the predicted label."""
    ordered = F.array_sort(F.collect_list(F.struct("pred", "n")))
    return cells.groupBy(*keys, "truth").agg(F.transform(ordered, lambda c: c["n"]).alias("counts"))


def class_totals(df: DataFrame, truth: str, pred: str, labels: Labels | None = None,
                 keys: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    """Per label: rows that have it (``support``), that were given it, and both.

    ``labels`` fixes the list; without it the labels seen in truth or prediction
    are used.
    """
    def part(label: Column, support: Column, predicted: Column, both: Column) -> Column:
        return F.struct(
            label.alias("label"),
            support.cast("bigint").alias("support"),
            predicted.cast("bigint").alias("predicted"),
            both.cast("bigint").alias("both"),
        )

    n, zero = F.col("n"), F.lit(0)
    parts = [
        part(F.col("truth"), n, zero, F.when(F.col("truth") == F.col("pred"), n).otherwise(zero)),
        part(F.col("pred"), zero, n, zero),
    ]
    parts += [part(F.lit(label), zero, zero, zero) for label in labels or ()]
    totals = (
        pair_counts(df, truth, pred, keys, weight)
        .select(*keys, F.explode(F.array(*parts)).alias("c"))
        .groupBy(*keys, F.col("c.label").alias("label"))
        .agg(*[F.sum(f"c.{name}").alias(name) for name in ("support", "predicted", "both")])
    )
    return totals.where(F.col("label").isNotNull() if labels is None else F.col("label").isin(*labels))


def class_report(df: DataFrame, truth: str, pred: str, labels: Labels | None = None,
                 keys: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    """Precision, recall, F1 and support per label."""
    both, support, predicted = F.col("both"), F.col("support"), F.col("predicted")
    return class_totals(df, truth, pred, labels, keys, weight).select(
        *keys,
        "label",
        ratio(both, predicted).alias("precision"),
        ratio(both, support).alias("recall"),
        ratio(2.0 * both, support + predicted).alias("f1"),
        "support",
        "predicted",
        "both",
    )


def _weighted(value: str) -> Column:
    return ratio(F.sum(F.col(value) * F.col("support")), F.sum("support"))


def class_report_averages(report: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Class rows plus the macro and the support-weighted average row."""
    fields = ("precision", "recall", "f1")
    rows = report.select(*keys, F.col("label").cast("string").alias("label"), *fields, "support")
    macro = rows.groupBy(*keys).agg(*[F.avg(f).alias(f) for f in fields], F.sum("support").alias("support"))
    weighted = rows.groupBy(*keys).agg(*[_weighted(f).alias(f) for f in fields], F.sum("support").alias("support"))
    return (
        rows.unionByName(macro.withColumn("label", F.lit("macro avg")))
        .unionByName(weighted.withColumn("label", F.lit("weighted avg")))
    )


def scores(df: DataFrame, truth: str, pred: str, labels: Labels, keys: Sequence[str] = (),
           per_class: bool = True, weight: str | None = None) -> DataFrame:
    """One row of metrics per key, from a single pass over the rows.

    ``f1_macro_seen`` averages over labels seen in truth or prediction,
    ``f1_macro_fixed`` over the given list.
    """
    seen = F.col("support") + F.col("predicted") > 0
    fixed = F.col("label").isin(*labels)
    report = class_report(df, truth, pred, None, keys, weight)
    aggs = [
        (F.sum("both") / F.sum("support")).alias("accuracy"),
        F.avg(F.when(seen, F.col("f1"))).alias("f1_macro_seen"),
        (F.sum(F.when(fixed, F.col("f1")).otherwise(0.0)) / len(labels)).alias("f1_macro_fixed"),
        ratio(2.0 * F.sum("both"), F.sum(F.col("support") + F.col("predicted"))).alias("f1_micro"),
        _weighted("f1").alias("f1_weighted"),
    ]
    if per_class:
        aggs += [
            F.coalesce(F.max(F.when(F.col("label") == label, F.col("f1"))), F.lit(0.0)).alias(f"f1_{label}")
            for label in labels
        ]
    return report.groupBy(*keys).agg(*aggs)


def losses(df: DataFrame, lp: str, label: str, batch: str = "batch_id", keys: Sequence[str] = ()) -> DataFrame:
    """Losses of log-probabilities; a label without a class is an error."""
    return mean_losses(df.withColumn("__nll", nll(F.col(lp), F.col(label))), "__nll", batch, keys)


def mean_losses(df: DataFrame, value: str, batch: str = "batch_id", keys: Sequence[str] = ()) -> DataFrame:
    """Mean loss over rows, and the mean of the batch means (a short last batch weighs more)."""
    batches = df.groupBy(*keys, batch).agg(F.sum(value).alias("s"), F.count(F.lit(1)).alias("n"))
    return batches.groupBy(*keys).agg(
        (F.sum("s") / F.sum("n")).alias("loss_row_mean"),
        F.avg(F.col("s") / F.col("n")).alias("loss_batch_mean"),
    )
