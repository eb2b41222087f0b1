"""Metric tables and text reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from polyview.operators import metrics

# The first line of the report.
HEADLINE = "Acc: %.5f. F1 macro: %.5f. F1 micro: %.5f. F1 weighted: %.5f."


def write_metrics(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists") -> None:
    """A metric table as ``parquet`` or ``csv``."""
    if fmt not in ("parquet", "csv"):
        raise ValueError(f"unknown format {fmt!r}")
    writer = df.write.mode(mode)
    writer.option("header", "true").csv(path) if fmt == "csv" else writer.parquet(path)


def fixed(value: Column, digits: int = 5) -> Column:
    return F.format_string(f"%.{digits}f", value)


def headline(scores: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """One line of text per metric row."""
    values = ("accuracy", "f1_macro_seen", "f1_micro", "f1_weighted")
    return scores.select(*keys, F.format_string(HEADLINE, *[F.col(v) for v in values]).alias("value"))


# One row of a classification report, and its two average rows.
CLASS_ROW = "%12s  %9.5f %9.5f %9.5f %9d"
AVERAGE_ROWS = ("macro avg", "weighted avg")


def report_lines(scores: DataFrame, averages: DataFrame, matrix: DataFrame, labels: Sequence) -> DataFrame:
    """``line, value``: headline, a row per class and average, a row per truth label of the matrix.

    The inputs are metric tables: a few rows per class, whatever was measured.
    """
    names = [str(label) for label in labels]
    place = F.array_position(F.array(*[F.lit(n) for n in (*names, *AVERAGE_ROWS)]), F.col("label"))
    rows = averages.select(
        place.cast("int").alias("line"),
        F.format_string(CLASS_ROW, "label", "precision", "recall", "f1", "support").alias("value"),
    )
    truth = F.array_position(F.array(*[F.lit(n) for n in names]), F.col("truth").cast("string"))
    cells = F.array_join(F.col("counts").cast("array<string>"), " ")
    grid = matrix.select(
        (truth + len(names) + len(AVERAGE_ROWS)).cast("int").alias("line"),
        F.concat(F.lit("["), cells, F.lit("]")).alias("value"),
    )
    return headline(scores).select(F.lit(0).alias("line"), "value").unionByName(rows).unionByName(grid)


def whole_rows(counted: DataFrame, labels: Sequence, keys: Sequence[str], truth: str = "truth", pred: str = "pred",
               weight: str = "n") -> DataFrame:
    """One row per key: all scores, F1 per class, the report text and the matrix, lines joined by line feeds.

    ``counted`` has one row per key, truth and prediction, so each of the three parts reads a few rows.
    """
    scores = metrics.scores(counted, truth, pred, labels, keys, weight=weight)
    names = F.array(*[F.lit(n) for n in (*map(str, labels), *AVERAGE_ROWS)])
    averages = metrics.class_report_averages(metrics.class_report(counted, truth, pred, labels, keys, weight), keys)
    line = F.format_string(CLASS_ROW, "label", "precision", "recall", "f1", "support")
    place = F.array_position(names, F.col("label"))
    in_order = lambda parts: F.array_join(F.transform(F.array_sort(F.collect_list(parts)), lambda x: x["line"]), "\n")
    report = averages.groupBy(*keys).agg(in_order(F.struct(place.alias("place"), line.alias("line"))).alias("report"))
    cells = metrics.confusion_rows(metrics.confusion(counted, truth, pred, labels, keys, weight), keys)
    row = F.concat(F.lit("["), F.array_join(F.col("counts").cast("array<string>"), " "), F.lit("]"))
    matrix = cells.groupBy(*keys).agg(in_order(F.struct("truth", row.alias("line"))).alias("matrix"))
    return scores.join(report, list(keys)).join(matrix, list(keys))


def write_report(lines: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One text file; lines that carry a ``line`` number are put in order."""
    ordered = lines.coalesce(1).sortWithinPartitions("line") if "line" in lines.columns else lines
    ordered.select("value").write.mode(mode).text(path)
