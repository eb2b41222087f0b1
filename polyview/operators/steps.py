"""A fit by gradient steps over batches, stopped by a cap and restarted from its stored state.

Every step is one aggregate: tasks sum the gradient of their own rows, and only
these sums are shuffled.  What comes to the driver is the model, ``classes *
(width + 1)`` numbers, whatever the input size.  The model is written every few
steps, so a fit that ends early goes on from the last whole state.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from polyview.functions.vectors import dot, literal_vector, log_softmax
from polyview.operators.ranks import epoch_batches, step_cap
from polyview.session import stored, subfolders

STEP = "step="


@dataclass(frozen=True)
class StepModel:
    """Softmax regression: one row of weights per class, the intercept last."""

    weights: np.ndarray  # classes x (width + 1)
    step: int
    loss: float | None = None  # mean over the batch that led to this model, before its step

    def log_probabilities(self, vec: Column) -> Column:
        """Of every class, from an array of doubles."""
        return log_softmax(F.array(*[dot(vec, literal_vector(row[:-1].tolist())) + float(row[-1]) for row in self.weights]))


def gradient(batch: DataFrame, vec: str, label: str, weights: np.ndarray) -> tuple[np.ndarray, float, int]:
    """Sums over the rows: gradient of the log loss, the loss, and the number of rows.

    A vector of another width, a NULL or NaN in it, and a label without a class are errors.
    """
    n_classes, width = weights.shape[0], weights.shape[1] - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, loss, n = np.zeros_like(weights), 0.0, 0
        for rows in batches:
            vectors, labels = rows.column(0), rows.column(1)
            flat = vectors.flatten()
            if vectors.null_count or len(flat) != len(rows) * width or flat.null_count:
                raise ValueError(f"every vector must hold {width} numbers")
            x = np.ones((len(rows), width + 1))
            x[:, :-1] = flat.to_numpy(zero_copy_only=False).reshape(-1, width)
            if not np.isfinite(x).all():
                raise ValueError("a vector holds NaN or an infinite number")
            if labels.null_count:
                raise ValueError("a row has no label")
            y = labels.to_numpy(zero_copy_only=False)
            if ((y < 0) | (y >= n_classes)).any():
                raise ValueError("label out of range")
            z = x @ weights.T
            z -= z.max(1, keepdims=True)
            lp = z - np.log(np.exp(z).sum(1, keepdims=True))
            loss -= lp[np.arange(len(y)), y].sum()
            error = np.exp(lp)
            error[np.arange(len(y)), y] -= 1.0
            sums += error.T @ x
            n += len(y)
        if n:
            numbers = pa.array(np.concatenate((sums.ravel(), (loss, float(n)))))
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(numbers)], pa.int32()), numbers)], ["g"])

    parts = batch.select(F.col(vec).cast("array<double>"), F.col(label).cast("int")).mapInArrow(run, "g array<double>")
    summed = parts.select(F.posexplode("g").alias("pos", "v")).groupBy("pos").agg(F.sum("v").alias("v")).toArrow()
    out = np.zeros(weights.size + 2)
    out[summed.column("pos").to_numpy()] = summed.column("v").to_numpy()
    return out[:-2].reshape(weights.shape), float(out[-2]), int(out[-1])


def save_state(spark: SparkSession, model: StepModel, root: str) -> None:
    """Writes the model of a step; written twice it is there once."""
    place, pos = np.indices(model.weights.shape)
    table = pa.table({"class": pa.array(place.ravel(), pa.int32()), "pos": pa.array(pos.ravel(), pa.int32()), "w": model.weights.ravel(),
                      "loss": pa.array([model.loss] * model.weights.size, pa.float64())})
    spark.createDataFrame(table).coalesce(1).write.mode("overwrite").parquet(f"{root}/{STEP}{model.step:09d}")


def stored_steps(spark: SparkSession, root: str) -> list[int]:
    """Steps whose state was written to its end."""
    return [int(name[len(STEP):]) for name in subfolders(spark, root, committed=True) if name.startswith(STEP)]


def load_state(spark: SparkSession, root: str, step: int) -> StepModel:
    table = spark.read.parquet(f"{root}/{STEP}{step:09d}").orderBy("class", "pos").toArrow()
    n_classes = table.column("class").to_numpy().max() + 1
    return StepModel(table.column("w").to_numpy().reshape(n_classes, -1), step, table.column("loss")[0].as_py())


def state_rows(spark: SparkSession, root: str) -> DataFrame:
    """``step, class, pos, w, loss`` of all stored states."""
    steps = stored_steps(spark, root)
    schema = "class int, pos int, w double, loss double"
    paths = [f"{root}/{STEP}{step:09d}" for step in steps]
    found = spark.read.schema(schema).option("basePath", root).parquet(*paths) if paths else spark.createDataFrame([], schema + ", step int")
    return found.select(F.col("step").cast("int").alias("step"), "class", "pos", "w", "loss")


def fit_steps(spark: SparkSession, batch_of: Callable[[int], DataFrame | None], vec: str, label: str, n_classes: int, width: int,
              state: str, max_steps: int, rate: float = 0.5, every: int = 1) -> StepModel:
    """Takes steps until ``max_steps`` or until ``batch_of`` gives no batch, from the last state stored under ``state``.

    A state beyond the cap is not used: the fit then goes on from the last one
    below it.  A batch without rows leaves the weights as they are.  The state is
    written every ``every`` steps and at the end.
    """
    if every < 1 or max_steps < 0:
        raise ValueError("every must be 1 or more and max_steps not negative")
    known = [step for step in stored_steps(spark, state) if step <= max_steps]
    model = load_state(spark, state, known[-1]) if known else StepModel(np.zeros((n_classes, width + 1)), 0)
    if model.weights.shape != (n_classes, width + 1):
        raise ValueError(f"the stored model has the shape {model.weights.shape}, not {(n_classes, width + 1)}")
    saved = model.step
    while model.step < max_steps and (batch := batch_of(model.step)) is not None:
        sums, loss, n = gradient(batch, vec, label, model.weights)
        weights = model.weights - rate * sums / n if n else model.weights
        model = StepModel(weights, model.step + 1, loss / n if n else None)
        if model.step % every == 0:
            save_state(spark, model, state)
            saved = model.step
    if saved != model.step:
        save_state(spark, model, state)
    return model


def full_batch(rows: DataFrame) -> Callable[[int], DataFrame]:
    """All rows in every step."""
    return lambda step: rows


def epoch_steps(rows: DataFrame, n: int, epochs: int, size: int, seed: int, max_steps: int, row_id: str = "row_id") -> Callable[[int], DataFrame | None]:
    """The batches of ``epoch_batches`` up to the cap, for ``fit_steps``.

    Rows are dealt to their steps once and stored in the order of steps, so that a
    step reads its own part of the table only; ``rows`` holds what the fit reads and
    a row id from 0 to ``n - 1``.
    """
    last = min(max_steps, epochs * -(-n // size))
    dealt = stored(epoch_batches(rows, n, epochs, size, seed, row_id), "dealt")  # a filter before the rounds would repeat them
    capped = step_cap(dealt, max_steps, "step").repartitionByRange("step").sortWithinPartitions("step")
    batches = stored(capped, "steps")
    return lambda step: batches.where(F.col("step") == step) if step < last else None
