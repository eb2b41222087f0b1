"""Expert classifiers over wide vectors, and batch inference with any model.

Dense scoring is the one step that runs in Python: an Arrow batch goes through
a matrix product, which is many times faster than array lambdas.  All that
follows it (gate, fusion, losses, metrics) is Column expressions.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.functions import array_to_vector, predict_batch_udf, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, functions as F, types as T

from polyview.functions.vectors import entropy, let, log_softmax

SLICE_CELLS = 1 << 22  # numbers that scoring holds at once, besides its input and output


def centroid_table(train: DataFrame, vec: str, label: str) -> DataFrame:
    """``class, center``: the mean vector of each class, one partial aggregate."""
    mean = Summarizer.mean(array_to_vector(F.col(vec).cast("array<double>")))
    return train.groupBy(F.col(label).alias("class")).agg(vector_to_array(mean).alias("center"))


@dataclass(frozen=True)
class CentroidModel:
    """Class centers of every expert; an expert scores by ``-sharpness * distance**2``."""

    widths: tuple[int, ...]
    centers: np.ndarray  # classes x sum(widths)
    sharpness: float
    seen: tuple[bool, ...]  # classes with training rows; the others have probability 0

    @property
    def n_classes(self) -> int:
        return self.centers.shape[0]

    def scores(self, wide: Column) -> Column:
        """Expert-major scores of a row: ARRAY<DOUBLE> of experts * classes."""
        return self._apply(wide, lambda z: z)

    def judged(self, wide: Column) -> Column:
        """Entropy and log-probabilities, expert-major: experts * (1 + classes) numbers."""
        return self._apply(wide, _judge)

    def _scored(self, rows: np.ndarray, edges: np.ndarray, norms: list[np.ndarray]) -> np.ndarray:
        z = np.empty((len(rows), len(self.widths), self.n_classes))
        for e, (a, b) in enumerate(zip(edges, edges[1:])):
            x = rows[:, a:b].astype(np.float64)
            z[:, e, :] = -self.sharpness * ((x * x).sum(1)[:, None] - 2.0 * (x @ self.centers[:, a:b].T) + norms[e][None, :])
        z[:, :, [not seen for seen in self.seen]] = -np.inf
        return z

    def _apply(self, wide: Column, finish: Callable[[np.ndarray], np.ndarray]) -> Column:
        widths, centers = self.widths, self.centers
        total, edges = sum(widths), np.cumsum((0, *widths))
        norms = [(centers[:, a:b] ** 2).sum(1) for a, b in zip(edges, edges[1:])]

        @F.arrow_udf(T.ArrayType(T.DoubleType()))
        def run(batch: pa.Array) -> pa.Array:
            numbers = batch.flatten()
            flat = numbers.to_numpy(zero_copy_only=False)
            if batch.null_count or flat.size != len(batch) * total:
                raise ValueError(f"every vector must hold {total} numbers")
            if numbers.null_count or np.isnan(flat).any():
                raise ValueError("a vector holds NULL or NaN")
            rows = flat.reshape(len(batch), total)
            step = max(1, SLICE_CELLS // (len(widths) * (len(centers) + 1)))
            out = [finish(self._scored(rows[at:at + step], edges, norms)) for at in range(0, max(1, len(batch)), step)]
            out = np.concatenate(out) if len(out) > 1 else out[0]
            cells = out.shape[1] * out.shape[2]
            if len(batch) * cells >= 2**31:
                raise ValueError("lower spark.sql.execution.arrow.maxBytesPerBatch: a batch gives more than 2**31 numbers")
            ends = np.arange(0, (len(batch) + 1) * cells, cells, dtype=np.int32)
            return pa.ListArray.from_arrays(pa.array(ends), pa.array(out.ravel()))

        return run(wide)


def _judge(z: np.ndarray) -> np.ndarray:
    """Entropy, then log-probabilities, of the scores in the last axis."""
    shifted = z - z.max(-1, keepdims=True)
    lp = shifted - np.log(np.exp(shifted).sum(-1, keepdims=True))
    h = -(np.exp(lp) * np.where(np.isneginf(lp), 0.0, lp)).sum(-1, keepdims=True)
    return np.concatenate((h, lp), -1)


def fit_centroids(train: DataFrame, vec: str, label: str, widths: Sequence[int], n_classes: int,
                  sharpness: float) -> CentroidModel:
    """Nearest-center experts.  The model is ``n_classes`` vectors, whatever the input size.

    A class without training rows is never predicted.
    """
    known = F.col(label).between(0, n_classes - 1)
    strict = F.when(known, F.col(label)).otherwise(
        F.raise_error(F.concat(F.lit("label out of range: "), F.coalesce(F.col(label).cast("string"), F.lit("NULL"))))
        .cast("int")
    )
    table = centroid_table(train.select(F.col(vec), strict.alias("__label")), vec, "__label")
    rows = table.toArrow()  # at most n_classes rows
    if not rows.num_rows:
        raise ValueError("no training rows")
    found = rows.column("center").combine_chunks()
    width = len(found.flatten()) // rows.num_rows
    if width != sum(widths):
        raise ValueError(f"vectors hold {width} numbers, widths say {sum(widths)}")
    classes = rows.column("class").to_numpy()
    centers = np.zeros((n_classes, width))
    centers[classes] = found.flatten().to_numpy().reshape(-1, width)
    return CentroidModel(tuple(widths), centers, float(sharpness), tuple(bool(s) for s in np.isin(np.arange(n_classes), classes)))


def expert_scores(flat: Column, n_experts: int, n_classes: int) -> Column:
    """Flat scores as ``ARRAY<STRUCT<expert, z>>``."""
    return F.transform(
        F.sequence(F.lit(0), F.lit(n_experts - 1)),
        lambda e: F.struct(e.alias("expert"), F.slice(flat, e * n_classes + 1, n_classes).alias("z")),
    )


def decisions(scored: Column) -> Column:
    """``ARRAY<STRUCT<h, expert, lp>>``: entropy and log-probabilities of every expert.

    The field order makes a plain sort rank experts by confidence, index second.
    """
    return F.transform(
        scored,
        lambda s: let(
            log_softmax(s["z"]),
            lambda lp: F.struct(entropy(lp).alias("h"), s["expert"].alias("expert"), lp.alias("lp")),
        ),
    )


def with_decisions(df: DataFrame, model: CentroidModel, wide: str, name: str = "decisions") -> DataFrame:
    """Adds the decisions of all experts on a wide vector: one Arrow pass, no shuffle.

    The experts return entropy and log-probabilities along with their scores;
    the rest of the row's way is Column expressions.
    """
    n_classes, size = model.n_classes, model.n_classes + 1
    flat = F.col("__flat")
    decided = F.transform(
        F.sequence(F.lit(0), F.lit(len(model.widths) - 1)),
        lambda e: F.struct(
            F.get(flat, e * size).alias("h"), e.alias("expert"), F.slice(flat, e * size + 2, n_classes).alias("lp")
        ),
    )
    return df.withColumn("__flat", model.judged(F.col(wide))).withColumn(name, decided).drop("__flat")


def gather_decisions(rows: DataFrame, keys: Sequence[str], z: str = "z") -> DataFrame:
    """Long ``keys, expert, z`` to one row per key with its decisions.

    Only scores are shuffled, never the vectors; a group has one row per expert.
    """
    scored = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("expert", z))).alias("scored"))
    renamed = F.transform("scored", lambda s: F.struct(s["expert"].alias("expert"), s[z].alias("z")))
    return scored.select(*keys, decisions(renamed).alias("decisions"))


def _vector(df: DataFrame, vec: str) -> Column:
    return array_to_vector(F.col(vec)) if isinstance(df.schema[vec].dataType, T.ArrayType) else F.col(vec)


def fit_logistic(train: DataFrame, vec: str, label: str, max_iter: int = 20, reg: float = 0.01,
                 ) -> LogisticRegressionModel:
    """Multinomial logistic regression on an array or vector column."""
    data = train.select(_vector(train, vec).alias("features"), F.col(label).cast("double").alias("label"))
    return LogisticRegression(family="multinomial", maxIter=max_iter, regParam=reg, standardization=True).fit(data)


def logistic_lp(df: DataFrame, model: LogisticRegressionModel, vec: str, name: str) -> DataFrame:
    """Adds the log-probabilities of a fitted model as an array column."""
    raw_only = model.copy().setFeaturesCol("__features").setRawPredictionCol("__raw")
    raw_only = raw_only.setProbabilityCol("").setPredictionCol("")
    out = raw_only.transform(df.withColumn("__features", _vector(df, vec)))
    return out.withColumn(name, log_softmax(vector_to_array("__raw"))).drop("__features", "__raw")


def batch_predict(df: DataFrame, vec: str, width: int, make_fn: Callable[[], Callable], name: str,
                  batch_size: int = 1024) -> DataFrame:
    """Adds the output vector of any model.

    ``make_fn`` runs once per Python worker and returns a function from a
    ``rows x width`` array to a ``rows x outputs`` array.
    """
    predict = predict_batch_udf(
        make_fn,
        return_type=T.ArrayType(T.DoubleType()),
        batch_size=batch_size,
        input_tensor_shapes=[[width]],
    )
    return df.withColumn(name, predict(F.col(vec)))
