"""Row-local vector arithmetic on ARRAY<DOUBLE> columns, all in the JVM.

``let`` binds a value once before it is used inside a lambda.  Without it the
optimizer may inline the value into the lambda and compute it per element.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, functions as F

from polyview.schema import LAYER_NORM_EPS

NEG_INF = float("-inf")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    return F.get(F.transform(F.array(value), body), F.lit(0))


def array_sum(vec: Column) -> Column:
    return F.aggregate(vec, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column, b: Column) -> Column:
    return array_sum(F.zip_with(a, b, lambda x, y: x * y))


def literal_vector(values: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def softmax(z: Column) -> Column:
    return let(
        F.array_max(z),
        lambda top: let(
            F.transform(z, lambda x: F.exp(x - top)),
            lambda e: let(array_sum(e), lambda total: F.transform(e, lambda x: x / total)),
        ),
    )


def log_softmax(z: Column) -> Column:
    return let(
        F.array_max(z),
        lambda top: let(
            top + F.log(F.aggregate(z, F.lit(0.0), lambda acc, x: acc + F.exp(x - top))),
            lambda norm: F.transform(z, lambda x: x - norm),
        ),
    )


def entropy(lp: Column) -> Column:
    """Shannon entropy in nats of the distribution whose log-probabilities are ``lp``."""
    return -F.aggregate(
        lp,
        F.lit(0.0),
        lambda acc, x: acc + F.when(x == NEG_INF, F.lit(0.0)).otherwise(F.exp(x) * x),
    )


def argmax(z: Column) -> Column:
    """0-based position of the largest element, the first one on ties."""
    return (F.array_position(z, F.array_max(z)) - 1).cast("int")


def affine(vec: Column, weight: Sequence[Sequence[float]], bias: Sequence[float]) -> Column:
    """``W x + b`` with literal ``W`` (one row per output) and ``b``."""
    rows = F.array(
        *[
            F.struct(literal_vector(w).alias("w"), F.lit(float(b)).alias("b"))
            for w, b in zip(weight, bias, strict=True)
        ]
    )
    return F.transform(rows, lambda r: dot(vec, r["w"]) + r["b"])


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def layer_norm(vec: Column, eps: float = LAYER_NORM_EPS) -> Column:
    """Zero mean and unit population variance over the elements of a row."""
    return let(
        array_sum(vec) / F.size(vec),
        lambda mean: let(
            F.aggregate(vec, F.lit(0.0), lambda acc, x: acc + (x - mean) * (x - mean)) / F.size(vec),
            lambda var: let(
                F.sqrt(var + F.lit(eps)),
                lambda scale: F.transform(vec, lambda x: (x - mean) / scale),
            ),
        ),
    )


def last_position(arr: Column) -> Column:
    """Last element of a sequence; NULL when it is empty."""
    return F.get(arr, F.size(arr) - 1)


def nll(lp: Column, label: Column) -> Column:
    """Negative log-likelihood of a 0-based label; a label without a class is an error."""
    unknown = F.concat(F.lit("label out of range: "), F.coalesce(label.cast("string"), F.lit("NULL")))
    return F.coalesce(-F.get(lp, label), F.raise_error(unknown).cast("double"))


def cut(vec: Column, widths: Sequence[int]) -> list[Column]:
    """The consecutive pieces of a wide vector, one per width."""
    pieces, start = [], 1
    for width in widths:
        pieces.append(F.slice(vec, start, width))
        start += width
    return pieces
