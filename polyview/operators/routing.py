"""Gates, fusion and the refinement head, all row-local.

A row carries ``ARRAY<STRUCT<h, expert, lp>>``: one decision per expert.  The
array is as long as the expert catalog, so sorting and slicing it needs no
shuffle.  A gate is ``ARRAY<STRUCT<expert, lp, g>>`` and leaves out the experts
with weight 0.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from polyview.functions.vectors import add, affine, dot, layer_norm, let, literal_vector, log_softmax


def top_by_entropy(decided: Column, k: int) -> Column:
    """The ``k`` most certain experts; on ties the lower index."""
    return F.slice(F.sort_array(decided), 1, k)


def _scored(decided: Column, score) -> Column:
    """Ascending sort on ``-score`` then expert."""
    return F.transform(
        decided,
        lambda d: F.struct((-score(d)).alias("neg"), d["expert"].alias("expert"), d["lp"].alias("lp")),
    )


def top_by_score(decided: Column, w_g: Sequence[float], k: int) -> Column:
    """The ``k`` experts with the highest ``lp . w_g``; on ties the lower index."""
    weights = literal_vector(w_g)
    return F.slice(F.sort_array(_scored(decided, lambda d: dot(d["lp"], weights))), 1, k)


def _normalised(kept: Column) -> Column:
    """``expert, lp, e`` to ``expert, lp, g`` with ``g`` the share of ``e``."""
    return let(
        F.aggregate(kept, F.lit(0.0), lambda acc, x: acc + x["e"]),
        lambda total: F.transform(
            kept, lambda x: F.struct(x["expert"], x["lp"], (x["e"] / total).alias("g"))
        ),
    )


def score_gate(decided: Column, w_g: Sequence[float], k: int) -> Column:
    """Softmax over the ``k`` highest scores; the first kept one is the largest."""
    def raised(kept: Column) -> Column:
        return let(
            F.get(kept, F.lit(0))["neg"],
            lambda low: F.transform(
                kept, lambda x: F.struct(x["expert"], x["lp"], F.exp(low - x["neg"]).alias("e"))
            ),
        )

    return let(let(top_by_score(decided, w_g, k), raised), _normalised)


def entropy_gate(decided: Column, k: int, double: bool = True) -> Column:
    """Softmax of the negative entropies, the ``k`` largest kept, softmax again.

    Entropies lie in [0, ln classes] and first weights in [0, 1], so no shift is
    needed before ``exp``.  ``double=False`` normalises the kept first weights
    instead.
    """
    def raised(ranked: Column, total: Column) -> Column:
        def weight(d: Column) -> Column:
            once = F.exp(-d["h"]) / total
            return F.exp(once) if double else once

        return F.transform(
            F.slice(ranked, 1, k), lambda d: F.struct(d["expert"], d["lp"], weight(d).alias("e"))
        )

    return let(
        F.sort_array(decided),
        lambda ranked: let(
            F.aggregate(ranked, F.lit(0.0), lambda acc, d: acc + F.exp(-d["h"])),
            lambda total: let(raised(ranked, total), _normalised),
        ),
    )


def combined_gate(decided: Column, w_g: Sequence[float], k: int) -> Column:
    """Both gates added: weights sum to 2 and up to ``2k`` experts take part."""
    both = F.concat(score_gate(decided, w_g, k), entropy_gate(decided, k))
    return let(
        both,
        lambda parts: F.filter(
            F.transform(
                decided,
                lambda d: F.struct(
                    d["expert"].alias("expert"),
                    d["lp"].alias("lp"),
                    F.aggregate(
                        parts,
                        F.lit(0.0),
                        lambda acc, p: acc + F.when(p["expert"] == d["expert"], p["g"]).otherwise(0.0),
                    ).alias("g"),
                ),
            ),
            lambda x: x["g"] > 0,
        ),
    )


def dense_gate(gate: Column, n_experts: int) -> Column:
    """Weights of all experts in index order, 0 for those left out."""
    return let(
        F.map_from_entries(F.transform(gate, lambda x: F.struct(x["expert"], x["g"]))),
        lambda kept: F.transform(
            F.sequence(F.lit(0), F.lit(n_experts - 1)),
            lambda e: F.coalesce(F.try_element_at(kept, e), F.lit(0.0)),
        ),
    )


def fuse(gate: Column, n_classes: int) -> Column:
    """Weighted sum of the kept experts' log-probabilities."""
    return F.aggregate(
        gate,
        F.array_repeat(F.lit(0.0), n_classes),
        lambda acc, x: F.zip_with(acc, x["lp"], lambda a, b: a + x["g"] * b),
    )


def refine(fused: Column, weight: Sequence[Sequence[float]], bias: Sequence[float]) -> Column:
    """Affine map, residual, layer norm, log-softmax."""
    return let(fused, lambda z: log_softmax(layer_norm(add(z, affine(z, weight, bias)))))


def gate_by_mode(mode: str, decided: Column, w_g: Sequence[float], k: int) -> Column:
    if mode == "vanilla":
        return score_gate(decided, w_g, k)
    if mode == "entropy":
        return entropy_gate(decided, k)
    if mode == "vanilla_plus_entropy":
        return combined_gate(decided, w_g, k)
    raise ValueError(f"unknown gate mode {mode!r}")
