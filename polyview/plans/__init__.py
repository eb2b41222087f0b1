"""All registered queries."""

from polyview.plans import corpora, fits, order, quality, routing, streams, texts, vectors  # noqa: F401
from polyview.plans.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
