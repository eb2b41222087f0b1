"""Schemas of the linking tables and the fixed values of the pipeline."""

from __future__ import annotations

from pyspark.sql import types as T

EXAMPLE = T.StructType(
    [
        T.StructField("input", T.StringType()),
        T.StructField("output", T.StringType()),
    ]
)

VIEW = T.StructType(
    [
        T.StructField("row_id", T.LongType()),
        T.StructField("vec", T.ArrayType(T.FloatType())),
        T.StructField("dataset", T.StringType()),
        T.StructField("expert", T.StringType()),
        T.StructField("split", T.StringType()),
    ]
)

# Label vocabulary, raw code maps, expert dimensions, ablations.
LABEL_TO_ID = {"negative": 0, "neutral": 1, "positive": 2}
PHRASEBANK_CODES = {0: "negative", 1: "neutral", 2: "positive"}
TWEET_CODES = {0: "negative", 1: "positive", 2: "neutral"}
DIMENSIONS = ["Semantic", "Math", "Event", "Sentiment"]
ABLATIONS = {
    "All": None,
    "woSemantic": "Semantic",
    "woNumerical": "Math",
    "woEvent": "Event",
    "woSentiment": "Sentiment",
}

# Experts per dimension of the default set-up, in index order.
EXPERT_COUNTS = {"Semantic": 6, "Math": 5, "Event": 2, "Sentiment": 2}

# Gate and training defaults.
TOP_K = 6
GATE_BATCH = 8
SPLIT_SEED = 42
LAYER_NORM_EPS = 1e-5
