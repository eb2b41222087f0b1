import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from polyview.functions import prompts
from polyview.operators import labels
from polyview.schema import DIMENSIONS, LABEL_TO_ID, PHRASEBANK_CODES, TWEET_CODES


def test_score_bin_edges(spark):
    scores = [-0.5, -0.1, -0.0999, 0.0, 0.0999, 0.1, 0.5, float("nan"), None]
    rows = spark.createDataFrame([(i, s) for i, s in enumerate(scores)], "i int, s double")
    got = [r[0] for r in rows.orderBy("i").select(labels.bin_score(F.col("s"))).collect()]
    assert got == ["negative"] + ["neutral"] * 4 + ["positive"] * 4


def test_codes_differ_by_corpus(spark):
    rows = spark.createDataFrame(
        [("phrasebank", 1), ("tweets", 1), ("phrasebank", 2), ("tweets", 2), ("tweets", 9), ("other", 0)], "d string, c int"
    )
    codes = {"phrasebank": PHRASEBANK_CODES, "tweets": TWEET_CODES}
    got = [r[0] for r in rows.select(labels.corpus_code_to_label(F.col("d"), F.col("c"), codes)).collect()]
    assert got == ["neutral", "positive", "positive", "neutral", None, None]


def test_lenient_and_strict_lookup(spark):
    rows = spark.createDataFrame([("negative",), ("odd",), (None,)], "l string")
    assert [r[0] for r in rows.select(labels.label_to_id(F.col("l"), LABEL_TO_ID)).collect()] == [0, None, None]
    for bad in ("odd", None):
        one = spark.createDataFrame([(bad,)], "l string")
        with pytest.raises(PySparkException, match="unknown label"):
            one.select(labels.label_to_id_strict(F.col("l"), LABEL_TO_ID)).collect()
    unknown = labels.unknown_labels(rows, "l", LABEL_TO_ID).collect()
    assert sorted((r["l"] or "", r["n"]) for r in unknown) == [("", 1), ("odd", 1)]


def test_positional_rename_wants_two_columns(spark):
    assert labels.canonicalise(spark.range(1).selectExpr("id a", "id b")).columns == ["input", "output"]
    with pytest.raises(ValueError):
        labels.canonicalise(spark.range(1))


def test_ablations():
    assert labels.ablation_dimensions("All", DIMENSIONS) == DIMENSIONS
    assert labels.ablation_dimensions("woNumerical", DIMENSIONS) == ["Semantic", "Event", "Sentiment"]
    with pytest.raises(ValueError):
        labels.ablation_dimensions("woNothing", DIMENSIONS)


def test_prompts(spark):
    row = spark.createDataFrame([("a {} b", None)], "i string, o string")
    i, o = F.col("i"), F.col("o")
    got = row.select(
        prompts.train_prompt(i, o, "</s>"),
        prompts.infer_prompt(i),
        prompts.infer_prompt(i, "do"),
    ).first()
    assert got[0] == "### Input:\na {} b\n\n### Response:\nNone</s>"
    assert got[1] == "### Input:\na {} b\n\n### Response:\n"
    assert got[2] == "### Instruction:\ndo\n\n### Input:\na {} b\n\n### Response:\n"
    with pytest.raises(ValueError):
        prompts.render("{} {}", i)


def test_narrative_uses_the_first_event(spark):
    kind = "array<struct<name:string,sentiment:string,label_1:string,label_2:string,category:string>>"
    rows = spark.createDataFrame(
        [(1, "Text.", [("N", "good", "x", "y", "C"), ("M", "bad", "p", "q", "D")]), (2, "Bare.", [])], f"id int, c string, e {kind}"
    )
    full = rows.where("id = 1").select(prompts.narrative(F.col("c"), F.col("e"))).first()[0]
    assert full.startswith("Text. ") and "company N," in full and "the C sector" in full and full.endswith("event is good.")
    assert "'x'" in full and "'y'" in full
    empty = rows.where("id = 2")
    assert "company None," in empty.select(prompts.narrative(F.col("c"), F.col("e"), strict=False)).first()[0]
    with pytest.raises(PySparkException, match="INVALID_ARRAY_INDEX"):
        empty.select(prompts.narrative(F.col("c"), F.col("e"))).collect()
