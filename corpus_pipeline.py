"""From raw documents to packed training sequences, in five stages.

``run(spark, sf_dir)`` applies ``STAGES`` to the table ``documents``; each stage is
written as Parquet to the shared scratch folder and read again by the next, so a
lost executor costs at most one stage.  All stages but the last return the columns
of ``documents``; the last returns the packed sequences, of which ``run`` gives the
digests.

Rows are told apart by ``doc_id`` and text.  Rows that repeat both are one
document: they are kept or dropped together.  A NULL ``doc_id`` comes before all
others, NULL and empty texts have no language and go in the first stage, and an
empty table passes through as an empty table.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from polyview.llm import exact_dedup, language, packing, simhash, substring
from polyview.llm.common import id_column, table, text_column, text_key
from polyview.session import stored

#: The stages fit models, walk graphs and tokenise, which SQL cannot say; tests hold them against brute force.
ORACLE_SQL = None


def _names(docs: DataFrame, *wanted: str) -> list[str]:
    """Column names that ``docs`` does not have yet."""
    taken = {c.lower() for c in docs.columns}
    return [next(n for n in (f"{w}{'_' * k}" for k in range(len(taken) + 1)) if n.lower() not in taken) for w in wanted]


def _keyed(docs: DataFrame, key: Column) -> tuple[DataFrame, list[str]]:
    names = _names(docs, "__id", "__key")
    return docs.withColumns(dict(zip(names, (id_column("doc_id"), key)))), names


def _without(docs: DataFrame, dropped: DataFrame, key: Column, dropped_key: str) -> DataFrame:
    """``docs`` without the rows whose id and ``key`` are listed in ``dropped``."""
    keyed, names = _keyed(docs, key)
    listed = dropped.select(id_column("doc_id").alias(names[0]), F.col(dropped_key).alias(names[1])).distinct()
    return keyed.join(listed, names, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the labelled ones have; all others go."""
    judged = language.identify(docs, language.fit_text(docs), declared="lang", host="source")
    return _without(docs, judged.where(~F.col("accepted")), text_key(text_column("text")), "text_key")


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the one with the largest id."""
    judged = exact_dedup.exact_dedup(docs)
    return _without(docs, judged.where(~F.col("kept")), F.sha2(text_column("text"), 256), "text_sha256")


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked fingerprints, the document with the smallest id."""
    judged = simhash.simhash_dedup(docs)
    return _without(docs, judged.where(~F.col("doc_id").eqNullSafe(F.col("component_id"))), text_key(text_column("text")), "text_key")


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that earlier documents have; a text of which nothing is left goes."""
    cut = substring.substring_dedup(docs, carry=True).where(F.col("kept_text").isNull() | (F.col("kept_text") != ""))
    new = {
        "text": F.coalesce("kept_text", "row.text"),
        "n_chars": F.when(F.col("kept_text").isNull(), F.col("row.n_chars")).otherwise(F.length("kept_text").cast("long")),
    }
    return cut.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The packed sequences: the pieces of all documents that are left, with their ids and places."""
    return packing.sequences(docs, public_tokenizers.path("byte_bpe_50k.json"))


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("language_id", language_id),
    ("exact_dedup", exact),
    ("simhash_dedup", near),
    ("substring_dedup", passages),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return packing.digests(docs)
