"""Language identification by Bayesian evidence fusion.

Four kinds of evidence are multiplied, each as a likelihood or prior per language:

* **Text.** Naive Bayes over byte trigrams of the lower-cased letters, hashed to
  a fixed number of buckets.  Trigrams overlap, so their sum is tempered.
* **Declared language** (of the markup, or a metadata column): how often pages of
  a language declare it, counted over the corpus.
* **Address suffix**: how often pages of a language have it, counted likewise.
* **Host prior**: the languages of the host's other documents, smoothed towards
  those of its registered domain, and these towards those of all documents.

The corpus counts are sums of text posteriors per host, domain, suffix and
declared language, made by grouped aggregation with partial sums, over all
documents.  A document's own share is taken out of its host prior.  One more
class, ``und``, spreads its text likelihood evenly over all buckets and so wins
for texts in no language of the model; such documents are rejected.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from polyview.llm.common import byte_column, given_id, id_column, list_array, slices, small_batches, text_column, text_key
from polyview.llm.urls import suffix_and_domain
from polyview.session import stored

BUCKETS = 1 << 16
FIT_ROWS = 20_000  # distinct texts per language that the text model is fitted on, at most
MAX_LANGUAGES = 200
TEMPER = 1 / 3
FLAT = 0.1  # share of the even distribution in every language's trigrams
SMOOTH = 10.0  # documents that a domain counts for in its hosts' priors, and all documents in a domain's
UND = "und"
ACCEPT = 0.5
PIECE = 1 << 20
U = np.uint32


def _letters() -> np.ndarray:
    """Letters stay, every other ASCII byte is a space; bytes above are parts of letters."""
    table = np.full(256, 0x20, np.uint8)
    for b in [*range(0x61, 0x7B), *range(0x80, 0x100)]:
        table[b] = b
    return table


def trigrams(text: bytes) -> np.ndarray:
    """Buckets of the byte trigrams of the lower-cased letters; runs of other characters are one space."""
    table = _letters()
    raw = table[np.frombuffer(b" " + text.decode().lower().encode() + b" ", np.uint8)]
    gap = raw == 0x20
    raw = raw[np.concatenate([[True], ~(gap[1:] & gap[:-1])])]
    if len(raw) < 3:
        return np.zeros(0, U)
    raw = raw.astype(U)
    code = raw[:-2] | raw[1:-1] << U(8) | raw[2:] << U(16)
    return (code * U(0x9E3779B1)) >> U(16)


def _texts(batch: pa.RecordBatch) -> Iterator[bytes]:
    buf, offsets = byte_column(batch.column("_text"))
    data = buf.tobytes()
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        yield data[a:b]


def main_language(label: Column) -> Column:
    """A language label in lower case and without its region: ``en`` of ``en``, ``EN``, ``en-US`` and ``en_GB``."""
    return F.substring_index(F.substring_index(F.lower(label), "-", 1), "_", 1)


def fit_texts(labelled: DataFrame, fit_rows: int) -> tuple[list[str], DataFrame]:
    """All languages of ``labelled`` (``_lang, _text``) and of each its ``fit_rows`` texts with the least hashes.

    Languages and their distinct texts are counted over all rows by grouped
    aggregation.  A language with more texts than wanted is first cut to a few more
    than that by its share of the hash range, so that ranks are made of few rows;
    a repeated text is one text.
    """
    rows = labelled.withColumn("_hash", F.xxhash64("_text", F.lit(7)))
    counts = rows.select("_lang", "_hash").distinct().groupBy("_lang").agg(F.count(F.lit(1)).alias("_n"))
    counts = stored(counts, "languages")
    names = [r["_lang"] for r in counts.select("_lang").sort("_lang").collect()]
    wanted = fit_rows + 8 * math.sqrt(fit_rows) + 8
    upto = F.least(F.lit(1.0), F.lit(wanted) / F.col("_n")) * 2.0**64 - 2.0**63
    # a double as large as 2^63 becomes the largest long, so a rare language keeps all texts
    near = rows.join(F.broadcast(counts.select("_lang", upto.cast("long").alias("_upto"))), "_lang").where(F.col("_hash") <= F.col("_upto"))
    rank = F.row_number().over(Window.partitionBy("_lang").orderBy("_hash"))
    last = near.select("_lang", "_hash").distinct().withColumn("_rank", rank).where(F.col("_rank") <= fit_rows)
    last = last.groupBy("_lang").agg(F.max("_hash").alias("_last"))
    picked = near.join(F.broadcast(last), "_lang").where(F.col("_hash") <= F.col("_last"))
    return names, picked.groupBy("_lang", "_hash").agg(F.first("_text").alias("_text")).select("_lang", "_text")


def fit_text(labelled: DataFrame, text: str = "text", language: str = "lang", fit_rows: int = FIT_ROWS) -> tuple[list[str], np.ndarray]:
    """Languages and log-probabilities ``[bucket, language]``, with ``und`` as the last column.

    Every language of the labelled rows is known, however rare.  Each is fitted on
    at most ``fit_rows`` of its distinct texts, chosen by a hash of the text; on all
    of them if there are no more.  Only sums per language and bucket come to the
    driver, at most ``MAX_LANGUAGES * BUCKETS``.  Without labelled rows no language
    is known, and ``identify`` rejects every text.
    """
    rows = labelled.select(main_language(F.coalesce(F.col(f"`{language}`").cast("string"), F.lit(""))).alias("_lang"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("_text"))
    names, rows = fit_texts(rows.where((F.col("_lang") != "") & (F.col("_lang") != UND)), fit_rows)
    if len(names) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = {n: i for i, n in enumerate(names)}
        for batch in slices(batches):
            codes = [trigrams(t) for t in _texts(batch)]
            which = np.array([place[n] for n in batch.column("_lang").to_pylist()], np.int64)
            keys = np.repeat(which, [len(c) for c in codes]) * BUCKETS + np.concatenate(codes)
            found, n = np.unique(keys, return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array((found // BUCKETS).astype(np.int32)), pa.array((found % BUCKETS).astype(np.int32)), pa.array(n.astype(np.int64))],
                ["which", "bucket", "n"],
            )

    small_batches(labelled.sparkSession)
    counted = rows.mapInArrow(count, "which int, bucket int, n long").groupBy("which", "bucket").agg(F.sum("n").alias("n")).toPandas()
    sums = np.zeros((BUCKETS, len(names)))
    sums[counted["bucket"], counted["which"]] = counted["n"]
    shares = sums / np.maximum(sums.sum(axis=0), 1)
    mixed = (1 - FLAT) * shares + FLAT / BUCKETS
    return [*names, UND], np.log(np.column_stack([mixed, np.full(BUCKETS, 1 / BUCKETS)])).astype(np.float32)


def text_scores(rows: DataFrame, model: tuple[list[str], np.ndarray], keep: list[str]) -> DataFrame:
    """Columns ``keep`` with ``_ll``, the tempered log-likelihoods of the whole text, and ``_grams``, how many trigrams it has."""
    _, table = model
    width = table.shape[1]
    small_batches(rows.sparkSession)
    schema = rows.select(*keep).withColumns({"_grams": F.lit(0).cast("long"), "_ll": F.array().cast("array<double>")}).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sums, grams = np.zeros((batch.num_rows, width)), np.zeros(batch.num_rows, np.int64)
            for r, t in enumerate(_texts(batch)):
                codes = trigrams(t)
                grams[r] = len(codes)
                for at in range(0, len(codes), PIECE):
                    sums[r] += table[codes[at:at + PIECE]].sum(axis=0, dtype=np.float64)
            lists = list_array((sums * TEMPER).ravel(), np.full(batch.num_rows, width), pa.float64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(grams), lists], [*keep, "_grams", "_ll"])

    return rows.select(*keep, "_text").mapInArrow(run, schema)


def normal(logs: Column) -> Column:
    """Log weights to probabilities; ``logs`` must be a column of the frame."""
    top = F.array_max(logs)
    weights = F.transform(logs, lambda x: F.exp(x - top))
    return F.transform(weights, lambda w: w / F.aggregate(weights, F.lit(0.0), lambda s, x: s + x))


def _sums(rows: DataFrame, keys: list[str], source: str, name: str, width: int) -> DataFrame:
    """Sums of the posterior vectors in ``source`` per key, as one vector."""
    parts = rows.groupBy(*keys).agg(*[F.sum(F.col(source)[i]).alias(f"_s{i}") for i in range(width)])
    return parts.select(*keys, F.array(*[F.col(f"_s{i}") for i in range(width)]).alias(name))


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray], doc_id: str = "doc_id", text: str = "text",
             declared: str | None = None, host: str | None = None, accept: float = ACCEPT) -> DataFrame:
    """``doc_id, language, probability, accepted, text_language, host, declared, text_key``: one row per input row.

    ``declared`` and ``host`` name the columns with that evidence; without a column
    all rows have the same, which says nothing.  NULL evidence counts as an empty
    value of its own.  A document is accepted if its text has letters, its most
    probable class is a language and that has at least the probability ``accept``;
    NULL and empty texts and texts without letters have no text evidence and are
    rejected.  Ties go to the first language by name.  Rows with equal ids are
    judged each; other columns are not read; an empty table gives an empty result.
    """
    names, width = model[0], len(model[0])
    place = lambda c: F.lit("") if c is None else F.lower(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")))
    suffix, domain = suffix_and_domain(F.col("_host"))
    said = main_language(place(declared))
    rows = docs.select(
        id_column(doc_id).alias("_id"), text_column(text).alias("_text"), place(host).alias("_host"), said.alias("_said")
    ).withColumns({"_key": text_key(F.col("_text")), "_suffix": suffix, "_domain": domain})
    keep = ["_id", "_key", "_host", "_domain", "_suffix", "_said"]
    scored = text_scores(rows, model, keep).withColumn("_p", normal(F.col("_ll")))
    # a text without letters says nothing and counts for nothing
    scored = stored(scored.withColumn("_p", F.when(F.col("_grams") > 0, F.col("_p")).otherwise(F.array(*[F.lit(0.0)] * width))), "language")

    hosts = _sums(scored, ["_host", "_domain"], "_p", "_of_host", width)
    domains = _sums(hosts, ["_domain"], "_of_host", "_of_domain", width)
    every = domains.agg(*[F.sum(F.col("_of_domain")[i]) for i in range(width)]).first()
    totals = [float(x or 0.0) for x in every]
    flat = [(t + 1.0) / (sum(totals) + width) for t in totals]
    of_said = _sums(scored, ["_said"], "_p", "_of_said", width)
    of_suffix = _sums(scored, ["_suffix"], "_p", "_of_suffix", width)

    joined = scored
    for table, key in ((hosts.drop("_domain"), "_host"), (domains, "_domain"), (of_said, "_said"), (of_suffix, "_suffix")):
        joined = joined.join(table, key)
    total = F.array(*[F.lit(t) for t in totals])
    sum_of = lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x)
    less = lambda v: F.zip_with(v, F.col("_p"), lambda x, p: F.greatest(x - p, F.lit(0.0)))
    shrunk = lambda counts, prior: F.zip_with(counts, prior, lambda c, p: (c + SMOOTH * p))
    evidence = joined.withColumn("_d", less(F.col("_of_domain"))).withColumn("_h", less(F.col("_of_host")))
    evidence = evidence.withColumn("_dn", sum_of(F.col("_d"))).withColumn("_hn", sum_of(F.col("_h")))
    evidence = evidence.withColumn("_dp", F.transform(shrunk(F.col("_d"), F.array(*[F.lit(p) for p in flat])), lambda x: x / (F.col("_dn") + SMOOTH)))
    evidence = evidence.withColumn("_hp", F.transform(shrunk(F.col("_h"), F.col("_dp")), lambda x: x / (F.col("_hn") + SMOOTH)))
    # P(value | language), smoothed by half a document on either side
    given = lambda v: F.zip_with(less(v), total, lambda c, t: (c + 0.5) / (t + 1.0))
    logs = reduce(
        lambda a, b: F.zip_with(a, b, lambda x, y: x + F.ln(y)),
        [F.col("_hp"), given(F.col("_of_said")), given(F.col("_of_suffix"))],
        F.col("_ll"),
    )
    fused = evidence.withColumn("_logs", logs).withColumn("_post", normal(F.col("_logs")))
    best = F.array_position("_post", F.array_max("_post")) - 1
    label = F.array(*[F.lit(n) for n in names])
    first = F.get(label, F.array_position("_p", F.array_max("_p")).cast("int") - 1)
    chosen = fused.withColumn("language", F.get(label, best.cast("int"))).withColumn("probability", F.array_max("_post"))
    sure = (F.col("_grams") > 0) & (F.col("language") != UND) & (F.col("probability") >= accept)
    return chosen.select(
        given_id().alias("doc_id"), "language", "probability", sure.alias("accepted"),
        F.when(F.col("_grams") > 0, first).alias("text_language"),
        F.col("_host").alias("host"), F.col("_said").alias("declared"), F.col("_key").alias("text_key"),
    )


def markup_language(html: Column) -> Column:
    """The ``lang`` attribute of the ``html`` element, or an empty string."""
    return F.regexp_extract(F.coalesce(html, F.lit("")), "(?is)<html[^>]*?\\blang\\s*=\\s*[\"']?([a-z-]+)", 1)


def markup_text(html: Column) -> Column:
    """The text between the tags, without scripts, styles and comments."""
    bare = F.regexp_replace(html, "(?is)<(script|style)\\b.*?</\\1\\s*>|<!--.*?-->", " ")
    return F.regexp_replace(F.regexp_replace(bare, "(?s)<[^>]*>", " "), "&[a-zA-Z0-9#]{1,10};", " ")
