"""The five stages against brute force, and the registered queries against their SQL."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from polyview.llm import queries, registry  # noqa: F401
from polyview.session import stored
from tests.llm import cases
from tests.llm.test_dedup import brute, classes, fingerprint
from tools.compare import database, difference


def rows_of(spark, docs):
    return [(r.doc_id, r.text) for r in docs.collect()]


def corpus(spark, sf):
    """Documents of the fixture with planted cases."""
    rng = random.Random(11)
    real = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").where("doc_id < 60").collect()]
    vocabulary = sorted({w for _, t in real for w in t.split() if w.isalpha()})
    passage = " ".join(rng.choice(vocabulary) for _ in range(60))
    fresh = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    near = [rng.choice(vocabulary) for _ in range(400)]
    planted = [(1000, real[3][1]), (1001, real[3][1]), (1002, f"{fresh(50)} {passage} {fresh(40)}"), (1003, f"{passage} {fresh(30)}"),
               (1004, passage), (1005, " ".join(near)), (1006, " ".join([*near[:200], "neu", *near[201:]])), (1007, None), (1008, ""),
               (1009, "текст на другом языке"), (None, fresh(70))]
    return real + planted


def test_stages(spark, sf):
    rows = corpus(spark, sf)
    unlabelled = F.col("doc_id") == 1009
    docs = cases.documents(spark, rows, 3).withColumn("lang", F.when(~unlabelled | F.col("doc_id").isNull(), F.col("lang")))
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language_id", "exact_dedup", "simhash_dedup", "substring_dedup", "packing"]

    docs = stored(stages["language_id"](spark, docs, sf))
    now = rows_of(spark, docs)
    assert docs.columns == columns
    assert Counter(now) == Counter(r for r in rows if r[0] not in (1007, 1008, 1009))

    docs = stored(stages["exact_dedup"](spark, docs, sf))
    largest = {}
    for i, t in now:
        largest[t] = max(largest.get(t, -1), -1 if i is None else i)
    now = [(i, t) for i, t in now if largest[t] == (-1 if i is None else i)]
    assert docs.columns == columns and Counter(rows_of(spark, docs)) == Counter(now)
    assert 1000 not in dict(now) and 1001 in dict(now)

    docs = stored(stages["simhash_dedup"](spark, docs, sf))
    prints = {fingerprint(t) for _, t in now}
    root = classes(prints, [(a, b) for a in prints for b in prints if a < b and (a ^ b).bit_count() <= 4])
    least = {}
    for i, t in now:
        r = root[fingerprint(t)]
        least[r] = min(least.get(r, 10**9), -1 if i is None else i)
    now = [(i, t) for i, t in now if least[root[fingerprint(t)]] == (-1 if i is None else i)]
    assert docs.columns == columns and Counter(rows_of(spark, docs)) == Counter(now)
    assert 1006 not in dict(now) and 1005 in dict(now)

    docs = stored(stages["substring_dedup"](spark, docs, sf))
    want = brute(sorted(now, key=lambda r: -1 if r[0] is None else r[0]))
    after = rows_of(spark, docs)
    assert docs.columns == columns
    assert {i for i, _ in after} == {i for (i, t), v in want.items() if v[0] != v[1] or not v[0]}
    for i, t in after:
        before = dict(now)[i]
        assert cases.sha(" ".join(cases.words(t))) == want[i, before][2]
        assert want[i, before][1] or t == before
    assert 1004 not in dict(after)
    assert all(r.n_chars == len(r.text) for r in docs.where("doc_id >= 1000").collect())

    packed = stages["packing"](spark, docs, sf).collect()
    assert {r.doc_id for r in packed} == {i for i, _ in after}


def test_stages_on_an_empty_table(spark, sf):
    docs = cases.documents(spark, [])
    for _, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, sf))
    assert docs.count() == 0


def test_run(spark, sf):
    got = corpus_pipeline.run(spark, sf)
    assert got.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] and got.count() > 0


@pytest.fixture(scope="module")
def con(sf):
    return database(sf)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_matches_sql(spark, sf, con, name):
    assert difference(registry.QUERIES[name](spark, sf), con, registry.ORACLES[name]) is None


CONTRACTS = {
    "op2_url_filter": ["page_id", "host", "path", "rule", "verdict"],
    "op4_simhash_dedup": ["doc_id", "fingerprint", "component_id"],
    "op5_substring_dedup": ["doc_id", "n_words", "n_removed", "kept_sha256"],
    "op6_byte_bpe": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
    "op7_scaled_sketches": ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
    "op8_packing": ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
    "op9_exact_dedup": ["doc_id", "keep_id", "group_size", "kept", "text_sha256"],
    "op10_token_files": ["doc_id", "start", "n_tokens", "ids_crc32"],
}


@pytest.mark.parametrize("name", sorted(CONTRACTS))
def test_contract_columns(spark, sf, name):
    kinds = {"page_id": "bigint", "doc_id": "bigint", "near_edited": "double", "near_next": "double", "kept": "boolean"}
    longs = {"start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "n_words", "n_removed", "n_tokens", "n_chars", "keep_id", "group_size", "component_id"}
    got = dict(registry.QUERIES[name](spark, sf).dtypes)
    for column in CONTRACTS[name]:
        assert got[column] == kinds.get(column, "bigint" if column in longs else "string")


def test_queries_are_registered():
    names = set(entry.queries())
    assert {f"op{n}" for n in range(1, 11)} == {n.split("_")[0] for n in names if n.startswith("op")}
    assert "pipeline" in names
