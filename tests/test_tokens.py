import hashlib
import math
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.ml.feature import HashingTF
from pyspark.sql import functions as F

from polyview.functions import text as X
from polyview.operators import tokens
from tests.helpers import plan

TEXTS = ["the cat the dog", "The bird\tflew\n away", "", "the the the the", "rare words only", "cat dog"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    return rows.select("doc_id", "text", X.tokens(F.col("text")).alias("words")).cache()


def words(text):
    return text.lower().split()


def test_tokens(docs):
    assert [r["words"] for r in docs.orderBy("doc_id").collect()] == [words(t) for t in TEXTS]
    assert docs.select(F.max(F.size(X.truncate(F.col("words"), 2)))).first()[0] == 2


def test_vocabulary_is_ranked_by_count(docs):
    counts = tokens.token_counts(docs, "words")
    rows = tokens.vocabulary(counts).orderBy("token_id").collect()
    want = Counter(w for t in TEXTS for w in words(t))
    assert {r["token"]: r["n"] for r in rows} == want
    assert [r["token_id"] for r in rows] == list(range(2, 2 + len(want)))
    assert [r["n"] for r in rows] == sorted(want.values(), reverse=True)


def test_vocabulary_order_over_the_whole_count_range(spark):
    ns = [1] * 300 + [2] * 50 + list(range(3, 200)) + [10**k for k in range(3, 13)]
    df = spark.createDataFrame([(f"t{i}", n) for i, n in enumerate(ns)], "token string, n long")
    rows = tokens.vocabulary(df).orderBy("token_id").collect()
    assert [r["n"] for r in rows] == sorted(ns, reverse=True)
    assert [r["token_id"] for r in rows] == list(range(2, 2 + len(ns)))


def test_encode_round_trip(docs):
    counts = tokens.token_counts(docs, "words")
    vocab = tokens.vocabulary(counts)
    back = {r["token_id"]: r["token"] for r in vocab.collect()}
    rows = tokens.encode(docs, "doc_id", "words", vocab).orderBy("doc_id").collect()
    assert [[back[i] for i in r["input_ids"]] for r in rows] == [words(t) for t in TEXTS]


def test_unknown_words_share_one_id(docs):
    vocab = tokens.vocabulary(tokens.token_counts(docs.where("doc_id = 0"), "words"))
    rows = tokens.encode(docs, "doc_id", "words", vocab).orderBy("doc_id").collect()
    assert rows[4]["input_ids"] == [tokens.UNKNOWN_ID] * 3
    assert rows[2]["input_ids"] == []


def test_distinct_tokens_keep_every_position(docs):
    rows = tokens.distinct_tokens(docs, "doc_id", "words").collect()
    assert len({(r["doc_id"], r["token"]) for r in rows}) == len(rows)
    placed = {(r["doc_id"], p): r["token"] for r in rows for p in r["positions"]}
    assert placed == {(i, p): w for i, t in enumerate(TEXTS) for p, w in enumerate(words(t))}


def test_joins_carry_distinct_tokens_and_are_keyed(docs):
    vocab = tokens.vocabulary(tokens.token_counts(docs, "words"))
    text = plan(tokens.encode(docs, "doc_id", "words", vocab))
    assert "CartesianProduct" not in text and "NestedLoop" not in text
    assert "Generate" not in text.split("MapInArrow")[0]  # no row per occurrence above the gathering step


def test_null_texts_stay(spark):
    rows = spark.createDataFrame([(0, "a b a"), (1, None)], "doc_id long, text string").select("doc_id", X.tokens(F.col("text")).alias("words"))
    vocab = spark.createDataFrame([("a", 2**40)], "token string, token_id long")
    got = {r["doc_id"]: r["input_ids"] for r in tokens.encode(rows, "doc_id", "words", vocab).collect()}
    assert got == {0: [2**40, tokens.UNKNOWN_ID, 2**40], 1: []}
    weights = spark.createDataFrame([("a", [0.5, 1.0])], "token string, w array<double>")
    means = {r["doc_id"]: (r["s_0"], r["s_1"]) for r in tokens.mean_log_odds(rows, "doc_id", "words", weights, 2).collect()}
    assert means[1] == (0.0, 0.0) and means[0] == pytest.approx((1 / 3, 2 / 3))


def test_log_odds_by_hand(spark, docs):
    labels = spark.createDataFrame([(0, 0), (1, 1), (3, 0), (4, 1), (5, 0)], "doc_id long, y int")
    train = docs.join(labels, "doc_id")
    table = {r["token"]: r["w"] for r in tokens.log_odds(train, "words", "y", 2).collect()}
    y = dict([(0, 0), (1, 1), (3, 0), (4, 1), (5, 0)])
    inside = {c: Counter(w for i, k in y.items() if k == c for w in words(TEXTS[i])) for c in (0, 1)}
    size, total = len(table), {c: sum(inside[c].values()) for c in (0, 1)}

    def odds(w, c):
        o = 1 - c
        return math.log((inside[c][w] + 1) / (total[c] + size)) - math.log((inside[o][w] + 1) / (total[o] + size))

    assert all(table[w] == pytest.approx([odds(w, 0), odds(w, 1)]) for w in table)
    fitted = tokens.log_odds(train, "words", "y", 2)
    means = {r["doc_id"]: (r["s_0"], r["s_1"]) for r in tokens.mean_log_odds(docs, "doc_id", "words", fitted, 2).collect()}
    assert means.keys() == set(range(6)) and means[2] == (0.0, 0.0)
    for i in (0, 1, 3, 4, 5):
        ws = words(TEXTS[i])
        assert means[i][0] == pytest.approx(sum(odds(w, 0) for w in ws) / len(ws))


def test_hashed_tf_idf_by_hand(docs):
    width = 16
    model = tokens.fit_idf(docs, "words", width)
    got = {r["doc_id"]: r["vec"] for r in tokens.tf_idf(docs, "words", model, width, "vec").collect()}
    hashing = HashingTF(numFeatures=width)
    found = [Counter(hashing.indexOf(w) for w in words(t)) for t in TEXTS]
    for i, counts in enumerate(found):
        want = [0.0] * width
        for bucket, n in counts.items():
            df = sum(bucket in other for other in found)
            want[bucket] = n * math.log((len(TEXTS) + 1) / (df + 1))
        assert list(got[i].toArray()) == pytest.approx(want)
    buckets = dict(docs.select(F.explode("words").alias("w")).select("w", tokens.bucket_of(F.col("w"), 64)).distinct().collect())
    assert buckets["the"] == int(hashlib.md5(b"the").hexdigest()[:8], 16) % 64
    sparse = {(r["doc_id"], r["pos"]): r["v"] for r in tokens.sparse_tf_idf(docs, "doc_id", "words", 64).collect()}
    found = [Counter(buckets[w] for w in words(t)) for t in TEXTS]
    assert sparse == pytest.approx({
        (i, b): n * math.log((len(TEXTS) + 1) / (sum(b in other for other in found) + 1)) for i, counts in enumerate(found) for b, n in counts.items()
    })


def test_numeric_and_event_features(spark):
    df = spark.createDataFrame([("up 5.5% and 10% on 3 deals",), ("",)], "t string")
    rows = df.select(*[c.alias(k) for k, c in X.numeric_features(F.col("t")).items()]).collect()
    assert rows[0].asDict() == {"n_numbers": 3, "n_percents": 2, "n_digits": 5, "digit_share": pytest.approx(5 / 26)}
    assert rows[1]["digit_share"] == 0
    hits = df.withColumn("w", X.tokens(F.col("t"))).select(
        *[c.alias(k) for k, c in X.lexicon_hits(F.col("w"), {"a": ["up", "on"], "b": ["no"]}).items()]
    )
    assert [tuple(r) for r in hits.collect()] == [(2, 0), (0, 0)]


def test_gathered_tokens_come_in_bounded_slices():
    lists = [["a", "b", "a"] * 30, [], None, ["c"] * 500, ["a", "c"], ["b"] * 99, ["d"]] * 40
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(lists)), pa.int64()), pa.array(lists, pa.list_(pa.string()))], ["doc_id", "words"])
    out = list(tokens.gathered("doc_id", "words", 100)(iter([batch])))
    assert all(sum(map(len, b.column("positions").to_pylist())) <= 100 or len(set(b.column("doc_id").to_pylist())) == 1 for b in out)
    got = {(r["doc_id"], r["token"]): r["positions"] for b in out for r in b.to_pylist()}
    want = {(i, w): [p for p, x in enumerate(ws) if x == w] for i, ws in enumerate(lists) for w in set(ws or [])}
    assert got == want and sum(b.num_rows for b in out) == len(want)


REPEATED = [(1, "a b a"), (2, "c"), (2, "d d"), (None, "a"), (None, "e b"), (3, ""), (4, None), (5, "b a z"), (2, "")]


@pytest.fixture(scope="module")
def repeated(spark):
    return spark.createDataFrame(REPEATED, "doc_id long, text string").select("doc_id", X.tokens(F.col("text")).alias("words")).cache()


def test_encode_shuffles_words_of_slices(repeated):
    vocab = tokens.vocabulary(tokens.token_counts(repeated.where("doc_id < 5"), "words"))
    ids = dict(vocab.select("token", "token_id").collect())
    merged = {}
    for i, text in REPEATED:
        for p, w in enumerate(words(text or "")):
            merged.setdefault(i, []).append((p, ids.get(w, tokens.UNKNOWN_ID)))
    want = [(i, [x for _, x in sorted(ps)]) for i, ps in merged.items()] + [(i, []) for i, t in REPEATED if not t]
    encoded = tokens.encode(repeated, "doc_id", "words", vocab)
    assert sorted(map(tuple, encoded.collect()), key=str) == sorted(want, key=str)
    assert "CoGroup" in plan(encoded)


def test_tf_idf_counts_a_repeated_key_as_one_text(repeated):
    counts = {}
    for i, text in REPEATED:
        for w in words(text or ""):
            counts.setdefault(i, Counter())[int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % 64] += 1
    met = Counter(b for c in counts.values() for b in c)
    want = {(i, b): n * math.log((len(REPEATED) + 1) / (met[b] + 1)) for i, c in counts.items() for b, n in c.items()}
    rows = tokens.sparse_tf_idf(repeated, "doc_id", "words", 64)
    got = {(r["doc_id"], r["pos"]): r["v"] for r in rows.collect()}
    assert got == pytest.approx(want) and rows.count() == len(want)
    assert "SortMergeJoin" not in plan(rows)  # the frequencies go to the texts, whatever the number of these
