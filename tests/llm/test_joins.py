"""The Jaccard join, hard negatives and spelling variants against brute force."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from polyview import session
from polyview.llm import jaccard, negatives, spelling
from polyview.llm.common import id_text
from tests.llm import cases
from tests.llm.test_dedup import classes

LOWER = {c: c + 32 for c in range(65, 91)}


def order(value):
    return -(2**63) if value is None else value


# ---------------------------------------------------------------- Jaccard join


def shingles(text, size):
    words = cases.words((text or "").translate(LOWER))
    return frozenset(tuple(words[i:i + size]) for i in range(max(1, len(words) - size + 1))) if words else frozenset()


def joined(rows, percent=80, size=5):
    sets = [shingles(t, size) for _, t in rows]
    links = []
    for a in range(len(rows)):
        for b in range(a):
            common = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                links.append((a, b))
    root, count = classes(range(len(rows)), links), Counter(i for pair in links for i in pair)
    least = {}
    for a, (i, _) in enumerate(rows):
        least[root[a]] = min(least.get(root[a], 2**63), order(i))
    return Counter((order(i), len(sets[a]), least[root[a]], count[a]) for a, (i, _) in enumerate(rows))


def groups_of_copies():
    """Groups around texts of several lengths, with up to three words changed or the head cut off."""
    rng = random.Random(3)
    out = list(cases.edge_rows())
    for g, n in enumerate([6, 9, 30, 120, 120, 9]):
        base = [f"w{rng.randrange(400)}" for _ in range(n)]
        for c in range(30):
            own = list(base)
            for _ in range(rng.randrange(4)):
                own[rng.randrange(n)] = f"x{rng.randrange(50)}"
            out.append((1000 + 100 * g + c, " ".join(own[rng.randrange(3) if rng.random() < 0.2 else 0:])))
    return out


@pytest.mark.parametrize("options", [
    {}, {"hot": 3, "room": 300, "pivots": 4}, {"hot": 1000, "room": 100, "pivots": 2}, {"hot": 1, "room": 2000, "percent": 60, "size": 2},
])
def test_jaccard_join(spark, options):
    rows = groups_of_copies()
    got = jaccard.jaccard_join(cases.documents(spark, rows, 4), **options).collect()
    want = joined(rows, options.get("percent", 80), options.get("size", 5))
    assert Counter((order(r.doc_id), r.n_shingles, order(r.component_id), r.n_links) for r in got) == want


def test_jaccard_join_of_nothing(spark):
    got = jaccard.jaccard_join(cases.documents(spark, []))
    assert got.count() == 0 and got.columns == ["doc_id", "n_shingles", "component_id", "n_links", "text_key"]
    with pytest.raises(ValueError):
        jaccard.jaccard_join(cases.documents(spark, []), percent=40)


def test_split_regions_hold_every_link_in_the_homes_of_both_ends(spark):
    """Points around several centres, so that homes, windows and the region of the far ones all have rows."""
    rng = np.random.default_rng(4)
    sets = []
    for c in range(12):
        base = rng.integers(1000 * c, 1000 * c + 200, 60, np.uint64)
        sets += [np.unique(np.concatenate([base[rng.random(60) < keep], rng.integers(0, 10**9, 3, np.uint64)])) for keep in rng.uniform(0.4, 1, 25)]
    rows = [(i, len(s), 1, [(7, False, 9.0)], bytearray(s.tobytes())) for i, s in enumerate(sets)]
    kinds = "sid long, n long, rows long, places array<struct<region:long,late:boolean,load:double>>, tokens binary"
    want = Counter()
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            common = len(np.intersect1d(a, b))
            want[i] += i != j and 100 * common >= 80 * (len(a) + len(b) - common)
    points = spark.createDataFrame(rows, kinds)
    found = jaccard.region_links(points, room=500, pivots=5).groupBy("u").agg(F.sum("links").alias("n")).collect()
    assert {r.u: r.n for r in found if r.n} == {i: n for i, n in want.items() if n} and sum(want.values()) > 100


def test_near_copies_are_sent_once_and_short_however_many_pivots_there_are(spark):
    """Two groups of near copies that one region holds: no copy lies in the windows of several pivots, and only what differs is sent."""
    rng = np.random.default_rng(5)
    sets = []
    for c in range(2):
        base = np.unique(rng.integers(0, 2**63, 400, np.uint64))
        own = [base] + [np.concatenate([rng.choice(base, len(base) - e, False), rng.integers(0, 2**63, e, np.uint64)]) for e in rng.integers(1, 30, 60)]
        sets += [np.unique(s) for s in own]
    rows = [(i, len(s), 1 + i % 3, i % 5 == 0, bytearray(s.tobytes()), 9.0, 7, True, 0) for i, s in enumerate(sets)]
    regions = spark.createDataFrame(rows, "sid long, n long, rows long, late boolean, tokens binary, before double, region long, home boolean, base long")
    cells = jaccard.split(regions, 80, 8).collect()
    assert len(cells) <= 2 * len(sets) and sum(r.home for r in cells) == len(sets)
    assert sum(len(r.tokens) for r in cells if r.home) < 0.25 * sum(8 * len(s) for s in sets)
    want = Counter()
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            common = len(np.intersect1d(a, b))
            if i != j and not rows[i][3] * rows[j][3] and 100 * common >= 80 * (len(a) + len(b) - common):
                want[i] += rows[j][2]
    assert 0 < len(want) and max(want.values()) < 3 * len(sets)
    places = F.array(F.struct("region", "late", F.col("before").alias("load")))
    points = regions.select("sid", "n", "rows", places.alias("places"), "tokens")
    for room in (1 << 18, 4000, 500):
        found = jaccard.region_links(points, room=room, pivots=8).groupBy("u").agg(F.sum("links").alias("n")).collect()
        assert {r.u: r.n for r in found if r.n} == want


def test_what_is_read_no_more_is_let_go(spark, monkeypatch):
    """Of the shingles that texts share, of the texts read again and of the cells of split regions nothing is left."""
    monkeypatch.setattr(session, "_written", [])
    kept = session.stored(spark.range(9))
    assert jaccard.jaccard_join(cases.documents(spark, groups_of_copies()), room=100).count() == len(groups_of_copies())
    left = {w.rsplit("/", 1)[-1].rsplit("-", 1)[0] for w in session._written}
    assert {"survey", "sets", "links"} <= left and not left & {"shared", "points", "cells"}
    assert kept.count() == 9


@settings(max_examples=50, deadline=None)
@given(st.lists(st.sets(st.integers(0, 30), min_size=1), min_size=3, max_size=8, unique_by=frozenset), st.integers(50, 100))
def test_sets_coded_against_another_compare_like_the_sets(sets, percent):
    raw = [np.array(sorted(s), np.uint64) for s in sets]
    sizes, ones, early = np.array([len(s) for s in raw]), np.ones(len(raw), np.int64), np.zeros(len(raw), bool)
    want, least = jaccard.compare(raw, sizes, 0, ones, early, None, percent)
    for pivot in raw:
        coded = [np.setxor1d(s, pivot) for s in raw]
        links, reached = jaccard.compare(coded, sizes, len(pivot), ones, early, None, percent)
        assert links.tolist() == want.tolist() and reached.tolist() == least.tolist()


def test_many_rare_shingles_of_a_bucket_do_not_look_frequent(spark):
    """Few texts share a passage, and every bucket has more rare shingles than the passage has texts."""
    rng = random.Random(6)
    passage = " ".join(f"p{i}" for i in range(24))
    texts = [" ".join([*(f"u{rng.randrange(10**9)}" for _ in range(200)), passage if i < 10 else ""]) for i in range(100)]
    rows = id_text(cases.documents(spark, list(enumerate(texts)))).withColumn("_key", F.xxhash64("_text"))
    sets = jaccard.row_sets(rows.toArrow().combine_chunks().to_batches()[0], 5)
    shared = np.intersect1d(*sorted(sets, key=len)[-2:])
    ranks = jaccard.bucket_ranks(rows, 5, share=1, buckets=1 << 10)
    assert len(shared) == 20 and sum(map(len, sets)) > 16 << 10
    first = [jaccard.ordered(s, ranks)[:jaccard.first_part(len(s), 80)] for s in sets]
    assert len(np.unique(np.concatenate(first))) == sum(map(len, first))
    # no more than ``frequent`` shingles are known
    assert np.count_nonzero(jaccard.bucket_ranks(rows, 5, share=1, frequent=19, buckets=1 << 10)) == 0


def test_only_texts_that_may_link_are_read_again(spark):
    keys = [-(2**63), -5, -1, 0, 1, 2**20, 2**63 - 1, 12345]
    table = jaccard.slot_table(
        spark.createDataFrame([(k, v) for k in keys[::2] for v in (1, 7)], "_key long, value int").select(jaccard._slot("_key", 1 << 20).alias("slot"), "value"), 1 << 20
    )
    assert len(table) == 1 << 20 and sorted(table[table > 0].tolist()) == [7] * len({k % 2**20 for k in keys[::2]})
    rows = spark.createDataFrame([(k,) for k in keys], "_key long")
    got = {r._key for r in rows.mapInArrow(jaccard._among(table), rows.schema).collect()}
    assert got == {k for k in keys if k % 2**20 in {x % 2**20 for x in keys[::2]}} and len(got) < len(keys)


@settings(max_examples=100, deadline=None)
@given(st.sets(st.integers(0, 2**64 - 1), max_size=60), st.sets(st.integers(0, 2**64 - 1), max_size=60), st.sets(st.integers(0, 2**64 - 1), max_size=60))
def test_folded_counts_bound_the_intersection(a, b, both):
    x, y = (np.array(sorted(s | both), np.uint64) for s in (a, b))
    assert jaccard.most_common(jaccard.fold(x), jaccard.fold(y)) >= len((a | both) & (b | both))


# ---------------------------------------------------------------- hard negatives


@settings(max_examples=50, deadline=None)
@given(st.integers(1, 40), st.integers(1, 9), st.integers(0, 2**20), st.integers(0, 99))
def test_scores_are_inner_products(rows, anchors, largest, seed):
    rng = np.random.default_rng(seed)
    values, own = rng.integers(-largest, largest + 1, (rows, 16)), rng.integers(-largest, largest + 1, (anchors, 16))
    least, bits, planes = negatives.bit_planes(values)
    assert planes.shape == (bits, 2, rows)
    assert np.array_equal(negatives.scores(negatives.subset_sums(own), own.sum(axis=1), least, planes), values @ own.T)


def vectors():
    """Few distinct values for ties, several widths, NULL ids, labels, vectors and components, rows that repeat."""
    rng = random.Random(5)
    out = []
    for i in range(600):
        v = [rng.choice([-0.5, 0.25, 0.0, 0.125, 1.5]) for _ in range(rng.choice([11, 11, 11, 7, 24, 0]))]
        out.append((i if i % 50 != 3 else None, [float("nan"), *v] if i % 80 == 40 else v, rng.randrange(3) if i % 31 else None))
    out += [out[200]] * 3 + [(5000, None, 1), (5100, [1.0, None], 1), (5200, [float("inf")], 0), (5300, [-0.25] * 3, 9)]
    return out + [(6000 + i, [0.25] * 11, i % 2) for i in range(200)]


def mined(rows):
    sound = [(i, [math.floor(256 * x) for x in v], k) for i, v, k in rows
             if i is not None and k is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, v, k in sound:
        if i % 100:
            continue
        scored = [(-sum(x * y for x, y in zip(v, w)), j, other) for j, w, other in sound]
        for s, p in sorted((s, j) for s, j, other in scored if other == k and j != i)[:5]:
            fits = sorted((t, j) for t, j, other in scored if other != k and 80 * -s <= 100 * -t <= 100 * -s)[:5]
            out += [(i, p, rank, j, -s, -t) for rank, (t, j) in enumerate(fits, 1)]
    return Counter(out)


@pytest.mark.parametrize("block", [4096, 7])
def test_hard_negatives(spark, block):
    rows = vectors()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(5)
    df = df.withColumns({c: F.lit("x") for c in ("_id", "_label", "chunk", "rank")})
    got = negatives.hard_negatives(df, F.col("vec_id") % 100 == 0, block=block).collect()
    assert Counter(map(tuple, got)) == mined(rows)
    assert negatives.hard_negatives(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0


def test_hard_negatives_of_huge_components(spark):
    df = spark.createDataFrame([(0, [1e30], 1)], "vec_id long, embedding array<double>, label int")
    with pytest.raises(Exception, match="lies beyond"):
        negatives.hard_negatives(df, F.lit(True)).collect()


# ---------------------------------------------------------------- spelling variants


def spelt(rows, letters=6, least=5, ratio=5, every=199):
    counts = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            counts[run[:h % len(run)] + run[h % len(run) + 1:] if h % every == 0 else run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= letters and n >= least}
    alphabet = {c for w in words for c in w}
    form, near = {}, {}
    for w, n in words.items():
        edits = {w[:i] + w[i + 1:] for i in range(len(w))}
        edits |= {w[:i] + c + w[j:] for i in range(len(w) + 1) for j in (i, i + 1) if j <= len(w) for c in alphabet}
        near[w] = (edits & words.keys()) - {w}
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best and words[best] >= ratio * n else None

    def root(w):
        return root(form[w]) if form[w] else w

    return Counter((w, n, len(near[w]), form[w], words[form[w]] if form[w] else None, root(w)) for w, n in words.items())


def spellings():
    rng = random.Random(1)
    base = ["".join(rng.choice("abé") for _ in range(rng.randrange(3, 9))) for _ in range(150)]
    base += ["x" * 70, "x" * 71, "x" * 69 + "y", "ÀÉÇÖÜß", "a×÷bcde"]
    out = [r for r in cases.edge_rows() if len(r[1] or "") < 10_000]
    for i in range(200):
        words = []
        for _ in range(rng.randrange(60)):
            w = rng.choice(base[:rng.choice([5, 40, 155])])
            at = rng.randrange(len(w) + 1)
            w = w[:at] + rng.choice("abE") + w[at:] if rng.random() < 0.3 else w
            words.append(w.upper() if rng.random() < 0.1 else w)
        out.append((i if i % 17 else None, rng.choice([" ", "1", "\n", "_"]).join(words)))
    return out


@pytest.mark.parametrize("group, options", [(4096, {}), (20, {"letters": 3, "least": 2, "ratio": 2, "every": 7}), (5, {"letters": 2, "least": 1, "ratio": 3, "every": 3})])
def test_spelling_variants(spark, group, options):
    rows = spellings()
    got = spelling.group_spellings(cases.documents(spark, rows, 3), group=group, **options).collect()
    assert Counter(map(tuple, got)) == spelt(rows, **options)


def test_words_of_many_letters(spark):
    rows = [(i, t) for i, t in enumerate(["x" * 50_000, "x" * 49_999 + "y", "x" * 50_001, "other words"] * 5)]
    got = {(len(r.word), r.n_near) for r in spelling.group_spellings(cases.documents(spark, rows)).collect()}
    assert got == {(50_000, 2), (50_000, 1), (50_001, 1)}


def test_spelling_variants_of_nothing(spark):
    assert spelling.group_spellings(cases.documents(spark, [])).count() == 0
    with pytest.raises(ValueError):
        spelling.group_spellings(cases.documents(spark, []), ratio=1)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text("ab", min_size=4, max_size=4), min_size=1, max_size=70), st.lists(st.text("ab", min_size=4, max_size=5), min_size=1, max_size=70))
def test_one_edit(queries, words):
    for m in (4, 5):
        own = [w for w in words if len(w) == m]
        if not own:
            continue
        codes, alphabet = spelling._letters(queries + own, m)
        a, b = spelling.one_edit(codes[:len(queries)], 4, codes[len(queries):], m, alphabet)
        apart = lambda q, w: sum(x != y for x, y in zip(q, w)) == 1 if m == 4 else any(w[:i] + w[i + 1:] == q for i in range(m))  # noqa: E731, B023
        want = {(i, j) for i, q in enumerate(queries) for j, w in enumerate(own) if apart(q, w)}
        assert set(zip(a.tolist(), b.tolist())) == want and len(a) == len(want)
