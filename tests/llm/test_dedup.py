"""Exact, near and substring deduplication against brute force."""

from collections import Counter

import numpy as np
import pytest
import xxhash

from polyview.llm import exact_dedup, simhash, substring
from polyview.llm.components import components
from tests.llm import cases


# ---------------------------------------------------------------- exact copies


@pytest.mark.parametrize("counters", [2, 1024])
def test_exact_dedup(spark, counters):
    rows = cases.edge_rows() + [(i, "copied often") for i in range(100, 160)] + [(i, f"text {i % 25}") for i in range(200, 260)]
    got = exact_dedup.exact_dedup(cases.documents(spark, rows, 5), counters=counters).collect()
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    largest = {t: max((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    want = Counter((i, largest[t or ""], len(groups[t or ""]), i == largest[t or ""], cases.sha(t or "")) for i, t in rows)
    assert Counter(map(tuple, got)) == want


def test_exact_dedup_of_nothing(spark):
    assert exact_dedup.exact_dedup(cases.documents(spark, [])).count() == 0


def test_misra_gries_keeps_the_frequent(spark):
    rows = [("hot",)] * 300 + [("warm",)] * 120 + [(str(i),) for i in range(400)]
    df = spark.createDataFrame(rows, "k string").repartition(7)
    assert {"hot", "warm"} <= set(exact_dedup.heavy_keys(df, "k", counters=8))
    assert len(exact_dedup.heavy_keys(df, "k", counters=8)) <= 8


# ---------------------------------------------------------------- near copies


def fingerprint(text):
    words = [w.translate({c: c + 32 for c in range(65, 91)}) for w in cases.words(text)]
    shingles = [" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(keys, linked):
    parent = {k: k for k in keys}

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a, b in linked:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {k: find(k) for k in keys}


def near_texts():
    rng = np.random.default_rng(2)
    out = list(cases.edge_rows())
    for g in range(12):
        base = [f"w{x}" for x in rng.integers(0, 500, 120)]
        for c in range(6):
            own = list(base)
            for at in rng.integers(0, 120, c // 2):
                own[at] = "changed"
            out.append((1000 + 10 * g + c, " ".join(own)))
    return out


def test_simhash_dedup(spark):
    rows = near_texts()
    got = simhash.simhash_dedup(cases.documents(spark, rows, 3)).collect()
    prints = {fingerprint(t) for _, t in rows}
    linked = [(a, b) for a in prints for b in prints if a < b and (a ^ b).bit_count() <= 4]
    root = classes(prints, linked)
    least = {}
    for i, t in rows:
        r = root[fingerprint(t)]
        least[r] = min(least.get(r, 10**9), -1 if i is None else i)
    name = lambda t: None if least[root[fingerprint(t)]] == -1 else least[root[fingerprint(t)]]
    assert linked
    assert Counter(tuple(r)[:3] for r in got) == Counter((i, f"{fingerprint(t):016x}", name(t)) for i, t in rows)
    assert simhash.simhash_dedup(cases.documents(spark, [])).count() == 0


def test_anchors_cover_every_pair_within_the_distance():
    rng = np.random.default_rng(4)
    base = rng.integers(0, 2**64, 3000, np.uint64, endpoint=False)
    other = base.copy()
    for n in range(len(base)):
        for bit in rng.choice(64, rng.integers(1, 5), replace=False):
            other[n] ^= np.uint64(1 << int(bit))
    near_of, second_of = simhash._make_code()
    assert all(int(v ^ near_of[v]).bit_count() <= 1 for v in range(0, 1 << 15, 7))
    row_a, key_a, home_a = simhash.anchors(base)
    row_b, key_b, _ = simhash.anchors(other)
    homes = {(r, k) for r, k, h in zip(row_a.tolist(), key_a.tolist(), home_a) if h}
    met = {r for r, k in zip(row_b.tolist(), key_b.tolist()) if (r, k) in homes}
    assert met == set(range(len(base)))
    assert len(row_a) / len(base) < 31


@pytest.mark.parametrize("tile", [3, 4096])
def test_links_of_a_crowded_anchor(spark, tile):
    """Many fingerprints around one: tiles of an anchor lose no link."""
    rng = np.random.default_rng(5)
    centre = int(rng.integers(0, 2**62))
    prints = {centre}
    while len(prints) < 80:
        prints.add(centre ^ sum(1 << int(b) for b in rng.choice(64, 6, replace=False)))
    prints |= {int(x) for x in rng.integers(0, 2**62, 50)}
    signed = [(p - 2**64 if p >= 2**63 else p,) for p in prints]
    df = spark.createDataFrame(signed, "_fp long")
    edges = components(simhash.simhash_links(df, tile=tile), "u", "v").collect()
    got = {}
    for r in edges:
        got.setdefault(r["root"], set()).add(r["node"] % 2**64)
    root = classes(prints, [(a, b) for a in prints for b in prints if a < b and (a ^ b).bit_count() <= 4])
    want = {}
    for p, r in root.items():
        want.setdefault(r, set()).add(p)
    assert sorted(map(sorted, got.values())) == sorted(sorted(g) for g in want.values() if len(g) > 1)


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(200, 201), (201, 200), (5, 5)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 140)}, 200: 200, 201: 200}
    assert components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


# ---------------------------------------------------------------- repeated passages


def brute(rows, window=20):
    """Documents by id; rows that repeat id and text are one document."""
    seen, out = set(), {}
    for i, t in rows:
        w = cases.words(t)
        gone = [False] * len(w)
        for p in range(len(w) - window + 1):
            part = tuple(w[p:p + window])
            if part in seen:
                gone[p:p + window] = [True] * window
            seen.add(part)
        out[i, t] = (len(w), sum(gone), cases.sha(" ".join(x for x, g in zip(w, gone) if not g)))
    return out


@pytest.mark.parametrize("parts", [1, 4])
def test_substring_dedup(spark, parts):
    rows = cases.passages(90, 3)
    want = brute(rows)
    got = substring.substring_dedup(cases.documents(spark, rows, parts)).collect()
    assert {(r.doc_id): (r.n_words, r.n_removed, r.kept_sha256) for r in got} == {i: v for (i, _), v in want.items()}
    assert sum(v[1] for v in want.values()) > 500
    texts = dict(rows)
    for r in got:
        gone = [p for s in r.spans for p in range(s.start, s.end)]
        assert len(gone) == r.n_removed and all(s.end - s.start >= 20 for s in r.spans)
        left = [w for p, w in enumerate(cases.words(texts[r.doc_id])) if p not in set(gone)]
        assert (r.kept_text or " ".join(left)) == " ".join(left) and (r.kept_text is None) == (not gone)


def test_substring_dedup_of_edge_cases(spark):
    rows = cases.edge_rows() + [(None, " ".join(f"n{i}" for i in range(25))), (9, " ".join(f"n{i}" for i in range(25)))]
    got = substring.substring_dedup(cases.documents(spark, rows)).collect()
    assert len(got) == len(rows)
    by_id = {}
    for r in got:
        by_id.setdefault(r.doc_id, set()).add((r.n_words, r.n_removed))
    assert by_id[9] == {(25, 25)} and (25, 0) in by_id[None]
    assert by_id[2] == {(6, 0), (5, 0)} and by_id[3] == by_id[4] == by_id[5] == {(0, 0)}
    assert by_id[6] == {(30_000, 30_000 - 997)}  # the first period stays
    assert substring.substring_dedup(cases.documents(spark, [])).count() == 0
