"""Sketches, URL reputation, language evidence and license notices."""

import hashlib
import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from polyview.llm import language, licenses, sketches, urls
from tests.helpers import plan
from tests.llm import cases

# ---------------------------------------------------------------- sketches


def shingles(text):
    w = cases.words(text)
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_edited_sketches(spark):
    rows = [(i, " ".join(f"w{(i * 31 + j) % 400}" for j in range(40 * i % 700))) for i in range(1, 30)] + [(3, None), (40, ""), (41, "ß🙂 short"), (None, "a b c d e f g h")]
    key = lambda r: (-(2**63) if r[0] is None else r[0], spark.range(1).select(F.xxhash64(F.lit(r[1] or ""))).first()[0])
    order = sorted(rows, key=key)
    got = sketches.edited_sketches(cases.documents(spark, [*rows, rows[0]], 3), fraction=1.0).collect()
    assert len(got) == len(rows) + 1
    by = {(r.doc_id, r.n_chars): r for r in got}
    for k, (i, t) in enumerate(order):
        text, after = t or "", order[(k + 1) % len(order)][1] or ""
        n = len(text) // 4
        edited = text[:len(text) - n] + after[:n]
        r = by[i, len(text)]
        assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        a, b, c = shingles(text), shingles(edited), shingles(after)
        like = lambda x, y: len(x & y) / len(x | y) if x | y else 1.0
        assert math.isclose(r.near_edited, like(a, b)) and math.isclose(r.near_next, like(a, c))
        assert math.isclose(r.in_edited, len(a & b) / len(a) if a else 1.0)
        assert (r.fingerprint == r.edited_fingerprint) == (a == b)
    assert sketches.edited_sketches(cases.documents(spark, [])).count() == 0


def test_sketches_merge_and_estimate_containment(spark):
    long = " ".join(f"u{i}" for i in range(8000))
    part = " ".join(f"u{i}" for i in range(1000, 2000))
    df = spark.createDataFrame([(long, part, long + " " + part)], "a string, b string, ab string")
    for c in df.columns:
        df = sketches.sketch(df, c, f"s_{c}")
    row = df.select(
        sketches.containment(F.col("s_b"), F.col("s_a")).alias("inside"), sketches.containment(F.col("s_a"), F.col("s_b")).alias("share"),
        sketches.merge(F.col("s_a"), F.col("s_b")).alias("merged"), "s_ab", F.size("s_a").alias("n"),
    ).first()
    assert row.inside == 1.0 and abs(row.share - 1000 / 8000) < 0.05
    assert set(row.merged) <= set(row.s_ab) and len(set(row.s_ab) - set(row.merged)) <= 4  # shingles across the seam
    assert abs(row.n / 7996 - sketches.FRACTION) < 0.02


def test_short_texts_in_long_ones_at_the_production_fraction(spark):
    """A short text that lies whole in a long one is contained in it, or its sample is empty and says nothing."""
    long = " ".join(f"v{i}" for i in range(3000))
    short = [" ".join(f"v{i}" for i in range(k * 12, k * 12 + 8)) for k in range(200)]
    df = spark.createDataFrame([(t, long, t + " end") for t in short], "a string, b string, c string")
    for c in df.columns:
        df = sketches.sketch(df, c, f"s_{c}")
    rows = df.select(
        sketches.containment(F.col("s_a"), F.col("s_b")).alias("inside"), sketches.resemblance(F.col("s_a"), F.col("s_c")).alias("near"),
        sketches.resemblance(F.col("s_a"), F.col("s_a")).alias("same"),
    ).collect()
    inside = [r.inside for r in rows]
    assert set(inside) == {1.0, None} and 0.4 < inside.count(None) / 200 < 0.75  # (7/8)**4 is 0.59
    assert abs(sum(r.near for r in rows) / 200 - 4 / 5) < 0.1 and all(r.same == 1.0 for r in rows)


def test_native_operators_run_no_python(spark):
    docs = cases.documents(spark, [(1, "a b"), (2, "c")])
    pages = spark.createDataFrame([(1, "http://a.com/x")], "page_id long, url string")
    outcomes = pages.select("url", F.lit(True).alias("good"))
    for df in (sketches.edited_sketches(docs), urls.filter_urls(pages, outcomes, [("com/", "allow")])):
        assert not any(word in plan(df) for word in ("Python", "Pandas", "Arrow"))


# ---------------------------------------------------------------- urls

RULES = [("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block")]


def test_url_rules(spark):
    cases_ = [
        ("http://WWW.Example.COM/en/1?x#y", "www.example.com", "/en/1", "www.example.com/en/", "allow"),
        ("http://m.example.com/en/", "m.example.com", "/en/", "example.com/en/", "block"),
        ("http://badexample.com/en/", "badexample.com", "/en/", "com/", "allow"),
        ("http://example.com?q=/en/", "example.com", "", None, "allow"),
        ("http://x.net/es/a", "x.net", "/es/a", "net/es/", "block"),
        ("a://b.org://c/d", "b.org:", "//c/d", None, "allow"),
        ("no scheme", "", "", None, "allow"), (None, "", "", None, "allow"), ("http://", "", "", None, "allow"),
        ("http://É.org/É?", "É.org", "/É", None, "allow"),
    ]
    rows = [(i, c[0], "x", "y") for i, c in enumerate(cases_)]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, _mean string")
    nothing = spark.createDataFrame([], "url string, good boolean")
    got = {r.page_id: tuple(r)[1:5] for r in urls.filter_urls(pages, nothing, RULES).collect()}
    assert got == {i: c[1:] for i, c in enumerate(cases_)}
    assert urls.filter_urls(pages.limit(0), nothing, RULES).count() == 0


def test_reputation_shrinks_and_blocks_on_evidence(spark):
    page = lambda host, n: [(f"http://{host}/{i}",) for i in range(n)]
    good = page("good.a.org", 60) + page("fine.b.org", 40) + page("new.b.org", 1)
    bad = page("bad.a.org", 60) + page("once.b.org", 1)
    outcomes = spark.createDataFrame([(u, True) for u, in good] + [(u, False) for u, in bad] + [("http://good.a.org/n", None)], "url string, good boolean")
    pages = spark.createDataFrame([(1, "http://good.a.org/z"), (2, "http://bad.a.org/z"), (3, "http://once.b.org/z"), (4, "http://never.b.org/")], "page_id long, url string")
    got = {r.page_id: r for r in urls.filter_urls(pages.union(pages), outcomes, []).collect()}
    assert [got[i].verdict for i in (1, 2, 3, 4)] == ["allow", "block", "allow", "allow"]
    assert [got[i].labelled for i in (1, 2, 3, 4)] == [60, 60, 1, 0]
    assert 0 < got[3].posterior_mean < got[4].posterior_mean < 1


def test_registered_domains(spark):
    hosts = {"a.b.co.uk": ("co.uk", "b.co.uk"), "x.y.org": ("org", "y.org"), "org": ("org", "org"), "": ("", "")}
    df = spark.createDataFrame([(h,) for h in hosts], "h string")
    suffix, domain = urls.suffix_and_domain(F.col("h"))
    assert {r.h: (r.s, r.d) for r in df.select("h", suffix.alias("s"), domain.alias("d")).collect()} == hosts


# ---------------------------------------------------------------- language


@pytest.fixture(scope="module")
def model(spark, sf):
    return language.fit_text(spark.read.parquet(f"{sf}/documents.parquet").where("doc_id % 2 = 0"))


def test_held_out_accuracy_of_the_text_model(spark, sf, model):
    held = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id % 2 = 1")
    got = language.identify(held, model).join(held.select("doc_id", "lang"), "doc_id")
    row = got.agg(F.avg((F.col("language") == F.col("lang")).cast("double")).alias("right"), F.avg(F.col("accepted").cast("double")).alias("kept")).first()
    assert row.right > 0.98 and row.kept > 0.98


def test_language_of_edge_cases(spark, model):
    rows = [*cases.edge_rows(), (20, "Русский текст о погоде и природе"), (21, "12345 67890 !!!")]
    got = language.identify(cases.documents(spark, rows), model, declared="lang", host="source").collect()
    assert len(got) == len(rows)
    verdicts = {}
    for r in got:
        verdicts.setdefault(r.doc_id, set()).add(r.accepted)
        assert abs(r.probability) <= 1 + 1e-9
    assert verdicts[3] == verdicts[4] == verdicts[5] == verdicts[20] == verdicts[21] == verdicts[7] == {False}
    assert language.identify(cases.documents(spark, []), model).count() == 0


def test_other_evidence_decides_where_the_text_is_unclear(spark, model):
    german = "und der die das ist von mit auf"
    rows = [(i, german, "de-DE", "a.site.de") for i in range(30)] + [(i, "the of and to in is was for", "en", "b.site.com") for i in range(40, 70)]
    unclear = [(100, "an", "de", "a.site.de"), (101, "an", "en", "b.site.com"), (102, "an", None, None)]
    docs = spark.createDataFrame(rows + unclear, "doc_id long, text string, lang string, host string")
    got = {r.doc_id: r for r in language.identify(docs, model, declared="lang", host="host").collect()}
    assert got[100].language == "de" and got[101].language == "en"
    assert got[100].text_language == got[101].text_language == got[102].text_language


def test_a_rare_language_is_fitted_whole(spark):
    """Of one row in a hundred, on a sample that a global share would leave empty; copies are one text."""
    english = [(i, f"the weather of the day and the number {'abcdefghij'[i % 10] * (i // 10 + 1)}", "en") for i in range(400)]
    rare = [(1000 + i, f"der hund und die katze {'xyzv'[i]}", "de") for i in range(4)] + [(2000 + i, "der hund", "de") for i in range(50)]
    rows = spark.createDataFrame(english + rare, "doc_id long, text string, lang string")
    names, picked = language.fit_texts(rows.select(F.col("lang").alias("_lang"), F.col("text").alias("_text")), 5)
    texts = Counter(r["_lang"] for r in picked.collect())
    assert names == ["de", "en"] and texts == {"de": 5, "en": 5}
    assert {r["_text"] for r in picked.where("_lang = 'de'").collect()} == {t for _, t, n in rare}
    model = language.fit_text(rows, fit_rows=5)
    got = language.identify(rows, model).where("doc_id >= 1000 AND doc_id < 2000").collect()
    assert model[0] == ["de", "en", "und"] and all(r.language == "de" and r.accepted for r in got)


def test_spellings_of_a_label_are_one_language(spark):
    labels = ["en", "EN", "en-US", "en_GB", "De-AT", "UND"]
    rows = spark.createDataFrame([(f"text of the label {i}", lang) for i, lang in enumerate(labels)], "text string, lang string")
    assert language.fit_text(rows)[0] == ["de", "en", "und"]


def test_markup(spark):
    html = "<!DOCTYPE html><HTML class='x' LANG=\"pt-BR\"><script>var a='<b>';</script><!-- c --><p>Ol&aacute; <b>mundo</b></p></html>"
    df = spark.createDataFrame([(html,), (None,)], "h string")
    rows = df.select(language.markup_language(F.col("h")).alias("l"), language.markup_text(F.col("h")).alias("t")).collect()
    assert rows[0].l == "pt-BR" and rows[0].t.split() == ["Ol", "mundo"] and rows[1].l == "" and rows[1].t is None


# ---------------------------------------------------------------- licenses


def test_license_scan(spark):
    apache, mit = licenses.NOTICES["Apache-2.0"][0], licenses.NOTICES["MIT"][0]
    w = apache.split()
    changed = " ".join([*w[:10], "inserted", *w[10:40], "other", *w[41:50], *w[53:]])
    rows = [
        (1, f"é foo {apache} bar"), (2, f"{changed} - {mit}"), (3, None), (4, ""), (5, "Licensed under the"),
        (6, "Released under the MIT License.\n" * 40), (7, "RELEASED under the mit license"), (7, "released under the mit license"),
        (8, "You may obtain a copy of the book at the shop and use it under the terms of the lender."),
    ]
    got = licenses.scan(cases.documents(spark, rows)).collect()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    assert set(by) == {1, 2, 6, 7}
    text = dict(rows)
    one, = by[1]
    assert one.license == "Apache-2.0" and one.coverage == 1.0 and text[1][one.start_char:one.end_char] + "." == apache
    assert sorted((r.license, r.notice) for r in by[2]) == [("Apache-2.0", 0), ("MIT", 2)]
    assert 0.9 < min(r.coverage for r in by[2]) < 1
    assert len(by[6]) == 40 and all(text[6][r.start_char:r.end_char] == "Released under the MIT License" for r in by[6])
    assert Counter(r.license for r in by[7]) == {"MIT": 2}
    assert licenses.scan(cases.documents(spark, [])).count() == 0


def test_deciding_words(spark):
    gpl3 = licenses.NOTICES["GPL-3.0"][0]
    work = "This work is licensed under a Creative Commons Attribution{} License."
    rows = [
        ("GPL-3.0", gpl3), ("GPL-2.0", gpl3.replace("version 3", "version 2")), ("AGPL-3.0", gpl3.replace("GNU General", "GNU Affero General")),
        ("LGPL-3.0", gpl3.replace("GNU General", "GNU Lesser General")), (None, gpl3.replace("version 3", "version 7")),
        ("GPL-2.0", gpl3.replace("version 3", "version 2").replace("program", "library")), ("LGPL-2.0", gpl3.replace("version 3", "version 2").replace("GNU General", "GNU Library General")),
        ("CC-BY-4.0", work.format(" 4.0 International")), ("CC-BY-ND-4.0", work.format("-NoDerivatives 4.0 International")),
        ("CC-BY-3.0", work.format(" 3.0 Unported")), ("CC-BY-NC-SA-2.5", work.format("-NonCommercial-ShareAlike 2.5")), (None, work.format(" 9.0")),
        *((name, licenses.NOTICES[name][0]) for name in ("ISC", "BSD-2-Clause", "BSD-3-Clause", "Unlicense", "CC0-1.0", "LGPL-2.1")),
    ]
    got = licenses.scan(cases.documents(spark, [(i, t) for i, (_, t) in enumerate(rows)])).collect()
    found = {}
    for r in got:
        found.setdefault(r.doc_id, []).append(r.license)
    assert found == {i: [name] for i, (name, _) in enumerate(rows) if name}


def test_alignment_counts_words_through_gaps():
    assert licenses.align([1, 2, 3, 4, 5], [9, 1, 2, 7, 3, 5, 8], -2, 3) == (4, 1, 6)
    assert licenses.align([1, 2], [3, 4], -2, 2)[0] == 0
