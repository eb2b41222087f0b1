"""One query per operator, each over its whole table, and SQL where SQL can say it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from polyview.llm import bpe, exact_dedup, jaccard, language, licenses, negatives, packing, simhash, sketches, spelling, substring, token_files, urls
from polyview.llm.common import table
from polyview.llm.registry import query
from polyview.session import scratch_path


@query(
    "op9_exact_dedup",
    """
    WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents),
    g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text_sha256)
    SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM d JOIN g USING (text_sha256)
    """,
)
def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


@query("op4_simhash_dedup")
def op4_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_dedup(table(spark, sf_dir, "documents"))


@query("op5_substring_dedup")
def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring.substring_dedup(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", "kept_sha256")


@query("op6_byte_bpe")
def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    coded = bpe.decode(bpe.encode(table(spark, sf_dir, "documents"), path), path)
    return coded.select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


@query("op8_packing")
def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.digests(packing.sequences(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")))


@query("op10_token_files")
def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = scratch_path(spark, "tokens")
    path = public_tokenizers.path("word_bpe_49k.json")
    token_files.write_tokens(table(spark, sf_dir, "documents"), target, path, vocabulary=49_408, end=2)
    return token_files.read_tokens(spark, target).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query("op7_scaled_sketches")
def op7_scaled_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketches.edited_sketches(table(spark, sf_dir, "documents"))


RULES = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"))

_STRENGTH = """
    {level}_groups AS (SELECT {level}, sum(n) AS n, sum(good) AS good FROM rated GROUP BY {level}),
    {level}_moments AS (
        SELECT count(*) AS k, sum(n)::DOUBLE AS n, sum(good)::DOUBLE AS good, sum((n * n)::DOUBLE) AS n2,
               sum(n * (good / n) * (good / n)) AS square, sum(n * (good / n) * (1 - good / n)) AS inside
        FROM {level}_groups),
    {level}_parts AS (
        SELECT k, n, (square - good * good / n) / (k - 1) AS b, inside / (n - k) AS w, (n - n2 / n) / (k - 1) AS size
        FROM {level}_moments WHERE k >= 2 AND n > k),
    {level}_alike AS (SELECT (b - w) / nullif(greatest(b + (size - 1) * w, 0), 0) AS alike FROM {level}_parts),
    {level}_pull AS (SELECT coalesce(
        (SELECT CASE WHEN alike > 0 THEN least({high}, greatest({low}, 1 / alike - 1)) ELSE {high} END FROM {level}_alike), {high}) AS pull)"""
_RULE = "WHEN (host = '{name}' OR ends_with(host, '.{name}')) AND starts_with(path, '{start}') THEN '{value}'"


def _rule_sql(value: int) -> str:
    """The rules from the longest on as a CASE; ``value`` picks the rule or its verdict."""
    whens = []
    for rule in sorted(RULES, key=lambda r: (-len(r[0]), r[0])):
        name, slash, start = rule[0].partition("/")
        whens.append(_RULE.format(name=name, start=slash + start, value=rule[value]))
    return f"CASE {' '.join(whens)} END"


URL_SQL = f"""
WITH cut AS (
    SELECT page_id, url, CASE WHEN position('://' IN coalesce(url, '')) > 0
        THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages),
hosted AS (
    SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
           regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
parsed AS (
    SELECT *, array_to_string(list_slice(string_split(host, '.'), -2, -1), '.') AS two, string_split(host, '.')[-1] AS one,
           array_to_string(list_slice(string_split(host, '.'), -3, -1), '.') AS three FROM hosted),
named AS (
    SELECT *, CASE WHEN two IN ({", ".join(f"'{t}'" for t in urls.TWO_LABELS)}) THEN two ELSE one END AS suffix,
           CASE WHEN two IN ({", ".join(f"'{t}'" for t in urls.TWO_LABELS)}) THEN three ELSE two END AS domain FROM parsed),
shown AS (
    SELECT host, suffix, domain, try_cast(nullif(regexp_extract(path, '/([0-9]{{1,18}})(?:[.][a-z]+)?/?$', 1), '') AS BIGINT) AS doc_id FROM named),
rated AS (
    SELECT host, suffix, domain, count(*) AS n, sum(CASE WHEN quality = 1 AND toxic = 0 THEN 1 ELSE 0 END) AS good
    FROM shown JOIN labels USING (doc_id) WHERE (quality = 1 AND toxic = 0) IS NOT NULL GROUP BY host, suffix, domain),
{",".join(_STRENGTH.format(level=x, low=urls.STRENGTH[0], high=urls.STRENGTH[1]) for x in urls.LEVELS)},
overall AS (SELECT (coalesce(sum(good), 0) + 1.0::DOUBLE) / (coalesce(sum(n), 0) + 2.0::DOUBLE) AS mean FROM rated),
hosts AS (SELECT DISTINCT host, suffix, domain FROM named),
of_suffix AS (
    SELECT h.*, (coalesce(g.good, 0) + pull * mean) / (coalesce(g.n, 0) + pull) AS m1
    FROM hosts h LEFT JOIN suffix_groups g USING (suffix), suffix_pull, overall),
of_domain AS (
    SELECT h.*, (coalesce(g.good, 0) + pull * m1) / (coalesce(g.n, 0) + pull) AS m2
    FROM of_suffix h LEFT JOIN domain_groups g USING (domain), domain_pull),
of_host AS (
    SELECT h.host, coalesce(g.n, 0) AS n, coalesce(g.good, 0) + pull * m2 AS a,
           coalesce(g.n, 0) - coalesce(g.good, 0) + pull * (1 - m2) AS b
    FROM of_domain h LEFT JOIN host_groups g USING (host), host_pull),
bounds AS (
    SELECT host, n, a / (a + b) AS mean,
           least(a / (a + b) + sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) * {urls.Z}::DOUBLE, 1.0) AS upper FROM of_host)
SELECT page_id, host, path, {_rule_sql(0)} AS rule,
       coalesce({_rule_sql(1)}, CASE WHEN upper < {urls.FLOOR} THEN 'block' ELSE 'allow' END) AS verdict,
       n::BIGINT AS labelled, round(mean, 6) AS posterior_mean, round(upper, 6) AS upper_bound
FROM named JOIN bounds USING (host)
"""


@query("op2_url_filter", URL_SQL)
def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page shows the document that its path names last; that document's label is the page's outcome."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    shown = F.regexp_extract(urls.host_and_path(F.col("url"))[1], "/([0-9]{1,18})(?:[.][a-z]+)?/?$", 1)
    named = pages.select("url", F.when(shown != "", shown.cast("long")).alias("doc_id")).where(F.col("doc_id").isNotNull())
    good = ((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("good")
    outcomes = named.join(table(spark, sf_dir, "labels").select("doc_id", good), "doc_id").select("url", "good")
    judged = urls.filter_urls(pages, outcomes, RULES)
    return judged.withColumns({c: F.round(c, 6) for c in ("posterior_mean", "upper_bound")})


@query("op1_language_id")
def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus column ``lang`` is what a document declares, its ``source`` the host."""
    docs = table(spark, sf_dir, "documents")
    return language.identify(docs, language.fit_text(docs), declared="lang", host="source")


@query("language_id_pages")
def language_id_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Web pages: the declared language is that of the markup, suffix and host are those of the address."""
    html, url = F.col("html"), F.col("url")
    pages = table(spark, sf_dir, "pages").select(
        "page_id", language.markup_text(html).alias("text"), language.markup_language(html).alias("lang"),
        urls.host_and_path(url)[0].alias("host"),
    )
    model = language.fit_text(table(spark, sf_dir, "documents"))
    found = language.identify(pages, model, doc_id="page_id", declared="lang", host="host")
    return found.withColumnRenamed("doc_id", "page_id").drop("text_key")


@query("op3_license_scan")
def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents")).drop("text_key")


@query("op11_jaccard_join")
def op11_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_join(table(spark, sf_dir, "documents")).drop("text_key")


NEGATIVES_SQL = """
WITH whole AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
           list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
    FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
    SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same,
           list_sum(list_transform(list_zip(a.v, b.v), lambda z: z[1] * z[2]))::BIGINT AS score
    FROM whole a JOIN whole b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
positives AS (
    SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
ranked AS (
    SELECT anchor_id, positive_id, vec_id AS negative_id, positive_score, score AS negative_score,
           row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INT AS rank
    FROM positives JOIN scored USING (anchor_id)
    WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score)
SELECT * FROM ranked WHERE rank <= 5
"""


@query("op12_hard_negatives", NEGATIVES_SQL)
def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vec_id, label = F.col("vec_id"), F.col("label")
    changed = F.when(vec_id % 7 == 0, (label + 1) % 10).otherwise(label)
    return negatives.hard_negatives(table(spark, sf_dir, "embeddings"), vec_id % 100 == 0, label=changed)


@query("op13_spelling_variants")
def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spelling.group_spellings(table(spark, sf_dir, "documents"))
    return found.select("word", "form", "root", "n", "n_near", "form_n")
