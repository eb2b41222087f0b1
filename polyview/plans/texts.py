"""Queries on tokens, vocabularies and the four text views of a document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from polyview.functions import text as X, vectors as V
from polyview.operators import experts, labels, metrics, ranks, routing, tokens, views
from polyview.plans.base import q6, query, r6, table
from polyview.plans.corpora import EXAMPLES_SQL, sentiment
from polyview.plans.order import WORDS_SQL
from polyview.schema import DIMENSIONS, LABEL_TO_ID, SPLIT_SEED
from polyview.session import stored

SHORT, LONG = 64, 2048
HASH_WIDTH = 2**18
N_CLASSES = len(LABEL_TO_ID)

# A stand-in event lexicon of words that occur in the fixtures.
LEXICON = {
    "change": ["from", "for", "with", "by"],
    "holding": ["the", "that", "this", "der"],
    "motion": ["to", "on", "in", "at"],
    "state": ["is", "was", "be", "are"],
}


def worded(spark, sf_dir) -> DataFrame:
    """``doc_id, words`` of all documents, whole texts."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return docs.select("doc_id", X.tokens(F.col("text")).alias("words"))


def token_table(spark, sf_dir) -> DataFrame:
    """The same, tokenised once and stored: the fitted views read it several times."""
    return stored(worded(spark, sf_dir), "words")


WORDED_SQL = f"worded AS (SELECT doc_id, text, {WORDS_SQL} AS words FROM documents)"


@query(
    "tokenise_truncate",
    f"""WITH {WORDED_SQL} SELECT doc_id, len(words)::INTEGER AS n_tokens, array_to_string(words[1:{SHORT}], ' ') AS short,
        array_to_string(words[1:{LONG}], ' ') AS long, md5(array_to_string(words, ' ')) AS whole FROM worded""",
)
def tokenise_truncate(spark, sf_dir):
    words = F.col("words")
    return worded(spark, sf_dir).select(
        "doc_id",
        F.size(words).alias("n_tokens"),
        F.array_join(X.truncate(words, SHORT), " ").alias("short"),
        F.array_join(X.truncate(words, LONG), " ").alias("long"),
        F.md5(F.array_join(X.truncate(words, None), " ")).alias("whole"),
    )


@query(
    "segment_ids",
    f"""WITH {WORDED_SQL} SELECT doc_id, repeat('0', len(words)) AS alone,
        repeat('0', len(words)) || repeat('1', length(lang)) AS paired FROM (SELECT doc_id, lang, words FROM worded JOIN documents USING (doc_id))""",
)
def segment_ids(spark, sf_dir):
    """Segments of a text alone, and of a text followed by a second sequence (here one position per letter of its language)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.size(X.tokens(F.col("text"))).alias("n"), F.length("lang").alias("m"))
    printed = lambda ids: F.array_join(ids.cast("array<string>"), "")
    return docs.select(
        "doc_id",
        printed(X.segment_ids(F.col("n"))).alias("alone"),
        printed(X.segment_ids(F.col("n"), F.col("m"))).alias("paired"),
    )


VOCAB_SQL = f"""{WORDED_SQL}, occurrences AS (
  SELECT doc_id, unnest(words) AS token, generate_subscripts(words, 1) AS pos FROM worded
), counts AS (SELECT token, count(*) AS n FROM occurrences GROUP BY 1
), vocab AS (SELECT token, n, row_number() OVER (ORDER BY n DESC, md5(token), token) + 1 AS token_id FROM counts)"""


@query("vocabulary", f"WITH {VOCAB_SQL} SELECT token, n, token_id FROM vocab")
def vocabulary(spark, sf_dir):
    return tokens.vocabulary(tokens.token_counts(worded(spark, sf_dir), "words")).select("token", "n", "token_id")


@query(
    "vocab_encode",
    f"""WITH {VOCAB_SQL} SELECT doc_id, string_agg(token_id::VARCHAR, ' ' ORDER BY pos) AS ids
    FROM occurrences JOIN vocab USING (token) GROUP BY 1""",
)
def vocab_encode(spark, sf_dir):
    docs = token_table(spark, sf_dir)
    vocab = stored(tokens.vocabulary(tokens.token_counts(docs, "words")), "vocabulary")
    ids = tokens.encode(docs, "doc_id", "words", vocab)
    return ids.select("doc_id", F.array_join(F.col("input_ids").cast("array<string>"), " ").alias("ids"))


@query(
    "vocab_encode_unseen",
    f"""WITH {VOCAB_SQL.replace('FROM worded', "FROM worded WHERE doc_id IN (SELECT doc_id FROM labels)").replace('occurrences', 'known')},
    every AS (SELECT doc_id, unnest(words) AS token, generate_subscripts(words, 1) AS pos FROM worded)
    SELECT doc_id, string_agg(coalesce(token_id, 1)::VARCHAR, ' ' ORDER BY pos) AS ids
    FROM every LEFT JOIN vocab USING (token) GROUP BY 1""",
)
def vocab_encode_unseen(spark, sf_dir):
    """Vocabulary of the labelled documents only; all documents are encoded."""
    docs = token_table(spark, sf_dir)
    known = docs.join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi")
    vocab = stored(tokens.vocabulary(tokens.token_counts(known, "words")), "vocabulary")
    ids = tokens.encode(docs, "doc_id", "words", vocab)
    return ids.select("doc_id", F.array_join(F.col("input_ids").cast("array<string>"), " ").alias("ids"))


@query("last_token", f"WITH {WORDED_SQL} SELECT doc_id, words[-1] AS token FROM worded")
def last_token(spark, sf_dir):
    return worded(spark, sf_dir).select("doc_id", V.last_position(F.col("words")).alias("token"))


# ---------------------------------------------------------------- four views


@query(
    "view_token_stats",
    f"""WITH {WORDED_SQL} SELECT doc_id, len(words)::INTEGER AS n_tokens, len(list_distinct(words))::INTEGER AS n_distinct,
        {q6("CASE WHEN len(words) > 0 THEN length(array_to_string(words, '')) / len(words) ELSE 0 END")} AS mean_length FROM worded""",
)
def view_token_stats(spark, sf_dir):
    stats = X.token_stats(F.col("words"))
    return worded(spark, sf_dir).select(
        "doc_id",
        stats["n_tokens"].alias("n_tokens"),
        stats["n_distinct"].alias("n_distinct"),
        r6(stats["mean_length"]).alias("mean_length"),
    )


@query(
    "view_semantic",
    f"""WITH {WORDED_SQL}, occurrences AS (
      SELECT doc_id, ('0x' || substr(md5(unnest(words)), 1, 8))::BIGINT % {HASH_WIDTH} AS pos FROM worded
    ), tf AS (SELECT doc_id, pos, count(*) AS tf FROM occurrences GROUP BY ALL
    ), frequencies AS (SELECT pos, count(*) AS df FROM tf GROUP BY 1)
    SELECT doc_id, pos, {q6("tf * ln(((SELECT count(*) FROM worded) + 1) / (df + 1))")} AS v FROM tf JOIN frequencies USING (pos)""",
)
def view_semantic(spark, sf_dir):
    rows = tokens.sparse_tf_idf(worded(spark, sf_dir), "doc_id", "words", HASH_WIDTH)
    return rows.select("doc_id", "pos", r6(F.col("v")).alias("v"))


@query(
    "view_numeric",
    f"""SELECT doc_id, len(regexp_extract_all(text, '{X.NUMBER}'))::INTEGER AS n_numbers,
        len(regexp_extract_all(text, '{X.PERCENT}'))::INTEGER AS n_percents, len(regexp_extract_all(text, '[0-9]'))::INTEGER AS n_digits,
        {q6("CASE WHEN length(text) > 0 THEN len(regexp_extract_all(text, '[0-9]')) / length(text) ELSE 0 END")} AS digit_share FROM documents""",
)
def view_numeric(spark, sf_dir):
    features = X.numeric_features(F.col("text"))
    features["digit_share"] = r6(features["digit_share"])
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return docs.select("doc_id", *[v.alias(k) for k, v in features.items()])


@query(
    "view_event",
    f"WITH {WORDED_SQL} SELECT doc_id, "
    + ", ".join(f"len(list_filter(words, lambda w: w IN {tuple(t)}))::INTEGER AS {k}" for k, t in LEXICON.items())
    + " FROM worded",
)
def view_event(spark, sf_dir):
    hits = X.lexicon_hits(F.col("words"), LEXICON)
    return worded(spark, sf_dir).select("doc_id", *[v.alias(k) for k, v in hits.items()])


LABEL_ID_SQL = "CASE output WHEN 'negative' THEN 0 WHEN 'neutral' THEN 1 ELSE 2 END"
ODDS_SQL = f"""{EXAMPLES_SQL}, numbered AS (
  SELECT doc_id, input, {LABEL_ID_SQL} AS y, row_number() OVER (ORDER BY md5('{SPLIT_SEED}:' || doc_id), doc_id) AS r, count(*) OVER () AS total
  FROM examples
), train_words AS (
  SELECT y, unnest(regexp_extract_all(lower(input), '[^ \\t\\n\\r\\f]+')) AS token FROM numbered WHERE r > ceil(total * 0.2::DOUBLE)
), by_class AS (
  SELECT token, count(*) AS n, count(*) FILTER (y = 0) AS n_0, count(*) FILTER (y = 1) AS n_1, count(*) FILTER (y = 2) AS n_2
  FROM train_words GROUP BY 1
), totals AS (SELECT count(*) AS size, sum(n) AS n, sum(n_0) AS n_0, sum(n_1) AS n_1, sum(n_2) AS n_2 FROM by_class
), odds AS (
  SELECT b.token, {', '.join(f'ln((b.n_{c} + 1) / (t.n_{c} + t.size)) - ln((b.n - b.n_{c} + 1) / (t.n - t.n_{c} + t.size)) AS w_{c}' for c in range(3))}
  FROM by_class b, totals t
)"""


def labelled(spark, sf_dir, docs: DataFrame, how: str = "inner") -> DataFrame:
    """The labelled rows of ``docs`` with label id and exact split; by a left join also all others, with NULLs."""
    marks = table(spark, sf_dir, "labels").select(
        "doc_id", labels.label_to_id_strict(sentiment(), LABEL_TO_ID).alias("y")
    )
    marks = marks.join(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", "left_semi")
    return docs.join(ranks.split_exact(marks, ["doc_id"], 0.2, SPLIT_SEED), "doc_id", how)


def fitted_odds(rows: DataFrame) -> DataFrame:
    return tokens.log_odds(rows.where(F.col("split") == "train"), "words", "y", N_CLASSES)


@query(
    "log_odds",
    f"WITH {ODDS_SQL} SELECT token, {', '.join(q6(f'w_{c}') + f' AS w_{c}' for c in range(3))} FROM odds",
)
def log_odds(spark, sf_dir):
    odds = fitted_odds(labelled(spark, sf_dir, token_table(spark, sf_dir)))
    return odds.select("token", *[r6(F.col("w")[c]).alias(f"w_{c}") for c in range(N_CLASSES)])


@query(
    "view_sentiment",
    f"""WITH {ODDS_SQL}, {WORDED_SQL}, occurrences AS (SELECT doc_id, unnest(words) AS token FROM worded)
    SELECT doc_id, {', '.join(q6(f'avg(coalesce(w_{c}, 0))') + f' AS s_{c}' for c in range(3))}
    FROM occurrences LEFT JOIN odds USING (token) GROUP BY 1""",
)
def view_sentiment(spark, sf_dir):
    docs = token_table(spark, sf_dir)
    odds = stored(fitted_odds(labelled(spark, sf_dir, docs)), "log-odds")
    means = tokens.mean_log_odds(docs, "doc_id", "words", odds, N_CLASSES)
    return means.select("doc_id", *[r6(F.col(f"s_{c}")).alias(f"s_{c}") for c in range(N_CLASSES)])


def four_views(spark, sf_dir, how: str = "inner") -> DataFrame:
    """``doc_id, split, y`` and one vector column per dimension, of the labelled documents, or of all by a left join."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = stored(labelled(spark, sf_dir, docs.withColumn("words", X.tokens(F.col("text"))), how), "labelled")
    odds = stored(fitted_odds(rows), "log-odds")
    idf = tokens.fit_idf(rows.where(F.col("split") == "train"), "words", HASH_WIDTH)
    means = tokens.mean_log_odds(rows, "doc_id", "words", odds, N_CLASSES)
    rows = tokens.tf_idf(rows, "words", idf, HASH_WIDTH, "Semantic")
    stats = {**X.numeric_features(F.col("text")), **X.token_stats(F.col("words"))}
    hits = X.lexicon_hits(F.col("words"), LEXICON)
    rows = rows.select("doc_id", "split", "y", "Semantic", *[v.alias(k) for k, v in {**stats, **hits}.items()])
    rows = rows.join(means, "doc_id")
    return rows.select(
        "doc_id",
        "split",
        "y",
        "Semantic",
        views.feature_vector(list(stats)).alias("Math"),
        views.feature_vector(list(hits)).alias("Event"),
        views.feature_vector([f"s_{c}" for c in range(N_CLASSES)]).alias("Sentiment"),
    )


TEXT_WIDTHS = [2, 2, len(LEXICON), N_CLASSES]
TEXT_SHARPNESS, TEXT_K = 20.0, 2
_N = "greatest(len(words), 1)"
TEXT_FEATURES_SQL = [
    f"length(array_to_string(words, '')) / {_N} / 10",
    f"len(list_distinct(words)) / {_N}",
    "CASE WHEN length(text) > 0 THEN len(regexp_extract_all(text, '[0-9]')) / length(text) ELSE 0 END",
    f"len(regexp_extract_all(text, '{X.NUMBER}')) / {_N}",
    *[f"len(list_filter(words, lambda w: w IN {tuple(t)})) / {_N}" for t in LEXICON.values()],
    *[f"s_{c}" for c in range(N_CLASSES)],
]
_EXPERT_SQL = "CASE WHEN i < 2 THEN 0 WHEN i < 4 THEN 1 WHEN i < 8 THEN 2 ELSE 3 END"
ROUTED_TEXT_SQL = f"""WITH {ODDS_SQL}, words AS (
  SELECT doc_id, input AS text, y, r > ceil(total * 0.2::DOUBLE) AS train,
         regexp_extract_all(lower(input), '[^ \\t\\n\\r\\f]+') AS words FROM numbered
), occurrences AS (SELECT doc_id, unnest(words) AS token FROM words
), means AS (
  SELECT doc_id, {', '.join(f'avg(coalesce(w_{c}, 0)) AS s_{c}' for c in range(3))}
  FROM occurrences LEFT JOIN odds USING (token) GROUP BY 1
), wide AS (
  SELECT doc_id, y, train, [{', '.join(f'({f})::DOUBLE' for f in TEXT_FEATURES_SQL)}] AS vec FROM words JOIN means USING (doc_id)
), dims AS (
  SELECT doc_id, y, train, i, {_EXPERT_SQL} AS expert, vec[i + 1] AS v FROM wide, range({sum(TEXT_WIDTHS)}) AS t(i)
), centers AS (SELECT y AS class, i, avg(v) AS c FROM dims WHERE train GROUP BY ALL
), z AS (
  SELECT d.doc_id, d.y, d.expert, k.class, -{TEXT_SHARPNESS}::DOUBLE * sum((d.v - k.c) * (d.v - k.c)) AS z
  FROM dims d JOIN centers k ON d.i = k.i WHERE NOT d.train GROUP BY ALL
), tops AS (SELECT *, z - max(z) OVER (PARTITION BY doc_id, expert) AS below FROM z
), lp AS (
  SELECT doc_id, y, expert, class, below - ln(sum(exp(below)) OVER (PARTITION BY doc_id, expert)) AS lp FROM tops
), h AS (SELECT doc_id, expert, -sum(exp(lp) * lp) AS h FROM lp GROUP BY ALL
), once AS (
  SELECT *, exp(-h) / sum(exp(-h)) OVER (PARTITION BY doc_id) AS w,
         row_number() OVER (PARTITION BY doc_id ORDER BY h, expert) AS place FROM h
), gate AS (
  SELECT doc_id, expert, exp(w) / sum(exp(w)) OVER (PARTITION BY doc_id) AS g FROM once WHERE place <= {TEXT_K}
), fused AS (
  SELECT l.doc_id, l.y, l.class, sum(g.g * l.lp) AS f FROM gate g JOIN lp l ON g.doc_id = l.doc_id AND g.expert = l.expert GROUP BY ALL
) SELECT doc_id, y, class AS pred, {q6('f')} AS score FROM fused
QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY f DESC, class) = 1"""


ROUTED_TEXT_ALL_SQL = (
    ROUTED_TEXT_SQL.replace(
        """SELECT doc_id, input AS text, y, r > ceil(total * 0.2::DOUBLE) AS train,
         regexp_extract_all(lower(input), '[^ \\t\\n\\r\\f]+') AS words FROM numbered""",
        """SELECT doc_id, text, y, coalesce(r > ceil(total * 0.2::DOUBLE), false) AS train,
         regexp_extract_all(lower(text), '[^ \\t\\n\\r\\f]+') AS words FROM documents LEFT JOIN numbered USING (doc_id)""",
    )
    .replace("FROM words JOIN means USING (doc_id)", "FROM words LEFT JOIN means USING (doc_id)")
    .replace("vec[i + 1] AS v", "coalesce(vec[i + 1], 0) AS v")
    .replace(" WHERE NOT d.train", "")
)


def text_features(text: Column, words: Column) -> list[Column]:
    """Semantic, numeric and event features of a text as shares, in view order."""
    n = F.greatest(F.size(words), F.lit(1))
    stats, numeric, hits = X.token_stats(words), X.numeric_features(text), X.lexicon_hits(words, LEXICON)
    shares = [stats["mean_length"] / 10, stats["n_distinct"] / n, numeric["digit_share"], numeric["n_numbers"] / n]
    return [f.cast("double") for f in (*shares, *[hit / n for hit in hits.values()])]


def routed_texts(spark, sf_dir, how: str) -> DataFrame:
    """``doc_id, split, y, pred, score`` by experts fitted on the train split, of the labelled documents, or of all by a left join."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = stored(labelled(spark, sf_dir, docs.withColumn("words", X.tokens(F.col("text"))), how), "labelled")
    means = tokens.mean_log_odds(rows, "doc_id", "words", stored(fitted_odds(rows), "log-odds"), N_CLASSES)
    features = text_features(F.col("text"), F.col("words"))
    rows = rows.select("doc_id", "split", "y", F.array(*features).alias("own")).join(means, "doc_id")
    sentiments = views.feature_vector([f"s_{c}" for c in range(N_CLASSES)])
    rows = stored(rows.select("doc_id", "split", "y", F.concat("own", sentiments).alias("wide")), "views")
    train = rows.where(F.col("split") == "train")
    model = experts.fit_centroids(train, "wide", "y", TEXT_WIDTHS, N_CLASSES, TEXT_SHARPNESS)
    gate = routing.entropy_gate(F.col("decisions"), TEXT_K)
    fused = experts.with_decisions(rows, model, "wide").withColumn("fused", routing.fuse(gate, N_CLASSES))
    return fused.select("doc_id", "split", "y", V.argmax(F.col("fused")).alias("pred"), r6(F.array_max("fused")).alias("score"))


@query("routed_text", ROUTED_TEXT_SQL)
def routed_text(spark, sf_dir):
    """From texts to predictions: four views, one nearest-center expert each, entropy gate, fusion."""
    return routed_texts(spark, sf_dir, "inner").where(F.col("split") == "test").drop("split")


@query("routed_text_all", ROUTED_TEXT_ALL_SQL)
def routed_text_all(spark, sf_dir):
    """The same for every document; ``y`` is NULL without a label."""
    return routed_texts(spark, sf_dir, "left").drop("split")


def learned(spark, sf_dir, how: str = "inner") -> DataFrame:
    """Decisions of one logistic expert per view, for all labelled documents, or for all by a left join."""
    rows = stored(four_views(spark, sf_dir, how), "views")
    train = rows.where(F.col("split") == "train")
    for dimension in DIMENSIONS:
        rows = experts.logistic_lp(rows, experts.fit_logistic(train, dimension, "y"), dimension, f"lp_{dimension}")
    decided = [
        F.struct(V.entropy(F.col(f"lp_{d}")).alias("h"), F.lit(e).alias("expert"), F.col(f"lp_{d}").alias("lp"))
        for e, d in enumerate(DIMENSIONS)
    ]
    return rows.select("doc_id", "split", "y", F.array(*decided).alias("decisions"))


def learned_rows(spark, sf_dir, how: str = "inner") -> DataFrame:
    rows = learned(spark, sf_dir, how).select("doc_id", "split", "y", F.explode("decisions").alias("d"))
    return rows.select("doc_id", "split", "y", F.col("d.expert").alias("expert"), F.col("d.lp").alias("lp"))


@query("expert_logreg")
def expert_logreg(spark, sf_dir):
    rows = learned_rows(spark, sf_dir).where(F.col("split") == "test")
    return rows.select("doc_id", "y", "expert", V.argmax(F.col("lp")).alias("pred"), r6(F.array_max("lp")).alias("lp"))


@query("expert_logreg_all")
def expert_logreg_all(spark, sf_dir):
    """The same for every document; ``y`` is NULL without a label."""
    rows = learned_rows(spark, sf_dir, "left")
    return rows.select("doc_id", "y", "expert", V.argmax(F.col("lp")).alias("pred"), r6(F.array_max("lp")).alias("lp"))


@query(
    "expert_fit_check",
    f"""WITH {ODDS_SQL} SELECT e::INTEGER AS expert, count(*) FILTER (r > ceil(total * 0.2::DOUBLE)) AS n_train,
        count(*) FILTER (r <= ceil(total * 0.2::DOUBLE)) AS n_test, true AS beats_prior
    FROM numbered, range({len(DIMENSIONS)}) AS t(e) GROUP BY 1""",
)
def expert_fit_check(spark, sf_dir):
    """Rows of each fit, and whether its loss on them is no worse than that of the class shares alone."""
    rows = learned_rows(spark, sf_dir)
    train = F.col("split") == "train"
    per_class = rows.groupBy("expert", "y").agg(
        F.count(F.when(train, 1)).alias("n"), F.count(F.when(~train, 1)).alias("m"), F.sum(F.when(train, V.nll(F.col("lp"), F.col("y")))).alias("nll")
    )
    sums = per_class.groupBy("expert").agg(
        F.sum("n").alias("n_train"), F.sum("m").alias("n_test"), F.sum("nll").alias("nll"),
        F.sum(F.when(F.col("n") > 0, F.col("n") * F.ln("n"))).alias("own"),
    )
    prior = F.col("n_train") * F.ln("n_train") - F.col("own")
    return sums.select("expert", "n_train", "n_test", (F.col("nll") <= prior + 1e-6).alias("beats_prior"))


@query("expert_eval")
def expert_eval(spark, sf_dir):
    rows = learned_rows(spark, sf_dir).where(F.col("split") == "test")
    rows = rows.select("expert", "y", V.argmax(F.col("lp")).alias("pred"), V.nll(F.col("lp"), F.col("y")).alias("nll"))
    counted = rows.groupBy("expert", "y", "pred").agg(F.count(F.lit(1)).alias("n"), F.sum("nll").alias("nll"))
    counted = stored(counted, "outcomes")  # labels**2 rows per expert, read by both metrics
    loss = counted.groupBy("expert").agg((F.sum("nll") / F.sum("n")).alias("loss"))
    return metrics.scores(counted, "y", "pred", list(LABEL_TO_ID.values()), ["expert"], weight="n").join(loss, "expert")


def calibrated(spark, sf_dir, how: str) -> DataFrame:
    """Experts fixed: a multinomial fit on the fused log-probabilities of the train rows."""
    gate = routing.entropy_gate(F.col("decisions"), 3)
    rows = stored(learned(spark, sf_dir, how).withColumn("fused", routing.fuse(gate, N_CLASSES)), "fused")
    model = experts.fit_logistic(rows.where(F.col("split") == "train"), "fused", "y")
    mixed = experts.logistic_lp(rows, model, "fused", "mixed")
    return mixed.select(
        "doc_id", "split", "y", V.argmax(F.col("fused")).alias("pred_fused"), V.argmax(F.col("mixed")).alias("pred_mixed"),
        r6(F.when(F.col("y").isNotNull(), V.nll(F.col("mixed"), F.col("y")))).alias("nll"),
    )


@query("mixture_calibrate")
def mixture_calibrate(spark, sf_dir):
    return calibrated(spark, sf_dir, "inner").where(F.col("split") == "test").drop("split")


@query("mixture_calibrate_all")
def mixture_calibrate_all(spark, sf_dir):
    """The same for every document; ``y`` and ``nll`` are NULL without a label."""
    return calibrated(spark, sf_dir, "left").drop("split")
