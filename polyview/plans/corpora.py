"""Queries on sources, label rules, splits, unions and prompts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from polyview.functions import batched, prompts
from polyview.functions.hashing import hex_cut
from polyview.operators import labels, ranks, sets
from polyview.plans.base import q6, query, r6, table
from polyview.schema import PHRASEBANK_CODES, SPLIT_SEED, TWEET_CODES
from polyview.session import scratch_path
from polyview.sources import jsonl, registry
from polyview.sources.registry import TABLES, driver_tables, ingest

EOS = "</s>"
TEST_SIZE = 0.2

SENTIMENT_SQL = "CASE WHEN toxic = 1 THEN 'negative' WHEN quality = 0 THEN 'neutral' ELSE 'positive' END"
EXAMPLES_SQL = f"""
examples AS (
  SELECT d.doc_id, d.text AS input, {SENTIMENT_SQL} AS output
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id
)"""
SPLIT_DOCS_SQL = f"""
split_docs AS (
  SELECT doc_id, text, lang, source, n_chars,
         CASE WHEN substr(md5('{SPLIT_SEED}:' || doc_id), 1, 8) < '{hex_cut(TEST_SIZE)}' THEN 'test' ELSE 'train' END AS split
  FROM documents
)"""


def sentiment() -> Column:
    return (
        F.when(F.col("toxic") == 1, "negative").when(F.col("quality") == 0, "neutral").otherwise("positive")
    )


def examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, input, output`` of the labelled documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    marks = table(spark, sf_dir, "labels")
    return docs.join(marks, "doc_id").select("doc_id", F.col("text").alias("input"), sentiment().alias("output"))


def split_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranks.split_hash(table(spark, sf_dir, "documents"), ["doc_id"], TEST_SIZE, SPLIT_SEED)


# ---------------------------------------------------------------- sources and sinks


@query("scan_registry", " UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n_rows FROM {t}" for t in TABLES))
def scan_registry(spark, sf_dir):
    return driver_tables(spark, sf_dir).row_counts()


@query("scan_corpus", "SELECT doc_id, text, lang, source, n_chars FROM documents")
def scan_corpus(spark, sf_dir):
    return driver_tables(spark, sf_dir).scan("documents")


@query(
    "ingest_corpus",
    f"WITH {SPLIT_DOCS_SQL} SELECT doc_id, text, lang, n_chars, split FROM split_docs",
)
def ingest_corpus(spark, sf_dir):
    docs = split_docs(spark, sf_dir).select("doc_id", "text", "lang", "n_chars", "split")
    path = scratch_path(spark, "corpus")
    ingest(docs, path, partition_by=("split",))
    return ingest(docs, path, partition_by=("split",))  # stored already: nothing is written


@query(
    "jsonl_roundtrip",
    f"""WITH {SPLIT_DOCS_SQL}
    SELECT 'documents' AS dataset, s.split, s.text AS input,
           CASE WHEN l.doc_id IS NOT NULL THEN {SENTIMENT_SQL} END AS output
    FROM split_docs s LEFT JOIN labels l ON s.doc_id = l.doc_id""",
)
def jsonl_roundtrip(spark, sf_dir):
    marks = table(spark, sf_dir, "labels").select("doc_id", sentiment().alias("output"))
    rows = split_docs(spark, sf_dir).join(marks, "doc_id", "left")
    rows = rows.select(F.lit("documents").alias("dataset"), "split", F.col("text").alias("input"), "output")
    path = scratch_path(spark, "examples")
    jsonl.write_examples(rows, path)
    return jsonl.read_examples(spark, path).select("dataset", "split", "input", "output")


LINE_GROUP = (
    T.StructType()
    .add("flag", "string")
    .add("status", "string")
    .add("n_lines", T.LongType())
    .add("quantity", "double")
)
ORDER_DOCUMENT = (
    T.StructType()
    .add("o_orderkey", T.LongType())
    .add("o_orderpriority", "string")
    .add("o_orderstatus", "string")
    .add("events", T.ArrayType(LINE_GROUP))
)
ORDER_DOCS_SQL = """
groups AS (
  SELECT l_orderkey, l_returnflag AS flag, l_linestatus AS status, count(*) AS n_lines, sum(l_quantity) AS quantity
  FROM lineitem GROUP BY ALL
)"""


def order_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with the list of their line groups: at most one entry per flag and status.

    Lines are summed before they are collected, so an order with very many lines
    still holds a handful of entries.
    """
    lines = table(spark, sf_dir, "lineitem")
    groups = lines.groupBy("l_orderkey", F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status")).agg(
        F.count(F.lit(1)).alias("n_lines"), F.sum("l_quantity").alias("quantity")
    )
    lists = groups.groupBy("l_orderkey").agg(
        F.array_sort(F.collect_list(F.struct("flag", "status", "n_lines", "quantity"))).alias("events")
    )
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus")
    return orders.join(lists, F.col("o_orderkey") == F.col("l_orderkey"), "left").drop("l_orderkey")


@query(
    "nested_scan",
    f"""WITH {ORDER_DOCS_SQL}
    SELECT o_orderkey, (row_number() OVER (PARTITION BY o_orderkey ORDER BY flag, status) - 1)::INTEGER AS pos,
           flag, status, n_lines, quantity
    FROM orders JOIN groups ON o_orderkey = l_orderkey""",
)
def nested_scan(spark, sf_dir):
    path = scratch_path(spark, "nested")
    jsonl.write_documents(order_documents(spark, sf_dir), path)
    docs = jsonl.read_documents(spark, path, ORDER_DOCUMENT)
    return docs.select("o_orderkey", F.posexplode("events").alias("pos", "event")).select("o_orderkey", "pos", "event.*")


@query("document_sink", "SELECT doc_id, text FROM documents")
def document_sink(spark, sf_dir):
    path = scratch_path(spark, "documents")
    jsonl.write_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), path)
    return jsonl.read_documents(spark, path, T.StructType.fromDDL("doc_id bigint, text string"))


# ---------------------------------------------------------------- projections and labels


@query("canonicalise", f"WITH {EXAMPLES_SQL} SELECT input, output FROM examples")
def canonicalise(spark, sf_dir):
    return labels.canonicalise(examples(spark, sf_dir).drop("doc_id"))


@query("project_alias", "SELECT conv_id, turn, text AS input, role AS output FROM conversations")
def project_alias(spark, sf_dir):
    names = {"conv_id": "conv_id", "turn": "turn", "input": "text", "output": "role"}
    return labels.project(table(spark, sf_dir, "conversations"), names)


@query(
    "code_to_label",
    """SELECT doc_id, code, CASE code WHEN 0 THEN 'negative' WHEN 1 THEN 'neutral' WHEN 2 THEN 'positive' END AS label_a,
       CASE code WHEN 0 THEN 'negative' WHEN 1 THEN 'positive' WHEN 2 THEN 'neutral' END AS label_b,
       CASE WHEN toxic = 1 THEN CASE code WHEN 0 THEN 'negative' WHEN 1 THEN 'positive' WHEN 2 THEN 'neutral' END
            ELSE CASE code WHEN 0 THEN 'negative' WHEN 1 THEN 'neutral' WHEN 2 THEN 'positive' END END AS label
    FROM (SELECT *, quality + 2 * toxic AS code FROM labels)""",
)
def code_to_label(spark, sf_dir):
    code = F.col("code")
    dataset = F.when(F.col("toxic") == 1, "tweets").otherwise("phrasebank")
    rows = table(spark, sf_dir, "labels").withColumn("code", F.col("quality") + 2 * F.col("toxic"))
    return rows.select(
        "doc_id",
        "code",
        labels.code_to_label(code, PHRASEBANK_CODES).alias("label_a"),
        labels.code_to_label(code, TWEET_CODES).alias("label_b"),
        labels.corpus_code_to_label(dataset, code, {"phrasebank": PHRASEBANK_CODES, "tweets": TWEET_CODES}).alias("label"),
    )


PRIORITIES = {"1-URGENT": 0, "2-HIGH": 1, "3-MEDIUM": 2}


@query(
    "label_to_id",
    """SELECT o_orderkey, o_orderpriority,
       CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 WHEN '3-MEDIUM' THEN 2 END AS label
    FROM orders""",
)
def label_to_id(spark, sf_dir):
    label = labels.label_to_id(F.col("o_orderpriority"), PRIORITIES).alias("label")
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", label)


FLAGS = {"A": 0, "N": 1, "R": 2}


@query(
    "label_to_id_strict",
    """SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber,
       CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 WHEN 'R' THEN 2 END AS label
    FROM lineitem""",
)
def label_to_id_strict(spark, sf_dir):
    label = labels.label_to_id_strict(F.col("l_returnflag"), FLAGS).alias("label")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", label)


@query(
    "unknown_labels",
    """SELECT o_orderpriority, count(*) AS n FROM orders
    WHERE o_orderpriority IS NULL OR o_orderpriority NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM') GROUP BY 1""",
)
def unknown_labels(spark, sf_dir):
    return labels.unknown_labels(table(spark, sf_dir, "orders"), "o_orderpriority", PRIORITIES)


@query(
    "bin_score",
    f"""SELECT event_id, {q6('s')} AS score,
       CASE WHEN s < -0.1 THEN 'negative' WHEN s < 0.1 THEN 'neutral' ELSE 'positive' END AS label
    FROM (SELECT event_id, (value - 50) / 50 AS s FROM events)""",
)
def bin_score(spark, sf_dir):
    score = (F.col("value") - 50) / 50
    events = table(spark, sf_dir, "events")
    return events.select("event_id", r6(score).alias("score"), labels.bin_score(score).alias("label"))


@query("select_split", f"WITH {SPLIT_DOCS_SQL} SELECT doc_id, lang, n_chars FROM split_docs WHERE split = 'test'")
def select_split(spark, sf_dir):
    return labels.select_split(split_docs(spark, sf_dir), "test").select("doc_id", "lang", "n_chars")


@query("path_basename", "SELECT page_id, list_extract(string_split(url, '/'), -1) AS name FROM pages")
def path_basename(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", labels.basename(F.col("url")).alias("name"))


# ---------------------------------------------------------------- unions and splits


@query("union_splits", "SELECT lang AS split, doc_id, n_chars FROM documents")
def union_splits(spark, sf_dir):
    """Every language is stored as a split table of its own; the tables found there are united again."""
    root = scratch_path(spark, "splits")
    registry.store_splits(table(spark, sf_dir, "documents").select("lang", "doc_id", "n_chars"), root, "lang")
    return registry.scan_splits(spark, root)


MERGED = f"substr(md5('{SPLIT_SEED}:' || %s), 1, 8) < '{hex_cut(TEST_SIZE)}'"


@query(
    "merge_corpora",
    f"""SELECT dataset, CASE WHEN test THEN 'test' ELSE 'train' END AS split, input, output FROM (
      SELECT 'documents' AS dataset, {MERGED % 'doc_id'} AS test, text AS input, lang AS output FROM documents
      UNION ALL SELECT 'benchmark', {MERGED % 'item_id'}, text, NULL FROM benchmark
      UNION ALL SELECT 'conversations', {MERGED % "conv_id || ':' || turn"}, text, role FROM conversations)""",
)
def merge_corpora(spark, sf_dir):
    """Each corpus brings its own labels: the merged vocabulary is open, and a corpus without labels has none."""
    sources = {
        "documents": (["doc_id"], F.col("lang")),
        "benchmark": (["item_id"], F.lit(None).cast("string")),
        "conversations": (["conv_id", "turn"], F.col("role")),
    }
    corpora = {
        name: ranks.split_hash(table(spark, sf_dir, name), key, TEST_SIZE, SPLIT_SEED).select(
            "split", F.col("text").alias("input"), label.alias("output")
        )
        for name, (key, label) in sources.items()
    }
    return sets.merge_corpora(corpora).select("dataset", "split", "input", "output")


@query(
    "append_results",
    """SELECT 'documents' AS run, 0 AS pass, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM documents
    UNION ALL SELECT 'events', NULL, count(*), NULL FROM events""",
)
def append_results(spark, sf_dir):
    n = F.count(F.lit(1)).alias("n")
    docs = table(spark, sf_dir, "documents").agg(n, F.sum("n_chars").alias("chars"))
    docs = docs.select(F.lit("documents").alias("run"), F.lit(0).alias("pass"), "n", "chars")
    events = table(spark, sf_dir, "events").agg(n).select(F.lit("events").alias("run"), "n")
    return sets.union_all(docs, events, missing=True)


@query(
    "publish_results",
    """SELECT lang AS run, quality AS pass, count(*) AS n, sum(n_chars)::BIGINT AS chars
    FROM documents LEFT JOIN labels USING (doc_id) GROUP BY ALL""",
)
def publish_results(spark, sf_dir):
    """Results per run and pass, published twice: the second time replaces a stale result and adds nothing."""
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    results = docs.groupBy(F.col("lang").alias("run"), F.col("quality").alias("pass")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars")
    )
    root = scratch_path(spark, "results")
    registry.publish(results.withColumn("n", -F.col("n")), root, ["run", "pass"])
    return registry.publish(results, root, ["run", "pass"])


@query(
    "split_passthrough",
    """SELECT doc_id, CASE lang WHEN 'de' THEN 'test' WHEN 'es' THEN 'test' ELSE 'train' END AS split FROM documents""",
)
def split_passthrough(spark, sf_dir):
    given = F.when(F.col("lang") == "de", "validation").when(F.col("lang") == "es", "test").otherwise("train")
    docs = table(spark, sf_dir, "documents").select("doc_id", given.alias("split"))
    return labels.pass_splits(docs, {"validation": "test"})


@query(
    "split_hash",
    f"""SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber,
       CASE WHEN substr(md5('{SPLIT_SEED}:' || l_orderkey || ':' || l_partkey || ':' || l_suppkey || ':' || l_linenumber), 1, 8)
            < '{hex_cut(TEST_SIZE)}' THEN 'test' ELSE 'train' END AS split
    FROM lineitem""",
)
def split_hash(spark, sf_dir):
    key = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]
    return ranks.split_hash(table(spark, sf_dir, "lineitem").select(*key), key, TEST_SIZE, SPLIT_SEED)


# ---------------------------------------------------------------- prompts


def turn_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user turn with the assistant turn right after it; both sides have unique keys."""
    turns = table(spark, sf_dir, "conversations")
    user = turns.where(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("input"))
    reply = turns.where(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("output")
    )
    return user.join(reply, ["conv_id", "turn"])


PAIRS_SQL = """
pairs AS (
  SELECT u.conv_id, u.turn, u.text AS input, a.text AS output
  FROM conversations u JOIN conversations a ON u.conv_id = a.conv_id AND a.turn = u.turn + 1
  WHERE u.role = 'user' AND a.role = 'assistant'
)"""


def _sql_text(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _sql_prompt(template: str, *fields: str) -> str:
    """SQL text that fills the ``{}`` marks with the given expressions."""
    pieces = template.split("{}")
    out = [_sql_text(pieces[0])]
    for field, piece in zip(fields, pieces[1:], strict=True):
        out += [field, _sql_text(piece)]
    return " || ".join(out)


@query(
    "prompt_train",
    f"WITH {PAIRS_SQL} SELECT conv_id, turn, {_sql_prompt(prompts.PLAIN, 'input', 'output')} || '{EOS}' AS text FROM pairs",
)
def prompt_train(spark, sf_dir):
    text = prompts.train_prompt(F.col("input"), F.col("output"), EOS)
    return turn_pairs(spark, sf_dir).select("conv_id", "turn", text.alias("text"))


_EMPTY = "''"


@query(
    "prompt_infer",
    f"SELECT conv_id, turn, {_sql_prompt(prompts.PLAIN, 'text', _EMPTY)} AS text_infer FROM conversations WHERE role = 'user'",
)
def prompt_infer(spark, sf_dir):
    """Every user turn: a prompt for inference needs no reply."""
    turns = table(spark, sf_dir, "conversations").where(F.col("role") == "user")
    return turns.select("conv_id", "turn", prompts.infer_prompt(F.col("text")).alias("text_infer"))


_ASK = _sql_text(prompts.SENTIMENT_INSTRUCTION)
_EVENT = _sql_text(prompts.EVENT_INSTRUCTION)


@query(
    "prompt_instruct",
    f"""WITH {EXAMPLES_SQL}
    SELECT doc_id, {_sql_prompt(prompts.INSTRUCTED, _ASK, 'input', 'output')} || '{EOS}' AS text,
           {_sql_prompt(prompts.INSTRUCTED, _ASK, 'input', _EMPTY)} AS text_infer,
           {_sql_prompt(prompts.INSTRUCTED, _EVENT, 'input', 'output')} || '{EOS}' AS text_event,
           {_sql_prompt(prompts.INSTRUCTED, _EVENT, 'input', _EMPTY)} AS text_event_infer
    FROM examples""",
)
def prompt_instruct(spark, sf_dir):
    source, target = F.col("input"), F.col("output")
    ask, event = prompts.SENTIMENT_INSTRUCTION, prompts.EVENT_INSTRUCTION
    return examples(spark, sf_dir).select(
        "doc_id",
        prompts.train_prompt(source, target, EOS, ask).alias("text"),
        prompts.infer_prompt(source, ask).alias("text_infer"),
        prompts.train_prompt(source, target, EOS, event).alias("text_event"),
        prompts.infer_prompt(source, event).alias("text_event_infer"),
    )


@query(
    "prompt_record",
    f"""WITH flags AS (
      SELECT l_partkey, l_returnflag AS flag, count(*) AS n FROM lineitem GROUP BY ALL
    ), lists AS (
      SELECT l_partkey, '[' || string_agg('{{"flag":"' || flag || '","n":' || n || '}}', ',' ORDER BY flag) || ']' AS tables
      FROM flags GROUP BY 1
    )
    SELECT p_partkey, {_sql_prompt(prompts.RECORD, 'p_name', "coalesce(tables, 'None')", 'p_partkey', 'p_brand', 'p_type', 'p_size')}
           || '{EOS}' AS text
    FROM part LEFT JOIN lists ON p_partkey = l_partkey""",
)
def prompt_record(spark, sf_dir):
    flags = table(spark, sf_dir, "lineitem").groupBy("l_partkey", F.col("l_returnflag").alias("flag")).agg(
        F.count(F.lit(1)).alias("n")
    )
    lists = flags.groupBy("l_partkey").agg(F.array_sort(F.collect_list(F.struct("flag", "n"))).alias("tables"))
    parts = table(spark, sf_dir, "part").join(lists, F.col("p_partkey") == F.col("l_partkey"), "left")
    text = prompts.record_prompt(
        F.col("p_name"), F.col("tables"), F.col("p_partkey"), F.col("p_brand"), F.col("p_type"), F.col("p_size"), EOS
    )
    return parts.select("p_partkey", text.alias("text"))


_FIRST = ["CASE WHEN l_orderkey IS NOT NULL THEN o_orderkey END", "CASE WHEN l_orderkey IS NOT NULL THEN o_orderstatus END", "flag", "status", "n_lines"]


@query(
    "narrative_nested",
    f"""WITH {ORDER_DOCS_SQL}, firsts AS (
      SELECT l_orderkey, flag, status, n_lines FROM groups
      QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY flag, status) = 1
    )
    SELECT o_orderkey, {_sql_prompt(prompts.NARRATIVE, 'o_orderpriority', *[f"coalesce({c}::VARCHAR, 'None')" for c in _FIRST])} AS text
    FROM orders LEFT JOIN firsts ON o_orderkey = l_orderkey""",
)
def narrative_nested(spark, sf_dir):
    """Every order, in the lenient form: one without lines has ``None`` for what its first line would say."""
    docs = order_documents(spark, sf_dir)
    key, category = F.col("o_orderkey").cast("string"), F.col("o_orderstatus")
    events = F.transform(
        "events",
        lambda e: F.struct(
            key.alias("name"),
            category.alias("category"),
            e["flag"].alias("label_1"),
            e["status"].alias("label_2"),
            e["n_lines"].alias("sentiment"),
        ),
    )
    return docs.select("o_orderkey", prompts.narrative(F.col("o_orderpriority"), events, strict=False).alias("text"))


@query("prompt_identity", f"SELECT item_id, text || '{EOS}' AS text FROM benchmark")
def prompt_identity(spark, sf_dir):
    text = prompts.identity_prompt(F.col("text"), EOS)
    return table(spark, sf_dir, "benchmark").select("item_id", text.alias("text"))


def _compose_batch(batch):
    """Composes characters (Unicode NFC), for which there is no Column function."""
    return batch.assign(text=batch["text"].str.normalize("NFC"))[["item_id", "text"]]


@query("map_batches", "SELECT item_id, nfc_normalize(text) AS text FROM benchmark")
def map_batches(spark, sf_dir):
    return batched.map_batches(table(spark, sf_dir, "benchmark"), _compose_batch, "item_id bigint, text string")


@query(
    "json_props",
    """SELECT event_id, (props::JSON->>'k')::INTEGER AS k, '{"k":' || (props::JSON->>'k') || '}' AS encoded FROM events""",
)
def json_props(spark, sf_dir):
    parsed = F.from_json("props", "k int")
    events = table(spark, sf_dir, "events").select("event_id", parsed.alias("p"))
    return events.select("event_id", F.col("p.k").alias("k"), F.to_json("p").alias("encoded"))

