"""Queries on row identity, order, exact splits, batches and padding."""

from __future__ import annotations

from pyspark.sql import functions as F

from polyview.functions import text as X
from polyview.operators import batches, ranks
from polyview.plans.base import query, table
from polyview.schema import GATE_BATCH, SPLIT_SEED
from polyview.session import stored

ROW_SEED = 0
EPOCHS, MAX_STEPS = 3, 150  # passes over the rows, and the cap of a fit on its steps over all of them
WORDS_SQL = "regexp_extract_all(lower(text), '[^ \\t\\n\\r\\f]+')"
ROWS_SQL = f"""
rows AS (
  SELECT doc_id, text, row_number() OVER (ORDER BY md5('{ROW_SEED}:' || doc_id), doc_id) - 1 AS row_id FROM documents
)"""
PADDED_SQL = f"""{ROWS_SQL}, worded AS (
  SELECT row_id, row_id // {GATE_BATCH} AS batch_id, {WORDS_SQL} AS words FROM rows
), padded AS (
  SELECT *, len(words) AS real_len, max(len(words)) OVER (PARTITION BY batch_id) AS padded_len FROM worded
)"""


def numbered(spark, sf_dir):
    return ranks.seeded_rank(table(spark, sf_dir, "documents").select("doc_id"), ["doc_id"], ROW_SEED)


def padded(spark, sf_dir):
    """Words of the whole texts, padded to the longest text of their batch."""
    docs = table(spark, sf_dir, "documents").select("doc_id", X.tokens(F.col("text")).alias("words"))
    lengths = stored(docs.select("doc_id", F.size("words").alias("real_len")), "lengths")  # one number per text, read three times
    rows = ranks.mini_batches(ranks.seeded_rank(lengths, ["doc_id"], ROW_SEED), GATE_BATCH)
    return batches.pad_rows(docs.join(batches.batch_lengths(rows), "doc_id"), "words", F.lit("<pad>"))


@query("global_row_id", f"WITH {ROWS_SQL} SELECT doc_id, row_id FROM rows")
def global_row_id(spark, sf_dir):
    return numbered(spark, sf_dir).select("doc_id", "row_id")


COPY_KEY = ["l_returnflag", "l_linestatus", "l_linenumber"]


@query(
    "global_row_id_copies",
    f"""SELECT l_returnflag, l_linestatus, l_linenumber,
        row_number() OVER (ORDER BY md5('{ROW_SEED}:' || l_returnflag || ':' || l_linestatus || ':' || l_linenumber)) - 1 AS row_id
    FROM lineitem""",
)
def global_row_id_copies(spark, sf_dir):
    """Row ids for a table without a key, where a few rows repeat very often."""
    return ranks.number_copies(table(spark, sf_dir, "lineitem").select(*COPY_KEY), ROW_SEED)


@query("mini_batches", f"WITH {ROWS_SQL} SELECT doc_id, row_id, row_id // {GATE_BATCH} AS batch_id FROM rows")
def mini_batches(spark, sf_dir):
    return ranks.mini_batches(numbered(spark, sf_dir), GATE_BATCH).select("doc_id", "row_id", "batch_id")


def epochs_of(spark, sf_dir):
    """Every document once per epoch, in an order of its own for each."""
    rows = stored(numbered(spark, sf_dir).select("doc_id", "row_id"), "rows")
    return ranks.epoch_batches(rows, rows.count(), EPOCHS, GATE_BATCH, SPLIT_SEED)


#: The grid of the network depends on the number of rows, so the SQL tries all sides as the library does.
_EPOCHS_SQL = f"""WITH RECURSIVE {ROWS_SQL}, total AS (SELECT count(*) AS n, greatest(floor(sqrt(greatest(count(*), 1)))::BIGINT, 1) AS root FROM rows
), grid AS (
  SELECT n, a, (greatest(n, 1) + a - 1) // a AS b FROM (SELECT n, root, unnest(range(root, root + least({ranks.GRIDS}, root // 2 + 1))) AS a FROM total)
  ORDER BY a * ((greatest(n, 1) + a - 1) // a), a LIMIT 1
), sized AS (SELECT row_id, n, a, b FROM rows, grid
), network AS (
  SELECT row_id, n, a, b, e AS epoch,
         (({SPLIT_SEED}::BIGINT * {ranks.FACTORS[0]} + e * {ranks.FACTORS[1]}) % {ranks.PRIME}) AS key, 0 AS turn,
         row_id // b AS l, row_id % b AS r, -1::BIGINT AS done
  FROM sized, range({EPOCHS}) AS t(e)
  UNION ALL
  SELECT row_id, n, a, b, epoch, key, (turn + 1) % {2 * ranks.ROUNDS}, nl, nr,
         CASE WHEN turn = {2 * ranks.ROUNDS - 1} AND nl * b + nr < n THEN nl * b + nr ELSE -1 END
  FROM (
    SELECT *, CASE WHEN turn % 2 = 0 THEN (l + h) % a ELSE l END AS nl, CASE WHEN turn % 2 = 1 THEN (r + h) % b ELSE r END AS nr
    FROM (
      SELECT *, xor(t2, t2 >> 11) % {ranks.PRIME} AS h FROM (
        SELECT *, (xor(t1, t1 >> 13) % {ranks.PRIME} * {ranks.FACTORS[1]} + key + turn) % {ranks.PRIME} AS t2 FROM (
          SELECT *, (CASE WHEN turn % 2 = 0 THEN r ELSE l END * {ranks.FACTORS[0]} + key + turn) % {ranks.PRIME} AS t1
          FROM network WHERE done < 0)))
  )
), batched AS (
  SELECT row_id, epoch::INTEGER AS epoch, done AS position, done // {GATE_BATCH} AS batch_id,
         epoch * ((n + {GATE_BATCH} - 1) // {GATE_BATCH}) + done // {GATE_BATCH} AS step
  FROM network WHERE done >= 0
)"""


@query(
    "epoch_batches",
    f"{_EPOCHS_SQL} SELECT doc_id, epoch, position, batch_id FROM batched JOIN rows USING (row_id)",
)
def epoch_batches(spark, sf_dir):
    """A new order of all rows in every epoch, and their batches."""
    return epochs_of(spark, sf_dir).select("doc_id", "epoch", "position", "batch_id")


@query(
    "step_cap",
    f"{_EPOCHS_SQL} SELECT doc_id, epoch, step FROM batched JOIN rows USING (row_id) WHERE step < {MAX_STEPS}",
)
def step_cap(spark, sf_dir):
    """The rows that a fit sees when it stops after so many batches over all its epochs."""
    # stored: a filter pushed through the rounds of the network would repeat their expressions in one another
    steps = stored(epochs_of(spark, sf_dir).select("doc_id", "epoch", "step"), "steps")
    return ranks.step_cap(steps, MAX_STEPS, "step")


@query("seeded_shuffle", f"SELECT doc_id, md5('{SPLIT_SEED}:' || doc_id) AS shuffle_key FROM documents ORDER BY 2, 1")
def seeded_shuffle(spark, sf_dir):
    return ranks.seeded_shuffle(table(spark, sf_dir, "documents").select("doc_id"), ["doc_id"], SPLIT_SEED)


def _exact_sql(test_size: float) -> str:
    return f"""SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY md5('{SPLIT_SEED}:' || doc_id), doc_id)
               <= ceil(count(*) OVER () * {test_size}::DOUBLE) THEN 'test' ELSE 'train' END AS split FROM documents"""


@query("split_exact", _exact_sql(0.2))
def split_exact(spark, sf_dir):
    return ranks.split_exact(table(spark, sf_dir, "documents").select("doc_id"), ["doc_id"], 0.2, SPLIT_SEED)


@query("split_exact_226", _exact_sql(0.226))
def split_exact_226(spark, sf_dir):
    return ranks.split_exact(table(spark, sf_dir, "documents").select("doc_id"), ["doc_id"], 0.226, SPLIT_SEED)


@query(
    "batch_padding",
    f"""WITH {PADDED_SQL}
    SELECT row_id, batch_id, real_len::INTEGER AS real_len, padded_len::INTEGER AS padded_len,
           md5(array_to_string(words || list_resize(['<pad>'], padded_len - real_len, '<pad>'), ' ')) AS content
    FROM padded""",
)
def batch_padding(spark, sf_dir):
    content = F.md5(F.array_join("words", " "))
    return padded(spark, sf_dir).select("row_id", "batch_id", "real_len", "padded_len", content.alias("content"))


@query(
    "attention_mask",
    f"""WITH {PADDED_SQL}
    SELECT row_id, padded_len::INTEGER AS length, real_len::INTEGER AS ones,
           repeat('1', real_len) || repeat('0', padded_len - real_len) AS mask FROM padded""",
)
def attention_mask(spark, sf_dir):
    mask = F.col("attention_mask")
    return padded(spark, sf_dir).select(
        "row_id",
        F.size(mask).alias("length"),
        F.aggregate(mask, F.lit(0), lambda a, x: a + x).alias("ones"),
        F.array_join(mask.cast("array<string>"), "").alias("mask"),
    )
