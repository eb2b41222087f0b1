"""Queries on fits by capped gradient steps."""

from __future__ import annotations

from pyspark.sql import functions as F

from polyview.operators import ranks, steps
from polyview.plans.base import q6, query, r6
from polyview.plans.routing import N_CLASSES, split_rows
from polyview.plans.vectors import WIDTHS
from polyview.schema import SPLIT_SEED
from polyview.session import scratch_path, stored

WIDTH = sum(WIDTHS)
MAX_STEPS, RATE = 3, 0.4142135  # a round rate gives first steps that lie halfway between two rounded numbers
BATCH, MINI_STEPS = 64, 4  # the cap ends the fit before the rows do


def _steps_sql(n_steps: int, size: int | None) -> str:
    """The chain of models: every step reads the one before it."""
    batch = f"pos // {size}" if size else "NULL"
    blocks = [
        f"""numbered AS (
  SELECT vec_id, label, embedding, row_number() OVER (ORDER BY md5('{SPLIT_SEED}:' || vec_id), vec_id) - 1 AS pos, count(*) OVER () AS n
  FROM embeddings
), train AS (
  SELECT vec_id, label, embedding, row_number() OVER (ORDER BY pos) - 1 AS pos FROM numbered WHERE pos >= ceil(n * 0.2::DOUBLE)
), x AS MATERIALIZED (
  SELECT vec_id, label, {batch} AS batch, i::INTEGER AS pos, CASE WHEN i < {WIDTH} THEN embedding[i + 1]::DOUBLE ELSE 1 END AS v
  FROM train, range({WIDTH + 1}) AS t(i)
), w0 AS (SELECT c::INTEGER AS class, i::INTEGER AS pos, 0::DOUBLE AS w FROM range({N_CLASSES}) AS a(c), range({WIDTH + 1}) AS b(i))"""
    ]
    for step in range(n_steps):
        mine = f"(SELECT * FROM x WHERE batch = {step})" if size else "x"
        blocks.append(
            f"""z{step} AS (
  SELECT vec_id, label, class, sum(v * w) AS z FROM {mine} JOIN w{step} USING (pos) GROUP BY ALL
), b{step} AS (SELECT *, z - max(z) OVER (PARTITION BY vec_id) AS below FROM z{step}
), l{step} AS MATERIALIZED (SELECT *, below - ln(sum(exp(below)) OVER (PARTITION BY vec_id)) AS lp FROM b{step}
), m{step} AS (SELECT avg(-lp) AS loss FROM l{step} WHERE class = label
), g{step} AS (
  SELECT class, pos, sum((exp(lp) - CASE WHEN class = r.label THEN 1 ELSE 0 END) * v) / count(*) AS g
  FROM {mine} r JOIN l{step} USING (vec_id) GROUP BY ALL
), w{step + 1} AS MATERIALIZED (
  SELECT class, pos, w - {RATE}::DOUBLE * coalesce(g, 0) AS w FROM w{step} LEFT JOIN g{step} USING (class, pos)
)"""
        )
    rows = " UNION ALL ".join(f"SELECT {s + 1} AS step, class, pos, {q6('w')} AS w, {q6('loss')} AS loss FROM w{s + 1}, m{s}" for s in range(n_steps))
    return "WITH " + ", ".join(blocks) + " " + rows


def _train(spark, sf_dir):
    return split_rows(spark, sf_dir).where(F.col("split") == "train").select("vec_id", "y", "embedding")


def _states(spark, state):
    return steps.state_rows(spark, state).select("step", "class", "pos", r6(F.col("w")).alias("w"), r6(F.col("loss")).alias("loss"))


@query("expert_steps", _steps_sql(MAX_STEPS, None))
def expert_steps(spark, sf_dir):
    """Softmax regression over all train rows at once, stopped after ``MAX_STEPS``: the model and its loss after every step."""
    rows = stored(_train(spark, sf_dir), "train")
    state = scratch_path(spark, "fit")
    steps.fit_steps(spark, steps.full_batch(rows), "embedding", "y", N_CLASSES, WIDTH, state, MAX_STEPS, RATE)
    return _states(spark, state)


@query("expert_mini_steps", _steps_sql(MINI_STEPS, BATCH))
def expert_mini_steps(spark, sf_dir):
    """The same over batches in seeded order, where the cap ends the fit before the rows do."""
    numbered = ranks.mini_batches(ranks.seeded_rank(_train(spark, sf_dir), ["vec_id"], SPLIT_SEED), BATCH)
    rows = ranks.step_cap(numbered, MINI_STEPS).repartitionByRange("batch_id").sortWithinPartitions("batch_id")
    rows = stored(rows, "train")
    state = scratch_path(spark, "fit")
    batch_of = lambda step: rows.where(F.col("batch_id") == step)
    steps.fit_steps(spark, batch_of, "embedding", "y", N_CLASSES, WIDTH, state, MINI_STEPS, RATE)
    return _states(spark, state)
