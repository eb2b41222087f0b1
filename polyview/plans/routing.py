"""Queries on experts, gates, fusion and sweeps over the embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from polyview.functions import vectors as V
from polyview.operators import experts, metrics, ranks, routing, views
from polyview.operators.experts import CentroidModel
from polyview.operators.labels import ablation_dimensions
from polyview.plans.base import q6, query, r6, table
from polyview.plans.vectors import CATALOG, DIMENSION_SQL, WIDTHS
from polyview.schema import ABLATIONS, GATE_BATCH, SPLIT_SEED
from polyview.session import stored
from polyview.sources import reports

N_EXPERTS, N_CLASSES, K, SHARPNESS = 8, 10, 3, 50.0
LABELS = list(range(N_CLASSES))
W_G = [((3 * c) % 7 - 3) / 4 for c in range(N_CLASSES)]
MIX_W = [[((2 * k + 5 * c) % 7 - 3) / 10 for c in range(N_CLASSES)] for k in range(N_CLASSES)]
MIX_B = [(k % 3 - 1) / 10 for k in range(N_CLASSES)]
MODES = ["vanilla", "entropy", "vanilla_plus_entropy"]

BASE_SQL = f"""
ranked AS (
  SELECT vec_id, label, embedding, row_number() OVER (ORDER BY md5('{SPLIT_SEED}:' || vec_id), vec_id) - 1 AS pos,
         count(*) OVER () AS n FROM embeddings
), parts AS (
  SELECT vec_id, label, embedding, pos, CASE WHEN pos < ceil(n * 0.2::DOUBLE) THEN 'test' ELSE 'train' END AS split
  FROM ranked
), dims AS (
  SELECT vec_id, label, split, pos, (i // 8)::INTEGER AS expert, i % 8 AS d, embedding[i + 1]::DOUBLE AS v
  FROM parts, range(64) AS t(i)
), centers AS (
  SELECT expert, label AS class, d, avg(v) AS c FROM dims WHERE split = 'train' GROUP BY ALL
), z AS (
  SELECT x.vec_id, x.label AS y, x.split, x.pos, x.expert, k.class, -50 * sum((x.v - k.c) * (x.v - k.c)) AS z
  FROM dims x JOIN centers k ON x.expert = k.expert AND x.d = k.d GROUP BY ALL
), tops AS (
  SELECT *, max(z) OVER (PARTITION BY vec_id, expert) AS top FROM z
), lp AS (
  SELECT vec_id, y, split, pos, expert, class, z - top - ln(sum(exp(z - top)) OVER (PARTITION BY vec_id, expert)) AS lp
  FROM tops
), h AS (
  SELECT vec_id, y, split, pos, expert, -sum(exp(lp) * lp) AS h FROM lp GROUP BY ALL
)"""
ENTROPY_SQL = f"""
once AS (
  SELECT *, exp(-h) / sum(exp(-h)) OVER (PARTITION BY vec_id) AS w,
         row_number() OVER (PARTITION BY vec_id ORDER BY h, expert) AS r FROM h
), g_entropy AS (
  SELECT vec_id, y, split, pos, expert, h, r, exp(w) / sum(exp(w)) OVER (PARTITION BY vec_id) AS g FROM once WHERE r <= {K}
)"""
SCORE_SQL = f"""
scored AS (
  SELECT vec_id, y, split, pos, expert, sum(lp * ((3 * class) % 7 - 3) / 4) AS s FROM lp GROUP BY ALL
), ranked_s AS (
  SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, expert) AS r,
         max(s) OVER (PARTITION BY vec_id) AS top FROM scored
), g_score AS (
  SELECT vec_id, y, split, pos, expert, s, r, exp(s - top) / sum(exp(s - top)) OVER (PARTITION BY vec_id) AS g
  FROM ranked_s WHERE r <= {K}
)"""
COMBINED_SQL = """
g_both AS (
  SELECT vec_id, y, split, pos, expert, sum(g) AS g FROM (
    SELECT vec_id, y, split, pos, expert, g FROM g_entropy UNION ALL SELECT vec_id, y, split, pos, expert, g FROM g_score
  ) GROUP BY ALL
)"""


def fused_sql(gate: str, name: str = "fused") -> str:
    return f"""
{name} AS (
  SELECT g.vec_id, g.y, g.split, g.pos, l.class, sum(g.g * l.lp) AS f
  FROM {gate} g JOIN lp l ON g.vec_id = l.vec_id AND g.expert = l.expert GROUP BY ALL
), {name}_pred AS (
  SELECT vec_id, y, split, pos, class AS pred, f AS score FROM {name}
  QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY f DESC, class) = 1
)"""


REFINED_SQL = """
mixed AS (
  SELECT f.vec_id, f.y, f.split, f.pos, k.k AS class, sum(f.f * ((2 * k.k + 5 * f.class) % 7 - 3) / 10) + (k.k % 3 - 1) / 10
         + sum(CASE WHEN f.class = k.k THEN f.f ELSE 0 END) AS z
  FROM fused f, range(10) AS k(k) GROUP BY f.vec_id, f.y, f.split, f.pos, k.k
), mixed_stats AS (
  SELECT vec_id, avg(z) AS mean, var_pop(z) AS var FROM mixed GROUP BY 1
), mixed_norm AS (
  SELECT m.vec_id, m.y, m.split, m.pos, m.class, (m.z - s.mean) / sqrt(s.var + 1e-5) AS z
  FROM mixed m JOIN mixed_stats s ON m.vec_id = s.vec_id
), refined AS (
  SELECT vec_id, y, split, pos, class, z - ln(sum(exp(z)) OVER (PARTITION BY vec_id)) AS lp FROM mixed_norm
)"""


def split_rows(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").withColumnRenamed("label", "y")
    return ranks.split_exact(rows, ["vec_id"], 0.2, SPLIT_SEED)


def fitted(rows) -> CentroidModel:
    train = rows.where(F.col("split") == "train")
    return experts.fit_centroids(train, "embedding", "y", WIDTHS, N_CLASSES, SHARPNESS)


def decided(spark, sf_dir, test_only: bool = False):
    """``vec_id, y, split, decisions`` of all rows, or of the test rows."""
    rows = split_rows(spark, sf_dir)
    model = fitted(rows)
    if test_only:
        rows = rows.where(F.col("split") == "test")
    return experts.with_decisions(rows, model, "embedding").drop("embedding")


def gated(spark, sf_dir, mode: str, test_only: bool = False):
    rows = decided(spark, sf_dir, test_only)
    return rows.withColumn("gate", routing.gate_by_mode(mode, F.col("decisions"), W_G, K))


def routed(spark, sf_dir, mode: str = "entropy", test_only: bool = False):
    rows = gated(spark, sf_dir, mode, test_only)
    return rows.withColumn("fused", routing.fuse(F.col("gate"), N_CLASSES))


def expert_rows(rows):
    """Long form: one row per expert decision."""
    kept = [c for c in rows.columns if c != "decisions"]
    return rows.select(*kept, F.explode("decisions").alias("d")).select(
        *kept, F.col("d.expert").alias("expert"), F.col("d.h").alias("h"), F.col("d.lp").alias("lp")
    )


# ---------------------------------------------------------------- experts and gates


@query("expert_centroid", f"WITH {BASE_SQL} SELECT vec_id, expert, class, {q6('lp')} AS lp, {q6('h')} AS h FROM lp JOIN h USING (vec_id, expert)")
def expert_centroid(spark, sf_dir):
    rows = expert_rows(decided(spark, sf_dir))
    return rows.select("vec_id", "expert", "h", F.posexplode("lp").alias("class", "v")).select(
        "vec_id", "expert", "class", r6(F.col("v")).alias("lp"), r6(F.col("h")).alias("h")
    )


@query(
    "centroid_table",
    f"WITH {BASE_SQL} SELECT class, (expert * 8 + d)::INTEGER AS pos, {q6('c')} AS v FROM centers",
)
def centroid_table(spark, sf_dir):
    train = split_rows(spark, sf_dir).where(F.col("split") == "train")
    centers = experts.centroid_table(train, "embedding", "y")
    return centers.select("class", F.posexplode("center").alias("pos", "v")).select("class", "pos", r6(F.col("v")).alias("v"))


@query(
    "topk_entropy",
    f"WITH {BASE_SQL}, {ENTROPY_SQL} SELECT vec_id, (r - 1)::INTEGER AS place, expert, {q6('h')} AS h FROM g_entropy",
)
def topk_entropy(spark, sf_dir):
    top = routing.top_by_entropy(F.col("decisions"), K)
    rows = decided(spark, sf_dir).select("vec_id", F.posexplode(top).alias("place", "d"))
    return rows.select("vec_id", "place", F.col("d.expert").alias("expert"), r6(F.col("d.h")).alias("h"))


@query(
    "topk_score",
    f"WITH {BASE_SQL}, {SCORE_SQL} SELECT vec_id, (r - 1)::INTEGER AS place, expert, {q6('s')} AS s FROM g_score",
)
def topk_score(spark, sf_dir):
    top = routing.top_by_score(F.col("decisions"), W_G, K)
    rows = decided(spark, sf_dir).select("vec_id", F.posexplode(top).alias("place", "d"))
    return rows.select("vec_id", "place", F.col("d.expert").alias("expert"), r6(-F.col("d.neg")).alias("s"))


def gate_rows(spark, sf_dir, mode):
    rows = gated(spark, sf_dir, mode).select("vec_id", F.explode("gate").alias("x"))
    return rows.select("vec_id", F.col("x.expert").alias("expert"), r6(F.col("x.g")).alias("g"))


@query("gate_score", f"WITH {BASE_SQL}, {SCORE_SQL} SELECT vec_id, expert, {q6('g')} AS g FROM g_score")
def gate_score(spark, sf_dir):
    return gate_rows(spark, sf_dir, "vanilla")


@query("gate_entropy", f"WITH {BASE_SQL}, {ENTROPY_SQL} SELECT vec_id, expert, {q6('g')} AS g FROM g_entropy")
def gate_entropy(spark, sf_dir):
    return gate_rows(spark, sf_dir, "entropy")


@query(
    "gate_entropy_single",
    f"""WITH {BASE_SQL}, {ENTROPY_SQL}
    SELECT vec_id, expert, {q6('w / sum(w) OVER (PARTITION BY vec_id)')} AS g FROM once WHERE r <= {K}""",
)
def gate_entropy_single(spark, sf_dir):
    gate = routing.entropy_gate(F.col("decisions"), K, double=False)
    rows = decided(spark, sf_dir).select("vec_id", F.explode(gate).alias("x"))
    return rows.select("vec_id", F.col("x.expert").alias("expert"), r6(F.col("x.g")).alias("g"))


@query(
    "gate_combined",
    f"WITH {BASE_SQL}, {ENTROPY_SQL}, {SCORE_SQL}, {COMBINED_SQL} SELECT vec_id, expert, {q6('g')} AS g FROM g_both",
)
def gate_combined(spark, sf_dir):
    return gate_rows(spark, sf_dir, "vanilla_plus_entropy")


@query(
    "gate_dense",
    f"""WITH {BASE_SQL}, {ENTROPY_SQL}
    SELECT h.vec_id, h.expert, {q6('coalesce(g.g, 0)')} AS g
    FROM h LEFT JOIN g_entropy g ON h.vec_id = g.vec_id AND h.expert = g.expert""",
)
def gate_dense(spark, sf_dir):
    dense = routing.dense_gate(F.col("gate"), N_EXPERTS)
    rows = gated(spark, sf_dir, "entropy").select("vec_id", F.posexplode(dense).alias("expert", "g"))
    return rows.select("vec_id", "expert", r6(F.col("g")).alias("g"))


# ---------------------------------------------------------------- fusion


@query(
    "fuse_log_probs",
    f"WITH {BASE_SQL}, {ENTROPY_SQL}, {fused_sql('g_entropy')} SELECT vec_id, class, {q6('f')} AS f FROM fused",
)
def fuse_log_probs(spark, sf_dir):
    rows = routed(spark, sf_dir).select("vec_id", F.posexplode("fused").alias("class", "f"))
    return rows.select("vec_id", "class", r6(F.col("f")).alias("f"))


@query(
    "refine_head",
    f"""WITH {BASE_SQL}, {ENTROPY_SQL}, {fused_sql('g_entropy')}, {REFINED_SQL}
    SELECT vec_id, class::INTEGER AS class, {q6('lp')} AS lp FROM refined""",
)
def refine_head(spark, sf_dir):
    refined = routing.refine(F.col("fused"), MIX_W, MIX_B)
    rows = routed(spark, sf_dir).select("vec_id", F.posexplode(refined).alias("class", "lp"))
    return rows.select("vec_id", "class", r6(F.col("lp")).alias("lp"))


ROUTED_SQL = f"""WITH {BASE_SQL}, {ENTROPY_SQL}, {fused_sql('g_entropy')}
SELECT vec_id, y, pred, {q6('score')} AS score FROM fused_pred"""


def predictions(rows):
    return rows.select(
        "vec_id", "y", V.argmax(F.col("fused")).alias("pred"), r6(F.array_max("fused")).alias("score")
    )


@query("routed_predict", f"{ROUTED_SQL} WHERE split = 'test'")
def routed_predict(spark, sf_dir):
    return predictions(routed(spark, sf_dir, test_only=True))


@query("routed_predict_all", ROUTED_SQL)
def routed_predict_all(spark, sf_dir):
    return predictions(routed(spark, sf_dir))


@query(
    "routed_from_long",
    f"{ROUTED_SQL} WHERE split = 'test'",
)
def routed_from_long(spark, sf_dir):
    """The same prediction when each expert's scores lie in rows of their own."""
    rows = split_rows(spark, sf_dir)
    model = fitted(rows)
    flat = rows.where(F.col("split") == "test").withColumn("flat", model.scores(F.col("embedding")))
    scored = experts.expert_scores(F.col("flat"), N_EXPERTS, N_CLASSES)
    long = flat.select("vec_id", "y", F.explode(scored).alias("s")).select("vec_id", "y", "s.expert", "s.z")
    gathered = experts.gather_decisions(long, ["vec_id", "y"])
    gate = routing.entropy_gate(F.col("decisions"), K)
    return predictions(gathered.withColumn("fused", routing.fuse(gate, N_CLASSES)))


@query(
    "expert_usage",
    f"""WITH {BASE_SQL}, {ENTROPY_SQL}, names AS (
      SELECT expert, count(*) AS picked, avg(g) AS mean_gate, avg(h) AS mean_entropy FROM g_entropy GROUP BY 1
    ) SELECT expert, {DIMENSION_SQL} AS dimension, 'view_' || expert AS name, picked,
             {q6('mean_gate')} AS mean_gate, {q6('mean_entropy')} AS mean_entropy FROM names""",
)
def expert_usage(spark, sf_dir):
    rows = gated(spark, sf_dir, "entropy").select(F.explode("gate").alias("x"))
    picked = rows.groupBy(F.col("x.expert").alias("expert")).agg(
        F.count(F.lit(1)).alias("picked"),
        r6(F.avg("x.g")).alias("mean_gate"),
        r6(F.avg(V.entropy(F.col("x.lp")))).alias("mean_entropy"),
    )
    named = views.name_experts(picked, CATALOG)
    return named.select("expert", "dimension", "name", "picked", "mean_gate", "mean_entropy")


# ---------------------------------------------------------------- losses, leaderboards, sweeps


def positioned(rows):
    """Test rows with their batch in seeded order."""
    numbered = ranks.seeded_rank(rows, ["vec_id"], SPLIT_SEED, "pos")
    return ranks.mini_batches(numbered, GATE_BATCH, "pos")


@query(
    "nll_loss",
    f"""WITH {BASE_SQL}, nll AS (
      SELECT expert, pos // {GATE_BATCH} AS batch, -lp AS nll FROM lp WHERE split = 'test' AND class = y
    ), batches AS (SELECT expert, batch, sum(nll) AS s, count(*) AS n, avg(nll) AS m FROM nll GROUP BY ALL)
    SELECT expert, {q6('sum(s) / sum(n)')} AS loss_row_mean, {q6('avg(m)')} AS loss_batch_mean FROM batches GROUP BY 1""",
)
def nll_loss(spark, sf_dir):
    # one number per expert is all that goes through the ranking
    per_expert = F.transform("decisions", lambda d: F.struct(d["expert"].alias("expert"), V.nll(d["lp"], F.col("y")).alias("nll")))
    rows = positioned(decided(spark, sf_dir, test_only=True).select("vec_id", per_expert.alias("losses")))
    rows = rows.select("batch_id", F.explode("losses").alias("x")).select("batch_id", "x.expert", "x.nll")
    losses = metrics.mean_losses(rows, "nll", keys=["expert"])
    return losses.select("expert", r6(F.col("loss_row_mean")).alias("loss_row_mean"), r6(F.col("loss_batch_mean")).alias("loss_batch_mean"))


@query(
    "joint_loss",
    f"""WITH {BASE_SQL}, {ENTROPY_SQL}, {fused_sql('g_entropy')}, {REFINED_SQL}, per_row AS (
      SELECT vec_id, pos // {GATE_BATCH} AS batch, max(CASE WHEN kind = 'm' THEN v END) AS mix,
             sum(CASE WHEN kind = 'e' THEN v END) AS ex
      FROM (SELECT vec_id, pos, 'm' AS kind, -lp AS v FROM refined WHERE split = 'test' AND class = y
            UNION ALL SELECT vec_id, pos, 'e', -lp FROM lp WHERE split = 'test' AND class = y) GROUP BY ALL
    ), batches AS (SELECT batch, avg(mix) AS mix, avg(ex) AS ex FROM per_row GROUP BY 1)
    SELECT {q6('avg(mix)')} AS mixture_loss, {q6('avg(ex)')} AS experts_loss, {q6('avg(mix + ex)')} AS joint_loss,
           {q6('(SELECT avg(mix + ex) FROM batches)')} AS joint_loss_batch_mean
    FROM per_row""",
)
def joint_loss(spark, sf_dir):
    y = F.col("y")
    rows = routed(spark, sf_dir, test_only=True).select(
        "vec_id",
        V.nll(routing.refine(F.col("fused"), MIX_W, MIX_B), y).alias("mix"),
        F.aggregate("decisions", F.lit(0.0), lambda acc, d: acc + V.nll(d["lp"], y)).alias("ex"),
    )
    batches = positioned(rows).groupBy("batch_id").agg(F.sum("mix").alias("mix"), F.sum("ex").alias("ex"), F.count(F.lit(1)).alias("n"))
    both, n = F.col("mix") + F.col("ex"), F.sum("n")
    return batches.agg(
        r6(F.sum("mix") / n).alias("mixture_loss"),
        r6(F.sum("ex") / n).alias("experts_loss"),
        r6(F.sum(both) / n).alias("joint_loss"),
        r6(F.avg(both / F.col("n"))).alias("joint_loss_batch_mean"),
    )


def scores_sql(rows: str, keys: str, truth: str = "y", pred: str = "pred", n_labels: int = N_CLASSES) -> str:
    """CTEs from ``rows`` to ``metric`` with the fields of ``metrics.scores``."""
    return f"""
pairs AS (SELECT {keys}, {truth} AS t, {pred} AS p, count(*) AS n FROM {rows} GROUP BY ALL
), pieces AS (
  SELECT {keys}, t AS label, n AS support, 0 AS predicted, CASE WHEN t = p THEN n ELSE 0 END AS hit FROM pairs
  UNION ALL SELECT {keys}, p, 0, n, 0 FROM pairs
), totals AS (
  SELECT {keys}, label, sum(support) AS support, sum(predicted) AS predicted, sum(hit) AS hit FROM pieces GROUP BY ALL
), f1s AS (
  SELECT *, CASE WHEN support + predicted > 0 THEN 2 * hit / (support + predicted) ELSE 0 END AS f1 FROM totals
), metric AS (
  SELECT {keys}, sum(hit) / sum(support) AS accuracy, avg(f1) AS f1_macro_seen, sum(f1) / {n_labels} AS f1_macro_fixed,
         2 * sum(hit) / sum(support + predicted) AS f1_micro, sum(f1 * support) / sum(support) AS f1_weighted
  FROM f1s GROUP BY ALL
)"""


def whole_sql(keys: str) -> str:
    """CTEs from those of ``scores_sql`` to ``report_text`` and ``matrix_text`` per key."""
    fields = [f"lpad(printf('%.5f', {c}::DOUBLE), 9, ' ')" for c in ("precision", "recall", "f1")]
    line = f"lpad(label, 12, ' ') || '  ' || {" || ' ' || ".join(fields)} || ' ' || lpad(support::VARCHAR, 9, ' ')"
    return f"""
class_lines AS (
  SELECT {keys}, label::VARCHAR AS label, CASE WHEN predicted > 0 THEN hit / predicted ELSE 0 END AS precision,
         CASE WHEN support > 0 THEN hit / support ELSE 0 END AS recall, f1, support FROM f1s
), all_lines AS (
  SELECT {keys}, 0 AS part, label, precision, recall, f1, support FROM class_lines
  UNION ALL SELECT {keys}, 1, 'macro avg', avg(precision), avg(recall), avg(f1), sum(support) FROM class_lines GROUP BY {keys}
  UNION ALL SELECT {keys}, 2, 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support),
                   sum(f1 * support) / sum(support), sum(support) FROM class_lines GROUP BY {keys}
), report_text AS (SELECT {keys}, string_agg({line}, chr(10) ORDER BY part, label) AS report FROM all_lines GROUP BY {keys}
), matrix_lines AS (
  SELECT k.{keys}, t.label AS t, '[' || string_agg(coalesce(n, 0)::VARCHAR, ' ' ORDER BY p.label) || ']' AS line
  FROM (SELECT DISTINCT {keys} FROM pairs) k CROSS JOIN (SELECT DISTINCT label FROM totals) t CROSS JOIN (SELECT DISTINCT label FROM totals) p
  LEFT JOIN pairs x ON x.{keys} = k.{keys} AND x.t = t.label AND x.p = p.label GROUP BY 1, 2
), matrix_text AS (SELECT {keys}, string_agg(line, chr(10) ORDER BY t) AS matrix FROM matrix_lines GROUP BY {keys})"""


METRICS = ["accuracy", "f1_macro_seen", "f1_macro_fixed", "f1_micro", "f1_weighted"]
METRICS_SQL = ", ".join(f"{q6(m)} AS {m}" for m in METRICS)
CLASS_F1_SQL = ", ".join(
    q6(f"coalesce((SELECT f1 FROM f1s f WHERE f.expert = m.expert AND f.label = {c}), 0)") + f" AS f1_{c}" for c in range(N_CLASSES)
)


def rounded(scores, *keys):
    return scores.select(*keys, *[r6(F.col(m)).alias(m) for m in METRICS])


@query(
    "expert_leaderboard",
    f"""WITH {BASE_SQL}, preds AS (
      SELECT vec_id, y, expert, class AS pred FROM lp WHERE split = 'test'
      QUALIFY row_number() OVER (PARTITION BY vec_id, expert ORDER BY lp DESC, class) = 1
    ), {scores_sql('preds', 'expert')}, {whole_sql('expert')}
    SELECT expert, 'view_' || expert AS name, {METRICS_SQL}, {CLASS_F1_SQL}, report, matrix
    FROM metric m JOIN report_text USING (expert) JOIN matrix_text USING (expert)""",
)
def expert_leaderboard(spark, sf_dir):
    rows = expert_rows(decided(spark, sf_dir, test_only=True)).select("y", "expert", V.argmax(F.col("lp")).alias("pred"))
    counted = stored(metrics.pair_counts(rows, "y", "pred", ["expert"]), "pairs")  # labels**2 rows per expert
    whole = views.name_experts(reports.whole_rows(counted, LABELS, ["expert"]), CATALOG)
    numbers = METRICS + [f"f1_{label}" for label in LABELS]
    return whole.select("expert", "name", *[r6(F.col(c)).alias(c) for c in numbers], "report", "matrix")


def _ablated_sql() -> str:
    """One block of CTEs per ablation, then all predictions together."""
    blocks, union = [], []
    for i, (name, dropped) in enumerate(ABLATIONS.items()):
        out = list(CATALOG).index(dropped) if dropped else -1
        blocks.append(
            f"""
h{i} AS (SELECT * FROM h WHERE expert // 2 <> {out} AND split = 'test'
), once{i} AS (
  SELECT *, exp(-h) / sum(exp(-h)) OVER (PARTITION BY vec_id) AS w,
         row_number() OVER (PARTITION BY vec_id ORDER BY h, expert) AS r FROM h{i}
), g{i} AS (
  SELECT vec_id, y, split, pos, expert, exp(w) / sum(exp(w)) OVER (PARTITION BY vec_id) AS g FROM once{i} WHERE r <= {K}
), {fused_sql(f'g{i}', f'fused{i}')}"""
        )
        union.append(f"SELECT '{name}' AS ablation, y, pred FROM fused{i}_pred")
    return ", ".join(blocks) + ", preds AS (" + " UNION ALL ".join(union) + ")"


@query(
    "ablation_sweep",
    f"WITH {BASE_SQL}, {_ablated_sql()}, {scores_sql('preds', 'ablation')} SELECT ablation, {METRICS_SQL} FROM metric",
)
def ablation_sweep(spark, sf_dir):
    """All settings in one pass: each row is decided once and gated once per setting."""
    dimension_of = [dim for dim, names in CATALOG.items() for _ in names]

    def setting(mode):
        kept = [e for e, dim in enumerate(dimension_of) if dim in ablation_dimensions(mode, list(CATALOG))]
        return F.struct(F.lit(mode).alias("ablation"), F.array(*map(F.lit, kept)).alias("kept"))

    def predict(s):
        subset = F.filter("decisions", lambda d: F.array_contains(s["kept"], d["expert"]))
        pred = V.argmax(routing.fuse(routing.entropy_gate(subset, K), N_CLASSES))
        return F.struct(s["ablation"].alias("ablation"), pred.alias("pred"))

    settings = F.array(*[setting(mode) for mode in ABLATIONS])
    rows = decided(spark, sf_dir, test_only=True)
    preds = rows.select("y", F.explode(F.transform(settings, predict)).alias("x")).select("y", "x.*")
    return rounded(metrics.scores(preds, "y", "pred", LABELS, ["ablation"], per_class=False), "ablation")


@query(
    "gate_sweep",
    f"""WITH {BASE_SQL}, {ENTROPY_SQL}, {SCORE_SQL}, {COMBINED_SQL},
    {fused_sql('g_score', 'f_s')}, {fused_sql('g_entropy', 'f_e')}, {fused_sql('g_both', 'f_b')}, preds AS (
      SELECT 'vanilla' AS mode, y, pred FROM f_s_pred WHERE split = 'test'
      UNION ALL SELECT 'entropy', y, pred FROM f_e_pred WHERE split = 'test'
      UNION ALL SELECT 'vanilla_plus_entropy', y, pred FROM f_b_pred WHERE split = 'test'
    ), {scores_sql('preds', 'mode')} SELECT mode, {METRICS_SQL} FROM metric""",
)
def gate_sweep(spark, sf_dir):
    def predict(mode):
        gate = routing.gate_by_mode(mode, F.col("decisions"), W_G, K)
        return F.struct(F.lit(mode).alias("mode"), V.argmax(routing.fuse(gate, N_CLASSES)).alias("pred"))

    rows = decided(spark, sf_dir, test_only=True)
    preds = rows.select("y", F.explode(F.array(*[predict(mode) for mode in MODES])).alias("x")).select("y", "x.*")
    return rounded(metrics.scores(preds, "y", "pred", LABELS, ["mode"], per_class=False), "mode")
