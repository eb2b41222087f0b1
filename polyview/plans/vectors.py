"""Queries on expert views and row-local vector arithmetic."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from polyview.functions import vectors as V
from polyview.operators import experts, labels, views
from polyview.operators.ranks import split_hash
from polyview.plans.base import q6, query, r6, table
from polyview.schema import DIMENSIONS
from polyview.session import scratch_path
from polyview.sources import views as stored_views

WIDTHS = [8] * 8
SCALE = 10.0  # spreads the unit vectors, so that softmax rows differ
CATALOG = views.numbered_catalog({dimension: 2 for dimension in DIMENSIONS}, "view_")
DIMENSION_SQL = "list_extract(['Semantic', 'Math', 'Event', 'Sentiment'], (expert // 2 + 1)::BIGINT)"
WEIGHT = [[((3 * k + 2 * d) % 7 - 3) / 10 for d in range(8)] for k in range(3)]
BIAS = [(k - 1) / 4 for k in range(3)]

LONG_SQL = f"""
long AS (
  SELECT vec_id, (i // 8)::INTEGER AS expert, (i % 8)::INTEGER AS pos, embedding[i + 1]::DOUBLE AS v
  FROM embeddings, range(64) AS t(i)
), scaled AS (SELECT vec_id, expert, pos, v * {SCALE}::DOUBLE AS v FROM long)"""
SOFT_SQL = f"""{LONG_SQL}, norm AS (
  SELECT vec_id, expert, max(v) AS top FROM scaled GROUP BY ALL
), total AS (
  SELECT s.vec_id, s.expert, n.top, sum(exp(s.v - n.top)) AS total
  FROM scaled s JOIN norm n ON s.vec_id = n.vec_id AND s.expert = n.expert GROUP BY ALL
), soft AS (
  SELECT s.vec_id, s.expert, s.pos, exp(s.v - t.top) / t.total AS p, s.v - t.top - ln(t.total) AS lp
  FROM scaled s JOIN total t ON s.vec_id = t.vec_id AND s.expert = t.expert
)"""


def wide(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").withColumn("embedding", F.col("embedding").cast("array<double>"))


def long_views(spark, sf_dir):
    """``vec_id, expert, vec``: eight views of eight numbers, row-local."""
    return views.explode_views(wide(spark, sf_dir), "embedding", WIDTHS, ["vec_id"])


def scaled_views(spark, sf_dir):
    return long_views(spark, sf_dir).withColumn("vec", F.transform("vec", lambda x: x * SCALE))


def spread(df, vec, name, *keys):
    """One row per vector element."""
    return df.select(*keys, F.posexplode(vec).alias("pos", "__v")).select(*keys, "pos", r6(F.col("__v")).alias(name))


# ---------------------------------------------------------------- views


@query(
    "view_widths",
    f"""WITH {LONG_SQL}, sizes AS (SELECT vec_id, expert, count(*)::INTEGER AS width FROM long GROUP BY ALL)
    SELECT expert, count(*) AS n_rows, min(width) AS min_width, max(width) AS max_width,
           CASE WHEN min(width) = max(width) THEN max(width) END AS width
    FROM sizes GROUP BY 1""",
)
def view_widths(spark, sf_dir):
    return views.view_widths(long_views(spark, sf_dir))


@query(
    "views_roundtrip",
    f"""WITH {LONG_SQL}
    SELECT 'embeddings' AS dataset, CASE WHEN substr(md5('42:' || vec_id), 1, 8) < '33333333' THEN 'test' ELSE 'train' END AS split,
           'view_' || expert AS expert, vec_id AS row_id, count(*)::INTEGER AS width, {q6('sum(v)')} AS total
    FROM long WHERE expert IN (2, 5) GROUP BY ALL""",
)
def views_roundtrip(spark, sf_dir):
    """Two of the eight stored experts: the folders of the others are not read."""
    return _totals(stored_views.read_views(spark, _stored(spark, sf_dir), dataset="embeddings", experts=["view_2", "view_5"]))


@query(
    "views_roundtrip_all",
    f"""WITH {LONG_SQL}
    SELECT 'embeddings' AS dataset, CASE WHEN substr(md5('42:' || vec_id), 1, 8) < '33333333' THEN 'test' ELSE 'train' END AS split,
           'view_' || expert AS expert, vec_id AS row_id, count(*)::INTEGER AS width, {q6('sum(v)')} AS total
    FROM long GROUP BY ALL""",
)
def views_roundtrip_all(spark, sf_dir):
    """All stored experts, after a check of their widths."""
    return _totals(stored_views.read_views(spark, _stored(spark, sf_dir), check=True))


def _stored(spark, sf_dir) -> str:
    rows = split_hash(long_views(spark, sf_dir), ["vec_id"], 0.2, 42).select(
        F.col("vec_id").alias("row_id"),
        F.col("vec").cast("array<float>").alias("vec"),
        F.lit("embeddings").alias("dataset"),
        F.concat(F.lit("view_"), F.col("expert").cast("string")).alias("expert"),
        "split",
    )
    path = scratch_path(spark, "views")
    stored_views.write_views(rows, path)
    return path


def _totals(back):
    return back.select(
        "dataset", "split", "expert", "row_id", F.size("vec").alias("width"), r6(V.array_sum(F.col("vec"))).alias("total")
    )


@query("views_concat", f"WITH {LONG_SQL} SELECT vec_id, expert * 8 + pos AS pos, {q6('v')} AS v FROM long")
def views_concat(spark, sf_dir):
    joined = views.concat_views(long_views(spark, sf_dir), len(WIDTHS), ["vec_id"])
    return spread(joined, "wide", "v", "vec_id")


@query("views_concat_bucketed", f"WITH {LONG_SQL} SELECT vec_id, expert * 8 + pos AS pos, {q6('v')} AS v FROM long")
def views_concat_bucketed(spark, sf_dir):
    """The same over a table bucketed by row: the grouping reads it without a shuffle."""
    path = scratch_path(spark, "bucketed")
    name = path.rsplit("/", 1)[-1].replace("-", "_")
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))  # as many as the shuffle they replace
    rows = stored_views.save_bucketed(long_views(spark, sf_dir), name, path, buckets, "vec_id")
    return spread(views.concat_views(rows, len(WIDTHS), ["vec_id"]), "wide", "v", "vec_id")


@query(
    "shape_summary",
    f"""WITH {LONG_SQL}, sizes AS (SELECT vec_id, expert, count(*)::INTEGER AS width FROM long GROUP BY ALL)
    SELECT 'embeddings' AS dataset, expert, CASE WHEN substr(md5('42:' || vec_id), 1, 8) < '33333333' THEN 'test' ELSE 'train' END AS split,
           count(*) AS n_rows, min(width) AS min_width, max(width) AS max_width,
           CASE WHEN min(width) = max(width) THEN max(width) END AS width
    FROM sizes GROUP BY ALL""",
)
def shape_summary(spark, sf_dir):
    rows = split_hash(long_views(spark, sf_dir), ["vec_id"], 0.2, 42).withColumn("dataset", F.lit("embeddings"))
    return views.view_widths(rows, ["dataset", "expert", "split"])


@query("squeeze_units", f"WITH {LONG_SQL} SELECT vec_id, expert, pos, {q6('v')} AS v FROM long")
def squeeze_units(spark, sf_dir):
    """Vectors that come with unit dimensions around them."""
    rows = long_views(spark, sf_dir).withColumn("nested", F.array(F.array("vec")))
    return spread(rows.withColumn("vec", stored_views.squeeze("nested", 2)), "vec", "v", "vec_id", "expert")


@query("views_split", f"WITH {LONG_SQL} SELECT vec_id, expert, pos, {q6('v')} AS v FROM long")
def views_split(spark, sf_dir):
    widths = views.view_widths(long_views(spark, sf_dir)).select("expert", "width")
    parts = views.explode_views_by_table(wide(spark, sf_dir), "embedding", widths, ["vec_id"])
    return spread(parts, "vec", "v", "vec_id", "expert")


@query(
    "features_labels",
    f"""SELECT vec_id, quality, toxic, len(embedding)::INTEGER AS width, {q6('list_sum(embedding::DOUBLE[])')} AS total
    FROM embeddings JOIN labels ON vec_id = doc_id""",
)
def features_labels(spark, sf_dir):
    marks = table(spark, sf_dir, "labels").withColumnRenamed("doc_id", "vec_id")
    rows = views.with_labels(wide(spark, sf_dir).drop("label"), marks, "vec_id")
    return rows.select(
        "vec_id", "quality", "toxic", F.size("embedding").alias("width"), r6(V.array_sum(F.col("embedding"))).alias("total")
    )


@query(
    "expert_lookup",
    f"""WITH {LONG_SQL} SELECT vec_id, expert, {DIMENSION_SQL} AS dimension, 'view_' || expert AS name, {q6('v')} AS first
    FROM long WHERE pos = 0""",
)
def expert_lookup(spark, sf_dir):
    named = views.name_experts(long_views(spark, sf_dir), CATALOG)
    return named.select("vec_id", "expert", "dimension", "name", r6(F.col("vec")[0]).alias("first"))


@query(
    "expert_subset",
    f"""WITH {LONG_SQL} SELECT vec_id, expert, {DIMENSION_SQL} AS dimension FROM long
    WHERE pos = 0 AND expert // 2 <> 1""",
)
def expert_subset(spark, sf_dir):
    kept = labels.ablation_dimensions("woNumerical", list(CATALOG))
    return views.name_experts(long_views(spark, sf_dir), CATALOG, kept).select("vec_id", "expert", "dimension")


# ---------------------------------------------------------------- vector arithmetic


@query(
    "argmax_class",
    f"""WITH {LONG_SQL} SELECT vec_id, expert, pos AS class FROM long
    QUALIFY row_number() OVER (PARTITION BY vec_id, expert ORDER BY v DESC, pos) = 1""",
)
def argmax_class(spark, sf_dir):
    return long_views(spark, sf_dir).select("vec_id", "expert", V.argmax(F.col("vec")).alias("class"))


@query("softmax_rows", f"WITH {SOFT_SQL} SELECT vec_id, expert, pos, {q6('p')} AS p FROM soft")
def softmax_rows(spark, sf_dir):
    rows = scaled_views(spark, sf_dir).withColumn("p", V.softmax(F.col("vec")))
    return spread(rows, "p", "p", "vec_id", "expert")


@query("log_softmax_rows", f"WITH {SOFT_SQL} SELECT vec_id, expert, pos, {q6('lp')} AS lp FROM soft")
def log_softmax_rows(spark, sf_dir):
    rows = scaled_views(spark, sf_dir).withColumn("lp", V.log_softmax(F.col("vec")))
    return spread(rows, "lp", "lp", "vec_id", "expert")


@query("entropy_rows", f"WITH {SOFT_SQL} SELECT vec_id, expert, {q6('-sum(p * lp)')} AS h FROM soft GROUP BY ALL")
def entropy_rows(spark, sf_dir):
    lp = V.log_softmax(F.col("vec"))
    return scaled_views(spark, sf_dir).select("vec_id", "expert", r6(V.let(lp, V.entropy)).alias("h"))


@query(
    "affine_rows",
    f"""WITH {LONG_SQL}
    SELECT vec_id, expert, k::INTEGER AS pos, {q6('sum(v * ((3 * k + 2 * pos) % 7 - 3) / 10) + (k - 1) / 4')} AS z
    FROM long, range(3) AS t(k) GROUP BY vec_id, expert, k""",
)
def affine_rows(spark, sf_dir):
    rows = long_views(spark, sf_dir).withColumn("z", V.affine(F.col("vec"), WEIGHT, BIAS))
    return spread(rows, "z", "z", "vec_id", "expert")


NORM_SQL = f"""{LONG_SQL}, stats AS (
  SELECT vec_id, expert, avg(v) AS mean, var_pop(v) AS var FROM long GROUP BY ALL
), normed AS (
  SELECT l.vec_id, l.expert, l.pos, l.v, (l.v - s.mean) / sqrt(s.var + 1e-5) AS z
  FROM long l JOIN stats s ON l.vec_id = s.vec_id AND l.expert = s.expert
)"""


@query("layer_norm_rows", f"WITH {NORM_SQL} SELECT vec_id, expert, pos, {q6('z')} AS z FROM normed")
def layer_norm_rows(spark, sf_dir):
    rows = long_views(spark, sf_dir).withColumn("z", V.layer_norm(F.col("vec")))
    return spread(rows, "z", "z", "vec_id", "expert")


@query("residual_add", f"WITH {NORM_SQL} SELECT vec_id, expert, pos, {q6('v + z')} AS z FROM normed")
def residual_add(spark, sf_dir):
    vec = F.col("vec")
    rows = long_views(spark, sf_dir).withColumn("z", V.add(vec, V.layer_norm(vec)))
    return spread(rows, "z", "z", "vec_id", "expert")


@query(
    "last_position",
    f"SELECT vec_id, {q6('embedding[64]')} AS v FROM embeddings",
)
def last_position(spark, sf_dir):
    return wide(spark, sf_dir).select("vec_id", r6(V.last_position(F.col("embedding"))).alias("v"))


def linear_model():
    """A stand-in for a loaded network: 64 inputs, 4 outputs."""
    weight = np.array([[((7 * k + 3 * d) % 11 - 5) / 10 for d in range(64)] for k in range(4)])
    return lambda x: x.astype(np.float64) @ weight.T


@query(
    "batch_predict",
    f"""SELECT vec_id, k::INTEGER AS pos, {q6('sum(embedding[d + 1]::DOUBLE * ((7 * k + 3 * d) % 11 - 5) / 10)')} AS v
    FROM embeddings, range(64) AS t(d), range(4) AS s(k) GROUP BY vec_id, k""",
)
def batch_predict(spark, sf_dir):
    rows = experts.batch_predict(wide(spark, sf_dir), "embedding", 64, linear_model, "out")
    return spread(rows, "out", "v", "vec_id")
