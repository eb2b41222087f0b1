"""Queries on metrics: truth and prediction from lineitem, class R is never predicted."""

from __future__ import annotations

from pyspark.sql import functions as F

from polyview.operators import metrics
from polyview.plans.base import q6, query, r6, table
from polyview.plans.routing import METRICS_SQL, scores_sql, whole_sql
from polyview.session import scratch_path, stored
from polyview.sources import reports

LABELS = ["A", "N", "R"]
ROWS_SQL = """
rows AS (
  SELECT l_returnflag AS y, CASE l_linestatus WHEN 'F' THEN 'A' WHEN 'O' THEN 'N' END AS pred, l_linenumber, l_linestatus
  FROM lineitem
)"""
GRID_SQL = f"""{ROWS_SQL}, grid AS (
  SELECT t.label AS truth, p.label AS pred FROM (VALUES ('A'), ('N'), ('R')) t(label), (VALUES ('A'), ('N'), ('R')) p(label)
), cells AS (
  SELECT g.truth, g.pred, count(r.y) AS n FROM grid g LEFT JOIN rows r ON r.y = g.truth AND r.pred = g.pred GROUP BY ALL
)"""
REPORT_SQL = f"""{GRID_SQL}, totals AS (
  SELECT label, sum(CASE WHEN truth = label THEN n ELSE 0 END) AS support, sum(CASE WHEN pred = label THEN n ELSE 0 END) AS predicted,
         sum(CASE WHEN truth = label AND pred = label THEN n ELSE 0 END) AS hit
  FROM cells, (VALUES ('A'), ('N'), ('R')) l(label) GROUP BY 1
), report AS (
  SELECT label, CASE WHEN predicted > 0 THEN hit / predicted ELSE 0 END AS precision,
         CASE WHEN support > 0 THEN hit / support ELSE 0 END AS recall,
         CASE WHEN support + predicted > 0 THEN 2 * hit / (support + predicted) ELSE 0 END AS f1,
         support::BIGINT AS support, predicted::BIGINT AS predicted, hit::BIGINT AS hit FROM totals
)"""
FIELDS_SQL = f"{q6('precision')} AS precision, {q6('recall')} AS recall, {q6('f1')} AS f1"


def outcomes(spark, sf_dir, *keys):
    """Truth and a stand-in prediction for every line."""
    pred = F.when(F.col("l_linestatus") == "F", "A").when(F.col("l_linestatus") == "O", "N")
    return table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("y"), pred.alias("pred"), *keys)


def _rounded(df, *fields):
    return df.select(*[r6(F.col(c)).alias(c) if c in fields else F.col(c) for c in df.columns])


@query("class_grid", f"WITH {GRID_SQL} SELECT truth, pred, n FROM cells")
def class_grid(spark, sf_dir):
    return metrics.confusion(outcomes(spark, sf_dir), "y", "pred", LABELS)


@query(
    "confusion_matrix",
    f"""WITH {GRID_SQL} SELECT truth, max(CASE WHEN pred = 'A' THEN n END) AS pred_a,
        max(CASE WHEN pred = 'N' THEN n END) AS pred_n, max(CASE WHEN pred = 'R' THEN n END) AS pred_r
    FROM cells GROUP BY 1""",
)
def confusion_matrix(spark, sf_dir):
    rows = metrics.confusion_rows(metrics.confusion(outcomes(spark, sf_dir), "y", "pred", LABELS))
    return rows.select("truth", *[F.col("counts")[i].alias(f"pred_{c.lower()}") for i, c in enumerate(LABELS)])


@query("accuracy", f"WITH {ROWS_SQL} SELECT {q6('avg(CASE WHEN y = pred THEN 1.0 ELSE 0.0 END)')} AS accuracy FROM rows")
def accuracy(spark, sf_dir):
    return _rounded(metrics.accuracy(outcomes(spark, sf_dir), "y", "pred"), "accuracy")


@query("class_report", f"WITH {REPORT_SQL} SELECT label, {FIELDS_SQL}, support, predicted FROM report")
def class_report(spark, sf_dir):
    report = metrics.class_report(outcomes(spark, sf_dir), "y", "pred", LABELS).drop("both")
    return _rounded(report, "precision", "recall", "f1")


@query(
    "class_report_avgs",
    f"""WITH {REPORT_SQL}, lines AS (
      SELECT label, precision, recall, f1, support FROM report
      UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), sum(support)::BIGINT FROM report
      UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support),
                       sum(f1 * support) / sum(support), sum(support)::BIGINT FROM report
    ) SELECT label, {FIELDS_SQL}, support FROM lines""",
)
def class_report_avgs(spark, sf_dir):
    report = metrics.class_report(outcomes(spark, sf_dir), "y", "pred", LABELS)
    return _rounded(metrics.class_report_averages(report), "precision", "recall", "f1")


def _one(name: str, sql_name: str):
    """One metric of the whole table."""
    sql = f"WITH {ROWS_SQL}, keyed AS (SELECT 0 AS k, y, pred FROM rows), {scores_sql('keyed', 'k', n_labels=3)} SELECT {q6(sql_name)} AS {name} FROM metric"

    @query(name, sql)
    def run(spark, sf_dir):
        scores = metrics.scores(outcomes(spark, sf_dir), "y", "pred", LABELS)
        return scores.select(r6(F.col(sql_name)).alias(name))

    return run


f1_macro = _one("f1_macro", "f1_macro_seen")
f1_macro_fixed = _one("f1_macro_fixed", "f1_macro_fixed")
f1_micro = _one("f1_micro", "f1_micro")
f1_weighted = _one("f1_weighted", "f1_weighted")


@query(
    "pass_metrics",
    f"""WITH {ROWS_SQL}, {scores_sql('rows', 'l_linenumber', n_labels=3)}, {whole_sql('l_linenumber')}
    SELECT l_linenumber - 1 AS pass, report, matrix, {METRICS_SQL}, {q6("(SELECT f1 FROM f1s f WHERE f.l_linenumber = m.l_linenumber AND f.label = 'A')")} AS f1_A,
           {q6("(SELECT f1 FROM f1s f WHERE f.l_linenumber = m.l_linenumber AND f.label = 'N')")} AS f1_N,
           {q6("coalesce((SELECT f1 FROM f1s f WHERE f.l_linenumber = m.l_linenumber AND f.label = 'R'), 0)")} AS f1_R
    FROM metric m JOIN report_text USING (l_linenumber) JOIN matrix_text USING (l_linenumber)""",
)
def pass_metrics(spark, sf_dir):
    rows = outcomes(spark, sf_dir, (F.col("l_linenumber") - 1).alias("pass"))
    counted = stored(metrics.pair_counts(rows, "y", "pred", ["pass"]), "pairs")  # labels**2 rows per pass, one scan
    whole = reports.whole_rows(counted, LABELS, ["pass"])
    return _rounded(whole, *[c for c in whole.columns if c not in ("pass", "report", "matrix")])


@query(
    "pass_confusion",
    f"""WITH {ROWS_SQL}, grid AS (
      SELECT x.l_linenumber, t.label AS truth, p.label AS pred
      FROM (SELECT DISTINCT l_linenumber FROM rows) x, (VALUES ('A'), ('N'), ('R')) t(label), (VALUES ('A'), ('N'), ('R')) p(label)
    ) SELECT g.l_linenumber - 1 AS pass, g.truth, g.pred, count(r.y) AS n
    FROM grid g LEFT JOIN rows r ON r.y = g.truth AND r.pred = g.pred AND r.l_linenumber = g.l_linenumber GROUP BY ALL""",
)
def pass_confusion(spark, sf_dir):
    rows = outcomes(spark, sf_dir, (F.col("l_linenumber") - 1).alias("pass"))
    return metrics.confusion(rows, "y", "pred", LABELS, ["pass"])


@query(
    "report_text",
    f"""WITH {ROWS_SQL}, keyed AS (SELECT 0 AS k, y, pred FROM rows), {scores_sql('keyed', 'k', n_labels=3)}
    SELECT printf('Acc: %.5f. F1 macro: %.5f. F1 micro: %.5f. F1 weighted: %.5f.',
                  accuracy::DOUBLE, f1_macro_seen::DOUBLE, f1_micro::DOUBLE, f1_weighted::DOUBLE) AS value FROM metric""",
)
def report_text(spark, sf_dir):
    scores = metrics.scores(outcomes(spark, sf_dir), "y", "pred", LABELS)
    path = scratch_path(spark, "report")
    reports.write_report(reports.headline(scores), path)
    return spark.read.text(path)


@query(
    "report_full",
    f"""WITH {REPORT_SQL}, keyed AS (SELECT 0 AS k, y, pred FROM rows), {scores_sql('keyed', 'k', n_labels=3).replace('totals', 'label_totals')},
    class_rows AS (
      SELECT label, precision, recall, f1, support FROM report
      UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), sum(support)::BIGINT FROM report
      UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support),
                       sum(f1 * support) / sum(support), sum(support)::BIGINT FROM report
    )
    SELECT printf('Acc: %.5f. F1 macro: %.5f. F1 micro: %.5f. F1 weighted: %.5f.',
                  accuracy::DOUBLE, f1_macro_seen::DOUBLE, f1_micro::DOUBLE, f1_weighted::DOUBLE) AS value FROM metric
    UNION ALL SELECT lpad(label, 12, ' ') || '  ' || lpad(printf('%.5f', precision::DOUBLE), 9, ' ') || ' ' || lpad(printf('%.5f', recall::DOUBLE), 9, ' ')
                     || ' ' || lpad(printf('%.5f', f1::DOUBLE), 9, ' ') || ' ' || lpad(support::VARCHAR, 9, ' ') FROM class_rows
    UNION ALL SELECT '[' || string_agg(n::VARCHAR, ' ' ORDER BY pred) || ']' FROM cells GROUP BY truth""",
)
def report_full(spark, sf_dir):
    counted = stored(metrics.pair_counts(outcomes(spark, sf_dir), "y", "pred"), "pairs")  # one pass over the lines
    averages = metrics.class_report_averages(metrics.class_report(counted, "truth", "pred", LABELS, weight="n"))
    matrix = metrics.confusion_rows(metrics.confusion(counted, "truth", "pred", LABELS, weight="n"))
    scores = metrics.scores(counted, "truth", "pred", LABELS, weight="n")
    lines = reports.report_lines(scores, averages, matrix, LABELS)
    path = scratch_path(spark, "report")
    reports.write_report(lines, path)
    return spark.read.text(path)


@query(
    "format_numbers",
    f"""WITH {REPORT_SQL} SELECT label, printf('%.5f', precision::DOUBLE) AS precision, printf('%.5f', recall::DOUBLE) AS recall,
        printf('%.5f', f1::DOUBLE) AS f1, support FROM report""",
)
def format_numbers(spark, sf_dir):
    report = metrics.class_report(outcomes(spark, sf_dir), "y", "pred", LABELS)
    fields = [reports.fixed(F.col(c)).alias(c) for c in ("precision", "recall", "f1")]
    return report.select("label", *fields, "support")


@query("metrics_sink", f"WITH {REPORT_SQL} SELECT label, {FIELDS_SQL}, support FROM report")
def metrics_sink(spark, sf_dir):
    report = _rounded(
        metrics.class_report(outcomes(spark, sf_dir), "y", "pred", LABELS).drop("predicted", "both"),
        "precision", "recall", "f1",
    )
    path = scratch_path(spark, "metrics")
    reports.write_metrics(report, path, "csv")
    return spark.read.schema(report.schema).option("header", "true").csv(path)


