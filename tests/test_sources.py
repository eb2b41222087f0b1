import os

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from polyview.functions import batched
from polyview.operators import sets, views
from polyview.schema import EXPERT_COUNTS
from polyview.session import clean_scratch, scratch_root, stored
from polyview.sources import jsonl, reports, registry, views as stored_views
from tests.helpers import plan


def test_unknown_corpus_fails_before_planning(spark, sf):
    tables = registry.driver_tables(spark, sf)
    assert tables.scan("labels").columns == ["doc_id", "quality", "toxic"]
    with pytest.raises(ValueError, match="unknown corpus"):
        tables.scan("nothing")


def test_ingest_keeps_what_is_there_unless_forced(spark, tmp_path):
    path = str(tmp_path / "corpus")
    assert registry.ingest(spark.range(3), path).count() == 3
    assert registry.ingest(spark.range(5), path).count() == 3
    assert registry.ingest(spark.range(5), path, force=True).count() == 5


def test_ingest_stores_a_half_written_corpus_anew(spark, tmp_path):
    path = tmp_path / "corpus"
    registry.ingest(spark.range(3), str(path))
    (path / "_SUCCESS").unlink()
    assert registry.ingest(spark.range(5), str(path)).count() == 5
    assert registry.ingest(spark.range(7), str(path)).count() == 5


def test_a_pass_published_again_is_there_once(spark, tmp_path):
    root = str(tmp_path / "results")
    schema = "run string, pass int, score double"
    first = spark.createDataFrame([("01", 0, 0.5), ("01", 0, 0.5), ("01", 1, 0.6), (None, None, 0.1)], schema)

    def rows(df):
        return sorted(map(str, df.collect()))

    assert rows(registry.publish(first, root, ["run", "pass"])) == rows(first)
    again = registry.publish(first.where("pass = 0").withColumn("score", F.lit(0.9)), root, ["run", "pass"])
    assert again.schema.simpleString() == first.schema.simpleString()
    assert rows(again) == rows(first.withColumn("score", F.when(F.col("pass") == 0, 0.9).otherwise(F.col("score"))))
    wider = registry.publish(spark.createDataFrame([("b", 2, 0.7, 4)], schema + ", n long"), root, ["run", "pass"])
    assert wider.count() == 5 and wider.where("n is not null").count() == 1
    assert registry.publish(first.limit(0), str(tmp_path / "none"), ["run", "pass"]).count() == 0


def test_examples_round_trip_keeps_nulls_and_unicode(spark, tmp_path):
    rows = [("d", "train", "café €\n\"q\"", None), ("d", "test", None, "neutral")]
    df = spark.createDataFrame(rows, "dataset string, split string, input string, output string")
    path = str(tmp_path / "examples")
    jsonl.write_examples(df, path)
    assert any('"output":null' in r[0] for r in spark.read.text(path).select("value").collect())
    back = jsonl.read_examples(spark, path).select(df.columns)
    assert sorted(map(str, back.collect())) == sorted(map(str, df.collect()))
    assert "PartitionFilters: [isnotnull(split" in plan(back.where("split = 'test'"))


def test_array_file_of_documents(spark, tmp_path):
    (tmp_path / "one.json").write_text('[{"id": 1, "company": [{"name": "a"}]},\n {"id": 2, "company": []}]')
    schema = spark.sql("select 1L id, array(named_struct('name', 'x')) company").schema
    got = jsonl.read_documents(spark, str(tmp_path / "one.json"), schema, one_array=True).orderBy("id").collect()
    assert [(r["id"], [c["name"] for c in r["company"]]) for r in got] == [(1, ["a"]), (2, [])]


def test_views_are_pruned_by_folder(spark, tmp_path):
    rows = [(i, [float(i)] * 3, "d", f"e{i % 2}", "test" if i % 3 else "train") for i in range(12)]
    df = spark.createDataFrame(rows, "row_id long, vec array<float>, dataset string, expert string, split string")
    path = str(tmp_path / "views")
    stored_views.write_views(df, path)
    got = stored_views.read_views(spark, path, dataset="d", split="test", experts=["e1"])
    assert "PartitionFilters: [isnotnull(dataset" in plan(got) and "PushedFilters: []" in plan(got)
    assert sorted(r["row_id"] for r in got.collect()) == [1, 5, 7, 11]
    assert dict(got.dtypes)["vec"] == "array<double>"


def test_ragged_views_are_refused(spark):
    df = spark.createDataFrame([(0, [1.0]), (0, [1.0, 2.0]), (1, [1.0])], "expert int, vec array<double>")
    with pytest.raises(ValueError, match="several widths"):
        views.checked_widths(df)
    assert views.checked_widths(df.where("expert = 1")) == [1]


def test_catalog_numbers_experts_across_dimensions(spark):
    names = views.numbered_catalog(EXPERT_COUNTS)
    rows = views.catalog(spark, names).orderBy("expert").collect()
    assert [r["expert"] for r in rows] == list(range(15))
    assert [r["dimension"] for r in rows] == ["Semantic"] * 6 + ["Math"] * 5 + ["Event"] * 2 + ["Sentiment"] * 2
    assert rows[14]["name"] == "expert_14"
    kept = views.name_experts(spark.range(15).select(F.col("id").cast("int").alias("expert")), names, ["Math", "Event"])
    assert sorted(r["expert"] for r in kept.collect()) == list(range(6, 13))


def test_squeeze_drops_unit_dimensions(spark):
    df = spark.sql("select array(array(array(1.0d, 2.0d))) v")
    assert df.select(stored_views.squeeze("v", 2)).first()[0] == [1.0, 2.0]


def test_concat_needs_each_expert_once(spark):
    kinds = "row_id long, expert int, vec array<double>"
    rows = [(1, 1, [3.0]), (1, 0, [1.0, 2.0])]
    assert [tuple(r) for r in views.concat_views(spark.createDataFrame(rows, kinds), 2).collect()] == [(1, [1.0, 2.0, 3.0])]
    for bad in ([(2, 0, [9.0])], [(2, 0, [1.0]), (2, 0, [9.0])]):
        with pytest.raises(PySparkException, match="each expert once"):
            views.concat_views(spark.createDataFrame(rows + bad, kinds), 2).collect()


def test_ragged_views_fail_at_the_scan(spark, tmp_path):
    rows = [("d", "e0", "train", i, [1.0] * (2 if i < 3 else n)) for n in (2, 3) for i in range(4)]
    for n, part in ((2, rows[:4]), (3, rows[4:])):
        path = str(tmp_path / str(n))
        frame = spark.createDataFrame(part, "dataset string, expert string, split string, row_id long, vec array<float>")
        stored_views.write_views(frame, path)
        if n == 2:
            assert stored_views.read_views(spark, path, check=True).count() == 4
        else:
            with pytest.raises(ValueError, match="several widths"):
                stored_views.read_views(spark, path, check=True)


def test_metrics_and_report(spark, tmp_path):
    df = spark.createDataFrame([(0.5, 0.25, 0.5, 1 / 3)], "accuracy double, f1_macro_seen double, f1_micro double, f1_weighted double")
    for fmt in ("parquet", "csv"):
        reports.write_metrics(df, str(tmp_path / fmt), fmt)
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 1
    with pytest.raises(ValueError):
        reports.write_metrics(df, str(tmp_path / "x"), "xlsx")
    assert reports.headline(df).first()[0] == "Acc: 0.50000. F1 macro: 0.25000. F1 micro: 0.50000. F1 weighted: 0.33333."


def test_full_report_is_one_ordered_file(spark, tmp_path):
    from polyview.operators import metrics

    rows = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("c", "a")], "y string, p string")
    labels = ["a", "b", "c"]
    averages = metrics.class_report_averages(metrics.class_report(rows, "y", "p", labels))
    matrix = metrics.confusion_rows(metrics.confusion(rows, "y", "p", labels))
    path = str(tmp_path / "report")
    reports.write_report(reports.report_lines(metrics.scores(rows, "y", "p", labels), averages, matrix, labels), path)
    lines = [r["value"] for r in spark.read.text(path, wholetext=True).collect()][0].splitlines()
    assert lines[0].startswith("Acc: 0.50000.") and len(lines) == 9
    assert lines[1] == "           a    0.50000   0.50000   0.50000         2"
    assert lines[4].split()[:2] == ["macro", "avg"] and lines[5].split()[:2] == ["weighted", "avg"]
    assert lines[6:] == ["[1 1 0]", "[0 1 0]", "[1 0 0]"]


def test_union_and_merge(spark):
    a, b = spark.range(2).toDF("x"), spark.range(1).toDF("x")
    assert sets.union_all(a, b, a).count() == 5
    merged = sets.merge_corpora({"a": a, "b": b})
    assert sorted((r["dataset"], r["n"]) for r in merged.groupBy("dataset").agg(F.count("*").alias("n")).collect()) == [("a", 2), ("b", 1)]


def test_batched_map(spark):
    got = batched.map_batches(spark.range(100), lambda b: b.assign(id=b["id"] * 2), "id long")
    assert got.agg(F.sum("id")).first()[0] == 9900


def test_stored(spark):
    back = stored(spark.range(100))
    assert back.count() == 100 and scratch_root(spark) in back.inputFiles()[0]


def test_scratch_is_removed(spark, monkeypatch):
    from polyview import session

    monkeypatch.setattr(session, "_written", [])
    back = stored(spark.range(5))
    folder = back.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
    assert os.path.isdir(folder)
    clean_scratch(spark)
    assert not os.path.exists(folder)


def test_stored_splits_are_united_again(spark, tmp_path):
    root = str(tmp_path / "splits")
    df = spark.createDataFrame([(1, "train"), (1, "train"), (2, None), (3, "odd name/%"), (4, "01")], "x long, part string")
    registry.store_splits(df, root, "part")
    assert set(registry.split_tables(spark, root)) == {"train", None, "odd name/%", "01"}
    want = [("01", 4), ("None", 2), ("odd name/%", 3), ("train", 1), ("train", 1)]
    assert sorted((str(r["split"]), r["x"]) for r in registry.scan_splits(spark, root).collect()) == want

    # A split stored again replaces its own table only, and may have other columns.
    more = spark.createDataFrame([(9, 0.5, "train")], "x long, weight double, part string")
    registry.store_splits(more, root, "part")
    got = registry.scan_splits(spark, root)
    assert set(got.columns) == {"split", "x", "weight"}
    assert sorted((str(r["split"]), r["x"], str(r["weight"])) for r in got.collect()) == [
        ("01", 4, "None"), ("None", 2, "None"), ("odd name/%", 3, "None"), ("train", 9, "0.5")]


def test_union_of_no_splits_is_an_error(spark, tmp_path):
    registry.store_splits(spark.createDataFrame([], "x long, split string"), str(tmp_path / "none"))
    with pytest.raises(ValueError, match="no splits"):
        registry.scan_splits(spark, str(tmp_path / "none"))
    clash = spark.createDataFrame([(1, "own")], "x long, SPLIT string")
    assert [tuple(r) for r in sets.union_splits({"a": clash}).collect()] == [("a", 1)]


def test_a_local_scratch_folder_is_refused_on_a_cluster(spark, monkeypatch):
    class Conf:
        def get(self, key, default=None):
            return {"spark.sql.warehouse.dir": "file:/home/me/spark-warehouse"}.get(key, default)

    class Session:
        conf = Conf()

        class sparkContext:
            master = "spark://host:1"

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch_root(Session)
    Session.sparkContext.master = "local[2]"
    assert scratch_root(Session) == "file:/home/me/spark-warehouse/_scratch"


def test_worker_functions_travel_without_the_package(tmp_path):
    """Executors do not have this package on their path."""
    import subprocess
    import sys

    from pyspark import cloudpickle

    from polyview.operators.experts import _judge

    (tmp_path / "f.pkl").write_bytes(cloudpickle.dumps(_judge))
    code = "import pickle, numpy; print(pickle.load(open('f.pkl', 'rb'))(numpy.zeros((1, 1, 2))).shape)"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=60)
    assert out.stdout.strip() == "(1, 1, 3)", out.stderr
