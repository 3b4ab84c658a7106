import gzip

import pytest
from pyspark.sql import functions as F

from widesift.operators import align, reports
from widesift.sources import matrices, runs, text_reports


def wide_csv(tmp_path, width):
    names = [f"g{i:05d}.1" for i in range(width)]
    rows = {"SAMPLE-AAAA-01A": 1.0, "SAMPLE-AAAA-01B": 3.0, "SAMPLE-BBBB-01A": 5.0}
    lines = [",".join(["", *names])] + [",".join([b, *[str(v + i) for i in range(width)]]) for b, v in rows.items()]
    path = tmp_path / "m.csv"
    path.write_text("\n".join(lines) + "\n")
    return str(path)


def test_very_wide_csv_is_read_long_and_averaged(spark, tmp_path):
    long = matrices.read_matrix_csv(spark, wide_csv(tmp_path, 60_660), "X")
    assert long.count() == 3 * 60_660
    mean = align.average_duplicates(long)
    facts = mean.groupBy("sample_id").agg(F.count("*").alias("n"), F.sum("value").alias("s")).orderBy("sample_id").collect()
    base = sum(range(60_660))
    assert [(r["sample_id"], r["n"], r["s"]) for r in facts] == [
        ("SAMPLE-AAAA-", 60_660, 2.0 * 60_660 + base), ("SAMPLE-BBBB-", 60_660, 5.0 * 60_660 + base)]


def test_missing_cells_are_null(spark, tmp_path):
    path = tmp_path / "m.csv"
    path.write_text('"","a","b"\n"s1",1.5,\n"s2",NA,NaN\n')
    rows = matrices.read_matrix_csv(spark, str(path), "X").orderBy("barcode", "feature").collect()
    assert [(r["barcode"], r["feature"], r["value"]) for r in rows] == [
        ("s1", "a", 1.5), ("s1", "b", None), ("s2", "a", None), ("s2", "b", None)]


def test_headers_by_place_quotes_and_separators(spark, tmp_path):
    folder = tmp_path / "m"
    folder.mkdir()
    (folder / "a.csv").write_text('id,"g,1",g2\nid,1,2\n"x ""y""",3,4\n')
    (folder / "b.csv").write_text('id,g2,"g,1"\n,5,6\nz,7\n\n')
    rows = {(r["barcode"], r["feature"]): (r["value"], r["feature_pos"]) for r in matrices.read_matrix_csv(spark, str(folder), "X").collect()}
    assert rows == {("id", "g,1"): (1.0, 0), ("id", "g2"): (2.0, 1), ('x "y"', "g,1"): (3.0, 0), ('x "y"', "g2"): (4.0, 1),
                    ("", "g2"): (5.0, 0), ("", "g,1"): (6.0, 1), ("z", "g2"): (7.0, 0)}
    path = tmp_path / "m.txt"
    path.write_text("|a|b.\ns|1|2\n")
    got = {(r["feature"], r["value"]) for r in matrices.read_matrix_csv(spark, str(path), "X", separator="|").collect()}
    assert got == {("a", 1.0), ("b.", 2.0)}


def test_transposed_gzip(spark, tmp_path):
    path = tmp_path / "m.tsv.gz"
    with gzip.open(path, "wt") as f:
        f.write("gene\ts1\ts2\ng1\t1\t2\ng2\t3\t4\n")
    rows = matrices.read_transposed_tsv(spark, str(path), "X", tasks=2).orderBy("barcode", "feature").collect()
    assert [(r["barcode"], r["feature"], r["value"]) for r in rows] == [
        ("s1", "g1", 1.0), ("s1", "g2", 3.0), ("s2", "g1", 2.0), ("s2", "g2", 4.0)]


def test_labels_keep_first_row_per_patient(spark, tmp_path):
    path = tmp_path / "l.csv"
    path.write_text(" pan.samplesID , Subtype_Selected,other\nPATIENT-0001-A,z,1\nPATIENT-0001-B,a,2\nPATIENT-0002-A,,3\nPATIENT-0003-A,b,4\n")
    raw = matrices.read_labels(spark, str(path), "X")
    got = {(r["sample_id"], r["label"]) for r in align.prepare_labels(raw, "barcode", "label", "file_pos").collect()}
    assert got == {("PATIENT-0001", "z"), ("PATIENT-0003", "b")}


def test_input_errors(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        matrices.read_matrix_csv(spark, str(tmp_path / "none.csv"), "X")
    path = tmp_path / "l.csv"
    path.write_text("id,label\n1,a\n")
    with pytest.raises(ValueError, match="Subtype_Selected"):
        matrices.read_labels(spark, str(path), "X")
    with pytest.raises(ValueError, match="unsupported"):
        matrices.cohort_paths({"ALPHA": ("a", "b")}, "nope")
    assert matrices.cohort_paths({"ALPHA": ("a", "b")}, "alpha") == ("a", "b")


def test_matrix_cache_builds_once(spark, tmp_path):
    calls = []

    def build(value):
        def make():
            calls.append(value)
            return spark.createDataFrame([("X", "s1", "g1", value)], "cohort string, sample_id string, feature string, value double")
        return make

    folder = str(tmp_path / "cache")
    assert matrices.cached_matrix(spark, folder, build(1.0)).first()["value"] == 1.0
    assert matrices.cached_matrix(spark, folder, build(2.0)).first()["value"] == 1.0
    assert matrices.cached_matrix(spark, folder, build(3.0), rebuild=True).first()["value"] == 3.0
    assert calls == [1.0, 3.0]


def run_rows(spark):
    rows = [(c, m, "p", 42 + i, i, 10, 4, 0.5 + 0.1 * i, 0.4, 0.45, 0.4, 0.5 + 0.1 * i, 0.7, 0.8, 1.0, 2.0, "ok")
            for c in ("A", "B") for m in ("anova",) for i in range(2)]
    return spark.createDataFrame(rows, reports.RUN_SCHEMA)


def test_run_files_round_trip(spark, tmp_path):
    table = run_rows(spark)
    runs.write_run_files(table, str(tmp_path / "by_run"))
    back = spark.read.option("header", True).csv(str(tmp_path / "by_run"))
    assert back.count() == 4 and {"method", "run_id"} <= set(back.columns)
    runs.write_results(table, str(tmp_path / "by_cohort"), "parquet")
    assert spark.read.parquet(str(tmp_path / "by_cohort")).where("cohort = 'A'").count() == 2


def test_glob_of_run_files(spark, tmp_path):
    assert runs.read_runs(spark, str(tmp_path / "run_*.csv")).count() == 0
    for i in range(3):
        (tmp_path / f"run_{i:02d}.csv").write_text(f"Cancer,Method,Accuracy,Seed,RunID\nA,ANOVA / F-test,0.{i + 5},{42 + i},{i}\n")
    got = runs.read_runs(spark, str(tmp_path / "run_*.csv"))
    assert {(r["method"], r["accuracy"], r["run_id"]) for r in got.collect()} == {("ANOVA", 0.5, 0), ("ANOVA", 0.6, 1), ("ANOVA", 0.7, 2)}


def test_run_files_of_several_layouts(spark, tmp_path):
    (tmp_path / "run_01.csv").write_text("Cancer,Method,Threshold,Accuracy,ROC-AUC,Seed,RunID\nA,Variance,0.50,0.5,0.9,42,1\n")
    (tmp_path / "run_02.csv").write_text("Seed,Accuracy,Cancer,Method,RunID,Threshold\n43,0.25,A,Variance,2,0.05\n")
    (tmp_path / "run_03.csv").write_text("run,seed,accuracy,roc_auc,Dataset,Method,train_time\n3,44,0.75,0.8,A,Random Forest,1.5\n")
    got = runs.read_runs(spark, str(tmp_path / "run_*.csv"))
    rows = {r["run_id"]: (r["method"], r["param"], r["seed"], r["accuracy"], r["roc_auc_macro"], r["roc_auc_weighted"], r["train_time_s"]) for r in got.collect()}
    assert rows == {1: ("Variance", "threshold=0.5", 42, 0.5, 0.9, None, None), 2: ("Variance", "threshold=0.05", 43, 0.25, None, None, None),
                    3: ("RandomForest", "all", 44, 0.75, None, 0.8, 1.5)}
    summary = reports.aggregate_runs(got).where("param = 'threshold=0.5'").first()
    assert summary["roc_auc_macro_mean"] == 0.9 and summary["n_runs"] == 1


def test_old_runs_take_names_from_directories(spark, tmp_path):
    folder = tmp_path / "LASSO" / "BETA"
    folder.mkdir(parents=True)
    (folder / "BETA_run_results.csv").write_text("run,seed,accuracy\n1,7,0.5\n")
    row = runs.read_old_runs(spark, str(tmp_path), "LASSO").first()
    assert (row["cohort"], row["method"], row["seed"], row["accuracy"]) == ("BETA", "LASSO", 7, 0.5)
    assert runs.read_old_runs(spark, str(tmp_path), "RandomForest").count() == 0


def report_text(spark, lines, folder):
    text_reports.write_report(lines, str(folder))
    return [r[0] for r in spark.read.text(str(folder)).collect()]


def test_text_reports(spark, tmp_path):
    table = run_rows(spark)
    lines = report_text(spark, text_reports.aggregated_report(reports.aggregate_runs(table)), tmp_path / "a")
    assert lines[0] == "  Cohort: A  Method: anova  Param: p"
    assert lines[1] == "    Accuracy           mean=0.5500  std=0.0707  min=0.5000  max=0.6000"
    table_lines = report_text(spark, text_reports.metric_table(table, ["cohort"]), tmp_path / "b")
    assert table_lines[3].split() == ["Accuracy", "0.5500", "0.0707", "0.5000", "0.6000"]
    assert "Total run time (s): 4.00" in table_lines
    best = report_text(spark, text_reports.best_settings_report(reports.best_setting(table)), tmp_path / "c")
    assert best[0] == "[A] anova best accuracy: p (seed 43) = 0.6000"


def test_run_report_has_metrics_then_classes(spark, tmp_path):
    classes = spark.createDataFrame(
        [("A", 42, "anova", "p", c, p, r, f, n) for c, p, r, f, n in [
            ("x", 0.5, 1.0, 0.66, 2), ("accuracy", None, None, 0.5, 3), ("macro avg", 0.5, 0.5, 0.5, 3), ("weighted avg", 0.4, 0.4, 0.4, 3)]],
        "cohort string, seed int, method string, param string, class string, precision double, recall double, f1 double, support long")
    lines = report_text(spark, text_reports.run_report(run_rows(spark).where("cohort = 'A' AND seed = 42"), classes), tmp_path / "r")
    assert lines[0].startswith("Report: anova on A")
    assert [line.split()[0] for line in lines[-4:]] == ["x", "accuracy", "macro", "weighted"]
