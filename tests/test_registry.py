import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from sparkprof.plans import registry as R
from sparkprof.plans import reports

DAY = datetime(2024, 5, 1)


def run_rows(spark):
    rows = [
        ("run-one-1234567890", "classification", "gbt", ["x", "y"], "t", {"maxIter": "5"},
         {"accuracy": 0.91239, "f1": 0.5}, [[3, 1], [0, 2]], "d1", 10, 6, DAY),
        ("run-two-1234567890", "regression", "gbt_reg", ["x"], None, {}, {"rmse": 2.0}, None, "gone", 7, 3,
         DAY + timedelta(days=1)),
        ("run-three-34567890", "regression", "linear_regression", ["x"], "t", {}, {"r2": 0.25, "rmse": 1.0},
         None, "d1", 8, 2, DAY + timedelta(days=2)),
    ]
    return spark.createDataFrame(
        rows, "id string, model_type string, algorithm string, features array<string>, target string, "
        "params map<string,string>, metrics map<string,double>, confusion_matrix array<array<bigint>>, "
        "dataset_id string, train_size bigint, test_size bigint, created_at timestamp_ntz"
    ).withColumn("name", F.lit(None).cast("string"))


@pytest.fixture(scope="module")
def runs(spark):
    return run_rows(spark)


@pytest.fixture(scope="module")
def datasets(spark):
    return spark.createDataFrame([("d1", "one.csv", "/d1", DAY)],
                                 "id string, filename string, path string, created_at timestamp_ntz")


def test_changes_in_order(spark, tmp_path):
    path = str(tmp_path / "r")
    row = lambda i, n: spark.createDataFrame([(i, n)], "id string, n int")
    at = lambda h: DAY + timedelta(hours=h)
    R.append(R.changes(row("a", 1), at=at(0)), path)
    R.append(R.changes(row("b", 1), at=at(1)), path)
    R.append(R.changes(row("c", 1), at=at(1)), path)
    state = lambda: {r["id"]: r["n"] for r in R.current(R.open_registry(spark, path, "id string, n int")).collect()}
    assert state() == {"a": 1, "b": 1, "c": 1}
    registry = R.open_registry(spark, path, "id string, n int")
    R.append(R.changes(R.updated(R.current(registry), row("a", 5)), at=at(2)), path)
    R.append(R.deleted(row("b", 0), registry, at=at(2)), path)
    assert state() == {"a": 5, "c": 1}
    R.append(R.changes(row(None, None), R.CLEAR, at(3)), path)
    assert state() == {}
    R.append(R.changes(row("b", 9), at=at(4)), path)
    R.append(R.changes(row("d", 1), at=at(5)), path)
    R.append(R.deleted(row("d", 0), registry, at=at(5)), path)
    assert state() == {"b": 9}


def test_update_of_unknown_ids_adds_nothing(spark, runs):
    changed = spark.createDataFrame([("nobody", 1), ("run-two-1234567890", None)], "id string, test_size bigint")
    found = R.updated(runs, changed).collect()
    assert [(r["id"], r["test_size"]) for r in found] == [("run-two-1234567890", None)]


def test_several_changes_of_an_id_give_one_row(spark, runs):
    rows = [("run-two-1234567890", 1), ("run-two-1234567890", 2), ("run-two-1234567890", 2)]
    found = R.updated(runs, spark.createDataFrame(rows, "id string, test_size bigint")).collect()
    assert len(found) == 1 and found[0]["test_size"] in (1, 2)


def test_puts_of_one_moment_give_one_row(spark):
    rows = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "id string, n int")
    puts = R.changes(rows, at=datetime(2024, 1, 1))
    found = [R.current(puts.repartition(k)).orderBy("id").collect() for k in (1, 3)]
    assert found[0] == found[1] and [r["id"] for r in found[0]] == ["a", "b"]
    plan = R.current(puts)._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate(key=[id#" not in plan.split("functions=[max(")[0]


def test_lookups(spark, runs, datasets):
    ids = spark.createDataFrame([("d1",), ("gone",), ("d1",)], "id string")
    assert {(r["id"], r["found"]) for r in R.lookup(ids, datasets).collect()} == {("d1", True), ("gone", False)}
    assert R.existing(ids, datasets).count() == 2 and R.missing(ids, datasets).count() == 1
    assert R.get(runs, "run-two-1234567890").first()["algorithm"] == "gbt_reg"
    with pytest.raises(LookupError):
        R.get(runs, "nobody")


def test_register_and_read_back(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "n int, s string")
    path = str(tmp_path / "registry")
    first = R.register_dataset(df, "one.csv", str(tmp_path), path)
    R.register_dataset(df.limit(1), "two.csv", str(tmp_path), path)
    entries = R.current(R.open_registry(spark, path, R.DATASET_SCHEMA))
    listed = {r["filename"]: r for r in R.dataset_list(entries).collect()}
    assert (listed["one.csv"]["row_count"], listed["two.csv"]["row_count"]) == (2, 1)
    assert listed["one.csv"]["id"] == first
    assert R.read_dataset(entries, first).count() == 2
    columns = R.dataset_columns(entries).filter(F.col("id") == first).collect()
    assert [(r["name"], r["null_count"]) for r in columns] == [("n", 0), ("s", 1)]


def test_run_lists(runs):
    assert "model_path" not in R.run_list(runs).columns
    assert R.run_summaries(runs).columns == [
        "id", "model_type", "algorithm", "features", "target", "created_at", "metrics"]


def test_reports_keep_runs_whose_dataset_is_gone(runs, datasets):
    found = {r["id"][:7]: r["dataset"]["filename"] for r in reports.model_reports(runs, datasets).collect()}
    assert found == {"run-one": "one.csv", "run-two": None, "run-thr": "one.csv"}
    assert reports.model_entries(runs, datasets).count() == 3


def test_overview(runs):
    found = {(r["section"], r["label"]): r["n"] for r in reports.overview(runs).collect()}
    assert found[("total", "Total Models")] == 3 and found[("by_type", "Regression")] == 2
    assert found[("by_algorithm", "gbt")] == 1 and len(found) == 6
    nothing = reports.overview(runs.filter("false")).collect()
    assert [(r["section"], r["n"]) for r in nothing] == [("total", 0)]
    unknown = reports.overview(runs.withColumn("algorithm", F.lit(None).cast("string"))).collect()
    assert ("by_algorithm", "Unknown", 3) in [tuple(r) for r in unknown]


def test_views(runs):
    summary = reports.summary(runs.filter("algorithm = 'gbt'")).orderBy("position").collect()
    assert [(r["label"], r["value"]) for r in summary][4:] == [
        ("Dataset ID", "d1"), ("Target Variable", "t"), ("Number of Features", "2"), ("Train Size", "10"),
        ("Test Size", "6"), ("Feature", "x"), ("Feature", "y")]
    metrics = {(r["metric"], r["value"]) for r in reports.metrics(runs).collect()}
    assert ("Accuracy", 0.9124) in metrics and ("R2", 0.25) in metrics
    assert [tuple(r)[1:] for r in reports.parameters(runs).collect()] == [("maxIter", "5")]
    cells = {(r["actual"], r["predicted"]): r["n"] for r in reports.confusion_matrices(runs).collect()}
    assert cells == {("Actual 0", "Predicted 0"): 3, ("Actual 0", "Predicted 1"): 1,
                     ("Actual 1", "Predicted 0"): 0, ("Actual 1", "Predicted 1"): 2}
    compared = {r["Algorithm"]: r for r in reports.metrics_comparison(runs).collect()}
    assert compared["gbt"]["Accuracy"] == "0.9124" and compared["gbt"]["RMSE"] is None
    assert compared["gbt_reg"]["R²"] == "N/A" and compared["gbt"]["Model ID"] == "run-one-..."
    detail = reports.type_comparison(runs, "regression")
    assert detail.columns == ["Model ID", "Algorithm", "R2", "Rmse"]
    assert {r["R2"] for r in detail.collect()} == {"N/A", "0.25"}


def test_options():
    assert reports.report_options() == ("excel", False)
    assert reports.report_options("JSON", "Yes") == ("json", True)
    assert reports.report_options("excel", "no") == ("excel", False)
    with pytest.raises(ValueError):
        reports.report_options("pdf")


def test_written_reports(spark, runs, datasets, tmp_path):
    data = spark.range(200)
    parts = reports.write_report(runs, datasets, str(tmp_path / "a"), "run-one-1234567890",
                                 include_data="true", dataset=data)
    assert sorted(parts) == ["confusion_matrix", "metrics", "parameters", "sample_data", "summary"]
    assert spark.read.csv(parts["sample_data"], header=True).count() == 100
    plain = reports.write_report(runs, datasets, str(tmp_path / "b"), "run-two-1234567890")
    assert sorted(plain) == ["metrics", "parameters", "summary"]
    both = reports.write_report(runs, datasets, str(tmp_path / "c"))
    assert sorted(both) == ["classification_models", "metrics_comparison", "overview", "regression_models"]
    one = reports.write_report(runs, datasets, str(tmp_path / "d"), "run-one-1234567890", "json")
    document = json.loads(spark.read.text(one["model"]).first()[0])
    assert document["report_type"] == "single_model" and document["data_split"] == {"train_size": 10, "test_size": 6}
    all_ = reports.write_report(runs, datasets, str(tmp_path / "e"), format="json")
    assert spark.read.json(all_["models"]).count() == 3
    with pytest.raises(LookupError):
        reports.write_report(runs.filter("false"), datasets, str(tmp_path / "f"))
    with pytest.raises(LookupError):
        reports.write_report(runs, datasets, str(tmp_path / "g"), "nobody")


def test_dashboard(runs, datasets):
    assert tuple(reports.dashboard_totals(datasets, runs).first()) == (1, 1, 3)
    assert [r["id"][:7] for r in reports.most_recent(runs, 2).collect()] == ["run-thr", "run-two"]


def test_a_hot_dataset_is_split_at_run_time(spark):
    """Half the runs were trained on one dataset: the join splits its partition."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k",
    }
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        runs = spark.range(200_000, numPartitions=8).select(
            F.sha2(F.col("id").cast("string"), 256).alias("id"),
            F.when(F.col("id") % 2 == 0, "d0").otherwise(F.concat(F.lit("d"), F.col("id") % 999)).alias("dataset_id"),
        )
        sets = spark.range(1_000).select(F.concat(F.lit("d"), "id").alias("id"), F.lit("f").alias("filename"))
        joined = reports.with_dataset(runs, sets)
        joined.write.format("noop").mode("overwrite").save()
        rows = joined.collect()
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert len(rows) == 200_000 and "skew=true" in plan
    finally:
        for key in settings:
            spark.conf.unset(key)


def state(registry):
    return sorted(tuple(r) for r in R.current(registry).select("id", "n", "updated_at").collect())


def test_snapshots_change_nothing(spark, tmp_path):
    """Puts, deletes, clears, ties and late arrivals: the state from a snapshot and its tail is that of the whole log."""
    import random

    draw, path, schema = random.Random(4), str(tmp_path / "a log"), "id string, n int"
    whole = spark.read.schema(f"{schema}, op string, updated_at timestamp_ntz")
    for step in range(8):
        rows = []
        for _ in range(25):
            op = "clear" if draw.random() < 0.02 else "delete" if draw.random() < 0.3 else "put"
            id = None if op == "clear" else f"id{draw.randrange(12)}"
            rows.append((id, draw.randrange(3), op, DAY + timedelta(minutes=draw.randrange(40))))
        R.append(spark.createDataFrame(rows, f"{schema}, op string, updated_at timestamp_ntz").coalesce(1), path)
        if step in (2, 3, 6):
            R.take_snapshot(spark, path, schema)
        opened = R.open_registry(spark, path, schema)
        assert state(opened) == state(whole.parquet(path))
        # An update of what a snapshot holds goes on from there.
    kept = R.open_registry(spark, path, schema)
    assert kept.filter("op = 'clear'").count() <= 1 + whole.parquet(path).filter("op = 'clear'").count()


def test_a_snapshot_spares_the_history(spark, tmp_path):
    """After a snapshot only its rows and later files are read."""
    path, schema = str(tmp_path / "r"), "id string, n int"
    for n in range(12):
        R.append(R.changes(spark.createDataFrame([("a", n), (f"b{n % 2}", n)], schema), at=DAY + timedelta(hours=n)).coalesce(1), path)
    assert len(R.open_registry(spark, path, schema).inputFiles()) == 12
    place = R.take_snapshot(spark, path, schema)
    opened = R.open_registry(spark, path, schema)
    assert opened.count() == 3 and all("_snapshots" in f for f in opened.inputFiles())
    R.append(R.changes(spark.createDataFrame([("c", 1)], schema), at=DAY + timedelta(days=9)).coalesce(1), path)
    opened = R.open_registry(spark, path, schema)
    assert opened.count() == 4 and sum("_snapshots" not in f for f in opened.inputFiles()) == 1
    assert {r["id"]: r["n"] for r in R.current(opened).collect()} == {"a": 11, "b0": 10, "b1": 11, "c": 1}
    # A snapshot that was not finished does not count.
    from pathlib import Path

    Path(place.removeprefix("file:"), "files", "_SUCCESS").unlink()
    assert len(R.open_registry(spark, path, schema).inputFiles()) == 13


def test_appended_rows_are_profiled_alone(spark, tmp_path):
    entries, schema = str(tmp_path / "entries"), R.DATASET_SCHEMA
    rows = spark.range(100).selectExpr("id", "nullif(id % 4, 0) AS few", "concat('t', id % 7) AS text")
    R.register_dataset(rows, "t.csv", str(tmp_path / "data"), entries, "d")
    current = lambda: R.current(R.open_registry(spark, entries, schema))
    before = current().first()
    with pytest.raises(ValueError):
        R.append_to_dataset(rows.drop("few"), current(), "d", entries)
    with pytest.raises(LookupError):
        R.append_to_dataset(rows, current(), "other", entries)
    R.append_to_dataset(rows.filter("id < 50"), current(), "d", entries)
    after = current().first()
    assert (after["row_count"], after["created_at"], after["path"]) == (150, before["created_at"], before["path"])
    assert {c["name"]: c["null_count"] for c in after["columns"]} == {"id": 0, "few": 38, "text": 0}
    found = {r["column"]: r for r in R.dataset_profile(current(), "d").collect()}
    assert found["text"]["top"] == "t0" and found["id"]["mean"] == pytest.approx((4950 + 1225) / 150, abs=1e-4)
    # A table without rows has its columns all the same.
    R.register_dataset(rows.limit(0), "none.csv", str(tmp_path / "data"), entries, "none")
    none = R.get(current(), "none").first()
    assert (none["row_count"], none["column_count"]) == (0, 3)


def test_only_rows_that_may_tie_are_shuffled_whole(spark):
    rows = spark.range(600).selectExpr("concat('id ', id) AS id", "id AS n", "repeat('wide', 50) AS text")
    again = rows.filter("n % 3 = 0").withColumn("n", F.col("n") + 1_000)
    puts = R.changes(rows.unionByName(again), at=datetime(2024, 1, 1))
    found = {r["id"]: r["n"] for r in R.current(puts.repartition(3)).collect()}
    assert len(found) == 600 and all(n % 1_000 == int(i[3:]) % 1_000 for i, n in found.items())
    assert found == {r["id"]: r["n"] for r in R.current(puts.repartition(1)).collect()}
    assert "bitmap_construct_agg" in R.current(puts)._jdf.queryExecution().optimizedPlan().toString()
