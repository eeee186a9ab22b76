from pyspark.sql import functions as F

from assay.sources import records, tracker
from assay.sources.tracker import Setting

ROWS = [
    ("a", "p", "first", '{"optimizer": {"lr": 0.1, "name": "adam"}, "depth": 6, "layers": [8, 4]}', ["x", "y"]),
    ("b", "p", None, '{"optimizer": {"lr": "0.2"}, "depth": "deep", "layers": []}', ["x"]),
    ("c", None, "third", "{broken", None),
    ("d", "p", "", '{"optimizer": null, "depth": null}', []),
    ("e", "p", "e", None, ["y", None]),
]
SCHEMA = "run_id string, project string, run_name string, config string, tags array<string>"


def tracked(spark, tmp_path):
    path = str(tmp_path / "runs")
    tracker.init_runs(spark.createDataFrame(ROWS[:2], SCHEMA), path)
    tracker.init_runs(spark.createDataFrame(ROWS[2:], SCHEMA).withColumn("config", F.try_parse_json("config")), path)
    return tracker.read_tracked(spark, path)


def test_settings_by_path(spark, tmp_path):
    wanted = {
        "lr": Setting("$.optimizer.lr", "double", 0.5),
        "depth": Setting("$.depth", "int", 3),
        "first": Setting("$.layers[0]", "int"),
        "opt": Setting("$.optimizer.name", "string", "sgd"),
    }
    rows = tracker.with_settings(tracked(spark, tmp_path), wanted).collect()
    assert {r.run_id: (r.lr, r.depth, r["first"], r.opt) for r in rows} == {
        "a": (0.1, 6, 8, "adam"),
        "b": (0.2, 3, None, "sgd"),
        "c": (0.5, 3, None, "sgd"),
        "d": (0.5, 3, None, "sgd"),
        "e": (0.5, 3, None, "sgd"),
    }


def test_tags(spark, tmp_path):
    runs = tracked(spark, tmp_path)
    ids = lambda df: {r.run_id for r in df.collect()}
    assert ids(tracker.tagged(runs, "x")) == {"a", "b"}
    assert ids(tracker.tagged(runs, "x", "y")) == {"a"}
    assert ids(tracker.tagged(runs)) == {"a", "b", "c", "d", "e"}


def test_best_run_per_setting(spark, tmp_path):
    scores = spark.createDataFrame([("a", 0.7), ("b", 0.9), ("c", 0.9), ("d", float("nan"))], "run_id string, value double")
    best = tracker.best_by_setting(tracked(spark, tmp_path), scores, Setting("$.depth", "int", 3))
    assert {tuple(r) for r in best.collect()} == {(6, "a", 0.7, 1), (3, "b", 0.9, 4)}


def test_runs_by_creation_time(spark, tmp_path):
    path = str(tmp_path / "records")
    times = {"a": "2024-03-01T00:00:00", "b": "2024-01-01T10:00:00.5", "c": None, "d": "2024-01-01T11:30:00+02:00", "e": "soon"}
    rows = spark.createDataFrame(list(times.items()), "id string, t string").selectExpr(
        "id", "named_struct('created_at', t) AS plan", "'training' AS status"
    )
    records.write_run_records(rows, path)
    assert [r.id for r in records.read_run_records(spark, path).collect()] == ["d", "b", "a", "c", "e"]
