import math
import random

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from assay.operators.experiment import Plan, answer_plan, run_experiment
from assay.operators.metrics import clf_metrics, reg_metrics
from assay.operators.prepare import prepare
from assay.operators.segments import holdout_line, holdout_linear
from assay.operators.runs import latest_runs, merged_metrics
from assay.operators.split import add_split
from assay.operators.train import _index_labels, build_estimator, train, train_tabular, train_text
from assay.sources.records import read_events


@pytest.fixture(scope="module")
def signal(spark):
    random.seed(3)
    rows = []
    for i in range(400):
        x, z = random.uniform(-5, 5), random.uniform(-5, 5)
        y = 3 * x + random.gauss(0, 0.5)
        rows.append((i, x, z, y, "hi" if y > 0 else "lo", "abc"[min(2, max(0, int((y + 15) // 10)))]))
    return spark.createDataFrame(
        rows, "k int, x double, z double, y double, side string, band string"
    ).cache()


def test_model_choice(spark):
    boosted = build_estimator("auto", "regression")
    assert (boosted.objective, boosted.rounds, boosted.width) == ("squared", 300, 1)
    assert build_estimator("bert", "binary_classification").objective == "logistic"
    boosted = build_estimator("lightgbm", "multiclass_classification", classes=3)
    assert (boosted.objective, boosted.width) == ("softmax", 3)
    assert build_estimator("random_forest", "regression").getMaxDepth() == 30
    assert build_estimator("random_forest", "regression", max_depth=4, max_bins=64).getMaxBins() == 64
    assert isinstance(build_estimator("logistic_regression", "regression"), LinearRegression)
    assert isinstance(
        build_estimator("linear_regression", "binary_classification"), LogisticRegression
    )
    assert build_estimator("random_forest", "time_series", 7).getNumTrees() == 7


@pytest.mark.parametrize("model", ["xgboost", "lightgbm", "random_forest", "linear_regression"])
def test_regressors_beat_the_mean(signal, model):
    ready = prepare(signal, "y", "regression", ["x", "z"], key="k")
    row = train_tabular(ready, "regression", model, 10).metrics.first()
    assert row.r2 > 0.8 and row.rmse > 0 and row.accuracy is None
    if model == "linear_regression":
        assert row.feature_importance is None
    else:
        assert sum(row.feature_importance.values()) == pytest.approx(1.0)
        assert row.feature_importance["x"] > row.feature_importance["z"]


@pytest.mark.parametrize(
    "model,target,classes",
    [("random_forest", "side", 2), ("logistic_regression", "side", 2), ("xgboost", "side", 2),
     ("xgboost", "band", 3), ("logistic_regression", "band", 3)],
)
def test_classifiers(signal, model, target, classes):
    ready = prepare(signal, target, "multiclass_classification", ["x", "z"], key="k")
    row = train_tabular(ready, "multiclass_classification", model, 5).metrics.first()
    assert row.accuracy > 0.85 and row.f1 > 0.8 and row.n_classes == classes and row.r2 is None


def test_linear_regression_is_least_squares(signal):
    ready = prepare(signal, "y", "regression", ["x", "z"], key="k")
    row = train_tabular(ready, "regression", "linear_regression").metrics.first()
    tr, te = (np.array(ready.frame.filter(F.col("split") == s).select("x", "z", "y").collect())
              for s in ("train", "test"))
    a = np.c_[tr[:, :2], np.ones(len(tr))]
    w, *_ = np.linalg.lstsq(a, tr[:, 2], rcond=None)
    err = te[:, 2] - np.c_[te[:, :2], np.ones(len(te))] @ w
    assert row.rmse == pytest.approx(math.sqrt((err**2).mean()), rel=1e-6)
    assert row.r2 == pytest.approx(1 - (err**2).sum() / ((te[:, 2] - te[:, 2].mean()) ** 2).sum())


def test_logistic_regression_finds_the_ridge_optimum(spark):
    random.seed(1)
    rows = [(i, float(i % 10), int(i % 10 + random.gauss(0, 2) > 5)) for i in range(200)]
    ready = prepare(spark.createDataFrame(rows, "k int, x double, y int"), "y",
                    "binary_classification", key="k")
    fitted = train_tabular(ready, "binary_classification", "logistic_regression").model.stages[-1]
    data = np.array(ready.train.select("x", "y").collect(), dtype=float)
    w, b = float(fitted.coefficients[0]), float(fitted.intercept)
    p = 1 / (1 + np.exp(-(w * data[:, 0] + b)))
    # Gradient of sum of losses + w^2 / 2 is zero.
    assert abs(((p - data[:, 1]) * data[:, 0]).sum() + w) < 1.0
    assert abs((p - data[:, 1]).sum()) < 0.5


@pytest.mark.parametrize("model", ["random_forest", "xgboost"])
def test_saved_model_predicts_the_same(signal, tmp_path, model):
    ready = prepare(signal, "y", "regression", ["x", "z"], key="k")
    fitted = train_tabular(ready, "regression", model, 5)
    fitted.save(str(tmp_path / "model"))
    again = PipelineModel.load(str(tmp_path / "model")).transform(ready.test)
    mine = fitted.model.transform(ready.test)
    pairs = mine.select("k", F.col("prediction").alias("a")).join(
        again.select("k", F.col("prediction").alias("b")), "k"
    )
    assert pairs.filter("a <> b").count() == 0 and pairs.count() == 80


def test_same_seed_same_metrics(signal):
    ready = prepare(signal, "y", "regression", ["x", "z"], key="k")
    one, two = (train_tabular(ready, "regression", "random_forest", 5).metrics.first() for _ in "ab")
    assert one == two


def test_weighted_f1(spark):
    rows = [(0.0, 0.0)] * 6 + [(1.0, 0.0)] * 3 + [(1.0, 1.0)] * 5 + [(2.0, 1.0)] * 2
    df = spark.createDataFrame(rows, "label double, prediction double").repartition(3)
    row = clf_metrics(df).first()
    assert row.accuracy == pytest.approx(11 / 16) and row.n_classes == 3
    want = MulticlassClassificationEvaluator(metricName="f1").evaluate(df)
    assert row.f1 == pytest.approx(want)
    assert clf_metrics(df.limit(0)).first().accuracy is None


def test_r2_guard(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 0.0)], "label double, prediction double")
    row = reg_metrics(df).first()
    assert row.rmse == 1.0 and math.isnan(row.r2)
    assert reg_metrics(df.limit(0)).first().r2 is None


def test_batch_line_equals_fit_and_score(signal):
    rows = add_split(signal.withColumn("g", F.col("k") % 3), "k")
    got = {r.g: r for r in holdout_line(rows, F.col("x"), F.col("y"), ["g"]).collect()}
    for g in range(3):
        tr, te = (
            np.array(rows.filter((F.col("g") == g) & (F.col("split") == s)).select("x", "y").collect())
            for s in ("train", "test")
        )
        slope, intercept = np.polyfit(tr[:, 0], tr[:, 1], 1)
        err = te[:, 1] - slope * te[:, 0] - intercept
        assert got[g].slope == pytest.approx(slope) and got[g].n_test == len(te)
        assert got[g].rmse == pytest.approx(math.sqrt((err**2).mean()))


def test_linear_segments_equal_fit_and_score(spark):
    rng = np.random.default_rng(4)
    rows = []
    for g in ("a", "b", "twin", "few", "flat", "unheld"):
        for i in range(3 if g == "few" else 80):
            x, z = float(rng.normal(1e6, 3)), float(rng.normal(0, 1e-3))
            w = 2 * x if g == "twin" else float(rng.normal())
            y = 5.0 if g == "flat" else x - 4000 * z + w + float(rng.normal())
            part = "train" if g == "unheld" or i % 4 else "test"
            rows.append((g, part, x, z, w if i != 7 else None, y))
    rows.append(("untrained", "test", 1.0, 1.0, 1.0, 1.0))
    df = spark.createDataFrame(rows, "g string, split string, x double, z double, w double, y double").repartition(5)
    got = {r.g: r for r in holdout_linear(df, ["x", "z", "w"], "y", ["g"]).collect()}
    assert len(got) == 7
    for g in ("a", "b", "twin", "flat"):
        own = [r for r in rows if r[0] == g and r[4] is not None]
        tr, te = (np.array([r[2:] for r in own if r[1] == s]) for s in ("train", "test"))
        mean = tr.mean(axis=0)
        w, *_ = np.linalg.lstsq((tr[:, :3] - mean[:3]) / tr[:, :3].std(axis=0), tr[:, 3] - mean[3], rcond=1e-6)
        err = te[:, 3] - mean[3] - (te[:, :3] - mean[:3]) / tr[:, :3].std(axis=0) @ w
        assert (got[g].n_train, got[g].n_test) == (len(tr), len(te))
        assert got[g].rmse == pytest.approx(math.sqrt((err**2).mean()), rel=1e-5, abs=1e-6)
        if g == "flat":
            assert math.isnan(got[g].r2)
        else:
            assert got[g].r2 == pytest.approx(1 - (err**2).mean() / te[:, 3].var(), rel=1e-5)
    assert got["unheld"].rmse is None and got["unheld"].coefficients[0] == pytest.approx(1, abs=0.3)
    assert got["untrained"].coefficients is None and got["untrained"].rmse is None
    assert len(holdout_linear(df, ["x"], "y").collect()) == 1
    assert holdout_linear(df.limit(0), ["x"], "y", ["g"]).count() == 0


def test_text_models(spark, tmp_path):
    good, bad = "bright happy great day", "sad gloomy awful rain"
    rows = [(i, (good if i % 2 else bad) + f" word{i % 5}", i % 2, float(i % 2)) for i in range(60)]
    df = add_split(spark.createDataFrame(rows, "k int, text string, y int, score double"), "k")
    row = train_text(df, "text", "y").metrics.first()
    assert row.accuracy == 1.0 and row.n_classes == 2
    fitted = train_text(df, "text", "score", "nlp_regression", n_max=2)
    row = fitted.metrics.first()
    assert row.r2 > 0.8 and row.accuracy is None
    fitted.save(str(tmp_path / "model"))
    new = spark.createDataFrame([("great happy day",), ("awful rain",), (None,)], "text string")
    high, low, _ = PipelineModel.load(str(tmp_path / "model")).transform(new).collect()
    assert high.prediction > 0.5 > low.prediction


def test_clustering_is_refused(signal):
    ready = prepare(signal, "y", "clustering", ["x"], key="k")
    with pytest.raises(ValueError, match="clustering"):
        train(ready, "clustering")


def test_experiment_end_to_end(spark, signal, tmp_path):
    log = str(tmp_path / "events")
    plan = Plan("r1", "Does x predict y?", "It does.", "y", "regression", ["x", "z"], "random_forest")
    done = run_experiment(signal, plan, "k", 5, event_log=log)
    assert done.error is None
    got = answer_plan(plan, done.metrics).first()
    assert got.verdict == "confirmed" and got.confidence >= 0.7
    assert got.full_report.startswith("# Experiment Report")
    lost = run_experiment(signal, Plan("r2", "q", "h", "nope", "regression", []), event_log=log)
    assert "nope" in lost.error and lost.metrics.count() == 0
    events = read_events(spark, log)
    assert {r.run_id: r.status for r in latest_runs(events).collect()} == {
        "r1": "complete", "r2": "failed",
    }
    assert {r.name for r in merged_metrics(events).collect()} == {"r2", "rmse"}
    # A repeated run comes after the first, in any order of rows.
    run_experiment(signal, Plan("r1", "q", "h", "nope", "regression", []), event_log=log)
    for rows in (read_events(spark, log).orderBy("seq"), read_events(spark, log).orderBy(F.desc("seq"))):
        assert latest_runs(rows).filter("run_id = 'r1'").first().status == "failed"


def test_text_experiment_keeps_its_text(spark):
    rows = [(i, "up up" if i % 2 else "down down", "ab"[i % 2]) for i in range(40)]
    df = spark.createDataFrame(rows, "k int, body string, mood string")
    plan = Plan("t", "q", "h", "mood", "nlp_classification", [])
    done = run_experiment(df, plan, "k")
    assert done.error is None and done.metrics.first().accuracy == 1.0
    assert answer_plan(plan, done.metrics).first().verdict == "inconclusive"


def test_text_column_comes_from_the_plan(spark):
    rows = [(i, f"t{i}", "up up" if i % 2 else "down down", "ab"[i % 2]) for i in range(40)]
    df = spark.createDataFrame(rows, "k int, title string, review string, mood string")
    plan = Plan("t", "q", "h", "mood", "nlp_classification", ["review"])
    assert run_experiment(df, plan, "k").metrics.first().accuracy == 1.0
    named = Plan("t", "q", "h", "mood", "nlp_classification", [], text_column="review")
    assert run_experiment(df, named, "k").metrics.first().accuracy == 1.0


def test_classes_have_no_cap(spark):
    labels = spark.range(10_001).select(F.concat(F.lit("c"), "id").alias("y"))
    assert len(_index_labels(labels, "y").labels) == 10_001
