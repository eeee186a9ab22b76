import pytest
from pyspark.sql import functions as F

from assay.functions.numbers import fixed, half_even
from assay.operators.answers import answer, evaluate, summarize, top_features, with_report
from assay.schemas import METRICS

SCHEMA = (
    "task_type string, feature_variables array<string>, r2 double, rmse double, accuracy double, "
    "f1 double, n_classes int, feature_importance map<string,double>"
)


def judge(spark, task, r2=None, rmse=None, accuracy=None, f1=None, n=None, weights=None):
    row = (task, ["hours"], r2, rmse, accuracy, f1, n, weights)
    return evaluate(spark.createDataFrame([row], SCHEMA)).first()


CASES = [
    ("regression", dict(r2=0.78, rmse=0.25), "confirmed", 0.88, 0),
    ("regression", dict(r2=0.72, rmse=0.31), "confirmed", 0.82, 0),
    ("time_series", dict(r2=0.72, rmse=0.31), "confirmed", 0.82, 0),
    ("regression", dict(r2=0.15, rmse=0.8), "inconclusive", 0.25, 1),
    ("regression", dict(r2=0.02, rmse=0.9), "rejected", 0.12, 1),
    ("binary_classification", dict(accuracy=0.88, f1=0.86), "confirmed", 0.76, 0),
    ("binary_classification", dict(accuracy=0.52, f1=0.5), "rejected", 0.04, 1),
    ("multiclass_classification", dict(accuracy=0.5, n=4), "confirmed", 0.333, 0),
    ("regression", dict(r2=float("nan"), rmse=0.1), "inconclusive", 0.0, 1),
    ("regression", {}, "rejected", 0.1, 2),
    ("nlp_classification", dict(accuracy=0.9), "inconclusive", 0.5, 0),
    ("regression", dict(r2=0.0999), "rejected", 0.2, 1),
    ("regression", dict(r2=0.10), "inconclusive", 0.2, 1),
    ("regression", dict(r2=0.3999), "inconclusive", 0.5, 1),
    ("regression", dict(r2=0.40), "confirmed", 0.5, 0),
    ("regression", dict(r2=-3.0), "rejected", 0.1, 1),
    ("regression", dict(r2=1.0), "confirmed", 0.99, 0),
    ("binary_classification", dict(accuracy=0.5499), "rejected", 0.1, 1),
    ("binary_classification", dict(accuracy=0.56), "inconclusive", 0.12, 1),
    ("binary_classification", dict(accuracy=0.6499), "inconclusive", 0.3, 1),
    ("binary_classification", dict(accuracy=0.65), "confirmed", 0.3, 0),
    ("binary_classification", dict(accuracy=0.1), "rejected", 0.01, 1),
    ("binary_classification", dict(accuracy=1.0, n=0), "confirmed", 0.99, 0),
]


def test_verdicts(spark):
    names = ("r2", "rmse", "accuracy", "f1", "n")
    rows = [
        (i, task, ["hours"], *(metrics.get(n) for n in names), None)
        for i, (task, metrics, *_) in enumerate(CASES)
    ]
    judged = evaluate(spark.createDataFrame(rows, "i int, " + SCHEMA)).orderBy("i").collect()
    for got, (task, metrics, verdict, confidence, caveats) in zip(judged, CASES, strict=True):
        assert got.verdict == verdict, (task, metrics)
        assert got.confidence == pytest.approx(confidence), (task, metrics)
        assert 0.0 <= got.confidence <= 1.0
        assert len(got.limitations) == caveats, (task, metrics)


def test_sentences(spark):
    got = judge(spark, "regression", r2=0.15, rmse=0.8)
    assert got.evidence_summary == (
        "The model explains 15.0% of the variance in the target (R²=0.150), suggesting the "
        "hypothesis is inconclusive with 25% confidence. 'hours' is among the features considered."
    )
    assert got.limitations == [
        "Model explains only 15.0% of variance (R²=0.150). "
        "Other factors not captured in the dataset may be important."
    ]
    got = judge(spark, "binary_classification", accuracy=0.52, f1=0.5)
    assert got.evidence_summary == (
        "The classifier achieved 52.0% accuracy, indicating the hypothesis is rejected "
        "with 4% confidence."
    )
    assert got.limitations == [
        "Model accuracy (52.0%) is close to the baseline (50.0%). "
        "The features may have limited predictive power."
    ]
    assert [(m["name"], m["value"]) for m in got.key_metrics] == [("accuracy", 0.52), ("f1", 0.5)]


def test_decimals_follow_the_exact_value(spark):
    values = [0.15625, 2.675, 0.125, 0.375, -0.125, 1.005, 0.5445, 28.5, 88.5, 93.75, -0.01, 1e15]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    for digits in (0, 1, 2, 3, 4):
        rows = df.select("x", fixed(F.col("x"), digits).alias("t"), half_even(F.col("x"), digits).alias("r"))
        for r in rows.collect():
            assert r.t == f"{r.x:.{digits}f}"
            assert r.r == round(r.x, digits)


def test_importance_order_and_report(spark):
    weights = {"a": 0.1, "b": 0.3, "c": 0.3, "d": 0.05, "e": 0.15, "f": 0.1}
    row = ("r1", "regression", ["a"], 0.5, 0.2, None, None, None, weights, "Does a matter?", None)
    df = spark.createDataFrame(
        [row], "run_id string, " + SCHEMA + ", question string, tracker_url string"
    )
    answers = with_report(evaluate(df))
    got = answers.first()
    assert [e.feature for e in got.importance] == ["b", "c", "e", "a", "f", "d"]
    assert [(r.position, r.feature) for r in top_features(answers, ["run_id"]).orderBy("position").collect()] == [
        (1, "b"), (2, "c"), (3, "e"), (4, "a"), (5, "f"),
    ]
    assert got.full_report == (
        "# Experiment Report\n\n## Question\nDoes a matter?\n\n## Verdict: ✅ CONFIRMED\n"
        "*Confidence: 60%*\n\n## Summary\n" + got.evidence_summary + "\n\n## Key Metrics\n"
        "- **r2**: 0.5000\n- **rmse**: 0.2000\n\n## Feature Importance (top 5)\n- `b`: 0.3000\n"
        "- `c`: 0.3000\n- `e`: 0.1500\n- `a`: 0.1000\n- `f`: 0.1000\n\n## Limitations\n"
        "None identified.\n\n\n"
    )


def test_answer_gate_and_overrides(spark):
    runs = spark.createDataFrame(
        [
            ("a", "complete", "q?", "h", "regression", ["x"], "http://t/a", "auto"),
            ("b", "training", "q?", "h", "regression", ["x"], None, "auto"),
            ("c", "failed", "q?", "h", "regression", [], None, "auto"),
        ],
        "run_id string, status string, question string, hypothesis string, task_type string, "
        "feature_variables array<string>, tracker_url string, model_type string",
    ).withColumn("error", F.lit(None).cast("string"))
    metrics = spark.createDataFrame(
        [("a", 0.85, 0.1, None, None, None, None)],
        "run_id string, " + METRICS.simpleString()[7:-1].replace(":", " ", 6),
    )
    asks = spark.createDataFrame(
        [("a", "mine?", ""), ("b", "", ""), ("c", "", ""), ("zz", "", "")],
        "run_id string, ask_question string, ask_hypothesis string",
    )
    found, errors = answer(runs, metrics, asks)
    row = found.first()
    assert (row.run_id, row.question, row.hypothesis, row.verdict) == (
        "a", "mine?", "h", "confirmed",
    )
    assert row.full_report.endswith("## W&B Run\nhttp://t/a\n")
    assert {r.run_id: r.error for r in errors.collect()} == {
        "b": "Experiment is still training. Wait for completion.",
        "c": "metrics.json not found. Training may not have completed.",
        "zz": "Experiment zz not found",
    }
    plain, _ = answer(runs, metrics)
    listed = summarize(runs, plain).collect()
    assert [(r.run_id, r.verdict) for r in listed] == [("a", "confirmed"), ("b", "-"), ("c", "-")]
