"""Every broken rule of a record row is listed."""

import pytest

from assay.operators.validate import RECORDS, validate


def found(df, kind):
    sound, rejects = validate(df, kind)
    assert sound.columns == df.columns
    return sound.count(), {r[0]: r.reasons for r in rejects.collect()}


def test_candidates(spark):
    df = spark.createDataFrame(
        [("a", "n", "web", "", "u", "1.5"), ("b", None, "attic", None, "u", "big"), ("c", "n", None, "d", "u", None)],
        "id string, name string, source string, description string, url string, size_mb string",
    )
    sound, rejects = found(df, "candidate")
    assert sound == 1 and rejects == {
        "b": [
            "name is missing", "description is missing", "size_mb is not of type double: big",
            "source is not one of the allowed values: attic",
        ],
        "c": ["source is missing"],
    }


def test_runs_hold_plans_and_answers(spark):
    plan = "struct<question:string,hypothesis:string,target_variable:string,task_type:string,dataset_query:string>"
    answer = "struct<question:string,hypothesis:string,verdict:string,confidence:double,evidence_summary:string,key_metrics:map<string,double>>"
    good = ("q", "h", "y", "regression", "d")
    said = ("q", "h", "confirmed", 0.5, "e", {"r2": 0.5})
    rows = [
        ("1", good, "complete", "local", said),
        ("2", None, "complete", None, None),
        ("3", ("q", None, "y", "guessing", "d"), "dreaming", "abacus", ("q", "h", "sure", 1.5, None, None)),
        ("4", good, None, None, (*said[:3], float("nan"), *said[4:])),
    ]
    df = spark.createDataFrame(rows, f"id string, plan {plan}, status string, compute_backend string, answer {answer}")
    sound, rejects = found(df, "run")
    assert sound == 1 and rejects["2"] == ["plan is missing"]
    assert rejects["3"] == [
        "status is not one of the allowed values: dreaming",
        "compute_backend is not one of the allowed values: abacus",
        "plan.hypothesis is missing",
        "plan.task_type is not one of the allowed values: guessing",
        "answer.evidence_summary is missing",
        "answer.key_metrics is missing",
        "answer.verdict is not one of the allowed values: sure",
        "answer.confidence is not from 0.0 to 1.0: 1.5",
    ]
    assert rejects["4"] == ["answer.confidence is not from 0.0 to 1.0: NaN"]


def test_absent_columns_and_empty_tables(spark):
    df = spark.createDataFrame([("x",)], "question string")
    assert validate(df, "answer")[1].first().reasons == [
        f"{c} is missing" for c in RECORDS["answer"].required if c != "question"
    ]
    assert validate(df.limit(0), "plan")[0].count() == 0
    long = spark.createDataFrame([("i", "n", "s" * 10_000, "d", "u")], "id string, name string, source string, description string, url string")
    assert len(validate(long, "candidate")[1].first().reasons[0]) < 200
    with pytest.raises(ValueError, match="unknown record"):
        validate(df, "cat")
