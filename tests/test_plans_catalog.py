import json

import pytest
from pyspark.sql import functions as F

from assay.operators import catalog
from assay.plans.cost import estimate_costs
from assay.plans.extract import extract_plans, validate_plans
from assay.schemas import CANDIDATE

PLAN = {
    "hypothesis": "Wetter summers go with taller oaks.",
    "target_variable": "height_m",
    "feature_variables": ["rain_mm", "altitude"],
    "task_type": "regression",
    "dataset_query": "oak heights by rainfall",
    "model_type": "xgboost",
    "needs_gpu": False,
    "machine_type": "n1-standard-4",
}


def test_plans_out_of_replies(spark):
    text = json.dumps(PLAN)
    replies = [
        (1, text), (2, f"Proposal follows\n```json\n{text}\n```"), (3, f"```\n{text}\n```"),
        (4, f"Try {text} first."), (5, "No table covers oaks."), (6, "12"),
        (7, json.dumps({**PLAN, "task_type": "guess"})), (8, "```JSON\n{broken\n```"),
        (9, json.dumps({k: v for k, v in PLAN.items() if k != "target_variable"})), (10, None),
        (11, "[1, 2]"), (12, json.dumps({**PLAN, "task_type": "clustering"})),
    ]
    df = spark.createDataFrame(replies, "id int, reply string")
    plans, rejects = extract_plans(
        df, "reply", question=F.lit("Does rain predict height?"), time_budget_minutes=F.lit(15)
    )
    rows = plans.orderBy(F.col("id").cast("int")).collect()
    assert [r.id for r in rows] == ["1", "2", "3", "4"]
    assert all(r.feature_variables == ["rain_mm", "altitude"] for r in rows)
    assert rows[0].time_budget_minutes == 15 and rows[0].compute == "auto"
    assert rows[0].question == "Does rain predict height?"
    reasons = {r.id: r.reason for r in rejects.collect()}
    assert set(reasons) == {"5", "6", "7", "8", "9", "10", "11", "12"}
    assert "plan" in reasons["5"] and "guess" in reasons["7"] and "target_variable" in reasons["9"]
    assert "clustering" in reasons["12"]


def test_validation_keeps_both_sides(spark):
    df = spark.createDataFrame(
        [("a", "regression", "auto"), ("b", None, "auto"), ("c", "regression", "svm")],
        "id string, task_type string, model_type string",
    )
    valid, rejects = validate_plans(df)
    assert [r.id for r in valid.collect()] == ["a"]
    assert {r.id for r in rejects.collect()} == {"b", "c"}


def plans(spark, *rows):
    return spark.createDataFrame(
        list(rows),
        "id string, task_type string, needs_gpu boolean, compute string, machine_type string, "
        "time_budget_minutes int",
    )


def test_costs(spark):
    df = plans(
        spark,
        ("tab", "regression", False, "vertex_ai", "n1-standard-4", 30),
        ("gpu", "nlp_classification", True, "vertex_ai", "n1-standard-8", 60),
        ("odd", "regression", False, "vertex_ai", "no-such-machine", 61),
        ("text", "nlp_regression", False, "vertex_ai", None, 5),
        ("home", "regression", False, "local", "n1-standard-4", 30),
        ("short", "regression", False, "auto", "n1-standard-4", 9),
        ("long", "regression", False, "auto", "n1-standard-4", 10),
    )
    got = {r.id: r for r in estimate_costs(df, cloud_ready=True).collect()}
    assert len(got) == 7
    assert got["tab"].estimated_cost_usd == 0.019 and got["gpu"].estimated_cost_usd == 0.076
    assert got["odd"].machine_type == "n1-standard-16"
    assert got["text"].machine_type == "n1-standard-4-t4"
    assert got["home"].estimated_cost_usd == 0.0 and got["home"].machine_type == "local"
    assert got["home"].breakdown == {}
    assert got["short"].compute_backend == "local" and got["long"].compute_backend == "vertex_ai"
    assert got["tab"].breakdown == {"machine_hourly_rate_usd": 0.038, "hours": 0.5}
    assert got["tab"].recommendation == (
        "Vertex AI n1-standard-4 spot instance (~$0.038/hr). Estimated cost: $0.019 for 30 "
        "minutes. Uses preemptible/spot pricing for maximum savings."
    )
    unready = {r.id: r.compute_backend for r in estimate_costs(df).collect()}
    assert unready["long"] == "local"
    forced = estimate_costs(df, cloud_ready=True, compute=F.lit("local"))
    assert {r.compute_backend for r in forced.collect()} == {"local"}


def test_cost_grows_with_time(spark):
    df = plans(*[spark], *[(str(m), "regression", False, "vertex_ai", "n1-standard-4", m) for m in (10, 60, 120)])
    costs = [r.estimated_cost_usd for r in estimate_costs(df).orderBy(F.col("id").cast("int")).collect()]
    assert costs == sorted(costs) and len(set(costs)) == 3


def candidates(spark, rows):
    full = [
        (i, i, s, "student exercise" if n % 2 else "", f"http://{i}", None, None, None, score, [])
        for n, (i, s, score) in enumerate(rows)
    ]
    return spark.createDataFrame(full, CANDIDATE)


def test_search_merges_limits_and_orders(spark):
    rows = [(f"k{i}", "kaggle", 0.8) for i in range(10)]
    rows += [(f"w{i}", "web", 0.5) for i in range(4)] + [("h", "huggingface", 0.7)]
    rows += [("u", "url", 0.9)]
    df = candidates(spark, rows)
    got = [r.id for r in catalog.search_catalog(df, limit_per_source=3).collect()]
    assert got == ["k0", "k1", "k2", "h", "w0", "w1", "w2"]
    only = catalog.search_catalog(df, ["kaggle"], 2, query="Exercise STUDENT").collect()
    assert [r.id for r in only] == ["k1", "k3"]
    assert catalog.search_catalog(df, []).count() == 0
    best = catalog.best_candidate(df.withColumn("q", F.lit(1)), ["q"]).collect()
    assert [r.id for r in best] == ["k0"]


@pytest.mark.parametrize("k", [3, 1500])
def test_top_per_group_is_exact_for_any_k(spark, k):
    df = spark.range(9000).selectExpr("id", "CASE WHEN id % 3 = 0 THEN 'hot' ELSE 'cold' END AS g")
    got = catalog.top_per_group(df, ["g"], [F.desc("id")], k)
    for g, ids in (("hot", [i for i in range(9000) if i % 3 == 0]),
                   ("cold", [i for i in range(9000) if i % 3])):
        assert sorted(r.id for r in got.filter(F.col("g") == g).collect()) == ids[-k:]


def test_cache_hits_and_misses(spark):
    df = candidates(spark, [("user/a", "kaggle", 0.8), ("b/c", "huggingface", 0.7), ("x", "ftp", 0.1)])
    files = spark.createDataFrame(
        [("kaggle/user/a", "kaggle/user/a/2.csv"), ("kaggle/user/a", "kaggle/user/a/1.csv"),
         ("huggingface/b_c", "huggingface/b_c/readme.txt")],
        "cache_key string, path string",
    )
    hits, misses = catalog.split_by_cache(df, files)
    row = hits.collect()
    assert [(r.id, r.local_path, r.cached) for r in row] == [("user/a", "kaggle/user/a/1.csv", True)]
    assert {r.id: (r.success, r.cached, r.error) for r in misses.collect()} == {
        "b/c": (None, False, None), "x": (False, False, "Unknown source: ftp"),
    }
