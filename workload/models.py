"""Fitted models: rows-only checks, their properties are tested apart."""

from pyspark.sql import functions as F

from assay.operators.prepare import Prepared, prepare
from assay.operators.split import add_split
from assay.operators.train import train_tabular, train_text
from workload.inputs import STUDY_SQL, normal_sql, split_sql, study, table, wide_table
from workload.registry import query

# Fewer and shallower trees than the defaults, which take minutes: README has the figures.
TREES = 30
#: Trees, depth and bins of the forests.
FOREST = (10, 10, 32)
FEATURES = ["acctbal", "step", "segment", "priority"]
METRICS = ["r2", "rmse", "accuracy", "f1", "n_classes"]


def regression(spark, sf) -> Prepared:
    return prepare(study(spark, sf), "medium", "regression", FEATURES, key="o_orderkey")


def classes(spark, sf, target: str = "level") -> Prepared:
    """Two levels (above the middle step or not) or the three order states."""
    rows = study(spark, sf).withColumn(
        "level", F.when(F.col("medium") > 35000, "high").otherwise("low")
    )
    task = "binary_classification" if target == "level" else "multiclass_classification"
    return prepare(rows, target, task, FEATURES, key="o_orderkey")


def scored(trained, model: str):
    return trained.metrics.select(F.lit(model).alias("model"), *METRICS)


@query("train_eval_gbt")
def train_eval_gbt(spark, sf):
    return scored(train_tabular(regression(spark, sf), "regression", "xgboost", TREES), "gbt")


@query("train_eval_gbt_classes")
def train_eval_gbt_classes(spark, sf):
    ready = classes(spark, sf, "status")
    return scored(train_tabular(ready, "multiclass_classification", "lightgbm", TREES), "gbt_classes")


@query("train_eval_rf")
def train_eval_rf(spark, sf):
    ready = classes(spark, sf)
    return scored(train_tabular(ready, "binary_classification", "random_forest", *FOREST), "rf")


@query("train_eval_logreg")
def train_eval_logreg(spark, sf):
    ready = classes(spark, sf)
    return scored(
        train_tabular(ready, "binary_classification", "logistic_regression"), "logreg"
    )


LINEAR_SQL = f"""{STUDY_SQL}, fill AS (SELECT median(acctbal) AS a FROM study),
    mode AS (SELECT priority AS q FROM study WHERE priority IS NOT NULL
      GROUP BY priority ORDER BY count(*) DESC, priority LIMIT 1),
    filled AS (SELECT o_orderkey, coalesce(acctbal, a) AS acctbal, step, segment,
      coalesce(priority, q) AS priority, medium FROM study, fill, mode),
    coded AS (SELECT o_orderkey, acctbal, step, dense_rank() OVER (ORDER BY segment) - 1 AS segment,
      dense_rank() OVER (ORDER BY priority) - 1 AS priority, medium FROM filled),
    {split_sql('coded', 'o_orderkey')}, {normal_sql('parts', FEATURES, 'medium')}"""


@query(
    "train_eval_linreg",
    f"""WITH {LINEAR_SQL} SELECT 'linreg' AS model, round(r2, 6) AS r2, round(rmse, 3) AS rmse,
    CAST(NULL AS DOUBLE) AS accuracy, CAST(NULL AS DOUBLE) AS f1, CAST(NULL AS INT) AS n_classes
    FROM solved""",
)
def train_eval_linreg(spark, sf):
    found = scored(train_tabular(regression(spark, sf), "regression", "linear_regression"), "linreg")
    return found.withColumns({"r2": F.round("r2", 6), "rmse": F.round("rmse", 3)})


@query("feature_importance")
def feature_importance(spark, sf):
    found = train_tabular(regression(spark, sf), "regression", "random_forest", *FOREST).metrics
    return found.select(
        F.lit("rf").alias("run_id"), F.explode("feature_importance").alias("feature", "importance")
    )


def labelled_texts(spark, sf, *targets: str):
    docs = wide_table(spark, sf, "documents").select("doc_id", "text")
    labels = table(spark, sf, "labels").select("doc_id", *targets)
    return add_split(docs.join(labels, "doc_id"), "doc_id")


@query("text_classify")
def text_classify(spark, sf):
    docs = labelled_texts(spark, sf, "quality")
    return scored(train_text(docs, "text", "quality"), "text_classify")


@query("text_regress")
def text_regress(spark, sf):
    docs = labelled_texts(spark, sf, "toxic")
    return scored(
        train_text(docs, "text", "toxic", "nlp_regression", n_max=2), "text_regress"
    )
