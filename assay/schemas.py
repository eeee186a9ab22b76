"""Record schemas and the values their closed fields may take."""

from pyspark.sql import types as T

# Members of the closed fields.
CANDIDATE_SOURCES = ["kaggle", "huggingface", "url", "web"]
SEARCH_SOURCES = ["kaggle", "huggingface", "web"]
TASK_TYPES = [
    "binary_classification",
    "multiclass_classification",
    "regression",
    "nlp_classification",
    "nlp_regression",
    "clustering",
    "time_series",
]
MODEL_TYPES = [
    "xgboost",
    "lightgbm",
    "random_forest",
    "logistic_regression",
    "linear_regression",
    "bert",
    "distilbert",
    "auto",
]
COMPUTE_CHOICES = ["local", "vertex_ai", "auto"]
BACKENDS = ["local", "vertex_ai"]
RUN_STATUSES = [
    "pending",
    "searching",
    "downloading",
    "preparing",
    "training",
    "analyzing",
    "complete",
    "failed",
]
VERDICTS = ["confirmed", "rejected", "inconclusive"]

# Relevance of a candidate by where it was found.
SOURCE_RELEVANCE = {"kaggle": 0.8, "huggingface": 0.7, "web": 0.5}

# USD per hour by machine type.
HOURLY_RATES = {
    "n1-standard-2": 0.019,
    "n1-standard-4": 0.038,
    "n1-standard-8": 0.076,
    "n1-standard-16": 0.152,
    "n1-standard-32": 0.304,
    "n1-highmem-4": 0.050,
    "n1-highmem-8": 0.100,
    "n2-standard-4": 0.042,
    "n2-standard-8": 0.084,
    "n1-standard-4-t4": 0.11,
    "n1-standard-8-t4": 0.148,
    "a2-highgpu-1g": 0.75,
}

REGRESSION_TASKS = ["regression", "time_series"]
CLASS_TASKS = ["binary_classification", "multiclass_classification"]
TEXT_TASKS = ["nlp_classification", "nlp_regression"]

CANDIDATE = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("url", T.StringType()),
        T.StructField("size_mb", T.DoubleType()),
        T.StructField("num_rows", T.LongType()),
        T.StructField("num_columns", T.LongType()),
        T.StructField("relevance_score", T.DoubleType()),
        T.StructField("tags", T.ArrayType(T.StringType())),
    ]
)

PLAN = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("question", T.StringType()),
        T.StructField("hypothesis", T.StringType()),
        T.StructField("target_variable", T.StringType()),
        T.StructField("feature_variables", T.ArrayType(T.StringType())),
        T.StructField("task_type", T.StringType()),
        T.StructField("dataset_query", T.StringType()),
        T.StructField("suggested_dataset_ids", T.ArrayType(T.StringType())),
        T.StructField("model_type", T.StringType()),
        T.StructField("needs_gpu", T.BooleanType()),
        T.StructField("compute", T.StringType()),
        T.StructField("machine_type", T.StringType()),
        T.StructField("time_budget_minutes", T.IntegerType()),
        T.StructField("estimated_cost_usd", T.DoubleType()),
        T.StructField("created_at", T.StringType()),
        T.StructField("description", T.StringType()),
    ]
)

IMPORTANCE = T.MapType(T.StringType(), T.DoubleType())

METRICS = T.StructType(
    [
        T.StructField("r2", T.DoubleType()),
        T.StructField("rmse", T.DoubleType()),
        T.StructField("accuracy", T.DoubleType()),
        T.StructField("f1", T.DoubleType()),
        T.StructField("n_classes", T.IntegerType()),
        T.StructField("feature_importance", IMPORTANCE),
    ]
)

COLUMN_PROFILE = T.StructType(
    [
        T.StructField("dtype", T.StringType()),
        T.StructField("null_pct", T.DoubleType()),
        T.StructField("unique_count", T.LongType()),
        T.StructField("sample_values", T.ArrayType(T.StringType())),
    ]
)

DATA_PROFILE = T.StructType(
    [
        T.StructField("num_rows", T.LongType()),
        T.StructField("num_columns", T.IntegerType()),
        T.StructField("columns", T.MapType(T.StringType(), COLUMN_PROFILE)),
        T.StructField("target_column", T.StringType()),
        T.StructField("target_distribution", T.MapType(T.StringType(), T.DoubleType())),
        T.StructField("recommended_task_type", T.StringType()),
        T.StructField("warnings", T.ArrayType(T.StringType())),
    ]
)

ANSWER = T.StructType(
    [
        T.StructField("question", T.StringType()),
        T.StructField("hypothesis", T.StringType()),
        T.StructField("verdict", T.StringType()),
        T.StructField("confidence", T.DoubleType()),
        T.StructField("evidence_summary", T.StringType()),
        T.StructField("key_metrics", IMPORTANCE),
        T.StructField("feature_importance", IMPORTANCE),
        T.StructField("limitations", T.ArrayType(T.StringType())),
        T.StructField("tracker_url", T.StringType()),
        T.StructField("full_report", T.StringType()),
    ]
)

RUN = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("plan", PLAN),
        T.StructField("raw_dataset_path", T.StringType()),
        T.StructField("prepared_data_path", T.StringType()),
        T.StructField("data_profile", DATA_PROFILE),
        T.StructField("status", T.StringType()),
        T.StructField("compute_backend", T.StringType()),
        T.StructField("job_id", T.StringType()),
        T.StructField("tracker_run_id", T.StringType()),
        T.StructField("tracker_run_url", T.StringType()),
        T.StructField("metrics", IMPORTANCE),
        T.StructField("artifacts", T.MapType(T.StringType(), T.StringType())),
        T.StructField("error", T.StringType()),
        T.StructField("started_at", T.StringType()),
        T.StructField("completed_at", T.StringType()),
        T.StructField("answer", ANSWER),
    ]
)

RUN_EVENT = T.StructType(
    [
        T.StructField("run_id", T.StringType()),
        T.StructField("seq", T.LongType()),
        T.StructField("status", T.StringType()),
        T.StructField("metrics", IMPORTANCE),
        T.StructField("error", T.StringType()),
    ]
)

METRIC_LOG = T.StructType(
    [
        T.StructField("run_id", T.StringType()),
        T.StructField("step", T.LongType()),
        T.StructField("name", T.StringType()),
        T.StructField("value", T.DoubleType()),
    ]
)
