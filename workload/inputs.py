"""Inputs planted in the given tables: the same expressions for Spark and for SQL.

The tables hold no nulls, plans, replies or run logs, so those are derived from
every row of a table by arithmetic on its key.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assay.operators.joins import lookup
from assay.sources.tables import spread


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def wide_table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A table for costly per-row work: a single file is spread over the cores."""
    return spread(table(spark, sf, name))


STUDY_COLUMNS = {
    "o_orderkey": "o_orderkey",
    "acctbal": "CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE c_acctbal END",
    "price": "CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_totalprice END",
    "priority": "CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderpriority END",
    "segment": "c_mktsegment",
    "status": "o_orderstatus",
    "day": "o_orderdate",
    "step": "CAST(o_orderkey % 1000 AS DOUBLE)",
    "strong": "CAST(3 AS DOUBLE) * c_acctbal + CAST(10 * (o_orderkey % 1000) AS DOUBLE)",
    "medium": "CAST(3 AS DOUBLE) * c_acctbal + CAST(70 * (o_orderkey % 1000) AS DOUBLE)",
    "total": "o_totalprice",
}
STUDY_SQL = (
    "study AS (SELECT "
    + ", ".join(f"{e} AS {n}" for n, e in STUDY_COLUMNS.items())
    + " FROM orders JOIN customer ON o_custkey = c_custkey)"
)


def study(spark: SparkSession, sf: str) -> DataFrame:
    """One row per order with its customer's balance; nulls in three columns."""
    customer = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("o_custkey"), "c_acctbal", "c_mktsegment"
    )
    joined = lookup(table(spark, sf, "orders"), customer, "o_custkey", "inner")
    return joined.selectExpr(*(f"{e} AS {n}" for n, e in STUDY_COLUMNS.items()))


def split_sql(source: str, key: str, name: str = "parts") -> str:
    """CTE that adds `split` to a source by ranking the key's hash."""
    return (
        f"{name} AS (SELECT *, CASE WHEN row_number() OVER (ORDER BY "
        f"md5('42:' || CAST({key} AS VARCHAR))) <= ceil(0.2 * count(*) OVER ()) "
        f"THEN 'test' ELSE 'train' END AS split FROM {source})"
    )


EVENT_COLUMNS = {
    "run_id": "CAST(user_id AS {text})",
    "seq": "event_id",
    "status": (
        "CASE event_type WHEN 'signup' THEN 'pending' WHEN 'view' THEN 'preparing' "
        "WHEN 'click' THEN 'training' WHEN 'purchase' THEN 'complete' ELSE 'failed' END"
    ),
    "name": (
        "CASE event_id % 4 WHEN 0 THEN 'r2' WHEN 1 THEN 'rmse' WHEN 2 THEN 'accuracy' END"
    ),
    "value": (
        "CASE event_id % 4 WHEN 0 THEN value / 100 WHEN 2 THEN (event_id % 997) / "
        "CAST(997 AS DOUBLE) ELSE value END"
    ),
    "error": "CASE WHEN event_type = 'error' THEN concat('step ', CAST(event_id AS {text})) END",
}
EVENTS_SQL = (
    "log AS (SELECT "
    + ", ".join(f"{e.format(text='VARCHAR')} AS {n}" for n, e in EVENT_COLUMNS.items())
    + " FROM events)"
)


def event_rows(spark: SparkSession, sf: str) -> DataFrame:
    """One log row per event: the user is the run, the event type its status."""
    return table(spark, sf, "events").selectExpr(
        *(f"{e.format(text='STRING')} AS {n}" for n, e in EVENT_COLUMNS.items())
    )


def run_events(spark: SparkSession, sf: str) -> DataFrame:
    """The log in the shape of run events; every fourth sets no metric."""
    rows = event_rows(spark, sf)
    metrics = F.when(F.col("name").isNotNull(), F.create_map("name", "value")).otherwise(
        F.create_map().cast("map<string,double>")
    )
    return rows.select("run_id", "seq", "status", metrics.alias("metrics"), "error")


PLAN_COLUMNS = {
    "id": "CAST(o_orderkey AS {text})",
    "question": "concat('Does balance predict order ', CAST(o_orderkey AS {text}), '?')",
    "hypothesis": "CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE 'Balance predicts value.' END",
    "target_variable": "'o_totalprice'",
    "task_type": (
        "CASE o_orderkey % 9 WHEN 0 THEN 'binary_classification' WHEN 1 THEN "
        "'multiclass_classification' WHEN 2 THEN 'nlp_classification' WHEN 3 THEN "
        "'nlp_regression' WHEN 4 THEN 'time_series' WHEN 5 THEN 'clustering' "
        "WHEN 6 THEN 'ranking' ELSE 'regression' END"
    ),
    "dataset_query": "'order value'",
    "model_type": (
        "CASE o_custkey % 6 WHEN 0 THEN 'xgboost' WHEN 1 THEN 'auto' WHEN 2 THEN 'bert' "
        "WHEN 3 THEN 'svm' ELSE 'linear_regression' END"
    ),
    "needs_gpu": "o_orderkey % 23 = 0",
    "compute": (
        "CASE o_custkey % 4 WHEN 0 THEN 'local' WHEN 1 THEN 'vertex_ai' ELSE 'auto' END"
    ),
    "machine_type": (
        "CASE o_orderkey % 5 WHEN 0 THEN 'n1-standard-4' WHEN 1 THEN 'a2-highgpu-1g' "
        "WHEN 2 THEN 'unknown-machine' WHEN 3 THEN 'n2-standard-8' ELSE 'n1-highmem-8' END"
    ),
    "time_budget_minutes": "CAST(o_orderkey % 120 AS INT)",
}
PLANS_SQL = (
    "plans AS (SELECT "
    + ", ".join(f"{e.format(text='VARCHAR')} AS {n}" for n, e in PLAN_COLUMNS.items())
    + " FROM orders)"
)


def plan_rows(spark: SparkSession, sf: str) -> DataFrame:
    """One plan per order, some of them invalid."""
    return table(spark, sf, "orders").selectExpr(
        *(f"{e.format(text='STRING')} AS {n}" for n, e in PLAN_COLUMNS.items())
    )


SCORE_COLUMNS = {
    "run_id": "CAST(o_orderkey AS {text})",
    "task_type": (
        "CASE o_custkey % 6 WHEN 0 THEN 'regression' WHEN 1 THEN 'time_series' WHEN 2 THEN "
        "'binary_classification' WHEN 3 THEN 'multiclass_classification' WHEN 4 THEN "
        "'nlp_classification' ELSE 'regression' END"
    ),
    "r2": (
        "CASE WHEN o_orderkey % 19 = 0 THEN NULL ELSE (o_orderkey % 1201) / "
        "CAST(1000 AS DOUBLE) - CAST(0.1 AS DOUBLE) END"
    ),
    "rmse": "CASE WHEN o_orderkey % 19 = 0 THEN NULL ELSE o_totalprice / 1000 END",
    "accuracy": (
        "CASE WHEN o_orderkey % 19 = 0 THEN NULL ELSE (o_orderkey % 997) / "
        "CAST(997 AS DOUBLE) END"
    ),
    "f1": "CASE WHEN o_orderkey % 19 = 0 THEN NULL ELSE (o_orderkey % 991) / CAST(991 AS DOUBLE) END",
    "n_classes": (
        "CASE WHEN o_orderkey % 19 = 0 OR o_orderkey % 3 = 0 THEN NULL "
        "ELSE CAST(o_orderkey % 7 AS INT) END"
    ),
}
SCORES_SQL = (
    "scores AS (SELECT "
    + ", ".join(f"{e.format(text='VARCHAR')} AS {n}" for n, e in SCORE_COLUMNS.items())
    + " FROM orders)"
)
FEATURES = ["acctbal", "segment", "priority", "status", "day", "step"]
# Weight of feature i in experiment k; exact in binary, some tied.
WEIGHT = "CAST((o_orderkey * {p} + {q}) % 64 AS DOUBLE) / 64"
PRIMES = [(3, 1), (5, 2), (7, 3), (11, 5), (13, 7), (17, 11)]
WEIGHTS_SQL = "weights AS (" + " UNION ALL ".join(
    f"SELECT CAST(o_orderkey AS VARCHAR) AS run_id, '{f}' AS feature, "
    f"{WEIGHT.format(p=p, q=q)} AS importance FROM orders"
    for f, (p, q) in zip(FEATURES, PRIMES)
) + ")"


def scores(spark: SparkSession, sf: str) -> DataFrame:
    """One row of hold-out metrics per order; every 19th has none."""
    weights = ", ".join(
        f"'{f}', {WEIGHT.format(p=p, q=q)}" for f, (p, q) in zip(FEATURES, PRIMES)
    )
    return wide_table(spark, sf, "orders").selectExpr(
        *(f"{e.format(text='STRING')} AS {n}" for n, e in SCORE_COLUMNS.items()),
        f"CASE WHEN o_orderkey % 19 <> 0 THEN map({weights}) END AS feature_importance",
        "array('acctbal', 'step') AS feature_variables",
    )


CANDIDATE_SQL = """candidates AS (
  SELECT lang AS query, doc_id AS rank,
    CASE WHEN doc_id % 2 = 0 THEN concat(source, '/ds-', doc_id % 5, '/v', doc_id)
      ELSE concat('hub', doc_id % 7, '/', source, '-', doc_id) END AS id,
    concat('Dataset ', doc_id) AS name,
    CASE WHEN doc_id % 2 = 0 THEN 'kaggle' ELSE 'huggingface' END AS source,
    lang AS description, concat('http://hub/', doc_id) AS url,
    CASE WHEN doc_id % 2 = 0 THEN n_chars * (doc_id % 3) / CAST(1048576 AS DOUBLE) END AS raw_mb,
    CASE WHEN doc_id % 2 = 0 THEN CAST(0.8 AS DOUBLE) ELSE CAST(0.7 AS DOUBLE) END
      AS relevance_score
  FROM documents
  UNION ALL
  SELECT CASE page_id % 4 WHEN 0 THEN 'en' WHEN 1 THEN 'de' WHEN 2 THEN 'fr' ELSE 'es' END,
    page_id, url, url, 'web', '', url, NULL, CAST(0.5 AS DOUBLE)
  FROM pages)"""


def candidates(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as two hubs and pages as the web, one search per language."""
    from assay.functions.keys import megabytes
    from assay.operators.catalog import relevance

    hubs = table(spark, sf, "documents").selectExpr(
        "lang AS query",
        "doc_id AS rank",
        "CASE WHEN doc_id % 2 = 0 THEN concat(source, '/ds-', doc_id % 5, '/v', doc_id) "
        "ELSE concat('hub', doc_id % 7, '/', source, '-', doc_id) END AS id",
        "concat('Dataset ', doc_id) AS name",
        "CASE WHEN doc_id % 2 = 0 THEN 'kaggle' ELSE 'huggingface' END AS source",
        "lang AS description",
        "concat('http://hub/', doc_id) AS url",
        "CASE WHEN doc_id % 2 = 0 THEN n_chars * (doc_id % 3) END AS bytes",
    )
    web = table(spark, sf, "pages").selectExpr(
        "CASE page_id % 4 WHEN 0 THEN 'en' WHEN 1 THEN 'de' WHEN 2 THEN 'fr' ELSE 'es' END "
        "AS query",
        "page_id AS rank",
        "url AS id",
        "url AS name",
        "'web' AS source",
        "'' AS description",
        "url",
        "CAST(NULL AS BIGINT) AS bytes",
    )
    both = hubs.unionByName(web)
    return both.withColumn("size_mb", megabytes(F.col("bytes"))).withColumn(
        "relevance_score", relevance(F.col("source"))
    ).drop("bytes")


def normal_sql(source: str, features: list[str], target: str, by: str = "1") -> str:
    """CTEs ending in `solved`: seg, n_train, n_test, w0.., intercept, rmse and r2 of least squares,
    by elimination on the centred moments of the train rows, one feature at a time."""
    v, p = [*features, target], len(features)
    parts = []
    for name in ("train", "test"):
        own = [f"CASE WHEN split = '{name}' THEN CAST({c} AS DOUBLE) END" for c in v]
        parts.append(f"count({own[0]}) AS n_{name}")
        parts += [f"avg({c}) AS m{i}_{name}" for i, c in enumerate(own)]
        kind = "a0" if name == "train" else "t"
        parts += [f"covar_pop({own[i]}, {own[j]}) AS {kind}_{i}_{j}" for i in range(p + 1) for j in range(i, p + 1)]
    steps = [f"n0 AS (SELECT {by} AS seg, {', '.join(parts)} FROM {source} GROUP BY 1)"]
    for k in range(p):
        new = [
            f"a{k}_{i}_{j} - a{k}_{k}_{i} * a{k}_{k}_{j} / a{k}_{k}_{k} AS a{k + 1}_{i}_{j}"
            for i in range(k + 1, p + 1)
            for j in range(i, p + 1)
        ]
        steps.append(f"n{k + 1} AS (SELECT *, {', '.join(new)} FROM n{k})")
    last = f"n{p}"
    for k in reversed(range(p)):
        known = "".join(f" - a{k}_{k}_{j} * w{j}" for j in range(k + 1, p))
        steps.append(f"b{k} AS (SELECT *, (a{k}_{k}_{p}{known}) / a{k}_{k}_{k} AS w{k} FROM {last})")
        last = f"b{k}"
    line = "".join(f" - w{i} * m{i}_train" for i in range(p))
    bias = "".join(f" - w{i} * m{i}_test" for i in range(p))
    spread = f"t_{p}_{p}" + "".join(f" - 2 * w{i} * t_{i}_{p}" for i in range(p))
    spread += "".join(f" + w{i} * w{j} * t_{min(i, j)}_{max(i, j)}" for i in range(p) for j in range(p))
    steps += [
        f"line AS (SELECT *, m{p}_train{line} AS intercept FROM {last})",
        f"error AS (SELECT *, greatest(power(m{p}_test - intercept{bias}, 2) + {spread}, 0) AS mse FROM line)",
        f"solved AS (SELECT *, sqrt(mse) AS rmse, 1 - mse / t_{p}_{p} AS r2 FROM error)",
    ]
    return ", ".join(steps)
