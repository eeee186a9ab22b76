"""Run log, metrics records, answers and summaries."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from assay.operators import answers, runs
from assay.scratch import scratch_path
from assay.sources import records, tracker
from assay.sources.run_log import RunLog
from assay.streaming.status import current_runs, stream_events, watch_runs
from workload.inputs import EVENTS_SQL, event_rows, plan_rows, run_events, table
from workload.registry import query
from workload.scores import IS_CLS, IS_REG, JUDGED_SQL, evidence_sql

LATEST_SQL = f"""{EVENTS_SQL},
  latest AS (SELECT run_id, max_by(status, seq) AS status,
    max_by(error, seq) FILTER (WHERE error IS NOT NULL) AS error, max(seq) AS seq
    FROM log GROUP BY run_id),
  merged AS (SELECT run_id, name, max_by(value, seq) AS value FROM log WHERE name IS NOT NULL
    GROUP BY run_id, name)"""


@query("runs_latest", f"WITH {LATEST_SQL} SELECT run_id, status, error, seq FROM latest")
def runs_latest(spark, sf):
    return runs.latest_runs(run_events(spark, sf))


@query("runs_watch", f"WITH {LATEST_SQL} SELECT run_id, status, error, seq FROM latest")
def runs_watch(spark, sf):
    log, out, state = (scratch_path(spark, n) for n in ("log", "status", "state"))
    records.append_events(run_events(spark, sf), log)
    watch_runs(stream_events(spark, log), out, state).awaitTermination()
    return current_runs(spark, out)


def compacted(spark, sf):
    """The events in four appends, with a compaction behind each of the first three."""
    log = RunLog(spark, scratch_path(spark, "runlog"))
    events = run_events(spark, sf)
    for part in range(4):
        log.append(events.filter(F.col("seq") % 4 == part))
        if part < 3:
            log.compact()
            log.vacuum()
    return log


@query("runs_compacted", f"WITH {LATEST_SQL} SELECT run_id, status, error, seq FROM latest")
def runs_compacted(spark, sf):
    return compacted(spark, sf).latest()


@query("metrics_compacted", f"WITH {LATEST_SQL} SELECT run_id, name, value FROM merged")
def metrics_compacted(spark, sf):
    return compacted(spark, sf).metrics()


@query(
    "runs_metrics_merged", f"WITH {LATEST_SQL} SELECT run_id, name, value FROM merged"
)
def runs_metrics_merged(spark, sf):
    return runs.merged_metrics(run_events(spark, sf))


@query(
    "metric_log_pivot",
    f"""WITH {EVENTS_SQL}, steps AS (SELECT run_id, seq % 10 AS step, seq, name, value FROM log
      WHERE name IS NOT NULL)
    SELECT run_id, step, max_by(value, seq) FILTER (WHERE name = 'r2') AS r2,
      max_by(value, seq) FILTER (WHERE name = 'rmse') AS rmse,
      max_by(value, seq) FILTER (WHERE name = 'accuracy') AS accuracy
    FROM steps GROUP BY run_id, step""",
)
def metric_log_pivot(spark, sf):
    log = event_rows(spark, sf).filter("name IS NOT NULL").selectExpr(
        "run_id", "seq % 10 AS step", "seq", "name", "value"
    )
    return records.pivot_metric_log(log, ["r2", "rmse", "accuracy"], order="seq")


METRIC_TEXT = """CASE event_id % 6
  WHEN 0 THEN concat('{{"r2": 0.', event_id % 1000 + 1000, ', "rmse": ', event_id % 50, '}}')
  WHEN 1 THEN concat('{{"accuracy": 0.', event_id % 1000 + 1000, ', "n_classes": ', event_id % 9, '}}')
  WHEN 2 THEN '{{}}'
  WHEN 3 THEN concat('{{"r2": 0.5, "rmse": ', event_id)
  WHEN 4 THEN 'not json'
  ELSE concat('{{"f1": 0.25, "feature_importance": {{"k": 0.', event_id % 10, '}}}}') END"""


@query(
    "metrics_load",
    f"""WITH t AS (SELECT event_id, {METRIC_TEXT.format()} AS line FROM events),
    v AS (SELECT event_id, json_valid(line) AS ok, CASE WHEN json_valid(line) THEN line END AS j
      FROM t)
    SELECT event_id, ok AS success, CASE WHEN NOT ok THEN 'invalid metrics record' END AS error,
      CAST(json_extract_string(j, '$.r2') AS DOUBLE) AS r2,
      CAST(json_extract_string(j, '$.rmse') AS DOUBLE) AS rmse,
      CAST(json_extract_string(j, '$.accuracy') AS DOUBLE) AS accuracy,
      CAST(json_extract_string(j, '$.f1') AS DOUBLE) AS f1,
      CAST(json_extract_string(j, '$.n_classes') AS INT) AS n_classes,
      CAST(json_extract_string(j, '$.feature_importance.k') AS DOUBLE) AS k_importance
    FROM v""",
)
def metrics_load(spark, sf):
    lines = table(spark, sf, "events").selectExpr("event_id", f"{METRIC_TEXT.format()} AS line")
    found = records.load_metrics(lines, "event_id", "line")
    return found.withColumn("k_importance", F.col("feature_importance")["k"]).drop(
        "feature_importance"
    )


RECORD = T.StructType(
    [
        T.StructField("question", T.StringType()),
        T.StructField("hypothesis", T.StringType()),
        T.StructField("needs_gpu", T.BooleanType()),
        T.StructField("time_budget_minutes", T.IntegerType()),
        T.StructField("total", T.DoubleType()),
        T.StructField("tags", T.ArrayType(T.StringType())),
    ]
)


@query(
    "run_json_roundtrip",
    """SELECT o_orderkey AS id, concat('Order "', o_orderkey, '"?') AS question,
      CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE o_orderstatus END AS hypothesis,
      o_orderkey % 23 = 0 AS needs_gpu, CAST(o_orderkey % 120 AS INT) AS time_budget_minutes,
      o_totalprice AS total, o_orderstatus || ',' || o_orderpriority AS tags FROM orders""",
)
def run_json_roundtrip(spark, sf):
    rows = table(spark, sf, "orders").selectExpr(
        "o_orderkey AS id",
        "concat('Order \"', o_orderkey, '\"?') AS question",
        "CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE o_orderstatus END AS hypothesis",
        "o_orderkey % 23 = 0 AS needs_gpu",
        "CAST(o_orderkey % 120 AS INT) AS time_budget_minutes",
        "o_totalprice AS total",
        "array(o_orderstatus, o_orderpriority) AS tags",
    )
    text = records.to_json_records(rows, "id", RECORD.fieldNames())
    back = records.from_json_records(text, "id", RECORD)
    return back.withColumn("tags", F.array_join("tags", ","))


STATES_SQL = f"""{EVENTS_SQL}, run_rows AS (SELECT run_id || '-' || CAST(seq AS VARCHAR) AS id,
  CASE WHEN seq % 15 = 0 THEN 'unknown' ELSE status END AS status, error FROM log)"""


def run_rows(spark, sf):
    return event_rows(spark, sf).selectExpr(
        "run_id || '-' || CAST(seq AS STRING) AS id",
        "CASE WHEN seq % 15 = 0 THEN 'unknown' ELSE status END AS status",
        "error",
    )


@query(
    "runs_list",
    f"WITH {STATES_SQL} SELECT id, status, error FROM run_rows WHERE status <> 'unknown'",
)
def runs_list(spark, sf):
    path = scratch_path(spark, "runs")
    records.write_run_records(run_rows(spark, sf), path)
    return records.read_run_records(spark, path).select("id", "status", "error")


@query(
    "run_lookup",
    f"""WITH {LATEST_SQL} SELECT run_id AS id, status, error FROM latest WHERE run_id = '7'
    UNION ALL SELECT run_id, status, error FROM latest WHERE run_id = 'no-such-run'""",
)
def run_lookup(spark, sf):
    known = runs.latest_runs(run_events(spark, sf)).withColumnRenamed("run_id", "id")
    found = records.find_run(known, "7").unionByName(records.find_run(known, "no-such-run"))
    return found.select("id", "status", "error")


@query(
    "run_status",
    f"""WITH {LATEST_SQL}, asked AS (SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS run_id FROM orders)
    SELECT run_id, coalesce(status, 'not_found') AS status, error
    FROM asked LEFT JOIN latest USING (run_id)""",
)
def run_status(spark, sf):
    asked = table(spark, sf, "orders").selectExpr("CAST(o_custkey AS STRING) AS run_id").distinct()
    return runs.run_status(run_events(spark, sf), asked)


RUNS_SQL = f"""{LATEST_SQL},
  runs AS (SELECT run_id, status, concat('Does k predict value for ', run_id, '?') AS question,
    'k predicts value' AS hypothesis,
    CASE CAST(run_id AS BIGINT) % 4 WHEN 0 THEN 'regression' WHEN 1 THEN 'time_series'
      WHEN 2 THEN 'binary_classification' ELSE 'nlp_classification' END AS task_type,
    CASE CAST(run_id AS BIGINT) % 3 WHEN 0 THEN 'xgboost' ELSE 'auto' END AS model_type
    FROM latest),
  wide AS (SELECT run_id, max(CASE WHEN name = 'r2' THEN value END) AS r2,
    max(CASE WHEN name = 'rmse' THEN value END) AS rmse,
    max(CASE WHEN name = 'accuracy' THEN value END) AS accuracy,
    CAST(NULL AS DOUBLE) AS f1, CAST(NULL AS INT) AS n_classes
    FROM merged GROUP BY run_id),
  gate AS (SELECT runs.*, CASE WHEN status NOT IN ('complete', 'failed')
      THEN 'Experiment is still ' || status || '. Wait for completion.'
    WHEN wide.run_id IS NULL THEN 'metrics.json not found. Training may not have completed.'
    END AS error FROM runs LEFT JOIN wide USING (run_id)),
  scores AS (SELECT gate.*, r2, rmse, accuracy, f1, n_classes FROM gate JOIN wide USING (run_id)
    WHERE error IS NULL)"""


def run_table(spark, sf):
    return runs.latest_runs(run_events(spark, sf)).selectExpr(
        "run_id",
        "status",
        "error",
        "concat('Does k predict value for ', run_id, '?') AS question",
        "'k predicts value' AS hypothesis",
        "CASE CAST(run_id AS BIGINT) % 4 WHEN 0 THEN 'regression' WHEN 1 THEN 'time_series' "
        "WHEN 2 THEN 'binary_classification' ELSE 'nlp_classification' END AS task_type",
        "CASE CAST(run_id AS BIGINT) % 3 WHEN 0 THEN 'xgboost' ELSE 'auto' END AS model_type",
        "array('k') AS feature_variables",
        "CAST(NULL AS STRING) AS tracker_url",
    )


def metric_table(spark, sf):
    merged = runs.merged_metrics(run_events(spark, sf))
    names = ["r2", "rmse", "accuracy", "f1", "n_classes"]
    wide = runs.metrics_table(merged, names)
    return wide.withColumns(
        {
            "n_classes": F.col("n_classes").cast("int"),
            "feature_importance": F.lit(None).cast("map<string,double>"),
        }
    )


@query(
    "answerable_runs", f"WITH {RUNS_SQL} SELECT run_id, status, error FROM gate"
)
def answerable_runs(spark, sf):
    found = runs.answerable(run_table(spark, sf), metric_table(spark, sf))
    return found.select("run_id", "status", "error")


@query(
    "answers",
    f"""WITH {RUNS_SQL}, {JUDGED_SQL}
    SELECT run_id, question, verdict, confidence, limitations,
      {evidence_sql('verdict', 'confidence', "'k'")} AS evidence_summary,
      CASE WHEN {IS_REG} THEN 'r2,rmse' WHEN {IS_CLS} THEN 'accuracy,f1'
        ELSE concat_ws(',', CASE WHEN r2 IS NOT NULL THEN 'r2' END,
          CASE WHEN rmse IS NOT NULL THEN 'rmse' END,
          CASE WHEN accuracy IS NOT NULL THEN 'accuracy' END) END AS key_metrics
    FROM judged""",
)
def answers_query(spark, sf):
    found, _ = answers.answer(run_table(spark, sf), metric_table(spark, sf))
    return found.select(
        "run_id",
        "question",
        "verdict",
        "confidence",
        F.array_join("limitations", " | ").alias("limitations"),
        "evidence_summary",
        F.array_join(F.col("key_metrics")["name"], ",").alias("key_metrics"),
    )


@query(
    "run_results",
    f"""WITH {RUNS_SQL} SELECT run_id, status, task_type, model_type, r2, rmse, accuracy
    FROM runs LEFT JOIN wide USING (run_id)""",
)
def run_results(spark, sf):
    found = answers.run_results(run_table(spark, sf), metric_table(spark, sf))
    return found.select("run_id", "status", "task_type", "model_type", "r2", "rmse", "accuracy")


@query(
    "runs_summary",
    f"""WITH {RUNS_SQL}, {JUDGED_SQL}
    SELECT run_id, substr(runs.question, 1, 50) AS question, runs.status, runs.model_type,
      coalesce(verdict, '-') AS verdict
    FROM runs LEFT JOIN (SELECT run_id, verdict FROM judged) USING (run_id)""",
)
def runs_summary(spark, sf):
    known = run_table(spark, sf)
    found, _ = answers.answer(known, metric_table(spark, sf))
    return answers.summarize(known, found)


@query(
    "merge_maps",
    f"""WITH {EVENTS_SQL}, a AS (SELECT seq, seq % 3 AS k FROM log)
    SELECT seq, 'a=' || CAST(CASE WHEN k = 0 THEN 10 + seq % 7 ELSE seq % 5 END AS VARCHAR)
      || CASE WHEN k = 1 THEN ',b=' || CAST(20 + seq % 7 AS VARCHAR) ELSE '' END AS merged FROM a""",
)
def merge_maps(spark, sf):
    rows = event_rows(spark, sf).selectExpr(
        "seq",
        "map('a', seq % 5) AS old",
        "CASE seq % 3 WHEN 0 THEN map('a', 10 + seq % 7) WHEN 1 THEN map('b', 20 + seq % 7) "
        "ELSE CAST(map() AS map<string,bigint>) END AS new",
    )
    merged = F.array_sort(F.map_entries(runs.merge_maps(F.col("old"), F.col("new"))))
    pairs = F.transform(merged, lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return rows.select("seq", F.array_join(pairs, ",").alias("merged"))


# A configuration per order: nested, of other types than asked for, incomplete or broken.
CONFIG_TEXT = """CASE o_orderkey % 5
  WHEN 0 THEN concat('{"optimizer": {"lr": 0.', o_orderkey % 89 + 10, ', "name": "adam"}, "depth": ', o_orderkey % 9, '}')
  WHEN 1 THEN concat('{"optimizer": {"lr": "0.', o_custkey % 89 + 10, '"}, "depth": "deep"}')
  WHEN 2 THEN '{"optimizer": null, "depth": 8}'
  WHEN 3 THEN '{"optimizer": {"lr": 0.5'
  ELSE '{"optimizer": {"name": "sgd"}, "layers": [16, 8]}' END"""
SETTINGS = {
    "lr": tracker.Setting("$.optimizer.lr", "double", 0.25),
    "depth": tracker.Setting("$.depth", "int", 6),
    "optimizer": tracker.Setting("$.optimizer.name", "string", "none"),
    "first_layer": tracker.Setting("$.layers[0]", "int"),
}
SETTINGS_SQL = f"""tracked AS (SELECT o_orderkey AS k, o_totalprice AS value, CAST(o_orderkey AS VARCHAR) AS run_id,
    o_orderpriority AS tag, o_orderstatus AS other, {CONFIG_TEXT} AS line FROM orders),
  parsed AS (SELECT *, CASE WHEN json_valid(line) THEN line END AS j FROM tracked),
  settings AS (SELECT *, coalesce(TRY_CAST(json_extract_string(j, '$.optimizer.lr') AS DOUBLE), 0.25) AS lr,
    coalesce(TRY_CAST(json_extract_string(j, '$.depth') AS INT), 6) AS depth,
    coalesce(json_extract_string(j, '$.optimizer.name'), 'none') AS optimizer,
    TRY_CAST(json_extract_string(j, '$.layers[0]') AS INT) AS first_layer FROM parsed)"""


def tracked_runs(spark, sf):
    path = scratch_path(spark, "tracked")
    runs_ = table(spark, sf, "orders").selectExpr(
        "CAST(o_orderkey AS STRING) AS run_id", "'orders' AS project", "o_orderpriority AS run_name",
        f"{CONFIG_TEXT} AS config", "array(o_orderpriority, o_orderstatus) AS tags",
    )
    tracker.init_runs(runs_, path)
    return tracker.read_tracked(spark, path)


@query(
    "run_settings",
    f"""WITH {SETTINGS_SQL} SELECT run_id, lr, depth, optimizer, first_layer FROM settings
    WHERE lr > 0.2 AND tag = '1-URGENT' AND other = 'O'""",
)
def run_settings(spark, sf):
    found = tracker.with_settings(tracker.tagged(tracked_runs(spark, sf), "1-URGENT", "O"), SETTINGS)
    return found.filter("lr > 0.2").select("run_id", *SETTINGS)


@query(
    "best_run_per_setting",
    f"""WITH {SETTINGS_SQL}, best AS (SELECT depth, count(*) AS n, max(value) AS value FROM settings GROUP BY depth)
    SELECT best.depth AS setting, (SELECT min(run_id) FROM settings s WHERE s.depth = best.depth
      AND s.value = best.value) AS run_id, value, n FROM best""",
)
def best_run_per_setting(spark, sf):
    scores = table(spark, sf, "orders").selectExpr("CAST(o_orderkey AS STRING) AS run_id", "o_totalprice AS value")
    return tracker.best_by_setting(tracked_runs(spark, sf), scores, SETTINGS["depth"])
