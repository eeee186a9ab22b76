"""Hold-out metrics, verdicts, evidence and reports."""

from pyspark.sql import functions as F

from assay.functions import verdict
from assay.functions.verdict import Metrics
from assay.operators import answers, metrics, segments
from assay.operators.impute import impute
from assay.operators.joins import lookup
from assay.operators.split import add_split
from assay.scratch import materialize
from workload.inputs import (
    SCORES_SQL,
    STUDY_SQL,
    WEIGHTS_SQL,
    normal_sql,
    scores,
    split_sql,
    study,
    table,
    wide_table,
)
from workload.registry import query

BASELINE = "CAST(1 AS DOUBLE) / greatest(coalesce(n_classes, 2), 2)"
R2 = "coalesce(r2, CAST(0 AS DOUBLE))"
ACC = "coalesce(accuracy, CAST(0.5 AS DOUBLE))"
IS_REG = "task_type IN ('regression', 'time_series')"
IS_CLS = "task_type IN ('binary_classification', 'multiclass_classification')"


def d(value: str) -> str:
    return f"CAST({value} AS DOUBLE)"


REG_VERDICT = (
    f"CASE WHEN {R2} >= {d('0.4')} THEN 'confirmed' WHEN {R2} >= {d('0.1')} THEN 'inconclusive' "
    "ELSE 'rejected' END"
)
REG_CONFIDENCE = (
    f"CAST(printf('%.3f', least({d('0.99')}, greatest({d('0')}, least({d('1')}, {R2})) "
    f"+ {d('0.1')})) AS DOUBLE)"
)
CLS_VERDICT = (
    f"CASE WHEN {ACC} - {BASELINE} >= {d('0.15')} THEN 'confirmed' "
    f"WHEN {ACC} - {BASELINE} >= {d('0.05')} THEN 'inconclusive' ELSE 'rejected' END"
)
CLS_CONFIDENCE = (
    f"CAST(printf('%.3f', least({d('0.99')}, greatest({d('0.01')}, ({ACC} - {BASELINE}) / "
    f"(1 - {BASELINE})))) AS DOUBLE)"
)
VERDICT = f"CASE WHEN {IS_REG} THEN {REG_VERDICT} WHEN {IS_CLS} THEN {CLS_VERDICT} ELSE 'inconclusive' END"
CONFIDENCE = (
    f"CASE WHEN {IS_REG} THEN {REG_CONFIDENCE} WHEN {IS_CLS} THEN {CLS_CONFIDENCE} "
    f"ELSE {d('0.5')} END"
)
LIMITATION = (
    f"CASE WHEN {IS_REG} AND {R2} < {d('0.4')} THEN printf('Model explains only %.1f%% of variance "
    f"(R²=%.3f). Other factors not captured in the dataset may be important.', {R2} * 100, {R2}) "
    f"WHEN {IS_CLS} AND {ACC} < {BASELINE} + {d('0.15')} THEN printf('Model accuracy (%.1f%%) is "
    f"close to the baseline (%.1f%%). The features may have limited predictive power.', "
    f"{ACC} * 100, {BASELINE} * 100) END"
)
EMPTY = (
    "r2 IS NULL AND rmse IS NULL AND accuracy IS NULL AND f1 IS NULL AND n_classes IS NULL"
)
NO_METRICS = (
    f"CASE WHEN {EMPTY} THEN 'No metrics were produced — training may have failed silently.' END"
)
LIMITATIONS = f"concat_ws(' | ', {LIMITATION}, {NO_METRICS})"


def evidence_sql(verdict: str, confidence: str, feature: str) -> str:
    return (
        f"CASE WHEN {IS_REG} THEN printf('The model explains %.1f%% of the variance in the target "
        f"(R²=%.3f), suggesting the hypothesis is %s with %.0f%% confidence. ''%s'' is among the "
        f"features considered.', {R2} * 100, {R2}, {verdict}, {confidence} * 100, {feature}) "
        f"ELSE printf('The classifier achieved %.1f%% accuracy, indicating the hypothesis is %s "
        f"with %.0f%% confidence.', coalesce(accuracy, {d('0')}) * 100, {verdict}, "
        f"{confidence} * 100) END"
    )


JUDGED_SQL = (
    f"judged AS (SELECT *, {VERDICT} AS verdict, {CONFIDENCE} AS confidence, "
    f"{LIMITATIONS} AS limitations FROM scores)"
)

PREDICTIONS_SQL = """predictions AS (SELECT o_orderkey, o_orderpriority,
  CAST(o_custkey % 5 AS DOUBLE) AS label,
  CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_orderkey % 4 AS DOUBLE)
    ELSE CAST(o_custkey % 5 AS DOUBLE) END AS prediction,
  o_totalprice AS y, CAST(0.9 AS DOUBLE) * o_totalprice + CAST(o_orderkey % 1000 AS DOUBLE) AS p
  FROM orders)"""


def predictions(spark, sf):
    return table(spark, sf, "orders").selectExpr(
        "o_orderkey",
        "o_orderpriority",
        "CAST(o_custkey % 5 AS DOUBLE) AS label",
        "CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_orderkey % 4 AS DOUBLE) "
        "ELSE CAST(o_custkey % 5 AS DOUBLE) END AS prediction",
        "o_totalprice AS y",
        "CAST(0.9 AS DOUBLE) * o_totalprice + CAST(o_orderkey % 1000 AS DOUBLE) AS p",
    )


@query(
    "clf_metrics",
    f"""WITH {PREDICTIONS_SQL},
    cls AS (SELECT label AS c FROM predictions UNION SELECT prediction FROM predictions),
    per AS (SELECT c, (SELECT count(*) FROM predictions WHERE label = c) AS support,
      (SELECT count(*) FROM predictions WHERE prediction = c) AS predicted,
      (SELECT count(*) FROM predictions WHERE label = c AND prediction = c) AS hits FROM cls)
    SELECT round(sum(hits) / CAST(sum(support) AS DOUBLE), 6) AS accuracy,
      round(sum(2.0 * hits / CAST(support + predicted AS DOUBLE) * support)
        / CAST(sum(support) AS DOUBLE), 6) AS f1,
      CAST((SELECT count(DISTINCT label) FROM predictions) AS INT) AS n_classes FROM per""",
)
def clf_metrics(spark, sf):
    found = metrics.clf_metrics(predictions(spark, sf))
    return found.select(
        F.round("accuracy", 6).alias("accuracy"), F.round("f1", 6).alias("f1"), "n_classes"
    )


@query(
    "reg_metrics",
    f"""WITH {PREDICTIONS_SQL}
    SELECT o_orderpriority, round(sqrt(avg((y - p) * (y - p))), 4) AS rmse,
      round(1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*)), 6) AS r2
    FROM predictions GROUP BY 1""",
)
def reg_metrics(spark, sf):
    found = metrics.reg_metrics(predictions(spark, sf), "y", "p", ["o_orderpriority"])
    return found.select(
        "o_orderpriority", F.round("rmse", 4).alias("rmse"), F.round("r2", 6).alias("r2")
    )


@query(
    "verdict_regression",
    f"""WITH {SCORES_SQL} SELECT run_id, {REG_VERDICT} AS verdict, {REG_CONFIDENCE} AS confidence
    FROM scores WHERE {IS_REG}""",
)
def verdict_regression(spark, sf):
    r2 = F.coalesce("r2", F.lit(0.0))
    return (
        scores(spark, sf)
        .filter(F.col("task_type").isin("regression", "time_series"))
        .select(
            "run_id",
            verdict.regression_verdict(r2).alias("verdict"),
            verdict.regression_confidence(r2).alias("confidence"),
        )
    )


@query(
    "verdict_classification",
    f"""WITH {SCORES_SQL} SELECT run_id, round({BASELINE}, 6) AS baseline, {CLS_VERDICT} AS verdict,
    {CLS_CONFIDENCE} AS confidence FROM scores WHERE {IS_CLS}""",
)
def verdict_classification(spark, sf):
    accuracy = F.coalesce("accuracy", F.lit(0.5))
    base = verdict.baseline(F.col("n_classes"))
    return (
        scores(spark, sf)
        .filter(F.col("task_type").isin("binary_classification", "multiclass_classification"))
        .select(
            "run_id",
            F.round(base, 6).alias("baseline"),
            verdict.classification_verdict(accuracy, base).alias("verdict"),
            verdict.classification_confidence(accuracy, base).alias("confidence"),
        )
    )


@query(
    "verdict_other",
    f"""WITH {SCORES_SQL} SELECT run_id, 'inconclusive' AS verdict, {d('0.5')} AS confidence,
    concat_ws(',', CASE WHEN r2 IS NOT NULL THEN 'r2' END,
      CASE WHEN rmse IS NOT NULL THEN 'rmse' END,
      CASE WHEN accuracy IS NOT NULL THEN 'accuracy' END, CASE WHEN f1 IS NOT NULL THEN 'f1' END,
      CASE WHEN n_classes IS NOT NULL THEN 'n_classes' END) AS metrics
    FROM scores WHERE NOT ({IS_REG} OR {IS_CLS})""",
)
def verdict_other(spark, sf):
    m, task = Metrics.of(), F.col("task_type")
    rows = scores(spark, sf).filter(task.isin("nlp_classification", "nlp_regression", "clustering"))
    return rows.select(
        "run_id",
        verdict.verdict(task, m).alias("verdict"),
        verdict.confidence(task, m).alias("confidence"),
        F.array_join(verdict.key_metrics(task, m)["name"], ",").alias("metrics"),
    )


@query(
    "limitations",
    f"WITH {SCORES_SQL} SELECT run_id, {LIMITATIONS} AS limitations FROM scores",
)
def limitations(spark, sf):
    found = verdict.limitations(F.col("task_type"), Metrics.of())
    return scores(spark, sf).select("run_id", F.array_join(found, " | ").alias("limitations"))


@query(
    "evidence_summary",
    f"""WITH {SCORES_SQL}, {JUDGED_SQL}
    SELECT run_id, {evidence_sql('verdict', 'confidence', "'acctbal'")} AS evidence_summary
    FROM judged""",
)
def evidence_summary(spark, sf):
    return answers.evaluate(scores(spark, sf)).select("run_id", "evidence_summary")


@query(
    "importance_sorted",
    f"""WITH {SCORES_SQL}, {WEIGHTS_SQL}
    SELECT run_id, string_agg(printf('%s:%.6f', feature, importance), ','
      ORDER BY importance DESC, feature) AS importance
    FROM weights WHERE CAST(run_id AS BIGINT) % 19 <> 0 GROUP BY run_id""",
)
def importance_sorted(spark, sf):
    rows = scores(spark, sf).filter(F.col("feature_importance").isNotNull())
    pairs = F.transform(
        verdict.sorted_importance(F.col("feature_importance")),
        lambda e: F.format_string("%s:%.6f", e["feature"], e["importance"]),
    )
    return rows.select("run_id", F.array_join(pairs, ",").alias("importance"))


@query(
    "top_features",
    f"""WITH {WEIGHTS_SQL}, ranked AS (SELECT run_id, feature, importance, row_number() OVER
      (PARTITION BY run_id ORDER BY importance DESC, feature) AS position FROM weights
      WHERE CAST(run_id AS BIGINT) % 19 <> 0)
    SELECT run_id, position, feature, importance FROM ranked WHERE position <= 5""",
)
def top_features(spark, sf):
    return answers.top_features(answers.evaluate(scores(spark, sf)), ["run_id"])


REPORT_SQL = f"""WITH {SCORES_SQL}, {WEIGHTS_SQL}, {JUDGED_SQL},
  ranked AS (SELECT run_id, feature, importance, row_number() OVER
    (PARTITION BY run_id ORDER BY importance DESC, feature) AS position FROM weights
    WHERE CAST(run_id AS BIGINT) % 19 <> 0),
  top AS (SELECT run_id, string_agg(printf('- `%s`: %.4f', feature, importance), chr(10)
    ORDER BY position) AS lines FROM ranked WHERE position <= 5 GROUP BY run_id),
  named AS (SELECT judged.*, lines, {evidence_sql('verdict', 'confidence', "'acctbal'")} AS evidence
    FROM judged LEFT JOIN top USING (run_id))
SELECT run_id, concat('# Experiment Report', chr(10), chr(10), '## Question', chr(10),
  'Is run ', run_id, ' sound?', chr(10), chr(10), '## Verdict: ',
  CASE verdict WHEN 'confirmed' THEN '✅' WHEN 'rejected' THEN '❌' ELSE '⚠️' END, ' ',
  upper(verdict), chr(10), printf('*Confidence: %.0f%%*', confidence * 100), chr(10), chr(10),
  '## Summary', chr(10), evidence, chr(10), chr(10), '## Key Metrics', chr(10),
  CASE WHEN {IS_REG} THEN printf('- **r2**: %.4f' || chr(10) || '- **rmse**: %.4f', {R2},
      coalesce(rmse, {d('0')}))
    WHEN {IS_CLS} THEN printf('- **accuracy**: %.4f' || chr(10) || '- **f1**: %.4f', {ACC},
      coalesce(f1, {d('0')}))
    ELSE concat_ws(chr(10), CASE WHEN r2 IS NOT NULL THEN printf('- **r2**: %.4f', r2) END,
      CASE WHEN rmse IS NOT NULL THEN printf('- **rmse**: %.4f', rmse) END,
      CASE WHEN accuracy IS NOT NULL THEN printf('- **accuracy**: %.4f', accuracy) END,
      CASE WHEN f1 IS NOT NULL THEN printf('- **f1**: %.4f', f1) END,
      CASE WHEN n_classes IS NOT NULL THEN printf('- **n_classes**: %.4f', {d('n_classes')}) END)
    END, chr(10), chr(10),
  CASE WHEN lines IS NULL THEN '' ELSE '## Feature Importance (top 5)' || chr(10) || lines END,
  chr(10), chr(10), '## Limitations', chr(10),
  CASE WHEN limitations = '' THEN 'None identified.'
    ELSE '- ' || replace(limitations, ' | ', chr(10) || '- ') END,
  chr(10), chr(10),
  CASE WHEN CAST(run_id AS BIGINT) % 2 = 0 THEN '## W&B Run' || chr(10) || 'http://t/' || run_id
    ELSE '' END, chr(10)) AS full_report
FROM named"""


@query("report_markdown", REPORT_SQL)
def report_markdown(spark, sf):
    rows = scores(spark, sf).withColumns(
        {
            "question": F.concat(F.lit("Is run "), "run_id", F.lit(" sound?")),
            "tracker_url": F.when(
                F.col("run_id").cast("bigint") % 2 == 0, F.concat(F.lit("http://t/"), "run_id")
            ),
        }
    )
    return answers.with_report(answers.evaluate(rows)).select("run_id", "full_report")


def line_sql(source: str, x: str, y: str, by: str) -> str:
    """Fit on the train rows of each group, score on its test rows."""
    return f"""fit AS (SELECT {by}, regr_slope({y}, {x}) AS slope,
      regr_intercept({y}, {x}) AS intercept, count(*) AS n_train
      FROM {source} WHERE split = 'train' GROUP BY {by}),
    scored AS (SELECT {by}, n_train, count(*) AS n_test, slope, intercept,
      sqrt(avg(power({y} - intercept - slope * {x}, 2))) AS rmse,
      1 - sum(power({y} - intercept - slope * {x}, 2)) / (var_pop({y}) * count(*)) AS r2
      FROM {source} JOIN fit USING ({by}) WHERE split = 'test'
      GROUP BY {by}, n_train, slope, intercept)"""


TARGETS = ["total", "strong", "medium"]
SLICE_SQL = f"""{STUDY_SQL}, m AS (SELECT median(acctbal) AS a FROM study),
  filled AS (SELECT o_orderkey, coalesce(acctbal, a) AS acctbal, total, strong, medium
    FROM study, m),
  {split_sql('filled', 'o_orderkey')},
  long AS ({" UNION ALL ".join(
      f"SELECT '{t}' AS target, split, acctbal, {t} AS y FROM parts" for t in TARGETS)}),
  {line_sql('long', 'acctbal', 'y', 'target')}"""


def slice_lines(spark, sf):
    """Balance against three targets: imputed, split, fitted and scored."""
    # Split, fills and fit scan the rows several times; they are joined once.
    rows = materialize(study(spark, sf).select("o_orderkey", "acctbal", *TARGETS), "slice")
    # The split needs the key alone, so it comes before the fills.
    ready = impute(add_split(rows, "o_orderkey"), ["acctbal"])
    pairs = [F.struct(F.lit(t).alias("target"), F.col(t).alias("y")) for t in TARGETS]
    long = ready.select("split", "acctbal", F.inline(F.array(*pairs)))
    return segments.holdout_line(long, F.col("acctbal"), F.col("y"), ["target"])


@query(
    "linreg_holdout",
    f"""WITH {SLICE_SQL} SELECT target, n_train, n_test, round(slope, 6) AS slope,
    round(intercept, 4) AS intercept, round(rmse, 4) AS rmse, round(r2, 6) AS r2 FROM scored""",
)
def linreg_holdout(spark, sf):
    return slice_lines(spark, sf).select(
        "target",
        "n_train",
        "n_test",
        F.round("slope", 6).alias("slope"),
        F.round("intercept", 4).alias("intercept"),
        F.round("rmse", 4).alias("rmse"),
        F.round("r2", 6).alias("r2"),
    )


def judged_lines(lines):
    """Verdict columns for rows that carry rmse and r2 of a regression."""
    none = F.lit(None)
    return answers.evaluate(
        lines.withColumns(
            {
                "accuracy": none.cast("double"),
                "f1": none.cast("double"),
                "n_classes": none.cast("int"),
                "feature_importance": none.cast("map<string,double>"),
            }
        ),
        F.lit("regression"),
        F.lit("acctbal"),
    )


SLICE_COLUMNS = ["verdict", "confidence", "evidence_summary"]


@query(
    "hypothesis_slice",
    f"""WITH {SLICE_SQL}, scores AS (SELECT target, n_test, round(rmse, 4) AS rmse,
      round(r2, 6) AS r2, 'regression' AS task_type, CAST(NULL AS DOUBLE) AS accuracy,
      CAST(NULL AS INT) AS n_classes, CAST(NULL AS DOUBLE) AS f1 FROM scored), {JUDGED_SQL}
    SELECT target, n_test, rmse, r2, verdict, confidence,
      {evidence_sql('verdict', 'confidence', "'acctbal'")} AS evidence_summary FROM judged""",
)
def hypothesis_slice(spark, sf):
    lines = slice_lines(spark, sf).select(
        "target", "n_test", F.round("rmse", 4).alias("rmse"), F.round("r2", 6).alias("r2")
    )
    return judged_lines(lines).select("target", "n_test", "rmse", "r2", *SLICE_COLUMNS)


LINE_COLUMNS = [
    "l_orderkey",
    "l_partkey",
    "l_suppkey",
    "l_linenumber",
    "l_quantity",
    "l_extendedprice",
    "l_discount",
    "l_tax",
    "l_returnflag",
    "l_linestatus",
    "l_shipdate",
]
LINE_KEY = "md5('42:' || concat_ws('|', " + ", ".join(
    f"CAST({c} AS VARCHAR)" for c in LINE_COLUMNS
) + "))"


LINE_FEATURES = ["l_quantity", "l_discount", "l_tax"]


@query(
    "segment_linear",
    f"""WITH parts AS (SELECT *, CASE WHEN row_number() OVER (ORDER BY {LINE_KEY})
        <= ceil(0.2 * count(*) OVER ()) THEN 'test' ELSE 'train' END AS split FROM lineitem),
    long AS (SELECT parts.*, p_brand FROM parts JOIN part ON l_partkey = p_partkey),
    {normal_sql('long', LINE_FEATURES, 'l_extendedprice', 'p_brand')}
    SELECT seg AS p_brand, n_train, n_test, round(w0, 4) AS quantity, round(w1, 2) AS discount,
      round(w2, 2) AS tax, round(intercept, 2) AS intercept, round(rmse, 3) AS rmse, round(r2, 6) AS r2
    FROM solved""",
)
def segment_linear(spark, sf):
    lines = add_split(table(spark, sf, "lineitem").select(*LINE_COLUMNS))
    brands = table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    kept = lines.select("l_partkey", "split", "l_extendedprice", *LINE_FEATURES)
    rows = lookup(kept, brands, "l_partkey", "inner")
    found = segments.holdout_linear(rows, LINE_FEATURES, "l_extendedprice", ["p_brand"])
    return found.select(
        "p_brand",
        "n_train",
        "n_test",
        F.round(F.col("coefficients")[0], 4).alias("quantity"),
        F.round(F.col("coefficients")[1], 2).alias("discount"),
        F.round(F.col("coefficients")[2], 2).alias("tax"),
        F.round("intercept", 2).alias("intercept"),
        F.round("rmse", 3).alias("rmse"),
        F.round("r2", 6).alias("r2"),
    )


@query(
    "segment_experiments",
    f"""WITH parts AS (SELECT *, CASE WHEN row_number() OVER (ORDER BY {LINE_KEY})
        <= ceil(0.2 * count(*) OVER ()) THEN 'test' ELSE 'train' END AS split FROM lineitem),
    long AS (SELECT p_brand, split, l_quantity AS x, l_extendedprice AS y
      FROM parts JOIN part ON l_partkey = p_partkey),
    {line_sql('long', 'x', 'y', 'p_brand')},
    scores AS (SELECT p_brand, n_train, n_test, round(rmse, 3) AS rmse, round(r2, 6) AS r2,
      'regression' AS task_type, CAST(NULL AS DOUBLE) AS accuracy, CAST(NULL AS INT) AS n_classes,
      CAST(NULL AS DOUBLE) AS f1 FROM scored), {JUDGED_SQL}
    SELECT p_brand, n_train, n_test, rmse, r2, verdict, confidence FROM judged""",
)
def segment_experiments(spark, sf):
    lines = add_split(wide_table(spark, sf, "lineitem").select(*LINE_COLUMNS))
    brands = table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    rows = lookup(
        lines.select("l_partkey", "split", "l_quantity", "l_extendedprice"), brands, "l_partkey",
        "inner",
    )
    found = segments.holdout_line(
        rows, F.col("l_quantity"), F.col("l_extendedprice"), ["p_brand"]
    ).select(
        "p_brand", "n_train", "n_test", F.round("rmse", 3).alias("rmse"),
        F.round("r2", 6).alias("r2"),
    )
    return judged_lines(found).select(
        "p_brand", "n_train", "n_test", "rmse", "r2", "verdict", "confidence"
    )
