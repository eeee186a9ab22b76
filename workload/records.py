"""Checks of the four record types, on rows with every kind of fault planted."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assay.operators.validate import reasons
from assay.schemas import BACKENDS, CANDIDATE_SOURCES, COMPUTE_CHOICES, MODEL_TYPES, RUN_STATUSES, TASK_TYPES, VERDICTS
from workload.inputs import table
from workload.registry import query

# Per record: its table, its fields as expressions that both engines read, and its rules in SQL as
# (field, broken, reason) in the order of the operator.
CHECKED = {
    "candidate": (
        "documents",
        {
            "id": "CASE WHEN doc_id % 31 = 0 THEN NULL ELSE concat('d', doc_id) END",
            "name": "CASE WHEN doc_id % 37 = 0 THEN NULL ELSE lang END",
            "source": "CASE doc_id % 6 WHEN 0 THEN 'kaggle' WHEN 1 THEN 'huggingface' WHEN 2 THEN 'url' "
            "WHEN 3 THEN 'web' WHEN 4 THEN source ELSE NULL END",
            "description": "CASE WHEN doc_id % 41 = 0 THEN NULL ELSE source END",
            "url": "concat('http://hub/', doc_id)",
            "size_mb": "CASE doc_id % 3 WHEN 0 THEN '1.5' WHEN 1 THEN NULL ELSE 'big' END",
        },
        ["id", "name", "source", "description", "url"],
        {"size_mb": "double"},
        {"source": CANDIDATE_SOURCES},
        None,
    ),
    "plan": (
        "orders",
        {
            "question": "CASE WHEN o_orderkey % 29 = 0 THEN NULL ELSE 'q' END",
            "hypothesis": "CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE 'h' END",
            "target_variable": "'y'",
            "task_type": "CASE o_orderkey % 4 WHEN 0 THEN 'regression' WHEN 1 THEN o_orderstatus WHEN 2 THEN "
            "'clustering' ELSE NULL END",
            "dataset_query": "o_orderpriority",
            "model_type": "CASE o_custkey % 3 WHEN 0 THEN 'auto' WHEN 1 THEN 'svm' ELSE 'bert' END",
            "compute": "CASE o_custkey % 5 WHEN 0 THEN 'mainframe' ELSE 'local' END",
        },
        ["question", "hypothesis", "target_variable", "task_type", "dataset_query"],
        {},
        {"task_type": TASK_TYPES, "model_type": MODEL_TYPES, "compute": COMPUTE_CHOICES},
        None,
    ),
    "run": (
        "events",
        {
            "id": "CASE WHEN event_id % 19 = 0 THEN NULL ELSE concat('r', event_id) END",
            "status": "CASE WHEN user_id % 2 = 0 THEN event_type ELSE 'training' END",
            "compute_backend": "CASE user_id % 3 WHEN 0 THEN NULL WHEN 1 THEN 'local' ELSE 'abacus' END",
        },
        ["id", "plan"],
        {},
        {"status": RUN_STATUSES, "compute_backend": BACKENDS},
        None,
    ),
    "answer": (
        "orders",
        {
            "question": "'q'",
            "hypothesis": "'h'",
            "verdict": "CASE o_custkey % 4 WHEN 0 THEN 'confirmed' WHEN 1 THEN 'maybe' WHEN 2 THEN 'rejected' ELSE NULL END",
            "confidence": "CASE o_orderkey % 7 WHEN 0 THEN NULL ELSE (o_orderkey % 64) / CAST(32 AS DOUBLE) END",
            "evidence_summary": "o_orderpriority",
        },
        ["question", "hypothesis", "verdict", "confidence", "evidence_summary", "key_metrics"],
        {},
        {"verdict": VERDICTS},
        "confidence",
    ),
}
KEYS = {"documents": "doc_id", "orders": "o_orderkey", "events": "event_id"}


def checked_sql(kind: str) -> str:
    name, fields, required, typed, closed, share = CHECKED[kind]
    parts = [
        f"CASE WHEN {c} IS NULL THEN '{c} is missing' END" if c in fields else f"'{c} is missing'"
        for c in sorted(required, key=lambda c: c in fields)
    ]
    parts += [
        f"CASE WHEN {c} IS NOT NULL AND TRY_CAST({c} AS DOUBLE) IS NULL THEN '{c} is not of type {t}: ' || {c} END"
        for c, t in typed.items()
    ]
    parts += [
        f"CASE WHEN {c} IS NOT NULL AND {c} NOT IN ({', '.join(map(repr, allowed))}) "
        f"THEN '{c} is not one of the allowed values: ' || {c} END"
        for c, allowed in closed.items()
    ]
    if share:
        parts.append(f"CASE WHEN {share} > 1 THEN '{share} is not from 0.0 to 1.0: ' || CAST({share} AS VARCHAR) END")
    rows = ", ".join(f"{e} AS {n}" for n, e in fields.items())
    return (
        f"SELECT '{kind}' AS record, row_id, concat_ws('; ', {', '.join(parts)}) AS reasons "
        f"FROM (SELECT {KEYS[name]} AS row_id, {rows} FROM {name})"
    )


def checked_rows(spark, sf, kind: str) -> DataFrame:
    name, fields, *_ = CHECKED[kind]
    rows = table(spark, sf, name).selectExpr(f"{KEYS[name]} AS row_id", *(f"{e} AS {n}" for n, e in fields.items()))
    found = F.array_join(reasons(rows.drop("row_id"), kind), "; ")
    return rows.select(F.lit(kind).alias("record"), "row_id", found.alias("reasons"))


@query("record_checks", " UNION ALL ".join(checked_sql(k) for k in CHECKED))
def record_checks(spark, sf):
    return reduce(DataFrame.unionByName, (checked_rows(spark, sf, k) for k in CHECKED))
