"""State of runs from their event log."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assay.schemas import RUN_STATUSES

# The answer gate.
FINISHED = ["complete", "failed"]
STILL = "Experiment is still %s. Wait for completion."
NO_METRICS_FILE = "metrics.json not found. Training may not have completed."
NOT_FOUND = "Experiment %s not found"


def status_code(status: Column) -> Column:
    """Position of a status in the closed list: a fixed-width value for aggregation."""
    return F.array_position(F.array(*(F.lit(s) for s in RUN_STATUSES)), status).cast("int")


def status_name(code: Column) -> Column:
    return F.get(F.array(*(F.lit(s) for s in RUN_STATUSES)), code - 1)


def latest_runs(events: DataFrame) -> DataFrame:
    """(run_id, status, error, seq): last status, last error that was set.

    A single aggregate without a window, so a run with very many events is
    reduced inside each task. Of events with one number the later status, and
    the greater error text, counts, whatever the row order.
    """
    code = status_code(F.col("status"))
    found = events.groupBy("run_id").agg(
        F.max_by(code, F.struct("seq", code)).alias("_code"),
        F.max_by("error", F.when(F.col("error").isNotNull(), F.struct("seq", "error"))).alias("error"),
        F.max("seq").alias("seq"),
    )
    return found.select("run_id", status_name(F.col("_code")).alias("status"), "error", "seq")


def merged_metrics(events: DataFrame) -> DataFrame:
    """(run_id, name, value): per metric the value set last."""
    values = events.select("run_id", "seq", F.explode("metrics").alias("name", "value"))
    return values.groupBy("run_id", "name").agg(F.max_by("value", F.struct("seq", "value")).alias("value"))


def metrics_table(merged: DataFrame, names: list[str]) -> DataFrame:
    """Merged metrics as one row per run with the named columns."""
    return merged.groupBy("run_id").agg(
        *(F.max(F.when(F.col("name") == n, F.col("value"))).alias(n) for n in names)
    )


def merge_maps(old: Column, new: Column) -> Column:
    """Union of two maps; the new value wins."""
    return F.map_zip_with(old, new, lambda _, a, b: F.coalesce(b, a))


def run_status(events: DataFrame, requests: DataFrame) -> DataFrame:
    """Status per requested run_id, `not_found` for an unknown one."""
    return requests.join(latest_runs(events), "run_id", "left").select(
        "run_id", F.coalesce("status", F.lit("not_found")).alias("status"), "error"
    )


def answerable(
    runs: DataFrame, metrics: DataFrame, requests: DataFrame | None = None
) -> DataFrame:
    """Runs with an `error` that says why they cannot be answered yet, else null.

    `metrics` holds one row per run_id. With `requests` (run_id) the rows are
    the requested runs and an unknown one is an error row.
    """
    present = metrics.withColumn("_has_metrics", F.lit(True))
    joined = runs.drop("error").withColumn("_known", F.lit(True))
    if requests is not None:
        joined = requests.join(joined, "run_id", "left")
    joined = joined.join(present, "run_id", "left")
    reason = (
        F.when(F.col("_known").isNull(), F.format_string(NOT_FOUND, F.col("run_id").cast("string")))
        .when(~F.col("status").isin(FINISHED), F.format_string(STILL, F.col("status")))
        .when(F.col("_has_metrics").isNull(), NO_METRICS_FILE)
    )
    return joined.withColumn("error", reason).drop("_known", "_has_metrics")
