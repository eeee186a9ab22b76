"""Run records, run events, metrics files and the metric log."""

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assay.schemas import METRIC_LOG, METRICS, RUN, RUN_EVENT, RUN_STATUSES

_CORRUPT = "_corrupt"


def append_events(events: DataFrame, path: str) -> None:
    """Append run events; the log is never rewritten."""
    events.select(*RUN_EVENT.fieldNames()).write.mode("append").parquet(path)


def read_events(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RUN_EVENT).parquet(path)


def append_metric_log(rows: DataFrame, path: str) -> None:
    rows.select(*METRIC_LOG.fieldNames()).write.mode("append").parquet(path)


def pivot_metric_log(
    log: DataFrame, names: list[str], order: str | None = None
) -> DataFrame:
    """One row per run and step, a column per metric; the last logged value wins."""
    last = F.max_by("value", F.col(order)) if order else F.last("value")
    return log.groupBy("run_id", "step").pivot("name", names).agg(last)


def write_run_records(runs: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One JSON object per line."""
    runs.write.mode(mode).json(path)


def read_run_records(spark: SparkSession, path: str, one_per_file: bool = False) -> DataFrame:
    """All readable runs, oldest first; malformed records and unknown states are skipped.

    `one_per_file` reads a folder per run with one, possibly indented, run.json each.
    """
    reader = (
        spark.read.schema(RUN).option("mode", "DROPMALFORMED").option("recursiveFileLookup", True)
    )
    if one_per_file:
        reader = reader.option("multiLine", True).option("pathGlobFilter", "run.json")
    return list_runs(reader.json(path))


def created_at(runs: DataFrame) -> Column:
    """Creation time of the plan; times without a zone are in the session's, unreadable ones null."""
    return F.col("plan.created_at").try_cast("timestamp") if "plan" in runs.columns else F.lit(None)


def list_runs(runs: DataFrame) -> DataFrame:
    """By creation time, then id; runs without a time come last."""
    known = runs.filter(F.col("id").isNotNull() & F.col("status").isin(RUN_STATUSES))
    return known.orderBy(created_at(runs).asc_nulls_last(), "id")


def find_run(runs: DataFrame, run_id: str) -> DataFrame:
    """The run with this id; no row when unknown."""
    return runs.filter(F.col("id") == run_id)


def to_json_records(df: DataFrame, id_: str, columns: list[str]) -> DataFrame:
    """(id, json) of the given columns."""
    return df.select(id_, F.to_json(F.struct(*columns)).alias("json"))


def from_json_records(df: DataFrame, id_: str, schema: T.StructType) -> DataFrame:
    """Back to columns."""
    return df.select(id_, F.from_json("json", schema).alias("_r")).select(id_, "_r.*")


def load_metrics(lines: DataFrame, id_: str, text: str) -> DataFrame:
    """Metrics from JSON text: (id, success, error, metrics...); a bad record is a failed row."""
    schema = T.StructType([*METRICS.fields, T.StructField(_CORRUPT, T.StringType())])
    parsed = lines.withColumn(
        "_m", F.from_json(text, schema, {"columnNameOfCorruptRecord": _CORRUPT})
    )
    bad = F.col("_m").isNull() | F.col(f"_m.{_CORRUPT}").isNotNull() | F.col(text).isNull()
    return parsed.select(
        id_,
        (~bad).alias("success"),
        F.when(bad, "invalid metrics record").alias("error"),
        *(F.when(~bad, F.col(f"_m.{n}")).alias(n) for n in METRICS.fieldNames()),
    )


def read_metrics_files(spark: SparkSession, path: str) -> DataFrame:
    """Metrics of every metrics.json below a path, with the file as id."""
    files = (
        spark.read.option("recursiveFileLookup", True)
        .option("pathGlobFilter", "metrics.json")
        .text(path, wholetext=True)
        .select(F.col("_metadata.file_path").alias("file"), "value")
    )
    return load_metrics(files, "file", "value")


def write_metrics(metrics: DataFrame, path: str) -> None:
    """One metrics.json record per line."""
    metrics.write.mode("overwrite").json(path)


def metric_map(columns: list[str]) -> Column:
    """Non-null numeric columns as one map."""
    entries = [
        F.struct(F.lit(c).alias("key"), F.col(c).cast("double").alias("value")) for c in columns
    ]
    return F.map_from_entries(F.filter(F.array(*entries), lambda e: e["value"].isNotNull()))


def union_all(parts: list[DataFrame]) -> DataFrame:
    """Tables one after the other, duplicates kept."""
    return reduce(DataFrame.unionByName, parts)
