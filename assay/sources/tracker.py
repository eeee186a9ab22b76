"""Tracked runs: project, name, tags and a nested configuration, kept as VARIANT.

A configuration has no fixed schema, so it is stored in binary form and read by path: `$.a.b`,
`$.list[0]`. A value of another type than asked for is read through its text where that can be
cast (`"0.1"` as double); what can't, a missing path, a JSON null and a configuration that isn't
JSON give the default.
"""

from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TRACKED_RUN = T.StructType(
    [
        T.StructField("run_id", T.StringType()),
        T.StructField("project", T.StringType()),
        T.StructField("run_name", T.StringType()),
        T.StructField("config", T.VariantType()),
        T.StructField("tags", T.ArrayType(T.StringType())),
    ]
)


@dataclass(frozen=True)
class Setting:
    """A place in a configuration, the type to read it as and the value where it is unset."""

    path: str
    type: str
    default: Any = None


def init_runs(runs: DataFrame, path: str) -> None:
    """Append tracked runs; `config` is JSON text or VARIANT already."""
    text = isinstance(runs.schema["config"].dataType, T.StringType)
    config = F.try_parse_json("config") if text else F.col("config")
    runs.withColumn("config", config).select(*TRACKED_RUN.fieldNames()).write.mode("append").parquet(path)


def read_tracked(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(TRACKED_RUN).parquet(path)


def setting(config: Column, wanted: Setting) -> Column:
    """One setting of a configuration, typed."""
    typed = F.try_variant_get(config, wanted.path, wanted.type)
    by_text = F.try_variant_get(config, wanted.path, "string").try_cast(wanted.type)
    return F.coalesce(typed, by_text, F.lit(wanted.default).cast(wanted.type))


def with_settings(runs: DataFrame, settings: dict[str, Setting]) -> DataFrame:
    """Tracked runs with a column per named setting."""
    return runs.withColumns({name: setting(F.col("config"), s) for name, s in settings.items()})


def tagged(runs: DataFrame, *tags: str) -> DataFrame:
    """Runs that carry all these tags."""
    wanted = F.array(*map(F.lit, tags)).cast("array<string>")
    return runs.filter(F.size(F.array_except(wanted, F.coalesce("tags", F.array().cast("array<string>")))) == 0)


def best_by_setting(runs: DataFrame, scores: DataFrame, wanted: Setting, by: str = "value") -> DataFrame:
    """(setting, run_id, value, n): per value of a setting the best scored run, ties to the smaller id.

    `scores` holds (run_id, <by>); runs without a score or with NaN only count in n.
    """
    known = runs.select("run_id", setting(F.col("config"), wanted).alias("setting"))
    scored = known.join(scores.select("run_id", F.col(by).alias("_v")), "run_id", "left")
    # Greatest value first, then the smallest id, both as one minimum: reduced inside each task.
    usable = F.when(F.col("_v").isNotNull() & ~F.isnan("_v"), F.struct((-F.col("_v")).alias("v"), "run_id"))
    best = scored.groupBy("setting").agg(F.min(usable).alias("b"), F.count("*").alias("n"))
    return best.select("setting", "b.run_id", (-F.col("b.v")).alias("value"), "n")
