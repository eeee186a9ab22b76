"""Machine choice and cost of a table of plans."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assay.functions.numbers import fixed, half_even
from assay.schemas import HOURLY_RATES, TEXT_TASKS

# Budgets (minutes) and machines of the choice.
CLOUD_MIN_MINUTES = 10
SHORT_MINUTES = 15
MEDIUM_MINUTES = 60
GPU_MACHINE = "n1-standard-4-t4"
SHORT_MACHINE = "n1-standard-4"
MEDIUM_MACHINE = "n1-standard-8"
LONG_MACHINE = "n1-standard-16"

# Recommendation texts.
LOCAL_TEXT = (
    "Running locally — free but limited to your machine's CPU/RAM. "
    "Consider Vertex AI for larger datasets or longer training runs."
)
CLOUD_TEXT = (
    "Vertex AI %s spot instance (~$%s/hr). Estimated cost: $%s for %d minutes. "
    "Uses preemptible/spot pricing for maximum savings."
)


def rate_table(spark: SparkSession) -> DataFrame:
    """The machines and their hourly rates: a fixed, small table."""
    return spark.createDataFrame(list(HOURLY_RATES.items()), "machine string, rate double")


def recommend_machine(task_type: Column, needs_gpu: Column, minutes: Column) -> Column:
    """Cheapest machine that suits the task and the budget."""
    return (
        F.when(needs_gpu | task_type.isin(TEXT_TASKS), GPU_MACHINE)
        .when(minutes <= SHORT_MINUTES, SHORT_MACHINE)
        .when(minutes <= MEDIUM_MINUTES, MEDIUM_MACHINE)
        .otherwise(LONG_MACHINE)
    )


def choose_backend(compute: Column, minutes: Column, cloud_ready: bool) -> Column:
    """Resolve `auto`: local for short budgets or without a cloud project."""
    automatic = F.when((minutes < CLOUD_MIN_MINUTES) | F.lit(not cloud_ready), "local").otherwise(
        "vertex_ai"
    )
    return F.when(compute == "auto", automatic).when(compute == "local", "local").otherwise(
        "vertex_ai"
    )


def estimate_costs(
    plans: DataFrame,
    rates: DataFrame | None = None,
    cloud_ready: bool = False,
    compute: Column | None = None,
) -> DataFrame:
    """Plans with compute_backend, cost, breakdown and recommendation.

    `compute` overrides the plan's own choice. A machine without a rate is
    replaced by the recommended one before its rate is looked up.
    """
    rates = rate_table(plans.sparkSession) if rates is None else rates
    known = F.broadcast(rates)
    minutes = F.col("time_budget_minutes")
    wanted = F.col("compute") if compute is None else compute
    advice = recommend_machine(
        F.col("task_type"), F.coalesce(F.col("needs_gpu"), F.lit(False)), minutes
    )
    placed = (
        plans.withColumn("compute_backend", choose_backend(wanted, minutes, cloud_ready))
        .withColumn("_advice", advice)
        .join(
            known.select(F.col("machine").alias("machine_type"), F.col("rate").alias("_own")),
            "machine_type",
            "left",
        )
        .join(
            known.select(F.col("machine").alias("_advice"), F.col("rate").alias("_advised")),
            "_advice",
            "left",
        )
    )
    is_local = F.col("compute_backend") == "local"
    hours = minutes / F.lit(60.0)
    rate = F.coalesce("_own", "_advised")
    cost = rate * hours
    machine = F.when(F.col("_own").isNotNull(), F.col("machine_type")).otherwise(F.col("_advice"))
    return placed.select(
        *(c for c in plans.columns if c not in ("machine_type", "estimated_cost_usd")),
        "compute_backend",
        F.when(is_local, "local").otherwise(machine).alias("machine_type"),
        hours.alias("estimated_hours"),
        F.when(is_local, 0.0).otherwise(half_even(cost, 4)).alias("estimated_cost_usd"),
        F.when(is_local, F.create_map().cast("map<string,double>"))
        .otherwise(F.create_map(F.lit("machine_hourly_rate_usd"), rate, F.lit("hours"), hours))
        .alias("breakdown"),
        F.when(is_local, LOCAL_TEXT)
        .otherwise(F.format_string(CLOUD_TEXT, machine, fixed(rate, 3), fixed(cost, 3), minutes))
        .alias("recommendation"),
    )
