"""Plans out of model replies, and the checks a plan must pass."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assay.schemas import COMPUTE_CHOICES, MODEL_TYPES, PLAN, TASK_TYPES

# Where a reply may hold its JSON, and defaults of absent fields.
FENCE = r"(?i)```(?:json)?\s*([\s\S]+?)```"
BRACES = r"\{[\s\S]+\}"
NO_PLAN = "Could not extract a valid experiment plan from the reply."
DEFAULTS = {
    "model_type": "auto",
    "needs_gpu": False,
    "compute": "auto",
    "machine_type": "n1-standard-4",
    "time_budget_minutes": 30,
    "estimated_cost_usd": 0.0,
    "description": "",
}
NOT_ANSWERABLE = "task_type clustering has no verdict"
REQUIRED = ["question", "hypothesis", "target_variable", "task_type", "dataset_query"]


def plan_record(reply: Column) -> Column:
    """Plan in a reply: all of it, else its fenced block, else its outermost braces.

    Null when none of them is a JSON object.
    """
    parsed = F.coalesce(
        F.try_parse_json(reply),
        F.try_parse_json(F.regexp_extract(reply, FENCE, 1)),
        F.try_parse_json(F.regexp_extract(reply, BRACES, 0)),
    )
    return F.try_variant_get(parsed, "$", PLAN.simpleString())


def parse_replies(
    replies: DataFrame, reply: str, id_: str = "id", **given: Column
) -> DataFrame:
    """One plan row per reply, with the `reason` it is rejected for or null.

    `given` are the fields the asker sets (question, time_budget_minutes,
    compute); they win over what the reply says.
    """
    # As a generator the parse runs once per row, however many fields and filters read it.
    parsed = replies.select(
        "*", F.inline(F.array(F.struct(plan_record(F.col(reply)).alias("_plan"))))
    )

    def value(name: str) -> Column:
        if name == "id":
            return F.col(id_).cast("string")
        if name in given:
            return given[name]
        own = F.col(f"_plan.{name}")
        if name in ("feature_variables", "suggested_dataset_ids"):
            return F.coalesce(own, F.array().cast("array<string>"))
        return F.coalesce(own, F.lit(DEFAULTS[name])) if name in DEFAULTS else own

    fields = [value(f.name).cast(f.dataType).alias(f.name) for f in PLAN]
    plans = parsed.select(*fields, F.col("_plan").isNull().alias("_none"))
    reason = F.when(F.col("_none"), NO_PLAN).otherwise(plan_reason(PLAN.fieldNames()))
    return plans.withColumn("reason", reason).drop("_none")


def extract_plans(
    replies: DataFrame, reply: str, id_: str = "id", **given: Column
) -> tuple[DataFrame, DataFrame]:
    """(plans, rejects as id and reason) of a table of replies."""
    checked = parse_replies(replies, reply, id_, **given)
    return (
        checked.filter(F.col("reason").isNull()).drop("reason"),
        checked.filter(F.col("reason").isNotNull()).select("id", "reason"),
    )


def plan_reason(columns: list[str]) -> Column:
    """First failed check of a plan row, null when it is sound."""
    reason = F.lit(None).cast("string")
    closed = {"task_type": TASK_TYPES, "model_type": MODEL_TYPES, "compute": COMPUTE_CHOICES}
    checks = [
        (F.col(c).isNull(), F.lit(f"{c} is missing")) for c in REQUIRED if c in columns
    ] + [
        (
            ~F.coalesce(F.col(c).isin(allowed), F.lit(False)),
            F.concat(F.lit(f"{c} is not one of the allowed values: "), F.coalesce(F.col(c), F.lit("null"))),
        )
        for c, allowed in closed.items()
        if c in columns
    ]
    if "task_type" in columns:
        checks.append((F.col("task_type") == "clustering", F.lit(NOT_ANSWERABLE)))
    for failed, text in reversed(checks):
        reason = F.when(failed, text).otherwise(reason)
    return reason


def validate_plans(plans: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, rejects with `reason`); both read the input once, without a shuffle."""
    checked = plans.withColumn("reason", plan_reason(plans.columns))
    return (
        checked.filter(F.col("reason").isNull()).drop("reason"),
        checked.filter(F.col("reason").isNotNull()),
    )
