"""Label encoding: values to their 0-based position in sorted order."""

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assay.operators.columns import as_text, value_counts
from assay.operators.joins import BROADCAST_BYTES, BROADCAST_ROWS, lookup
from assay.scratch import materialize

# Most levels one task ranks; more are ranked in that many range partitions.
LEVELS_PER_TASK = 1_000_000


@dataclass(frozen=True)
class Levels:
    """(column_name, value, code) and which columns' levels fit a broadcast."""

    table: DataFrame
    small: dict[str, bool]


def level_codes(
    levels: DataFrame, total: int, levels_per_task: int = LEVELS_PER_TASK
) -> DataFrame:
    """(column_name, value) -> (column_name, value, code), codes dense per column.

    Up to `levels_per_task` levels are ranked per column at once. More are
    range-partitioned; each part is ranked alone and shifted by the sizes of
    the parts before it, so no task sees more than its range.
    """
    if total <= levels_per_task:
        order = Window.partitionBy("column_name").orderBy("value")
        return levels.select("column_name", "value", (F.row_number().over(order) - 1).alias("code"))
    parts = materialize(
        levels.select("column_name", "value")
        .repartitionByRange(math.ceil(total / levels_per_task), "column_name", "value")
        .withColumn("part", F.spark_partition_id()),
        "levels",
    )
    earlier = (
        Window.partitionBy("column_name").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    )
    starts = (
        parts.groupBy("column_name", "part")
        .agg(F.count(F.lit(1)).alias("size"))
        .select(
            "column_name", "part", F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("start")
        )
    )
    order = Window.partitionBy("column_name", "part").orderBy("value")
    coded = (
        parts.withColumn("at", F.row_number().over(order) - 1)
        .join(F.broadcast(starts), ["column_name", "part"])
        .select("column_name", "value", (F.col("start") + F.col("at")).alias("code"))
    )
    return materialize(coded, "codes")


def fit_levels(
    df: DataFrame,
    columns: list[str],
    null_level: str | None = None,
    counts: DataFrame | None = None,
) -> Levels:
    """Levels of the given columns; nulls become `null_level` or are left out.

    `counts` are written value counts of the columns already at hand.
    """
    if counts is None:
        counts = materialize(value_counts(df, columns), "values")
    values = counts.select("column_name", F.coalesce("value", F.lit(null_level)).alias("value"))
    if null_level is not None:
        values = values.distinct()
    values = values.filter(F.col("value").isNotNull())
    sizes = (
        values.groupBy("column_name")
        .agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("value") + 32).alias("size"))
        .collect()
    )
    small = {c: n <= BROADCAST_ROWS and size <= BROADCAST_BYTES for c, n, size in sizes}
    return Levels(level_codes(values, sum(n for _, n, _ in sizes)), small)


def apply_levels(
    df: DataFrame,
    levels: Levels,
    columns: list[str],
    null_level: str | None = None,
    unseen: int | None = None,
) -> DataFrame:
    """Replace each column by its code (a long); values not in the table become `unseen`.

    Columns of few levels are looked up by broadcast. All columns of many levels are looked up
    together: their values in long form, one join with the dictionary, where hot values are met by
    broadcast, and one regrouping by row.
    """
    names = df.columns
    large = [c for c in columns if not levels.small.get(c, True)]
    for column in columns:
        if column in large:
            continue
        codes = levels.table.filter(F.col("column_name") == column).select(
            F.col("value").alias("_level"), F.col("code").alias("_code")
        )
        value = F.coalesce(as_text(df, column), F.lit(null_level))
        joined = lookup(df.withColumn("_level", value), codes, "_level", small=True)
        code = F.col("_code") if unseen is None else F.coalesce("_code", F.lit(unseen))
        df = joined.withColumn(column, code.cast("long")).select(*names)
    return _apply_large(df, levels, large, null_level, unseen) if large else df


def _apply_large(
    df: DataFrame, levels: Levels, columns: list[str], null_level: str | None, unseen: int | None
) -> DataFrame:
    """Codes of all columns of many levels by one dictionary join."""
    names = df.columns
    # Written once, so that a row keeps its number.
    rows = materialize(df.withColumn("_row", F.monotonically_increasing_id()), "encode-rows")
    entries = [
        F.struct(
            F.lit(i).alias("_c"), entry_key(F.lit(c), F.coalesce(as_text(df, c), F.lit(null_level))).alias("_entry")
        )
        for i, c in enumerate(columns)
    ]
    long = rows.select("_row", F.inline(F.array(*entries))).filter(F.col("_entry").isNotNull())
    codes = levels.table.filter(F.col("column_name").isin(columns)).select(
        entry_key(F.col("column_name"), F.col("value")).alias("_entry"), F.col("code").alias("_code")
    )
    found = lookup(long, codes, "_entry", "inner", small=False)
    by_row = found.groupBy("_row").agg(
        *(F.max(F.when(F.col("_c") == i, F.col("_code"))).alias(f"_code{i}") for i in range(len(columns)))
    )
    joined = rows.join(by_row, "_row", "left")
    for i, c in enumerate(columns):
        code = F.col(f"_code{i}") if unseen is None else F.coalesce(f"_code{i}", F.lit(unseen))
        joined = joined.withColumn(c, code.cast("long"))
    return joined.select(*names)


def entry_key(column: Column, value: Column) -> Column:
    """One key for a value of a column; null for a null value. A column's name holds no NUL."""
    return F.concat(column, F.lit("\u0000"), value)


def label_encode(df: DataFrame, columns: list[str], null_level: str | None = None) -> DataFrame:
    """Fit on all rows and apply to them."""
    return apply_levels(df, fit_levels(df, columns, null_level), columns, null_level)
