"""Column and dataset profiles."""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assay.operators.columns import (
    as_text,
    is_numeric,
    nan_to_null,
    require_target,
    value_counts,
)
from assay.schemas import DATA_PROFILE, REGRESSION_TASKS

# Small-data warning and sample length.
SMALL_ROWS = 100
SAMPLE_VALUES = 5
SMALL_WARNING = "Small dataset: only %d rows. Results may not be reliable."
#: Rows of smallest key that samples are first looked for in, for all columns at once.
SAMPLE_ROWS = 64
#: Most classes that a record lists; all are in `target_counts`.
RECORD_CLASSES = 1000
CLASSES_WARNING = "The target has %d classes; the record lists the %d most frequent."


def profile_columns(df: DataFrame, approximate: bool = False) -> DataFrame:
    """(column_name, dtype, null_pct, unique_count), one row per column.

    The exact form shuffles each distinct value of each column once; the
    approximate form is one scan with a fixed-size sketch per column.
    """
    clean = nan_to_null(df)
    if approximate:
        stats = clean.agg(
            *(
                F.struct(
                    F.lit(f.name).alias("column_name"),
                    F.lit(f.dataType.simpleString()).alias("dtype"),
                    F.avg(F.col(f.name).isNull().cast("int")).alias("null_pct"),
                    F.approx_count_distinct(f.name).alias("unique_count"),
                ).alias(f"p{i}")
                for i, f in enumerate(df.schema)
            )
        )
        return stats.select(F.inline(F.array(*stats.columns)))
    types = F.create_map(
        *(F.lit(x) for f in df.schema for x in (f.name, f.dataType.simpleString()))
    )
    nulls = F.sum(F.when(F.col("value").isNull(), F.col("n")).otherwise(0))
    found = (
        value_counts(clean, df.columns)
        .groupBy("column_name")
        .agg(
            (nulls / F.sum("n").cast("double")).alias("null_pct"),
            F.count("value").alias("unique_count"),
        )
    )
    dtype = F.element_at(types, F.col("column_name")).alias("dtype")
    return found.select("column_name", dtype, "null_pct", "unique_count")


def profile_samples(df: DataFrame, key: str, size: int = SAMPLE_VALUES) -> DataFrame:
    """(column_name, position, value): the non-null values of the smallest keys.

    Each column is a top-k over its own two-column scan, so a task keeps `size` rows.
    """
    clean = nan_to_null(df)

    def head(column: str) -> DataFrame:
        return (
            clean.filter(F.col(column).isNotNull())
            .select(
                F.lit(column).alias("column_name"),
                F.col(key).alias("_key"),
                as_text(clean, column).alias("value"),
            )
            .orderBy("_key", "value")
            .limit(size)
            .agg(F.sort_array(F.collect_list(F.struct("_key", "value"))).alias("rows"))
            .select(F.lit(column).alias("column_name"), F.posexplode("rows").alias("i", "row"))
            .select("column_name", (F.col("i") + 1).alias("position"), "row.value")
        )

    return reduce(DataFrame.unionByName, [head(c) for c in df.columns])


def dataset_profile(df: DataFrame, target: str, task: str) -> DataFrame:
    """One row: size, target and warnings."""
    require_target(df, target)
    return df.agg(F.count(F.lit(1)).alias("num_rows")).select(
        "num_rows",
        F.lit(len(df.columns)).alias("num_columns"),
        F.lit(target).alias("target_column"),
        F.lit(task).alias("recommended_task_type"),
        F.array_compact(
            F.array(
                F.when(F.col("num_rows") < SMALL_ROWS, F.format_string(SMALL_WARNING, "num_rows"))
            )
        ).alias("warnings"),
    )


def target_stats(df: DataFrame, target: str) -> DataFrame:
    """Mean, sample deviation, minimum and maximum of a numeric target."""
    require_target(df, target)
    if not is_numeric(df.schema[target].dataType):
        raise ValueError(f"target column '{target}' must be numeric for a regression profile")
    y = F.nanvl(F.col(target).cast("double"), F.lit(None))
    return df.agg(
        F.avg(y).alias("mean"),
        F.stddev_samp(y).alias("std"),
        F.min(y).alias("min"),
        F.max(y).alias("max"),
    )


def target_counts(df: DataFrame, target: str) -> DataFrame:
    """(value, n) of the non-null target values."""
    require_target(df, target)
    clean = nan_to_null(df.select(target))
    return (
        clean.filter(F.col(target).isNotNull())
        .groupBy(as_text(clean, target).alias("value"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def target_distribution(df: DataFrame, target: str, task: str) -> DataFrame:
    """(name, value): moments for a regression task, class counts for any other."""
    if task in REGRESSION_TASKS:
        s = target_stats(df, target)
        names = s.columns
        return s.select(
            F.inline(
                F.array(
                    *(F.struct(F.lit(n).alias("name"), F.col(n).alias("value")) for n in names)
                )
            )
        )
    counts = target_counts(df, target)
    return counts.select(F.col("value").alias("name"), F.col("n").cast("double").alias("value"))


def _head_values(clean: DataFrame, key: str, columns: list[str], size: int) -> dict[str, list[str]]:
    """Per column the non-null values of the smallest keys, as text, ties by value.

    One pass keeps a few whole rows in each task and settles every column that has enough values in
    them; only columns that are nearly all null are looked through by themselves.
    """
    texts = [as_text(clean, c).alias(f"v{i}") for i, c in enumerate(columns)]
    rows = clean.select(F.col(key).alias("_key"), *texts)
    first = rows.orderBy("_key", *(f"v{i}" for i in range(len(columns)))).limit(SAMPLE_ROWS).collect()
    last = first[-1]["_key"] if len(first) == SAMPLE_ROWS else None
    found: dict[str, list[str]] = {}
    for i, c in enumerate(columns):
        own = sorted(((r["_key"], r[f"v{i}"]) for r in first if r[f"v{i}"] is not None), key=_null_first)
        # Rows of the last key may go on behind the cut.
        sure = [v for k, v in own if len(first) < SAMPLE_ROWS or k != last]
        if len(sure) < size and len(first) == SAMPLE_ROWS:
            more = rows.filter(F.col(f"v{i}").isNotNull()).orderBy("_key", f"v{i}").limit(size)
            sure = [r[f"v{i}"] for r in more.select(f"v{i}").collect()]
        found[c] = sure[:size]
    return found


def _null_first(pair: tuple) -> tuple:
    return (pair[0] is not None, pair[0] if pair[0] is not None else 0, pair[1])


def profile_record(
    df: DataFrame, target: str, task: str, key: str, exact: bool = False, size: int = SAMPLE_VALUES
) -> DataFrame:
    """One row in the shape of DATA_PROFILE: its size is bounded by the columns, not by the rows.

    One aggregate holds the row count, the nulls and a distinct sketch of every column, and the
    moments of a numeric target; a second pass takes the samples. `exact` counts distinct values by
    shuffling them instead of the sketch (its error is about 5 %). Classes beyond `RECORD_CLASSES`
    are left to `target_counts`, with a warning.
    """
    require_target(df, target)
    is_number = task in REGRESSION_TASKS
    if is_number and not is_numeric(df.schema[target].dataType):
        raise ValueError(f"target column '{target}' must be numeric for a regression profile")
    clean = nan_to_null(df)
    columns = df.columns
    y = F.col(target).cast("double") if is_number else F.lit(None).cast("double")
    sums = {"rows": F.count(F.lit(1)), "mean": F.avg(y), "std": F.stddev_samp(y), "min": F.min(y), "max": F.max(y)}
    sums |= {f"n{i}": F.count(c) for i, c in enumerate(columns)}
    if not exact:
        sums |= {f"u{i}": _sketch(clean, c) for i, c in enumerate(columns)}
    row = clean.agg(*(v.alias(k) for k, v in sums.items())).first()
    if exact:
        unique = {r["column_name"]: r["unique_count"] for r in profile_columns(df).collect()}
    else:
        unique = {c: row[f"u{i}"] for i, c in enumerate(columns)}
    rows = row["rows"]
    samples = _head_values(clean, key, columns, size)
    warnings = [SMALL_WARNING % rows] if rows < SMALL_ROWS else []
    if is_number:
        spread = {m: row[m] for m in ("mean", "std", "min", "max")}
    else:
        counts = target_counts(df, target).orderBy(F.desc("n"), "value").limit(RECORD_CLASSES + 1).collect()
        spread = {r["value"]: float(r["n"]) for r in counts[:RECORD_CLASSES]}
        if len(counts) > RECORD_CLASSES:
            warnings.append(CLASSES_WARNING % (target_counts(df, target).count(), RECORD_CLASSES))
    known = {
        c: (
            df.schema[c].dataType.simpleString(),
            (rows - row[f"n{i}"]) / rows if rows else None,
            unique.get(c, 0),
            samples[c],
        )
        for i, c in enumerate(columns)
    }
    record = (rows, len(columns), known, target, spread, task, warnings)
    return df.sparkSession.createDataFrame([record], DATA_PROFILE)


def _sketch(clean: DataFrame, column: str) -> Column:
    return F.approx_count_distinct(as_text(clean, column))
