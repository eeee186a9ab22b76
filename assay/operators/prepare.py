"""From a raw table to imputed, encoded and split training data."""

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assay.operators import encode, impute, split
from assay.operators.columns import (
    categorical_columns,
    is_numeric,
    nan_to_null,
    numeric_columns,
    require_target,
    select_features,
    value_counts,
)
from assay.operators.profile import (
    dataset_profile,
    profile_columns,
    profile_record,
    target_distribution,
)
from assay.schemas import REGRESSION_TASKS
from assay.scratch import materialize


@dataclass(frozen=True)
class Prepared:
    """Prepared rows with their `split`, and the profile of the raw table."""

    frame: DataFrame
    features: list[str]
    target: str
    key: list[str]
    source: DataFrame
    task: str
    warnings: list[str] = field(default_factory=list)

    @property
    def train(self) -> DataFrame:
        return self.frame.filter(F.col("split") == "train").drop("split")

    @property
    def test(self) -> DataFrame:
        return self.frame.filter(F.col("split") == "test").drop("split")

    def xy(self, part: str) -> tuple[DataFrame, DataFrame]:
        """Features and target of a split, each with the key."""
        rows = self.frame.filter(F.col("split") == part)
        return rows.select(*self.key, *self.features), rows.select(*self.key, self.target)

    def profile(self, exact: bool = False) -> DataFrame:
        """The raw table's profile as one record; samples go by the first key, or by the first column."""
        first = self.key[0] if self.key else self.source.columns[0]
        return profile_record(self.source, self.target, self.task, first, exact)

    def columns_profile(self, approximate: bool = False) -> DataFrame:
        return profile_columns(self.source, approximate)

    def dataset_profile(self) -> DataFrame:
        return dataset_profile(self.source, self.target, self.task)

    def target_distribution(self) -> DataFrame:
        return target_distribution(self.source, self.target, self.task)

    def write(self, path: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
        """One directory with a folder per split."""
        writer = self.frame.write.mode(mode).partitionBy("split")
        if fmt == "csv":
            writer = writer.option("header", True)
        writer.format(fmt).save(path)


def prepare(
    df: DataFrame,
    target: str,
    task: str,
    features: list[str] | None = None,
    key: str | list[str] | None = None,
    test_size: float = split.TEST_SIZE,
    fit_on: str = "all",
    text_columns: list[str] | None = None,
) -> Prepared:
    """Select, impute, label-encode and split.

    `key` names the columns that identify a row; they decide the split and are
    carried along. `fit_on="train"` fits fills and levels on the training rows
    only, and codes a level first seen in the test rows as 0. `text_columns`
    are left as text, with nulls as empty strings.
    """
    if fit_on not in ("all", "train"):
        raise ValueError(f"fit_on must be 'all' or 'train', got {fit_on!r}")
    require_target(df, target)
    keys = [key] if isinstance(key, str) else list(key or [])
    text = set(text_columns or [])
    chosen = select_features(df, features or [c for c in df.columns if c not in (*keys, target)], target)
    used = chosen.columns
    if task in REGRESSION_TASKS and not is_numeric(df.schema[target].dataType):
        raise ValueError(f"target column '{target}' must be numeric for task '{task}'")
    # Keys travel under their own names, so a key column may be a feature too.
    raw = nan_to_null(df).select(
        *(F.col(k).alias(f"_key_{k}") for k in keys),
        *(
            F.coalesce(F.col(c), F.lit("")).alias(c)
            if c in text
            else F.col(c).cast("int").alias(c)
            if isinstance(df.schema[c].dataType, T.BooleanType)
            else F.col(c).cast("string").alias(c)
            if isinstance(df.schema[c].dataType, T.NullType)
            else F.col(c)
            for c in used
        ),
    )
    # The source is read once; fills, levels, the split and the result all come from what it gave.
    raw = materialize(raw, "raw")
    hidden = [f"_key_{k}" for k in keys]
    rows, nulls = impute.missing_counts(raw.select(*used))
    empty = [c for c in numeric_columns(raw, used) if c != target and rows and nulls[c] == rows]
    warnings = [f"Column '{c}' has no values and was dropped." for c in empty]
    if nulls[target]:
        warnings.append(f"{nulls[target]} missing target values were imputed.")
    used = [c for c in used if c not in empty]
    raw = split.add_split(raw.select(*hidden, *used), hidden or None, test_size)

    basis = raw if fit_on == "all" else raw.filter(F.col("split") == "train")
    categories = [c for c in categorical_columns(raw, used) if c not in text]
    counts = materialize(value_counts(basis, categories), "values") if categories else None
    fills = impute.fit_fills(basis, used, counts, (rows, nulls) if fit_on == "all" else None)
    filled = fills.apply(raw)
    if categories:
        unknown = [c for c in categories if fills.categories.get(c) == impute.UNKNOWN]
        if unknown:
            extra = raw.sparkSession.createDataFrame(
                [(c, impute.UNKNOWN, 0) for c in unknown], counts.schema
            )
            counts = (
                counts.unionByName(extra)
                .groupBy("column_name", "value")
                .agg(F.sum("n").alias("n"))
            )
        levels = encode.fit_levels(basis, categories, counts=counts)
        filled = encode.apply_levels(
            filled, levels, categories, unseen=0 if fit_on == "train" else None
        )
    outputs = [c for c in used if c not in keys]
    frame = filled.select(
        *(F.col(h).alias(k) for h, k in zip(hidden, keys)),
        *outputs,
        "split",
    )
    return Prepared(frame, [c for c in used if c != target], target, keys, df, task, warnings)


def quality(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, is_numeric, nulls) of prepared columns: all numeric, no nulls."""
    numeric = set(numeric_columns(df, columns))
    counts = df.agg(*(F.count_if(F.col(c).isNull()).alias(c) for c in columns))
    return counts.select(
        F.inline(
            F.array(
                *(
                    F.struct(
                        F.lit(c).alias("column_name"),
                        F.lit(c in numeric).alias("is_numeric"),
                        F.col(c).alias("nulls"),
                    )
                    for c in columns
                )
            )
        )
    )


def partition_check(frame: DataFrame, key: str) -> DataFrame:
    """One row: rows per split and keys that are in both; disjoint when `shared` is 0."""
    per_key = frame.groupBy(key).agg(
        F.count_if(F.col("split") == "train").alias("a"),
        F.count_if(F.col("split") == "test").alias("b"),
    )
    return per_key.agg(
        F.sum("a").alias("train_rows"),
        F.sum("b").alias("test_rows"),
        F.count_if((F.col("a") > 0) & (F.col("b") > 0)).alias("shared"),
    )
