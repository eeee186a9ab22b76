"""Column checks and type groups shared by the operators."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def is_numeric(dtype: T.DataType) -> bool:
    """Numbers and booleans; everything else is a category."""
    return isinstance(dtype, (T.NumericType, T.BooleanType))


def numeric_columns(df: DataFrame, columns: list[str]) -> list[str]:
    return [c for c in columns if is_numeric(df.schema[c].dataType)]


def categorical_columns(df: DataFrame, columns: list[str]) -> list[str]:
    return [c for c in columns if not is_numeric(df.schema[c].dataType)]


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN counts as missing in float columns."""
    return df.select(
        *(
            F.nanvl(F.col(f.name), F.lit(None)).cast(f.dataType).alias(f.name)
            if isinstance(f.dataType, (T.FloatType, T.DoubleType))
            else F.col(f.name)
            for f in df.schema
        )
    )


def as_text(df: DataFrame, column: str) -> Column:
    """A value as the string it is counted and encoded under."""
    if isinstance(df.schema[column].dataType, (T.FloatType, T.DoubleType)):
        return (F.col(column) + F.lit(0.0)).cast("string")
    return F.col(column).cast("string")


def require_target(df: DataFrame, target: str) -> None:
    if target not in df.columns:
        raise ValueError(f"target column '{target}' not found. Available columns: {df.columns}")


def select_features(df: DataFrame, features: list[str] | None, target: str) -> DataFrame:
    """Features then target; no feature list keeps every column."""
    require_target(df, target)
    if not features:
        return df
    missing = [c for c in features if c not in df.columns]
    if missing:
        raise ValueError(f"Feature columns not found: {missing}")
    return df.select(*features, target)


def text_column(df: DataFrame, target: str, name: str | None = None) -> str:
    """The named text column, or the first string column that is not the target."""
    require_target(df, target)
    if name:
        if name not in df.columns:
            raise ValueError(f"Text column '{name}' not found")
        return name
    for field in df.schema:
        if isinstance(field.dataType, T.StringType) and field.name != target:
            return field.name
    raise ValueError("No text column found")


def value_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, value, n), nulls included as a null value.

    One scan for any number of columns; hot values shrink before the shuffle.
    """
    pairs = [F.struct(F.lit(c).alias("column_name"), as_text(df, c).alias("value")) for c in columns]
    return (
        df.select(F.inline(F.array(*pairs)))
        .groupBy("column_name", "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )
