"""Columns of the caller under names that no operator uses inside."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def hidden(df: DataFrame, *without: str) -> tuple[DataFrame, dict[str, str]]:
    """`df` without some columns, the others renamed by place, and the new name of each."""
    kept = df.drop(*without)
    names = {c: f"in_{i}" for i, c in enumerate(kept.columns)}
    return kept.toDF(*names.values()), names


def shown(names: dict[str, str]) -> list[Column]:
    """Hidden columns under their own names."""
    return [F.col(h).alias(c) for c, h in names.items()]
