"""Join of a skewed table to a table with one row per key."""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Bounds of a lookup that is broadcast; a larger one is shuffled.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 64 * 1024 * 1024
# A key with more than this share of the rows is hot, so at most 1/share keys are.
HOT_SHARE = 1e-4
HOT_ROWS = 1_000_000
#: Slices of answered rows for each shuffle partition, so that these fill evenly.
SALTS = 8


def salt(df: DataFrame, salts: int | None = None) -> Column:
    """Even spread of rows that a repeated task reproduces; equal rows differ by their part."""
    if salts is None:
        salts = SALTS * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return F.pmod(F.xxhash64(*df.columns, F.spark_partition_id()), F.lit(salts)).cast("int")


def byte_size(df: DataFrame) -> Column:
    """Rough width of a row: text by its bytes, nested values by their JSON."""

    def width(field: T.StructField) -> Column:
        column = F.col(field.name)
        if isinstance(field.dataType, (T.StringType, T.BinaryType)):
            return F.coalesce(F.octet_length(column), F.lit(0)) + 16
        if isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType)):
            return F.coalesce(F.length(F.to_json(F.struct(column))), F.lit(0)) + 16
        return F.lit(16)

    return reduce(Column.__add__, (width(f) for f in df.schema)).cast("long")


def fits_broadcast(
    df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES
) -> bool:
    """Measure a table against the broadcast bounds: one pre-aggregated scan."""
    n, total = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(byte_size(df)), F.lit(0))).first()
    return n <= rows and total <= size


def lookup(
    left: DataFrame,
    right: DataFrame,
    key: str,
    how: str = "left",
    small: bool | None = None,
    broadcast_rows: int = BROADCAST_ROWS,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Join `left` to `right`, which holds each key once.

    A small right side is broadcast. For a large one the few hot keys of the
    left are looked up by broadcast and only the rest is shuffled; rows already
    answered carry a salted null key, so they spread evenly and match nothing.
    `small` tells whether the right side fits where the caller has measured it.
    """
    if how not in ("left", "inner", "left_semi", "left_anti"):
        raise ValueError(f"unsupported join kind {how!r}")
    if fits_broadcast(right, broadcast_rows) if small is None else small:
        return left.join(F.broadcast(right), key, how)

    values = [c for c in right.columns if c != key]
    counts = left.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    bar = max(hot_rows, int(left.count() * HOT_SHARE))
    hot = counts.filter(F.col("_n") > bar).select(key)
    answers = right.join(F.broadcast(hot), key, "left_semi").select(
        F.col(key).alias("_hot"), F.struct(F.lit(True).alias("_found"), *values).alias("_a")
    )
    large = right.select(
        F.col(key).alias("_key"),
        F.lit(0).alias("_salt"),
        F.struct(F.lit(True).alias("_found"), *values).alias("_b"),
    )
    once = left.join(F.broadcast(answers), F.col(key) == F.col("_hot"), "left")
    answered = F.col("_a").isNotNull() | F.col(key).isNull()
    keyed = once.select(
        *left.columns,
        "_a",
        F.when(~answered, F.col(key)).alias("_probe"),
        F.when(answered, salt(left)).otherwise(0).alias("_spread"),
    )
    # Spark broadcasts by the size of files, which says little about rows: those measured above stay shuffled.
    joined = keyed.join(
        large.hint("merge"),
        (F.col("_probe") == F.col("_key")) & (F.col("_spread") == F.col("_salt")),
        "left",
    ).withColumn("_hit", F.coalesce("_a", "_b"))
    if how == "left_anti":
        return joined.filter(F.col("_hit").isNull()).select(*left.columns)
    if how != "left":
        joined = joined.filter(F.col("_hit").isNotNull())
    if how == "left_semi":
        return joined.select(*left.columns)
    return joined.select(*left.columns, *(F.col(f"_hit.{c}").alias(c) for c in values))
