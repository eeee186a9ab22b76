"""Fill values: medians of numbers, modes of categories."""

import struct
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assay.operators.columns import categorical_columns, nan_to_null, numeric_columns, value_counts

# Fixed value: fill of a category column that has no values at all.
UNKNOWN = "unknown"

# Most values of a column one task may hold to find a median; longer columns are selected by
# digits, all together. Short columns share a scan up to so many values in all.
DIRECT_ROWS = 1_000_000
DIRECT_TOTAL = 4_000_000


# Bits of a key that a scan of a selection settles.
DIGIT_BITS = 16


def order_key(x: Column) -> Column:
    """A long in the order of the doubles: the bits of the size, with the sign of the number.

    All steps are exact: powers of two, and products and quotients by them.
    """
    size = F.abs(x)
    within = (size >= 2.0**-1022) & (size < float("inf"))
    guess = F.floor(F.log2(F.when(within, size).otherwise(1.0))).cast("double")
    power = F.pow(F.lit(2.0), guess)
    exponent = F.when(size < power, guess - 1).when(size >= power * 2, guess + 1).otherwise(guess)
    fraction = (size / F.pow(F.lit(2.0), exponent) - 1) * 2.0**52
    normal = F.shiftleft((exponent + 1023).cast("long"), 52) + F.when(within, fraction).otherwise(0.0).cast("long")
    tiny = F.when(size < 2.0**-1022, size).otherwise(0.0) * 2.0**537 * 2.0**537
    bits = (
        F.when(within, normal).when(size == float("inf"), F.lit(2047 << 52)).otherwise(tiny.cast("long"))
    )
    return F.when(x < 0, -bits).otherwise(bits)


def key_value(key: int) -> float:
    """The double of an order key."""
    size = struct.unpack(">d", abs(key).to_bytes(8, "big"))[0]
    return -size if key < 0 else size


def values_at(df: DataFrame, ranks: dict[str, set[int]]) -> dict[str, dict[int, float]]:
    """Values of 0-based ranks of columns of doubles, nulls left out: exact, in four scans.

    A radix selection on order keys. Every scan counts one digit of the keys of all columns, of those
    rows whose higher digits are the ones that a rank was found under so far, and keeps the digits
    that the ranks fall on. What a task sends on is bounded by the digits, not by its rows.
    """
    columns = list(ranks)
    # Per column: what is left of each rank, and the higher digits of its value.
    sought = {(c, r): (0, r) for c in columns for r in ranks[c]}
    for shift in range(64 - DIGIT_BITS, -1, -DIGIT_BITS):

        def digit(c: str) -> Column:
            key = order_key(F.col(c))
            low = key if shift + DIGIT_BITS == 64 else key.bitwiseAND((1 << (shift + DIGIT_BITS)) - 1)
            high = F.lit(0).cast("long") if shift + DIGIT_BITS == 64 else F.shiftright(key, shift + DIGIT_BITS)
            under = sorted({prefix for (of, _), (prefix, _) in sought.items() if of == c})
            entry = F.struct(
                F.lit(columns.index(c)).alias("c"), high.alias("prefix"), F.shiftright(low, shift).alias("digit")
            )
            return F.when(F.col(c).isNotNull() & high.isin(under), entry)

        counts = (
            df.select(F.inline(F.array_compact(F.array(*(digit(c) for c in columns)))))
            .groupBy("c", "prefix", "digit")
            .agg(F.count(F.lit(1)).alias("n"))
        )
        upto = F.sum("n").over(Window.partitionBy("c", "prefix").orderBy("digit"))
        # What is left of the ranks goes along as literals: a broadcast takes 32 MB for a single row.
        def rests(c: str) -> Column:
            known = [(F.lit(prefix), F.lit(r), F.lit(rest)) for (of, r), (prefix, rest) in sought.items() if of == c]
            names = ("under", "rank", "rest")
            return F.array(*(F.struct(*(x.cast("long").alias(n) for x, n in zip(row, names, strict=True))) for row in known))

        left = F.array(*(rests(c) for c in columns))
        hits = (
            counts.withColumn("upto", upto)
            .select("c", "prefix", "digit", "n", "upto", F.inline(left[F.col("c")]))
            .filter((F.col("under") == F.col("prefix")) & (F.col("rest") < F.col("upto")) & (F.col("rest") >= F.col("upto") - F.col("n")))
            .select("c", "rank", "prefix", "digit", (F.col("rest") - F.col("upto") + F.col("n")).alias("rest"))
        )
        sought = {
            (columns[h.c], h.rank): ((h.prefix << DIGIT_BITS) + h.digit, h.rest) for h in hits.collect()
        }
    found: dict[str, dict[int, float]] = {c: {} for c in columns}
    for (c, r), (key, _) in sought.items():
        found[c][r] = key_value(key)
    return found


def medians(
    df: DataFrame, counts: dict[str, int], direct_rows: int = DIRECT_ROWS
) -> dict[str, float | None]:
    """Exact interpolated medians of columns with known non-null counts."""
    found: dict[str, float | None] = {}
    for batch in _batches({c: n for c, n in counts.items() if n <= direct_rows}):
        row = df.agg(*(F.percentile(F.col(c).cast("double"), 0.5) for c in batch)).first()
        found.update(zip(batch, row))
    large = {c: n for c, n in counts.items() if n > direct_rows}
    if large:
        doubles = nan_to_null(df.select(*(F.col(c).cast("double").alias(c) for c in large)))
        ranks = {c: {(n - 1) // 2, n // 2} for c, n in large.items()}
        for c, values in values_at(doubles, ranks).items():
            found[c] = sum(values[r] for r in ((large[c] - 1) // 2, large[c] // 2)) / 2
    return found


def _batches(counts: dict[str, int]) -> list[list[str]]:
    """Columns in groups of at most DIRECT_TOTAL values."""
    groups: list[list[str]] = []
    room = 0
    for column, n in counts.items():
        if not groups or n > room:
            groups.append([])
            room = DIRECT_TOTAL
        groups[-1].append(column)
        room -= n
    return groups


def modes(counts: DataFrame) -> DataFrame:
    """(column_name, mode) from value counts; ties go to the smallest value."""
    return (
        counts.filter(F.col("value").isNotNull())
        .groupBy("column_name")
        .agg(F.min(F.struct((-F.col("n")).alias("n"), F.col("value").alias("value"))).alias("best"))
        .select("column_name", F.col("best.value").alias("mode"))
    )


def missing_counts(df: DataFrame) -> tuple[int, dict[str, int]]:
    """Row count and nulls per column, one scan."""
    row = df.agg(F.count(F.lit(1)), *(F.count_if(F.col(c).isNull()) for c in df.columns)).first()
    return row[0], dict(zip(df.columns, row[1:]))


@dataclass(frozen=True)
class Fills:
    """One fitted value per column that has nulls."""

    numbers: dict[str, float | None]
    categories: dict[str, str]

    def expression(self, field: T.StructField) -> Column:
        """The column with its nulls filled; medians of integers stay fractional."""
        column = F.col(field.name)
        if isinstance(field.dataType, T.BooleanType):
            column = column.cast("int")
        if self.numbers.get(field.name) is not None:
            return F.coalesce(column.cast("double"), F.lit(self.numbers[field.name])).alias(
                field.name
            )
        if field.name in self.categories:
            return F.coalesce(column.cast("string"), F.lit(self.categories[field.name])).alias(
                field.name
            )
        return column.alias(field.name)

    def apply(self, df: DataFrame) -> DataFrame:
        return df.select(*(self.expression(f) for f in df.schema))


def fit_fills(
    df: DataFrame,
    columns: list[str] | None = None,
    counts: DataFrame | None = None,
    missing: tuple[int, dict[str, int]] | None = None,
) -> Fills:
    """Fit fills for the columns that have nulls.

    `counts` and `missing` are value and null counts of `df` already at hand.
    """
    columns = columns or df.columns
    rows, nulls = missing_counts(df.select(*columns)) if missing is None else missing
    gaps = [c for c in columns if nulls[c]]
    numbers = {c: rows - nulls[c] for c in numeric_columns(df, gaps)}
    categories = categorical_columns(df, gaps)
    fills: dict[str, str] = {}
    if categories:
        known = value_counts(df, categories) if counts is None else counts
        found = modes(known.filter(F.col("column_name").isin(categories))).collect()
        fills = dict.fromkeys(categories, UNKNOWN) | {r["column_name"]: r["mode"] for r in found}
    medians_found = medians(df, numbers) if numbers else {}
    return Fills(medians_found, fills)


def impute(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Fill nulls of the given columns (all by default) by median or mode."""
    return fit_fills(df, columns).apply(df)
