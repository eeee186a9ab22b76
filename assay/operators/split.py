"""Exact-size train / test split that any partitioning repeats."""

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assay.functions.keys import SPLIT_SEED, split_hash

TEST_SIZE = 0.2
# Hex digits of a hash, and of one step into it.
HASH_LENGTH = 32
PREFIX_STEP = 3
# Distinct hashes read to the driver to place the cut.
CUT_HASHES = 4096
COPIES_PER_ROW = 100_000


@dataclass(frozen=True)
class Cut:
    """Boundary hash of the test set: `take` of its `ties` rows belong to it."""

    hash: str
    take: int
    ties: int


def find_cut(hashes: DataFrame, rank) -> Cut | None:
    """Boundary of the `rank(rows)` smallest rows (1-based) of the `h` column.

    Counts rows by hash prefix, steps into the prefix that holds the rank and
    lengthens it until few rows are left: one short count per step, no sort.
    The first step also counts the rows. None for an empty table.
    """
    prefix, left = "", None
    while True:
        inside = hashes.filter(F.startswith("h", F.lit(prefix))) if prefix else hashes
        width = min(len(prefix) + PREFIX_STEP, HASH_LENGTH)
        sizes = (
            inside.groupBy(F.substring("h", 1, width).alias("p"))
            .agg(F.count(F.lit(1)).alias("n"))
            .collect()
        )
        if not sizes:
            return None
        if left is None:
            left = rank(sum(n for _, n in sizes))
        prefix, left, n = _step(sizes, left)
        if width == HASH_LENGTH:
            return Cut(prefix, left, n)
        if n <= CUT_HASHES:
            break
    rows = (
        hashes.filter(F.startswith("h", F.lit(prefix)))
        .groupBy("h")
        .agg(F.count(F.lit(1)).alias("n"))
        .collect()
    )
    return Cut(*_step(rows, left))


def _step(sizes: list, rank: int) -> tuple[str, int, int]:
    """(value, rank inside it, size) of the value that holds a rank."""
    for value, n in sorted(sizes):
        if rank <= n:
            return value, rank, n
        rank -= n
    raise ValueError(f"rank is {rank} rows past the end")


def _label(is_test: Column) -> Column:
    return F.when(is_test, "test").otherwise("train")


def _repeat(df: DataFrame, times: Column) -> DataFrame:
    """Each row `times` times, in chunks so no array grows with the count."""
    chunks = F.sequence(F.lit(0), F.floor((times - 1) / COPIES_PER_ROW).cast("int"))
    whole = df.withColumn("_times", times).filter("_times > 0")
    wide = whole.withColumn("_chunk", F.explode(chunks)).repartition("_chunk")
    size = F.least(
        F.lit(COPIES_PER_ROW), F.col("_times") - F.col("_chunk").cast("long") * COPIES_PER_ROW
    ).cast("int")
    return wide.withColumn("_copy", F.explode(F.sequence(F.lit(1), size))).select(*df.columns)


def test_rows(count: int, test_size: float) -> int:
    return math.ceil(test_size * count)


def add_split(
    df: DataFrame,
    key: str | list[str] | None = None,
    test_size: float = TEST_SIZE,
    seed: int = SPLIT_SEED,
) -> DataFrame:
    """Add `split`: the rows with the smallest key hashes are the test set.

    Fitting reads only the key; applying is a comparison with one constant, no
    shuffle. Without a key the whole row is hashed. Rows that share the
    boundary hash are told apart by all their columns; identical rows are
    interchangeable and divided by number.
    """
    if not 0.0 < test_size < 1.0:
        raise ValueError(f"test_size must be between 0 and 1, got {test_size}")
    keys = [key] if isinstance(key, str) else list(key or df.columns)
    h = split_hash([F.col(k) for k in keys], seed)
    cut = find_cut(df.select(h.alias("h")), lambda rows: test_rows(rows, test_size))
    if cut is None:
        return df.withColumn("split", F.lit("train"))
    if cut.take == cut.ties:
        return df.withColumn("split", _label(h <= cut.hash))

    tied = df.filter(h == cut.hash)
    whole = split_hash([F.to_json(F.struct(*df.columns))], seed)
    inner = find_cut(tied.select(whole.alias("h")), lambda _: cut.take)
    ahead = (h < cut.hash) | ((h == cut.hash) & (whole < inner.hash))
    if inner.take == inner.ties:
        return df.withColumn("split", _label(ahead | ((h == cut.hash) & (whole == inner.hash))))

    same = (h == cut.hash) & (whole == inner.hash)
    apart = df.filter(~same).withColumn("split", _label(ahead))
    copies = df.filter(same).groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_n"))
    test = _repeat(copies.select(*df.columns), F.lit(inner.take).cast("long"))
    train = _repeat(copies.select(*df.columns), F.lit(inner.ties - inner.take).cast("long"))
    return apart.unionByName(test.withColumn("split", F.lit("test"))).unionByName(
        train.withColumn("split", F.lit("train"))
    )
