import hashlib
import math

import pytest
from pyspark.sql import functions as F

from assay.operators import encode, joins
from assay.operators.columns import value_counts
from assay.operators.split import CUT_HASHES, add_split, find_cut
from assay.operators.prepare import partition_check


def digest(key):
    return hashlib.md5(f"42:{key}".encode()).hexdigest()


@pytest.mark.parametrize("n", [1, 2, 5, 10, 11, 1000])
def test_split_is_exact_and_repeatable(spark, n):
    expected = set(sorted(range(n), key=digest)[: math.ceil(0.2 * n)])
    for parts in (1, 3, 7):
        df = spark.range(n).repartition(parts)
        got = add_split(df, "id")
        assert {r.id for r in got.filter("split = 'test'").collect()} == expected
        check = partition_check(got, "id").first()
        assert (check.train_rows, check.test_rows, check.shared) == (
            n - len(expected),
            len(expected),
            0,
        )


def test_split_of_more_rows_than_one_step_resolves(spark):
    n = 4096 * CUT_HASHES // 256
    got = add_split(spark.range(n), "id", 0.3).filter("split = 'test'")
    assert got.count() == math.ceil(0.3 * n)


def test_split_of_nothing(spark):
    assert add_split(spark.range(0), "id").columns == ["id", "split"]


@pytest.mark.parametrize("share", [0.0, 1.0, -1, 2])
def test_split_share_is_checked(spark, share):
    with pytest.raises(ValueError):
        add_split(spark.range(3), "id", share)


def test_hot_split_key_is_divided_by_the_whole_row(spark):
    df = spark.range(1000).select(F.lit("hot").alias("k"), F.col("id").alias("v"))
    got = add_split(df, "k")
    assert got.filter("split = 'test'").count() == 200
    again = add_split(df.repartition(6), "k").filter("split = 'test'")
    assert {r.v for r in again.collect()} == {r.v for r in got.filter("split = 'test'").collect()}


def test_identical_rows_are_divided_by_number(spark):
    same = spark.range(700).select(F.lit("a").alias("k"), F.lit(1.5).alias("v"))
    other = spark.range(300).select(F.col("id").cast("string").alias("k"), F.lit(2.5).alias("v"))
    df = same.unionByName(other)
    for key in (None, "k"):
        got = add_split(df, key)
        assert got.count() == 1000
        assert got.filter("split = 'test'").count() == 200
        assert got.filter("k = 'a'").count() == 700


def test_cut_counts_ties(spark):
    hashes = spark.createDataFrame([("0" * 32,)] * 5 + [("f" * 32,)] * 3, "h string")
    cut = find_cut(hashes, lambda n: n - 2)
    assert (cut.hash, cut.take, cut.ties) == ("f" * 32, 1, 3)


def test_codes_are_dense_in_sorted_order(spark):
    values = ["pear", "Apple", "fig", "Fig", "éclair", "10", "9", ""]
    df = spark.createDataFrame([(v, str(len(v))) for v in values * 3], "a string, b string")
    levels = value_counts(df, ["a", "b"]).select("column_name", "value")
    for per_task in (1_000_000, 2):
        codes = encode.level_codes(levels, levels.count(), per_task).collect()
        a = {r.value: r.code for r in codes if r.column_name == "a"}
        assert a == {v: i for i, v in enumerate(sorted(values, key=lambda v: v.encode()))}
        b = {r.value: r.code for r in codes if r.column_name == "b"}
        assert b == {v: i for i, v in enumerate(sorted({str(len(v)) for v in values}))}


def test_null_level_and_unseen(spark):
    df = spark.createDataFrame([("b",), (None,), ("z",)], "c string")
    got = encode.label_encode(df, ["c"], null_level="nan").collect()
    assert [r.c for r in got] == [0, 1, 2]
    levels = encode.fit_levels(df.filter("c = 'b'"), ["c"])
    new = encode.apply_levels(df, levels, ["c"], unseen=0)
    assert [r.c for r in new.collect()] == [0, 0, 0]


@pytest.mark.parametrize("how", ["left", "inner", "left_semi", "left_anti"])
@pytest.mark.parametrize("hot_rows", [0, 50, 10**6])
def test_large_lookup_equals_a_plain_join(spark, how, hot_rows):
    left = spark.range(900).selectExpr(
        "id AS n", "CASE WHEN id % 3 = 0 THEN 'hot' WHEN id % 50 = 1 THEN NULL "
        "ELSE CAST(id % 97 AS STRING) END AS k"
    )
    right = spark.range(60).selectExpr("CAST(id AS STRING) AS k", "id * 2 AS v").unionByName(
        spark.createDataFrame([("hot", -1)], "k string, v long")
    )
    small = joins.lookup(left, right, "k", how)
    large = joins.lookup(left, right, "k", how, broadcast_rows=1, hot_rows=hot_rows)
    columns = ["n", "k"] if how in ("left_semi", "left_anti") else ["n", "k", "v"]
    assert sorted(map(str, small.select(*columns).collect())) == sorted(
        map(str, large.select(*columns).collect())
    )
    assert sorted(map(str, left.join(right, "k", how).select(*columns).collect())) == sorted(
        map(str, large.select(*columns).collect())
    )


def test_large_lookup_is_not_broadcast_by_file_size(spark):
    left = spark.range(900).selectExpr("id AS n", "id % 97 AS k")
    found = joins.lookup(left, spark.range(60).selectExpr("id AS k", "id * 2 AS v"), "k", "inner", broadcast_rows=1)
    assert len(found.collect()) == sum(n % 97 < 60 for n in range(900))
    assert "SortMergeJoin" in found._jdf.queryExecution().executedPlan().toString()


def test_lookup_kind_is_checked(spark):
    with pytest.raises(ValueError):
        joins.lookup(spark.range(1), spark.range(1), "id", "full")


def test_many_large_columns_share_one_dictionary_join(spark):
    rows = [(i, "hot" if i % 3 else f"v{i}", None if i % 5 == 0 else f"w{i % 90}", f"s{i % 4}") for i in range(400)]
    df = spark.createDataFrame(rows + rows[:1], "k int, a string, b string, c string").repartition(6)
    levels = encode.fit_levels(df, ["a", "b", "c"])
    plain = sorted(encode.apply_levels(df, levels, ["a", "b", "c"], unseen=0).collect())
    large = encode.Levels(levels.table, {"a": False, "b": False, "c": True})
    coded = encode.apply_levels(df, large, ["a", "b", "c"], unseen=0)
    assert sorted(coded.collect()) == plain and coded.columns == df.columns
    assert dict(coded.dtypes) == {"k": "int", "a": "bigint", "b": "bigint", "c": "bigint"}
    none = encode.apply_levels(df, large, ["a", "b"]).filter("b IS NULL").count()
    assert none == len([r for r in rows + rows[:1] if r[2] is None])


@pytest.mark.parametrize("small", [True, False])
def test_codes_beyond_an_int(spark, small):
    table = spark.createDataFrame([("a", "x", 2**31 + 5), ("a", "y", 2**40)], "column_name string, value string, code long")
    df = spark.createDataFrame([("x",), ("y",), ("z",), (None,)], "a string")
    got = encode.apply_levels(df, encode.Levels(table, {"a": small}), ["a"])
    assert sorted((r.a for r in got.collect()), key=str) == sorted([2**31 + 5, 2**40, None, None], key=str)
