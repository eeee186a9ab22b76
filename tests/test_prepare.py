import datetime

import pytest
from pyspark.sql import functions as F

from assay.operators import impute
from assay.operators.columns import text_column, value_counts
from assay.operators.prepare import prepare, quality


def test_profile_of_the_raw_table(plots):
    ready = prepare(plots, "harvest", "regression", ["depth_m", "soil"], key="plot_id")
    rows = {r.column_name: r for r in ready.columns_profile().collect()}
    assert rows["depth_m"].null_pct == pytest.approx(1 / 3)
    assert rows["soil"].null_pct == pytest.approx(1 / 6)
    assert rows["soil"].unique_count == 3
    assert rows["depth_m"].dtype == "double"
    moments = {r.name: r.value for r in ready.target_distribution().collect()}
    assert moments["mean"] == 13 and moments["min"] == 3 and moments["max"] == 23
    assert moments["std"] == pytest.approx(7.48331477)
    summary = ready.dataset_profile().first()
    assert summary.num_rows == 6
    assert summary.warnings == ["Small dataset: only 6 rows. Results may not be reliable."]


def test_fills_and_codes(plots):
    ready = prepare(plots, "harvest", "regression", ["depth_m", "soil"], key="plot_id")
    rows = ready.frame.orderBy("plot_id").collect()
    assert [r.depth_m for r in rows] == [5.5, 2.5, 8.5, 5.5, 4.5, 6.5]
    # clay and sand are tied, the smaller fills; clay = 0, loam = 1, sand = 2.
    assert [r.soil for r in rows] == [0, 2, 0, 2, 0, 1]
    assert all(
        r.is_numeric and r.nulls == 0
        for r in quality(ready.frame, [*ready.features, ready.target]).collect()
    )


def test_split_sizes_and_features(gauges):
    ready = prepare(gauges, "level", "regression", ["rain_mm"], key="site_id")
    assert ready.train.count() == 8 and ready.test.count() == 2
    assert ready.train.columns == ["site_id", "rain_mm", "level"]
    x, y = ready.xy("train")
    assert x.columns == ["site_id", "rain_mm"] and y.columns == ["site_id", "level"]
    assert x.count() == y.count() == 8


def test_missing_columns_are_named(gauges):
    with pytest.raises(ValueError, match="target column 'nope' not found.*wind"):
        prepare(gauges, "nope", "regression")
    with pytest.raises(ValueError, match=r"Feature columns not found: \['nope'\]"):
        prepare(gauges, "level", "regression", ["nope"])


def test_text_target_of_a_regression_is_refused(plots):
    with pytest.raises(ValueError, match="numeric"):
        prepare(plots, "soil", "regression")


def test_booleans_dates_and_empty_columns(spark):
    day = datetime.datetime
    rows = [
        (1, True, day(2024, 3, 1), None, None, float("nan"), "a"),
        (2, False, day(2023, 1, 1), None, None, 2.0, "b"),
        (3, None, day(2025, 1, 1), None, None, 4.0, "a"),
    ]
    df = spark.createDataFrame(
        rows, "k int, flag boolean, at timestamp, empty double, blank string, x double, y string"
    )
    ready = prepare(df, "y", "binary_classification", key="k")
    got = ready.frame.orderBy("k").collect()
    assert "empty" not in ready.frame.columns
    assert ready.warnings == ["Column 'empty' has no values and was dropped."]
    assert [r["at"] for r in got] == [1, 0, 2]
    assert [r["x"] for r in got] == [3.0, 2.0, 4.0]
    assert [r["flag"] for r in got] == [1.0, 0.0, 0.5]
    assert [r["blank"] for r in got] == [0, 0, 0]
    assert [r["y"] for r in got] == [0, 1, 0]


def test_imputed_targets_are_reported(plots):
    df = plots.withColumn("harvest", F.when(F.col("plot_id") != 0, F.col("harvest")))
    ready = prepare(df, "harvest", "regression", key="plot_id")
    assert ready.warnings == ["1 missing target values were imputed."]
    assert ready.frame.filter("plot_id = 0").first().harvest == 15.0


def test_fit_on_train_only(spark):
    rows = [(i, float(i), f"v{i:03d}") for i in range(50)]
    df = spark.createDataFrame(rows, "k int, y double, c string")
    ready = prepare(df, "y", "regression", key="k", fit_on="train")
    assert sorted(r.c for r in ready.train.collect()) == list(range(40))
    # No test value was seen in training.
    assert {r.c for r in ready.test.collect()} == {0}


def test_roundtrip_by_split(spark, tmp_path, gauges):
    ready = prepare(gauges, "level", "regression", key="site_id")
    for fmt in ("parquet", "csv"):
        path = str(tmp_path / fmt)
        ready.write(path, fmt)
        back = spark.read.option("header", True).format(fmt).load(path)
        assert back.filter("split = 'test'").count() == 2
        assert back.count() == 10


def test_order_keys_follow_the_doubles(spark):
    import random
    import struct
    import sys

    random.seed(2)
    inf = float("inf")
    values = [0.0, -0.0, 5e-324, -5e-324, 2.2250738585072014e-308, 2.225073858507201e-308, 1.0, -1.0, inf, -inf]
    values += [sys.float_info.max, -sys.float_info.max, 0.1, 1 - 2**-53, 1 + 2**-52, 2.0**1023, 2.0**-1022]
    values += [2.0**e * f for e in range(-1070, 1024, 41) for f in (1.0, -1.0)]
    values += [v for v in (struct.unpack("d", random.randbytes(8))[0] for _ in range(3000)) if v == v]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    keys = [r.k for r in df.select(impute.order_key(F.col("x") + 0.0).alias("k")).collect()]
    assert [impute.key_value(k) for k in keys] == values
    assert [v for _, v in sorted(zip(keys, values))] == sorted(values)


def test_medians_of_many_long_columns(spark):
    import random
    import statistics

    random.seed(9)
    rows = [[random.gauss(0, 10.0**j) if random.random() < 0.9 else None for j in range(6)] + [i % 3, None] for i in range(999)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double, e double, f double, g int, h double")
    counts = {c: sum(r[j] is not None for r in rows) for j, c in enumerate("abcdefgh")}
    found = impute.medians(df.repartition(7), counts, direct_rows=0)
    for j, c in enumerate("abcdefg"):
        assert found[c] == statistics.median(r[j] for r in rows if r[j] is not None), c
    assert found["h"] is None


def test_exact_median_of_long_columns(spark):
    import random
    import statistics

    random.seed(7)
    cases = {
        "even": [float(i) for i in range(1, 5)],
        "odd": [3.0, 1.0, 2.0],
        "wide": [random.gauss(0, 1e6) for _ in range(5001)],
        "hot": [5.0] * 3000 + [random.random() * 10 for _ in range(4000)],
        "two": [1.0] * 2500 + [2.0] * 2500,
        "edge": [1.0] * 2499 + [2.0] * 2501,
        "outlier": [1e300, -1e300] + [float(i % 7) for i in range(2000)],
    }
    for name, values in cases.items():
        df = spark.createDataFrame([(v,) for v in values] + [(None,)], "x double").repartition(5)
        for limit in (10**6, 50):
            found = impute.medians(df, {"x": len(values)}, direct_rows=limit)["x"]
            assert found == statistics.median(values), (name, limit)


def test_medians_of_many_columns_are_batched():
    counts = {"a": 3_000_000, "b": 2_000_000, "c": 1_000_000, "d": 5_000_000, "e": 0}
    assert impute._batches(counts) == [["a"], ["b", "c"], ["d"], ["e"]]
    assert impute._batches({}) == []


def test_profile_record(spark):
    from assay.operators import profile

    rows = [(i // 2, float(i) if i % 3 else float("nan"), f"t{i % 7}", "late" if i in (300, 350) else None) for i in range(400)]
    df = spark.createDataFrame(rows, "k int, x double, t string, r string").repartition(6)
    ready = prepare(df, "t", "multiclass_classification", ["x"], key="k")
    got = ready.profile().first()
    assert (got.num_rows, got.num_columns, got.target_column, got.warnings) == (400, 4, "t", [])
    assert got.columns["x"].null_pct == pytest.approx(134 / 400)
    assert abs(got.columns["x"].unique_count - 266) < 30
    assert got.columns["x"].sample_values == ["1.0", "2.0", "4.0", "5.0", "7.0"]
    assert got.columns["r"].sample_values == ["late", "late"] and got.columns["r"].dtype == "string"
    assert got.target_distribution == {f"t{j}": float(len([r for r in rows if r[2] == f"t{j}"])) for j in range(7)}
    assert ready.profile(exact=True).first().columns["x"].unique_count == 266
    number = profile.profile_record(df, "x", "regression", "k").first()
    assert number.target_distribution["min"] == 1.0 and number.target_distribution["max"] == 398.0
    few = profile.profile_record(df.limit(3), "t", "binary_classification", "k").first()
    assert few.warnings == ["Small dataset: only 3 rows. Results may not be reliable."]
    none = profile.profile_record(df.limit(0), "x", "regression", "k").first()
    assert none.num_rows == 0 and none.columns["k"].null_pct is None and none.columns["k"].sample_values == []
    many = spark.range(1500).selectExpr("id AS k", "CAST(id AS STRING) AS c")
    wide = profile.profile_record(many, "c", "multiclass_classification", "k").first()
    assert len(wide.target_distribution) == 1000 and "1500 classes" in wide.warnings[0]
    with pytest.raises(ValueError, match="numeric"):
        profile.profile_record(df, "t", "regression", "k")


def test_the_source_is_read_once(spark, tmp_path):
    """What prepare reads again is what it wrote, so a source that changes can't tear it apart."""
    rows = spark.createDataFrame([(i, float(i), "ab"[i % 2], None) for i in range(50)], "k int, x double, c string, e void")
    rows.drop("e").write.parquet(str(tmp_path / "t"))
    source = spark.read.parquet(str(tmp_path / "t"))
    ready = prepare(source, "x", "regression", ["c"], key="k")
    spark.createDataFrame([(1, 1.0, "z")], "k int, x double, c string").write.mode("overwrite").parquet(str(tmp_path / "t"))
    assert ready.frame.count() == 50
    assert prepare(rows, "x", "regression", key="k").frame.count() == 50


def test_mode_ties_and_nulls(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("a",), (None,), (None,), (None,)], "c string")
    found = impute.modes(value_counts(df, ["c"])).collect()
    assert [(r.column_name, r.mode) for r in found] == [("c", "a")]


def test_text_column(spark):
    df = spark.createDataFrame([(1, "a", "b")], "n int, label string, body string")
    assert text_column(df, "label") == "body"
    assert text_column(df, "label", "body") == "body"
    with pytest.raises(ValueError, match="No text column"):
        text_column(df.select("n", "label"), "label")
