"""Boosted trees against a small dense build of the same rule."""

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from assay.operators import boosting
from assay.operators.boosting import BoostedTrees, BoostedTreesModel


def dense(x, y, objective, rounds, depth, rate, classes, ridge=1.0, least=1.0):
    """Margins of the training rows: every cut of every node tried by itself."""
    width = classes if objective == "softmax" else 1
    margin = np.full((len(x), width), y.mean() if objective == "squared" else 0.0)

    def step(rows, g, h, left):
        total_g, total_h = g[rows].sum(), h[rows].sum()
        best = (boosting.LEAST_GAIN, None, None)
        if left:
            for f in range(x.shape[1]):
                for c in sorted(set(x[:, f]))[1:]:
                    a = rows[x[rows, f] < c]
                    b = rows[x[rows, f] >= c]
                    if h[a].sum() < least or h[b].sum() < least:
                        continue
                    gain = g[a].sum() ** 2 / (h[a].sum() + ridge) + g[b].sum() ** 2 / (h[b].sum() + ridge)
                    gain -= total_g**2 / (total_h + ridge)
                    if gain > best[0] + 1e-9:
                        best = (gain, a, b)
        if best[1] is None:
            out[rows] = -rate * total_g / (total_h + ridge)
        else:
            step(best[1], g, h, left - 1)
            step(best[2], g, h, left - 1)

    for _ in range(rounds):
        moves = []
        if objective == "softmax":
            p = np.exp(margin) / np.exp(margin).sum(axis=1, keepdims=True)
            gs, hs = p - np.eye(classes)[y.astype(int)], 2 * p * (1 - p)
        elif objective == "logistic":
            p = 1 / (1 + np.exp(-margin))
            gs, hs = p - y[:, None], p * (1 - p)
        else:
            gs, hs = margin - y[:, None], np.ones_like(margin)
        for k in range(width):
            out = np.zeros(len(x))
            step(np.arange(len(x)), gs[:, k], hs[:, k], depth)
            moves.append(out)
        margin = margin + np.stack(moves, axis=1)
    return margin


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(8)
    # Few distinct values, so that the bins are the values; sums of odd weights, so that no two cuts tie.
    x = np.stack([rng.integers(0, 12, 90), rng.integers(0, 5, 90), rng.integers(-7, 3, 90)], axis=1).astype(float)
    score = x[:, 0] + 2.3 * x[:, 1] + rng.normal(size=90)
    return x, score


def table(spark, x, y, parts=3):
    df = spark.createDataFrame([(row.tolist(), float(v)) for row, v in zip(x, y, strict=True)], "x array<double>, label double")
    return df.repartition(parts).select(array_to_vector("x").alias("features"), "label")


@pytest.mark.parametrize("driver_sums", [boosting.DRIVER_SUMS, 0])
@pytest.mark.parametrize("objective, classes", [("squared", 2), ("logistic", 2), ("softmax", 4)])
def test_equal_to_a_dense_build(spark, rows, monkeypatch, objective, classes, driver_sums):
    monkeypatch.setattr(boosting, "DRIVER_SUMS", driver_sums)
    monkeypatch.setattr(boosting, "CHECKPOINT_ROUNDS", 2)
    x, score = rows
    y = score if objective == "squared" else np.digitize(score, np.quantile(score, np.arange(1, classes) / classes)).astype(float)
    model = BoostedTrees(objective, 4, 3, 0.3, classes).fit(table(spark, x, y))
    assert model.ensemble.margins(x) == pytest.approx(dense(x, y, objective, 4, 3, 0.3, classes), abs=1e-9)
    assert len(model.ensemble.trees) == 4
    assert sum(model.featureImportances) == pytest.approx(1.0)


def test_scores_and_reload(spark, rows, tmp_path):
    x, score = rows
    y = np.digitize(score, np.quantile(score, [0.3, 0.6])).astype(float)
    df = table(spark, x, y)
    model = BoostedTrees("softmax", 8, 3, 0.3, 3).fit(df)
    model.write().overwrite().save(str(tmp_path / "m"))
    again = BoostedTreesModel.load(str(tmp_path / "m"))
    scored = again.transform(df).collect()
    want = model.ensemble.predictions(np.array([r.features.toArray() for r in scored]))
    assert [r.prediction for r in scored] == list(want)
    # The labels are noisy; the largest class holds 40 % of them.
    assert np.mean([r.prediction == r.label for r in scored]) > 2 * 0.4


def test_odd_tables(spark):
    flat = table(spark, np.ones((20, 2)), np.arange(20) % 3)
    model = BoostedTrees("softmax", 5, 3, 0.3, 3).fit(flat)
    assert model.ensemble.trees == [] and list(model.featureImportances) == [0.0, 0.0]
    assert {r.prediction for r in model.transform(flat).collect()} == {0.0}
    with pytest.raises(ValueError, match="no training rows"):
        BoostedTrees("squared", 5, 3, 0.3).fit(flat.limit(0))
    with pytest.raises(ValueError, match="objective"):
        BoostedTrees("hinge", 5, 3, 0.3)
    assert BoostedTrees("squared", 3, 2, 0.3).fit(flat).transform(flat.limit(0)).count() == 0
    one = BoostedTrees("squared", 3, 2, 0.3).fit(flat.filter(F.col("label") == 1))
    assert {r.prediction for r in one.transform(flat).collect()} == {1.0}


def test_batches_are_joined_to_large_blocks_of_narrow_bins():
    sizes = (10_000, 10_000, 10_000, 10_000, 0, 5)
    batches = (pd.DataFrame({"x0": np.arange(n) % 4.0, "label": np.full(n, 1.0)}) for n in sizes)
    blocks = pd.concat(boosting._pack([np.array([1.0, 3.0])])(batches))
    assert [len(b) for b in blocks["bins"]] == [40_000, 5]
    assert list(blocks["bins"].iloc[1]) == [0, 1, 1, 2, 0]
    assert [len(b) // 8 for b in blocks["y"]] == [40_000, 5]
