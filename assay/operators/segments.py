"""Linear experiments on every segment of a table, all in one aggregation."""

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def holdout_line(
    df: DataFrame, x: Column, y: Column, by: list[str] | None = None
) -> DataFrame:
    """Least squares of y on x on the train rows, scored on the test rows.

    The hold-out error follows from the centred moments of the two parts, so
    fit and score are one pre-aggregated pass, for any number of segments and
    however many rows the largest holds. Needs `split`.
    """
    by = by or []
    rows = df.select(
        *by, "split", x.cast("double").alias("x"), y.cast("double").alias("y")
    ).filter(F.col("x").isNotNull() & F.col("y").isNotNull())

    def part(name: str) -> list[Column]:
        px = F.when(F.col("split") == name, F.col("x"))
        py = F.when(F.col("split") == name, F.col("y"))
        return [
            F.count(px).alias(f"n_{name}"),
            F.avg(px).alias(f"mx_{name}"),
            F.avg(py).alias(f"my_{name}"),
            F.var_pop(px).alias(f"vx_{name}"),
            F.var_pop(py).alias(f"vy_{name}"),
            F.covar_pop(px, py).alias(f"c_{name}"),
        ]

    sums = rows.groupBy(*by).agg(*part("train"), *part("test"))
    fitted = sums.withColumn(
        "slope", F.when(F.col("vx_train") > 0, F.col("c_train") / F.col("vx_train"))
    ).withColumn("intercept", F.col("my_train") - F.col("slope") * F.col("mx_train"))
    bias = F.col("my_test") - F.col("intercept") - F.col("slope") * F.col("mx_test")
    spread = (
        F.col("vy_test")
        - 2.0 * F.col("slope") * F.col("c_test")
        + F.col("slope") * F.col("slope") * F.col("vx_test")
    )
    mse = F.greatest(bias * bias + spread, F.lit(0.0))
    return fitted.withColumn("mse", mse).select(
        *by,
        "n_train",
        "n_test",
        "slope",
        "intercept",
        F.sqrt("mse").alias("rmse"),
        F.when(F.col("vy_test") > 0, 1.0 - F.col("mse") / F.col("vy_test"))
        .when(F.col("vy_test") == 0, float("nan"))
        .alias("r2"),
    )


def holdout_linear(
    df: DataFrame, features: list[str], target: str, by: list[str] | None = None
) -> DataFrame:
    """Least squares of the target on several features in each segment, scored on its test rows.

    One aggregate holds the centred second moments of features and target for the train and the test
    rows of every segment; coefficients solve the normal equations of the first, and the hold-out
    error follows from the second, so no row is read again and the largest segment is pre-aggregated
    like any other. Rows with a null in a feature or the target are left out. Features that others
    determine in a segment share their weight (the solution of least norm). A segment without train
    rows has no line, one without test rows no score. Needs `split`.
    """
    by = by or []
    names = [*features, target]
    values = [F.col(c).cast("double").alias(f"v{i}") for i, c in enumerate(names)]
    rows = df.select(*(F.col(b) for b in by), "split", *values).dropna(subset=[f"v{i}" for i in range(len(names))])

    def part(name: str) -> list[Column]:
        own = [F.when(F.col("split") == name, F.col(f"v{i}")) for i in range(len(names))]
        pairs = [F.covar_pop(own[i], own[j]) for i in range(len(names)) for j in range(i + 1)]
        return [
            F.count(own[0]).alias(f"n_{name}"),
            F.array(*(F.avg(v) for v in own)).alias(f"mean_{name}"),
            F.array(*pairs).alias(f"moments_{name}"),
        ]

    sums = rows.groupBy(*by).agg(*part("train"), *part("test"))
    kept = [*by, "n_train", "n_test"]
    schema = T.StructType([sums.schema[c] for c in kept])
    schema = schema.add("coefficients", T.ArrayType(T.DoubleType())).add("intercept", "double").add("rmse", "double").add("var", "double")
    # Pandas has one missing value, so an undefined score is made here, not there.
    score = F.when(F.col("var") > 0, 1.0 - F.col("rmse") * F.col("rmse") / F.col("var")).when(F.col("var") == 0, float("nan"))
    return sums.mapInPandas(_solve(kept, len(features)), schema).withColumn("r2", score).drop("var")


def _solve(kept: list[str], width: int):
    at = np.tril_indices(width + 1)

    def moments(packed: np.ndarray) -> np.ndarray:
        whole = np.zeros((width + 1, width + 1))
        whole[at] = packed
        return whole + np.tril(whole, -1).T

    def line(row) -> tuple:
        if not row.n_train:
            return None, None, None, None
        fit, mean = moments(row.moments_train), np.array(row.mean_train)
        # Features of one scale, or the smallest would look like nothing beside the largest.
        scale = np.sqrt(np.where(np.diag(fit)[:-1] > 0, np.diag(fit)[:-1], 1.0))
        gram = fit[:-1, :-1] / np.outer(scale, scale)
        weights = np.linalg.lstsq(gram, fit[:-1, -1] / scale, rcond=1e-12)[0] / scale
        intercept = float(mean[-1] - weights @ mean[:-1])
        if not row.n_test:
            return weights.tolist(), intercept, None, None
        held, mean = moments(row.moments_test), np.array(row.mean_test)
        bias = mean[-1] - intercept - weights @ mean[:-1]
        spread = held[-1, -1] - 2 * weights @ held[:-1, -1] + weights @ held[:-1, :-1] @ weights
        mse = max(0.0, float(bias**2 + spread))
        return weights.tolist(), intercept, mse**0.5, float(held[-1, -1])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            found = [line(row) for row in x.itertuples(index=False)]
            out = x[kept].copy()
            for i, name in enumerate(("coefficients", "intercept", "rmse", "var")):
                out[name] = pd.Series([f[i] for f in found], index=out.index, dtype=object)
            yield out

    return run
