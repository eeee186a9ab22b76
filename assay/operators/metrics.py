"""Hold-out metrics of predictions."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def clf_metrics(
    df: DataFrame, label: str = "label", prediction: str = "prediction", by: list[str] | None = None
) -> DataFrame:
    """accuracy, support-weighted f1 and n_classes (distinct labels), one row per group.

    All three come from the confusion counts, so rows are shuffled once, pre-counted.
    """
    by = by or []
    confusion = df.groupBy(
        *by, F.col(label).alias("_label"), F.col(prediction).alias("_prediction")
    ).agg(F.count(F.lit(1)).alias("n"))
    hits = F.when(F.col("_label") == F.col("_prediction"), F.col("n")).otherwise(0)
    none = F.lit(0).cast("long")
    sides = F.array(
        F.struct(F.col("_label").alias("cls"), F.col("n").alias("support"), none.alias("predicted"),
                 hits.alias("hits")),
        F.struct(F.col("_prediction").alias("cls"), none.alias("support"),
                 F.col("n").alias("predicted"), none.alias("hits")),
    )
    classes = (
        confusion.select(*by, F.inline(sides))
        .groupBy(*by, "cls")
        .agg(
            F.sum("support").alias("support"),
            F.sum("predicted").alias("predicted"),
            F.sum("hits").alias("hits"),
        )
    )
    f1 = 2.0 * F.col("hits") / (F.col("support") + F.col("predicted"))
    return classes.groupBy(*by).agg(
        F.try_divide(F.sum("hits").cast("double"), F.sum("support")).alias("accuracy"),
        F.try_divide(F.sum(f1 * F.col("support")), F.sum("support")).alias("f1"),
        F.count_if(F.col("support") > 0).cast("int").alias("n_classes"),
    )


def reg_metrics(
    df: DataFrame, label: str = "label", prediction: str = "prediction", by: list[str] | None = None
) -> DataFrame:
    """rmse and r2, one row per group; r2 of a constant label is NaN."""
    y, p = F.col(label).cast("double"), F.col(prediction).cast("double")
    sums = df.groupBy(*(by or [])).agg(
        F.avg((y - p) * (y - p)).alias("mse"), F.var_pop(y).alias("var")
    )
    return sums.select(
        *(by or []),
        F.sqrt("mse").alias("rmse"),
        F.when(F.col("var") > 0, 1.0 - F.col("mse") / F.col("var"))
        .when(F.col("var") == 0, float("nan"))
        .alias("r2"),
    )
