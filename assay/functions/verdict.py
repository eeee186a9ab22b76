"""Verdict, confidence, limitations and evidence as column expressions.

A metric that is absent is null and takes its default; one that is undefined
(R2 of a constant target) is NaN and never confirms or rejects anything.
"""

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from assay.functions.numbers import fixed, half_even
from assay.schemas import CLASS_TASKS, REGRESSION_TASKS

# Verdict bands.
R2_CONFIRMED = 0.40
R2_INCONCLUSIVE = 0.10
LIFT_CONFIRMED = 0.15
LIFT_INCONCLUSIVE = 0.05

# Sentences of an answer.
LOW_R2 = (
    "Model explains only %s%% of variance (R²=%s). "
    "Other factors not captured in the dataset may be important."
)
NEAR_BASELINE = (
    "Model accuracy (%s%%) is close to the baseline (%s%%). "
    "The features may have limited predictive power."
)
NO_METRICS = "No metrics were produced — training may have failed silently."
REGRESSION_EVIDENCE = (
    "The model explains %s%% of the variance in the target (R²=%s), "
    "suggesting the hypothesis is %s with %s confidence. "
    "'%s' is among the features considered."
)
CLASS_EVIDENCE = (
    "The classifier achieved %s%% accuracy, indicating the hypothesis is %s with %s confidence."
)
UNDEFINED_R2 = "R² is undefined because the hold-out target does not vary."


@dataclass(frozen=True)
class Metrics:
    """The columns an evaluation reads."""

    r2: Column
    rmse: Column
    accuracy: Column
    f1: Column
    n_classes: Column
    importance: Column

    @classmethod
    def of(cls, prefix: str = "") -> "Metrics":
        return cls(
            *(
                F.col(prefix + name)
                for name in ("r2", "rmse", "accuracy", "f1", "n_classes", "feature_importance")
            )
        )

    def empty(self) -> Column:
        """True when the metrics record holds nothing."""
        return F.coalesce(
            self.r2.isNull()
            & self.rmse.isNull()
            & self.accuracy.isNull()
            & self.f1.isNull()
            & self.n_classes.isNull()
            & self.importance.isNull(),
            F.lit(True),
        )


def baseline(n_classes: Column) -> Column:
    """Accuracy of guessing among the classes."""
    return F.lit(1.0) / F.greatest(F.coalesce(n_classes, F.lit(2)), F.lit(2)).cast("double")


def regression_verdict(r2: Column) -> Column:
    return (
        F.when(F.isnan(r2), "inconclusive")
        .when(r2 >= R2_CONFIRMED, "confirmed")
        .when(r2 >= R2_INCONCLUSIVE, "inconclusive")
        .otherwise("rejected")
    )


def regression_confidence(r2: Column) -> Column:
    clamped = F.greatest(F.lit(0.0), F.least(F.lit(1.0), r2))
    return F.when(F.isnan(r2), 0.0).otherwise(half_even(F.least(F.lit(0.99), clamped + 0.1), 3))


def classification_verdict(accuracy: Column, base: Column) -> Column:
    lift = accuracy - base
    return (
        F.when(F.isnan(accuracy), "inconclusive")
        .when(lift >= LIFT_CONFIRMED, "confirmed")
        .when(lift >= LIFT_INCONCLUSIVE, "inconclusive")
        .otherwise("rejected")
    )


def classification_confidence(accuracy: Column, base: Column) -> Column:
    share = (accuracy - base) / (F.lit(1.0) - base)
    return F.when(F.isnan(accuracy), 0.0).otherwise(
        half_even(F.least(F.lit(0.99), F.greatest(F.lit(0.01), share)), 3)
    )


def percent(share: Column) -> Column:
    """Whole percent."""
    return F.concat(fixed(share * 100.0, 0), F.lit("%"))


def _by_task(task_type: Column, regression: Column, classes: Column, other: Column) -> Column:
    return (
        F.when(task_type.isin(REGRESSION_TASKS), regression)
        .when(task_type.isin(CLASS_TASKS), classes)
        .otherwise(other)
    )


def verdict(task_type: Column, m: Metrics) -> Column:
    return _by_task(
        task_type,
        regression_verdict(F.coalesce(m.r2, F.lit(0.0))),
        classification_verdict(F.coalesce(m.accuracy, F.lit(0.5)), baseline(m.n_classes)),
        F.lit("inconclusive"),
    )


def confidence(task_type: Column, m: Metrics) -> Column:
    return _by_task(
        task_type,
        regression_confidence(F.coalesce(m.r2, F.lit(0.0))),
        classification_confidence(F.coalesce(m.accuracy, F.lit(0.5)), baseline(m.n_classes)),
        F.lit(0.5),
    )


def limitations(task_type: Column, m: Metrics) -> Column:
    """The caveats that apply, in a fixed order."""
    r2 = F.coalesce(m.r2, F.lit(0.0))
    accuracy = F.coalesce(m.accuracy, F.lit(0.5))
    base = baseline(m.n_classes)
    regression = F.when(F.isnan(r2), UNDEFINED_R2).when(
        r2 < R2_CONFIRMED, F.format_string(LOW_R2, fixed(r2 * 100.0, 1), fixed(r2, 3))
    )
    classes = F.when(
        accuracy < base + LIFT_CONFIRMED,
        F.format_string(NEAR_BASELINE, fixed(accuracy * 100.0, 1), fixed(base * 100.0, 1)),
    )
    return F.array_compact(
        F.array(
            _by_task(task_type, regression, classes, F.lit(None).cast("string")),
            F.when(m.empty(), NO_METRICS),
        )
    )


def evidence(
    task_type: Column, m: Metrics, verdict_: Column, confidence_: Column, primary_feature: Column
) -> Column:
    """One sentence on what was found."""
    r2 = F.coalesce(m.r2, F.lit(0.0))
    accuracy = F.coalesce(m.accuracy, F.lit(0.0))
    return F.when(
        task_type.isin(REGRESSION_TASKS),
        F.format_string(
            REGRESSION_EVIDENCE,
            fixed(r2 * 100.0, 1),
            fixed(r2, 3),
            verdict_,
            percent(confidence_),
            F.coalesce(primary_feature, F.lit("")),
        ),
    ).otherwise(
        F.format_string(
            CLASS_EVIDENCE, fixed(accuracy * 100.0, 1), verdict_, percent(confidence_)
        )
    )


def key_metrics(task_type: Column, m: Metrics) -> Column:
    """The metrics an answer quotes, as an ordered array of (name, value)."""

    def pair(name: str, value: Column) -> Column:
        return F.struct(F.lit(name).alias("name"), value.cast("double").alias("value"))

    everything = F.filter(
        F.array(
            pair("r2", m.r2),
            pair("rmse", m.rmse),
            pair("accuracy", m.accuracy),
            pair("f1", m.f1),
            pair("n_classes", m.n_classes),
        ),
        lambda e: e["value"].isNotNull(),
    )
    return _by_task(
        task_type,
        F.array(
            pair("r2", F.coalesce(m.r2, F.lit(0.0))), pair("rmse", F.coalesce(m.rmse, F.lit(0.0)))
        ),
        F.array(
            pair("accuracy", F.coalesce(m.accuracy, F.lit(0.5))),
            pair("f1", F.coalesce(m.f1, F.lit(0.0))),
        ),
        everything,
    )


def sorted_importance(importance: Column) -> Column:
    """Feature weights as an array of (feature, importance), heaviest first."""
    negated = F.transform(
        F.map_entries(F.coalesce(importance, F.create_map().cast("map<string,double>"))),
        lambda e: F.struct((-e["value"]).alias("w"), e["key"].alias("feature")),
    )
    return F.transform(
        F.array_sort(negated),
        lambda e: F.struct(e["feature"].alias("feature"), (-e["w"]).alias("importance")),
    )
