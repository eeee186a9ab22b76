"""Markdown report of one answered experiment per row."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from assay.functions.numbers import fixed
from assay.functions.verdict import percent

# Headings and marks of the report.
MARKS = {"confirmed": "✅", "rejected": "❌", "inconclusive": "⚠️"}
TOP_FEATURES = 5
TITLE = "# Experiment Report"
NO_LIMITATIONS = "None identified."
FEATURE_HEADING = "## Feature Importance (top 5)"
TRACKER_HEADING = "## W&B Run"


def _lines(items: Column, render) -> Column:
    return F.array_join(F.transform(items, render), "\n")


def markdown(
    question: Column,
    verdict: Column,
    confidence: Column,
    evidence: Column,
    key_metrics: Column,
    importance: Column,
    limitations: Column,
    tracker_url: Column,
) -> Column:
    """Assemble the report; `importance` is sorted, heaviest first."""
    mark = F.lit("?")
    for name, sign in MARKS.items():
        mark = F.when(verdict == name, sign).otherwise(mark)
    features = F.when(
        F.size(importance) > 0,
        F.concat_ws(
            "\n",
            F.lit(FEATURE_HEADING),
            _lines(
                F.slice(importance, 1, TOP_FEATURES),
                lambda e: F.format_string("- `%s`: %s", e["feature"], fixed(e["importance"], 4)),
            ),
        ),
    ).otherwise("")
    tracker = F.when(
        F.length(tracker_url) > 0, F.concat_ws("\n", F.lit(TRACKER_HEADING), tracker_url)
    ).otherwise("")
    caveats = F.when(
        F.size(limitations) > 0, _lines(limitations, lambda s: F.concat(F.lit("- "), s))
    ).otherwise(NO_LIMITATIONS)
    sections = [
        F.lit(TITLE),
        F.concat_ws("\n", F.lit("## Question"), question),
        F.concat_ws(
            "\n",
            F.format_string("## Verdict: %s %s", mark, F.upper(verdict)),
            F.format_string("*Confidence: %s*", percent(confidence)),
        ),
        F.concat_ws("\n", F.lit("## Summary"), evidence),
        F.concat_ws(
            "\n",
            F.lit("## Key Metrics"),
            _lines(
                key_metrics,
                lambda e: F.format_string("- **%s**: %s", e["name"], fixed(e["value"], 4)),
            ),
        ),
        features,
        F.concat_ws("\n", F.lit("## Limitations"), caveats),
        tracker,
    ]
    return F.concat(F.concat_ws("\n\n", *sections), F.lit("\n"))
