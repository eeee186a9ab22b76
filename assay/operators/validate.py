"""Checks of record tables: every rule that a row breaks, listed.

Rules come from a record's schema, from its closed lists and from what it requires: a value that
can't be read as its field's type, a required field without a value, a member outside a closed list,
a number outside its range. A row is checked in place, without a shuffle.
"""

from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assay import schemas


@dataclass(frozen=True)
class Record:
    """What a sound row of a record type looks like."""

    schema: T.StructType
    required: tuple[str, ...]
    closed: dict[str, list[str]] = field(default_factory=dict)
    #: Least and greatest value of numeric fields.
    ranges: dict[str, tuple[float, float]] = field(default_factory=dict)
    #: Fields that hold a record of another kind.
    nested: dict[str, str] = field(default_factory=dict)


# Required fields and closed lists by record.
RECORDS = {
    "candidate": Record(
        schemas.CANDIDATE,
        ("id", "name", "source", "description", "url"),
        {"source": schemas.CANDIDATE_SOURCES},
    ),
    "plan": Record(
        schemas.PLAN,
        ("question", "hypothesis", "target_variable", "task_type", "dataset_query"),
        {
            "task_type": schemas.TASK_TYPES,
            "model_type": schemas.MODEL_TYPES,
            "compute": schemas.COMPUTE_CHOICES,
        },
    ),
    "run": Record(
        schemas.RUN,
        ("id", "plan"),
        {"status": schemas.RUN_STATUSES, "compute_backend": schemas.BACKENDS},
        nested={"plan": "plan", "answer": "answer"},
    ),
    "answer": Record(
        schemas.ANSWER,
        ("question", "hypothesis", "verdict", "confidence", "evidence_summary", "key_metrics"),
        {"verdict": schemas.VERDICTS},
        {"confidence": (0.0, 1.0)},
    ),
}
MISSING = "%s is missing"
NOT_TYPED = "%s is not of type %s: "
NOT_LISTED = "%s is not one of the allowed values: "
OUT_OF_RANGE = "%s is not from %s to %s: "
#: Characters of a bad value that a reason shows.
SHOWN = 100


def _shown(text: str, value: Column) -> Column:
    return F.concat(F.lit(text), F.substring(value.cast("string"), 1, SHOWN))


def _rules(kind: str, types: dict[str, T.DataType], get, path: str = "") -> Iterable[tuple[Column, Column]]:
    """(broken, reason) of every rule that the fields at hand can break."""
    record = RECORDS[kind]
    for name in record.required:
        if name in types:
            yield get(name).isNull(), F.lit(MISSING % (path + name))
    for f in record.schema:
        own = types.get(f.name)
        # A table may keep numbers and times as text; what can't be read is a broken row, not an error.
        if isinstance(own, T.StringType) and not isinstance(f.dataType, T.StringType) and isinstance(f.dataType, T.AtomicType):
            value = get(f.name)
            unread = value.isNotNull() & value.try_cast(f.dataType).isNull()
            yield unread, _shown(NOT_TYPED % (path + f.name, f.dataType.simpleString()), value)
    for name, allowed in record.closed.items():
        if name in types:
            value = get(name)
            yield value.isNotNull() & ~value.isin(allowed), _shown(NOT_LISTED % (path + name), value)
    for name, (low, high) in record.ranges.items():
        if name in types:
            value = get(name).try_cast("double")
            broken = value.isNotNull() & ~value.between(low, high)
            yield broken, _shown(OUT_OF_RANGE % (path + name, low, high), value)
    for name, inner in record.nested.items():
        if isinstance(types.get(name), T.StructType):
            own = {f.name: f.dataType for f in types[name]}
            whole = get(name)
            for broken, reason in _rules(inner, own, lambda n, of=whole: of[n], f"{path}{name}."):
                # A missing record is one fault, not one for each of its fields.
                yield whole.isNotNull() & broken, reason


def reasons(df: DataFrame, kind: str) -> Column:
    """array<string> of the rules that a row breaks, in the order of the rules; empty when sound."""
    if kind not in RECORDS:
        raise ValueError(f"unknown record {kind!r}; known: {sorted(RECORDS)}")
    types = {f.name: f.dataType for f in df.schema}
    absent = [MISSING % n for n in RECORDS[kind].required if n not in types]
    found = [F.lit(a) for a in absent]
    found += [F.when(F.coalesce(b, F.lit(False)), r) for b, r in _rules(kind, types, lambda n: F.col(f"`{n}`"))]
    return F.array_compact(F.array(*found))


def validate(df: DataFrame, kind: str) -> tuple[DataFrame, DataFrame]:
    """(sound rows as they are, the others with `reasons`), for tables of candidates, plans, runs or
    answers. Fields that a table doesn't have are only missed where they are required."""
    checked = df.withColumn("reasons", reasons(df, kind))
    sound = F.size("reasons") == 0
    return checked.filter(sound).drop("reasons"), checked.filter(~sound)
