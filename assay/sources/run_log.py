"""A run log that stays short: appended changes, merged into snapshots step by step.

A folder holds three things:

- `changes/`: a file or more per append, reduced to one cell per run and field;
- `snapshots/<name>/`: cells merged out of changes and older snapshots;
- `pointers/name=<name>/`: one row per finished snapshot with what went into it.

A pointer is written last and makes its snapshot count. A snapshot that is no parent of another one
is a head; the state of the log is what all heads and all changes that no pointer covers say
together. Merging keeps the greatest entry of a cell, so whatever is merged twice (a batch repeated
by a stream, two compactions at a time, a compaction that died between its steps) changes nothing,
and no order of steps loses an event.

`compact` merges the new changes with those heads that aren't much larger, as they come by size.
A cell is thus rewritten a logarithmic number of times, and few heads remain.
"""

import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assay.operators.runs import status_code, status_name
from assay.schemas import RUN_EVENT

CELL = T.StructType(
    [
        T.StructField("run_id", T.StringType()),
        T.StructField("field", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("seq", T.LongType()),
        T.StructField("code", T.IntegerType()),
        T.StructField("text", T.StringType()),
        T.StructField("value", T.DoubleType()),
    ]
)
POINTER = T.StructType(
    [
        T.StructField("parents", T.ArrayType(T.StringType())),
        T.StructField("covered", T.ArrayType(T.StringType())),
        T.StructField("cells", T.LongType()),
    ]
)
ENTRY = ["seq", "code", "text", "value"]
#: Heads up to this many times as large as what is merged already are merged with it.
TIER = 2.0


def cells_of(events: DataFrame) -> DataFrame:
    """One row per event for its status, one for an error that is set, one per metric."""
    null = F.lit(None)
    state = F.struct(
        F.lit("status").alias("field"),
        null.cast("string").alias("name"),
        status_code(F.col("status")).alias("code"),
        null.cast("string").alias("text"),
        null.cast("double").alias("value"),
    )
    error = F.struct(
        F.lit("error").alias("field"),
        null.cast("string").alias("name"),
        null.cast("int").alias("code"),
        F.col("error").alias("text"),
        null.cast("double").alias("value"),
    )
    metrics = F.transform(
        F.map_entries(F.coalesce("metrics", F.create_map().cast("map<string,double>"))),
        lambda m: F.struct(
            F.lit("metric").alias("field"),
            m["key"].alias("name"),
            null.cast("int").alias("code"),
            null.cast("string").alias("text"),
            m["value"].alias("value"),
        ),
    )
    errors = F.when(F.col("error").isNotNull(), F.array(error)).otherwise(F.array().cast(T.ArrayType(
        T.StructType([CELL[n] for n in ("field", "name", "code", "text", "value")])
    )))
    rows = events.select("run_id", "seq", F.explode(F.concat(F.array(state), errors, metrics)).alias("c"))
    return rows.select("run_id", "c.field", "c.name", "seq", "c.code", "c.text", "c.value")


def merge_cells(cells: DataFrame) -> DataFrame:
    """The greatest entry per run and field: highest seq, ties to the greater content."""
    last = cells.groupBy("run_id", "field", "name").agg(F.max(F.struct(*ENTRY)).alias("e"))
    return last.select("run_id", "field", "name", *(f"e.{n}" for n in ENTRY))


def latest_of(cells: DataFrame) -> DataFrame:
    """(run_id, status, error, seq) of merged cells."""

    def of(field: str, column: str):
        return F.max(F.when(F.col("field") == field, F.col(column)))

    found = cells.filter("field <> 'metric'").groupBy("run_id").agg(
        of("status", "code").alias("_code"), of("error", "text").alias("error"), of("status", "seq").alias("seq")
    )
    return found.select("run_id", status_name(F.col("_code")).alias("status"), "error", "seq")


@dataclass(frozen=True)
class Version:
    """What a pointer says."""

    name: str
    parents: tuple[str, ...]
    covered: tuple[str, ...]
    cells: int


class RunLog:
    """The log below a folder; the folder is made by the first append."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    def append(self, events: DataFrame) -> None:
        """Adds run events; a batch that is added again changes nothing."""
        cells = merge_cells(cells_of(events.select(*RUN_EVENT.fieldNames())))
        cells.write.mode("append").parquet(f"{self.root}/changes")

    def versions(self) -> list[Version]:
        """All finished snapshots that vacuum has left, one small row each."""
        if not self._exists("pointers"):
            return []
        rows = self.spark.read.schema(
            T.StructType([*POINTER.fields, T.StructField("name", T.StringType())])
        ).parquet(f"{self.root}/pointers")
        return [Version(r.name, tuple(r.parents), tuple(r.covered), r.cells) for r in rows.collect()]

    def pending(self, versions: list[Version] | None = None) -> list[str]:
        """Names of the change files that no snapshot covers."""
        covered = {f for v in self._known(versions) for f in v.covered}
        return [f for f in self._change_files() if f not in covered]

    def cells(self) -> DataFrame:
        """The merged state: heads and pending changes."""
        versions = self.versions()
        parts = [self._snapshot(v.name) for v in _heads(versions)]
        return merge_cells(self._union([*parts, self._changes(self.pending(versions))]))

    def latest(self) -> DataFrame:
        """(run_id, status, error, seq): as `operators.runs.latest_runs` over all events."""
        return latest_of(self.cells())

    def metrics(self) -> DataFrame:
        """(run_id, name, value): as `operators.runs.merged_metrics` over all events."""
        return self.cells().filter("field = 'metric'").select("run_id", "name", "value")

    def compact(self, full: bool = False) -> str | None:
        """Merges pending changes, and heads of their size, into a new snapshot; gives its name.

        `full` merges every head, so that one is left. None when there is nothing to merge.
        """
        versions = self.versions()
        files = self.pending(versions)
        heads = sorted(_heads(versions), key=lambda v: (v.cells, v.name))
        if not files and not (full and len(heads) > 1):
            return None
        size = self._changes(files).count() if files else 0
        parents = []
        for head in heads:
            if not full and head.cells > TIER * size:
                break
            parents.append(head.name)
            size += head.cells
        name = uuid.uuid4().hex
        merged = merge_cells(self._union([*map(self._snapshot, parents), self._changes(files)]))
        merged.write.parquet(f"{self.root}/snapshots/{name}")
        self._commit(name, parents, files)
        return name

    def vacuum(self) -> list[str]:
        """Removes covered change files and snapshots merged into others; gives their names.

        A reader or compaction planned before may find its files gone; it fails and is right when
        repeated. Files are named by a finished snapshot before they go, so a crash loses nothing.
        """
        versions = self.versions()
        heads = {v.name for v in _heads(versions)}
        covered = {f for v in versions for f in v.covered}
        files = [f for f in self._change_files() if f in covered]
        old = [v.name for v in versions if v.name not in heads]
        for f in files:
            self._delete(f"changes/{f}")
        for name in old:
            self._delete(f"snapshots/{name}")
        # The pointer goes last: while it is there, the next vacuum can finish a broken one.
        for name in old:
            self._delete(f"pointers/name={name}")
        return files + old

    def _commit(self, name: str, parents: list[str], covered: list[str]) -> None:
        cells = self._snapshot(name).count()
        row = self.spark.createDataFrame([(parents, covered, cells)], POINTER)
        row.coalesce(1).write.parquet(f"{self.root}/pointers/name={name}")

    def _known(self, versions: list[Version] | None) -> list[Version]:
        return self.versions() if versions is None else versions

    def _change_files(self) -> list[str]:
        if not self._exists("changes"):
            return []
        found = self.spark.read.schema(CELL).parquet(f"{self.root}/changes").inputFiles()
        return sorted(f.rsplit("/", 1)[1] for f in found)

    def _changes(self, files: list[str]) -> DataFrame:
        if not files:
            return self.spark.createDataFrame([], CELL)
        return self.spark.read.schema(CELL).parquet(*(f"{self.root}/changes/{f}" for f in files))

    def _snapshot(self, name: str) -> DataFrame:
        return self.spark.read.schema(CELL).parquet(f"{self.root}/snapshots/{name}")

    def _union(self, parts: list[DataFrame]) -> DataFrame:
        return reduce(DataFrame.unionByName, parts)

    def _path(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path, path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())

    def _exists(self, name: str) -> bool:
        path, files = self._path(name)
        return files.exists(path)

    def _delete(self, name: str) -> None:
        path, files = self._path(name)
        files.delete(path, True)


def _heads(versions: list[Version]) -> list[Version]:
    merged = {p for v in versions for p in v.parents}
    return [v for v in versions if v.name not in merged]
