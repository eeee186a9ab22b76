"""Token totals by source, language and tokenizer version, kept up to date by deltas.

A change is a signed row: an insert adds a document and its tokens, a delete subtracts both, a
revised count is the delete of the old row and the insert of the new one. A batch of changes is
summed per group before it is stored, so the ledger grows with groups and batches, not documents.

A batch is committed in two steps: an attempt writes its sums to a folder of its own, then lists
batch, attempt and time. Totals count of every listed batch the attempt that was listed first: a
batch that is repeated, or committed by two drivers at once, changes nothing, what a failed attempt
left isn't seen, and no attempt overwrites another's files.

`compact` adds up what is committed so far into a snapshot, which also lists the batches in it.
Totals are those of the snapshot with the most batches and of the batches that it doesn't have; a
snapshot is listed after it is whole, and older ones stay valid, so readers and other drivers need
not wait.

Edge cases: a null or empty text has no tokens and counts as a document; null sources, languages
and versions are groups of their own. Repeated rows are separate changes. Groups whose documents
and tokens have all gone are left out of the totals. An empty batch can be committed.
"""

import time
import uuid
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assay.scratch import materialize

GROUP = ["source", "lang", "version"]
DELTAS = "source string, lang string, version string, docs long, tokens long"
COMMITS = "batch string, attempt string, at long"
SNAPSHOTS = "snapshot string, batches long"


@lru_cache(maxsize=8)
def _encoder(path: str):
    """Counts the tokens of a list of texts; one per worker process."""
    if path.endswith(".tiktoken"):
        import base64

        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        return lambda texts: [len(own.encode_ordinary(t)) for t in texts]
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(model.encode(t, num_threads=1)) for t in texts]
    from tokenizers import Tokenizer

    fast = Tokenizer.from_file(path)
    fast.encode_special_tokens = True
    return lambda texts: [len(fast.encode(t, add_special_tokens=False).ids) for t in texts]


def token_count(text: Column, tokenizer: str) -> Column:
    """Tokens of a text (long); tokenizer: path of a vocabulary file."""

    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = _encoder(tokenizer)
        for texts in batches:
            yield pd.Series(encode(texts.tolist()), dtype="int64")

    # The types are spelt out for pandas_udf, which reads them from the annotations.
    return F.pandas_udf(count, "long")(F.coalesce(text, F.lit("")))


def _signed(rows: DataFrame, sign: int) -> DataFrame:
    return rows.select(*GROUP, F.lit(sign).cast("long").alias("docs"), (sign * F.col("tokens")).cast("long").alias("tokens"))


def inserts(rows: DataFrame) -> DataFrame:
    """Deltas of new documents; rows: source, lang, version, tokens, one per document."""
    return _signed(rows, 1)


def deletes(rows: DataFrame) -> DataFrame:
    """Deltas of documents that go, given as they were counted."""
    return _signed(rows, -1)


def revisions(old: DataFrame, new: DataFrame) -> DataFrame:
    """Deltas of documents that were counted as `old` and now are as `new`."""
    return deletes(old).unionByName(inserts(new))


class Rollup:
    """Totals kept under a folder that all executors and drivers share."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        # Appending nothing makes these readable from the start.
        for name, schema in (("commits", COMMITS), ("snapshots", SNAPSHOTS)):
            spark.createDataFrame([], schema).write.mode("append").parquet(f"{self.path}/{name}")

    def commits(self) -> DataFrame:
        """batch and attempt of the committed batches: of each the attempt listed first."""
        listed = self.spark.read.schema(COMMITS).parquet(f"{self.path}/commits")
        return listed.groupBy("batch").agg(F.min_by("attempt", F.struct("at", "attempt")).alias("attempt"))

    def prepare(self, batch: str, deltas: DataFrame) -> str:
        """First step: the sums of a batch, in a folder of this attempt's own."""
        if not batch.replace("-", "").replace("_", "").isalnum():
            raise ValueError(f"batch names are letters, digits, - and _: {batch!r}")
        attempt = uuid.uuid4().hex
        sums = deltas.groupBy(*GROUP).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        sums.write.parquet(f"{self.path}/ledger/batch={batch}/attempt={attempt}")
        return attempt

    def publish(self, batch: str, attempt: str) -> None:
        """Second step: from here on the batch counts, unless another attempt was listed before."""
        row = [(batch, attempt, time.time_ns())]
        self.spark.createDataFrame(row, COMMITS).coalesce(1).write.mode("append").parquet(f"{self.path}/commits")

    def commit(self, batch: str, deltas: DataFrame) -> bool:
        """Add a batch; False, and nothing done, when it is in already."""
        if not self.commits().filter(F.col("batch") == batch).isEmpty():
            return False
        self.publish(batch, self.prepare(batch, deltas))
        return True

    def _snapshot(self) -> str | None:
        best = self.spark.read.schema(SNAPSHOTS).parquet(f"{self.path}/snapshots")
        row = best.orderBy(F.desc("batches"), "snapshot").first()
        return row.snapshot if row else None

    def _parts(self) -> tuple[DataFrame, DataFrame]:
        """Sums of the snapshot and of the batches after it, and the names of all these batches."""
        commits, snapshot = self.commits(), self._snapshot()
        sums = self.spark.createDataFrame([], DELTAS)
        if snapshot:
            names = self.spark.read.schema("batch string").parquet(f"{self.path}/snapshot/{snapshot}/batches")
            sums = self.spark.read.schema(DELTAS).parquet(f"{self.path}/snapshot/{snapshot}/sums")
            commits = commits.join(names, "batch", "left_anti")
        if not commits.isEmpty():
            ledger = self.spark.read.schema(f"{DELTAS}, batch string, attempt string").parquet(f"{self.path}/ledger")
            later = ledger.join(commits, ["batch", "attempt"], "left_semi")
            sums = sums.unionByName(later.select(sums.columns))
        return sums, commits.select("batch").unionByName(names) if snapshot else commits.select("batch")

    def compact(self) -> None:
        """Write a snapshot of what is committed, in three steps: sums, names, and its listing."""
        sums, names = self._parts()
        name = uuid.uuid4().hex
        # The names first: sums of exactly these, whatever is committed meanwhile.
        held = materialize(names, "rollup-names")
        _added(sums).write.parquet(f"{self.path}/snapshot/{name}/sums")
        held.write.parquet(f"{self.path}/snapshot/{name}/batches")
        row = [(name, held.count())]
        self.spark.createDataFrame(row, SNAPSHOTS).coalesce(1).write.mode("append").parquet(f"{self.path}/snapshots")

    def totals(self) -> DataFrame:
        """source, lang, version, docs, tokens over all committed batches."""
        return _added(self._parts()[0]).filter("docs != 0 OR tokens != 0")


def _added(sums: DataFrame) -> DataFrame:
    return sums.groupBy(*GROUP).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
