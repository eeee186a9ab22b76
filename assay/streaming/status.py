"""Live status of runs: the event log as a stream instead of a polling loop."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from assay.schemas import RUN_EVENT
from assay.sources.run_log import RunLog

#: Batches between two compactions of the watched table.
COMPACT_EVERY = 16


def stream_events(
    spark: SparkSession, path: str, files_per_batch: int | None = None
) -> DataFrame:
    """New events as they are appended to the log."""
    reader = spark.readStream.schema(RUN_EVENT)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def watch_runs(
    events: DataFrame, table: str, checkpoint: str, compact_every: int = COMPACT_EVERY
) -> StreamingQuery:
    """Keep the state of runs in the run log at `table`; stops once the stream is read.

    The stream itself has no state: a batch appends its cells, and these are merged into snapshots
    every `compact_every` batches. A repeated batch leaves the state as it was.
    """

    def save(batch: DataFrame, number: int) -> None:
        log = RunLog(batch.sparkSession, table)
        log.append(batch)
        if number % compact_every == compact_every - 1:
            log.compact()
            log.vacuum()

    return (
        events.writeStream.foreachBatch(save)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def current_runs(spark: SparkSession, table: str) -> DataFrame:
    """Latest state per run out of the watched table."""
    return RunLog(spark, table).latest()
