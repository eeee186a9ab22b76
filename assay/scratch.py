"""Shared scratch space for tables that several jobs reuse."""

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path under the folder the session names in spark.checkpoint.dir.

    Only a local session that names none falls back to a local folder: on a cluster every executor
    would write to its own disk, and what is read back would be incomplete.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError(
                "set spark.checkpoint.dir to a folder that the driver and all executors share; "
                f"with master {spark.sparkContext.master!r} there is no local fallback"
            )
        root = tempfile.mkdtemp(prefix="assay-")
        spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/assay-{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write `df` once and read it back: cuts lineage and outlives lost executors."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
