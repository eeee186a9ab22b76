"""Shards of near equal bytes, tokens and rows by vector bin packing.

Documents of equal text are one group, a vector of its bytes, tokens and rows in units of what one
shard should take. Groups are placed largest first (by their largest component): of the shards that
have room for it in every component, a group goes where the dot product of its vector and the
residual capacity is highest; where none has room, to the shard that would overflow least.

A group larger than a shard is cut, by a hash of the row, into one chunk per shard, or a few where
that is still much: whole shards of short copies would leave no rows for the bytes that they need. Groups that take `LARGE` of a shard or more are few (at most three times shards / LARGE) and are placed first, on
the driver. The rest is dealt by hash into parts of about `PART` groups; every part places its own
groups, one by one, into a share of the capacity that is left, so parts need not know each other and
their sums are balanced as well as each of them. Only keys and sizes are shuffled.

Slots number the rows of a shard from 0 without gaps: rows are counted in buckets (by hash), the
buckets' counts are summed up, and rows are numbered inside their bucket.

Edge cases: a null text has no bytes and no words and is in one group with empty texts. Repeated
rows are rows like others; rows without doc_id are placed too. Fewer groups than shards leave shards
empty. A document larger than a shard's share lies alone or with what weighs least beside it. Other
columns are ignored. An empty table gives no rows.
"""

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assay.scratch import materialize

SHARDS = 40
#: Bytes that a document takes besides its text.
OVERHEAD = 16
#: Share of a shard from which on a group is placed before all smaller ones.
LARGE = 1 / 256
#: Chunks of a group that is larger than a shard, for each shard's worth of it, at least.
CHUNKS = 4
#: Groups that one task places.
PART = 20_000
#: Rows of a shard that are numbered in one task, and the least number of buckets of a shard.
BUCKET, BUCKETS = 4096, 16
SIZES = ("bytes", "tokens", "rows")


def place(items: np.ndarray, residual: np.ndarray) -> np.ndarray:
    """The shard of every item, in the order given; `residual` (shards x components) is used up."""
    out = np.empty(len(items), dtype=np.int32)
    for i, item in enumerate(items):
        room = (residual >= item - 1e-12).all(axis=1)
        if room.any():
            at = int(np.where(room, residual @ item, -np.inf).argmax())
        else:
            at = int((item - residual).max(axis=1).argmin())
        residual[at] -= item
        out[i] = at
    return out


def placing_order(items: np.ndarray, keys: list) -> np.ndarray:
    """Largest first, ties by key."""
    largest = items.max(axis=1, initial=0.0)
    return np.array(sorted(range(len(items)), key=lambda i: (-largest[i], keys[i])), dtype=int)


def _measured(docs: DataFrame, doc_id: str, text: str, tokens: Column | None) -> DataFrame:
    whole = F.coalesce(F.col(text), F.lit(""))
    return docs.select(
        F.col(doc_id).alias("doc_id"),
        (F.octet_length(whole) + OVERHEAD).cast("long").alias("size"),
        F.crc32(whole.cast("binary")).alias("text_crc32"),
        F.coalesce(F.regexp_count(whole, F.lit(r"\S+")) if tokens is None else tokens, F.lit(0)).cast("long").alias("tokens"),
        F.unhex(F.md5(whole.cast("binary"))).alias("key"),
        # Written down with the rows, so that repeated rows can be told apart.
        F.monotonically_increasing_id().alias("place"),
    )


def _sums(rows: DataFrame, *by: str) -> DataFrame:
    return rows.groupBy(*by).agg(
        F.sum("size").alias("bytes"), F.sum("tokens").alias("tokens"), F.count("*").alias("rows")
    )


def _place_part(residual: np.ndarray, scale: np.ndarray):
    def run(key: tuple, x: pd.DataFrame) -> pd.DataFrame:
        items = x[list(SIZES)].to_numpy(np.float64) * scale
        order = placing_order(items, x["key"].to_list())
        # Every part begins at another shard, or what is left over would go to the same ones in all.
        turned = np.roll(np.arange(len(residual)), key[0])
        # And fills what is left in proportion to what it has, so that its own shards come out even.
        own = residual * (items.sum(axis=0) / np.maximum(residual.sum(axis=0), 1e-12))
        shard = turned[place(items[order], own[turned])]
        return pd.DataFrame({"key": x["key"].to_numpy()[order], "shard": shard.astype(np.int32)})

    return run


def pack_shards(
    docs: DataFrame,
    shards: int = SHARDS,
    doc_id: str = "doc_id",
    text: str = "text",
    tokens: Column | None = None,
    large: float = LARGE,
    part: int = PART,
    bucket: int = BUCKET,
) -> DataFrame:
    """doc_id, size, text_crc32, tokens, shard and slot of every row.

    tokens: a count per row; words by default.
    """
    spark = docs.sparkSession
    rows = materialize(_measured(docs, doc_id, text, tokens), "shard-rows")
    groups = materialize(_sums(rows, "key"), "shard-groups")
    total = groups.agg(*(F.sum(c).alias(c) for c in SIZES)).first()
    # Of every component, each shard should take 1.
    scale = np.array([shards / max(1, total[c] or 0) for c in SIZES])
    share = F.greatest(*(F.col(c) * float(s) for c, s in zip(SIZES, scale, strict=True)))

    # At most one per shard and component.
    split = groups.filter(share > 1).select("key", (F.ceil(share * CHUNKS / shards) * shards).cast("int").alias("chunks"))
    split = spark.createDataFrame(split.collect(), "key binary, chunks int")
    chunk = F.coalesce(F.pmod(F.xxhash64("place"), F.col("chunks")), F.lit(0)).cast("int").alias("chunk")
    parts = _sums(rows.join(F.broadcast(split), "key").select("*", chunk), "key", "chunk")
    whole = groups.filter((share <= 1) & (share >= large)).withColumn("chunk", F.lit(0))
    first = parts.unionByName(whole).select("key", "chunk", *SIZES).collect()
    items = np.array([[r[c] for c in SIZES] for r in first], dtype=np.float64).reshape(-1, len(SIZES)) * scale
    order = placing_order(items, [(bytes(r.key), r.chunk) for r in first])
    residual = np.ones((shards, len(SIZES)))
    at = place(items[order], residual)
    placed = spark.createDataFrame(
        [(bytes(first[i].key), first[i].chunk, int(s)) for i, s in zip(order, at, strict=True)],
        "key binary, chunk int, shard int",
    )

    small = groups.filter(share < large)
    n = max(1, -(-small.count() // part))
    rest = (
        small.withColumn("part", F.pmod(F.xxhash64("key"), F.lit(n)))
        .groupBy("part")
        .applyInPandas(_place_part(residual, scale), "key binary, shard int")
    )

    known = rows.join(F.broadcast(split), "key", "left").select("*", chunk).drop("chunks")
    known = known.join(F.broadcast(placed), ["key", "chunk"], "left").drop("chunk")
    found = known.filter(F.col("shard").isNotNull())
    # No group in here is large, so the shuffle by key has no hot one.
    others = known.filter(F.col("shard").isNull()).drop("shard").join(rest, "key")
    buckets = max(BUCKETS, -(-(total["rows"] or 0) // (shards * bucket)))
    assigned = materialize(
        found.unionByName(others).withColumn("bucket", F.pmod(F.xxhash64("place"), F.lit(buckets))).drop("key"),
        "shard-assigned",
    )
    return number_slots(assigned)


def number_slots(assigned: DataFrame) -> DataFrame:
    """Rows with slot, from 0 in each shard: what the buckets before hold, then the place inside."""
    by = ["shard", "bucket"]
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    start = assigned.groupBy(*by).agg(F.count("*").alias("n"))
    start = start.select(*by, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inside = F.row_number().over(Window.partitionBy(*by).orderBy("doc_id", "place")) - 1
    numbered = assigned.withColumn("inside", inside).join(start, by)
    return numbered.select(
        "doc_id", "size", "text_crc32", "tokens", "shard", (F.col("start") + F.col("inside")).cast("long").alias("slot")
    )
