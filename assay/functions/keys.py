"""Hash keys and path strings."""

from pyspark.sql import Column
from pyspark.sql import functions as F

SPLIT_SEED = 42


def split_hash(keys: list[Column], seed: int = SPLIT_SEED) -> Column:
    """Hex digest that orders rows for the split, the same on any partitioning."""
    parts = [F.coalesce(k.cast("string"), F.lit("")) for k in keys]
    return F.md5(F.concat(F.lit(f"{seed}:"), F.concat_ws("|", *parts)).cast("binary"))


def cache_key(source: Column, id_: Column, url: Column) -> Column:
    """Folder a candidate lands in: owner/slug, flattened id or hashed address."""
    flat = F.replace(id_, F.lit("/"), F.lit("_"))
    parts = F.split(id_, "/", -1)
    slug = F.when(
        F.size(parts) > 1, F.array_join(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(1))), "_")
    ).otherwise(flat)
    return (
        F.when(source == "kaggle", F.concat_ws("/", F.lit("kaggle"), parts[0], slug))
        .when(source == "huggingface", F.concat(F.lit("huggingface/"), flat))
        .otherwise(F.concat(F.lit("url/"), F.substring(F.md5(url.cast("binary")), 1, 12)))
    )


def file_name(url: Column) -> Column:
    """Last part of an address, `data.csv` when it ends in a slash."""
    last = F.element_at(F.split(url, "/", -1), -1)
    return F.when(last == "", "data.csv").otherwise(last)


def local_path(url: Column) -> Column:
    """Address without its file scheme."""
    return F.when(F.startswith(url, F.lit("file://")), F.substr(url, F.lit(8))).otherwise(url)


def bucket_and_key(uri: Column) -> Column:
    """Split `gs://bucket/path` into a struct; null for any other scheme."""
    rest = F.regexp_extract(uri, r"^gs://(.*)$", 1)
    parts = F.split(rest, "/", 2)
    key = F.coalesce(F.get(parts, F.lit(1)), F.lit(""))
    return F.when(
        F.startswith(uri, F.lit("gs://")), F.struct(parts[0].alias("bucket"), key.alias("key"))
    )


def dataset_uri(bucket: Column, run_id: Column, file: str = "data.csv") -> Column:
    """Object-store address of a run's dataset."""
    return F.concat(F.lit("gs://"), bucket, F.lit("/experiments/"), run_id, F.lit(f"/data/{file}"))


def output_uri(bucket: Column, run_id: Column) -> Column:
    """Object-store folder of a run's outputs."""
    return F.concat(F.lit("gs://"), bucket, F.lit("/experiments/"), run_id, F.lit("/output"))


def megabytes(size: Column) -> Column:
    """Bytes to MB, null when unknown or zero."""
    return F.when(size != 0, size / F.lit(1024.0 * 1024.0))
