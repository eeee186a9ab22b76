"""Tables of dataset candidates: search, best pick and cache lookup."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assay.functions.keys import cache_key
from assay.operators.joins import fits_broadcast, lookup, salt
from assay.schemas import CANDIDATE_SOURCES, SEARCH_SOURCES, SOURCE_RELEVANCE

# Fixed value: candidates kept per source.
LIMIT_PER_SOURCE = 5
# Largest k that Spark cuts to inside each task before a window shuffle.
PRELIMITED_ROWS = 1000


def relevance(source: Column) -> Column:
    """Constant score by source."""
    score = F.lit(0.0)
    for name, value in SOURCE_RELEVANCE.items():
        score = F.when(source == name, value).otherwise(score)
    return score


def top_per_group(df: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    """First `k` rows of each group.

    Spark cuts to small k before the shuffle; a larger k is first cut inside
    salted slices of each group, which keeps every row of the true top k.
    """
    if k > PRELIMITED_ROWS:
        slices = Window.partitionBy(*by, "_salt").orderBy(*order)
        df = (
            df.withColumn("_salt", salt(df))
            .withColumn("_rank", F.row_number().over(slices))
            .filter(F.col("_rank") <= k)
            .drop("_salt", "_rank")
        )
    whole = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(whole)).filter(F.col("_rank") <= k)


def source_rank(source: Column) -> Column:
    """Position of a source in the merge order."""
    return F.array_position(F.array(*(F.lit(s) for s in SEARCH_SOURCES)), source)


def matches(query: str, *texts: Column) -> Column:
    """True when every word of the query occurs in one of the texts."""
    found = F.lit(True)
    whole = F.lower(F.concat_ws(" ", *texts))
    for word in query.lower().split():
        found = found & F.contains(whole, F.lit(word))
    return found


def search_catalog(
    candidates: DataFrame,
    sources: list[str] | None = None,
    limit_per_source: int = LIMIT_PER_SOURCE,
    query: str | None = None,
    by: list[str] | None = None,
    rank: str = "id",
) -> DataFrame:
    """Best `limit_per_source` candidates of each source, most relevant first.

    `rank` is the order inside a source; `by` names the columns of a batch of
    searches (one ranking each). `sources` defaults to all that are searched.
    """
    by = by or []
    kept = candidates.filter(
        F.col("source").isin(SEARCH_SOURCES if sources is None else sources)
    )
    if query:
        kept = kept.filter(matches(query, F.col("name"), F.col("description")))
    top = top_per_group(kept, [*by, "source"], [F.col(rank), F.col("id")], limit_per_source)
    return top.drop("_rank").orderBy(
        *by, F.desc("relevance_score"), source_rank(F.col("source")), rank, "id"
    )


def best_candidate(
    candidates: DataFrame, by: list[str], sources: list[str] | None = None, rank: str = "id"
) -> DataFrame:
    """The candidate a search would list first, per search; one partial aggregate."""
    kept = candidates.filter(
        F.col("source").isin(SEARCH_SOURCES if sources is None else sources)
    )
    order = F.struct(
        (-F.col("relevance_score")).alias("s"),
        source_rank(F.col("source")).alias("p"),
        F.col(rank).alias("r"),
        F.col("id").alias("i"),
    )
    row = F.struct(*(c for c in candidates.columns if c not in by))
    return kept.groupBy(*by).agg(F.min_by(row, order).alias("best")).select(*by, "best.*")


def with_cache_key(candidates: DataFrame) -> DataFrame:
    return candidates.withColumn(
        "cache_key", cache_key(F.col("source"), F.col("id"), F.col("url"))
    )


def landed_files(files: DataFrame) -> DataFrame:
    """(cache_key, path) files to the first CSV of each key."""
    return (
        files.filter(F.endswith(F.col("path"), F.lit(".csv")))
        .groupBy("cache_key")
        .agg(F.min("path").alias("local_path"))
    )


def split_by_cache(candidates: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(hits with their local path, misses still to fetch).

    A miss of an unknown source is a failed row with its error, not an exception; `success` of the
    others is null until they are fetched.
    """
    keyed = with_cache_key(candidates)
    landed = landed_files(files)
    small = fits_broadcast(landed)
    hits = (
        lookup(keyed, landed, "cache_key", "inner", small)
        .withColumn("success", F.lit(True))
        .withColumn("cached", F.lit(True))
    )
    keys = landed.select("cache_key")
    unknown = ~F.coalesce(F.col("source").isin(CANDIDATE_SOURCES), F.lit(False))
    misses = lookup(keyed, keys, "cache_key", "left_anti", small).withColumns(
        {
            "success": F.when(unknown, F.lit(False)),
            "cached": F.lit(False),
            "error": F.when(unknown, F.concat(F.lit("Unknown source: "), F.coalesce("source", F.lit("")))),
        }
    )
    return hits, misses
