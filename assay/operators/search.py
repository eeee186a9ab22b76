"""A table of text queries against a table of candidates, by an inverted index of words.

A candidate matches a query when every word of the query is one of the words of its name or
description. Each distinct set of words is searched once, however many queries ask for it:

- a set of one word (or none) takes the best candidates straight out of the index, where they are
  cut to the limit inside each task, so a word that a third of all candidates has costs no more;
- a larger set probes the index with its rarest word only, and the rest of its words are verified on
  the candidate. The postings of a common word are dealt over as many slices as its number asks for.

Postings hold a word, a row number and what rows are ranked by; only words that are asked for have
any, and texts stay where they are until candidates are verified.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assay.operators.catalog import LIMIT_PER_SOURCE, source_rank, top_per_group
from assay.operators.joins import lookup
from assay.schemas import SEARCH_SOURCES
from assay.scratch import materialize

#: Postings of one word that one task meets with the queries that probe it.
SLICE_ROWS = 50_000
WORD = r"[^\p{L}\p{N}]+"
#: What a query without words asks for; every candidate has it.
ANY = ""


def words(*texts: Column) -> Column:
    """Distinct lower-case runs of letters and digits."""
    whole = F.lower(F.concat_ws(" ", *texts))
    return F.array_distinct(F.filter(F.split(whole, WORD), lambda w: w != ""))


def search_batch(
    candidates: DataFrame,
    queries: DataFrame,
    sources: list[str] | None = None,
    limit_per_source: int = LIMIT_PER_SOURCE,
    query_id: str = "query_id",
    text: str = "text",
    rank: str = "id",
    slice_rows: int = SLICE_ROWS,
) -> DataFrame:
    """query_id, position and the columns of the candidates, most relevant first.

    Per query the first `limit_per_source` matches of each source by `rank` and id, as
    `search_catalog` lists them. A query without words (or without text) matches every candidate.
    Equal queries, rows of a null id included, each get their rows.
    """
    wanted = SEARCH_SOURCES if sources is None else sources
    rows = materialize(
        candidates.filter(F.col("source").isin(wanted)).select(
            F.monotonically_increasing_id().alias("_row"), F.struct("*").alias("_c")
        ),
        "search-rows",
    )
    own = words(F.col("_c.name"), F.col("_c.description"))
    asked = materialize(
        queries.select(
            F.col(query_id).alias("_q"), F.array_sort(words(F.col(text))).alias("_words")
        ),
        "search-queries",
    )
    sets = asked.select("_words").distinct()

    # Only words that are asked for are indexed.
    posted = rows.select(
        "_row",
        F.col("_c.source").alias("source"),
        F.col(f"_c.{rank}").alias("_rank_by"),
        F.col("_c.id").alias("_id"),
        F.explode(F.concat(own, F.array(F.lit(ANY)))).alias("_word"),
    )
    term = F.explode(F.when(F.size("_words") == 0, F.array(F.lit(ANY))).otherwise(F.col("_words")))
    terms = sets.select("_words", term.alias("_word"))
    index = materialize(
        lookup(posted, terms.select("_word").distinct(), "_word", "left_semi"), "search-index"
    )
    sizes = materialize(index.groupBy("_word").agg(F.count(F.lit(1)).alias("n")), "search-sizes")

    single = sets.filter(F.size("_words") <= 1).select(
        "_words", F.coalesce(F.get("_words", F.lit(0)), F.lit(ANY)).alias("_word")
    )
    heads = lookup(index, single.select("_word"), "_word", "left_semi")
    heads = top_per_group(
        heads, ["_word", "source"], [F.col("_rank_by"), F.col("_id"), F.col("_row")], limit_per_source
    ).drop("_rank")
    found_single = heads.join(single, "_word").select("_words", "_row")

    # The rarest word of a set; a set with a word that nothing has finds nothing.
    probes = (
        lookup(terms.filter(F.size("_words") > 1), sizes, "_word")
        .groupBy("_words")
        .agg(
            F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), F.col("_word").alias("_word"))).alias("p")
        )
        .filter("p.n > 0")
        .select("_words", "p._word", "p.n")
    )
    probes = materialize(probes, "search-probes")
    slices = F.ceil(F.col("n") / slice_rows).cast("int")
    probed = probes.select("_word", slices.alias("_slices")).distinct()
    slot = F.pmod(F.xxhash64("_row"), F.col("_slices")).cast("int")
    postings = lookup(index, probed, "_word", "inner").select("_word", slot.alias("_slot"), "_row")
    spread = probes.select(
        "_words", "_word", F.explode(F.sequence(F.lit(0), slices - 1)).alias("_slot")
    )
    pairs = spread.join(postings, ["_word", "_slot"]).select("_words", "_row")
    verified = pairs.join(rows.select("_row", "_c", own.alias("_own")), "_row").filter(
        F.forall("_words", lambda w: F.array_contains("_own", w))
    )
    ranked = verified.select(
        "_words",
        "_row",
        F.col("_c.source").alias("source"),
        F.col(f"_c.{rank}").alias("_rank_by"),
        F.col("_c.id").alias("_id"),
    )
    found_many = top_per_group(
        ranked, ["_words", "source"], [F.col("_rank_by"), F.col("_id"), F.col("_row")], limit_per_source
    ).select("_words", "_row")

    # A few rows per set and source: placed in the order of the answer, then given to every query.
    best = found_single.unionByName(found_many).join(rows, "_row")
    best = best.withColumn("_by", F.col(f"_c.{rank}"))
    order = F.struct(
        (-F.col("_c.relevance_score")).alias("s"),
        source_rank(F.col("_c.source")).alias("p"),
        F.col("_by").alias("r"),
        F.col("_c.id").alias("i"),
        "_row",
        "_c",
    )
    # At most the limit for each of the sources.
    answers = best.groupBy("_words").agg(F.collect_list(order).alias("_a"))
    plain = materialize(
        answers.select("_words", F.array_sort("_a", _before).alias("_a")), "search-answers"
    )
    return (
        lookup(asked, plain, "_words", "inner")
        .select(F.col("_q").alias(query_id), F.posexplode("_a").alias("_at", "_x"))
        .select(query_id, (F.col("_at") + 1).alias("position"), "_x._c.*")
    )


def _before(a: Column, b: Column) -> Column:
    """Order of two entries by score, source, rank, id and row; candidates aren't comparable."""
    out = F.lit(0)
    for name in ("_row", "i", "r", "p", "s"):
        x, y = a[name], b[name]
        less = F.when(x.isNull() & y.isNull(), 0).when(x.isNull(), -1).when(y.isNull(), 1)
        less = less.when(x < y, -1).when(x > y, 1).otherwise(0)
        out = F.when(less != 0, less).otherwise(out)
    return out
