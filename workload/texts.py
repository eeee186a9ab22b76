"""Tokens, term statistics and TF-IDF."""

from pyspark.sql import functions as F

from assay.operators import terms
from assay.operators.split import add_split
from workload.inputs import split_sql, wide_table
from workload.registry import query

TOKENS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}')"
WORDS_SQL = f"words AS (SELECT doc_id, unnest({TOKENS}) AS term FROM documents)"


@query(
    "tokenize_counts",
    f"""SELECT doc_id, CAST(len({TOKENS}) AS INT) AS n_tokens,
    CAST(len(list_distinct({TOKENS})) AS INT) AS n_distinct FROM documents""",
)
def tokenize_counts(spark, sf):
    return terms.token_counts(wide_table(spark, sf, "documents"), "doc_id", "text")


@query(
    "bigram_counts",
    f"""WITH t AS (SELECT {TOKENS} AS w FROM documents),
    pairs AS (SELECT unnest(list_zip(w[1:len(w) - 1], w[2:])) AS p FROM t WHERE len(w) > 1)
    SELECT p[1] || ' ' || p[2] AS term, count(*) AS n FROM pairs GROUP BY 1""",
)
def bigram_counts(spark, sf):
    return terms.bigram_counts(wide_table(spark, sf, "documents"), "text")


@query(
    "term_stats",
    f"""WITH {WORDS_SQL} SELECT term, count(*) AS n, count(DISTINCT doc_id) AS df FROM words
    GROUP BY term""",
)
def term_stats(spark, sf):
    return terms.term_stats(wide_table(spark, sf, "documents"), "text")


@query(
    "tfidf_vocab",
    f"""WITH {WORDS_SQL} SELECT term, count(*) AS n, count(DISTINCT doc_id) AS df FROM words
    GROUP BY term ORDER BY n DESC, term LIMIT 5000""",
)
def tfidf_vocab(spark, sf):
    return terms.vocabulary(wide_table(spark, sf, "documents"), "text")


@query(
    "tfidf_weights",
    f"""WITH {split_sql('documents', 'doc_id')},
    words AS (SELECT doc_id, split, unnest({TOKENS}) AS term FROM parts),
    vocab AS (SELECT term, count(DISTINCT doc_id) AS df FROM words WHERE split = 'train'
      GROUP BY term ORDER BY count(*) DESC, term LIMIT 5000),
    size AS (SELECT count(*) AS n FROM parts WHERE split = 'train'),
    tf AS (SELECT doc_id, term, count(*) AS tf FROM words GROUP BY doc_id, term),
    raw AS (SELECT doc_id, term, tf * (ln((1 + n) / CAST(1 + df AS DOUBLE)) + 1) AS w
      FROM tf JOIN vocab USING (term), size),
    norms AS (SELECT doc_id, sqrt(sum(w * w)) AS norm FROM raw GROUP BY doc_id)
    SELECT doc_id, term, round(w / norm, 6) AS weight FROM raw JOIN norms USING (doc_id)""",
)
def tfidf_weights(spark, sf):
    docs = add_split(wide_table(spark, sf, "documents").select("doc_id", "text"), "doc_id")
    fitted = terms.fit_tfidf(docs.filter("split = 'train'"), "text")
    return fitted.weights(docs, "doc_id", "text").withColumn("weight", F.round("weight", 6))
