"""Corpus term statistics and TF-IDF weights."""

import math
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.feature import (
    CountVectorizerModel,
    ElementwiseProduct,
    Normalizer,
    SQLTransformer,
)
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assay.functions.text import bigrams, terms_statement, tokens

# Vocabulary limits of the unigram and the bigram model.
UNIGRAM_FEATURES = 5000
BIGRAM_FEATURES = 10000


def terms_stage(text: str, n_max: int = 1, output: str = "_terms") -> SQLTransformer:
    """Pipeline stage from a text column to its term array."""
    return SQLTransformer(statement=terms_statement(text, n_max, output))


def token_counts(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, n_tokens, n_distinct) per document, without a shuffle."""
    words = docs.select(key, tokens(text).alias("w"))
    return words.select(
        key,
        F.size("w").alias("n_tokens"),
        F.size(F.array_distinct("w")).alias("n_distinct"),
    )


def bigram_counts(docs: DataFrame, text: str) -> DataFrame:
    """(term, n) of neighbouring token pairs over the corpus."""
    words = docs.select(tokens(text).alias("_words"))
    pairs = words.select(F.explode(bigrams("_words")).alias("term"))
    return pairs.groupBy("term").agg(F.count(F.lit(1)).alias("n"))


def term_stats(docs: DataFrame, text: str, n_max: int = 1) -> DataFrame:
    """(term, n, df): occurrences and documents per term.

    Every document adds its tokens and, apart from them, its distinct tokens,
    so both counts come from one pre-aggregated shuffle on the term alone.
    """
    terms = terms_stage(text, n_max, "t").transform(docs.select(text)).select("t")
    one, zero = F.lit(1).cast("long"), F.lit(0).cast("long")

    def marked(array, n, df):
        return F.transform(
            array, lambda t: F.struct(t.alias("term"), n.alias("n"), df.alias("df"))
        )

    rows = terms.select(
        F.inline(
            F.concat(
                marked(F.col("t"), one, zero), marked(F.array_distinct(F.col("t")), zero, one)
            )
        )
    )
    return rows.groupBy("term").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))


def vocabulary(
    docs: DataFrame, text: str, max_features: int = UNIGRAM_FEATURES, n_max: int = 1
) -> DataFrame:
    """The most frequent terms; equal counts go to the smaller term."""
    return term_stats(docs, text, n_max).orderBy(F.desc("n"), "term").limit(max_features)


@dataclass(frozen=True)
class Tfidf:
    """Fitted vocabulary and inverse document frequencies (at most `max_features`)."""

    terms: list[str]
    idf: list[float]
    n_max: int

    def pipeline(self, text: str, output: str = "features") -> PipelineModel:
        """Text to term counts times idf, scaled to unit length; runs inside each row."""
        return PipelineModel(
            [
                terms_stage(text, self.n_max),
                CountVectorizerModel.from_vocabulary(
                    self.terms, inputCol="_terms", outputCol="_counts"
                ),
                ElementwiseProduct(
                    scalingVec=Vectors.dense(self.idf), inputCol="_counts", outputCol="_weights"
                ),
                Normalizer(p=2.0, inputCol="_weights", outputCol=output),
            ]
        )

    def transform(self, docs: DataFrame, text: str, output: str = "features") -> DataFrame:
        """`docs` with a sparse unit vector per row."""
        found = self.pipeline(text, output).transform(docs)
        return found.drop("_terms", "_counts", "_weights")

    def weights(self, docs: DataFrame, key: str, text: str) -> DataFrame:
        """(key, term, weight) of the non-zero entries; documents are not shuffled."""
        spark = docs.sparkSession
        names = spark.createDataFrame(list(enumerate(self.terms)), "i int, term string")
        vectors = self.transform(docs.select(key, text), text, "v").select(
            key, F.unwrap_udt("v").alias("v")
        )
        entries = vectors.select(key, F.inline(F.arrays_zip("v.indices", "v.values")))
        entries = entries.toDF(key, "i", "weight")
        return entries.join(F.broadcast(names), "i").select(key, "term", "weight")


def fit_tfidf(
    docs: DataFrame,
    text: str,
    max_features: int = UNIGRAM_FEATURES,
    n_max: int = 1,
    rows: int | None = None,
) -> Tfidf:
    """Fit on `docs` only; idf = ln((1 + rows) / (1 + df)) + 1."""
    count = docs.count() if rows is None else rows
    found = vocabulary(docs, text, max_features, n_max).collect()
    if not found:
        raise ValueError("empty vocabulary: the documents hold no terms")
    idf = [math.log((1 + count) / (1 + r["df"])) + 1.0 for r in found]
    return Tfidf([r["term"] for r in found], idf, n_max)
