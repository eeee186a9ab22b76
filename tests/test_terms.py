import math
from collections import Counter

import pytest

from assay.functions.text import bigrams, terms_statement, tokens
from assay.operators import terms

DOCS = [
    (1, "The cat, the CAT and a_b x 12"),
    (2, "cat dog"),
    (3, ""),
    (4, None),
    (5, "Été à dog-dog"),
]


@pytest.fixture
def docs(spark):
    return spark.createDataFrame(DOCS, "id int, text string")


def test_tokens_and_bigrams(docs):
    rows = {
        r.id: (r.t, r.b)
        for r in docs.select("id", tokens("text").alias("t"))
        .select("id", "t", bigrams("t").alias("b"))
        .collect()
    }
    assert rows[1][0] == ["the", "cat", "the", "cat", "and", "a_b", "12"]
    assert rows[1][1][:2] == ["the cat", "cat the"] and len(rows[1][1]) == 6
    assert rows[2] == (["cat", "dog"], ["cat dog"])
    assert rows[3] == ([], []) and rows[4] == ([], [])
    assert rows[5][0] == ["été", "dog", "dog"]
    with pytest.raises(ValueError):
        terms_statement("text", 3, "t")


def reference_weights(rows, vocabulary, n_docs, df):
    out = {}
    for key, words in rows:
        tf = Counter(w for w in words if w in vocabulary)
        raw = {w: c * (math.log((1 + n_docs) / (1 + df[w])) + 1) for w, c in tf.items()}
        norm = math.sqrt(sum(v * v for v in raw.values()))
        out.update({(key, w): v / norm for w, v in raw.items()})
    return out


@pytest.mark.parametrize("n_max", [1, 2])
def test_tfidf_against_brute_force(docs, n_max):
    rows = [(r.id, r.t) for r in terms.terms_stage("text", n_max, "t").transform(docs).collect()]
    counts = Counter(w for _, t in rows for w in t)
    df = Counter(w for _, t in rows for w in set(t))
    stats = {r.term: (r.n, r.df) for r in terms.term_stats(docs, "text", n_max).collect()}
    assert stats == {w: (counts[w], df[w]) for w in counts}
    limit = 4
    best = sorted(counts, key=lambda w: (-counts[w], w))[:limit]
    assert [r.term for r in terms.vocabulary(docs, "text", limit, n_max).collect()] == best
    fitted = terms.fit_tfidf(docs, "text", limit, n_max)
    got = {(r.id, r.term): r.weight for r in fitted.weights(docs, "id", "text").collect()}
    want = reference_weights(rows, set(best), len(rows), df)
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k]) for k in want)


def test_empty_corpus(spark):
    with pytest.raises(ValueError, match="empty vocabulary"):
        terms.fit_tfidf(spark.createDataFrame([(1, "a b")], "id int, text string"), "text")
