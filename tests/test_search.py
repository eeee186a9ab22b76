"""Batch search against a look at every pair of query and candidate."""

import re

import pytest

from assay.operators.catalog import SOURCE_RELEVANCE
from assay.operators.search import search_batch
from assay.schemas import SEARCH_SOURCES

CANDIDATES = "id string, name string, source string, description string, url string, relevance_score double"


def split(text):
    return frozenset(w for w in re.split(r"[\W_]+", (text or "").lower()) if w)


def brute(candidates, queries, limit):
    out = []
    for q, text in queries:
        fit = [c for c in candidates if c[2] in SEARCH_SOURCES and split(text) <= split(f"{c[1] or ''} {c[3] or ''}")]
        top = [c for s in SEARCH_SOURCES for c in sorted((c for c in fit if c[2] == s), key=lambda c: c[0])[:limit]]
        top.sort(key=lambda c: (-c[5], SEARCH_SOURCES.index(c[2]), c[0]))
        out += [(q, i + 1, c[0]) for i, c in enumerate(top)]
    return sorted(out)


@pytest.fixture
def pool():
    rows = []
    for i in range(300):
        source = [*SEARCH_SOURCES, "attic"][i % 4]
        extra = " ".join(w for n, w in ((2, "even"), (3, "Third"), (50, "rare")) if i % n == 0)
        name = None if i == 7 else f"Common data-set no{i % 40}"
        rows.append((f"c{i:03}", name, source, extra, "u", SOURCE_RELEVANCE.get(source, 0.0)))
    return rows


QUERIES = [
    (1, "common"), (2, "COMMON; data, set"), (3, "rare third"), (4, "even common"), (4, "even common"), (5, "no3 common"),
    (6, "missing common"), (7, "missing"), (8, ""), (9, None), (10, "?!"), (None, "third third THIRD"), (11, "set data even third rare"),
]


def found(df):
    return sorted(((r.query_id, r.position, r.id) for r in df.collect()), key=str)


@pytest.mark.parametrize("slice_rows", [50_000, 7])
def test_equal_to_every_pair(spark, pool, slice_rows):
    candidates = spark.createDataFrame(pool, CANDIDATES).repartition(5)
    queries = spark.createDataFrame(QUERIES, "query_id long, text string")
    df = search_batch(candidates, queries, limit_per_source=2, slice_rows=slice_rows)
    assert found(df) == sorted(brute(pool, [q for q in QUERIES if q[0]], 2) + brute(pool, [q for q in QUERIES if not q[0]], 2), key=str)
    assert df.columns == ["query_id", "position", "id", "name", "source", "description", "url", "relevance_score"]


def test_no_cross_join(spark, pool):
    candidates = spark.createDataFrame(pool, CANDIDATES)
    df = search_batch(candidates, spark.createDataFrame(QUERIES, "query_id long, text string"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan


def test_chosen_sources_and_empty_tables(spark, pool):
    candidates = spark.createDataFrame(pool, CANDIDATES)
    queries = spark.createDataFrame(QUERIES, "query_id long, text string")
    web = search_batch(candidates, queries, sources=["web"], limit_per_source=1).filter("query_id = 1")
    assert [r.source for r in web.collect()] == ["web"]
    assert search_batch(candidates.limit(0), queries).count() == 0
    assert search_batch(candidates, queries.limit(0)).count() == 0
