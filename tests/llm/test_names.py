"""Columns of the caller that are named like the operators' own."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from assay.llm import decontaminate, license_scan, near_dedup, sentencepiece_codec, toxicity, url_filter

CLASHES = (
    "_id _text _gone _n _w _pos _t _g _raw _size _best _lines _paragraphs _f _p _c _prob _class _keys _hit _row "
    "_blocks _head node weight key label head class_id at hit blocks in_0 in_1 in_2"
).split()
WORDS = " ".join(f"word{i}" for i in range(40))
ROWS = [(1, WORDS), (2, WORDS), (3, "Released under the MIT license"), (4, None), (4, "you fool"), (None, "")]


@pytest.fixture(scope="module")
def plain(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string").withColumn("url", F.lit("http://a.b/c"))


@pytest.fixture(scope="module")
def clashing(plain):
    return plain.withColumns({c: F.concat_ws("-", F.lit(c), "doc_id") for c in CLASHES})


def benchmark(spark):
    return spark.createDataFrame([(1, WORDS, "x")], "item_id long, text string, answer string")


APPLY = {
    "near_dedup": lambda spark, df: near_dedup.deduplicate(df),
    "decontaminate": lambda spark, df: decontaminate.decontaminate(df, benchmark(spark)),
    "sentencepiece": lambda spark, df: sentencepiece_codec.encode(df, public_tokenizers.path("piece_bpe_32k.model")),
    "license_scan": lambda spark, df: license_scan.scan_licenses(df),
    "toxicity": lambda spark, df: toxicity.score_documents(
        df, spark.createDataFrame([(1, 0), (4, 1)], "doc_id long, toxic int")
    ),
    "url_filter": lambda spark, df: url_filter.filter_urls(
        df, spark.createDataFrame([("b/", "block")], "rule string, action string")
    ),
}


@pytest.mark.parametrize("name", APPLY)
def test_columns_of_any_name_come_through(spark, plain, clashing, name):
    want = APPLY[name](spark, plain)
    got = APPLY[name](spark, clashing)
    replaced = {"license_scan": {"at"}}.get(name, set())
    kept = [c for c in CLASHES if c not in replaced]
    assert set(got.columns) == {*want.columns, *CLASHES}
    rows = got.collect()
    for r in rows:
        tail = "" if r.doc_id is None else f"-{r.doc_id}"
        assert all(r[c] == f"{c}{tail}" for c in kept)
    same = lambda found: sorted((str([r[c] for c in want.columns]) for r in found))
    assert same(rows) == same(want.collect()) and rows


def test_trees_beside_their_own_columns(spark):
    rows = [(i, ("you are a stupid fool " if i % 2 else "the river runs past green fields ") * (1 + i % 5)) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = docs.selectExpr("doc_id", "CAST(doc_id % 2 AS INT) AS toxic")
    model = toxicity.fit_toxicity(docs, labels)
    assert model.trees is not None
    wide = docs.withColumns({c: F.lit(c) for c in CLASHES})
    got = model.score(wide)
    assert got.columns == [*wide.columns, "score", "predicted"]
    assert got.filter(" OR ".join(f"{c} != '{c}'" for c in CLASHES)).isEmpty()
    assert got.select("doc_id", "score").exceptAll(model.score(docs).select("doc_id", "score")).isEmpty()
