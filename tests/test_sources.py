import json

import pytest
from pyspark.sql import functions as F

from assay.functions.keys import (
    bucket_and_key, cache_key, dataset_uri, file_name, local_path, megabytes, output_uri,
)
from assay.operators import runs
from assay.sources import pages, records, tables
from assay.streaming.status import current_runs, stream_events, watch_runs


def test_typed_csv(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text(
        "n,x,flag,day,mixed,empty,odd\n"
        "1,1.5,True,2024-01-01,1,,1d\nNA,nan,False,2024-01-02,b,NA,2\n3,null,,NULL,,,N/A\n"
    )
    df = tables.read_csv(spark, str(path))
    assert dict(df.dtypes) == {
        "n": "bigint", "x": "double", "flag": "boolean", "day": "string", "mixed": "string",
        "empty": "double", "odd": "string",
    }
    rows = df.collect()
    assert [r.n for r in rows] == [1, None, 3]
    assert [r.x for r in rows] == [1.5, None, None]
    assert [r.flag for r in rows] == [True, False, None]
    assert [r.day for r in rows] == ["2024-01-01", "2024-01-02", None]
    same = tables.read_csv(spark, str(path), schema=df.schema)
    assert same.collect() == rows


def test_fields_that_span_lines(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text('id,text\n1,"two\nlines, ""quoted"""\n2,plain\n')
    rows = tables.read_csv(spark, f"file://{path}").orderBy("id").collect()
    assert [(r.id, r.text) for r in rows] == [(1, 'two\nlines, "quoted"'), (2, "plain")]


def test_first_csv_and_read_table(spark, tmp_path):
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "z.csv").write_text("v\n1\n")
    (tmp_path / "b" / "a.csv").write_text("v\n2\n")
    (tmp_path / "a.txt").write_text("v\n3\n")
    found = tables.first_csv(spark, str(tmp_path))
    assert found.endswith("/b/a.csv")
    assert tables.read_table(spark, found).first().v == 2
    assert tables.first_csv(spark, str(tmp_path / "b" / "..")).endswith("/b/a.csv")


def test_pick_split(spark):
    df = spark.createDataFrame([("test", 1), ("train", 2), ("dev", 3)], "split string, v int")
    assert [r.v for r in tables.pick_split(df).collect()] == [2]
    assert [r.v for r in tables.pick_split(df.filter("v <> 2")).collect()] == [3]


def test_keys(spark):
    df = spark.createDataFrame(
        [("kaggle", "user/exercise-gpa", "u"), ("kaggle", "solo", "u"), ("kaggle", "a/b/c", "u"),
         ("huggingface", "mldb/student/x", "u"), ("url", "id", "http://h/data.csv")],
        "source string, id string, url string",
    )
    got = [r[0] for r in df.select(cache_key(F.col("source"), F.col("id"), F.col("url"))).collect()]
    import hashlib

    assert got == [
        "kaggle/user/exercise-gpa", "kaggle/solo/solo", "kaggle/a/b_c", "huggingface/mldb_student_x",
        "url/" + hashlib.md5(b"http://h/data.csv").hexdigest()[:12],
    ]
    paths = spark.createDataFrame(
        [("file:///tmp/x.csv",), ("http://h/d/",), ("gs://b/k/v.csv",), ("gs://b",)], "u string"
    ).select(local_path(F.col("u")).alias("p"), file_name(F.col("u")).alias("f"),
             bucket_and_key(F.col("u")).alias("b"))
    rows = paths.collect()
    assert rows[0].p == "/tmp/x.csv" and rows[0].f == "x.csv" and rows[0].b is None
    assert rows[1].p == "http://h/d/" and rows[1].f == "data.csv"
    assert tuple(rows[2].b) == ("b", "k/v.csv") and tuple(rows[3].b) == ("b", "")
    one = spark.range(1).select(
        dataset_uri(F.lit("b"), F.lit("r")).alias("d"), output_uri(F.lit("b"), F.lit("r")).alias("o"),
        megabytes(F.lit(2_000_000)).alias("m"), megabytes(F.lit(0)).alias("z"),
    ).first()
    assert one.d == "gs://b/experiments/r/data/data.csv" and one.o == "gs://b/experiments/r/output"
    assert one.m == pytest.approx(1.9073, abs=1e-4) and one.z is None


def test_result_blocks(spark):
    html = (
        '<div class="result__title"><a class="x" href="https://h/a?b=1&amp;c=2"> Example <b>Data'
        '</b></a></div><a href="/other">No</a><h2 class="big result__title">\n<span><a href="/e"></a></span></h2>'
    )
    df = spark.createDataFrame([(1, html), (2, "<p>none</p>")], "id int, html string")
    found = pages.page_links(df, "id", result_class=pages.RESULT_CLASS).collect()
    assert [(r.url, r.name) for r in found] == [
        ("https://h/a?b=1&c=2", "Example Data"), ("/e", "/e"),
    ]
    assert pages.page_links(df, "id").count() == 3
    assert pages.page_links(df, "id", limit=1).count() == 1
    web = pages.web_candidates(pages.page_links(df, "id")).first()
    assert web.source == "web" and web.relevance_score == 0.5 and web.id == web.url


def test_result_blocks_end_with_their_element(spark):
    c = "result__title"
    cases = [
        f'<h2 class="{c}"><span>Ad</span> <a href=/x>One</a></h2><a href="/out">no</a>',
        f'<div class={c}><div>in</div><p>open <a class="l" href=\'/y?a>b\'>T<i>w</i>o</a></div>',
        f'<div class="{c}">none</div><a href="/late">late</a>',
        f'<h3 class="x {c} y"><a>first has no address</a><a href="/z">z</a></h3>',
        f'<div class="{c}"><b class="{c}"><a href="/in">in</a></b></div>',
        f'<div class="{c}"><script>var t = "<a href=/js></div>";</script><!-- <a href="/c"> --><a href="/s">&#8364;&nbsp;&#x1F600; &amp;lt; &bad; &#0; &</a></div>',
        f'<div title="class={c}"><a href="/t">t</a></div><p data-class="{c}"><a href="/u">u</a></p>',
        f'<br class="{c}"><a href="/v">v</a><p class="{c}">reaches <a href="/end">the <b>end',
        f'<DIV CLASS="{c}"><A HREF="/up"></A></DIV>',
        "<a href='/none'>none</a>", "", None, f"< {c} <<a", f"<div class='{c}'" ,
    ]
    df = spark.createDataFrame(list(enumerate(cases)), "id int, html string")
    got = {}
    for r in pages.result_links(df, "id").orderBy("id", "position").collect():
        got.setdefault(r.id, []).append((r.position, r.url, r.name))
    assert got == {
        0: [(0, "/x", "One")], 1: [(0, "/y?a>b", "Two")], 4: [(0, "/in", "in"), (1, "/in", "in")],
        5: [(0, "/s", "€\u00a0😀 &lt; &bad; \ufffd &")], 7: [(0, "/end", "the end")], 8: [(0, "/up", "/up")],
    }
    # The limit counts blocks, with a link or without.
    many = spark.createDataFrame([(1, cases[2] + cases[0] * 3)], "id int, html string")
    assert pages.result_links(many, "id", limit=2).count() == 1
    long = cases[0] + "<p>word</p>" * 20_000 + cases[0]
    assert pages.result_links(spark.createDataFrame([(1, long)], "id int, html string"), "id").count() == 2


def test_run_records_skip_the_unreadable(spark, tmp_path):
    for name, text in {
        "b": json.dumps({"id": "b", "status": "training", "metrics": {"r2": 0.7},
                         "plan": {"question": "q?"}}, indent=2),
        "a": json.dumps({"id": "a", "status": "pending"}),
        "c": '{"id": "c", "status": ',
        "d": json.dumps({"id": "d", "status": "dreaming"}),
    }.items():
        (tmp_path / name).mkdir()
        (tmp_path / name / "run.json").write_text(text)
    found = records.read_run_records(spark, str(tmp_path), one_per_file=True)
    rows = found.collect()
    assert [r.id for r in rows] == ["a", "b"]
    assert rows[1].metrics == {"r2": 0.7} and rows[1].plan.question == "q?"
    assert records.find_run(found, "b").count() == 1
    assert records.find_run(found, "zz").count() == 0


def test_run_records_by_line(spark, tmp_path):
    path = tmp_path / "runs.json"
    path.write_text('{"id": "b", "status": "training"}\n{"id": "c", "sta\n{"id": "a", "status": "failed"}\n')
    assert [r.id for r in records.read_run_records(spark, str(path)).collect()] == ["a", "b"]


def test_metrics_files(spark, tmp_path):
    for name, text in {"a": '{\n "r2": 0.72,\n "rmse": 0.31\n}', "b": "{oops"}.items():
        (tmp_path / name).mkdir()
        (tmp_path / name / "metrics.json").write_text(text)
    rows = records.read_metrics_files(spark, str(tmp_path)).orderBy("file").collect()
    assert rows[0].success and rows[0].r2 == 0.72 and rows[0].error is None
    assert not rows[1].success and rows[1].error and rows[1].r2 is None


EVENTS = [
    ("a", 1, "pending", {}, None),
    ("a", 2, "training", {"r2": 0.1, "rmse": 2.0}, None),
    ("a", 3, "failed", {}, "boom"),
    ("a", 4, "complete", {"r2": 0.85}, None),
    ("b", 1, "training", {}, None),
]


def test_last_write_wins(spark):
    from assay.schemas import RUN_EVENT

    events = spark.createDataFrame(EVENTS, RUN_EVENT)
    rows = {r.run_id: r for r in runs.latest_runs(events).collect()}
    assert (rows["a"].status, rows["a"].error, rows["a"].seq) == ("complete", "boom", 4)
    assert (rows["b"].status, rows["b"].error) == ("training", None)
    merged = {(r.run_id, r.name): r.value for r in runs.merged_metrics(events).collect()}
    assert merged == {("a", "r2"): 0.85, ("a", "rmse"): 2.0}
    asks = spark.createDataFrame([("b",), ("zz",)], "run_id string")
    found = {r.run_id: r.status for r in runs.run_status(events, asks).collect()}
    assert found == {"b": "training", "zz": "not_found"}
    one = spark.range(1).select(
        runs.merge_maps(F.expr("map('r2', 0.1D, 'f1', 1D)"), F.expr("map('r2', 0.5D)")).alias("m")
    ).first()
    assert one.m == {"r2": 0.5, "f1": 1.0}


def test_watching_a_log_in_batches(spark, tmp_path):
    from assay.schemas import RUN_EVENT

    log, table, state = (str(tmp_path / n) for n in ("log", "table", "state"))
    for row in EVENTS:
        records.append_events(spark.createDataFrame([row], RUN_EVENT).coalesce(1), log)
    watch_runs(stream_events(spark, log, files_per_batch=2), table, state).awaitTermination()
    first = {r.run_id: (r.status, r.error) for r in current_runs(spark, table).collect()}
    assert first == {"a": ("complete", "boom"), "b": ("training", None)}
    records.append_events(spark.createDataFrame([("b", 2, "complete", {}, None)], RUN_EVENT), log)
    watch_runs(stream_events(spark, log), table, state).awaitTermination()
    again = {r.run_id: r.status for r in current_runs(spark, table).collect()}
    assert again == {"a": "complete", "b": "complete"}
    batch = runs.latest_runs(records.read_events(spark, log)).collect()
    assert {r.run_id: r.status for r in batch} == again


def test_metric_log(spark, tmp_path):
    path = str(tmp_path / "log")
    rows = [("a", 1, "r2", 0.1), ("a", 1, "rmse", 2.0), ("a", 2, "r2", 0.3)]
    from assay.schemas import METRIC_LOG

    records.append_metric_log(spark.createDataFrame(rows, METRIC_LOG), path)
    wide = records.pivot_metric_log(spark.read.parquet(path), ["r2", "rmse"]).orderBy("step").collect()
    assert [(r.step, r.r2, r.rmse) for r in wide] == [(1, 0.1, 2.0), (2, 0.3, None)]
