"""Profile, impute, encode, split and the whole preparation."""

from pyspark.sql import functions as F

from assay.operators import encode, impute, prepare, profile, split
from assay.operators.columns import select_features, text_column
from assay.scratch import materialize, scratch_path
from assay.sources.tables import pick_split, read_csv, write_csv
from workload.inputs import STUDY_SQL, split_sql, study, table
from workload.registry import query

CSV_SQL = """SELECT o_orderkey,
  CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END AS price,
  CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderpriority END AS priority,
  o_orderstatus = 'F' AS is_final,
  CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_custkey END AS customer
FROM orders"""


@query("csv_scan_typed", CSV_SQL)
def csv_scan_typed(spark, sf):
    token = "CASE o_orderkey % 4 WHEN 0 THEN 'NA' WHEN 1 THEN 'nan' WHEN 2 THEN 'null' ELSE '' END"
    raw = table(spark, sf, "orders").selectExpr(
        "o_orderkey",
        f"CASE WHEN o_orderkey % 7 = 0 THEN {token} ELSE CAST(o_totalprice AS STRING) END AS price",
        f"CASE WHEN o_orderkey % 11 = 0 THEN {token} ELSE o_orderpriority END AS priority",
        "CASE WHEN o_orderstatus = 'F' THEN 'True' ELSE 'False' END AS is_final",
        f"CASE WHEN o_orderkey % 5 = 0 THEN {token} ELSE CAST(o_custkey AS STRING) END AS customer",
    )
    path = scratch_path(spark, "csv")
    write_csv(raw, path)
    return read_csv(spark, path)


@query(
    "split_pick",
    """WITH a AS (SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'validation' WHEN 1 THEN 'train'
         ELSE 'test' END AS split, value FROM events)
    SELECT event_id, split, value, 'named' AS case FROM a WHERE split = 'train'
    UNION ALL
    SELECT event_id, split, value, 'first' FROM a
    WHERE split = (SELECT min(split) FROM a WHERE split <> 'train')""",
)
def split_pick(spark, sf):
    rows = table(spark, sf, "events").selectExpr(
        "event_id",
        "CASE event_id % 3 WHEN 0 THEN 'validation' WHEN 1 THEN 'train' ELSE 'test' END AS split",
        "value",
    )
    named = pick_split(rows).withColumn("case", F.lit("named"))
    first = pick_split(rows.filter("split <> 'train'")).withColumn("case", F.lit("first"))
    return named.unionByName(first)


@query(
    "prepared_roundtrip",
    f"""WITH base AS (SELECT o_orderkey, o_totalprice FROM orders),
    {split_sql('base', 'o_orderkey')}
    SELECT o_orderkey, o_totalprice, split FROM parts""",
)
def prepared_roundtrip(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    ready = prepare.prepare(rows, "o_totalprice", "regression", key="o_orderkey")
    path = scratch_path(spark, "prepared")
    ready.write(path)
    return spark.read.parquet(path).select("o_orderkey", "o_totalprice", "split")


@query(
    "feature_select",
    f"WITH {STUDY_SQL} SELECT acctbal, segment, total FROM study",
)
def feature_select(spark, sf):
    return select_features(study(spark, sf), ["acctbal", "segment"], "total")


@query(
    "xy_train",
    f"""WITH {STUDY_SQL}, base AS (SELECT o_orderkey, step, strong, total FROM study),
    {split_sql('base', 'o_orderkey')},
    train AS (SELECT * FROM parts WHERE split = 'train')
    SELECT o_orderkey, 'x' AS side, step AS a, strong AS b FROM train
    UNION ALL SELECT o_orderkey, 'y', total, NULL FROM train""",
)
def xy_train(spark, sf):
    rows = study(spark, sf).select("o_orderkey", "step", "strong", "total")
    ready = prepare.prepare(rows, "total", "regression", key="o_orderkey")
    x, y = ready.xy("train")
    return x.select(
        "o_orderkey", F.lit("x").alias("side"), F.col("step").alias("a"), F.col("strong").alias("b")
    ).unionByName(
        y.select(
            "o_orderkey",
            F.lit("y").alias("side"),
            F.col("total").alias("a"),
            F.lit(None).cast("double").alias("b"),
        )
    )


@query(
    "text_column_pick",
    """SELECT doc_id, 'text' AS column_name,
      length(coalesce(CASE WHEN doc_id % 9 = 0 THEN NULL ELSE text END, '')) AS n
    FROM documents""",
)
def text_column_pick(spark, sf):
    docs = table(spark, sf, "documents").selectExpr(
        "doc_id", "lang", "CASE WHEN doc_id % 9 = 0 THEN NULL ELSE text END AS text", "source"
    )
    name = text_column(docs, "lang")
    return docs.select(
        "doc_id",
        F.lit(name).alias("column_name"),
        F.length(F.coalesce(F.col(name), F.lit(""))).cast("long").alias("n"),
    )


LINE_TYPES = {
    "l_orderkey": "bigint",
    "l_partkey": "bigint",
    "l_suppkey": "bigint",
    "l_linenumber": "int",
    "l_quantity": "double",
    "l_extendedprice": "double",
    "l_discount": "double",
    "l_tax": "double",
    "l_returnflag": "string",
    "l_linestatus": "string",
    "l_shipdate": "timestamp_ntz",
}
PLANTED = {
    "l_quantity": "CASE WHEN l_orderkey % 7 = 0 THEN NULL ELSE l_quantity END",
    "l_tax": "CASE WHEN l_orderkey % 10 = 0 THEN CAST('NaN' AS DOUBLE) ELSE l_tax END",
    "l_returnflag": "CASE WHEN l_orderkey % 11 = 0 THEN NULL ELSE l_returnflag END",
}
LINES_SQL = "lines AS (SELECT " + ", ".join(
    "CASE WHEN l_orderkey % 10 = 0 THEN NULL ELSE l_tax END AS l_tax"
    if c == "l_tax"
    else f"{PLANTED.get(c, c)} AS {c}"
    for c in LINE_TYPES
) + " FROM lineitem)"


@query(
    "profile_columns",
    f"WITH {LINES_SQL} "
    + " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, '{t}' AS dtype, "
        f"round(sum(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) / CAST(count(*) AS DOUBLE), 6) "
        f"AS null_pct, count(DISTINCT {c}) AS unique_count FROM lines"
        for c, t in LINE_TYPES.items()
    ),
)
def profile_columns(spark, sf):
    lines = table(spark, sf, "lineitem").selectExpr(
        *(f"{PLANTED.get(c, c)} AS {c}" for c in LINE_TYPES)
    )
    found = profile.profile_columns(lines)
    return found.withColumn("null_pct", F.round("null_pct", 6))


SAMPLE_COLUMNS = ["o_orderkey", "acctbal", "price", "priority", "segment", "status", "day"]


@query(
    "profile_samples",
    f"WITH {STUDY_SQL}, long AS ("
    + " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, o_orderkey, CAST({c} AS VARCHAR) AS value FROM study "
        f"WHERE {c} IS NOT NULL"
        for c in SAMPLE_COLUMNS
    )
    + """), ranked AS (SELECT column_name, value,
      row_number() OVER (PARTITION BY column_name ORDER BY o_orderkey) AS position FROM long)
    SELECT column_name, position, value FROM ranked WHERE position <= 5""",
)
def profile_samples(spark, sf):
    return profile.profile_samples(study(spark, sf).select(*SAMPLE_COLUMNS), "o_orderkey")


def record_sql(column: str) -> str:
    kept = f"FROM study WHERE {column} IS NOT NULL"
    return f"""SELECT '{column}' AS column_name,
      (SELECT count(*) FROM study) AS num_rows, {len(SAMPLE_COLUMNS)} AS num_columns,
      (SELECT round((count(*) - count({column})) / CAST(count(*) AS DOUBLE), 6) FROM study) AS null_pct,
      (SELECT count(DISTINCT {column}) FROM study) AS unique_count,
      (SELECT string_agg(v, '|' ORDER BY k) FROM
        (SELECT CAST({column} AS VARCHAR) AS v, o_orderkey AS k {kept} ORDER BY o_orderkey LIMIT 5)) AS samples,
      (SELECT round(avg(price), 4) FROM study) AS mean, (SELECT round(stddev_samp(price), 4) FROM study) AS std,
      (SELECT min(price) FROM study) AS min, (SELECT max(price) FROM study) AS max"""


@query("profile_record", f"WITH {STUDY_SQL} " + " UNION ALL ".join(record_sql(c) for c in SAMPLE_COLUMNS))
def profile_record(spark, sf):
    """The record of a prepared table, one row per column of it."""
    rows = study(spark, sf).select(*SAMPLE_COLUMNS)
    ready = prepare.prepare(rows, "price", "regression", ["acctbal", "segment"], key="o_orderkey")
    spread = F.col("target_distribution")
    columns = ready.profile(exact=True).select(F.explode("columns").alias("column_name", "c"), "*")
    return columns.select(
        "column_name",
        "num_rows",
        "num_columns",
        F.round("c.null_pct", 6).alias("null_pct"),
        F.col("c.unique_count").alias("unique_count"),
        F.array_join("c.sample_values", "|").alias("samples"),
        F.round(spread["mean"], 4).alias("mean"),
        F.round(spread["std"], 4).alias("std"),
        spread["min"].alias("min"),
        spread["max"].alias("max"),
    )


@query(
    "dataset_profile",
    " UNION ALL ".join(
        f"""SELECT '{t}' AS dataset, count(*) AS num_rows, {n} AS num_columns,
        '{c}' AS target_column, 'regression' AS recommended_task_type,
        CASE WHEN count(*) < 100 THEN 'Small dataset: only ' || count(*) ||
        ' rows. Results may not be reliable.' ELSE '' END AS warnings FROM {t}"""
        for t, n, c in [
            ("nation", 3, "n_regionkey"),
            ("supplier", 4, "s_acctbal"),
            ("lineitem", 11, "l_quantity"),
        ]
    ),
)
def dataset_profile(spark, sf):
    found = None
    for name, target in [
        ("nation", "n_regionkey"),
        ("supplier", "s_acctbal"),
        ("lineitem", "l_quantity"),
    ]:
        one = profile.dataset_profile(table(spark, sf, name), target, "regression").select(
            F.lit(name).alias("dataset"),
            "num_rows",
            "num_columns",
            "target_column",
            "recommended_task_type",
            F.array_join("warnings", " ").alias("warnings"),
        )
        found = one if found is None else found.unionByName(one)
    return found


@query(
    "target_stats",
    """SELECT round(avg(l_extendedprice), 4) AS mean, round(stddev_samp(l_extendedprice), 4) AS std,
    min(l_extendedprice) AS min, max(l_extendedprice) AS max FROM lineitem""",
)
def target_stats(spark, sf):
    found = profile.target_stats(table(spark, sf, "lineitem"), "l_extendedprice")
    return found.withColumns({"mean": F.round("mean", 4), "std": F.round("std", 4)})


@query(
    "target_counts",
    f"""WITH {LINES_SQL} SELECT l_returnflag AS value, count(*) AS n FROM lines
    WHERE l_returnflag IS NOT NULL GROUP BY 1""",
)
def target_counts(spark, sf):
    lines = table(spark, sf, "lineitem").selectExpr(f"{PLANTED['l_returnflag']} AS l_returnflag")
    return profile.target_counts(lines, "l_returnflag")


@query(
    "impute_median",
    f"""WITH {STUDY_SQL}, m AS (SELECT median(acctbal) AS a, median(price) AS p FROM study)
    SELECT o_orderkey, coalesce(acctbal, a) AS acctbal, coalesce(price, p) AS price
    FROM study, m""",
)
def impute_median(spark, sf):
    # The fit scans the rows several times; they are joined once.
    return impute.impute(materialize(study(spark, sf).select("o_orderkey", "acctbal", "price"), "study"))


@query(
    "impute_mode",
    f"""WITH {STUDY_SQL}, m AS (SELECT priority FROM study WHERE priority IS NOT NULL
      GROUP BY priority ORDER BY count(*) DESC, priority LIMIT 1)
    SELECT o_orderkey, coalesce(study.priority, m.priority) AS priority, segment
    FROM study, m""",
)
def impute_mode(spark, sf):
    return impute.impute(study(spark, sf).select("o_orderkey", "priority", "segment"))


def _codes(source: str, *columns: str) -> str:
    return ", ".join(
        f"{c}_codes AS (SELECT {c} AS v, row_number() OVER (ORDER BY CAST({c} AS VARCHAR)) - 1 "
        f"AS code FROM (SELECT DISTINCT {c} FROM {source} WHERE {c} IS NOT NULL) t)"
        for c in columns
    )


@query(
    "label_encode",
    f"""WITH {STUDY_SQL}, {_codes('study', 'segment', 'priority', 'day')}
    SELECT o_orderkey, s.code AS segment, p.code AS priority, d.code AS day FROM study
    LEFT JOIN segment_codes s ON segment = s.v LEFT JOIN priority_codes p ON priority = p.v
    LEFT JOIN day_codes d ON day = d.v""",
)
def label_encode(spark, sf):
    rows = study(spark, sf).select("o_orderkey", "segment", "priority", "day")
    return encode.label_encode(rows, ["segment", "priority", "day"])


@query(
    "label_encode_unseen",
    f"""WITH {split_sql('orders', 'o_orderkey')},
    fit AS (SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS v FROM parts WHERE split = 'train'),
    codes AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS code FROM fit)
    SELECT o_orderkey, coalesce(code, 0) AS customer
    FROM parts LEFT JOIN codes ON CAST(o_custkey AS VARCHAR) = v WHERE split = 'test'""",
)
def label_encode_unseen(spark, sf):
    orders = table(spark, sf, "orders").selectExpr(
        "o_orderkey", "CAST(o_custkey AS STRING) AS customer"
    )
    rows = split.add_split(orders, "o_orderkey")
    levels = encode.fit_levels(rows.filter("split = 'train'"), ["customer"])
    test = rows.filter("split = 'test'").drop("split")
    return encode.apply_levels(test, levels, ["customer"], unseen=0)


@query(
    "train_test_split",
    f"WITH {split_sql('orders', 'o_orderkey')} SELECT o_orderkey, split FROM parts",
)
def train_test_split(spark, sf):
    return split.add_split(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey")


@query(
    "split_partition_check",
    """SELECT CAST(count(*) - ceil(0.2 * count(*)) AS BIGINT) AS train_rows,
    CAST(ceil(0.2 * count(*)) AS BIGINT) AS test_rows, CAST(0 AS BIGINT) AS shared FROM orders""",
)
def split_partition_check(spark, sf):
    rows = split.add_split(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey")
    return prepare.partition_check(rows, "o_orderkey")


PREPARED_FEATURES = ["acctbal", "priority", "segment", "status", "day", "step"]
PREPARED_SQL = f"""{STUDY_SQL},
    fill AS (SELECT median(acctbal) AS a, median(price) AS p FROM study),
    fill_priority AS (SELECT priority AS q FROM study WHERE priority IS NOT NULL
      GROUP BY priority ORDER BY count(*) DESC, priority LIMIT 1),
    filled AS (SELECT o_orderkey, coalesce(acctbal, a) AS acctbal, coalesce(priority, q) AS priority,
      segment, status, day, step, coalesce(price, p) AS price FROM study, fill, fill_priority),
    {_codes('filled', 'priority', 'segment', 'status', 'day')},
    coded AS (SELECT o_orderkey, acctbal, p.code AS priority, s.code AS segment, t.code AS status,
      d.code AS day, step, price FROM filled
      JOIN priority_codes p ON priority = p.v JOIN segment_codes s ON segment = s.v
      JOIN status_codes t ON status = t.v JOIN day_codes d ON day = d.v),
    {split_sql('coded', 'o_orderkey')}"""


def prepared_study(spark, sf):
    return prepare.prepare(
        study(spark, sf), "price", "regression", PREPARED_FEATURES, key="o_orderkey"
    )


@query("prepare_full", f"WITH {PREPARED_SQL} SELECT * FROM parts")
def prepare_full(spark, sf):
    return prepared_study(spark, sf).frame


@query(
    "prepared_quality",
    f"WITH {PREPARED_SQL} "
    + " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, true AS is_numeric, "
        f"CAST(count(*) - count({c}) AS BIGINT) AS nulls FROM parts"
        for c in [*PREPARED_FEATURES, "price"]
    ),
)
def prepared_quality(spark, sf):
    ready = prepared_study(spark, sf)
    return prepare.quality(ready.frame, [*ready.features, ready.target])
