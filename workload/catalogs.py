"""Candidates, cache, page links and plans."""

from pyspark.sql import functions as F

from assay.functions.keys import cache_key
from assay.operators import catalog, search
from assay.plans.cost import estimate_costs, rate_table
from assay.plans.extract import parse_replies, validate_plans
from assay.schemas import HOURLY_RATES
from assay.sources.pages import RESULT_CLASS
from assay.sources.pages import page_links as links_of
from workload.inputs import CANDIDATE_SQL, PLANS_SQL, candidates, plan_rows, table, wide_table
from workload.registry import query

POSITION = "CASE source WHEN 'kaggle' THEN 1 WHEN 'huggingface' THEN 2 ELSE 3 END"
KEY_SQL = """CASE source
  WHEN 'kaggle' THEN 'kaggle/' || split_part(id, '/', 1) || '/' ||
    replace(substr(id, strpos(id, '/') + 1), '/', '_')
  WHEN 'huggingface' THEN 'huggingface/' || replace(id, '/', '_')
  ELSE 'url/' || substr(md5(url), 1, 12) END"""


@query(
    "catalog_search",
    f"""WITH {CANDIDATE_SQL}, ranked AS (SELECT *, row_number() OVER
      (PARTITION BY query, source ORDER BY rank, id) AS r FROM candidates)
    SELECT query, id, source, round(raw_mb, 6) AS size_mb, relevance_score,
      row_number() OVER (PARTITION BY query ORDER BY relevance_score DESC, {POSITION}, rank)
      AS position
    FROM (SELECT query, id, source, CASE WHEN raw_mb <> 0 THEN raw_mb END AS raw_mb,
      relevance_score, rank FROM ranked WHERE r <= 5)""",
)
def catalog_search(spark, sf):
    from pyspark.sql import Window

    found = catalog.search_catalog(candidates(spark, sf), by=["query"], rank="rank")
    order = Window.partitionBy("query").orderBy(
        F.desc("relevance_score"), catalog.source_rank(F.col("source")), "rank"
    )
    return found.select(
        "query",
        "id",
        "source",
        F.round("size_mb", 6).alias("size_mb"),
        "relevance_score",
        F.row_number().over(order).alias("position"),
    )


@query(
    "catalog_search_sources",
    f"""WITH {CANDIDATE_SQL}, ranked AS (SELECT *, row_number() OVER
      (PARTITION BY source ORDER BY rank, id) AS r FROM candidates
      WHERE source IN ('huggingface', 'web') AND contains(lower(name || ' ' || description), 'en'))
    SELECT id, source, relevance_score FROM ranked WHERE r <= 3""",
)
def catalog_search_sources(spark, sf):
    found = catalog.search_catalog(
        candidates(spark, sf), ["huggingface", "web"], 3, query="EN", rank="rank"
    )
    return found.select("id", "source", "relevance_score")


# One text per customer and per nation: words that a third of all candidates has, rare ones, pairs of
# both, words that none has, and none at all.
BATCH_QUERIES = {
    "customer": (
        "c_custkey",
        "CASE c_custkey % 6 WHEN 0 THEN concat('dataset ', CAST(c_custkey % 200 AS {text})) "
        "WHEN 1 THEN concat('EN; Dataset / ', CAST(c_custkey % 200 AS {text})) WHEN 2 THEN 'dataset fr' "
        "WHEN 3 THEN 'de' WHEN 4 THEN 'https example www' ELSE concat('dataset dataset ', c_mktsegment) END",
    ),
    "nation": ("-1 - n_nationkey", "CASE n_nationkey % 3 WHEN 0 THEN '--' WHEN 1 THEN NULL ELSE n_name END"),
}
BATCH_SQL = "queries AS (" + " UNION ALL ".join(
    f"SELECT {i} AS query_id, {t.format(text='VARCHAR')} AS text FROM {name}"
    for name, (i, t) in BATCH_QUERIES.items()
) + ")"
WORDS_SQL = "list_distinct(list_filter(regexp_split_to_array(lower({}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> ''))"


@query(
    "catalog_search_batch",
    f"""WITH {CANDIDATE_SQL}, {BATCH_SQL},
    sets AS (SELECT query_id, {WORDS_SQL.format("coalesce(text, '')")} AS words FROM queries),
    own AS (SELECT *, {WORDS_SQL.format("concat_ws(' ', name, description)")} AS words FROM candidates),
    asked AS (SELECT DISTINCT list_sort(words) AS words FROM sets),
    ranked AS (SELECT a.words, o.* EXCLUDE (words), row_number() OVER
      (PARTITION BY a.words, source ORDER BY rank, id) AS r
      FROM asked a JOIN own o ON list_has_all(o.words, a.words)),
    placed AS (SELECT *, row_number() OVER (PARTITION BY words
      ORDER BY relevance_score DESC, {POSITION}, rank, id) AS position FROM ranked WHERE r <= 5)
    SELECT query_id, CAST(position AS INT) AS position, id, source, url, relevance_score
    FROM sets JOIN placed ON list_sort(sets.words) = placed.words""",
)
def catalog_search_batch(spark, sf):
    texts = [
        table(spark, sf, name).selectExpr(
            f"CAST({i} AS BIGINT) AS query_id", f"{t.format(text='STRING')} AS text"
        )
        for name, (i, t) in BATCH_QUERIES.items()
    ]
    found = search.search_batch(candidates(spark, sf), texts[0].unionByName(texts[1]), rank="rank")
    return found.select("query_id", "position", "id", "source", "url", "relevance_score")


@query(
    "catalog_best",
    f"""WITH {CANDIDATE_SQL}, ranked AS (SELECT *, row_number() OVER (PARTITION BY query
      ORDER BY relevance_score DESC, {POSITION}, rank, id) AS r FROM candidates)
    SELECT query, id, source, url, relevance_score FROM ranked WHERE r = 1""",
)
def catalog_best(spark, sf):
    return catalog.best_candidate(candidates(spark, sf), ["query"], rank="rank").select(
        "query", "id", "source", "url", "relevance_score"
    )


@query(
    "cache_key",
    f"WITH {CANDIDATE_SQL} SELECT source, id, {KEY_SQL} AS cache_key FROM candidates",
)
def cache_keys(spark, sf):
    return candidates(spark, sf).select(
        "source",
        "id",
        cache_key(F.col("source"), F.col("id"), F.col("url")).alias("cache_key"),
    )


LANDED = "substr(md5(cache_key), 1, 1) < '8'"
FILES_SQL = f"""{CANDIDATE_SQL}, keyed AS (SELECT *, {KEY_SQL} AS cache_key FROM candidates),
  files AS (SELECT cache_key, cache_key || '/part-' || CAST(rank % 3 AS VARCHAR) || '.csv' AS path
    FROM keyed WHERE {LANDED}
    UNION ALL SELECT cache_key, cache_key || '/a.txt' FROM keyed),
  landed AS (SELECT cache_key, min(path) AS local_path FROM files
    WHERE path LIKE '%.csv' GROUP BY cache_key)"""


def landed_files(spark, sf):
    """Files of about half the cached folders; every folder has one that is no CSV."""
    keyed = catalog.with_cache_key(candidates(spark, sf))
    csv = keyed.filter(LANDED).selectExpr(
        "cache_key", "cache_key || '/part-' || CAST(rank % 3 AS STRING) || '.csv' AS path"
    )
    return csv.unionByName(keyed.selectExpr("cache_key", "cache_key || '/a.txt' AS path"))


@query(
    "cache_hits",
    f"""WITH {FILES_SQL} SELECT id, cache_key, local_path, true AS success, true AS cached
    FROM keyed JOIN landed USING (cache_key)""",
)
def cache_hits(spark, sf):
    hits, _ = catalog.split_by_cache(candidates(spark, sf), landed_files(spark, sf))
    return hits.select("id", "cache_key", "local_path", "success", "cached")


@query(
    "cache_misses",
    f"""WITH {FILES_SQL} SELECT id, cache_key, CAST(NULL AS BOOLEAN) AS success, FALSE AS cached,
      CAST(NULL AS VARCHAR) AS error FROM keyed ANTI JOIN landed USING (cache_key)""",
)
def cache_misses(spark, sf):
    _, misses = catalog.split_by_cache(candidates(spark, sf), landed_files(spark, sf))
    return misses.select("id", "cache_key", "success", "cached", "error")


@query(
    "page_links",
    r"""WITH found AS (SELECT page_id, regexp_extract_all(html,
      '(<a\b[^>]*?\bhref\s*=\s*["''][^"'']+["''][^>]*>.*?</a>)', 1, 'si') AS anchors FROM pages),
    long AS (SELECT page_id, unnest(anchors) AS a, generate_subscripts(anchors, 1) - 1 AS position
      FROM found),
    raw AS (SELECT page_id, CAST(position AS INT) AS position,
      regexp_extract(a, '^<a\b[^>]*?\bhref\s*=\s*["'']([^"'']+)["'']', 1, 'si') AS u,
      regexp_replace(a, '<[^>]*>', '', 'g') AS t FROM long),
    clean AS (SELECT page_id, position,
      replace(replace(replace(replace(replace(u, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'),
        '&#39;', ''''), '&amp;', '&') AS url,
      trim(replace(replace(replace(replace(replace(t, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'),
        '&#39;', ''''), '&amp;', '&')) AS name FROM raw)
    SELECT page_id, position, url, CASE WHEN name = '' THEN url ELSE name END AS name FROM clean""",
)
def page_links(spark, sf):
    return links_of(wide_table(spark, sf, "pages"), "page_id")


# List items become result blocks: some behind a closed tag, some with bare addresses and entities.
BLOCKS_HTML = """replace(replace(replace(html,
    '<li><a href="/d', '<li class=''big result__title'' data-x="a>b"><span class="ad">Ad</span><br><a class=x href="/d'),
    '<li><a href="/t', concat('<li class=result__title><p>', chr(10), '<a title="</li>" HREF="/q?a=1&amp;t')),
    '</a></li>', '&nbsp;&#233;&#x20AC;&amp;lt; </a><a href="/late">late</a></LI>')"""
ITEM = """<li class=(?:result__title|'big result__title')[^>]*>(.*?)</li>"""


@query(
    "page_results",
    rf"""WITH p AS (SELECT page_id, {BLOCKS_HTML} AS html FROM pages),
    found AS (SELECT page_id, regexp_extract_all(replace(replace(html, 'title="</li>" ', ''), 'data-x="a>b"', ''),
      $${ITEM}$$, 1, 'si')[:5] AS blocks FROM p),
    long AS (SELECT page_id, unnest(blocks) AS b, generate_subscripts(blocks, 1) - 1 AS position FROM found),
    raw AS (SELECT page_id, CAST(position AS INT) AS position,
      regexp_extract(b, '<a[^>]* href="([^"]*)"', 1, 'si') AS u, regexp_extract(b, '<a[^>]*>(.*?)</a>', 1, 'si') AS t FROM long)
    SELECT page_id, position, replace(u, '&amp;', '&') AS url,
      replace(replace(replace(replace(trim(t), '&nbsp;', chr(160)), '&#233;', 'é'), '&#x20AC;', '€'), '&amp;', '&') AS name
    FROM raw""",
)
def page_results(spark, sf):
    pages = wide_table(spark, sf, "pages").selectExpr("page_id", f"{BLOCKS_HTML} AS html")
    return links_of(pages, "page_id", result_class=RESULT_CLASS, limit=5)


REASON = """CASE
  WHEN hypothesis IS NULL THEN 'hypothesis is missing'
  WHEN task_type NOT IN ('binary_classification', 'multiclass_classification', 'regression',
    'nlp_classification', 'nlp_regression', 'clustering', 'time_series')
    THEN 'task_type is not one of the allowed values: ' || task_type
  WHEN model_type NOT IN ('xgboost', 'lightgbm', 'random_forest', 'logistic_regression',
    'linear_regression', 'bert', 'distilbert', 'auto')
    THEN 'model_type is not one of the allowed values: ' || model_type
  WHEN task_type = 'clustering' THEN 'task_type clustering has no verdict' END"""


@query(
    "plan_validate",
    f"WITH {PLANS_SQL} SELECT id, {REASON} IS NULL AS is_valid, {REASON} AS reason FROM plans",
)
def plan_validate(spark, sf):
    valid, rejects = validate_plans(plan_rows(spark, sf))
    return valid.select(
        "id", F.lit(True).alias("is_valid"), F.lit(None).cast("string").alias("reason")
    ).unionByName(rejects.select("id", F.lit(False).alias("is_valid"), "reason"))


RATES_SQL = "rates(machine, rate) AS (VALUES " + ", ".join(
    f"('{m}', CAST({r} AS DOUBLE))" for m, r in HOURLY_RATES.items()
) + ")"


@query(
    "cost_estimate",
    f"""WITH {PLANS_SQL}, {RATES_SQL}, placed AS (SELECT *,
      CASE WHEN compute = 'local' OR (compute = 'auto' AND time_budget_minutes < 10) THEN 'local'
        ELSE 'vertex_ai' END AS backend,
      CASE WHEN machine_type IN (SELECT machine FROM rates) THEN machine_type
        WHEN needs_gpu OR task_type IN ('nlp_classification', 'nlp_regression')
          THEN 'n1-standard-4-t4'
        WHEN time_budget_minutes <= 15 THEN 'n1-standard-4'
        WHEN time_budget_minutes <= 60 THEN 'n1-standard-8' ELSE 'n1-standard-16' END AS chosen
      FROM plans)
    SELECT id, backend AS compute_backend,
      CASE WHEN backend = 'local' THEN 'local' ELSE chosen END AS machine_type,
      round(time_budget_minutes / CAST(60 AS DOUBLE), 6) AS estimated_hours,
      CASE WHEN backend = 'local' THEN CAST(0 AS DOUBLE)
        ELSE CAST(printf('%.4f', rate * (time_budget_minutes / CAST(60 AS DOUBLE))) AS DOUBLE)
        END AS estimated_cost_usd,
      CASE WHEN backend <> 'local' THEN rate END AS machine_hourly_rate_usd,
      CASE WHEN backend = 'local' THEN 'Running locally — free but limited to your machine''s CPU/RAM. Consider Vertex AI for larger datasets or longer training runs.'
        ELSE printf('Vertex AI %s spot instance (~$%.3f/hr). ', chosen, rate) ||
          'Estimated cost: $' || printf('%.3f', rate * (time_budget_minutes / CAST(60 AS DOUBLE)))
          || printf(' for %d minutes. Uses preemptible/spot pricing for maximum savings.',
            time_budget_minutes) END AS recommendation
    FROM placed JOIN rates ON chosen = machine""",
)
def cost_estimate(spark, sf):
    found = estimate_costs(plan_rows(spark, sf), rate_table(spark), cloud_ready=True)
    return found.select(
        "id",
        "compute_backend",
        "machine_type",
        F.round("estimated_hours", 6).alias("estimated_hours"),
        "estimated_cost_usd",
        F.col("breakdown")["machine_hourly_rate_usd"].alias("machine_hourly_rate_usd"),
        "recommendation",
    )


REPLY_JSON = """concat('{"hypothesis": "h', event_id, '", "target_variable": "value", ',
  '"feature_variables": ["k", "ts"], "task_type": "',
  CASE event_id % 4 WHEN 0 THEN 'regression' WHEN 1 THEN 'time_series'
    WHEN 2 THEN 'binary_classification' ELSE 'guessing' END,
  '", "dataset_query": "events", "model_type": "random_forest", "needs_gpu": false}')"""
REPLY = f"""CASE event_id % 7
  WHEN 0 THEN {REPLY_JSON}
  WHEN 1 THEN concat('Here is the plan:', NEWLINE, '```json', NEWLINE, {REPLY_JSON}, NEWLINE, '```')
  WHEN 2 THEN concat('```', NEWLINE, {REPLY_JSON}, NEWLINE, '```', NEWLINE, 'Good luck.')
  WHEN 3 THEN concat('The plan is ', {REPLY_JSON}, ' as asked.')
  WHEN 4 THEN concat('I cannot determine that for ', event_type, '.')
  WHEN 5 THEN concat('{{"task_type": "regression", ', event_id)
  ELSE concat('  ', {REPLY_JSON}, NEWLINE) END"""
NO_PLAN = "'Could not extract a valid experiment plan from the reply.'"
BAD_TASK = "'task_type is not one of the allowed values: guessing'"


@query(
    "plan_extract",
    rf"""WITH replies AS (SELECT event_id, user_id, {REPLY.replace('NEWLINE', 'chr(10)')} AS reply FROM events),
    parts AS (SELECT *, trim(reply, ' ' || chr(10)) AS whole,
      regexp_extract(reply, '```(?:json)?\s*([\s\S]+?)```', 1, 'i') AS fence,
      regexp_extract(reply, '\{{[\s\S]+\}}', 0) AS brace FROM replies),
    parsed AS (SELECT *, CASE WHEN json_valid(whole) THEN whole WHEN json_valid(fence) THEN fence
      WHEN json_valid(brace) THEN brace END AS j FROM parts)
    SELECT CAST(event_id AS VARCHAR) AS id,
      CASE WHEN j IS NULL THEN {NO_PLAN}
        WHEN json_extract_string(j, '$.task_type') = 'guessing' THEN {BAD_TASK} END AS reason,
      CASE WHEN j IS NOT NULL AND json_extract_string(j, '$.task_type') <> 'guessing'
        THEN json_extract_string(j, '$.hypothesis') END AS hypothesis,
      CASE WHEN j IS NOT NULL AND json_extract_string(j, '$.task_type') <> 'guessing'
        THEN json_extract_string(j, '$.task_type') END AS task_type,
      CASE WHEN j IS NOT NULL AND json_extract_string(j, '$.task_type') <> 'guessing'
        THEN 'k,ts' END AS features,
      CASE WHEN j IS NOT NULL AND json_extract_string(j, '$.task_type') <> 'guessing'
        THEN CAST(user_id % 60 AS INT) END AS minutes,
      CASE WHEN j IS NOT NULL AND json_extract_string(j, '$.task_type') <> 'guessing'
        THEN 'n1-standard-4' END AS machine_type
    FROM parsed""",
)
def plan_extract(spark, sf):
    replies = wide_table(spark, sf, "events").selectExpr(
        "event_id", "user_id", REPLY.replace("NEWLINE", "chr(10)") + " AS reply"
    )
    found = parse_replies(
        replies,
        "reply",
        "event_id",
        question=F.concat(F.lit("q"), F.col("event_id")),
        time_budget_minutes=(F.col("user_id") % 60).cast("int"),
    )
    valid = F.col("reason").isNull()
    return found.select(
        "id",
        "reason",
        F.when(valid, F.col("hypothesis")).alias("hypothesis"),
        F.when(valid, F.col("task_type")).alias("task_type"),
        F.when(valid, F.array_join("feature_variables", ",")).alias("features"),
        F.when(valid, F.col("time_budget_minutes")).alias("minutes"),
        F.when(valid, F.col("machine_type")).alias("machine_type"),
    )
