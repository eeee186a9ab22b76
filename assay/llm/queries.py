"""The registered queries of the operators, over their whole tables, and their DuckDB twins."""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assay.llm import (
    chat,
    decontaminate,
    hard_negatives,
    license_scan,
    near_dedup,
    prefix_trie,
    sharding,
    token_rollup,
    toxicity,
    url_filter,
    vector_search,
    warc,
)
from assay.llm import sentencepiece_codec as pieces
from assay.scratch import materialize, scratch_path

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_near_dedup")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_table(spark, sf_dir, "documents").select("doc_id", "text"))


OP2 = r"""
WITH turns AS (
    SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
    UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')
), formed AS (
    SELECT *, length(text) + length(regexp_replace(text, '[^\\<\[]', '', 'g'))
        + CASE role WHEN 'user' THEN 18 WHEN 'system' THEN 16 WHEN 'assistant' THEN 13
          ELSE 25 + length(role) + length(regexp_replace(role, '[^\\<\[]', '', 'g')) END AS chars
    FROM turns
)
SELECT conv_id, count(*) AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
    coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
    sum(chars)::BIGINT AS formatted_chars
FROM formed GROUP BY conv_id
"""


@query("op2_chat_prefix_targets", OP2)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], rows.schema)
    segments = materialize(chat.format_chat(rows.unionByName(more)), "chat")
    made = materialize(chat.examples(segments), "chat-examples")
    return chat.chat_digests(segments, made)


OP3 = """
WITH v AS (
    SELECT vec_id, [floor(x::DOUBLE * 64) for x in embedding] AS vec FROM embeddings
    WHERE embedding IS NOT NULL
        AND len([x for x in embedding if x IS NULL OR isnan(x) OR isinf(x)]) = 0
), s AS (
    SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.vec, c.vec)::BIGINT AS score
    FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
), r AS (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
)
SELECT query_id, rank::INT AS rank, vec_id, score FROM r WHERE rank <= 20
"""


@query("op3_pivot_top_k", OP3)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_search.top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


@query("op4_toxicity")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity.score_documents(docs, _table(spark, sf_dir, "labels")).drop("text")


@query("op5_decontamination")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.contaminated(docs, _table(spark, sf_dir, "benchmark"))


OP6 = """
WITH p AS (
    SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS h FROM pages
), d AS (
    SELECT page_id, octet_length(encode(payload)) AS payload_bytes,
        list_aggregate([
            substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                1 + (((('0x' || substr(h, 5 * (i // 4) + 1, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31))::INT, 1)
            for i in range(32)], 'string_agg', '') AS payload_digest
    FROM p
), m AS (
    SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS head FROM d
)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest,
    CASE WHEN page_id < head THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN page_id < head THEN head END AS refers_to
FROM m
"""


@query("op6_warc_salvage", OP6)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    warc.write_warc(_table(spark, sf_dir, "pages").select("page_id", "url", "html"), path)
    rows = warc.read_warc(spark, path, payloads=False).filter("kind = 'record'")
    return rows.select(
        F.col("record_id").cast("long").alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        F.col("refers_to").cast("long").alias("refers_to"),
    )


@query("op7_sentencepiece_spans")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return pieces.encode_digests(docs, public_tokenizers.path("piece_bpe_32k.model"), keep=["doc_id"])


@query("op8_token_rollups")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Load all documents; recount those not in English with another tokenizer; take down those of
    low quality; repeat the recount, which must change nothing."""
    old, new = "byte_bpe_50k.tiktoken", "piece_bpe_32k.model"
    foreign = F.coalesce(F.col("lang") != "en", F.lit(True))
    old_count = token_rollup.token_count(F.col("text"), public_tokenizers.path(old))
    recount = token_rollup.token_count(F.when(foreign, F.col("text")), public_tokenizers.path(new))
    counts = materialize(
        _table(spark, sf_dir, "documents").select(
            "doc_id", "source", "lang", foreign.alias("is_foreign"), old_count.alias("old"), recount.alias("new")
        ),
        "token-counts",
    )
    low = _table(spark, sf_dir, "labels").filter("quality = 0").select("doc_id").distinct()

    def rows(of: DataFrame, version: str, tokens: str) -> DataFrame:
        return of.select("source", "lang", F.lit(version).alias("version"), F.col(tokens).alias("tokens"))

    changed = counts.filter("is_foreign")
    gone = counts.join(low, "doc_id", "left_semi")
    rollup = token_rollup.Rollup(spark, scratch_path(spark, "rollup"))
    rollup.commit("load", token_rollup.inserts(rows(counts, old, "old")))
    revised = token_rollup.revisions(rows(changed, old, "old"), rows(changed, new, "new"))
    rollup.commit("recount", revised)
    taken = rows(gone.filter("is_foreign"), new, "new").unionByName(rows(gone.filter("NOT is_foreign"), old, "old"))
    rollup.commit("takedown", token_rollup.deletes(taken))
    rollup.commit("recount", revised)
    return rollup.totals()


@query("op9_license_scan")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return license_scan.scan_licenses(docs).drop("text")


# The rules that the contract names.
URL_RULES = [
    ("com/", "allow"),
    ("example.com/en/", "block"),
    ("www.example.com/en/", "allow"),
    ("net/es/", "block"),
    ("net/fr/", "block"),
]

OP10 = r"""
WITH p AS (
    SELECT page_id,
        translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''),
            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path
    FROM pages
), rules(rule, verdict, rule_host, rule_path) AS (
    VALUES ('com/', 'allow', 'com', '/'), ('example.com/en/', 'block', 'example.com', '/en/'),
        ('www.example.com/en/', 'allow', 'www.example.com', '/en/'),
        ('net/es/', 'block', 'net', '/es/'), ('net/fr/', 'block', 'net', '/fr/')
), fits AS (
    SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict
    FROM p JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
    GROUP BY page_id
)
SELECT p.page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM p LEFT JOIN fits USING (page_id)
"""


@query("op10_url_bloom_cascade", OP10)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "rule string, action string")
    return url_filter.filter_urls(_table(spark, sf_dir, "pages").select("page_id", "url"), rules).drop("url")


@query("op11_vector_bin_packing")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    law, grown = F.lit("bytes").alias("law"), F.lit(None).cast("int").alias("grown_shard")
    return sharding.pack_shards(docs).select("*", law, grown)


OP12 = r"""
WITH bits AS (
    SELECT i FROM range(256) t(i)
), crc_table AS (
    SELECT i, list_reduce(list_prepend(i::BIGINT, [k::BIGINT for k in range(8)]),
        lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END) AS c FROM bits
), crc_list AS (
    SELECT list(c ORDER BY i) AS t FROM crc_table
), turns AS (
    SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
        row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''),
            left(coalesce(text, ''), 256), md5(coalesce(text, ''))) - 1 AS pos
    FROM conversations WHERE conv_id IS NOT NULL
), convs AS (
    SELECT conv_id, conv_id - conv_id % 20 AS base, xor(list_reduce(
        list_prepend(4294967295::BIGINT, [ord(ch)::BIGINT for ch in string_split(conv_id::VARCHAR, '')]),
        lambda x, ch: xor(t[(xor(x, ch) & 255) + 1], x >> 8)), 4294967295) % 4 AS h
    FROM (SELECT DISTINCT conv_id FROM turns), crc_list
), pieces AS (
    SELECT c.conv_id, 0 AS part, pos, role, text FROM convs c JOIN turns t ON t.conv_id = c.base AND pos < h
    UNION ALL
    SELECT c.conv_id, 1 AS part, pos, role, text FROM convs c JOIN turns t ON t.conv_id = c.conv_id AND pos >= h
), rebuilt AS (
    SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY part, pos) AS depth FROM pieces
), prefixes AS (
    SELECT conv_id, 0 AS depth, '' AS node, 0 AS words FROM convs
    UNION ALL
    SELECT conv_id, depth, md5(string_agg(length(role) || ':' || role || length(text) || ':' || text, '')
        OVER (PARTITION BY conv_id ORDER BY depth)),
        len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) FROM rebuilt
), nodes AS (
    SELECT depth, node, min(conv_id) AS conv_id, count(*) AS n_convs, max(words) AS words FROM prefixes GROUP BY depth, node
), tree AS (
    SELECT n.*, p.node AS parent FROM nodes n LEFT JOIN prefixes p ON p.conv_id = n.conv_id AND p.depth = n.depth - 1
), children AS (
    SELECT depth - 1 AS depth, parent AS node, count(*) AS n_children FROM tree WHERE depth > 0 GROUP BY ALL
), subtrees AS (
    SELECT a.depth, a.node, count(*) FILTER (k.n_children IS NULL) AS n_leaves, sum((u.n_convs - 1) * u.words) AS saved_tokens
    FROM nodes u JOIN prefixes a ON a.conv_id = u.conv_id AND a.depth <= u.depth
    LEFT JOIN children k ON k.depth = u.depth AND k.node = u.node GROUP BY a.depth, a.node
), ends AS (
    SELECT depth, node, sha256(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)) AS ends_sha256
    FROM prefixes p WHERE depth = (SELECT max(depth) FROM prefixes q WHERE q.conv_id = p.conv_id) GROUP BY depth, node
)
SELECT t.conv_id, t.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, t.n_convs,
    coalesce(n_children, 0)::BIGINT AS n_children, n_leaves::BIGINT AS n_leaves, saved_tokens::BIGINT AS saved_tokens,
    coalesce(ends_sha256, sha256('')) AS ends_sha256
FROM tree t LEFT JOIN nodes p ON p.depth = t.depth - 1 AND p.node = t.parent
LEFT JOIN children k ON k.depth = t.depth AND k.node = t.node
JOIN subtrees s ON s.depth = t.depth AND s.node = t.node
LEFT JOIN ends e ON e.depth = t.depth AND e.node = t.node
"""


@query("op12_prefix_trie", OP12)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = materialize(prefix_trie.ordered_turns(_table(spark, sf_dir, "conversations")), "trie-ordered")
    return prefix_trie.prefix_trie(prefix_trie.rebuilt_turns(turns))


OP13 = """
WITH v AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
        [floor(x::DOUBLE * 256) for x in embedding] AS vec FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL
        AND len([x for x in embedding if x IS NULL OR isnan(x) OR isinf(x)]) = 0
), s AS (
    SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS alike, list_inner_product(a.vec, c.vec)::BIGINT AS score
    FROM v a JOIN v c ON a.vec_id <> c.vec_id WHERE a.vec_id % 100 = 0
), p AS (
    SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE alike
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT anchor_id, positive_id, (row_number() OVER w)::INT AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id)
WHERE NOT alike AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)
QUALIFY row_number() OVER w <= 5
"""


@query("op13_hard_negatives", OP13)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine_hard_negatives(rows.withColumn("label", moved), F.col("vec_id") % 100 == 0)
