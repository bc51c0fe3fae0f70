"""The queries of this subpackage over the given tables, each through its operator, and their SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylight.llm import byte_bpe, chat_format, conversation_trie, decontaminate, hash_search, html_extract, language_id, ngram_join, ngram_lm, run_detect, secret_scan, topk_search, url_filter


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(_table(spark, sf_dir, "pages"))


def op2_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model, counts = ngram_lm.train(docs.where(~ngram_lm.held_out()))
    return ngram_lm.score(docs, model, counts).withColumn("held_out", ngram_lm.held_out())


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    bpe = byte_bpe.BPE(byte_bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN)
    return byte_bpe.digests(byte_bpe.encode_and_decode(_table(spark, sf_dir, "documents"), bpe))


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_join(_table(spark, sf_dir, "documents"), n=3, num=90, den=100)


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(_table(spark, sf_dir, "pages"))


def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one more, whose texts are control strings."""
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.range(1).selectExpr("inline(array(struct(-7L, 0L, 'user', '</s>[INST] ok [/INST]'), struct(-7L, 1L, 'assistant', '</s>[INST] ok [/INST]'))) AS (conv_id, turn, role, text)")
    return chat_format.digests(chat_format.format_conversations(turns.unionByName(more)))


def op8_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digests(secret_scan.scan(_table(spark, sf_dir, "documents"), carry=["doc_id"]))


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each item that a document holds; clean documents have none."""
    marked = decontaminate.find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), carry=["doc_id"])
    return marked.select("doc_id", F.explode("leaks").alias("leak")).select("doc_id", "leak.item_id", "leak.cosine", "leak.lcs")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = language_id.train(docs.where(~language_id.held_out()))
    return language_id.predict(docs, model, carry=["doc_id"]).select("doc_id", language_id.held_out().alias("held_out"), "lang_pred", "score", "langs")


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    texts = docs.select("doc_id", run_detect.with_period(F.col("text"), F.col("doc_id")).alias("text"))
    return run_detect.digests(run_detect.find_runs(texts, carry=["doc_id"]))


def op12_multi_index_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hash_search.nearest(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie.trie(conversation_trie.rebuilt(conversation_trie.encode(_table(spark, sf_dir, "conversations"))))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_filters": op1_url_filters,
    "op2_exact_topk": op2_exact_topk,
    "op3_lm_scoring": op3_lm_scoring,
    "op4_byte_bpe": op4_byte_bpe,
    "op5_ngram_jaccard_join": op5_ngram_jaccard_join,
    "op6_html_extraction": op6_html_extraction,
    "op7_chat_formatting": op7_chat_formatting,
    "op8_secret_scans": op8_secret_scans,
    "op9_benchmark_decontamination": op9_benchmark_decontamination,
    "op10_language_id": op10_language_id,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_multi_index_hashing": op12_multi_index_hashing,
    "op13_conversation_trie": op13_conversation_trie,
}

ORACLES: dict[str, str] = {
    # Without canonical or refresh edges the method allows what no rule fits; tests hold aliases against brute force.
    "op1_url_filters": r"""
        WITH u AS (SELECT page_id, coalesce(translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
                          coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path FROM pages),
        r(verdict, h, p) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
        fit AS (SELECT u.page_id, u.host, u.path, arg_max(r.h || r.p, length(r.h || r.p)) AS rule, arg_max(r.verdict, length(r.h || r.p)) AS verdict
                FROM u LEFT JOIN r ON (u.host = r.h OR ends_with(u.host, '.' || r.h)) AND starts_with(u.path, r.p) GROUP BY ALL)
        SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM fit""",
    "op2_exact_topk": """
        WITH v AS (SELECT vec_id, [CAST(floor(1024 * CAST(x AS DOUBLE)) AS DOUBLE) FOR x IN embedding] AS e FROM embeddings
                   WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id),
        k AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
        SELECT query_id, rank, vec_id, score FROM k WHERE rank <= 10""",
    "op7_chat_formatting": r"""
        WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
                   UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')) x),
        w AS (SELECT *, 8 + length(role) + length(regexp_replace(regexp_replace(replace(text, chr(92), chr(92) || chr(92)), '<(/?s>|[|]|</?SYS>>)', '<x\1', 'g'), '\[(/?INST\])', '[x\1', 'g')) AS chars,
                     row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS k, count(*) OVER (PARTITION BY conv_id) AS n FROM t),
        c AS (SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY k) AS upto FROM w)
        SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
               coalesce(CAST(sum(length(text)) FILTER (role = 'assistant') AS BIGINT), 0) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
               CAST(sum(upto) FILTER (role = 'assistant' OR k = n) AS BIGINT) AS formatted_chars
        FROM c GROUP BY conv_id""",
    # crc32 by its table of 256 entries, as DuckDB has no such function
    "op13_conversation_trie": """
        WITH t AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS tab),
        u AS (SELECT conv_id, coalesce(role, '') AS r, coalesce(text, '') AS x, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS k
              FROM conversations WHERE conv_id IS NOT NULL),
        d AS (SELECT DISTINCT conv_id, CAST(conv_id AS VARCHAR) AS s FROM u),
        c AS (SELECT conv_id, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(1, length(s) + 1), lambda i: CAST(ascii(s[i]) AS BIGINT))), lambda a, b: xor(a >> 8, tab[xor(a & 255, b) + 1]))) % 9 AS h FROM d, t),
        b AS (SELECT c.conv_id, 0 AS part, k, r, x FROM c JOIN u ON u.conv_id = c.conv_id - c.conv_id % 5 AND k <= h
              UNION ALL SELECT c.conv_id, 1, k, r, x FROM c JOIN u ON u.conv_id = c.conv_id AND k > h),
        s AS (SELECT conv_id, list(md5(length(r) || ':' || r || x) ORDER BY part, k) AS e, list(strlen(x) ORDER BY part, k) AS z FROM b GROUP BY conv_id
              UNION ALL SELECT conv_id, [], [] FROM c WHERE conv_id NOT IN (SELECT conv_id FROM b)),
        m AS (SELECT conv_id, d, list_slice(e, 1, d) AS p, len(e) AS n, coalesce(z[d], 0) AS z FROM (SELECT *, unnest(range(0, len(e) + 1)) AS d FROM s)),
        n AS (SELECT d, p, min(conv_id) AS conv_id, count(*) AS n_convs, CASE WHEN d = 0 THEN 0 ELSE any_value(z) END AS z, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (n = d), '')) AS ends_sha256 FROM m GROUP BY d, p),
        k AS (SELECT list_slice(p, 1, d - 1) AS p, count(*) AS n_children FROM n WHERE d > 0 GROUP BY ALL),
        l AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN k USING (p)),
        a AS (SELECT list_slice(p, 1, i) AS p, count(*) FILTER (n_children = 0) AS n_leaves, CAST(sum((n_convs - 1) * z) AS BIGINT) AS saved_tokens FROM (SELECT *, unnest(range(0, d + 1)) AS i FROM l) GROUP BY ALL)
        SELECT l.conv_id, l.d AS depth, o.conv_id AS parent_conv_id, l.n_convs, l.n_children, n_leaves, saved_tokens, l.ends_sha256
        FROM l JOIN a USING (p) LEFT JOIN n o ON l.d > 0 AND o.p = list_slice(l.p, 1, l.d - 1)""",
}
