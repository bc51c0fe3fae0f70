"""Queries of mentions, edges and transaction records, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrylight.operators import relations as R
from quarrylight.plans.queries import query

_SENT = """s AS (SELECT doc_id, source, pos - 1 AS pos, trim(x) AS sentence FROM (SELECT doc_id, source, unnest(string_split_regex(text, '[.\\n]')) AS x, generate_subscripts(string_split_regex(text, '[.\\n]'), 1) AS pos FROM documents) WHERE length(trim(x)) >= 10 AND (contains(x, 'tion') OR contains(x, 'ing')))"""
_NAME = "[A-Z][a-z]{3,}"
_ORDER = "'Buyer' || o_custkey || ' wins from Firm' || (o_orderkey % 7) || ' project: Job' || o_orderkey"


def _sentences(d, also=None):
    return R.factual_sentences(d.select("doc_id", "text"), "doc_id", "text", ["tion", "ing"], delimiters=r"[.\n]", also=also)


def _orders(o):
    cols = {"own": F.concat(F.lit("Buyer"), "o_custkey"), "sentence": F.concat(F.lit("Buyer"), "o_custkey", F.lit(" wins from Firm"), F.col("o_orderkey") % 7, F.lit(" project: Job"), "o_orderkey")}
    return o.select("o_orderkey", *[c.alias(k) for k, c in cols.items()], "o_totalprice", "o_orderdate")


@query("i1_company_mentions", "documents", f"""WITH n AS (SELECT doc_id, text, unnest(list_distinct(regexp_extract_all(text, '({_NAME})', 1) || [w FOR w IN ['tion', 'ment'] IF contains(text, w)])) AS name FROM documents WHERE text IS NOT NULL)
    SELECT doc_id, name, text[greatest(strpos(text, name) - 50, 1):strpos(text, name) + length(name) + 49] AS context FROM n""")
def _(d):
    return R.mentions(d, "doc_id", "text", [_NAME], ["tion", "ment"]).select("doc_id", "name", "context")


@query("i2_valid_mention", "documents", f"""WITH n AS (SELECT doc_id, coalesce(lang, '?') AS own, unnest(list_distinct(regexp_extract_all(text, '({_NAME}|[0-9]+)', 1))) AS name FROM documents WHERE text IS NOT NULL)
    SELECT doc_id, name FROM n WHERE length(name) >= 2 AND name <> 'They' AND NOT contains(name, own) AND NOT contains(own, name) AND NOT regexp_matches(name, '^[0-9.,]+$') AND NOT contains(name, 'ing')""")
def _(d):
    rows = R.mentions(d, "doc_id", "text", [f"{_NAME}|[0-9]+"], []).join(d.select("doc_id", F.coalesce("lang", F.lit("?")).alias("own")).hint("merge"), "doc_id")
    return rows.where(R.valid_mention(F.col("name"), F.col("own"), ["They"], ["ing"])).select("doc_id", "name")


@query("i4_infer_industry", "part", """SELECT p_partkey, CASE WHEN p_name = 'red widget' THEN 'exact' WHEN contains(p_name, 'ring') THEN 'rings' WHEN contains(p_name, 'small') THEN 'small' WHEN p_type LIKE '%ECONOMY%' THEN 'economy' WHEN contains(p_name, 'widget') THEN 'widgets' ELSE '' END AS industry FROM part""")
def _(p):
    return p.select("p_partkey", R.infer_industry(F.col("p_name"), {"red widget": "exact"}, [("ring", "rings"), ("small", "small")], F.col("p_type"), [("economy", ["ECONOMY"])], [("widgets", ["widget"])]).alias("industry"))


_LINES = "SELECT DISTINCT 'S' || l_suppkey AS own, l_partkey AS k FROM lineitem"


@query("i8_downstream_relations", "lineitem", f"""WITH a AS ({_LINES} WHERE l_returnflag = 'A' AND l_linenumber = 1), t AS (SELECT DISTINCT own, 'I' || k % 7 AS industry FROM a), c AS (SELECT DISTINCT own, k % 14 AS c FROM a), n AS (SELECT own, k, 'I' || k % 9 AS industry FROM ({_LINES} WHERE l_returnflag = 'R' AND l_linenumber = 2)),
    sure AS (SELECT own, industry, (SELECT list('应用场景:C' || c ORDER BY c) FROM c WHERE c.own = t.own AND 'I' || c % 7 = t.industry) AS s, (SELECT list('关联企业:P' || k ORDER BY k) FROM n WHERE n.own = t.own AND n.industry = t.industry) AS m FROM t),
    e AS (SELECT own, industry, array_to_string(coalesce(s, []) || coalesce(m, []), '；') AS evidence, .85::DOUBLE AS confidence, '标签推断' AS data_source FROM sure
        UNION ALL SELECT own, industry, '关联企业:P' || min(k) || '推断', .75::DOUBLE, '原始文本推断' FROM n WHERE industry <> 'I8' AND (own, industry) NOT IN (SELECT (own, industry) FROM t) GROUP BY own, industry)
    SELECT own AS subject, industry AS object, '下游行业' AS rel_type, own || '产品应用于' || industry AS description, '' AS project, '' AS amount, industry, CASE WHEN evidence = '' THEN '应用场景/业务范围推断' ELSE evidence END AS evidence, confidence, data_source FROM e""")
def _(li):
    """Suppliers' parts as scenes and as mentions of industries."""
    own, k = F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("own"), F.col("l_partkey")
    name = lambda letter, c: F.concat(F.lit(letter), c.cast("string"))
    flat = li.where("l_returnflag = 'A' AND l_linenumber = 1").groupBy(own).agg(F.collect_set(name("I", k % 7)).alias("downstream"), F.transform(F.sort_array(F.collect_set(k % 14)), lambda c: name("C", c)).alias("scenes"))
    seen = li.where("l_returnflag = 'R' AND l_linenumber = 2").select(own, k.alias("seq"), name("P", k).alias("name"), name("I", k % 9).alias("industry")).distinct()
    return R.downstream_edges(flat, seen, {f"C{c}": f"I{c % 7}" for c in range(14)}, "I8")


@query("j1_route_segments", "documents", "SELECT doc_id, CASE WHEN lang IN ('en', 'de') THEN 'bidding' ELSE 'website' END AS parser FROM documents WHERE lang IN ('en', 'de', 'fr') AND length(text) > 20")
def _(d):
    return R.route_segments(d, "lang", "text", {"en": "bidding", "de": "bidding", "fr": "website"}).select("doc_id", "parser")


@query("j3_factual_sentences", "documents", f"WITH {_SENT} SELECT doc_id, pos, sentence FROM s")
def _(d):
    return _sentences(d)


@query("j5_project_name", "documents", "SELECT doc_id, CASE WHEN length(v) BETWEEN 4 AND 60 THEN v ELSE '' END AS project FROM (SELECT doc_id, regexp_replace(regexp_extract(coalesce(text, ''), 'the ([a-z]+)', 1), '^[st]', '') AS v FROM documents)")
def _(d):
    return d.select("doc_id", R.project_name(F.col("text"), ["the ([a-z]+)"], "[st]").alias("project"))


@query("j8_counterparty", "orders", "SELECT o_orderkey, 'Firm' || (o_orderkey % 7) AS counterparty FROM orders")
def _(o):
    return _orders(o).select("o_orderkey", R.counterparty(F.col("sentence"), "(?:Buyer|Firm)[0-9]+", F.col("own")).alias("counterparty"))


@query("j22_fact_row_mapping", "lineitem", "SELECT l_orderkey || '-' || l_linenumber AS record_id, CASE l_returnflag WHEN 'A' THEN 'bidding' ELSE 'customer' END AS record_type, CASE l_returnflag WHEN 'A' THEN l_linestatus ELSE l_suppkey::VARCHAR END AS counterparty, CASE l_returnflag WHEN 'A' THEN l_partkey::VARCHAR END AS project_name FROM lineitem")
def _(li):
    rows = li.withColumns({"record_id": F.concat_ws("-", "l_orderkey", "l_linenumber"), "record_type": F.when(F.col("l_returnflag") == "A", "bidding").otherwise("customer")})
    return R.fact_rows(rows, {"counterparty": {"bidding": "l_linestatus", "customer": "l_suppkey"}, "project_name": {"bidding": "l_partkey"}})
