"""More queries of the profile operators with their SQL: crawl assembly, configuration, fields, relations, records, serving."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrylight.functions import exprs as X
from quarrylight.operators import records, serving, sites, tags, web
from quarrylight.plans.queries import DOMAIN, query


@query("c3_crawl_confidence", "documents", """WITH p AS (SELECT source, lang, sum(length(coalesce(text, ''))) AS n FROM documents GROUP BY ALL HAVING sum(length(coalesce(text, ''))) > 0), s AS (SELECT source, count(*) AS filled, sum(n) AS n FROM p GROUP BY 1)
    SELECT source, filled, round_even(least(.95::DOUBLE, .2::DOUBLE + .18::DOUBLE * filled + least(2 * n / 15000, .15::DOUBLE)), 2) AS confidence, CASE WHEN filled >= 4 THEN 'success' ELSE 'partial' END AS status FROM s""")
def _(d):
    return sites.crawl_score(d.where("source IS NOT NULL"), "source", "lang", "text")


_RELEVANCE = """CASE WHEN coalesce(text, '') = '' THEN 0 ELSE round_even(greatest(.1::DOUBLE, least(1::DOUBLE, len(regexp_extract_all(text, 'the')) * .05::DOUBLE + len(regexp_extract_all(text, 'ing')) * .03::DOUBLE
    + list_sum([contains(s, 'with')::INT + contains(s, 'tion')::INT FOR s IN string_split(text, '.') IF contains(s, 'the') OR contains(s, 'ing')] || [0]) * .1::DOUBLE)), 2) END"""


@query("c4_content_relevance", "documents", f"WITH r AS (SELECT doc_id, {_RELEVANCE} AS relevance FROM documents) SELECT *, CASE WHEN relevance < .3 THEN .95::DOUBLE * .6::DOUBLE ELSE .95::DOUBLE END AS confidence FROM r")
def _(d):
    found = d.select("doc_id", sites.relevance(F.col("text"), "the", "ing", ["with", "tion"], r"\.").alias("relevance"))
    return found.withColumn("confidence", sites.discounted(F.lit(0.95), F.col("relevance")))


@query("c7_first_confirmed_site", "pages", f"SELECT {DOMAIN} AS key, min(page_id) AS page_id FROM pages WHERE length(html) > 100 AND contains(html, 'the') GROUP BY 1")
def _(p):
    return sites.first_confirmed(p, web.domain(F.col("url")), "page_id", "html", ["the"])


@query("d10_crawl_friendly", "pages", """SELECT page_id, round_even(least(1::DOUBLE, greatest(0::DOUBLE, .5::DOUBLE - CASE WHEN contains(lower(html[1:3000]), 'form') THEN .4 ELSE 0 END::DOUBLE - CASE WHEN contains(lower(html[1:3000]), 'cookie') THEN .3 ELSE 0 END::DOUBLE
    - CASE WHEN page_id % 10 > 8 THEN .2 WHEN page_id % 10 > 5 THEN .1 ELSE 0 END::DOUBLE + CASE WHEN length(html) > 500 THEN .2 ELSE 0 END::DOUBLE)), 2) AS score FROM pages""")
def _(p):
    return p.select("page_id", sites.crawl_friendly(F.col("html"), F.col("page_id") % 10, ["form"], ["cookie"]).alias("score"))


@query("d19_source_ids", "part", """WITH s AS (SELECT p_partkey, lower(regexp_replace(p_type, '[^A-Za-z0-9]', '', 'g'))[1:30] AS slug FROM part), n AS (SELECT *, row_number() OVER (PARTITION BY slug ORDER BY p_partkey) - 1 AS n FROM s)
    SELECT p_partkey, CASE WHEN n = 0 THEN slug ELSE slug || '_' || n END AS source_id FROM n""")
def _(p):
    return sites.source_ids(p, "p_type", "p_partkey").select("p_partkey", "source_id")


@query("d21_type_keywords", "part", "SELECT p_partkey, CASE WHEN contains(p_type, 'STEEL') AND contains(p_type, 'SMALL') THEN 'a,b,c' WHEN contains(p_type, 'STEEL') THEN 'a,b' WHEN contains(p_type, 'SMALL') THEN 'b,c' ELSE '' END AS keywords FROM part")
def _(p):
    types = X.map_all(F.col("p_type"), [("steel", ["STEEL"]), ("small", ["SMALL"])])
    return p.select("p_partkey", F.array_join(sites.type_keywords(types, {"steel": ["a", "b"], "small": ["b", "c"]}), ",").alias("keywords"))


@query("d23_config_merge", "part", "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'kept' ELSE p_type END AS template, CASE WHEN p_size % 2 = 0 THEN p_name WHEN p_partkey % 3 = 0 THEN 'old' ELSE '' END AS keywords FROM part")
def _(p):
    """Templates of the old configuration stay, its keywords only where the new one has none."""
    old = p.where("p_partkey % 3 = 0").select("p_partkey", F.lit("kept").alias("template"), F.array(F.lit("old")).alias("keywords"))
    new = p.select("p_partkey", F.col("p_type").alias("template"), F.when(F.col("p_size") % 2 == 0, F.array("p_name")).otherwise(F.array().cast("array<string>")).alias("keywords"))
    return sites.merge_config(new, old, "p_partkey", ["template"], ["keywords"]).withColumn("keywords", F.array_join("keywords", ","))


@query("d25_incremental_merge", "events", "SELECT event_id FROM events WHERE event_id % 4 <> 0 AND floor(epoch((SELECT max(ts) FROM events))) - floor(epoch(ts)) <= 604800")
def _(e):
    old = e.join(F.broadcast(e.agg(F.max("ts").alias("now"))), F.lit(True))  # one row
    return sites.carry_forward(old, e.where("event_id % 4 = 0"), "event_id", "ts", F.col("now")).select("event_id")


@query("e2_high_value_source", "documents", "SELECT doc_id, contains(coalesce(source, ''), 'a') OR contains(coalesce(source, ''), 'web') AS high FROM documents")
def _(d):
    return d.select("doc_id", X.any_hit(F.col("source"), ["a", "web"]).alias("high"))


@query("i3_context_class", "documents", "SELECT doc_id, CASE WHEN regexp_matches(text, 'tion|ment') THEN 'customer' WHEN regexp_matches(text, 'sch') THEN 'supplier' ELSE 'partner' END AS kind FROM documents WHERE text IS NOT NULL")
def _(d):
    return d.where("text IS NOT NULL").select("doc_id", X.map_first(F.col("text"), [("customer", ["tion", "ment"]), ("supplier", ["sch"])], "partner").alias("kind"))


@query("i11_map_rel_type", "lineitem", "SELECT l_orderkey, l_linenumber, CASE l_returnflag WHEN 'A' THEN 'customer' WHEN 'R' THEN 'supplier' ELSE 'other' END AS record_type, 'REL-' || printf('%03d', row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_returnflag)) AS record_id FROM lineitem")
def _(li):
    kind = X.map_first(F.col("l_returnflag"), [("customer", ["A"]), ("supplier", ["R"])], "other")
    rows = li.select("l_orderkey", "l_linenumber", kind.alias("record_type"), F.lit(1).alias("all"), F.struct("l_linenumber", "l_returnflag").alias("seq"))
    return tags.record_ids(rows, "l_orderkey", "all", F.lit("REL"), "seq").drop("all", "seq")


@query("q3_list_sorted", "customer", "SELECT c_custkey AS name, c_acctbal AS confidence FROM customer")
def _(c):
    return serving.list_sorted(c.select(F.col("c_custkey").alias("name"), F.col("c_acctbal").alias("confidence")), "confidence", True, "name")


@query("q12_overall_confidence", "lineitem", "SELECT name, round_even(coalesce(sum(c) / (count(c) * 10000), 0), 0) / 100 AS confidence FROM (SELECT l_orderkey AS name, CASE WHEN l_discount > 0 THEN CAST(round(l_discount * 1000000) AS BIGINT) END AS c FROM lineitem) GROUP BY 1")
def _(li):
    return serving.overall_confidence(li.select(F.col("l_orderkey").alias("name"), F.col("l_discount").alias("confidence")))


@query("e4_source_weighting", "documents", "SELECT doc_id, x AS segment FROM (SELECT doc_id, unnest(CASE WHEN contains(coalesce(source, ''), 'a') THEN [text, text] ELSE [text] END) AS x FROM documents)")
def _(d):
    return d.select("doc_id", F.explode(records.weighted(F.col("text"), X.any_hit(F.col("source"), ["a"]))).alias("segment"))


@query("e13_search_text", "documents", "SELECT doc_id, coalesce(nullif(regexp_extract(coalesce(text[101:], ''), '([0-9]{3,})', 1), ''), nullif(regexp_extract(coalesce(text, ''), '([0-9]{3,})', 1), ''), '') AS value FROM documents")
def _(d):
    return d.select("doc_id", records.first_match(F.substring("text", 101, 2147483647), F.col("text"), "([0-9]{3,})").alias("value"))


@query("f16_certifications", "documents", "SELECT doc_id, array_to_string(list_filter([CASE WHEN contains(text, 'MIT License') THEN 'mit' END, CASE WHEN contains(text, 'Apache') THEN 'apache' END, CASE WHEN contains(text, 'GPL') OR contains(text, 'General Public') THEN 'gpl' END], lambda x: x IS NOT NULL), '、') AS certs FROM documents")
def _(d):
    return d.select("doc_id", F.array_join(X.map_all(F.col("text"), [("mit", ["MIT License"]), ("apache", ["Apache"]), ("gpl", ["GPL", "General Public"])]), "、").alias("certs"))


@query("j2_infer_platform", "pages", "SELECT page_id, CASE WHEN contains(url, 'blog.') THEN 'blog' WHEN contains(url, 'm.') THEN 'mobile' ELSE 'site' END AS platform FROM pages")
def _(p):
    return p.select("page_id", X.map_first(F.col("url"), [("blog", ["blog."]), ("mobile", ["m."])], "site").alias("platform"))


@query("j19_record_confidence", "lineitem", "SELECT l_orderkey, l_linenumber, round_even(least(.98::DOUBLE, .6::DOUBLE + CASE WHEN l_returnflag = 'A' THEN .15 ELSE 0 END::DOUBLE + CASE WHEN l_quantity > 10 THEN .1 ELSE 0 END::DOUBLE + CASE WHEN l_discount > .05 THEN .2 ELSE 0 END::DOUBLE), 2) AS confidence FROM lineitem")
def _(li):
    score = records.record_confidence(0.6, [(F.col("l_returnflag") == "A", 0.15), (F.col("l_quantity") > 10, 0.1), (F.col("l_discount") > 0.05, 0.2)])
    return li.select("l_orderkey", "l_linenumber", score.alias("confidence"))


@query("q7_query_facts", "lineitem", "SELECT l_orderkey, l_linenumber, l_extendedprice, count(*) OVER () AS total FROM lineitem WHERE l_suppkey = 1 AND l_returnflag = 'A' ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 10 OFFSET 10")
def _(li):
    """A page is the feature: ten rows, with the number of all."""
    rows = records.facts_page(li, F.col("l_suppkey") == 1, F.col("l_returnflag") == "A", [F.desc("l_extendedprice"), F.asc("l_orderkey"), F.asc("l_linenumber")], 2, 10)
    return rows.select("l_orderkey", "l_linenumber", "l_extendedprice", "total")


@query("q15_result_digest", "lineitem", "WITH r AS (SELECT l_suppkey, l_returnflag, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_returnflag) AS k FROM lineitem) SELECT l_suppkey, count(*) AS n, string_agg(l_returnflag, ',' ORDER BY k) FILTER (k <= 5) AS first FROM r GROUP BY 1")
def _(li):
    return records.digest(li.select("l_suppkey", "l_returnflag", "l_orderkey"), "l_suppkey", "l_returnflag", "l_orderkey")
