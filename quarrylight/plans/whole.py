"""Queries of sources and sinks, discovery, links, noise, records, edges, flat columns, sheets and streams, each with its SQL.

Their sentences and pages are made by Spark from the tables' columns where the tables hold none of the kind.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quarrylight.functions.exprs import map_first, words_array
from quarrylight.operators import crawl, facts, profile_tags, scoring, serving, tags, text, web
from quarrylight.operators import relations as R
from quarrylight.plans.queries import DOMAIN, LINES, ORACLES, QUERIES, SQUEEZE, TEXT, query
from quarrylight.sources import io
from quarrylight.streaming import jobs
from quarrylight.streaming.state import BucketTable



def on_session(name: str, sql: str | None):
    """Registers a function of the session and the tables' folder."""

    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


# Sources and sinks


@query("s1_crawl_records", "conversations", """WITH c AS (SELECT conv_id, max(text) FILTER (role = 'assistant') AS a, max(text) FILTER (role = 'user') AS u, max(text) FILTER (role = 'system') AS s FROM conversations GROUP BY 1),
    t AS (SELECT conv_id, coalesce(CASE WHEN conv_id % 2 = 0 THEN nullif(trim(s), '') END, concat_ws(chr(10), nullif(trim(a), ''), nullif(trim(u), ''))) AS text FROM c) SELECT conv_id, md5(text) AS text FROM t WHERE text <> ''""")
def _(c):
    of = lambda role: F.max(F.when(F.col("role") == role, F.col("text")))
    by = c.groupBy("conv_id").agg(of("assistant").alias("a"), of("user").alias("u"), of("system").alias("s"))
    none = F.lit(None).cast("string")
    raw = F.struct(F.col("a").alias("official_website"), F.col("u").alias("business_info"), none.alias("bidding_info"), none.alias("patent_info"), F.when(F.col("conv_id") % 2 == 0, F.col("s")).alias("all_content"))
    return io.crawl_text(by.select("conv_id", raw.alias("raw_content"))).select("conv_id", F.md5(F.col("text").cast("binary")).alias("text"))


@query("s2_name_list", "customer", "SELECT trim(x) AS name FROM (SELECT unnest(string_split(c_name || ', ' || c_mktsegment || ',#' || c_custkey || ', ', ',')) AS x FROM customer) WHERE trim(x) <> '' AND NOT starts_with(trim(x), '#')")
def _(c):
    return io.names(c.select(F.concat("c_name", F.lit(", "), "c_mktsegment", F.lit(",#"), F.col("c_custkey").cast("string"), F.lit(", ")).alias("line")), "line", commas=True)


@query("s3_table_names", "supplier", "SELECT DISTINCT s_name AS name FROM supplier WHERE s_acctbal > 0 AND s_name <> ''")
def _(s):
    return io.names_from_table(s, "s_name", "s_acctbal > 0")


@query("s4_pages", "pages", "SELECT page_id, url, length(html) AS n FROM pages WHERE html IS NOT NULL AND html <> '' AND page_id % 5 <> 0")
def _(p):
    return io.fetched(p.withColumn("success", F.col("page_id") % 5 != 0), "success").select("page_id", "url", F.length("html").cast("long").alias("n"))


@query("s5_seed_tables", "supplier,nation", "SELECT n_name AS category, s_name AS name, 'https://s' || s_suppkey || '.example.org/' AS url, 'phone ' || s_suppkey AS description FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_suppkey % 4 <> 0")
def _(s, n):
    key, link = F.col("s_suppkey").cast("string"), F.concat(F.lit("https://s"), F.col("s_suppkey").cast("string"), F.lit(".example.org/"))
    plain = F.concat(F.lit("| phone "), key, F.lit(" | "), "s_name", F.lit(" | "), link, F.lit(" |"))
    marked = F.concat(F.lit("| phone "), key, F.lit(" | ["), "s_name", F.lit("]("), link, F.lit(") | |"))
    row = F.when(F.col("s_suppkey") % 4 == 0, F.concat(F.lit("| none | "), "s_name", F.lit(" | - |"))).when(F.col("s_suppkey") % 2 == 0, plain).otherwise(marked)
    rows = s.select(F.col("s_nationkey").alias("doc"), (F.col("s_suppkey") + 3).alias("seq"), row.alias("line"))
    heads = n.select(F.col("n_nationkey").alias("doc"), F.explode(F.array(F.struct(F.lit(0).cast("long").alias("seq"), F.concat(F.lit("## "), "n_name").alias("line")), F.struct(F.lit(1).cast("long").alias("seq"), F.lit("| 说明 | 名称 | 网址 |").alias("line")), F.struct(F.lit(2).cast("long").alias("seq"), F.lit("|---|:--|---|").alias("line")))).alias("x")).select("doc", "x.*")
    return io.seed_rows(rows.unionByName(heads))


@on_session("s6_stage_archive", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_orderkey % 2 = 1")
def _(spark, sf_dir):
    """Two batches of one stage and one of another are archived; one batch is read back."""
    orders, path = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_totalprice", "o_orderstatus"), io.scratch(spark)
    for batch in (0, 1):
        io.write_stage(orders.where((F.col("o_orderstatus") == "F") & (F.col("o_orderkey") % 2 == batch)), "clean", f"b{batch}", path)
    io.write_stage(orders.where("o_orderstatus = 'O'"), "tag", "b1", path)
    return io.read_stage(spark, path, "clean", "b1").select("o_orderkey", "o_totalprice")


@query("s9a_tag_overview", "part", """SELECT p_partkey AS enterprise_name, p_name AS short_name, p_type AS industry, CASE WHEN p_size % 2 = 0 THEN p_name || '、' || p_brand ELSE p_brand END AS main, p_type AS core, '' AS high_end, '' AS core_process, '' AS special, p_name AS scenes, '' AS downstream, '' AS roles, '' AS tiers, '' AS customers,
    CASE WHEN p_size > 25 THEN 'iso' || (p_size % 3) || '、' || p_brand WHEN p_size > 10 THEN p_brand ELSE '' END AS compliance, p_brand AS manufacturing, p_name AS keywords, p_retailprice AS confidence, '' AS data_source FROM part""")
def _(p):
    lists = ["main", "core", "high_end", "core_process", "special", "scenes", "downstream", "roles", "tiers", "customers", "manufacturing", "keywords"]
    made = {"main": F.array(F.when(F.col("p_size") % 2 == 0, F.col("p_name")).otherwise("未明确"), "p_brand"), "core": F.array("p_type"), "high_end": words_array(["未明确"]), "scenes": F.array("p_name"), "manufacturing": F.array("p_brand"), "keywords": F.array("p_name")}
    none = F.lit(None).cast("array<string>")
    companies = p.select("p_partkey", F.col("p_name").alias("short_name"), F.col("p_type").alias("industry"), F.col("p_retailprice").alias("confidence"), F.lit(None).cast("string").alias("data_source"), *[made.get(c, none).alias(c) for c in lists])
    tag = lambda n, t, c: F.struct(F.lit(n).alias("ord"), t.alias("tag"), c.alias("confidence"))
    both = F.array(tag(2, F.col("p_brand"), F.when(F.col("p_size") > 10, 0.9).otherwise(0.0)), tag(1, F.concat(F.lit("iso"), (F.col("p_size") % 3).cast("string")), F.when(F.col("p_size") > 25, 0.8).otherwise(0.0)))
    rows = p.select("p_partkey", F.lit("产品合规标签").alias("sub_category"), F.inline(both))
    return crawl.overview(companies, rows, "p_partkey", lists, "产品合规标签")


def _typed_records(li):
    """Records of three types, with repeated keys, from order lines."""
    kind = F.when(F.col("l_returnflag") == "A", "bidding").when(F.col("l_returnflag") == "R", "customer").otherwise("investment")
    some = lambda c, x: F.when(c, x).otherwise("")
    given = {
        "enterprise_name": F.concat(F.lit("E"), (F.col("l_suppkey") % 10).cast("string")), "seg": F.col("l_orderkey"), "pos": F.col("l_linenumber").cast("long"), "record_type": kind,
        "counterparty": F.concat(F.lit("S"), (F.col("l_suppkey") % 50).cast("string")), "project_name": some(F.col("l_partkey") % 3 > 0, F.concat(F.lit("P"), (F.col("l_partkey") % 40).cast("string"))),
        "amount": some(F.col("l_discount") > 0.05, F.floor("l_extendedprice").cast("string")), "bid_date": some(F.col("l_linestatus") == "F", F.date_format("l_shipdate", "yyyy-MM-dd")),
        "products": some(F.col("l_quantity") > 30, F.lit("轴承")), "evidence_text": some(F.col("l_tax") > 0.04, F.lit("text")), "source_platform": F.when(F.col("l_quantity") < 10, "中国政府采购网").otherwise("企业官网"),
    }
    plain = {"confidence": F.lit(0.5), "is_current": F.lit(True)}
    return li.select(*[(given[c] if c in given else plain[c] if c in plain else F.lit("")).alias(c) for c in facts.COLUMNS])


# rows of one place: by the columns in order; the platform of the greater bonus is the lesser name
_RECORDS = """r AS (SELECT 'E' || (l_suppkey % 10) AS enterprise_name, l_orderkey AS seg, l_linenumber AS pos, CASE l_returnflag WHEN 'A' THEN 'bidding' WHEN 'R' THEN 'customer' ELSE 'investment' END AS record_type, 'S' || (l_suppkey % 50) AS counterparty,
    CASE WHEN l_partkey % 3 > 0 THEN 'P' || (l_partkey % 40) ELSE '' END AS project_name, CASE WHEN l_discount > .05 THEN CAST(CAST(floor(l_extendedprice) AS BIGINT) AS VARCHAR) ELSE '' END AS amount, CASE WHEN l_linestatus = 'F' THEN strftime(l_shipdate, '%Y-%m-%d') ELSE '' END AS bid_date,
    CASE WHEN l_quantity > 30 THEN '轴承' ELSE '' END AS products, CASE WHEN l_tax > .04 THEN 'text' ELSE '' END AS evidence_text, CASE WHEN l_quantity < 10 THEN .15 ELSE .05 END::DOUBLE AS bonus FROM lineitem),
    k AS (SELECT *, CASE record_type WHEN 'bidding' THEN counterparty || chr(1) || project_name WHEN 'customer' THEN counterparty ELSE project_name END AS key,
        CASE record_type WHEN 'bidding' THEN (project_name <> '')::INT + 1 + (amount <> '')::INT + (bid_date <> '')::INT + (products <> '')::INT WHEN 'customer' THEN 1 + (products <> '')::INT + (evidence_text <> '')::INT ELSE (project_name <> '')::INT + (amount <> '')::INT + (bid_date <> '')::INT END AS filled FROM r),
    d AS (SELECT *, min({'seg': seg, 'pos': pos, 'counterparty': counterparty}) OVER g AS place, round_even(least(.98::DOUBLE, .6::DOUBLE + bonus + CASE record_type WHEN 'bidding' THEN CASE WHEN amount <> '' THEN .05 ELSE 0 END::DOUBLE + .05::DOUBLE + CASE WHEN project_name <> '' THEN .03 ELSE 0 END::DOUBLE + CASE WHEN bid_date <> '' THEN .03 ELSE 0 END::DOUBLE + CASE WHEN products <> '' THEN .02 ELSE 0 END::DOUBLE
        WHEN 'customer' THEN .08::DOUBLE + CASE WHEN products <> '' THEN .05 ELSE 0 END::DOUBLE + CASE WHEN evidence_text <> '' THEN .05 ELSE 0 END::DOUBLE ELSE CASE WHEN amount <> '' THEN .08 ELSE 0 END::DOUBLE + CASE WHEN project_name <> '' THEN .05 ELSE 0 END::DOUBLE + CASE WHEN bid_date <> '' THEN .03 ELSE 0 END::DOUBLE END), 2) AS confidence
        FROM k WINDOW g AS (PARTITION BY enterprise_name, record_type, key) QUALIFY row_number() OVER (PARTITION BY enterprise_name, record_type, key ORDER BY filled DESC, seg, pos, counterparty, project_name, bid_date, amount, products, evidence_text, bonus DESC) = 1),
    n AS (SELECT *, CASE record_type WHEN 'bidding' THEN 'BID-' WHEN 'customer' THEN 'CUS-' ELSE 'INV-' END || printf('%03d', row_number() OVER (PARTITION BY enterprise_name, record_type ORDER BY place, key)) AS record_id FROM d)"""


def _numbered(li):
    return facts.with_ids(facts.with_confidence(facts.dedup_records(_typed_records(li))))


@query("j18_dedup_records", "lineitem", f"WITH {_RECORDS} SELECT enterprise_name, record_type, record_id, seg, pos, project_name, amount, confidence FROM n")
def _(li):
    return _numbered(li).select("enterprise_name", "record_type", "record_id", "seg", "pos", "project_name", "amount", "confidence")


@query("j21_fact_summary", "lineitem,customer", f"""WITH {_RECORDS}, s AS (SELECT enterprise_name, count(*) AS total_records, count(*) FILTER (record_type = 'bidding') AS bidding_records, count(*) FILTER (record_type = 'customer') AS customer_records, count(*) FILTER (record_type = 'investment') AS investment_records, round_even(avg(confidence), 2) AS extraction_confidence FROM n GROUP BY 1)
    SELECT 'E' || c_custkey AS enterprise_name, c_acctbal > 0 AS has_official_website, c_nationkey % 2 = 0 AS has_bidding_info, coalesce(total_records, 0) AS total_records, coalesce(bidding_records, 0) AS bidding_records, coalesce(customer_records, 0) AS customer_records, coalesce(investment_records, 0) AS investment_records, coalesce(extraction_confidence, 0) AS extraction_confidence FROM customer LEFT JOIN s ON enterprise_name = 'E' || c_custkey""")
def _(li, c):
    companies = c.select(F.concat(F.lit("E"), F.col("c_custkey").cast("string")).alias("enterprise_name"), F.when(F.col("c_acctbal") > 0, F.col("c_name")).otherwise("").alias("official_website"), F.when(F.col("c_nationkey") % 2 == 0, F.col("c_name")).alias("bidding_info"))
    return facts.fact_summary(companies, _numbered(li), "enterprise_name", ["bidding", "customer", "investment"], ["official_website", "bidding_info"])


@query("s9c_fact_details", "lineitem", f"""WITH {_RECORDS} SELECT CASE record_type WHEN 'bidding' THEN '招投标' WHEN 'customer' THEN '客户关系' ELSE '投资项目' END AS record_type, record_id, counterparty, project_name, CASE record_type WHEN 'bidding' THEN '招投标' WHEN 'customer' THEN '客户关系' ELSE '投资项目' END AS relation, CASE record_type WHEN 'customer' THEN '供应商' ELSE '' END AS role, products,
    CASE record_type WHEN 'bidding' THEN enterprise_name ELSE '' END AS product_detail, amount, '' AS amount_unit, bid_date, '' AS region, '' AS counterparty_industry, '原始文本' AS evidence_type, CASE WHEN bonus > .1 THEN '中国政府采购网' ELSE '企业官网' END AS source_platform, confidence FROM n ORDER BY n.record_type, n.confidence DESC, n.record_id, n.enterprise_name""")
def _(li):
    rows = _numbered(li).withColumns({"relationship_nature": F.when(F.col("record_type") == "customer", "供应商"), "product_detail": F.col("enterprise_name"), "spec": F.lit(None).cast("string")})
    return crawl.detail_sheet(rows)


@query("s9c_fact_totals", "lineitem", f"WITH {_RECORDS} SELECT '共' || count(*) || '条记录' AS total, '招投标:' || count(*) FILTER (record_type = 'bidding') || '、客户关系:' || count(*) FILTER (record_type = 'customer') || '、投资项目:' || count(*) FILTER (record_type = 'investment') AS by_type FROM n")
def _(li):
    return crawl.detail_summary(_numbered(li))


@query("s9d_data_dictionary", "supplier", """SELECT * FROM (SELECT 's_suppkey' AS field, 'suppliers' AS sheet, '数值' AS type, 'key' AS description, count(s_suppkey) AS filled FROM supplier UNION ALL SELECT 's_name', 'suppliers', '文本', 'name', count(nullif(s_name, '')) FROM supplier
    UNION ALL SELECT 's_nationkey', 'suppliers', '数值', '', count(s_nationkey) FROM supplier UNION ALL SELECT 's_acctbal', 'suppliers', '数值', '', count(s_acctbal) FROM supplier)""")
def _(s):
    return crawl.data_dictionary(s, "suppliers", {"s_suppkey": "key", "s_name": "name"})


@query("s10_source_config", "part", """SELECT CAST(row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS INTEGER) AS place, '{"id":' || p_partkey || ',"name":"' || p_name || '","data_types":["' || p_type || '","' || p_brand || '"],"enabled":' || CASE WHEN p_size > 5 THEN 'true' ELSE 'false' END || '}' AS source FROM part""")
def _(p):
    rows = p.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.array("p_type", "p_brand").alias("data_types"), (F.col("p_size") > 5).alias("enabled"), "p_retailprice")
    return crawl.config_rows(rows, ["id", "name", "data_types", "enabled"], "p_retailprice", "id")


@query("s11_table_param", "supplier", "SELECT s_suppkey, s_name FROM supplier")
def _(s):
    """Under a table name that is given and checked, read back; the table goes again."""
    name = f"facts_{uuid.uuid4().hex}"
    kept = io.saved(io.save_as(s.select("s_suppkey", "s_name"), name))
    s.sparkSession.sql(f"DROP TABLE {name}")
    return kept


# Links, discovery and configuration

_ROOT = "regexp_extract(url, '^([^:/?#]+://[^/?#]*)', 1)"


@query("p8_page_links", "pages", f"""WITH l AS (SELECT page_id, unnest([url] || [{_ROOT} || x FOR x IN regexp_extract_all(html, '(?i)href=["''](/[^"'']*)["'']', 1)]) AS x FROM pages WHERE contains(url, '://'))
    SELECT DISTINCT page_id, regexp_replace(x, '#.*$', '') AS link FROM l WHERE length(regexp_replace(x, '#.*$', '')) > 10""")
def _(p):
    pages = p.where("contains(url, '://')").withColumn("html", F.concat("html", F.lit("<p><cite>"), F.regexp_replace("url", "://", "<b></b>://"), F.lit("</cite>")))
    return web.page_links(pages, []).select("page_id", "link")


@query("p10_serp_links", "pages", """WITH e AS (SELECT page_id, page_id % 6 AS e, regexp_replace(url, '[?#].*$', '') AS u FROM pages WHERE contains(url, '://'))
    SELECT page_id, unnest(CASE WHEN e = 0 THEN [u, u || 'x/cite'] WHEN e IN (1, 2, 3) THEN [u, u || 'x/two', u || 'x/cite'] ELSE [u, u || 'x/two', u || 'x/three', u || 'x/cite'] END) AS link FROM e""")
def _(p):
    """Result pages with one link of the engine's kind and others, of which the engines' patterns take their own."""
    rows = p.where("contains(url, '://')").withColumns({"e": F.col("page_id") % 6, "u": F.regexp_replace("url", "[?#].*$", "")})
    kinds = ["百度", "必应", "搜狗", "360搜索"]
    engine = F.coalesce(F.get(words_array(kinds), F.col("e").cast("int")), F.lit("其他"))
    a = lambda tail, more: F.concat(F.lit('<a href="'), "u", F.lit(f'{tail}"{more}>t</a>'))
    first = F.when(F.col("e") == 0, F.concat(F.lit('<p data-url="'), "u", F.lit('"></p>'))).when(F.col("e") == 1, a("", ' class="b_algo"')).when(F.col("e") == 2, a("?q=1", ' class="vr-title"')).when(F.col("e") == 3, a("#f", ' class="x res-title"')).otherwise(a("", ""))
    others = F.when(F.col("e") == 0, "").when(F.col("e") < 4, a("x/two", "")).otherwise(F.concat(a("x/two", ""), a("x/three", "")))
    html = F.concat(first, others, F.lit("<cite>"), "u", F.lit("x/cite</cite>"))
    return crawl.result_links(rows.select("page_id", engine.alias("engine"), html.alias("html")), "page_id", "html", "engine", []).select("page_id", "link")


@query("p15_link_priority_topk", "pages", f"""WITH l AS (SELECT page_id, url, {DOMAIN} AS site, unnest([{_ROOT} || x FOR x IN regexp_extract_all(html, '(?i)href=["''](/[^"'']*)["'']', 1)]) AS x FROM pages WHERE contains(url, '://')),
    o AS (SELECT page_id, site, regexp_replace(x, '#.*$', '') AS link FROM l WHERE length(regexp_replace(x, '#.*$', '')) > 10 AND regexp_replace(x, '#.*$', '') <> url AND contains(x, site)),
    d AS (SELECT site, link, min(page_id) AS first FROM o GROUP BY ALL), q AS (SELECT *, contains(lower(link), 'the') OR contains(lower(link), 'un') AS priority FROM d)
    SELECT site, link, priority FROM q QUALIFY row_number() OVER (PARTITION BY site, priority ORDER BY first, link) <= CASE WHEN priority THEN 6 ELSE 2 END""")
def _(p):
    own = p.where("contains(url, '://')").select("page_id", "url", web.domain(F.col("url")).alias("site"))
    links = web.page_links(p.where("contains(url, '://')"), []).join(own.hint("merge"), "page_id")
    return web.deep_targets(links, "site", "url", ["page_id"], ["the", "un"]).select("site", "link", "priority")


@query("c8_enough_results_cap", "lineitem", """WITH i AS (SELECT l_suppkey, l_linenumber, l_orderkey FROM lineitem WHERE l_quantity > 45 QUALIFY row_number() OVER (PARTITION BY l_suppkey, l_linenumber ORDER BY l_orderkey, l_partkey) <= 3),
    b AS (SELECT l_suppkey, l_linenumber, count(*) AS n FROM i GROUP BY ALL), a AS (SELECT *, row_number() OVER w AS place, coalesce(sum(n) OVER (PARTITION BY l_suppkey ORDER BY l_linenumber ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM b WINDOW w AS (PARTITION BY l_suppkey ORDER BY l_linenumber)),
    k AS (SELECT * FROM a WHERE place <= 3 AND before < 2), f AS (SELECT l_suppkey FROM k GROUP BY 1 HAVING sum(n) >= 2)
    SELECT i.l_suppkey, i.l_linenumber, i.l_orderkey FROM i SEMI JOIN k USING (l_suppkey, l_linenumber) UNION ALL SELECT l_suppkey, l_linenumber, l_orderkey FROM lineitem WHERE l_quantity < 2 AND l_suppkey NOT IN (FROM f)""")
def _(li):
    rows = li.select("l_suppkey", "l_linenumber", "l_orderkey", "l_partkey", "l_quantity")
    return crawl.enough(rows.where("l_quantity > 45"), "l_suppkey", "l_linenumber", ["l_orderkey", "l_partkey"], rows.where("l_quantity < 2")).select("l_suppkey", "l_linenumber", "l_orderkey")


_PAGES = "SELECT source, lang, doc_id, '【来源: ' || source[1:80] || '】' || chr(10) || text[1:5000] || chr(10) || chr(10) AS x FROM documents WHERE text IS NOT NULL AND source IS NOT NULL AND lang IN ('en', 'de', 'fr', 'es')"
_BARE = "nullif(regexp_replace({}, '^\\s+|\\s+$', '', 'g'), '')"


@query("c2_categorize_concat", "documents", f"""WITH k AS (SELECT source, {', '.join(f"coalesce(string_agg(x, '' ORDER BY doc_id) FILTER (lang = '{c}'), '') AS {c}" for c in ('en', 'de', 'fr', 'es'))} FROM ({_PAGES}) GROUP BY 1)
    SELECT *, concat_ws(chr(10) || chr(10), {', '.join(_BARE.format(c) for c in ('en', 'de', 'fr', 'es'))}) AS all_content FROM k""")
def _(d):
    return crawl.assemble(d, "source", "lang", ["en", "de", "fr", "es"], "source", "text", "doc_id")


@query("c2_page_blocks", "documents", f"SELECT source AS key, lang AS category, doc_id AS seq, x AS block FROM ({_PAGES})")
def _(d):
    return crawl.blocks(d, "source", "lang", ["en", "de", "fr", "es"], "source", "text", "doc_id")


@query("d1_discover_sites", "pages", f"""WITH p AS (SELECT page_id, url, {DOMAIN} AS domain, page_id % 10 <> 0 AS hit FROM pages), f AS (SELECT domain, arg_min(url, hit::INT * 1000000000 + page_id) AS url, min(hit::INT * 1000000000 + page_id) AS seq FROM p WHERE domain <> '' GROUP BY 1),
    s AS (SELECT domain, url, 'seed' AS source FROM f WHERE seq < 1000000000), h AS (SELECT domain, url, 'search' AS source FROM f WHERE seq >= 1000000000 QUALIFY row_number() OVER (ORDER BY seq) <= greatest(0, 24 - (SELECT count(*) FROM s))) FROM s UNION ALL FROM h""")
def _(p):
    rows = p.select("page_id", "url", web.domain(F.col("url")).alias("domain"))
    return scoring.discover(rows.where("page_id % 10 = 0"), rows.where("page_id % 10 <> 0"), "domain", "page_id", 12).select("domain", "url", "source")


@query("d16_category_distribution", "pages", f"SELECT {DOMAIN} AS kind, count(*) AS n FROM pages GROUP BY 1")
def _(p):
    return scoring.distribution(p, web.domain(F.col("url")))


@query("d17_evaluation_summary", "pages", f"SELECT count(DISTINCT {DOMAIN}) AS total_discovered, count(*) FILTER (page_id % 2 = 0) AS total_evaluated, count(*) FILTER (page_id % 2 = 0) >= 20 AS top20_selected FROM pages")
def _(p):
    rows = p.select("page_id", web.domain(F.col("url")).alias("domain"))
    return scoring.evaluation_summary(rows, rows.where("page_id % 2 = 0"), "domain")


@query("d24_resume_pending", "pages", f"""SELECT 'site' AS kind, domain AS key FROM (SELECT DISTINCT {DOMAIN} AS domain FROM pages) WHERE domain NOT IN (SELECT {DOMAIN} FROM pages WHERE page_id % 3 = 0)
    UNION ALL SELECT DISTINCT 'keyword', w FROM (SELECT unnest(string_split(regexp_extract(html, '<title>([^<]*)', 1), ' ')) AS w FROM pages) WHERE w <> '' AND w NOT IN (SELECT unnest(string_split(regexp_extract(html, '<title>([^<]*)', 1), ' ')) FROM pages WHERE page_id % 3 = 0)""")
def _(p):
    sites_ = p.select("page_id", web.domain(F.col("url")).alias("key"))
    words = p.select("page_id", F.explode(F.split(F.regexp_extract("html", "<title>([^<]*)", 1), " ")).alias("key")).where("key <> ''")
    left = lambda rows, kind: scoring.pending(rows.select("key").distinct(), rows.where("page_id % 3 = 0"), "key").select(F.lit(kind).alias("kind"), "key")
    return left(sites_, "site").unionByName(left(words, "keyword"))


def _sources(p):
    kinds = F.filter(F.array(F.when(F.col("p_size") % 2 == 0, "bidding_info"), F.when(F.col("p_size") % 3 == 0, "business_info"), F.when(F.col("p_size") % 5 == 0, "patent_info"), F.lit("other")), lambda x: x.isNotNull())
    return p.where("p_retailprice > 910").select(F.col("p_partkey").alias("seq"), F.col("p_name").alias("name"), kinds.alias("data_types"), F.concat(F.lit("https://www.site"), (F.col("p_partkey") % 40).cast("string"), F.lit(".org/x")).alias("base_url"), F.when(F.col("p_size") > 20, F.lit("https://s/{name}")).alias("template"), F.split("p_type", " ").alias("keywords"))


_SOURCES = """s AS (SELECT p_partkey AS seq, p_name AS name, unnest(list_filter([CASE WHEN p_size % 2 = 0 THEN 'bidding_info' END, CASE WHEN p_size % 3 = 0 THEN 'business_info' END, CASE WHEN p_size % 5 = 0 THEN 'patent_info' END, 'other'], lambda x: x IS NOT NULL)) AS type, 'site' || (p_partkey % 40) || '.org' AS domain, p_size > 20 AS has, string_split(p_type, ' ') AS keywords FROM part WHERE p_retailprice > 910)"""


@query("d26_config_load", "part", f"WITH {_SOURCES}, r AS (SELECT domain, CASE type WHEN 'business_info' THEN 1 WHEN 'bidding_info' THEN 2 WHEN 'patent_info' THEN 3 END AS rank FROM s) SELECT domain, CASE min(rank) WHEN 1 THEN 'business_info' WHEN 2 THEN 'bidding_info' ELSE 'patent_info' END AS type FROM r WHERE rank IS NOT NULL GROUP BY 1")
def _(p):
    return crawl.domain_types(_sources(p), "base_url", "data_types", "seq")


@query("d26_config_keywords", "part", f"WITH {_SOURCES} SELECT DISTINCT type, unnest(keywords) AS keyword FROM s")
def _(p):
    return crawl.type_keyword_sets(_sources(p), "data_types", "keywords")


@query("d26_config_platforms", "part", f"WITH {_SOURCES} SELECT type, seq, name, 'https://s/{{name}}' AS template FROM s WHERE has")
def _(p):
    return crawl.platforms(_sources(p), "data_types", "name", "template", "seq")


# Text

_NAV = ["the", "that", "with", "tion", "ing"]
_COUNT = "(" + " + ".join(f"contains(sentence, '{w}')::INT" for w in _NAV) + ")"
_NOISE = f"({_COUNT} >= 3 OR (length(sentence) < 30 AND regexp_full_match(sentence, '[a-zA-Z\\s&;,.>/=_()-]+')) OR regexp_matches(sentence, '^(?:The|Und) ') OR (length(sentence) < 50 AND regexp_matches(sentence, '[0-9]{{3,}}')))"


@query("e3_noise_line_filter", "documents", f"WITH {LINES} SELECT doc_id, CAST(pos AS INTEGER) AS pos, sentence FROM s JOIN documents USING (doc_id) WHERE NOT {_NOISE} OR (contains(coalesce(source, ''), 'a') AND {_COUNT} < 5)")
def _(d):
    lines = text.sentences(d, r"[.;\n]", carry=["source"])
    return text.noise_lines(lines, _NAV, ["^(?:The|Und) "], "[0-9]{3,}", high=F.coalesce(F.col("source"), F.lit("")).contains("a")).drop("source")


@query("e5_scrub_text", "pages", "SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '<[^>]+>', '', 'g'), '&[A-Za-z]+;', ' ', 'g'), '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F]', '', 'g'), '[ \\t]+', ' ', 'g'), ' ' || chr(9) || chr(10) || chr(13)) AS text FROM pages")
def _(p):
    marked = F.concat(F.lit("【企业官网内容】【来源: https://a.org/x】"), "html", F.lit("【来源：b】"))
    return p.select("page_id", text.scrub(marked).alias("text"))


_KEY = "regexp_replace(sentence, '\\s+', '', 'g')"


@query("e11_drop_repeated_paragraphs", "documents", f"WITH {LINES} SELECT s.doc_id, CAST(pos AS INTEGER) AS pos, sentence FROM s JOIN documents USING (doc_id) QUALIFY count(*) OVER (PARTITION BY s.doc_id, {_KEY}) < 2 OR length({_KEY}) <= 20 OR length(text) <= 300")
def _(d):
    lines = text.sentences(d, r"[.;\n]", carry=[F.length("text").alias("size")])
    return text.drop_repeats(lines, size=F.col("size")).drop("size")


_DIMS = {"english": ["the", "that"], "german": ["und", "sch"], "spanish": ["los"]}
_SURE = "round_even(least(CAST(.9 AS DOUBLE) + least(length(text) / 100, CAST(.05 AS DOUBLE)), CAST(.99 AS DOUBLE)), 2)"
_HAS = {k: "[w FOR w IN [" + ", ".join(f"'{w}'" for w in ws) + "] IF contains(lower(text), w)]" for k, ws in _DIMS.items()}


@query("g16_tag_summary", "documents", f"""WITH t AS (SELECT doc_id, {_SURE} AS c, {' + '.join(f'len({x})' for x in _HAS.values())} AS n, list_filter([{', '.join(f"CASE WHEN len({x}) = 0 THEN '{k}' END" for k, x in sorted(_HAS.items()))}], lambda x: x IS NOT NULL) AS u FROM documents WHERE text <> ''),
    c AS (SELECT *, CASE WHEN n > 0 THEN c ELSE 0 END AS confidence FROM t)
    SELECT doc_id, confidence, n AS n_tags, len(u) AS n_uncertain, array_to_string([x || '-未明确' FOR x IN u], ',') AS uncertain, CASE WHEN confidence >= .9 THEN '标签生成正常，核心标签基于模块2结构化字段' WHEN confidence >= .7 THEN '标签生成部分完成，部分字段缺失影响标签覆盖' ELSE '标签生成受限，多数字段缺失' END
        || CASE WHEN len(u) > 0 THEN '；未明确标签' || len(u) || '项：' || array_to_string([x || '：缺少text' FOR x IN u], '; ') ELSE '' END AS note FROM c""")
def _(d):
    rows = None
    for k, ws in _DIMS.items():
        part = tags.tag_rows(d.where("text <> ''"), "doc_id", "language", k, tags.keyword_tags(F.col("text"), {w: w for w in ws}), "text", 0.9)
        rows = part if rows is None else rows.unionByName(part)
    return tags.tag_summary(rows, "doc_id")


# Records of transactions

_OTHERS = ["金风科技股份有限公司", "株洲中车电机工业有限公司", "大连汽车装备有限公司", "北方矿山机械有限公司", "东方铁路轴承有限公司"]
_PICK = "['" + "', '".join(_OTHERS) + "'][1 + o_orderkey % 5]"
_PRICE = "CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR)"
_SMALL = "(o_orderkey % 20000 + 17)"


def _bids(o):
    """Segments of one sentence each, from orders: date, own name, another's, project, region, result and amount."""
    k, price = F.col("o_orderkey"), F.floor("o_totalprice").cast("string")
    other = F.get(words_array(_OTHERS), (k % 5).cast("int"))
    money = F.when(k % 3 == 0, F.concat(F.lit("成交金额"), price, F.lit("万元"))).when(k % 3 == 1, F.concat(F.lit("总价"), (k % 20000 + 17).cast("string"), F.lit("元"))).otherwise(F.concat(F.lit("约"), price, F.lit(".5亿元")))
    place = F.when(k % 4 == 0, "河南").when(k % 4 == 1, "北京").otherwise("本地")
    s = F.concat(F.date_format("o_orderdate", "yyyy年M月d日"), F.lit(", 洛阳轴承有限公司, "), other, F.lit(", 项目名称：第"), k.cast("string"), F.lit("号采购, "), place, F.when(k % 2 == 0, ", 中标, ").otherwise(", "), money)
    none = F.lit(None).cast("string")
    return o.select(F.lit("洛阳轴承有限公司").alias("enterprise_name"), k.alias("seg"), s.alias("text"), F.lit("bidding_info").alias("source_type"), F.lit("").alias("source_url"), F.lit("招投标平台").alias("source_platform"), none.alias("cooperative_enterprise"), none.alias("core_products"))


_AMOUNT = f"CASE o_orderkey % 3 WHEN 0 THEN {_PRICE} WHEN 2 THEN {_PRICE} || '.5' ELSE CASE WHEN {_SMALL} >= 10000 THEN CAST(round_even({_SMALL} / 10000, 1) AS VARCHAR) ELSE CAST({_SMALL} AS VARCHAR) END END"
_UNIT = f"CASE WHEN o_orderkey % 3 = 0 OR (o_orderkey % 3 = 1 AND {_SMALL} >= 10000) THEN '万元' WHEN o_orderkey % 3 = 2 THEN '亿元' ELSE '元' END"
_RAW = f"CASE o_orderkey % 3 WHEN 0 THEN '成交金额' || {_PRICE} || '万元' WHEN 2 THEN {_PRICE} || '.5亿元' ELSE '总价' || {_SMALL} || '元' END"


@query("j4_bidding_record", "orders", f"""SELECT o_orderkey AS seg, {_PICK} AS counterparty, CASE o_orderkey % 5 WHEN 0 THEN '风力发电行业' WHEN 1 THEN '轨道交通行业' WHEN 2 THEN '汽车工业' WHEN 3 THEN '矿山机械' ELSE '轨道交通' END AS counterparty_industry, '第' || o_orderkey || '号采购' AS project_name, CASE WHEN o_orderkey % 2 = 0 THEN '中标' WHEN o_orderkey % 3 = 0 THEN '成交' ELSE '采购' END AS subtype,
    CASE WHEN o_orderkey % 2 = 0 THEN '中标方' ELSE '招标方' END AS role, strftime(o_orderdate, '%Y-%m-%d') AS bid_date, CASE o_orderkey % 4 WHEN 0 THEN '河南省' WHEN 1 THEN '北京市' ELSE '' END AS region, {_AMOUNT} AS amount, {_UNIT} AS amount_unit, {_RAW} AS amount_raw, '人民币' AS currency, '轴承' AS products FROM orders""")
def _(o):
    return facts.bidding_records(_bids(o)).select("seg", "counterparty", "counterparty_industry", "project_name", "subtype", "role", "bid_date", "region", "amount", "amount_unit", "amount_raw", "currency", "products")


@query("j6_parse_amount", "orders", f"SELECT o_orderkey, {_AMOUNT} AS amount, {_UNIT} AS unit, {_RAW} AS raw, '人民币' AS currency FROM orders")
def _(o):
    return _bids(o).select(F.col("seg").alias("o_orderkey"), tags.parse_amount(F.col("text")).alias("x")).select("o_orderkey", "x.*")


@query("j9_bid_type_and_role", "orders", "SELECT o_orderkey, CASE WHEN o_orderpriority LIKE '%URGENT%' THEN 'urgent' WHEN o_orderpriority LIKE '%LOW%' THEN 'low' ELSE 'plain' END AS bid_type, CASE WHEN o_orderpriority NOT LIKE '%URGENT%' AND o_orderstatus = 'F' THEN 'buyer' ELSE 'winner' END AS role FROM orders")
def _(o):
    s = F.concat(F.lit("before Firm "), "o_orderpriority", F.lit(" "), "o_orderstatus")
    return o.select("o_orderkey", map_first(F.col("o_orderpriority"), [("urgent", ["URGENT"]), ("low", ["LOW"])], "plain").alias("bid_type"), facts.bid_role(s, F.lit("Firm"), "URGENT", (" F",), ("winner", "buyer")).alias("role"))


@query("j11_products_and_region", "nation", "SELECT n_nationkey, CASE WHEN n_nationkey % 3 = 0 THEN '滚子' WHEN n_nationkey % 3 = 1 THEN '轴承' ELSE '' END AS product, CASE n_nationkey % 4 WHEN 0 THEN '天津市' WHEN 1 THEN '山西省' ELSE '' END AS region FROM nation")
def _(n):
    k = F.col("n_nationkey")
    s = F.concat("n_name", F.when(k % 3 == 0, "滚子钢").when(k % 3 == 1, "滚子和轴承").otherwise(""), F.when(k % 4 == 0, "山西天津").when(k % 4 == 1, "江西山西").otherwise(""))
    return n.select("n_nationkey", facts._first_word(s, ["轴承", "滚子"]).alias("product"), facts.region(s, ["天津", "山西", "江西"]).alias("region"))


@query("j13_counterparty_industry", "supplier", "SELECT s_suppkey, CASE s_suppkey % 5 WHEN 0 THEN '工程机械行业' WHEN 1 THEN '冶金行业' WHEN 2 THEN '石油装备' WHEN 3 THEN '机床工具' ELSE '' END AS industry FROM supplier")
def _(s):
    k = F.col("s_suppkey") % 5
    name = F.when(k == 0, F.lit("徐工")).when(k == 1, F.concat(F.lit("鞍钢"), "s_name")).when(k == 3, "").otherwise(F.col("s_name"))
    sentence = F.when(k == 3, F.lit("采购机床")).when(k == 4, F.lit("采购")).otherwise(F.lit("石油项目"))
    return s.select("s_suppkey", facts.counterparty_industry(name, sentence).alias("industry"))


_OWN = "coalesce(source, '?')"
_SENT = "s AS (SELECT doc_id, {own} AS own, pos - 1 AS pos, trim(x) AS sentence FROM (SELECT doc_id, source, unnest(string_split_regex(text, '[。；\\n]')) AS x, generate_subscripts(string_split_regex(text, '[。；\\n]'), 1) AS pos FROM documents) WHERE length(trim(x)) >= 10 AND regexp_matches(x, '{words}'))"
_NAMES = "list_distinct([x FOR x IN regexp_extract_all(sentence, '([A-Z][a-z]{4,})', 1) IF NOT contains(x, own)] || [x FOR x IN ['Theth', 'Ing'] IF contains(sentence, x) AND NOT contains(own, x)])"
_ENGLISH = {"patterns": ["([A-Z][a-z]{4,})"], "known": ["Theth", "Ing"], "industries": {"Theth": "x"}}
_X = "CASE WHEN name = 'Theth' THEN 'x' ELSE '' END"


def _segments(d):
    own = F.coalesce("source", F.lit("?"))
    return d.select(own.alias("enterprise_name"), F.col("doc_id").alias("seg"), "text", F.lit("official_website").alias("source_type"), F.lit("u").alias("source_url"), F.lit("").alias("source_platform"), F.when(F.col("doc_id") % 2 == 0, F.lit("Alpha、Be,x")).otherwise("未明确").alias("cooperative_enterprise"), F.col("lang").alias("core_products"))


@query("j14_customer_records", "documents", f"""WITH {_SENT.format(own=_OWN, words='tion|ing')}, n AS (SELECT *, unnest({_NAMES}) AS name FROM s), f AS (SELECT doc_id, lang, unnest(['Alpha', 'Be']) AS name FROM documents WHERE text IS NOT NULL AND doc_id % 2 = 0 AND doc_id NOT IN (SELECT doc_id FROM s))
    SELECT doc_id AS seg, name AS counterparty, {_X} AS counterparty_industry, coalesce(CASE WHEN contains(sentence, 'ring') THEN 'ring' WHEN contains(sentence, 'ment') THEN 'ment' END, (SELECT lang FROM documents d WHERE d.doc_id = n.doc_id), '') AS products, '官网提及' AS evidence_type, sentence[1:100] AS evidence_text, .85::DOUBLE AS confidence FROM n
    UNION ALL SELECT doc_id, name, '', coalesce(lang, ''), '结构化字段', '合作企业列表中包含' || name, .7 FROM f""")
def _(d):
    return facts.customer_records(_segments(d), ["tion", "ing"], products=["ring", "ment"], **_ENGLISH).select("seg", "counterparty", "counterparty_industry", "products", "evidence_type", "evidence_text", "confidence")


@query("j15_supplier_records", "documents", f"WITH {_SENT.format(own=_OWN, words='ment|by.*?the')}, n AS (SELECT *, unnest({_NAMES}) AS name FROM s) SELECT doc_id AS seg, pos, name AS counterparty, {_X} AS counterparty_industry, '采购方' AS relationship_nature, sentence[1:100] AS evidence_text, .82::DOUBLE AS confidence FROM n")
def _(d):
    return facts.supplier_records(_segments(d), ["ment", "by.*?the"], **_ENGLISH).select("seg", "pos", "counterparty", "counterparty_industry", "relationship_nature", "evidence_text", "confidence")


@query("j16_partnership_records", "documents", f"WITH {_SENT.format(own=_OWN, words='und|les')}, n AS (SELECT *, unnest({_NAMES}) AS name FROM s) SELECT doc_id AS seg, pos, name AS counterparty, CASE WHEN contains(sentence, 'sch') THEN 'a' WHEN contains(sentence, 'eux') OR contains(sentence, 'oi') THEN 'b' ELSE 'c' END AS subtype, .88::DOUBLE AS confidence FROM n")
def _(d):
    return facts.partnership_records(_segments(d), ["und", "les"], types=[("a", ["sch"]), ("b", ["eux", "oi"])], default="c", **_ENGLISH).select("seg", "pos", "counterparty", "subtype", "confidence")


@query("j17_investment_records", "orders", f"""SELECT o_orderkey AS seg, {_PRICE} AS amount, CASE WHEN o_orderkey % 3 = 0 THEN '亿元' ELSE '万元' END AS amount_unit, CASE WHEN o_orderkey % 5 = 0 THEN strftime(o_orderdate, '%Y') ELSE strftime(o_orderdate, '%Y-%m') END AS bid_date, CASE WHEN o_orderkey % 2 = 0 THEN '新建' WHEN o_orderkey % 7 = 0 THEN '建设' ELSE '扩建' END AS subtype, '精密' AS products FROM orders""")
def _(o):
    k = F.col("o_orderkey")
    s = F.concat(F.date_format("o_orderdate", "yyyy年"), F.when(k % 5 == 0, "").otherwise(F.date_format("o_orderdate", "M月")), F.when(k % 2 == 0, "新增").when(k % 7 == 0, "建设").otherwise("扩建"), F.lit("精密产品生产线项目，总投资"), F.floor("o_totalprice").cast("string"), F.when(k % 3 == 0, "亿元").otherwise("万元"))
    return facts.investment_records(_bids(o).drop("text").join(o.select(k.alias("seg"), s.alias("text")).hint("merge"), "seg")).select("seg", "amount", "amount_unit", "bid_date", "subtype", "products")


# Edges

_KINDS = "CASE o_orderpriority[1:1] WHEN '1' THEN '客户' WHEN '2' THEN '供应商' WHEN '3' THEN '招投标' ELSE '合作' END"


@query("i5_classify_relations", "orders", f"""WITH t AS (SELECT 'O' || o_custkey AS own, CASE WHEN o_orderkey % 3 = 0 THEN '轴承厂' ELSE '公司' END || o_orderkey AS name, {_KINDS} AS kind, o_orderkey % 3 = 0 AS makes, o_custkey % 2 = 0 AS own_makes, CASE WHEN o_orderkey % 2 = 0 THEN '工业' ELSE '' END AS industry, {_PRICE} || CASE WHEN o_orderkey % 5 = 0 THEN '元' ELSE '万元' END AS amount FROM orders),
    c AS (SELECT *, CASE WHEN kind = '客户' THEN 1 WHEN kind = '招投标' AND NOT makes THEN 2 WHEN kind = '供应商' OR (own_makes AND makes) THEN 3 WHEN kind = '招投标' THEN 4 ELSE 5 END AS k FROM t)
    SELECT own AS subject, name AS object, ['客户', '客户', '供应商', '客户', '合作'][k] AS rel_type, CASE k WHEN 3 THEN name || '为' || own || '提供轴承相关产品/技术' WHEN 4 THEN own || '与' || name || '存在招投标业务关系' WHEN 5 THEN own || '与' || name || '存在合作关系' ELSE own || '为' || name || '提供产品/服务' END AS description, '' AS project, amount, industry,
        '原始文本匹配；上下文:' || kind || CASE WHEN industry <> '' THEN '；行业:' || industry ELSE '' END AS evidence, [.85, .8, .82, .78, .75][k]::DOUBLE AS confidence, ['原始文本-客户上下文', '招投标信息', '原始文本-供应商上下文', '招投标信息', '原始文本-合作上下文'][k] AS data_source FROM c""")
def _(o):
    return _edges(o)


def _edges(o):
    k, p = F.col("o_orderkey"), F.substring("o_orderpriority", 1, 1)
    kind = F.when(p == "1", "客户").when(p == "2", "供应商").when(p == "3", "招投标").otherwise("合作")
    name = F.concat(F.when(k % 3 == 0, "轴承厂").otherwise("公司"), k.cast("string"))
    snippet = F.concat(F.lit("约"), F.floor("o_totalprice").cast("string"), F.when(k % 5 == 0, "元").otherwise("万元"), F.lit("或9元"))
    rows = o.select(F.concat(F.lit("O"), F.col("o_custkey").cast("string")).alias("own"), name.alias("name"), kind.alias("kind"), F.when(k % 2 == 0, "工业").otherwise("").alias("industry"), snippet.alias("snippet"), (F.col("o_custkey") % 2 == 0).alias("own_makes"))
    return R.context_edges(rows, F.col("own_makes"), R.is_maker(F.col("name")))


@query("s9b_relation_sheet", "orders", ORACLES["i5_classify_relations"])
def _(o):
    return crawl.relation_sheet(_edges(o).withColumn("project", F.lit(None).cast("string")))


_GATHER = "list_reduce([''] || [trim(x) FOR x IN string_split_regex(text, '[。；\\n]') IF length(trim(x)) >= 15 AND {good}], lambda acc, s: CASE WHEN contains(acc, s) THEN acc WHEN acc = '' THEN s ELSE acc || '。' || s END)"


@query("i6_bidding_relations", "documents", f"""WITH g AS (SELECT doc_id, {_GATHER.format(good="(contains(x, 'tion') OR contains(x, 'sch')) AND regexp_matches(x, '[0-9]{2,}')")} AS t FROM documents WHERE text IS NOT NULL), n AS (SELECT doc_id, t, unnest(list_distinct(regexp_extract_all(t, '([A-Z][a-z]{{4,}})', 1))) AS name FROM g),
    c AS (SELECT *, t[greatest(strpos(t, name) - 30, 1):strpos(t, name) + length(name) + 29] AS context FROM n WHERE name <> 'There')
    SELECT 'D' || doc_id AS subject, name AS object, '客户' AS rel_type, 'D' || doc_id || '与' || name || '存在招投标业务关系' AS description, context[1:80] AS project, '' AS amount, CASE WHEN contains(context, 'und') THEN 'de' ELSE '' END AS industry, '招投标上下文:' || context[1:50] AS evidence, .78::DOUBLE AS confidence, '招投标信息' AS data_source FROM c""")
def _(d):
    rows = d.where("text IS NOT NULL").select(F.concat(F.lit("D"), F.col("doc_id").cast("string")).alias("own"), "text", F.lit("未明确").alias("bids"))
    return R.bidding_edges(rows, "own", "bids", "text", ["[A-Z][a-z]{4,}"], ["tion", "sch"], "[0-9]{2,}", lambda n, own: n != "There", lambda n, c: F.when(F.contains(c, F.lit("und")), "de").otherwise(""))


@query("i7_investment_relations", "documents", f"""WITH g AS (SELECT doc_id, lang, {_GATHER.format(good="contains(x, 'tion') AND regexp_matches(x, '[0-9]{2,}')")} AS t FROM documents WHERE text IS NOT NULL), f AS (SELECT *, [trim(x) FOR x IN string_split_regex(t, '[。；\\n]') IF length(trim(x)) >= 15 AND (contains(x, 'the') OR contains(x, 'tion'))][1] AS s FROM g)
    SELECT 'D' || doc_id AS subject, s[1:60] AS object, '投资' AS rel_type, 'D' || doc_id || '投资建设: ' || s[1:80] AS description, s[1:80] AS project, '' AS amount, coalesce(lang, '') AS industry, '投资项目/原始文本' AS evidence, .85::DOUBLE AS confidence, '投资信息' AS data_source FROM f WHERE s IS NOT NULL""")
def _(d):
    rows = d.where("text IS NOT NULL").select(F.concat(F.lit("D"), F.col("doc_id").cast("string")).alias("own"), "text", F.lit("").alias("plans"), "lang")
    return R.investment_edges(rows, "own", "plans", "text", "lang", ["tion"], ["the", "tion"], "[0-9]{2,}")


# Flat columns


def _flat(df, key, x):
    """The fields of a struct of arrays and texts, arrays joined."""
    rows = df.select(key, x.alias("x")).select(key, "x.*")
    return rows.select(key, *[F.array_join(c, "、").alias(c) if t.startswith("array") else F.col(c) for c, t in rows.dtypes[1:]])


_L = lambda xs: f"list_filter([{xs}], lambda x: x IS NOT NULL)"
_OR = lambda x: f"CASE WHEN len({x}) > 0 THEN {x} ELSE ['未明确'] END"
_JOIN = lambda x: f"array_to_string({x}, '、')"


@query("h1_flat_product", "part", f"""WITH t AS (SELECT *, [x FOR x IN string_split(p_name, ' ') IF x NOT IN ('red', 'small', '') AND length(x) <= 6] AS items, string_split(p_type, ' ') AS core, [p_brand, 'P4-' || p_size] AS specs, {_L("CASE WHEN p_size > 20 THEN 'iso' END")} AS compliance FROM part),
    h AS (SELECT *, [x FOR x IN core IF x IN ('STEEL', 'SMALL')] || ['P4-' || p_size] AS high FROM t)
    SELECT p_partkey, {_JOIN('CASE WHEN len(items) > 0 THEN items ELSE core[1:5] END')} AS main, {_JOIN('core[1:8]')} AS core, {_JOIN('high')} AS high_end, {_JOIN('(core || compliance)[1:10]')} AS keywords, '核心产品：' || {_JOIN('core[1:5]')} || '；产品规格：' || {_JOIN('specs')} || CASE WHEN len(compliance) > 0 THEN '；合规认证：iso' ELSE '' END AS description FROM h""")
def _(p):
    certs = F.filter(F.array(F.when(F.col("p_size") > 20, "iso")), lambda x: x.isNotNull())
    specs = F.array("p_brand", F.concat(F.lit("P4-"), F.col("p_size").cast("string")))
    return _flat(p, "p_partkey", profile_tags.flat_product([F.col("p_name"), F.lit("未明确")], F.split("p_type", " "), specs, certs, ["red", "small"], ["STEEL", "SMALL"], ["P4"], 6))


@query("h2_flat_process", "part", f"""WITH t AS (SELECT *, p_name || ' ' || p_type AS t FROM part), a AS (SELECT *, {_L("CASE WHEN contains(t, 'ring') AND contains(t, 'red') THEN 'red' END, CASE WHEN contains(t, 'ring') AND contains(t, 'STEEL') THEN 'STEEL' END, CASE WHEN p_size > 25 THEN 'tech' END")} AS w, {_L("CASE WHEN p_size % 2 = 0 THEN 'seals' END")} AS pat, {_L("CASE WHEN p_size > 40 THEN 'able' END, p_brand")} AS made,
        {_L("CASE WHEN contains(p_brand, '1') THEN 'one' END, CASE WHEN contains(t, 'blue') THEN 'blue work' END")} AS extra FROM t), b AS (SELECT *, {_OR('w')} AS process FROM a), c AS (SELECT *, CASE WHEN len(pat) > 0 THEN pat ELSE process[1:3] END AS core FROM b)
    SELECT p_partkey, {_JOIN('process')} AS process, {_JOIN('core')} AS core, {_JOIN('made')} AS manufacturing, {_JOIN('extra')} AS special, '核心工艺：' || {_JOIN('core')} || '；制造能力：' || {_JOIN('made')} || CASE WHEN len(extra) > 0 THEN '；特种工艺：' || {_JOIN('extra')} ELSE '' END AS description FROM c""")
def _(p):
    some = lambda *xs: F.filter(F.array(*xs), lambda x: x.isNotNull())
    tech = some(F.when(F.col("p_size") > 25, "tech"), F.when(F.col("p_size") > 40, "able"))
    return _flat(p, "p_partkey", profile_tags.flat_process([F.col("p_name"), F.col("p_type")], F.col("p_brand"), F.when(F.col("p_size") % 2 == 0, "a seal").otherwise("未提取到"), tech, F.array("p_brand"), {"ring": ["rings", "red", "STEEL"]}, {"seal": "seals"}, {"1": "one"}, {"blue": "blue work"}, "tech", ["able"]))


@query("h3_flat_application", "part", f"""WITH t AS (SELECT *, {_L("CASE WHEN contains(p_name, 'ring') THEN 'rings' END, CASE WHEN contains(p_name, 'widget') THEN 'widgets' END, CASE WHEN contains(p_name, 'small') THEN 'small goods' END, CASE WHEN contains(p_type, 'STEEL') THEN 'steel' END")} AS s FROM part), d AS (SELECT *, list_sort(list_distinct([CASE x WHEN 'rings' THEN 'motion' ELSE 'home' END FOR x IN s IF x IN ('rings', 'widgets')])) AS i FROM t)
    SELECT p_partkey, {_JOIN(_OR('s'))} AS scenes, {_JOIN(_OR('s[1:3]'))} AS top, {_JOIN(_OR('i'))} AS downstream, coalesce(nullif(concat_ws('；', CASE WHEN len(s) > 0 THEN '主要应用于' || {_JOIN('s')} || '领域' END, CASE WHEN p_size > 10 THEN '服务客户包括' || p_brand END), ''), '应用领域未明确') AS description FROM d""")
def _(p):
    scenes = tags.keyword_tags(F.concat_ws(" ", "p_name", "p_type"), {"ring": "rings", "widget": "widgets", "small": "small goods", "STEEL": "steel"})
    scenes = F.filter(scenes, lambda x: (x != "small goods") | F.contains(F.col("p_name"), F.lit("small")))
    return _flat(p, "p_partkey", profile_tags.flat_application(scenes, F.when(F.col("p_size") > 10, F.col("p_brand")).otherwise("未明确"), {"rings": "motion", "widgets": "home"}))


@query("h4_flat_supply_chain", "customer", f"""WITH t AS (SELECT c_custkey AS k, c_nationkey AS n, c_custkey % 4 > 0 AS has, c_custkey % 3 = 0 AS sure, c_acctbal AS b, c_mktsegment AS m FROM customer),
    a AS (SELECT *, CASE WHEN has THEN 'SKF、N' || n || CASE WHEN k % 5 = 0 THEN ',x' ELSE '' END END AS partners, has AND k % 5 = 0 AS three FROM t)
    SELECT k AS c_custkey, {_JOIN(_OR(_L("CASE WHEN has THEN '头部企业供应商' END, CASE WHEN three THEN '多客户供应' END, CASE WHEN sure THEN '中标供应商' END, CASE WHEN m = 'BUILDING' THEN '供应链配套商' END")))} AS chain,
        {_JOIN(_OR(_L("CASE WHEN has THEN '头部企业客户' END, CASE WHEN three THEN '多类型客户' END, CASE WHEN has THEN 'B2B企业客户' END, CASE WHEN m = 'AUTOMOBILE' THEN '车企客户' END")))} AS customers,
        {_JOIN(_L("CASE m WHEN 'MACHINERY' THEN '制造商' WHEN 'FURNITURE' THEN '研产一体化供应商' WHEN 'HOUSEHOLD' THEN '设计服务商' WHEN 'BUILDING' THEN '配套供应商' ELSE '供应商' END"))} AS roles,
        {_JOIN("CASE WHEN len(x) > 0 THEN x ELSE ['常规供应商'] END")} AS tiers, coalesce(nullif(concat_ws('；', '合作企业：' || partners, CASE WHEN m = 'BUILDING' THEN '合作模式：供应链配套' END), ''), '供应链信息未明确') AS description
    FROM (SELECT *, {_L("CASE WHEN has THEN '一级供应商' END, CASE WHEN (k % 2 = 0 AND b >= 5000) OR (k % 2 = 1 AND b >= 1) THEN '核心供应商' END, CASE WHEN sure THEN '战略供应商' END")} AS x FROM a)""")
def _(c):
    k, m, no = F.col("c_custkey"), F.col("c_mktsegment"), F.lit("未明确")
    partners = F.when(k % 4 > 0, F.concat(F.lit("SKF、N"), F.col("c_nationkey").cast("string"), F.when(k % 5 == 0, ",x").otherwise(""))).otherwise(no)
    business = F.when(m == "MACHINERY", "轴承制造").when(m == "FURNITURE", "研发与生产").when(m == "HOUSEHOLD", "设计").otherwise("")
    capital = F.concat(F.when(F.col("c_acctbal") > 0, F.floor("c_acctbal")).otherwise(0).cast("string"), F.when(k % 2 == 0, "万元").otherwise("亿元"))
    modes = F.filter(F.array(F.when(m == "BUILDING", "供应链配套")), lambda x: x.isNotNull())
    scenes = F.filter(F.array(F.when(m == "AUTOMOBILE", "汽车")), lambda x: x.isNotNull())
    sure = F.when(k % 3 == 0, "某项目中标").otherwise(no)
    return _flat(c, "c_custkey", profile_tags.flat_supply_chain(partners, sure, business, F.lit(None).cast("string"), capital, sure, modes, F.array().cast("array<string>"), scenes))


# Serving


@query("q5_company_detail", "orders", "SELECT o_orderkey, o_custkey AS name FROM orders WHERE o_custkey = 7 QUALIFY row_number() OVER (ORDER BY strftime(o_orderdate, '%Y%m%d%H%M%S') DESC) = 1")
def _(o):
    rows = o.select(F.col("o_custkey").alias("name"), serving.batch_no(F.col("o_orderdate")).alias("batch_no"), "o_orderkey")
    return serving.detail(rows, 7).select("o_orderkey", "name")


@query("q8_fact_type_summary", "lineitem", "SELECT l_returnflag AS kind, count(*) AS n FROM lineitem GROUP BY 1")
def _(li):
    return scoring.distribution(li, F.col("l_returnflag"))


# Streams: what comes in is written to a folder part by part, and the stream run after each


def _runs(spark, parts, start):
    """Runs a stream after each part of its input has come; ``start`` gets the stream and a folder and gives the running query."""
    path = io.scratch(spark)
    for part in parts:
        part.write.mode("append").parquet(f"{path}/in")
        start(spark.readStream.schema(part.schema).parquet(f"{path}/in"), path).awaitTermination()
    return path


@on_session("t1_stream_ingest_pages", f"""SELECT page_id, url, {DOMAIN} AS domain, coalesce(nullif({SQUEEZE.format("regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '(?s)<[^>]+>', '', 'g')")}, ''), nullif({SQUEEZE.format("regexp_replace(regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1), '(?s)<[^>]+>', '', 'g')")}, ''), '') AS title, trim(regexp_replace(regexp_replace({TEXT}, '&[A-Za-z]+;', ' ', 'g'), '[ \\t]+', ' ', 'g')) AS text, regexp_extract(trim(regexp_replace(regexp_replace({TEXT}, '&[A-Za-z]+;', ' ', 'g'), '[ \\t]+', ' ', 'g')), '([A-Za-z0-9._]+@[A-Za-z0-9.-]+)', 1) AS contact
    FROM pages WHERE html <> '' AND regexp_matches(url, '^(?i)https?://') AND NOT contains({DOMAIN}, 'ads-track')""")
def _(spark, sf_dir):
    """Pages as a stream of files: each goes through the page operators into a table of profiles. Some come first with an older text, and the last run finds nothing new."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    old = pages.where("page_id % 3 = 0").withColumn("html", F.lit("<title>old</title><p>old</p>"))
    schema = jobs.profile_pages(pages, ["ads-track"]).schema

    def start(source, path):
        return jobs.ingest(jobs.profile_pages(source, ["ads-track"]), f"{path}/checkpoint", BucketTable(spark, f"{path}/table", schema, ["page_id"]).merge)

    path = _runs(spark, [old, pages, pages.where("false")], start)
    return BucketTable(spark, f"{path}/table", schema, ["page_id"]).read()


_CACHED = "WITH RECURSIVE f AS (SELECT user_id || ':' || event_type AS url, ts FROM events), k(url, ts) AS (SELECT url, min(ts) FROM f GROUP BY url UNION ALL SELECT k.url, min(f.ts) FROM k JOIN f ON f.url = k.url AND f.ts > k.ts + INTERVAL 7 DAY GROUP BY k.url)"


@on_session("t2_stream_url_dedup", f"{_CACHED} SELECT url, count(*) AS kept FROM k GROUP BY url")
def _(spark, sf_dir):
    """Fetches, made of events, in four parts by time: how many of a url find nothing in the cache that is less than seven days old."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.concat_ws(":", "user_id", "event_type").alias("url"), F.col("ts").cast("timestamp").alias("fetched_at"))
    part = F.least(F.floor(F.datediff("fetched_at", F.lit("2024-01-01")) / 8), F.lit(3))

    def start(source, path):
        return jobs.fetches_in_time(source, 7 * 86400).writeStream.option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start(f"{path}/table", "parquet", "append")

    path = _runs(spark, [events.where(part == n) for n in range(4)], start)
    return spark.read.parquet(f"{path}/table").where("state <> 'hit'").groupBy("url").agg(F.count("*").alias("kept"))


# a fortieth of the rows comes two parts later
_PARTS = """WITH p AS (SELECT ts, least(value * 1000, 15000) AS ms, date_trunc('hour', ts) AS hour, least(3, CAST(floor(event_id * 4 / (SELECT count(*) FROM events)) AS INT) + CASE WHEN event_id % 40 = 7 THEN 2 ELSE 0 END) AS part FROM events),
    m AS (SELECT n, (SELECT max(ts) FROM p WHERE part < n) - INTERVAL 1 HOUR AS mark FROM range(5) t(n)), r AS (SELECT p.*, coalesce(hour + INTERVAL 1 HOUR <= mark, false) AS late FROM p JOIN m ON n = part) """
_LAST = "date_trunc('second', (SELECT mark FROM m WHERE n = 4))"


def _closed(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    total = events.agg(F.count("*").alias("total"))
    part = F.least(F.lit(3), F.floor(F.col("event_id") * 4 / F.col("total")) + F.when(F.col("event_id") % 40 == 7, 2).otherwise(0))
    rows = events.join(F.broadcast(total), F.lit(True)).select(F.col("ts").cast("timestamp").alias("ts"), (F.col("value") * 1000).alias("ms"), part.alias("part"))  # one row
    path = _runs(spark, [rows.where(F.col("part") == n).drop("part") for n in range(4)], lambda source, path: jobs.ingest(source, f"{path}/checkpoint", jobs.ClosedHours(spark, f"{path}/hours").merge))
    return jobs.ClosedHours(spark, f"{path}/hours")


@on_session("t3_probe_stats_hourly", f"{_PARTS} SELECT hour, count(*) AS n, round(avg(ms), 4) AS avg_ms FROM r WHERE NOT late GROUP BY hour HAVING hour + INTERVAL 1 HOUR <= {_LAST}")
def _(spark, sf_dir):
    """Probes, made of events, in four parts, some of them late: the hours that are closed by the end, once each."""
    return _closed(spark, sf_dir).closed().select(F.col("hour").cast("timestamp_ntz").alias("hour"), "n", F.round("avg_ms", 4).alias("avg_ms"))


@on_session("t3_probe_late_rows", f"{_PARTS} SELECT hour, count(*) AS n FROM r WHERE late GROUP BY hour")
def _(spark, sf_dir):
    """The rows of the same probes that came after their hour was closed, by hour."""
    return _closed(spark, sf_dir).late().select(F.col("hour").cast("timestamp_ntz").alias("hour"), "n")
