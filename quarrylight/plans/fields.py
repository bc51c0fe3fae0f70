"""Queries of the field operators, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrylight.functions import domain as D
from quarrylight.functions import exprs as X
from quarrylight.operators import fields, web
from quarrylight.plans.queries import DOMAIN, query

_MISSING = "coalesce({0}, '') IN ('', '未提取到', '未明确')"


@query("f1_enterprise_name", "documents", "SELECT doc_id, coalesce(nullif(CASE WHEN doc_id % 3 = 0 THEN source ELSE '' END, ''), regexp_extract(coalesce(text, ''), '([A-Z][a-z]{3,} [a-z]{2,})', 1)) AS name FROM documents")
def _(d):
    return d.select("doc_id", fields.enterprise_name(F.when(F.col("doc_id") % 3 == 0, F.col("source")).otherwise(""), F.col("text"), ["([A-Z][a-z]{3,} [a-z]{2,})"]).alias("name"))


@query("f3_establish_time", "orders", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 < 2 OR year(o_orderdate) BETWEEN 1996 AND 1999 THEN strftime(o_orderdate, '%Y-%m-%d') ELSE '' END AS value, o_orderkey % 3 <> 0 AS uncertain FROM orders")
def _(o):
    date, k = F.date_format("o_orderdate", "yyyy-M-d"), F.col("o_orderkey") % 3
    text = F.when(k == 0, F.concat(F.lit("founded on "), date)).when(k == 1, F.concat(date, F.lit(" founded"))).otherwise(date)
    return o.select("o_orderkey", fields.establish_time(text, ["founded"], (1996, 1999)).alias("x")).select("o_orderkey", "x.*")


@query("f4_addresses", "supplier", "SELECT s_suppkey, CASE s_suppkey % 4 WHEN 3 THEN 'Lane of ' || s_name WHEN 1 THEN CASE WHEN length(s_name) > 18 THEN s_name ELSE '' END ELSE s_name || ' Street' END AS register, CASE WHEN s_suppkey % 2 = 0 THEN s_name || ' Road' ELSE '' END AS actual FROM supplier")
def _(s):
    """An address, also one of an office, or only one that a fallback finds: a bidder's, or a name that is long enough."""
    k = F.col("s_suppkey") % 4
    text = F.when(k == 3, F.concat(F.lit("bidder at Lane of "), "s_name")).when(k == 1, F.concat(F.lit("only "), "s_name")).otherwise(F.concat(F.lit("Seat "), "s_name", F.lit(" Street"), F.when(k % 2 == 0, F.concat(F.lit("; and the office for work is in "), "s_name", F.lit(" Road"))).otherwise("")))
    found = fields.addresses(text, ["([A-Z][a-z]+#[0-9]+ (?:Street|Road))"], ["work"], fallbacks=[("bidder.*?at (Lane of [A-Za-z]+#[0-9]+)", 5), ("([A-Z][a-z]+#[0-9]+)", 18)])
    return s.select("s_suppkey", found.alias("x")).select("s_suppkey", "x.*")


@query("f5_legal_person", "supplier", "SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN s_name ELSE '' END AS value, CASE WHEN s_suppkey % 2 = 0 THEN 'regex' ELSE 'miss' END AS method FROM supplier")
def _(s):
    text = F.concat(F.lit("person: "), F.when(F.col("s_suppkey") % 2 == 0, F.col("s_name")).otherwise("nobody"))
    return s.select("s_suppkey", fields.legal_person(text, ["owner: (.+)", "person: (.+)"], ["nobody"]).alias("x")).select("s_suppkey", "x.*")


@query("f6_registered_capital", "customer", "SELECT c_custkey, CASE WHEN c_acctbal >= 0 THEN CAST(floor(c_acctbal) AS BIGINT) || CASE WHEN c_custkey % 2 = 0 THEN '亿元' ELSE '万元' END ELSE '' END AS value, CASE WHEN c_acctbal >= 0 THEN NULL ELSE 'no pattern matched' END AS reason FROM customer")
def _(c):
    text = F.when(F.col("c_acctbal") >= 0, F.concat(F.lit("注册资本："), F.format_number(F.floor("c_acctbal"), 0), F.when(F.col("c_custkey") % 2 == 0, "亿元").otherwise("万元")))
    x = fields.registered_capital(text, [("注册资本[:：]([0-9,.]+)亿", "亿元"), ("注册资本[:：]([0-9,.]+)万", "万元")])
    return c.select("c_custkey", x.alias("x")).select("c_custkey", "x.value", F.col("x.diagnostics.reason").alias("reason"))


@query("f9_business_scope", "documents", "SELECT doc_id, CASE WHEN length(v) > 5 THEN v ELSE '' END AS scope FROM (SELECT doc_id, regexp_replace(regexp_extract(coalesce(text, ''), 'the ([^.]*)[.]', 1), '\\s+', '', 'g') AS v FROM documents)")
def _(d):
    return d.select("doc_id", fields.business_scope(F.col("text"), ["the ([^.]*)[.]"]).alias("scope"))


@query("f11_core_products", "part", """SELECT p_partkey, array_to_string(list_filter([x FOR x IN ['ring', 'small', 'small ring', 'widget'] IF contains(p_name, x)], lambda x: NOT (contains(p_name, 'small ring') AND x IN ('ring', 'small'))), ',') AS products FROM part""")
def _(p):
    return p.select("p_partkey", F.array_join(fields.core_products(F.col("p_name"), ["ring", "small", "small ring", "widget"], [("small ring", "ring"), ("small ring", "small")]), ",").alias("products"))


@query("f12_product_spec", "documents", "SELECT doc_id, array_to_string(list_filter([nullif(regexp_extract(coalesce(text, ''), p, 0), '') FOR p IN ['[0-9]{2,4}', '[A-Z]{3,}', '[a-z]+ing']], lambda x: x IS NOT NULL), '；') AS spec FROM documents".replace("[nullif(regexp_extract(coalesce(text, ''), p, 0), '') FOR p IN ['[0-9]{2,4}', '[A-Z]{3,}', '[a-z]+ing']]", "[" + ", ".join(f"nullif(regexp_extract(coalesce(text, ''), '{p}', 0), '')" for p in ("[0-9]{2,4}", "[A-Z]{3,}", "[a-z]+ing")) + "]"))
def _(d):
    return d.select("doc_id", fields.product_spec(F.col("text"), ["[0-9]{2,4}", "[A-Z]{3,}", "[a-z]+ing"]).alias("spec"))


@query("f14_qualification_flags", "documents", "SELECT doc_id, CASE WHEN contains(coalesce(text, ''), 'the') THEN '是' WHEN contains(coalesce(text, ''), 'nothe') THEN '否' ELSE '未明确' END AS flag, CASE WHEN contains(coalesce(text, ''), 'of the') THEN '否' WHEN contains(coalesce(text, ''), 'the') THEN '是' ELSE '未明确' END AS strict FROM documents")
def _(d):
    return d.select("doc_id", fields.qualification_flag(F.col("text"), ["the"], ["nothe"]).alias("flag"), fields.qualification_flag(F.col("text"), ["the"], ["of the"], True).alias("strict"))


@query("f15_patent_count", "part", """WITH n AS (SELECT p_partkey, p_size, p_partkey % 2 = 0 AS inv, list_filter([CASE WHEN contains(p_name, 'ring') THEN 'ring' END, CASE WHEN contains(p_name, 'red') THEN 'red' END], lambda x: x IS NOT NULL) AS t FROM part)
    SELECT p_partkey, CASE WHEN inv THEN 0 ELSE p_size END::BIGINT AS total, CASE WHEN inv THEN p_size ELSE 0 END::BIGINT AS invention, CASE WHEN p_size = 0 THEN '' ELSE p_size || '项' || CASE WHEN inv OR len(t) > 0 THEN '（' || concat_ws('（', CASE WHEN inv THEN '发明专利' || p_size || '项' END, CASE WHEN len(t) > 0 THEN '含' || array_to_string(t, '、') || '相关' END) || '）' ELSE '' END END AS shown FROM n""")
def _(p):
    text = F.concat("p_name", F.when(F.col("p_partkey") % 2 == 0, " invention ").otherwise(" design "), F.lit("patents "), F.col("p_size").cast("string"))
    patterns = ["patents ([0-9]+)", "([0-9]+) patents"]
    return p.select("p_partkey", fields.patent_count(text, patterns, "invent").alias("x"), fields.patent_text(text, patterns, "invent", ["ring", "red"], "patents").alias("shown")).select("p_partkey", "x.*", "shown")


@query("f17_bidding_projects", "documents", """WITH s AS (SELECT doc_id, source, [trim(x) FOR x IN string_split_regex(coalesce(text, ''), '[.\\n]')] AS s FROM documents)
    SELECT doc_id, coalesce(list_filter(s, lambda x: contains(x, 'tion') AND (regexp_matches(x, '[0-9]') OR contains(x, source)))[1], list_filter(s, lambda x: contains(x, 'ing') AND regexp_matches(x, '[0-9]'))[1], '') AS project FROM s""")
def _(d):
    return d.select("doc_id", fields.bidding_project(F.col("text"), [], ["tion"], "[0-9]", F.col("source"), ["ing"], r"[.\n]").alias("project"))


@query("f18_investment_projects", "orders", "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN CAST(floor(o_totalprice) AS BIGINT)::VARCHAR ELSE '' END AS value FROM orders")
def _(o):
    text = F.concat(F.when(F.col("o_orderkey") % 2 == 0, "invested ").otherwise("sold "), F.floor("o_totalprice").cast("string"))
    return o.select("o_orderkey", X.ordered_extract(text, ["total investment ([0-9]+)", "invested ([0-9]+)"])["value"].alias("value"))


@query("f19_cooperative_enterprises", "documents", """WITH m AS (SELECT doc_id, coalesce(text, '') AS t, lang FROM documents), n AS (SELECT doc_id, t, list_distinct(regexp_extract_all(t, '([A-Z][a-z]{3,})', 1) || [w FOR w IN ['ring', 'tion'] IF contains(t, w)]) AS names, coalesce(lang, '?') AS own FROM m),
    k AS (SELECT doc_id, unnest(list_filter(names, lambda x: length(x) >= 4 AND x <> 'They' AND NOT contains(x, own) AND NOT contains(own, x))) AS name, t FROM n)
    SELECT doc_id, string_agg(name, ',' ORDER BY strpos(t, name), name) AS partners FROM (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY strpos(t, name), name) <= 8) GROUP BY 1""")
def _(d):
    rows = d.select("doc_id", fields.partners(F.col("text"), "[A-Z][a-z]{3,}", F.coalesce("lang", F.lit("?")), ["ring", "tion"], ["They"]).alias("p"))
    return rows.where(F.size("p") > 0).select("doc_id", F.array_join("p", ",").alias("partners"))


@query("f20_industry_class", "part", "SELECT p_partkey, coalesce(nullif(array_to_string(list_filter([CASE WHEN contains(p_name, 'ring') THEN 'rings' END, CASE WHEN contains(p_name, 'widget') THEN 'widgets' END, CASE WHEN contains(p_name, 'widget') AND contains(p_name, 'e') THEN 'e' END], lambda x: x IS NOT NULL)[1:3], '/'), ''), CASE WHEN contains(p_type, 'ECO') THEN 'cheap' WHEN contains(p_type, 'STEEL') THEN 'steel' END, 'parts') AS industry, '制造业-通用设备制造业-轴承制造' AS category FROM part")
def _(p):
    """Segments of the name, else an industry by the type as scope, else the default; and the constant category."""
    rules = [("rings", ["ring"]), ("widgets", ["widget"]), ("e", ["e widget", "ed widget", "widget"])]
    found = fields.industry_class(F.col("p_name"), rules, "parts", F.col("p_type"), [("cheap", ["ECO"]), ("steel", ["STEEL"])])
    return p.select("p_partkey", found.alias("industry"), F.lit(D.INDUSTRY_CATEGORY).alias("category"))


@query("f21_data_source_labels", "pages", f"""WITH l AS (SELECT DISTINCT {DOMAIN} AS domain, CASE WHEN contains(url, 'blog.') THEN 'blog' WHEN contains(url, '/en') THEN 'english' ELSE 'site' END AS label FROM pages) SELECT domain, string_agg(label, '、' ORDER BY label) AS labels FROM l GROUP BY 1""")
def _(p):
    rules = [("blog", ["blog."]), ("english", ["/en"])]
    labels = p.select(web.domain(F.col("url")).alias("domain"), fields.source_labels(F.array("url"), rules, "site").alias("label")).distinct()
    return labels.groupBy("domain").agg(F.array_join(F.sort_array(F.collect_list("label")), "、").alias("labels"))  # as many as rules at most


@query("f22_clean_confidence", "documents", f"""SELECT doc_id, round_even(least(least(.3::DOUBLE + .085::DOUBLE * (CASE WHEN {_MISSING.format("text")} THEN 0 ELSE 1 END + CASE WHEN {_MISSING.format("lang")} THEN 0 ELSE 1 END), .98::DOUBLE) + CASE WHEN {_MISSING.format("source")} THEN 0 ELSE .03 END::DOUBLE, .98::DOUBLE), 2) AS confidence FROM documents""")
def _(d):
    return d.select("doc_id", fields.clean_confidence([F.col("text"), F.col("lang")], [(F.col("source"), 0.03)]).alias("confidence"))


@query("f23_clean_status", "documents", """WITH n AS (SELECT doc_id, coalesce(text, '') = '' AS bare, (coalesce(lang, '') <> '')::INT + (coalesce(source, '') <> '')::INT + (doc_id % 3 > 0)::INT AS n, doc_id % 5 AS u FROM documents)
    SELECT doc_id, CASE WHEN bare THEN 'failed' WHEN n = 3 THEN 'success' ELSE 'partial' END AS status, CASE WHEN bare THEN '输入数据为空或格式错误' WHEN n = 3 THEN '所有核心字段提取完整' WHEN n = 2 THEN '部分字段提取成功，' || u || ' 个字段不确定' WHEN n = 1 THEN '核心字段提取不充分，仅1个字段有值，' || u || ' 个字段不确定' ELSE '核心字段提取不足，但已尽力提取可用信息' END AS note FROM n""")
def _(d):
    core = [F.col("lang"), F.col("source"), F.when(F.col("doc_id") % 3 > 0, "x")]
    return d.select("doc_id", fields.clean_status(F.col("text"), core).alias("status"), fields.clean_note(F.col("text"), core, F.col("doc_id") % 5).alias("note"))


@query("f24_uncertain_fields", "documents", "SELECT doc_id, array_to_string(list_filter([CASE WHEN coalesce(text, '') = '' THEN 'text' END, CASE WHEN coalesce(lang, '') = '' THEN 'lang' END, CASE WHEN coalesce(source, '') = '' THEN 'source' END], lambda x: x IS NOT NULL), ',') AS missing, CASE WHEN regexp_matches(coalesce(text, ''), '[0-9]+ EUR') THEN 0 ELSE 1 END AS n, CASE WHEN regexp_matches(coalesce(text, ''), '[0-9]+ EUR') THEN '' ELSE coalesce(text, '')[1:200] END AS sample FROM documents")
def _(d):
    """Missing fields, and the diagnostics of a capital that isn't found: how many fields have some, and the sample of the text."""
    capital = fields.registered_capital(F.col("text"), [("([0-9]+) EUR", "EUR")])["diagnostics"]
    rows = d.withColumn("m", fields.diagnostics({"registered_capital": capital}))
    return rows.select("doc_id", F.array_join(fields.uncertain_fields(["text", "lang", "source"]), ",").alias("missing"), F.size("m").alias("n"), F.coalesce(F.col("m")["registered_capital"]["text_sample"], F.lit("")).alias("sample"))


@query("f25_gap_fill_merge", "documents,labels", "SELECT doc_id, coalesce(nullif(lang, ''), q, '') AS lang FROM documents LEFT JOIN (SELECT doc_id, min('q' || quality) AS q FROM labels GROUP BY 1) USING (doc_id)")
def _(d, la):
    rows = d.select("doc_id", F.coalesce("lang", F.lit("")).alias("lang"))
    answers = la.select("doc_id", F.lit("lang").alias("field"), F.concat(F.lit("q"), F.col("quality").cast("string")).alias("value"))
    return fields.gap_fill(rows, answers, "doc_id", ["lang"])


@query("f25_gap_queue", "documents", "SELECT doc_id, unnest(list_filter([CASE WHEN coalesce(source, '') = '' THEN 'source' END, CASE WHEN NOT contains(text, '@') THEN 'contact' END], lambda x: x IS NOT NULL)) AS field, text[1:6000] AS text_sample FROM documents WHERE text IS NOT NULL")
def _(d):
    rows = d.where("text IS NOT NULL").withColumn("contact", F.when(F.col("text").contains("@"), "known").otherwise("未提取到"))
    return fields.gap_queue(rows, "doc_id", ["source", "contact"], "text")
