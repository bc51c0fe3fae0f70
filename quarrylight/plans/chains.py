"""Whole chains of operators over texts, with SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrylight.operators.chain import Words, company_edges
from quarrylight.operators.profile import profiles
from quarrylight.plans.queries import query

_GATHER = "list_filter([trim(x) FOR x IN string_split_regex(text, '[。；\\n]') IF length(trim(x)) >= 15 AND {}], lambda x, i: true)"
_UNIQUE = "list_filter({0}, lambda x, i: list_position({0}, x) = i)"
_HELD = "list_reduce([''] || {}, lambda acc, s: CASE WHEN contains(acc, s) THEN acc WHEN acc = '' THEN s ELSE acc || '。' || s END)"
_BID = _HELD.format(_GATHER.format("(contains(x, 'tion') OR contains(x, 'sch')) AND regexp_matches(x, '[0-9]{2,}')"))
_INDUSTRY = "CASE WHEN contains(context, 'und') THEN 'de' WHEN contains(context, 'les') THEN 'fr' ELSE '' END"
_AROUND = "[greatest(strpos({0}, name) - {1}, 1):strpos({0}, name) + length(name) + {1} - 1]"
_EDGE = "subject, object, rel_type, description, project, amount, industry, evidence, confidence, data_source"

_SQL = f"""WITH d AS (SELECT 'D' || doc_id AS own, doc_id % 2 = 0 AS own_makes, text, coalesce(source, '') AS segment, lang, regexp_extract_all(text, '([A-Z][a-z]{{4,}})', 1) AS l FROM documents WHERE text IS NOT NULL),
    u AS (SELECT own, own_makes, text, unnest({_UNIQUE.format('l')}) AS name, generate_subscripts({_UNIQUE.format('l')}, 1) AS seq FROM d),
    m AS (SELECT *, text{_AROUND.format('text', 50)} AS context FROM u WHERE name <> 'There' AND NOT contains(name, 'ing')),
    k AS (SELECT *, CASE WHEN regexp_matches(context, 'tion') THEN '客户' WHEN regexp_matches(context, 'b.r') THEN '供应商' WHEN contains(context, 'sch') THEN '招投标' ELSE '合作' END AS kind, {_INDUSTRY} AS ind FROM m),
    e1 AS (SELECT own AS subject, name AS object, CASE WHEN kind IN ('客户', '招投标') THEN '客户' WHEN kind = '供应商' THEN '供应商' ELSE '合作' END AS rel_type, CASE WHEN kind IN ('客户', '招投标') THEN own || '为' || name || '提供产品/服务' WHEN kind = '供应商' THEN name || '为' || own || '提供轴承相关产品/技术' ELSE own || '与' || name || '存在合作关系' END AS description,
        '' AS project, '' AS amount, ind AS industry, '原始文本匹配；上下文:' || kind || CASE WHEN ind <> '' THEN '；行业:' || ind ELSE '' END AS evidence, CASE kind WHEN '客户' THEN .85 WHEN '招投标' THEN .8 WHEN '供应商' THEN .82 ELSE .75 END::DOUBLE AS confidence,
        CASE kind WHEN '招投标' THEN '招投标信息' ELSE '原始文本-' || kind || '上下文' END AS data_source, 0 AS step FROM k),
    g AS (SELECT own, {_BID} AS t FROM d), gn AS (SELECT own, t, unnest(list_distinct(regexp_extract_all(t, '([A-Z][a-z]{{4,}})', 1))) AS name FROM g), c AS (SELECT *, t{_AROUND.format('t', 30)} AS context FROM gn WHERE name <> 'There' AND NOT contains(name, 'ing')),
    e2 AS (SELECT own, name, '客户', own || '与' || name || '存在招投标业务关系', context[1:80], '', {_INDUSTRY}, '招投标上下文:' || context[1:50], .78::DOUBLE, '招投标信息', 1 FROM c),
    i AS (SELECT own, segment, ({_GATHER.format("contains(x, 'und') AND regexp_matches(x, '[0-9]{2,}')")})[1] AS f FROM d),
    e3 AS (SELECT own, f[1:60], '投资', own || '投资建设: ' || f[1:80], f[1:80], '', segment, '投资项目/原始文本', .85::DOUBLE, '投资信息', 2 FROM i WHERE f IS NOT NULL),
    s AS (SELECT own, ind, array_to_string(list('关联企业:' || name ORDER BY seq), '；') AS seen, arg_min(name, seq) AS first FROM k WHERE ind <> '' GROUP BY own, ind),
    e4 AS (SELECT own, lang, '下游行业', own || '产品应用于' || lang, '', '', lang, coalesce(seen, '应用场景/业务范围推断'), .85::DOUBLE, '标签推断', 3 FROM d LEFT JOIN s USING (own) WHERE lang <> '' AND (ind = lang OR ind IS NULL)
        UNION ALL SELECT own, lang, '下游行业', own || '产品应用于' || lang, '', '', lang, '应用场景/业务范围推断', .85, '标签推断', 3 FROM d WHERE lang <> '' AND own IN (SELECT own FROM s) AND (own, lang) NOT IN (SELECT (own, ind) FROM s)
        UNION ALL SELECT own, ind, '下游行业', own || '产品应用于' || ind, '', '', ind, '关联企业:' || first || '推断', .75, '原始文本推断', 3 FROM s JOIN d USING (own) WHERE ind <> coalesce(lang, ''))
    SELECT {_EDGE} FROM (SELECT * FROM e1 UNION ALL SELECT * FROM e2 UNION ALL SELECT * FROM e3 UNION ALL SELECT * FROM e4) QUALIFY row_number() OVER (PARTITION BY subject, object, rel_type ORDER BY confidence DESC, step) = 1"""


@query("company_edges", "documents", _SQL)
def _(d):
    """Every document as a company: names in its text, bids, investments and its language as the industry it supplies."""
    none = F.array().cast("array<string>")
    rows = d.where("text IS NOT NULL").select(
        F.concat(F.lit("D"), F.col("doc_id").cast("string")).alias("own"), "text", F.lit("未明确").alias("bids"), F.lit("未明确").alias("invests"), F.coalesce("source", F.lit("")).alias("segment"),
        F.lit(False).alias("own_makes"), F.when(F.col("lang").isNotNull(), F.array("lang")).otherwise(none).alias("downstream"), none.alias("scenes"),
    )
    kinds = [("客户", ["tion"]), ("供应商", ["b.r"]), ("招投标", ["sch"])]
    return company_edges(rows, Words(["[A-Z][a-z]{4,}"], [], ["There"], ["ing"], kinds, "合作", [], {"und": "de", "les": "fr"}, ["tion", "sch"], "[0-9]{2,}", ["und"], "[0-9]{2,}", "x"))


_PAGES = """s AS (SELECT s_suppkey AS k, 'S' || s_suppkey || '有限公司' AS name FROM supplier),
    p AS (SELECT name, 'business_info' AS category, '成立于' || (2000 + k % 20) || '年' || (1 + k % 9) || '月。注册资本' || (k % 500 + 1) || '万元。' AS text FROM s WHERE k % 4 <> 0
        UNION ALL SELECT name, 'official_website', '经营范围：深沟球轴承制造销售。法定代表人：王小明，员工' || (k % 700 + 1) || '人。' FROM s WHERE k % 2 = 1
        UNION ALL SELECT name, 'bidding_info', '中标轴承采购项目，中标金额：' || (k % 900 + 100) || '万元人民币，深沟球轴承。' FROM s WHERE k % 3 = 0 AND k % 4 <> 0)"""
_STAFF = "CASE WHEN n < 50 THEN '50人以下' WHEN n < 150 THEN '50-150人' WHEN n < 500 THEN '150-500人' ELSE '500-1000人' END"


@query("profile_plan", "supplier", f"""WITH {_PAGES}, c AS (SELECT name, count(*) AS filled, sum(length(text)) AS size FROM p GROUP BY name), x AS (SELECT *, k % 2 = 1 AS site, k % 4 <> 0 AS info, k % 3 = 0 AND k % 4 <> 0 AS bid, k % 700 + 1 AS n FROM s)
    SELECT name AS enterprise_name, CASE WHEN info THEN 'success' ELSE 'failed' END AS status, coalesce(filled, 0) AS filled, CASE WHEN info THEN 'partial' ELSE 'failed' END AS crawl_status, CASE WHEN site THEN 'success' WHEN info THEN 'partial' ELSE 'failed' END AS clean_status,
        round_even(least(.95::DOUBLE, .2::DOUBLE + .18::DOUBLE * coalesce(filled, 0) + least(2 * coalesce(size, 0) / 15000, .15::DOUBLE)), 2) AS crawl_confidence,
        CASE WHEN info THEN (2000 + k % 20) || '-0' || (1 + k % 9) ELSE '' END AS establish_time, CASE WHEN info THEN (k % 500 + 1) || '万元人民币' ELSE '' END AS registered_capital, CASE WHEN site THEN '深沟球轴承制造销售' ELSE '' END AS business_scope,
        CASE WHEN site OR bid THEN '深沟球轴承' ELSE '' END AS core_products, CASE WHEN site THEN {_STAFF} ELSE '' END AS employee_scale, CASE WHEN info THEN CASE WHEN site THEN '企业官网、' ELSE '' END || '工商查询平台' || CASE WHEN bid THEN '、招投标平台' ELSE '' END ELSE '' END AS data_source,
        bid::BIGINT AS n_records, CASE WHEN bid THEN 'BID-001' ELSE '' END AS record_id, CASE WHEN bid THEN (k % 900 + 100) || '' ELSE '' END AS amount, CASE WHEN bid THEN '中国政府采购网' ELSE '' END AS source_platform
    FROM x LEFT JOIN c USING (name)""")
def _(s):
    """Suppliers as companies with up to three pages; one row a company of what the plan's tables say of it."""
    k, name = F.col("s_suppkey"), F.concat(F.lit("S"), F.col("s_suppkey").cast("string"), F.lit("有限公司"))
    n = lambda c: c.cast("string")
    texts = [
        (k % 4 != 0, "business_info", "tianyancha", F.concat(F.lit("成立于"), n(2000 + k % 20), F.lit("年"), n(1 + k % 9), F.lit("月。注册资本"), n(k % 500 + 1), F.lit("万元。"))),
        (k % 2 == 1, "official_website", "https://s.example.org", F.concat(F.lit("经营范围：深沟球轴承制造销售。法定代表人：王小明，员工"), n(k % 700 + 1), F.lit("人。"))),
        ((k % 3 == 0) & (k % 4 != 0), "bidding_info", "http://www.ccgp.gov.cn/1", F.concat(F.lit("中标轴承采购项目，中标金额："), n(k % 900 + 100), F.lit("万元人民币，深沟球轴承。"))),
    ]
    made = F.array(*[F.when(c, F.struct(F.lit(category).alias("category"), F.lit(source).alias("source"), text.alias("text"))) for c, category, source, text in texts])
    pages = s.select(name.alias("name"), k.alias("seq"), F.inline(F.filter(made, lambda x: x.isNotNull())))
    p, key = profiles(s.select(name.alias("name")), pages), "enterprise_name"
    of = p.fields.select(key, "establish_time", "registered_capital", "business_scope", "core_products", "employee_scale")
    out = p.runs.select(key, "status", "filled", "crawl_status", "clean_status", "n_records").join(p.records.select(key, "crawl_confidence").hint("merge"), key)
    for more in (of, p.overview.select(key, "data_source"), p.facts.select(key, "record_id", "amount", "source_platform")):
        out = out.join(more.hint("merge"), key, "left")
    return out.na.fill("")
