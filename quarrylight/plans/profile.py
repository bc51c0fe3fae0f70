"""Queries of the tag generators and flat columns, of segments, fingerprints and stored columns, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrylight.operators import profile_tags as T
from quarrylight.operators import records, serving, tags, text
from quarrylight.plans.queries import BITS, LINES, query

_NAMES = {"ring": "rings", "widget": "widgets", "small": "small goods"}
_KEYS = "[x FOR x IN [CASE WHEN contains(p_name, 'ring') THEN 'rings' END, CASE WHEN contains(p_name, 'widget') THEN 'widgets' END, CASE WHEN contains(p_name, 'small') THEN 'small goods' END] IF x IS NOT NULL]"
_j = lambda c, name, sep=",": F.array_join(c, sep).alias(name)


@query("g4_product_type_tags", "part", f"SELECT p_partkey, array_to_string(CASE WHEN len({_KEYS}) > 0 THEN {_KEYS} ELSE [replace(p_name, 'red', 'rouge')] END, ',') AS tags FROM part")
def _(p):
    return p.select("p_partkey", _j(T.product_types(F.col("p_name"), F.lit(None).cast("string"), _NAMES, [("red", "rouge")]), "tags"))


@query("g5_product_spec_tags", "part", "SELECT p_partkey, 'size-' || p_size || ',size-' || p_brand || ',' || p_type AS tags FROM part")
def _(p):
    return p.select("p_partkey", _j(T.product_specs(F.concat(F.lit("size："), F.col("p_size").cast("string"), F.lit(", "), "p_brand", F.lit("； ;"), "p_type")), "tags"))


@query("g6_application_tags", "part", "SELECT p_partkey, array_to_string(list_sort(list_distinct([x FOR x IN [CASE p_brand WHEN 'Brand#2' THEN 'trade' WHEN 'Brand#17' THEN 'widgets' END, CASE WHEN contains(p_name, 'ring') THEN 'rings' END, CASE WHEN contains(p_name, 'widget') THEN 'widgets' END, CASE WHEN contains(p_name, 'small') THEN 'small goods' END] IF x IS NOT NULL])), ',') AS tags FROM part")
def _(p):
    return p.select("p_partkey", _j(T.application_tags(F.array("p_brand"), {"Brand#2": "trade", "Brand#17": "widgets"}, F.col("p_name"), _NAMES), "tags"))


@query("g7_compliance_tags", "part", "SELECT p_partkey, array_to_string(list_filter([p_brand, nullif(trim(p_type), ''), 'rouge ' || p_size], lambda x: x IS NOT NULL), ',') AS tags FROM part")
def _(p):
    return p.select("p_partkey", _j(T.compliance_tags(F.concat(F.lit("has "), "p_brand", F.lit("、"), "p_type", F.lit("，red "), F.col("p_size").cast("string"), F.lit("; has")), [("red", "rouge")], ["has"]), "tags"))


@query("g8_service_type_tags", "documents", "SELECT doc_id, array_to_string(list_filter([CASE WHEN contains(t, 'the') THEN 'en' END, CASE WHEN contains(t, 'und') THEN 'de' END, CASE WHEN contains(text, 'on') AND contains(text, 're') AND contains(text, 'ing') THEN 'all' END], lambda x: x IS NOT NULL), ',') AS tags FROM (SELECT doc_id, lower(text) AS t, text FROM documents)")
def _(d):
    return d.select("doc_id", _j(T.inferred_tags(F.col("text"), {"the": "en", "und": "de"}, [(T.all_of(F.col("text"), ["on", "re", "ing"]), "all")], 8), "tags"))


@query("g9_coop_mode_tags", "orders", "SELECT o_orderkey, array_to_string(list_filter([CASE WHEN contains(o_orderpriority, 'LOW') THEN 'slow' END, CASE WHEN o_orderstatus = 'F' THEN 'bid' END, CASE WHEN o_custkey % 2 = 0 THEN 'chain' END], lambda x: x IS NOT NULL), ',') AS tags FROM orders")
def _(o):
    return o.select("o_orderkey", _j(T.inferred_tags(F.col("o_orderpriority"), {"LOW": "slow"}, [(F.col("o_orderstatus") == "F", "bid"), (F.col("o_custkey") % 2 == 0, "chain")], 6), "tags"))


@query("g10_coverage_tags", "lineitem,supplier", """WITH p AS (SELECT l_suppkey, count(DISTINCT l_linenumber) AS n, bool_or(l_linenumber = 1) AS famous FROM lineitem WHERE l_quantity > 48 AND l_linenumber <= 4 GROUP BY 1)
    SELECT s_suppkey, array_to_string(list_filter([CASE WHEN n >= 3 THEN '全国' WHEN famous THEN '知名客户' WHEN n > 0 THEN '区域' END, CASE WHEN contains(s_name, '7') THEN 'seven' END], lambda x: x IS NOT NULL), ',') AS tags FROM supplier LEFT JOIN p ON s_suppkey = l_suppkey""")
def _(li, s):
    known = li.where("l_quantity > 48 AND l_linenumber <= 4").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.collect_set(F.col("l_linenumber").cast("string")).alias("partners"))  # four names at most
    return s.join(known.hint("merge"), "s_suppkey", "left").select("s_suppkey", _j(T.coverage_tags(F.col("partners"), ["1"], F.col("s_name"), {"7": "seven"}), "tags"))


@query("g11_value_added_tags", "documents", "SELECT doc_id, array_to_string(list_filter([CASE WHEN contains(t, 'tion') THEN 'action' END, CASE WHEN contains(t, 'ment') THEN 'state' END], lambda x: x IS NOT NULL), ',') AS tags FROM (SELECT doc_id, lower(text) AS t FROM documents)")
def _(d):
    return d.select("doc_id", _j(T.inferred_tags(F.col("text"), {"tion": "action", "ment": "state"}, [], 6), "tags"))


@query("g12_tech_ability_tags", "part", f"SELECT p_partkey, array_to_string([x FOR x IN [CASE WHEN p_type = 'ECONOMY' THEN 'high-tech' END, CASE WHEN p_size >= 50 THEN 'strong' WHEN p_size >= 20 THEN 'fair' END] || {_KEYS} IF x IS NOT NULL], ',') AS tags FROM part")
def _(p):
    n = F.col("p_size")
    return p.select("p_partkey", _j(T.inferred_tags(F.col("p_name"), _NAMES, [(F.col("p_type") == "ECONOMY", "high-tech"), (n >= 50, "strong"), ((n >= 20) & (n < 50), "fair")], 8, first=True), "tags"))


_WORK = "CASE p_partkey % 4 WHEN 0 THEN [CASE WHEN p_size % 6 >= 3 THEN '多条产线' ELSE '产线扩建' END, CASE WHEN p_size / 8 >= 5 THEN '重资产投资' WHEN p_size / 8 >= 1 THEN '产能升级能力' END] WHEN 1 THEN ['产线扩建', '磨削产线'] ELSE [] END"


@query("g13_production_tags", "part", f"SELECT p_partkey, array_to_string([x FOR x IN [CASE p_partkey % 3 WHEN 0 THEN CASE WHEN p_size * 40 >= 1000 THEN '大型生产企业' WHEN p_size * 40 >= 500 THEN '中大型生产企业' WHEN p_size * 40 >= 100 THEN '中型生产企业' ELSE '小型生产企业' END WHEN 1 THEN '中型生产企业' END] || {_WORK} IF x IS NOT NULL], ',') AS tags FROM part")
def _(p):
    """Staff and investments as text, made of each part's size."""
    k, n = F.col("p_partkey"), F.col("p_size")
    staff = F.when(k % 3 == 0, F.concat(F.format_number(n * 40, 0), F.lit("-99999人"))).when(k % 3 == 1, "中型企业").otherwise("未提取到")
    plans = F.when(k % 4 == 0, F.concat(F.lit("投资"), (n / 8).cast("string"), F.lit("亿元建设"), (n % 6).cast("string"), F.lit(" 条生产线"))).when(k % 4 == 1, "磨削产线改造").otherwise("")
    return p.select("p_partkey", F.array_join(T.production_tags(staff, plans), ",").alias("tags"))


@query("g14_cert_ability_tags", "documents", "SELECT doc_id, array_to_string(list_filter([CASE WHEN source IN ('src1', 'src2') THEN 'special' END, CASE WHEN contains(lower(text), 'mit license') THEN 'mit' END], lambda x: x IS NOT NULL), ',') AS tags FROM documents")
def _(d):
    return d.select("doc_id", _j(T.inferred_tags(F.col("text"), {"MIT License": "mit"}, [(F.col("source").isin("src1", "src2"), "special")], 8, first=True), "tags"))


@query("g15_financial_tags", "customer", """SELECT c_custkey, array_to_string([x FOR x IN [CASE c_custkey % 3 WHEN 2 THEN NULL ELSE CASE WHEN n >= 10000 THEN '高注册资本（≥1亿）' WHEN n >= 5000 THEN '高注册资本（≥5000万）' WHEN n >= 1000 THEN '中等注册资本' ELSE '中小规模注册资本' END END, CASE WHEN c_custkey % 5 = 0 THEN '重资产投资' WHEN c_custkey % 5 = 1 THEN '产能升级能力' END] IF x IS NOT NULL], ',') AS tags
    FROM (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN abs(CAST(floor(c_acctbal) AS BIGINT)) ELSE abs(CAST(floor(c_acctbal) AS BIGINT)) % 30 / 10 * 10000 END AS n FROM customer)""")
def _(c):
    """Capital in 万 or 亿 and investments as text, made of each balance."""
    k, n = F.col("c_custkey"), F.abs(F.floor("c_acctbal").cast("long"))
    capital = F.when(k % 3 == 0, F.concat(n.cast("string"), F.lit(" 万元人民币"))).when(k % 3 == 1, F.concat((n % 30 / 10).cast("string"), F.lit("亿元"))).otherwise("未明确")
    plans = F.when(k % 5 == 0, "总投资5.5亿元").when(k % 5 == 1, "投资 1 亿").when(k % 5 == 2, "投资0.9亿").otherwise("")
    return c.select("c_custkey", F.array_join(T.financial_tags(capital, plans), ",").alias("tags"))


@query("g17_tag_gap_merge", "part", "SELECT p_partkey, CASE WHEN contains(p_name, 'ring') THEN 'rings' WHEN p_partkey % 2 = 0 THEN 'answer' ELSE 'name-未明确' END AS tag, CASE WHEN contains(p_name, 'ring') THEN round_even(least(.9::DOUBLE + least(length(p_name) / 100, .05::DOUBLE), .99::DOUBLE), 2) WHEN p_partkey % 2 = 0 THEN .95 ELSE 0 END::DOUBLE AS confidence FROM part")
def _(p):
    rows = tags.tag_rows(p, "p_partkey", "product", "name", tags.keyword_tags(F.col("p_name"), {"ring": "rings"}), "p_name", 0.9)
    answers = p.where("p_partkey % 2 = 0").select("p_partkey", F.lit("name").alias("sub_category"), F.lit("answer").alias("tag"), F.lit(0.99).alias("confidence"))
    return tags.gap_merge(rows, answers, "p_partkey").select("p_partkey", "tag", "confidence")


@query("e1_segment_by_source", "documents", """WITH s AS (SELECT doc_id, string_split_regex(text, '[A-Z][a-z]{5,}') AS b, [''] || regexp_extract_all(text, '([A-Z][a-z]{5,})', 1) AS t FROM documents WHERE text IS NOT NULL), u AS (SELECT doc_id, unnest(t) AS tag, trim(unnest(b)) AS body, generate_subscripts(b, 1) - 1 AS pos FROM s) SELECT * FROM u WHERE body <> ''""")
def _(d):
    return records.segments(d, "doc_id", "text", "([A-Z][a-z]{5,})")


@query("e8_hamming", "orders", "SELECT o_orderkey, bit_count(xor(o_orderkey, o_custkey))::INT AS distance FROM orders")
def _(o):
    return o.select("o_orderkey", text.hamming(F.col("o_orderkey"), F.col("o_custkey")).alias("distance"))


@query("e9_simhash_dedup_in_doc", "documents", f"""WITH {LINES}, t AS (SELECT doc_id, pos, unnest(regexp_extract_all(sentence, '[A-Za-z]{{2,}}|[一-龥]{{2,}}')) AS t FROM s), k AS (SELECT doc_id, pos, ('0x' || md5(t)[17:32])::UBIGINT AS h, count(*) AS c FROM t GROUP BY ALL), b AS (SELECT doc_id, pos, {BITS} AS v FROM k GROUP BY ALL),
    l AS (SELECT doc_id, list([{{'pos': pos, 'h': coalesce(v, 0::HUGEINT)::UBIGINT}}] ORDER BY pos) AS l FROM s LEFT JOIN b USING (doc_id, pos) GROUP BY 1),
    r AS (SELECT doc_id, unnest(list_reduce(l, lambda acc, x: CASE WHEN len(list_filter(acc, lambda y: bit_count(xor(y.h, x[1].h)) <= 3)) = 0 THEN list_concat(acc, x) ELSE acc END)) AS x FROM l)
    SELECT r.doc_id, CAST(s.pos AS BIGINT) AS pos, s.sentence FROM r JOIN s ON r.doc_id = s.doc_id AND r.x.pos = s.pos""")
def _(d):
    lines = text.sentences(d, r"[.;\n]")
    return records.near_lines(lines, "doc_id")


@query("q9_decode_json_columns", "events", "SELECT event_id, CAST(props->>'k' AS INT) AS k, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at FROM events")
def _(e):
    return serving.decode(e, {"props": "struct<k:int>"}, {"ts": "at"}).select("event_id", "props.k", "at")


@query("q11_tag_row_mapping", "part", f"SELECT p_partkey AS enterprise_name, '[' || array_to_string(['\"' || x || '\"' FOR x IN {_KEYS}], ',') || ']' AS products, nullif(CASE WHEN p_partkey % 5 = 0 THEN '' ELSE p_type END, '') AS kind FROM part")
def _(p):
    rows = p.select("p_partkey", tags.keyword_tags(F.col("p_name"), _NAMES).alias("found"), F.when(F.col("p_partkey") % 5 == 0, "").otherwise(F.col("p_type")).alias("type"))
    return serving.tag_row(rows, {"enterprise_name": "p_partkey", "products": "found", "kind": "type"})
