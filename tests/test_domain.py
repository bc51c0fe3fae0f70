"""The operators with the words of the domain. Texts and expected values of single cases are fixed values."""

import json

import pytest
from pyspark.sql import functions as F

from quarrylight.operators import crawl, facts, fields, profile_tags, relations, scoring, sites, tags, text, web
from quarrylight.sources import io

OWN = "洛阳LYC轴承有限公司"


def one(spark, value, expr):
    return spark.createDataFrame([(value,)], "x string").select(expr(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(("value", "want"), [("注册资本：5000万元人民币", "5000万元人民币"), ("注册资本：1.5亿元人民币", "1.5亿元人民币"), ("注册资本: 10,000万元", "10000万元人民币"), ("这是一段不包含资本信息的文本", "")])
def test_capital(spark, value, want):
    got = one(spark, value, fields.registered_capital)
    assert got["value"] == want and (got["diagnostics"] is None) == bool(want)


@pytest.mark.parametrize(("value", "want"), [("法定代表人：张三", "张三"), ("法人代表:李四", "李四"), ("主营业务包括轴承的设计与制造，产品质量优秀", "")])
def test_legal_person(spark, value, want):
    got = one(spark, value, fields.legal_person)
    assert (got["value"], got["method"]) == (want, "regex" if want else "miss")


def test_establish_time(spark):
    assert tuple(one(spark, "公司成立于2015年3月20日", fields.establish_time)) == ("2015-03-20", False)
    assert one(spark, "2015年3月20日是一个日期", fields.establish_time)["uncertain"]
    assert tuple(one(spark, None, fields.establish_time)) == ("", True)


@pytest.mark.parametrize("value", ["注册地址：陕西省西安市高新区科技路1号", "浙江省杭州市余杭区文一西路"])
def test_register_address(spark, value):
    assert one(spark, value, fields.addresses)["register"] != ""


def test_other_fields(spark):
    assert one(spark, "生产深沟球轴承、直线导轨和滚珠丝杠", fields.core_products) == ["深沟球轴承", "直线导轨", "滚珠丝杠"]
    assert one(spark, "内径: 25mm，精度等级：P4", fields.product_spec) == "内径: 25mm；精度等级：P4"
    assert tuple(one(spark, "拥有120项专利，其中发明专利30项", fields.patent_count)) == (120, 30)


def test_noise_lines(spark):
    raw = ["查公司 查老板 查关系 开通会员", "公司成立于2015年，主营轴承制造。", "苏ICP备12345号", "about us > home", "a long line of Latin letters that is not short at all", "贝文彪", "沪ICP备9号"]
    lines = spark.createDataFrame([(i, x) for i, x in enumerate(raw)], "pos int, sentence string")
    assert [r["pos"] for r in text.noise_lines(lines).orderBy("pos").collect()] == [1, 4]
    assert [r["pos"] for r in text.noise_lines(lines, high=F.lit(True)).orderBy("pos").collect()] == list(range(7))


def test_scrub(spark):
    assert one(spark, "【来源: https://a.org】【企业官网内容】<b>轴承</b>&nbsp;制造\t 厂\x07\n二 ", text.scrub) == "轴承 制造 厂\n二"


def segment(spark, own, body, kind="bidding_info", partners=None, products=None):
    raw = {kind: body}
    struct = "struct<official_website:string,business_info:string,bidding_info:string,patent_info:string>"
    df = spark.createDataFrame([(own, partners, products, json.dumps(raw, ensure_ascii=False))], "enterprise_name string, cooperative_enterprise string, core_products string, j string")
    return facts.raw_segments(df.withColumn("raw_content", F.from_json("j", struct)))


def records(spark, *args, **kw):
    return [r.asDict() for r in facts.fact_records(segment(spark, *args, **kw)).orderBy("record_id").collect()]


def test_bidding_record(spark):
    got = records(spark, OWN, "【来源: https://www.ccgp.gov.cn/1】2024年3月洛阳LYC轴承有限公司中标金风科技股份有限公司风电主轴轴承采购项目，金额3,200万元")
    assert len(got) == 1
    r = got[0]
    assert (r["record_type"], r["amount"], r["amount_unit"], r["subtype"], r["role"], r["source_platform"], r["record_id"], r["bid_date"]) == ("bidding", "3200", "万元", "中标", "中标方", "中国政府采购网", "BID-001", "2024-03")
    assert "金风" in r["counterparty"] and r["counterparty_industry"] == "风力发电行业" and r["products"] == "轴承" and r["source_url"] == "https://www.ccgp.gov.cn/1"


@pytest.mark.parametrize(
    ("own", "body", "count"),
    [("测试公司", "2024年1月测试公司中标甲项目，金额500万元。2024年2月测试公司中标乙项目，金额800万元。", 2), ("测试公司", "公司主营深沟球轴承，产品质量优秀，服务全国各地用户", 0), ("测试公司", "2024年中标重大项目，金额300万元；2024年中标重大项目，金额300万元，再说一次", 1), ("测试公司", "太短了", 0)],
)
def test_number_of_bids(spark, own, body, count):
    assert len(records(spark, own, body)) == count


def test_amounts_and_dates_of_bids(spark):
    assert [(r["amount"], r["amount_unit"]) for r in records(spark, "测试公司", "2024年中标重大项目，金额1.5亿元，履约期为三年整")] == [("1.5", "亿元")]
    assert [r["bid_date"] for r in records(spark, "测试公司", "2024年3月15日中标XX项目，金额100万元，履约期为三年")] == ["2024-03-15"]


def test_customers_partners_and_suppliers(spark):
    got = records(spark, "测试轴承公司", "公司长期为一汽解放提供配套轴承产品，同时与中车合作供应铁路轴承。", "official_website")
    by = lambda k: {r["counterparty"] for r in got if r["record_type"] == k}
    assert {"一汽", "中车"} <= by("customer") and {"一汽", "中车"} <= by("partnership") and not by("supplier")
    assert {(r["products"], r["relationship_nature"], r["is_current"]) for r in got if r["record_type"] == "customer"} == {("轴承", "供应商", True)}
    got = records(spark, "测试轴承公司", "与洛阳轴承研究所有限公司联合开展高铁轴承技术攻关战略合作项目", "official_website")
    assert [r["subtype"] for r in got if r["record_type"] == "partnership"] == ["战略合作"]
    got = records(spark, "测试轴承公司", "钢材主要采购自宝钢和鞍钢，质量稳定可靠，交货及时。", "official_website")
    assert {r["counterparty"] for r in got if r["record_type"] == "supplier"} == {"宝钢", "鞍钢"}


def test_customers_fall_back_to_listed_partners(spark):
    got = records(spark, "测试公司", "我们是一家历史悠久的企业，员工众多，技术精湛。", "official_website", partners="一汽、某某公司；x", products="钢球")
    assert [(r["counterparty"], r["products"], r["counterparty_industry"], r["evidence_type"]) for r in got] == [("一汽", "钢球", "汽车工业", "结构化字段"), ("某某公司", "钢球", "", "结构化字段")]


def test_investments(spark):
    got = records(spark, "测试公司", "2023年新增精密轴承生产线项目，总投资1.5亿元，预计明年投产", "official_website")
    assert [(r["amount"], r["amount_unit"], r["subtype"], r["bid_date"], r["products"]) for r in got if r["record_type"] == "investment"] == [("1.5", "亿元", "新建", "2023", "轴承")]


def test_segments_keep_their_urls(spark):
    rows = segment(spark, "a", "【来源: https://one.org】第一段的内容足够长，超过二十个字符才会保留下来【来源：https://www.qcc.com/x】第二段的内容足够长，超过二十个字符才会保留下来【来源: c】短", "business_info").orderBy("seg").collect()
    assert [(r["source_url"], r["source_platform"]) for r in rows] == [("https://one.org", "工商查询平台"), ("https://www.qcc.com/x", "企查查")]


def test_summary_without_content(spark):
    df = spark.createDataFrame([("a", "", None), ("b", "x", "y")], "enterprise_name string, official_website string, bidding_info string")
    none = facts.fact_records(segment(spark, "b", "", "bidding_info"))
    got = facts.fact_summary(df, none, "enterprise_name", ["bidding"], ["official_website", "bidding_info"]).orderBy("enterprise_name").collect()
    assert [tuple(r) for r in got] == [("a", False, False, 0, 0, 0.0), ("b", True, True, 0, 0, 0.0)]


def test_edges_of_investment_and_bids(spark):
    df = spark.createDataFrame([("甲公司", None, "2023年甲公司投资建设风电轴承新产线，总投资2.5亿元人民币。其他。乙重工有限公司与甲公司签订招标合同，金额30万元整。", "轴承")], "own string, field string, text string, segment string")
    got = relations.investment_edges(df, "own", "field", "text", "segment").collect()
    assert [(r["rel_type"], r["amount"], r["industry"], r["confidence"]) for r in got] == [("投资", "2.5亿元", "轴承", 0.85)]
    got = relations.bidding_edges(df, "own", "field", "text", ["[一-龥]{2,8}(?:有限公司|集团)"]).collect()
    assert [(r["object"], r["amount"], r["rel_type"], r["confidence"]) for r in got] == [("乙重工有限公司", "30万元", "客户", 0.78)]


def test_flat_columns(spark):
    df = spark.createDataFrame([("研发、深沟球轴承生产", "SKF、一汽、中车", "6000万元")], "business string, partners string, capital string")
    scenes, none = F.array(F.lit("汽车"), F.lit("风电")), F.lit(None).cast("string")
    x = df.select(profile_tags.flat_supply_chain(F.col("partners"), none, F.col("business"), none, F.col("capital"), none, F.array(F.lit("批量供货")), F.array().cast("array<string>"), scenes).alias("x"), profile_tags.flat_application(scenes, none).alias("y")).first()
    assert (x["x"]["chain"], x["x"]["customers"]) == (["头部企业供应商", "多客户供应", "批量供应商"], ["头部企业客户", "多类型客户", "B2B企业客户", "车企客户", "风电设备商客户"])
    assert (x["x"]["roles"], x["x"]["tiers"]) == (["研产一体化供应商"], ["一级供应商", "核心供应商"])
    assert x["y"]["downstream"] == ["汽车工业", "风力发电行业"] and x["y"]["description"] == "主要应用于汽车、风电领域"


def test_result_links_by_engine(spark):
    page = '<a href="https://a.org/1?x=1" class="vr-title">t</a><a href="https://b.org/2">u</a><cite>https://c.org/3<b>x</b></cite>'
    df = spark.createDataFrame([(1, "搜狗", page), (2, "必应", page), (3, "x", page)], "k int, engine string, html string")
    got = {k: [r["link"] for r in crawl.result_links(df.where(f"k = {k}"), "k", "html", "engine", ["b.org"]).orderBy("pos").collect()] for k in (1, 2, 3)}
    assert got == {1: ["https://a.org/1", "https://c.org/3x"], 2: ["https://c.org/3x", "https://a.org/1"], 3: ["https://a.org/1", "https://c.org/3x"]}


def test_deep_targets(spark):
    links = spark.createDataFrame([("s.org", "https://s.org/", i, f"https://s.org/{'about' if i % 2 else 'z'}{i}") for i in range(20)] + [("s.org", "https://s.org/", 30, "https://s.org/"), ("s.org", "https://s.org/", 31, "https://t.org/about")], "site string, url string, pos int, link string")
    got = web.deep_targets(links, "site", "url", ["pos"]).collect()
    assert sorted(r["link"] for r in got) == sorted([f"https://s.org/about{i}" for i in range(1, 12, 2)] + ["https://s.org/z0", "https://s.org/z2"])


def test_close_pairs_equal_brute_force(spark):
    import random

    rng = random.Random(9)
    base = [rng.getrandbits(64) for _ in range(40)]
    values = sorted({b ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(5))) for b in base for _ in range(6)} | {0, 1})
    signed = [(i, v - 2**64 if v >= 2**63 else v) for i, v in enumerate(values)]
    got = sorted((r["id"], r["id2"]) for r in text.close_pairs(spark.createDataFrame(signed, "id long, simhash long")).collect())
    assert got == [(i, j) for i in range(len(values)) for j in range(i + 1, len(values)) if (values[i] ^ values[j]).bit_count() <= 3]


def test_tables_under_a_name_and_configuration(spark, tmp_path):
    df = spark.createDataFrame([(2, "b"), (1, "a")], "id int, name string")
    assert io.save_as(df, "facts_of_test").count() == 2
    with pytest.raises(ValueError):
        io.save_as(df, "a; drop")
    crawl.write_config(crawl.config_rows(df, ["id", "name"], "id", "name"), str(tmp_path / "c"))
    assert [json.loads(r["value"])["name"] for r in spark.read.text(str(tmp_path / "c")).collect()] == ["b", "a"]
    spark.sql("DROP TABLE facts_of_test")


@pytest.mark.parametrize(("value", "want"), [("中标供应商：某公司，地址：洛阳市涧西区建设路1号", "洛阳市涧西区建设路1号"), ("在深圳市南山区科技园路新城12号办公", "深圳市南山区科技园路新城12号"), ("深圳市南山区", ""), ("没有", ""), (None, "")])
def test_address_fallbacks(spark, value, want):
    got = one(spark, value, lambda c: fields.addresses(c, patterns=[r"(no such [a-z]+)"]))
    assert got["register"].startswith(want) if want else got["register"] == ""


@pytest.mark.parametrize(("value", "want"), [("员工：120人", "50-150人"), ("规模100-499人", "150-500人"), ("规模100至5000 人", "1000-5000人"), ("现有职工约30人", "50人以下"), ("10000人以上", "5000人以上"), ("人员 49 人", "50人以下"), ("员工若干", ""), (None, "")])
def test_employee_scale(spark, value, want):
    assert one(spark, value, fields.employee_scale) == want


@pytest.mark.parametrize(("value", "want"), [("拥有120项专利", "120项"), ("轴承企业，拥有120项专利，密封与磨削、热处理领先", "120项（含轴承、密封、热处理相关）"), ("发明：授权30项专利", "30项（发明专利30项）"), ("没有", ""), (None, "")])
def test_patent_text(spark, value, want):
    assert one(spark, value, fields.patent_text) == want


def test_business_and_industry_fall_back_on_the_scope(spark):
    df = spark.createDataFrame([("生产深沟球轴承", ""), ("一般企业", "轴承钢销售；软件开发"), ("一般企业", "从事磨削"), (None, None)], "t string, s string")
    t, s = F.col("t"), F.col("s")
    got = df.select(fields.main_business(t, s).alias("b"), fields.industry_class(t, scope=s).alias("i")).collect()
    assert [r["b"] for r in got] == ["滚动轴承制造", "轴承钢材料", "", ""]
    assert [r["i"] for r in got] == ["滚动轴承制造", "信息技术服务", "轴承制造", ""]


@pytest.mark.parametrize(("staff", "plans", "want"), [("1,200人", "投资6.5亿元建设3条生产线，含锻造与装配", ["大型生产企业", "多条产线", "重资产投资", "锻造产线", "装配产线"]), ("500-1000人", "1亿元", ["中大型生产企业", "产能升级能力"]), ("大型", "产线扩建", ["大型生产企业", "产线扩建"]), ("99人", "未明确", ["小型生产企业"]), ("若干", "", []), (None, None, [])])
def test_production_tags(spark, staff, plans, want):
    df = spark.createDataFrame([(staff, plans)], "a string, b string")
    assert df.select(profile_tags.production_tags(F.col("a"), F.col("b")).alias("x")).first()["x"] == want


@pytest.mark.parametrize(("capital", "plans", "want"), [("1.5亿元人民币", "5亿", ["高注册资本（≥1亿）", "重资产投资"]), ("5000万元人民币", "1.0 亿元", ["高注册资本（≥5000万）", "产能升级能力"]), ("1000万", "", ["中等注册资本"]), ("壹佰万", "0.9亿", ["中小规模注册资本"]), ("未明确", None, [])])
def test_financial_tags(spark, capital, plans, want):
    df = spark.createDataFrame([(capital, plans)], "a string, b string")
    assert df.select(profile_tags.financial_tags(F.col("a"), F.col("b")).alias("x")).first()["x"] == want


def test_clean_notes_and_diagnostics(spark):
    core = lambda n: [F.lit("x") if i < n else F.lit("") for i in range(4)]
    note = lambda n, t="t": spark.range(1).select(fields.clean_note(F.lit(t), core(n), F.lit(7)).alias("x")).first()["x"]
    assert [note(n) for n in (4, 3, 1, 0)] == ["所有核心字段提取完整", "部分字段提取成功，7 个字段不确定", "核心字段提取不充分，仅1个字段有值，7 个字段不确定", "核心字段提取不足，但已尽力提取可用信息"]
    assert note(4, "") == "输入数据为空或格式错误"
    got = one(spark, "没有资本", lambda c: fields.diagnostics({"registered_capital": fields.registered_capital(c)["diagnostics"], "other": F.lit(None).cast("struct<reason:string,text_sample:string,tried_patterns:array<string>>")}))
    assert list(got) == ["registered_capital"] and got["registered_capital"]["text_sample"] == "没有资本"


def test_terms_replaced_in_one_pass(spark):
    terms = [("导轨", "直线导轨"), ("直线导轨", "直线导轨"), ("a.b", "x"), ("a", "b")]
    assert one(spark, "直线导轨与导轨 a.b axb\n", lambda c: tags.normalize_terms(c, terms, longest_first=True)) == "直线导轨与直线导轨 x bxb\n"
    assert one(spark, "直线导轨", lambda c: tags.normalize_terms(c, terms)) == "直线直线导轨"


@pytest.mark.parametrize(("value", "want"), [("2019 2025", 1.0), ("2024年", 0.7), ("2023", 0.4), ("2028-05", 0.8), ("2031", 0.3), ("2019", 0.3), ("", 0.0)])
def test_freshness(spark, value, want):
    assert one(spark, value, lambda c: scoring.freshness(c, 2026)) == want


def test_relevance_and_confidence(spark):
    text_ = "洛阳轴承有限公司生产轴承和滚子。其他。洛阳轴承的密封件"
    got = one(spark, text_, lambda c: sites.relevance(c, "洛阳轴承有限公司", "洛阳轴承", ["轴承", "滚子", "密封"]))
    assert got == pytest.approx(min(1, 0.05 + 2 * 0.03 + 4 * 0.1))
    assert [one(spark, t, lambda c: sites.relevance(c, "ab", "b", ["x"])) for t in ("", None, "b b b", "ab")] == [0.0, 0.0, 0.1, 0.1]
    assert one(spark, "x", lambda c: F.struct(sites.discounted(F.lit(0.9), F.lit(0.29)).alias("a"), sites.discounted(F.lit(0.9), F.lit(0.3)).alias("b"))) == (pytest.approx(0.54), 0.9)


def test_all_pages_of_a_record(spark):
    rows = [("k", "a", f"u{i}" + "x" * 100, f" text {i} " * 700, i) for i in range(9)] + [("k", "b", None, "  ", 1), (None, "a", "u", "t", 1), ("k", "z", "u", "t", 1), ("k", "a", "u", None, 99)]
    df = spark.createDataFrame(rows, "key string, cat string, url string, text string, seq int")
    got = crawl.assemble(df, "key", "cat", ["b", "a", "c"], "url", "text", "seq").collect()
    want = "".join(f"【来源: {u[:80]}】\n{t[:5000]}\n\n" for _, c, u, t, _ in rows if c == "a" and t and _ is not None and u != "u")
    assert len(got) == 1 and got[0]["a"] == want and got[0]["b"] == "【来源: 】\n  \n\n" and got[0]["c"] == ""
    assert got[0]["all_content"] == "【来源: 】\n\n" + want.strip()


def test_downstream_edges(spark):
    flat = spark.createDataFrame([("甲", ["汽车工业", "未明确", "电梯行业"], ["汽车", "汽车电子", "风电"])], "own string, downstream array<string>, scenes array<string>")
    seen = spark.createDataFrame([("甲", 2, "乙", "汽车工业"), ("甲", 1, "丙", "汽车工业"), ("甲", 3, "丁", "风力发电行业"), ("甲", 4, "戊", "风力发电行业"), ("甲", 5, "己", "轴承制造行业"), ("甲", 6, "庚", ""), (None, 1, "x", "y")], "own string, seq int, name string, industry string")
    got = {r["object"]: (r["evidence"], r["confidence"], r["data_source"]) for r in relations.downstream_edges(flat, seen).collect()}
    assert got == {"汽车工业": ("应用场景:汽车；应用场景:汽车电子；关联企业:丙；关联企业:乙", 0.85, "标签推断"), "电梯行业": ("应用场景/业务范围推断", 0.85, "标签推断"), "风力发电行业": ("关联企业:丁推断", 0.75, "原始文本推断")}


def test_crawl_reader(spark, tmp_path):
    record = {"enterprise_name": "甲", "raw_content": {"official_website": " a ", "business_info": "", "bidding_info": "b"}, "confidence": 0.5}
    (tmp_path / "r.json").write_text(json.dumps(record, ensure_ascii=False, indent=1))
    (tmp_path / "s.json").write_text(json.dumps({"enterprise_name": "乙", "raw_content": {"all_content": "  "}}))
    assert [(r["enterprise_name"], r["text"]) for r in io.read_crawl(spark, str(tmp_path)).collect()] == [("甲", "a\nb")]
