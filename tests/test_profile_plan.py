"""The plan from names and pages to sheets, on sentences of the domain and on odd rows; expected values are texts of these sentences."""

from quarrylight.functions import domain as D
from quarrylight.operators.crawl import DETAILS, OVERVIEW
from quarrylight.operators.profile import Labels, profiles
from quarrylight.operators.relations import EDGE

PAGES = "name string, category string, seq long, source string, text string, filled string"
NAME = "洛阳甲轴承有限公司"
SITE = "洛阳甲轴承有限公司成立于2003年5月，注册资本6000万元。法定代表人：王小明，主营深沟球轴承、圆锥滚子轴承。公司与舍弗勒开展战略合作，联合研发风电轴承产品。公司投资3.5亿元建设新增产线5条扩大产能。"
INFO = "经营范围：轴承制造、销售。企业状态存续，员工300人。"
BID = "2024年3月5日，洛阳甲轴承有限公司中标国家电网有限公司轴承采购项目，中标金额：500万元。"


def run(spark, names, pages):
    return profiles(spark.createDataFrame([(n,) for n in names], "name string"), spark.createDataFrame([(*p, "c") for p in pages], PAGES))


def test_a_company_from_pages_to_sheets_and_odd_rows(spark):
    pages = [(NAME, "official_website", 1, "http://a.cn", SITE), (NAME, "business_info", 1, "tianyancha", INFO), (NAME, "bidding_info", 2, "http://www.ccgp.gov.cn/1", BID)]
    odd = [("乙", "other", 1, "x", "y"), ("丙", "official_website", 1, None, "短"), ("无名", "official_website", 1, None, "z"), ("丁", "official_website", 1, "x", " "), ("丁", None, 2, "x", "t"), (None, "official_website", 1, "x", "t"), ("丁", "business_info", 3, "x", None)]
    p = run(spark, [NAME, "乙", "丙", " 乙 ", "丁", None, " "], pages + odd)
    runs = {r["enterprise_name"]: r for r in p.runs.collect()}
    assert {n: r["status"] for n, r in runs.items()} == {NAME: "success", "乙": "failed", "丁": "failed", "丙": "success"}
    a = runs[NAME]
    assert (a["filled"], a["crawl_status"], a["clean_status"]) == (3, "partial", "success")
    assert {n: runs[n]["confidence"] for n in ("乙", "丁")} == {"乙": 0.0, "丁": 0.0} and runs["丙"]["n_tags"] == 0
    fields = {r["enterprise_name"]: r for r in p.fields.collect()}
    f = fields[NAME]
    assert set(fields) == {NAME, "丙"} and (f["short_name"], f["establish_time"], f["legal_person"], f["registered_capital"]) == ("洛阳甲轴承", "2003-05", "王小明", "6000万元人民币")
    assert (f["operating_status"], f["employee_scale"], f["business_scope"]) == ("存续", "150-500人", "轴承制造、销售") and "投资3.5亿元" in f["investment"] and "500万元" in f["bidding"]
    tags = {(r["sub_category"], r["tag"]) for r in p.tags.where(f"enterprise_name = '{NAME}'").collect()}
    assert {("产品类型标签", "深沟球轴承"), ("生产能力标签", "中型生产企业"), ("生产能力标签", "多条产线"), ("资金实力标签", "高注册资本（≥5000万）"), ("产品合规标签", "产品合规标签-未明确")} <= tags
    assert a["n_tags"] == sum(not t.endswith("未明确") for _, t in tags) and {r["source_field"] for r in p.tags.where(f"enterprise_name = '{NAME}' AND sub_category = '应用场景标签'").collect()} <= {"partners", "main_business"}
    sure = [r["confidence"] for r in p.tags.where(f"enterprise_name = '{NAME}' AND confidence > 0").collect()] + [f["clean_confidence"], p.records.where(f"enterprise_name = '{NAME}'").first()["crawl_confidence"]]
    assert abs(a["confidence"] - sum(sure) / len(sure)) <= 0.0051
    (sheet,) = p.overview.where(f"enterprise_name = '{NAME}'").collect()
    assert p.overview.columns == OVERVIEW and sheet["core"].startswith("深沟球轴承、圆锥滚子轴承") and sheet["data_source"] == "企业官网、工商查询平台、招投标平台" and sheet["compliance"] == ""
    edges = p.relations.collect()
    assert p.relations.columns == EDGE and a["n_edges"] == len(edges) and {e["subject"] for e in edges} == {NAME}
    assert {"投资", "下游行业", "客户"} <= {e["rel_type"] for e in edges} and any("舍弗勒" in e["object"] for e in edges)
    details = {r["record_id"]: r for r in p.details.collect()}
    assert p.details.columns == DETAILS and a["n_records"] == len(details) and {"BID-001", "INV-001", "PTN-001"} <= set(details)
    bid = details["BID-001"]
    assert (bid["amount"], bid["amount_unit"], bid["bid_date"], bid["source_platform"]) == ("500", "万元", "2024-03-05", "中国政府采购网")
    flat = {r["enterprise_name"]: r for r in p.flat.collect()}
    assert flat[NAME]["supply"]["tiers"] == ["核心供应商", "战略供应商"] and flat["丙"]["product"]["core"] == ["未明确"]


def test_empty_tables(spark):
    p = run(spark, [], [])
    assert [getattr(p, t).count() for t in ("runs", "fields", "tags", "flat", "edges", "facts", "overview", "relations", "details")] == [0] * 9


def test_scenes_of_companies_follow_their_industries():
    scenes = Labels().partner_scenes
    assert scenes and all(D.SCENE_INDUSTRY[s] in [i for i, names in D.COMPANY_INDUSTRIES if n in names] for n, s in scenes.items())
