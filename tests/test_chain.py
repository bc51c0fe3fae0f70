"""Edges of companies in one plan, on sentences of the domain and on odd rows."""

from quarrylight.operators.chain import Words, classified_mentions, company_edges
from quarrylight.operators.relations import EDGE

COMPANIES = "own string, text string, bids string, invests string, segment string, own_makes boolean, downstream array<string>, scenes array<string>"
TEXT = "我司长期为上海通达汽车有限公司供货轴承套圈产品。本厂与东方精工集团战略合作开发新品。我厂中标洛阳重工有限公司采购项目，金额500万元。公司投资3.5亿元建设新增产线扩大精密产能。"


def edges(spark, rows, words=None):
    return company_edges(spark.createDataFrame(rows, COMPANIES), words)


def test_domain_sentences(spark):
    words = Words(names=["[一-龥]{2,6}(?:有限公司|集团)"], known=["比亚迪"], kinds=[("客户", ["供货"]), ("合作", ["战略合作"])])
    text = TEXT + "产品也用于比亚迪。"
    out = edges(spark, [("甲轴承厂", text, None, None, "精密轴承", True, ["汽车工业", "未明确"], ["汽车", "风电"])], words)
    assert out.columns == EDGE
    got = {(r["object"], r["rel_type"]): r for r in out.collect()}
    sure = got[("汽车工业", "下游行业")]
    assert sure["confidence"] == 0.85 and "应用场景:汽车" in sure["evidence"] and "比亚迪" in sure["evidence"] and "风电" not in sure["evidence"]
    assert ("未明确", "下游行业") not in got
    (investment,) = [r for (_, t), r in got.items() if t == "投资"]
    assert investment["amount"] == "3.5亿元" and investment["industry"] == "精密轴承"
    assert any(t == "客户" and o.endswith("有限公司") for o, t in got)
    assert all(r["subject"] == "甲轴承厂" and r["object"] for r in got.values())


def test_defaults_and_the_own_name(spark):
    rows = [("洛阳LYC", "洛阳LYC为一汽供货，一汽与洛阳LYC合作多年。", None, None, None, True, None, None)]
    found = classified_mentions(spark.createDataFrame(rows, COMPANIES), Words())
    assert {r["name"] for r in found.where("name = '一汽' OR name = '洛阳LYC'").collect()} == {"一汽"}
    got = {(r["object"], r["rel_type"]): r["industry"] for r in edges(spark, rows).collect()}
    assert got[("一汽", "客户")] == "汽车工业" and ("汽车工业", "下游行业") in got


def test_odd_rows(spark):
    none = [None] * 6
    assert edges(spark, [("a", None, *none), ("b", "", *none)]).count() == 0
    assert edges(spark, []).count() == 0
    one = ("甲", TEXT, "未明确", "未明确", "段", False, [], [])
    once = sorted(map(str, edges(spark, [one]).collect()))
    assert once and sorted(map(str, edges(spark, [one, one]).collect())) == once
    assert edges(spark, [("长", TEXT + "我司为各地客户供货。" * 20_000, *none)]).count() > 0
