"""Tag generators and flat business columns: arrays of labels from a company's fields. Dictionaries are arguments.

A null or missing field gives no label; ``tags.tag_rows`` turns empty results into uncertain tags.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarrylight.functions import domain
from quarrylight.functions.exprs import any_hit, is_missing, map_first, words_array
from quarrylight.operators.tags import keyword_tags, normalize_terms


def _parts(c: Column, delimiters: str) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), delimiters), lambda x: F.trim(x)), lambda x: x != "")


def product_types(products: Column, other: Column, labels: dict[str, str], terms: list[tuple[str, str]], most: int = 8, longest: int = 20) -> Column:
    """Labels of keywords in both fields; if there are none, the items of the first one, normalised."""
    found = keyword_tags(F.concat_ws(" ", products, other), labels)
    items = F.array_distinct(F.transform(F.filter(_parts(products, "[、,，;；]"), lambda x: F.length(x) <= longest), lambda x: normalize_terms(x, terms)))
    return F.slice(F.when(F.size(found) > 0, found).otherwise(items), 1, most)


def product_specs(spec: Column, most: int = 10) -> Column:
    """Parts by ; or line; ``class：a,b`` becomes class-a and class-b."""
    def spread(p: Column) -> Column:
        head, tail = F.trim(F.regexp_extract(p, "^([^：:]*)[：:]", 1)), F.regexp_extract(p, "^[^：:]*[：:](.*)$", 1)
        return F.when(p.rlike("[：:]"), F.transform(_parts(tail, "[,，、]"), lambda x: F.concat(head, F.lit("-"), x))).otherwise(F.array(p))

    return F.slice(F.flatten(F.transform(_parts(spec, r"[;；\n]"), spread)), 1, most)


def application_tags(partners: Column, scenes: dict[str, str], text: Column, labels: dict[str, str], most: int = 8) -> Column:
    """Scenes of known partners and labels of keywords, sorted."""
    table = F.create_map(*[F.lit(x) for kv in scenes.items() for x in kv])
    known = F.transform(F.filter(F.coalesce(partners, F.array()), lambda p: p.isin(*scenes)), lambda p: table[p])
    return F.slice(F.array_sort(F.array_union(known, keyword_tags(text, labels))), 1, most)


def compliance_tags(certs: Column, terms: list[tuple[str, str]], verbs: list[str], most: int = 10) -> Column:
    clean = lambda x: F.trim(F.regexp_replace(normalize_terms(x, terms), "|".join(verbs), ""))
    return F.slice(F.array_distinct(F.filter(F.transform(_parts(certs, "[、,，;；]"), clean), lambda x: x != "")), 1, most)


def inferred_tags(text: Column, labels: dict[str, str], extra: list[tuple[Column, str]], most: int, first: bool = False) -> Column:
    """Labels of keywords, and those whose condition holds, before or after them."""
    more = F.array_compact(F.array(*[F.when(c, F.lit(label)) for c, label in extra])) if extra else F.array().cast("array<string>")
    words = keyword_tags(text, labels) if labels else F.array().cast("array<string>")
    return F.slice(F.array_union(more, words) if first else F.array_union(words, more), 1, most)


def all_of(text: Column, words: list[str]) -> Column:
    out = F.lit(True)
    for w in words:
        out = out & F.contains(F.coalesce(text, F.lit("")), F.lit(w))
    return out


def coverage_tags(partners: Column, famous: list[str], address: Column, cities: dict[str, str], least: int = 3, most: int = 6) -> Column:
    """Nationwide from three partners on, else well-known or regional; and the cluster of the address."""
    n = F.size(F.coalesce(partners, F.array().cast("array<string>")))
    reach = F.when(n >= least, "全国").when(F.arrays_overlap(partners, words_array(famous)), "知名客户").when(n > 0, "区域")
    return F.slice(F.array_union(F.array_compact(F.array(reach)), keyword_tags(address, cities)), 1, most)


def amount_tags(capital_wan: Column, cuts: list[tuple[float, str]], last: str, extra: list[tuple[Column, str]] = (), most: int = 6) -> Column:
    """The label of the first cut that the capital reaches, from the largest on, and further ones by condition."""
    label = F.lit(last)
    for cut, name in sorted(cuts):
        label = F.when(capital_wan >= cut, name).otherwise(label)
    return F.slice(F.array_compact(F.array(F.when(capital_wan.isNotNull(), label), *[F.when(c, F.lit(x)) for c, x in extra])), 1, most)


def _number(text: Column, pattern: str) -> Column:
    return F.regexp_extract(F.coalesce(text, F.lit("")), pattern, 1).try_cast("double")


def _invested(investment: Column) -> Column:
    """By the first amount in 亿."""
    n = _number(investment, r"(\d+(?:\.\d+)?)\s*亿")
    return F.when(n >= 5, "重资产投资").when(n >= 1, "产能升级能力")


def production_tags(staff: Column, investment: Column, lines: dict[str, str] = domain.LINES, most: int = 8) -> Column:
    """The class of the first number of staff, or of a word; how many lines are built; the amount; the processes. Missing fields give none."""
    n, size = _number(F.replace(staff, F.lit(","), F.lit("")), r"(\d+)"), F.lit("小型生产企业")
    for cut, label in reversed(domain.STAFF_CLASSES):
        size = F.when(n >= cut, label).otherwise(size)
    size = F.when(~is_missing(staff), F.when(n.isNotNull(), size).otherwise(F.nullif(map_first(staff, domain.STAFF_CLASS_WORDS), F.lit(""))))
    built = F.when(any_hit(investment, ["生产线", "产线"]), F.when(_number(investment, r"(\d+)\s*条") >= 3, "多条产线").otherwise("产线扩建"))
    words = [F.when(any_hit(investment, [w]), F.lit(label)) for w, label in lines.items()]
    found = F.array_compact(F.array(size, *[F.when(~is_missing(investment), c) for c in (built, _invested(investment), *words)]))
    return F.slice(F.array_distinct(found), 1, most)


def financial_tags(capital: Column, investment: Column, most: int = 6) -> Column:
    """The class of the capital in 万, an amount in 亿 counting ten thousand times, and the investment. Missing fields give none."""
    large, small = _number(capital, r"(\d+(?:\.\d+)?)\s*亿"), _number(capital, r"(\d+(?:\.\d+)?)\s*万")
    n, label = F.coalesce(large * 10000, small, F.lit(0.0)), F.lit("中小规模注册资本")
    for cut, name in reversed(domain.CAPITAL_CLASSES):
        label = F.when(n >= cut, name).otherwise(label)
    return F.slice(F.array_compact(F.array(F.when(~is_missing(capital), label), F.when(~is_missing(investment), _invested(investment)))), 1, most)


def _joined(c: Column, n: int) -> Column:
    return F.array_join(F.slice(c, 1, n), "、")


def _lines(parts: list[tuple[str, Column, int]], default: str) -> Column:
    """``label：a、b`` of the first tags of the arrays that aren't empty, joined by ；."""
    out = F.concat_ws("；", *[F.when(F.size(c) > 0, F.concat(F.lit(f"{label}："), _joined(c, n))) for label, c, n in parts])
    return F.when(out == "", default).otherwise(out)


def _or(c: Column, default: str = "未明确") -> Column:
    return F.when(F.size(c) > 0, c).otherwise(words_array([default]))


def _known(c: Column) -> Column:
    return F.when(is_missing(c), F.lit("")).otherwise(c)


def _labels(text: Column, labels: dict[str, str]) -> Column:
    """Distinct labels of the words that the text holds, in order; case counts."""
    return F.array_distinct(F.array_compact(F.array(*[F.when(F.contains(F.coalesce(text, F.lit("")), F.lit(w)), F.lit(x)) for w, x in labels.items()])))


def flat_product(fields: list[Column], core: Column, specs: Column, compliance: Column, stop: list[str] = domain.PRODUCT_STOP, listed: list[str] = domain.HIGH_END, words: list[str] = domain.HIGH_END_SPECS, longest: int = 15) -> Column:
    """struct(main, core, high_end, keywords, description).

    main: up to 8 items of the fields without stop words, else the first 5 core products; high_end: core products that are
    listed, then specifications with one of the words; keywords: core products and the first 3 certificates, up to 10.
    """
    items = F.array_distinct(F.filter(F.flatten(F.array(*[_parts(_known(f), r"[,，、；;/\s]+") for f in fields])), lambda x: (F.length(x) <= longest) & ~x.isin(*stop)))
    main = F.when(F.size(items) > 0, F.slice(items, 1, 8)).otherwise(F.slice(core, 1, 5))
    high = F.array_union(F.array_intersect(core, words_array(listed)), F.filter(specs, lambda s: any_hit(s, words)))
    lines = _lines([("核心产品", core, 5), ("产品规格", specs, 5), ("合规认证", compliance, 3)], "产品信息未明确")
    return F.struct(main.alias("main"), _or(F.slice(core, 1, 8)).alias("core"), high.alias("high_end"), _or(F.slice(F.array_union(core, F.slice(compliance, 1, 3)), 1, 10)).alias("keywords"), lines.alias("description"))


def flat_process(
    fields: list[Column], spec: Column, patents: Column, tech: Column, production: Column, crafts: dict[str, list[str]] = domain.CRAFTS, patent_crafts: dict[str, str] = domain.PATENT_CRAFTS,
    spec_crafts: dict[str, str] = domain.SPEC_CRAFTS, special: dict[str, str] = domain.SPECIAL_CRAFTS, technique: str = "技术", abilities: list[str] = domain.ABILITY_TAGS,
) -> Column:
    """struct(process, core, manufacturing, special, description).

    process: a craft's words where its name and they are in the fields, then tags of techniques; core: by words of the
    patents, else the first 3 processes; manufacturing: tags of ability and production; special: by words of the specification, then of the fields.
    """
    text = F.concat_ws(" ", *[F.coalesce(f, F.lit("")) for f in fields])
    has = lambda w: F.contains(text, F.lit(w))
    words = F.array_compact(F.array(*[F.when(has(name) & has(w), F.lit(w)) for name, ws in crafts.items() for w in ws[1:]]))
    process = _or(F.array_union(words, F.filter(tech, lambda t: F.contains(t, F.lit(technique)))))
    by_patent = _labels(_known(patents), patent_crafts)
    core = F.when(F.size(by_patent) > 0, by_patent).otherwise(F.slice(process, 1, 3))
    made = _or(F.array_union(F.array_intersect(tech, words_array(abilities)), production))
    extra = F.array_union(_labels(_known(spec), spec_crafts), _labels(text, special))
    lines = _lines([("核心工艺", core, 3), ("制造能力", made, 3), ("特种工艺", extra, 3)], "工艺能力未明确")
    return F.struct(F.slice(process, 1, 8).alias("process"), F.slice(core, 1, 5).alias("core"), F.slice(made, 1, 8).alias("manufacturing"), F.slice(extra, 1, 5).alias("special"), lines.alias("description"))


def flat_application(scenes: Column, partners: Column, industries: dict[str, str] = domain.SCENE_INDUSTRY) -> Column:
    """struct(scenes, top, downstream, description); downstream industries are sorted."""
    first = F.when(F.size(scenes) > 0, F.concat(F.lit("主要应用于"), _joined(scenes, 5), F.lit("领域")))
    lines = F.concat_ws("；", first, F.when(~is_missing(partners), F.concat(F.lit("服务客户包括"), partners)))
    return F.struct(_or(scenes).alias("scenes"), _or(F.slice(scenes, 1, 3)).alias("top"), _or(downstream(scenes, industries)).alias("downstream"), F.when(lines == "", "应用领域未明确").otherwise(lines).alias("description"))


def flat_supply_chain(
    partners: Column, bids: Column, business: Column, scope: Column, capital: Column, investment: Column, modes: Column, coverage: Column, scenes: Column, chain: list[str] = domain.FAMOUS_CHAIN,
    customers: list[str] = domain.FAMOUS_CUSTOMERS, tier: list[str] = domain.FAMOUS_TIER, scene_customers: dict[str, str] = domain.SCENE_CUSTOMERS, least_capital: float = 5000,
) -> Column:
    """struct(chain, customers, roles, tiers, description); capital counts in 万."""
    names = _parts(_known(partners), "[,，、；;]+")
    some, famous = F.size(names) > 0, lambda listed: F.arrays_overlap(names, words_array(listed))
    labels = lambda rules: F.array_distinct(F.array_compact(F.array(*[F.when(c, F.lit(x)) for c, x in rules])))
    mode = lambda m: F.array_contains(modes, m)
    text = F.concat_ws(" ", F.coalesce(business, F.lit("")), F.coalesce(scope, F.lit("")))
    has = lambda *ws: any_hit(text, list(ws))
    yi, wan = (F.regexp_extract(_known(capital), rf"(\d+(?:\.\d+)?)\s*{u}", 1).try_cast("double") for u in ("亿", "万"))
    links = labels([(famous(chain), "头部企业供应商"), (F.size(names) >= 3, "多客户供应"), (F.contains(_known(bids), F.lit("中标")), "中标供应商"), (mode("供应链配套"), "供应链配套商"), (mode("批量供货"), "批量供应商")])
    kinds = labels([(famous(customers), "头部企业客户"), (F.size(names) >= 3, "多类型客户"), (some, "B2B企业客户"), *[(F.array_contains(scenes, s), x) for s, x in scene_customers.items()]])
    main = F.when(has("研发") & has("生产"), "研产一体化供应商").when(has("生产", "制造"), "制造商").when(has("研发", "设计"), "设计服务商")
    roles = F.array_distinct(F.array_compact(F.array(main, *[F.when(c, F.lit(x)) for c, x in ((has("锻造") & has("车削"), "锻件供应商"), (has("代工", "OEM"), "代工厂"), (mode("供应链配套"), "配套供应商"), (mode("定制化服务"), "定制化供应商"))])))
    tiers = labels([(famous(tier), "一级供应商"), (F.coalesce(yi * 10000, wan, F.lit(0.0)) >= least_capital, "核心供应商"), (~is_missing(investment), "战略供应商")])
    lines = F.concat_ws("；", F.when(~is_missing(partners), F.concat(F.lit("合作企业："), partners)), *[F.when(F.size(c) > 0, F.concat(F.lit(f"{x}："), F.array_join(c, "、"))) for x, c in (("合作模式", modes), ("覆盖范围", coverage))])
    return F.struct(_or(links).alias("chain"), _or(kinds).alias("customers"), _or(roles, "供应商").alias("roles"), _or(tiers, "常规供应商").alias("tiers"), F.when(lines == "", "供应链信息未明确").otherwise(lines).alias("description"))


def downstream(scenes: Column, industries: dict[str, str]) -> Column:
    """Industries of the scenes, sorted."""
    table = F.create_map(*[F.lit(x) for kv in industries.items() for x in kv])
    return F.array_sort(F.array_distinct(F.transform(F.filter(scenes, lambda s: s.isin(*industries)), lambda s: table[s])))
