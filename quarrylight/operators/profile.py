"""Profiles of companies in one plan: names and pages become crawl records, fields, tags, flat columns, edges, transaction records and sheets.

Names are rows (name); pages are rows (name, category, seq, source, text), seq tells a company's pages apart. Every table is written once,
so a later step reads what an earlier one has made instead of extracting it again. Steps after the crawl take the companies that have
text; the others stay in ``runs`` as failed. Null and blank names go, a repeated name is one company, and pages of other names,
of null or other categories or without text count for nothing.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylight.functions import domain as D
from quarrylight.functions.exprs import is_missing, map_all, map_first, words_array
from quarrylight.operators import crawl, facts, fields, profile_tags, sites, tags
from quarrylight.operators.chain import Words, company_edges
from quarrylight.sources.io import saved

CATEGORIES = list(D.CATEGORY_PLATFORMS)
CORE = ["enterprise_name", "establish_time", "registered_capital", "business_scope"]
FIELDS = "establish_time register_address legal_person registered_capital enterprise_type operating_status business_scope main_business core_products product_spec employee_scale patents certifications bidding investment partners industry".split()
COMPLIANCE = "产品合规标签"
MONEY = r"[\d,.]+\s*[亿万]?元"


def _scenes_of_companies() -> dict[str, str]:
    """The first scene of the industry of each listed company."""
    scene_of = {industry: scene for scene, industry in reversed(D.SCENE_INDUSTRY.items())}
    return {n: scene_of[industry] for industry, names in D.COMPANY_INDUSTRIES if industry in scene_of for n in names}


@dataclass
class Labels:
    """What tags are made of: words and their labels."""

    products: dict[str, str] = field(default_factory=lambda: {w: w for w in D.CORE_PRODUCTS})
    scenes: dict[str, str] = field(default_factory=lambda: {s: s for s in D.SCENE_INDUSTRY})
    partner_scenes: dict[str, str] = field(default_factory=lambda: _scenes_of_companies())
    terms: list[tuple[str, str]] = field(default_factory=list)
    verbs: list[str] = field(default_factory=lambda: ["通过", "获得", "取得"])
    services: dict[str, str] = field(default_factory=lambda: {"研发": "研发", "生产": "生产", "销售": "销售"})
    modes: dict[str, str] = field(default_factory=lambda: {"配套": "供应链配套", "批量": "批量供货", "定制": "定制化服务"})
    techniques: dict[str, str] = field(default_factory=lambda: {w: f"{w}技术" for w in D.PATENT_TOPICS})
    cities: dict[str, str] = field(default_factory=lambda: {p: p for p in D.PROVINCES})
    famous: list[str] = field(default_factory=lambda: D.FAMOUS_CHAIN)
    certificates: list[tuple[str, list[str]]] = field(default_factory=lambda: D.CERTIFICATIONS)


@dataclass
class Profiles:
    runs: DataFrame  # one row a company: status, confidence and counts of every step
    records: DataFrame  # crawl records
    fields: DataFrame
    tags: DataFrame  # long form
    flat: DataFrame
    edges: DataFrame
    facts: DataFrame
    overview: DataFrame  # the three sheets
    relations: DataFrame
    details: DataFrame


def crawl_records(names: DataFrame, pages: DataFrame) -> DataFrame:
    """(enterprise_name, a column a category, all_content, filled, crawl_confidence, crawl_status) of every name."""
    own = names.select(F.trim("name").alias("name")).where("name <> ''").distinct()
    items = pages.select(F.trim("name").alias("name"), "category", "seq", "source", "text").where(F.col("category").isin(*CATEGORIES) & (F.trim("text") != ""))
    whole = crawl.assemble(items, "name", "category", CATEGORIES, "source", "text", "seq")
    scores = sites.crawl_score(items, "name", "category", "text").withColumnRenamed("confidence", "crawl_confidence").withColumnRenamed("status", "crawl_status")
    rows = own.join(whole.hint("merge"), "name", "left").join(scores.hint("merge"), "name", "left")
    texts = [F.coalesce(c, F.lit("")).alias(c) for c in (*CATEGORIES, "all_content")]
    return rows.select(F.col("name").alias("enterprise_name"), *texts, F.coalesce("filled", F.lit(0)).alias("filled"), F.coalesce("crawl_confidence", F.lit(0.2)).alias("crawl_confidence"), F.coalesce("crawl_status", F.lit("failed")).alias("crawl_status"))


def company_fields(records: DataFrame, labels: Labels) -> DataFrame:
    """The fields of every company with text: lists as arrays, '' for what isn't found, and status, note and confidence over them."""
    t, own = F.col("all_content"), F.col("enterprise_name")
    rows = records.where("crawl_status <> 'failed'").withColumns({"_scope": fields.business_scope(t), "_address": fields.addresses(t)})
    rows = rows.select(
        "enterprise_name", tags.short_name(own).alias("short_name"), fields.establish_time(t)["value"].alias("establish_time"), F.col("_address.register").alias("register_address"), F.col("_address.actual").alias("actual_address"),
        fields.legal_person(t)["value"].alias("legal_person"), fields.registered_capital(t)["value"].alias("registered_capital"), map_first(t, D.ENTERPRISE_TYPES).alias("enterprise_type"), map_first(t, D.STATUSES).alias("operating_status"),
        F.col("_scope").alias("business_scope"), fields.main_business(t, F.col("_scope")).alias("main_business"), fields.core_products(t).alias("core_list"), fields.product_spec(t).alias("product_spec"), fields.employee_scale(t).alias("employee_scale"),
        fields.patent_text(t).alias("patents"), F.array_join(map_all(t, labels.certificates), "、").alias("certifications"), fields.bidding_project(t, [], D.BIDDING_CONTEXT, MONEY, own, ["项目"], r"[。；\n]").alias("bidding"),
        fields.bidding_project(t, [], D.INVESTMENT_CONTEXT, MONEY, own, D.INVESTMENT_WORDS, r"[。；\n]").alias("investment"), fields.partners(t, D.ANY_COMPANY, own, D.KNOWN, []).alias("partner_list"),
        fields.industry_class(t, scope=F.col("_scope")).alias("industry"), F.substring(t, 1, 1).alias("some"),
    ).withColumns({"core_products": F.array_join("core_list", "、"), "partners": F.array_join("partner_list", "、")})
    core, extra = [F.col(c) for c in CORE], [(F.col(c), x) for c, x in (("patents", 0.03), ("certifications", 0.02), ("bidding", 0.02), ("business_scope", 0.02), ("partners", 0.01))]
    filled = [F.col(c) for c in ("enterprise_name", "establish_time", "register_address", "legal_person", "registered_capital", "main_business", "core_products", "industry")]
    rows = saved(rows).withColumn("uncertain", fields.uncertain_fields(FIELDS))
    made = {"clean_status": fields.clean_status(F.col("some"), core), "clean_note": fields.clean_note(F.col("some"), core, F.size("uncertain")), "clean_confidence": fields.clean_confidence(filled, extra)}
    return rows.withColumns(made).drop("some")


def tag_lists(of: DataFrame, labels: Labels) -> DataFrame:
    """The fields with an array of tags for each sub category."""
    text = F.concat_ws(" ", "main_business", "core_products", "business_scope")
    some = lambda c: ~is_missing(F.col(c))
    made = {
        "types": profile_tags.product_types(F.col("core_products"), F.col("main_business"), labels.products, labels.terms), "specs": profile_tags.product_specs(F.col("product_spec")),
        "scenes": profile_tags.application_tags(F.col("partner_list"), labels.partner_scenes, text, labels.scenes), "compliance": profile_tags.compliance_tags(F.col("certifications"), labels.terms, labels.verbs),
        "services": profile_tags.inferred_tags(text, labels.services, [], 6), "modes": profile_tags.inferred_tags(text, labels.modes, [(F.size("partner_list") > 0, "长期合作")], 6),
        "coverage": profile_tags.coverage_tags(F.col("partner_list"), labels.famous, F.col("register_address"), labels.cities), "tech": profile_tags.inferred_tags(F.concat_ws(" ", text, "patents"), labels.techniques, [(some("patents"), "专利密集型")], 8),
        "production": profile_tags.production_tags(F.col("employee_scale"), F.col("investment")), "finance": profile_tags.financial_tags(F.col("registered_capital"), F.col("investment")),
    }
    return of.withColumns(made)


#: dimension, sub category, the list of tags, the fields that they come from, base confidence.
_SUBS = [
    ("产品", "产品类型标签", "types", ["core_products", "main_business"], 0.92), ("产品", "产品规格标签", "specs", ["product_spec"], 0.9), ("产品", "应用场景标签", "scenes", ["partners", "main_business", "core_products", "business_scope"], 0.88),
    ("产品", COMPLIANCE, "compliance", ["certifications"], 0.92), ("服务", "服务类型标签", "services", ["business_scope", "main_business", "core_products"], 0.88), ("服务", "合作模式标签", "modes", ["partners", "business_scope", "main_business", "core_products"], 0.85),
    ("服务", "服务覆盖标签", "coverage", ["partners", "register_address"], 0.85), ("能力", "技术能力标签", "tech", ["patents", "core_products", "main_business", "business_scope"], 0.9), ("能力", "生产能力标签", "production", ["employee_scale", "investment"], 0.88),
    ("能力", "资金实力标签", "finance", ["registered_capital", "investment"], 0.9),
]


def tag_table(of: DataFrame) -> DataFrame:
    """Long form of all lists in one pass over the companies; an empty list gives one uncertain tag of confidence 0.

    A tag counts for the first of its fields that is filled.
    """

    def rows(dim: str, sub: str, made: str, sources: list[str], base: float) -> Column:
        source, text = F.lit(sources[0]), F.col(sources[-1])
        for c in reversed(sources[1:]):
            source = F.when(is_missing(F.col(sources[0])) & ~is_missing(F.col(c)), c).otherwise(source)
        for c in reversed(sources[:-1]):
            text = F.when(is_missing(F.col(c)), text).otherwise(F.col(c))
        row = lambda k, tag, sure: F.struct(F.lit(dim).alias("dim"), F.lit(sub).alias("sub_category"), k.cast("long").alias("ord"), tag.alias("tag"), source.alias("source_field"), sure.alias("confidence"))
        return F.when(F.size(made) > 0, F.transform(made, lambda x, k: row(k, x, tags.tag_confidence(base, text)))).otherwise(F.array(row(F.lit(0), F.lit(f"{sub}-未明确"), F.lit(0.0))))

    return of.select("enterprise_name", F.inline(F.flatten(F.array(*[rows(*s) for s in _SUBS]))))


def flat_columns(of: DataFrame) -> DataFrame:
    """(enterprise_name, product, process, application, supply): structs of the flat columns."""
    c = F.col
    texts = [c(x) for x in ("main_business", "core_products", "business_scope")]
    return of.select(
        "enterprise_name",
        profile_tags.flat_product([c("main_business"), c("core_products"), c("business_scope")], c("types"), c("specs"), c("compliance")).alias("product"), profile_tags.flat_process(texts, c("product_spec"), c("patents"), c("tech"), c("production")).alias("process"),
        profile_tags.flat_application(c("scenes"), c("partners")).alias("application"),
        profile_tags.flat_supply_chain(c("partners"), c("bidding"), c("main_business"), c("business_scope"), c("registered_capital"), c("investment"), c("modes"), c("coverage"), c("scenes")).alias("supply"),
    )


def profiles(names: DataFrame, pages: DataFrame, labels: Labels | None = None, words: Words | None = None) -> Profiles:
    labels, words = labels or Labels(), words or Words()
    records = saved(crawl_records(names, pages))
    of = saved(tag_lists(company_fields(records, labels), labels))
    rows, flat = saved(tag_table(of)), saved(flat_columns(of))
    both = of.join(flat.hint("merge"), "enterprise_name").join(records.select("enterprise_name", *CATEGORIES, "all_content").hint("merge"), "enterprise_name")
    companies = both.select(
        F.col("enterprise_name").alias("own"), F.col("all_content").alias("text"), F.col("bidding").alias("bids"), F.col("investment").alias("invests"), F.col("main_business").alias("segment"),
        (F.exists(words_array(D.BEARING_WORDS), lambda w: F.contains("main_business", w)) | (F.size("core_list") > 0)).alias("own_makes"), F.col("application.downstream").alias("downstream"), "scenes",
    )
    edges = saved(company_edges(companies, words))
    segments = facts.raw_segments(both.select("enterprise_name", F.struct(*CATEGORIES).alias("raw_content"), F.col("partners").alias("cooperative_enterprise"), "core_products"))
    found = saved(facts.fact_records(segments))
    lists = ["main", "core", "high_end", "core_process", "special", "scenes", "downstream", "roles", "tiers", "customers", "manufacturing", "keywords"]
    flattened = both.select(
        "enterprise_name", "short_name", "industry", F.col("product.main").alias("main"), F.col("product.core").alias("core"), F.col("product.high_end").alias("high_end"), F.col("process.core").alias("core_process"), F.col("process.special").alias("special"), F.col("application.scenes").alias("scenes"),
        F.col("application.downstream").alias("downstream"), F.col("supply.roles").alias("roles"), F.col("supply.tiers").alias("tiers"), F.col("supply.customers").alias("customers"), F.col("process.manufacturing").alias("manufacturing"),
        F.col("product.keywords").alias("keywords"), F.col("clean_confidence").alias("confidence"), F.array_join(F.filter(F.array(*[F.when(F.col(k) != "", F.lit(p)) for k, p in D.CATEGORY_PLATFORMS.items()]), lambda x: x.isNotNull()), "、").alias("data_source"),
    )
    details = found.withColumns({"product_detail": F.lit(""), "spec": F.lit("")})
    return Profiles(run_rows(records, of, rows, edges, found), records, of, rows, flat, edges, found, crawl.overview(flattened, rows, "enterprise_name", lists, COMPLIANCE), crawl.relation_sheet(edges), crawl.detail_sheet(details))


def run_rows(records: DataFrame, of: DataFrame, rows: DataFrame, edges: DataFrame, found: DataFrame) -> DataFrame:
    """One row a name: failed without text, else success, with the mean of all confidences over 0 (crawl, fields, each tag) and counts."""
    key = "enterprise_name"
    counts = [
        rows.groupBy(key).agg(F.count_if(F.col("confidence") > 0).alias("n_tags"), F.sum("confidence").alias("of_tags")),
        edges.groupBy(F.col("subject").alias(key)).agg(F.count("*").alias("n_edges")),
        found.groupBy(key).agg(F.count("*").alias("n_records")),
    ]
    out = records.select(key, "filled", "crawl_status", "crawl_confidence").join(of.select(key, "clean_status", "clean_confidence").hint("merge"), key, "left")
    for c in counts:
        out = out.join(c.hint("merge"), key, "left")
    parts, failed = [F.col("crawl_confidence"), F.col("clean_confidence")], F.col("crawl_status") == "failed"
    n = sum((F.when(c > 0, 1).otherwise(0) for c in parts), F.coalesce("n_tags", F.lit(0)))
    mean = F.bround((parts[0] + parts[1] + F.coalesce("of_tags", F.lit(0.0))) / n, 2)
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return out.select(
        key, F.when(failed, "failed").otherwise("success").alias("status"), F.col("filled").cast("long").alias("filled"), "crawl_status", F.coalesce("clean_status", F.lit("failed")).alias("clean_status"),
        F.when(failed, 0.0).otherwise(mean).alias("confidence"), zero("n_tags"), zero("n_edges"), zero("n_records"),
    )
