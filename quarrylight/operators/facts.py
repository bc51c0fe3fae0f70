"""Transaction records from text segments: bids, customers, suppliers, partners and investments, deduplicated, scored and numbered.

Segments are rows (enterprise_name, seg, text, source_type, source_url, source_platform, cooperative_enterprise, core_products);
seg orders a company's segments. Records have the columns of ``COLUMNS``; a value that isn't found is ''. Null texts give no
records, null list fields count as missing, repeated segments give repeated records, which ``dedup_records`` folds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylight.functions import domain as D
from quarrylight.functions.exprs import any_hit, is_missing, map_first, words_array
from quarrylight.operators.relations import infer_industry, project_name
from quarrylight.operators.tags import parse_amount, parse_date

COLUMNS = (
    "enterprise_name seg pos record_type counterparty counterparty_short counterparty_industry project_name subtype role bid_date region amount amount_unit amount_raw currency "
    "products relationship_nature evidence_type evidence_text source_platform source_url source_snippet confidence is_current"
).split()
_KINDS = {"bidding": 0, "customer": 1, "supplier": 2, "partnership": 3, "investment": 4}
_TYPES = {"pos": "long", "confidence": "double", "is_current": "boolean"}


def raw_segments(companies: DataFrame, least: int = 20) -> DataFrame:
    """Segments of (enterprise_name, raw_content, cooperative_enterprise, core_products): the categories' texts, cut at source tags.

    Every segment has the url of the tag before it, '' without one; those that aren't longer than ``least`` go.
    """
    parts = [F.struct(F.lit(k).cast("long").alias("place"), F.lit(c).alias("source_type"), F.col(f"raw_content.{c}").alias("body")) for k, c in enumerate(D.CATEGORY_PLATFORMS)]
    rows = companies.select("enterprise_name", "cooperative_enterprise", "core_products", F.inline(F.array(*parts))).where("body <> ''")
    urls = F.concat(F.array(F.lit("")), F.regexp_extract_all("body", F.lit(D.SOURCE_TAG), F.lit(1)))
    rows = rows.select("*", F.posexplode(F.arrays_zip(F.split("body", D.SOURCE_TAG, -1).alias("text"), urls.alias("url"))).alias("n", "x"))
    by_type = F.element_at(F.create_map(*[F.lit(x) for kv in D.CATEGORY_PLATFORMS.items() for x in kv]), F.col("source_type"))
    rows = rows.withColumns({"text": F.trim(F.regexp_replace("x.text", r"^\s+|\s+$", "")), "source_url": F.trim("x.url"), "seg": F.col("place") * (1 << 32) + F.col("n")})
    platform = map_first(F.lower("source_url"), D.PLATFORMS)
    return rows.where(F.length("text") > least).select("enterprise_name", "seg", "text", "source_type", "source_url", F.when(platform != "", platform).otherwise(by_type).alias("source_platform"), "cooperative_enterprise", "core_products")


def _first_word(text: Column, words: list[str]) -> Column:
    return F.coalesce(F.get(F.filter(words_array(words), lambda w: F.contains(text, w)), F.lit(0)), F.lit(""))


def _records(rows: DataFrame, record_type: str, **columns: Column) -> DataFrame:
    """The columns of records; what isn't given is '', or null for what isn't text."""
    given = {"record_type": F.lit(record_type), "pos": F.col("pos"), **columns}
    plain = ["enterprise_name", "seg", "source_url", "source_platform"]
    return rows.select(*[(given[c] if c in given else F.col(c) if c in plain else F.lit(None).cast(_TYPES[c]) if c in _TYPES else F.lit("")).alias(c) for c in COLUMNS])


def sentences(segments: DataFrame, patterns: list[str], least: int, also: str | None = None) -> DataFrame:
    """Segments' sentences, with their place, that are long enough and match a pattern, and another one if given."""
    rows = segments.select("*", F.posexplode(F.split("text", r"[。；\n]", -1)).alias("pos", "sentence")).withColumns({"pos": F.col("pos").cast("long"), "sentence": F.trim("sentence")})
    good = (F.length("sentence") >= least) & F.col("sentence").rlike("|".join(f"(?:{p})" for p in patterns))
    return rows.where(good & F.col("sentence").rlike(also) if also else good)


def companies(text: Column, own: Column, patterns: list[str], known: list[str], least: int = 4) -> Column:
    """Distinct names: matches in the order of patterns, long enough and without the own name in them, then known ones that don't lie in it."""
    found = F.filter(F.flatten(F.array(*[F.regexp_extract_all(text, F.lit(p), F.lit(1)) for p in patterns])), lambda n: (F.length(n) >= least) & ~F.contains(n, own))
    return F.array_union(found, F.filter(words_array(known), lambda w: F.contains(text, w) & ~F.contains(own, w)) if known else F.array().cast("array<string>"))


def bid_role(text: Column, own: Column, won: str = "中标", buys: tuple[str, ...] = ("采购", "招标"), labels: tuple[str, str] = ("中标方", "招标方")) -> Column:
    """The winner where the word for winning stands beside the own name, else the buyer where one for buying follows it, else the winner."""
    at = F.position(own, text)
    rest = F.substring(text, at + F.length(own), F.length(text))
    return F.when((at > 0) & ~F.contains(text, F.lit(won)) & any_hit(rest, list(buys)), labels[1]).otherwise(labels[0])


def region(text: Column, provinces: list[str] = D.PROVINCES, cities: list[str] = D.MUNICIPALITIES) -> Column:
    """The first province in the text, in the list's order, with 市 or 省."""
    p = _first_word(text, provinces)
    return F.when(p == "", "").when(p.isin(*cities), F.concat(p, F.lit("市"))).otherwise(F.concat(p, F.lit("省")))


def counterparty_industry(name: Column, text: Column, industries: dict[str, str] = D.BIDDER_INDUSTRY, scenes: list[tuple[str, list[str]]] = D.BIDDER_SCENES) -> Column:
    """By the name, exactly or by containment either way, else by a word of the sentence; a missing name goes by the sentence."""
    return F.when(name == "", map_first(text, scenes)).otherwise(infer_industry(name, industries, list(industries.items()), text, scenes, []))


def bidding_records(segments: DataFrame, words: list[str] = D.BID_WORDS, patterns: list[str] = D.BIDDER, projects: list[str] = D.PROJECTS) -> DataFrame:
    """One record for each sentence with a bid word and an amount, a counterparty or a project."""
    s, own = F.col("sentence"), F.col("enterprise_name")
    rows = sentences(segments, words, 10).withColumns({"other": F.coalesce(F.get(companies(s, own, patterns, []), F.lit(0)), F.lit("")), "a": parse_amount(s), "project": project_name(s, projects)})
    return _records(
        rows.where("other <> '' OR a.amount <> '' OR project <> ''"), "bidding", counterparty=F.col("other"), counterparty_industry=counterparty_industry(F.col("other"), s), project_name=F.col("project"),
        subtype=map_first(s, D.BID_TYPES, "招标"), role=bid_role(s, own), bid_date=parse_date(s), region=region(s), amount=F.col("a.amount"), amount_unit=F.col("a.unit"), amount_raw=F.col("a.raw"),
        currency=F.col("a.currency"), products=_first_word(s, D.PRODUCTS), source_snippet=F.substring(s, 1, 200),
    )


def _named(segments: DataFrame, context: list[str], patterns: list[str], known: list[str]) -> DataFrame:
    """A row for each company in each sentence with a word of the context."""
    rows = sentences(segments, context, 10)
    return rows.withColumn("other", F.explode(companies(F.col("sentence"), F.col("enterprise_name"), patterns, known)))


def _known_industry(name: Column, industries: dict[str, str]) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in industries.items() for x in kv]), name), F.lit("")) if industries else F.lit("")


def customer_records(segments: DataFrame, context: list[str] = D.CUSTOMER_CONTEXT, patterns: list[str] = D.COMPANY, known: list[str] = D.KNOWN, industries: dict[str, str] = D.KNOWN_INDUSTRY, products: list[str] = D.SUPPLIED) -> DataFrame:
    """Companies in sentences of supply; a segment without such a sentence falls back to its company's listed partners."""
    s, name = F.col("sentence"), F.col("other")
    made = F.coalesce("core_products", F.lit(""))
    found = _records(
        _named(segments, context, patterns, known), "customer", counterparty=name, counterparty_short=F.substring(name, 1, 4), counterparty_industry=_known_industry(name, industries), relationship_nature=F.lit("供应商"),
        products=F.coalesce(F.nullif(_first_word(s, products), F.lit("")), made), evidence_type=F.lit("官网提及"), evidence_text=F.substring(s, 1, 100), source_platform=F.lit("企业官网"), confidence=F.lit(0.85), is_current=F.lit(True),
    )
    any_ = F.exists(F.transform(F.split("text", r"[。；\n]", -1), lambda x: F.trim(x)), lambda x: (F.length(x) >= 10) & x.rlike("|".join(f"(?:{p})" for p in context)))
    bare = segments.where(F.col("text").isNotNull() & ~any_ & ~is_missing(F.col("cooperative_enterprise")))
    listed = bare.select("*", F.posexplode(F.split("cooperative_enterprise", "[,，、；;]+")).alias("pos", "x")).withColumns({"pos": F.col("pos").cast("long"), "other": F.trim("x")}).where("length(other) >= 2")
    fallback = _records(
        listed, "customer", counterparty=name, counterparty_short=F.substring(name, 1, 4), counterparty_industry=_known_industry(name, industries), relationship_nature=F.lit("供应商"), products=made,
        evidence_type=F.lit("结构化字段"), evidence_text=F.concat(F.lit("合作企业列表中包含"), name), source_platform=F.lit("结构化数据"), source_url=F.lit(""), confidence=F.lit(0.70), is_current=F.lit(True),
    )
    return found.unionByName(fallback)


def supplier_records(segments: DataFrame, context: list[str] = D.SUPPLIER_CONTEXT, patterns: list[str] = D.COMPANY, known: list[str] = D.KNOWN, industries: dict[str, str] = D.KNOWN_INDUSTRY) -> DataFrame:
    name = F.col("other")
    return _records(
        _named(segments, context, patterns, known), "supplier", counterparty=name, counterparty_industry=_known_industry(name, industries), relationship_nature=F.lit("采购方"),
        evidence_type=F.lit("官网提及"), evidence_text=F.substring("sentence", 1, 100), source_platform=F.lit("企业官网"), confidence=F.lit(0.82),
    )


def partnership_records(segments: DataFrame, context: list[str] = D.PARTNER_CONTEXT, patterns: list[str] = D.COMPANY, known: list[str] = D.KNOWN, industries: dict[str, str] = D.KNOWN_INDUSTRY, types: list[tuple[str, list[str]]] = D.PARTNERSHIP_TYPES, default: str = "技术合作") -> DataFrame:
    """Companies in sentences of cooperation, with its type by ordered words."""
    name = F.col("other")
    return _records(
        _named(segments, context, patterns, known), "partnership", counterparty=name, counterparty_industry=_known_industry(name, industries), subtype=map_first(F.col("sentence"), types, default),
        evidence_text=F.substring("sentence", 1, 100), source_platform=F.lit("企业官网"), confidence=F.lit(0.88),
    )


def investment_records(segments: DataFrame, words: list[str] = D.INVESTMENT_WORDS, types: list[tuple[str, list[str]]] = D.INVESTMENT_TYPES, products: list[str] = D.INVESTED) -> DataFrame:
    """One record for each sentence with a word of investment and money."""
    s = F.col("sentence")
    rows = sentences(segments, words, 15, r"[\d,.]+\s*[亿万]元").withColumn("a", parse_amount(s, D.INVESTED_AMOUNTS, None))
    year, month = F.regexp_extract(s, r"(\d{4})\s*年\s*(\d{1,2})\s*月", 1), F.regexp_extract(s, r"(\d{4})\s*年\s*(\d{1,2})\s*月", 2)
    date = F.when(month != "", F.concat(year, F.lit("-"), F.lpad(month, 2, "0"))).otherwise(F.regexp_extract(s, r"(\d{4})\s*年", 1))
    return _records(
        rows, "investment", project_name=F.substring(s, 1, 40), subtype=map_first(s, types, "扩建"), bid_date=date, amount=F.col("a.amount"), amount_unit=F.col("a.unit"), amount_raw=F.col("a.raw"), currency=F.lit(""),
        products=_first_word(s, products), evidence_text=F.substring(s, 1, 100), source_platform=F.lit("企业官网"), source_snippet=F.substring(s, 1, 150), confidence=F.lit(0.90),
    )


def completeness(core: dict[str, list[str]] = D.CORE_FIELDS) -> Column:
    """How many of its type's core fields a record has."""
    out = F.lit(0)
    for kind, fields in core.items():
        out = F.when(F.col("record_type") == kind, sum((F.when(F.coalesce(c, F.lit("")) != "", 1).otherwise(0) for c in fields), F.lit(0))).otherwise(out)
    return out


def record_key() -> Column:
    """What tells a company's records of a type apart."""
    kind = F.col("record_type")
    project = F.substring("project_name", 1, 30)
    key = F.when(kind == "bidding", F.concat_ws("\u0001", "counterparty", project)).when(kind.isin("customer", "supplier", "partnership"), F.col("counterparty")).when(kind == "investment", project)
    return F.coalesce(key, F.concat_ws("\u0001", "counterparty", F.substring("source_snippet", 1, 50)), F.lit(""))


def dedup_records(records: DataFrame) -> DataFrame:
    """Of the records of a company, type and key, the most complete one, the first of those alike, the least by its columns in order of those
    at one place; ``at`` is the place of the key's first one."""
    order = F.lit(len(_KINDS))
    for kind, k in _KINDS.items():
        order = F.when(F.col("record_type") == kind, k).otherwise(order)
    at = F.struct("seg", order.alias("kind"), "pos", "counterparty")
    row = F.struct(*[c for c in records.columns])
    best = records.groupBy("enterprise_name", "record_type", record_key().alias("key")).agg(F.min_by(row, F.struct(-completeness(), at, row)).alias("row"), F.min(at).alias("at"))
    return best.select("row.*", "at")


def with_confidence(records: DataFrame, bonus: dict[str, dict[str, float]] = D.FIELD_BONUS, platforms: list[tuple[str, float]] = D.PLATFORM_BONUS) -> DataFrame:
    """0.60, the bonus of the first platform and of each field that the type asks for, up to 0.98, in place of the extractor's confidence."""
    score = F.lit(0.0)
    for name, more in reversed(platforms):
        score = F.when(F.contains("source_platform", F.lit(name)), more).otherwise(score)
    score = score + 0.60
    for kind, fields in bonus.items():
        for c, more in fields.items():
            score = score + F.when((F.col("record_type") == kind) & (F.coalesce(c, F.lit("")) != ""), more).otherwise(0.0)
    return records.withColumn("confidence", F.bround(F.least(F.lit(0.98), score), 2))


def with_ids(records: DataFrame, prefixes: dict[str, str] = D.ID_PREFIX) -> DataFrame:
    """PREFIX-001 and so on, by company and type in order of ``at``, then of the key."""
    prefix = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in prefixes.items() for x in kv]), F.col("record_type")), F.lit("REC"))
    n = F.row_number().over(Window.partitionBy("enterprise_name", "record_type").orderBy("at", record_key()))
    return records.withColumn("record_id", F.format_string("%s-%03d", prefix, n))


def fact_records(segments: DataFrame) -> DataFrame:
    """All records of the segments: bids from those of kind bidding and business, the others from official sites."""
    bids = segments.where(F.col("source_type").isin("bidding_info", "business_info"))
    site = segments.where("source_type = 'official_website'")
    found = bidding_records(bids)
    for make in (customer_records, supplier_records, partnership_records, investment_records):
        found = found.unionByName(make(site))
    return with_ids(with_confidence(dedup_records(found)))


def fact_summary(companies: DataFrame, records: DataFrame, key: str, kinds: list[str], categories: list[str]) -> DataFrame:
    """For each company: records in all and by type, mean confidence (0 without records), and which categories of its raw content hold text."""
    by = records.groupBy(key).agg(F.count("*").alias("total_records"), *[F.count_if(F.col("record_type") == k).alias(f"{k}_records") for k in kinds], F.bround(F.avg("confidence"), 2).alias("extraction_confidence"))
    has = [(F.coalesce(F.col(c), F.lit("")) != "").alias(f"has_{c}") for c in categories]
    counts = [F.coalesce(c, F.lit(0)).alias(c) for c in ("total_records", *[f"{k}_records" for k in kinds])]
    return companies.select(key, *has).join(by.hint("merge"), key, "left").select(key, *[f"has_{c}" for c in categories], *counts, F.coalesce("extraction_confidence", F.lit(0.0)).alias("extraction_confidence"))
