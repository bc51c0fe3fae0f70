"""Assembly of crawled items, candidate sites, links of result pages, lookups of the source configuration, sheets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylight.functions import domain
from quarrylight.functions.exprs import any_hit, in_both, words_array
from quarrylight.operators.ordering import best, ranked
from quarrylight.operators.relations import EDGE
from quarrylight.operators.web import attributes, cited, is_blacklisted, linked
from quarrylight.operators.web import domain as domain_of


def blocks(items: DataFrame, key: str, category: str, categories: list[str], source: str, text: str, seq: str, size: int = 5000) -> DataFrame:
    """(key, category, seq, block): each page's first ``size`` characters under a line that names its source, as rows of its own, however many a key has.

    Null keys, other categories and null texts go.
    """
    block = F.concat(F.lit("【来源: "), F.substring(F.coalesce(source, F.lit("")), 1, 80), F.lit("】\n"), F.substring(text, 1, size), F.lit("\n\n"))
    return items.where(F.col(text).isNotNull() & F.col(key).isNotNull() & F.col(category).isin(*categories)).select(F.col(key).alias("key"), F.col(category).alias("category"), F.col(seq).alias("seq"), block.alias("block"))


def assemble(items: DataFrame, key: str, category: str, categories: list[str], source: str, text: str, seq: str, size: int = 5000) -> DataFrame:
    """One row a key with a column a category, all its blocks in order, '' without any, and all_content, the ones that aren't blank joined by a blank line.

    A record holds all pages of its key, so they are gathered in its row; ``blocks`` has them as rows.
    """
    rows = blocks(items, key, category, categories, source, text, seq, size)
    own = lambda c: F.sort_array(F.collect_list(F.when(F.col("category") == c, F.struct("seq", "block"))))
    joined = rows.groupBy(F.col("key").alias(key)).agg(*[F.array_join(F.transform(own(c), lambda x: x["block"]), "").alias(c) for c in categories])
    bare = lambda c: F.nullif(F.regexp_replace(c, r"^\s+|\s+$", ""), F.lit(""))
    return joined.withColumn("all_content", F.concat_ws("\n\n", *[bare(c) for c in categories]))


def official_score(title: Column, body: Column, domain: Column, full: str, short: str, structure: list[str], token: str, negative: list[str]) -> Column:
    """Names in the title and how dense in the body, words of a site's structure, the domain's token, less for negative titles; 0 to 1."""
    b, flag = F.coalesce(body, F.lit("")), lambda c, x: F.when(c, x).otherwise(0.0)
    named = lambda c, w: F.contains(c, F.lit(w))
    dense = F.least(F.lit(0.3), F.regexp_count(b, F.lit(full)) / F.greatest(F.length(b), F.lit(1)) * 1000 * 0.03)
    words = sum((named(b, w).cast("int") for w in structure), F.lit(0))
    score = F.when(named(title, full), 0.25).when(named(title, short), 0.2).otherwise(0.0) + F.when(named(b, full), dense).when(named(b, short), 0.15).otherwise(0.0)
    score = score + F.least(F.lit(0.15), 0.03 * words) + flag(named(domain, token), 0.15) - flag(any_hit(title, negative), 0.15)
    return F.bround(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), 4)


def data_types(category: Column, listed: list[tuple[str, list[str]]], words: list[tuple[str, list[str]]], default: list[str]) -> Column:
    """The types of the first listed name within the category or around it, else of the first word in it."""
    out = words_array(default)
    for w, types in reversed(words):
        out = F.when(F.contains(category, F.lit(w)), words_array(types)).otherwise(out)
    for name, types in reversed(listed):
        out = F.when(in_both(category, F.lit(name)), words_array(types)).otherwise(out)
    return out


def template_of(name: Column, templates: dict[str, str]) -> Column:
    """By the exact name, else the first one within it or around it, else null."""
    out = F.lit(None).cast("string")
    for k, v in reversed(templates.items()):
        out = F.when(in_both(name, F.lit(k)), F.lit(v)).otherwise(out)
    for k, v in templates.items():
        out = F.when(name == k, F.lit(v)).otherwise(out)
    return out


def domain_types(sources: DataFrame, base_url: str, types: str, seq: str, priority: dict[str, int] = domain.TYPE_PRIORITY) -> DataFrame:
    """(domain, type): the type of the highest priority among those of a domain's sources, the first of those alike; unlisted types don't count."""
    rank = F.element_at(F.create_map(*[F.lit(x) for kv in priority.items() for x in kv]), F.col("type"))
    rows = sources.select(domain_of(F.col(base_url)).alias("domain"), seq, F.posexplode(types).alias("place", "type")).withColumn("rank", rank)
    return rows.where("domain <> '' AND rank IS NOT NULL").groupBy("domain").agg(F.min_by("type", F.struct("rank", seq, "place")).alias("type"))


def type_keyword_sets(sources: DataFrame, types: str, keywords: str) -> DataFrame:
    """(type, keyword): the distinct keywords of the sources of a type, in order."""
    return sources.select(F.explode(types).alias("type"), keywords).select("type", F.explode(keywords).alias("keyword")).distinct().orderBy("type", "keyword")


def platforms(sources: DataFrame, types: str, name: str, template: str, seq: str) -> DataFrame:
    """(type, seq, name, template): sources of a type that have a template, in order."""
    return sources.where(F.coalesce(F.col(template), F.lit("")) != "").select(F.explode(types).alias("type"), seq, name, template).orderBy("type", seq)


def enough(items: DataFrame, key: str, platform: str, seq: list[str], fallback: DataFrame, least: int = 2, most_platforms: int = 3, a_platform: int = 3) -> DataFrame:
    """Items of the first platforms of a key, a page and two details of each, until there are enough; then none of the next platform.

    A key with fewer gets its rows of the fallback too. Null keys and platforms go.
    """
    rows = items.where(F.col(key).isNotNull() & F.col(platform).isNotNull()).withColumn("n", F.row_number().over(Window.partitionBy(key, platform).orderBy(*seq))).where(F.col("n") <= a_platform)
    by = rows.groupBy(key, platform).agg(F.count("*").alias("found"))
    order = Window.partitionBy(key).orderBy(platform)
    before = F.coalesce(F.sum("found").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    asked = by.withColumns({"place": F.row_number().over(order), "before": before}).where((F.col("place") <= most_platforms) & (F.col("before") < least))
    kept = rows.join(asked.select(key, platform).hint("merge"), [key, platform], "left_semi").select(*items.columns)
    full = asked.groupBy(key).agg(F.sum("found").alias("all")).where(F.col("all") >= least).select(key)
    return kept.unionByName(fallback.join(full.hint("merge"), key, "left_anti").select(*items.columns))


def result_links(pages: DataFrame, key: str, html: str, engine: str, domains: list[str], patterns: dict[str, list[str]] = domain.ENGINE_LINKS, plain: list[str] = domain.ANY_ENGINE_LINKS, least: int = 3, most: int = 30) -> DataFrame:
    """(key, pos, link): links of a result page by the patterns of its engine and cited ones; all links where these are too few.

    Without query and fragment, valid, distinct, the first ones.
    """
    by = lambda ps: F.flatten(F.array(*[F.regexp_extract_all(html, F.lit(p), F.lit(1)) for p in ps]))
    own = by(plain)
    for name, ps in patterns.items():
        own = F.when(F.col(engine) == name, by(ps)).otherwise(own)
    rows = pages.select(key, own.alias("own"), attributes(F.col(html)).alias("attrs"), cited(F.col(html)).alias("cites"))
    found = F.concat("own", "cites")
    found = F.when(F.size(found) < least, F.concat(found, linked(F.col("attrs"), F.col("cites"), F.lit("")))).otherwise(found)
    links = F.array_distinct(F.transform(found, lambda x: F.trim(F.regexp_replace(x, r"[?#].*$", ""))))
    links = F.filter(links, lambda x: (x != "") & ~is_blacklisted(x, domains))
    return rows.select(key, F.posexplode(F.slice(links, 1, most)).alias("pos", "link"))


def candidates(pages: DataFrame, key: str, domain: Column, tokens: list[str], seq: str, first: int = 5, others: int = 3) -> DataFrame:
    """For each key its first pages on a domain with one of the tokens of two characters or more, and a few others."""
    own = pages.withColumn("own", any_hit(domain, [t for t in tokens if len(t) >= 2]))
    return best(own.where("own"), [key], [F.asc(seq)], first).unionByName(best(own.where("NOT own"), [key], [F.asc(seq)], others))


OVERVIEW = "enterprise_name short_name industry main core high_end core_process special scenes downstream roles tiers customers compliance manufacturing keywords confidence data_source".split()
DETAILS = "record_type record_id counterparty project_name relation role products product_detail amount amount_unit bid_date region counterparty_industry evidence_type source_platform confidence".split()


def overview(companies: DataFrame, tags: DataFrame, key: str, lists: list[str], compliance: str) -> DataFrame:
    """One row a company with the columns of ``OVERVIEW``: lists joined by 、 without the word for missing values, and its sure tags of compliance in order."""
    sure = tags.where((F.col("sub_category") == compliance) & (F.col("confidence") > 0)).groupBy(key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", "tag"))), lambda x: x["tag"]), "、").alias("compliance"))
    joined = lambda c: F.array_join(F.filter(F.coalesce(c, F.array().cast("array<string>")), lambda x: (x != "未明确") & (x != "")), "、")
    both = companies.join(sure.hint("merge"), key, "left")
    plain = lambda c: F.coalesce(c, F.lit("")) if c != "confidence" else F.col(c)
    return both.select(F.col(key).alias("enterprise_name"), *[(joined(F.col(c)) if c in lists else plain(c)).alias(c) for c in OVERVIEW[1:]])


def relation_sheet(edges: DataFrame) -> DataFrame:
    """The ten columns of edges between companies, '' for what is missing."""
    return edges.select(*[(F.coalesce(c, F.lit("")) if c != "confidence" else F.col(c)).alias(c) for c in EDGE])


def detail_sheet(records: DataFrame, names: dict[str, str] = domain.TYPE_NAMES) -> DataFrame:
    """The columns of ``DETAILS``, types by name, the relation in place of a missing role, by type and falling confidence; those alike by id, then by
    company, as ids repeat among companies: no two rows are left open."""
    text = lambda c: F.coalesce(c, F.lit(""))
    label = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), F.col("record_type")), F.col("record_type"))
    kind = F.col("record_type")
    detail = F.when(kind == "bidding", text("product_detail")).when(kind == "product_supply", F.coalesce(F.nullif(F.col("product_detail"), F.lit("")), text("spec"))).otherwise("")
    columns = {
        "record_type": label, "relation": label, "role": F.coalesce(F.nullif(F.col("role"), F.lit("")), text("relationship_nature")), "product_detail": detail,
        "evidence_type": F.coalesce(F.nullif(F.col("evidence_type"), F.lit("")), F.lit("原始文本")), "confidence": F.col("confidence"),
    }
    return records.orderBy("record_type", F.desc("confidence"), "record_id", "enterprise_name").select(*[columns.get(c, text(c)).alias(c) for c in DETAILS])


def detail_summary(records: DataFrame, names: dict[str, str] = domain.TYPE_NAMES) -> DataFrame:
    """One row: how many records there are, and how many of each named type, in the order of the names."""
    counts = [(label, F.count_if(F.col("record_type") == k)) for k, label in names.items()]
    parts = F.concat_ws("、", *[F.when(n > 0, F.concat(F.lit(f"{label}:"), n.cast("string"))) for label, n in counts])
    return records.agg(F.concat(F.lit("共"), F.count("*").cast("string"), F.lit("条记录")).alias("total"), parts.alias("by_type"))


def data_dictionary(df: DataFrame, sheet: str, descriptions: dict[str, str]) -> DataFrame:
    """(field, sheet, type, description, filled) of a table's columns: 数值 or 文本 by the column's type, and how many rows fill it."""
    number = ("int", "bigint", "smallint", "tinyint", "double", "float", "decimal")
    kinds = {c: "数值" if t.startswith(number) else "文本" for c, t in df.dtypes}
    filled = df.agg(*[F.count(F.when(F.col(c).cast("string") != "", 1)).alias(c) for c in df.columns])
    rows = [F.struct(F.lit(c).alias("field"), F.lit(sheet).alias("sheet"), F.lit(kinds[c]).alias("type"), F.lit(descriptions.get(c, "")).alias("description"), F.col(c).alias("filled")) for c in df.columns]
    return filled.select(F.inline(F.array(*rows)))


def config_rows(sources: DataFrame, columns: list[str], score: str, seq: str) -> DataFrame:
    """(place, source): each source as one JSON text, by falling score; the file of a configuration holds one a line."""
    return ranked(sources, [F.desc(score), F.asc(seq)], "place").select(F.col("place").cast("int").alias("place"), F.to_json(F.struct(*columns)).alias("source"))


def write_config(rows: DataFrame, path: str) -> None:
    rows.orderBy("place").select("source").write.mode("overwrite").text(path)
