"""Mentions of companies and edges between them, from sentences. Words and patterns are arguments.

Null texts give no rows; a value that isn't found is ''.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylight.functions import domain
from quarrylight.functions.exprs import any_hit, in_both, is_missing, map_first, ordered_extract, words_array


def around(text: Column, part: Column, n: int) -> Column:
    """The text from n characters before the first place of a part to n after its end."""
    at = F.position(part, text)
    start = F.greatest(at - n, F.lit(1))
    return F.substring(text, start, at - start + F.length(part) + n)


def mentions(df: DataFrame, key: str, text: str, patterns: list[str], known: list[str], reach: int = 50, snippet: int = 100) -> DataFrame:
    """(key, seq, name, context, snippet): distinct names by patterns in order and known ones, with the text around the first place."""
    found = F.array_union(F.flatten(F.array(*[F.regexp_extract_all(text, F.lit(f"({p})"), F.lit(1)) for p in patterns])), F.filter(words_array(known), lambda w: F.contains(F.col(text), w)))
    rows = df.where(F.col(text).isNotNull()).select(key, text, F.posexplode(found).alias("seq", "name"))
    return rows.select(key, "seq", "name", around(F.col(text), F.col("name"), reach).alias("context")).withColumn("snippet", F.substring("context", 1, snippet))


def valid_mention(name: Column, own: Column, stop: list[str], nouns: list[str]) -> Column:
    """At least two characters, no stop word, noise noun or number, and neither contains the own name nor lies in it."""
    return (F.length(name) >= 2) & ~name.isin(*stop) & ~in_both(name, own) & ~name.rlike(r"^[0-9.,]+$") & ~any_hit(name, nouns)


def infer_industry(name: Column, exact: dict[str, str], partial: list[tuple[str, str]], context: Column, scenes: list[tuple[str, list[str]]], words: list[tuple[str, list[str]]]) -> Column:
    """By the exact name, by containment either way in order, by a scene in the context, by a word in the name; else ''."""
    out = map_first(name, words)
    out = F.coalesce(F.nullif(map_first(context, scenes), F.lit("")), out)
    for k, label in reversed(partial):
        out = F.when(in_both(name, F.lit(k)), F.lit(label)).otherwise(out)
    for k, label in exact.items():
        out = F.when(name == k, F.lit(label)).otherwise(out)
    return out


EDGE = "subject object rel_type description project amount industry evidence confidence data_source".split()
MONEY = r"([\d,.]+)\s*万?元"


def is_maker(name: Column, words: list[str] = domain.BEARING_WORDS, listed: list[str] = domain.MAKERS) -> Column:
    """Whether a company makes the product, by a word in its name or a list."""
    return any_hit(name, words) | name.isin(*listed)


def context_edges(mentions: DataFrame, own_makes: Column, makes: Column) -> DataFrame:
    """Edges from (own, name, kind, industry, snippet): by the kind of context and by who makes the product.

    A customer in a customer's context (0.85), or in a bid without making the product (0.80); a supplier in a supplier's
    context or where both make it (0.82); a customer in another bid (0.78); else a partner (0.75). The amount is the first in the snippet.
    """
    own, name, kind = F.col("own"), F.col("name"), F.col("kind")
    row = lambda t, text, c, source: F.struct(F.lit(t).alias("rel_type"), F.concat(*text).alias("description"), F.lit(c).alias("confidence"), F.lit(source).alias("data_source"))
    serves = [own, F.lit("为"), name, F.lit("提供产品/服务")]
    x = F.when(kind == "客户", row("客户", serves, 0.85, "原始文本-客户上下文")).when((kind == "招投标") & ~makes, row("客户", serves, 0.80, "招投标信息"))
    x = x.when((kind == "供应商") | (own_makes & makes), row("供应商", [name, F.lit("为"), own, F.lit("提供轴承相关产品/技术")], 0.82, "原始文本-供应商上下文"))
    x = x.when(kind == "招投标", row("客户", [own, F.lit("与"), name, F.lit("存在招投标业务关系")], 0.78, "招投标信息"))
    x = x.otherwise(row("合作", [own, F.lit("与"), name, F.lit("存在合作关系")], 0.75, "原始文本-合作上下文"))
    evidence = F.concat(F.lit("原始文本匹配；上下文:"), kind, F.when(F.col("industry") != "", F.concat(F.lit("；行业:"), "industry")).otherwise(""))
    columns = {"subject": own, "object": name, "project": F.lit(""), "amount": F.regexp_extract("snippet", MONEY, 0), "industry": F.col("industry"), "evidence": evidence}
    return mentions.withColumn("x", x).select(*[(columns[c] if c in columns else F.col(f"x.{c}")).alias(c) for c in EDGE])


def gathered(field: Column, text: Column, good, least: int = 15, delimiters: str = r"[。；\n]") -> Column:
    """The field's text, '' if it is missing, and the sentences of the text that are good and that it doesn't hold yet, joined by 。."""
    start = F.when(is_missing(field), "").otherwise(field)
    found = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), delimiters, -1), lambda s: F.trim(s)), lambda s: (F.length(s) >= least) & good(s))
    return F.aggregate(found, start, lambda acc, s: F.when(F.contains(acc, s), acc).when(acc == "", s).otherwise(F.concat(acc, F.lit("。"), s)))


def bidding_edges(df: DataFrame, own: str, field: str, text: str, patterns: list[str], words: list[str] = domain.BIDDING_CONTEXT, company: str = domain.ANY_COMPANY, valid=None, industry=None) -> DataFrame:
    """A customer edge (0.78) for each company named in the field or in sentences with a bid word and money or a company."""
    whole = gathered(F.col(field), F.col(text), lambda s: any_hit(s, words) & (s.rlike(MONEY) | s.rlike(company)))
    rows = mentions(df.select(F.col(own).alias("own"), whole.alias("whole")), "own", "whole", patterns, [], 30)
    rows = rows.where(valid(F.col("name"), F.col("own"))) if valid else rows
    name, context = F.col("name"), F.col("context")
    columns = {
        "subject": F.col("own"), "object": name, "rel_type": F.lit("客户"), "description": F.concat("own", F.lit("与"), "name", F.lit("存在招投标业务关系")), "project": F.substring(context, 1, 80),
        "amount": F.regexp_extract(context, MONEY, 0), "industry": industry(name, context) if industry else F.lit(""), "evidence": F.concat(F.lit("招投标上下文:"), F.substring(context, 1, 50)), "confidence": F.lit(0.78), "data_source": F.lit("招投标信息"),
    }
    return rows.select(*[columns[c].alias(c) for c in EDGE])


def investment_edges(df: DataFrame, own: str, field: str, text: str, segment: str, words: list[str] = domain.INVESTMENT_CONTEXT, first_words: list[str] = domain.FIRST_INVESTMENT, money: str = r"[\d,.]+\s*[亿万]元") -> DataFrame:
    """One edge (0.85) for a company's first sentence on an investment, with the amount of all such sentences, 亿 before 万."""
    whole = gathered(F.col(field), F.col(text), lambda s: any_hit(s, words) & s.rlike(money))
    rows = df.select(F.col(own).alias("own"), F.coalesce(segment, F.lit("")).alias("segment"), whole.alias("whole"))
    first = F.get(F.filter(F.transform(F.split("whole", r"[。；\n]", -1), lambda s: F.trim(s)), lambda s: (F.length(s) >= 15) & any_hit(s, first_words)), F.lit(0))
    yi, wan = (F.regexp_extract("whole", rf"(\d+(?:\.\d+)?)\s*{u}", 1) for u in ("亿", "万"))
    amount = F.when(yi != "", F.concat(yi, F.lit("亿元"))).when(wan != "", F.concat(wan, F.lit("万元"))).otherwise("")
    columns = {
        "subject": F.col("own"), "object": F.substring("first", 1, 60), "rel_type": F.lit("投资"), "description": F.concat("own", F.lit("投资建设: "), F.substring("first", 1, 80)), "project": F.substring("first", 1, 80),
        "amount": amount, "industry": F.col("segment"), "evidence": F.lit("投资项目/原始文本"), "confidence": F.lit(0.85), "data_source": F.lit("投资信息"),
    }
    return rows.withColumn("first", first).where("first IS NOT NULL").select(*[columns[c].alias(c) for c in EDGE])


def factual_sentences(df: DataFrame, key: str, text: str, words: list[str], least: int = 10, delimiters: str = r"[。；\n]", also: str | None = None) -> DataFrame:
    """(key, pos, sentence): long enough, with one of the words and, if given, a match of the pattern."""
    rows = df.select(key, F.posexplode(F.split(text, delimiters, -1)).alias("pos", "sentence")).withColumns({"pos": F.col("pos").cast("long"), "sentence": F.trim("sentence")})
    good = (F.length("sentence") >= least) & any_hit(F.col("sentence"), words)
    return rows.where(good & F.col("sentence").rlike(also) if also else good)


def route_segments(segments: DataFrame, category: str, text: str, parsers: dict[str, str], least: int = 20) -> DataFrame:
    """The segments that are longer than ``least``, each with its category's parser; categories without a parser go."""
    out = F.lit(None).cast("string")
    for k, v in parsers.items():
        out = F.when(F.col(category) == k, F.lit(v)).otherwise(out)
    return segments.withColumn("parser", out).where(F.col("parser").isNotNull() & (F.length(text) > least))


def project_name(text: Column, patterns: list[str], particles: str = "[的为于在]", sizes: tuple[int, int] = (4, 60)) -> Column:
    """The first pattern's group whose length, without one leading particle, is in the bounds."""
    clean = lambda c: F.regexp_replace(c, f"^{particles}", "")
    return clean(ordered_extract(text, patterns, lambda v: F.length(clean(v)).between(*sizes))["value"])


def counterparty(text: Column, pattern: str, own: Column, least: int = 4) -> Column:
    """The first company in the text that is long enough and doesn't contain the own name."""
    found = F.filter(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({pattern})"), F.lit(1)), lambda n: (F.length(n) >= least) & ~F.contains(n, own))
    return F.coalesce(F.get(found, F.lit(0)), F.lit(""))


def downstream_edges(flat: DataFrame, mentions: DataFrame, industries: dict[str, str] = domain.CONTEXT_SCENES, own_industry: str = domain.OWN_INDUSTRY) -> DataFrame:
    """Edges from companies to the industries they supply, in the columns of ``EDGE``.

    From (own, downstream, scenes), one for each downstream tag (0.85), with the scenes of that industry and the mentions from it as
    evidence; from (own, seq, name, industry), one for each other industry but the own (0.75), with the first mention.
    Null and unclear industries go. The names behind an edge are gathered in it.
    """
    table = F.create_map(*[F.lit(x) for kv in industries.items() for x in kv])
    seen = mentions.where(~is_missing(F.col("industry")) & F.col("own").isNotNull()).groupBy("own", "industry").agg(F.sort_array(F.collect_list(F.struct("seq", "name"))).alias("seen"))
    tags = flat.select("own", F.explode("downstream").alias("industry"), "scenes").where(~is_missing(F.col("industry")) & F.col("own").isNotNull())
    scene = F.transform(F.filter(F.coalesce("scenes", F.array().cast("array<string>")), lambda s: F.coalesce(table[s] == F.col("industry"), F.lit(False))), lambda s: F.concat(F.lit("应用场景:"), s))
    named = F.coalesce(F.transform("seen", lambda x: F.concat(F.lit("关联企业:"), x["name"])), F.array().cast("array<string>"))
    proof = F.array_join(F.concat(scene, named), "；")
    sure = tags.join(seen.hint("merge"), ["own", "industry"], "left").select("own", "industry", F.when(proof == "", "应用场景/业务范围推断").otherwise(proof).alias("evidence"), F.lit(0.85).alias("confidence"), F.lit("标签推断").alias("data_source"))
    others = seen.where(F.col("industry") != own_industry).join(tags.select("own", "industry").hint("merge"), ["own", "industry"], "left_anti")
    guessed = others.select("own", "industry", F.concat(F.lit("关联企业:"), F.get("seen", F.lit(0))["name"], F.lit("推断")).alias("evidence"), F.lit(0.75).alias("confidence"), F.lit("原始文本推断").alias("data_source"))
    described = F.concat("own", F.lit("产品应用于"), "industry")
    return sure.unionByName(guessed).select(F.col("own").alias("subject"), F.col("industry").alias("object"), F.lit("下游行业").alias("rel_type"), described.alias("description"), F.lit("").alias("project"), F.lit("").alias("amount"), "industry", "evidence", "confidence", "data_source")


def fact_rows(records: DataFrame, columns: dict[str, dict[str, str]]) -> DataFrame:
    """Columns of the fact table from records: each by the record's type, '' as null. ``columns``: target to type to source."""
    pick = lambda by: F.nullif(F.coalesce(*[F.when(F.col("record_type") == t, F.col(c).cast("string")) for t, c in by.items()]), F.lit(""))
    return records.select("record_id", "record_type", *[pick(by).alias(name) for name, by in columns.items()])
