"""Tags, fields, relations and transaction records as column rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylight.functions import domain
from quarrylight.functions.exprs import hits, is_missing
from quarrylight.operators.ordering import numbered

# Legal suffixes of company names, in order.
SUFFIXES = ("股份有限公司", "有限公司", "有限责任公司", "公司")


def short_name(name: Column, suffixes: tuple[str, ...] = SUFFIXES) -> Column:
    out = name
    for s in reversed(suffixes):
        out = F.when(name.endswith(s), F.substring(name, 1, F.length(name) - len(s))).otherwise(out)
    return out


def normalize_terms(c: Column, terms: list[tuple[str, str]], longest_first: bool = False) -> Column:
    """Replacements one after the other; a later one sees what an earlier one made.

    With ``longest_first``, one pass that takes the longest term at each place and leaves what it has made alone.
    """
    if longest_first:
        by_size = sorted(dict(reversed(terms)).items(), key=lambda kv: -len(kv[0]))  # of equal terms the first counts
        table = F.create_map(*[F.lit(x) for kv in by_size for x in kv])
        pieces = F.regexp_extract_all(c, F.lit("(?s)" + "|".join(["\\Q" + k + "\\E" for k, _ in by_size] + ["."])), F.lit(0))
        return F.array_join(F.transform(pieces, lambda x: F.coalesce(table[x], x)), "")
    for old, new in terms:
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


def keyword_tags(text: Column, labels: dict[str, str], most: int | None = None) -> Column:
    """Distinct labels of the keywords in the text, in dictionary order."""
    table = F.create_map(*[F.lit(x) for kv in labels.items() for x in kv])
    found = F.array_distinct(F.transform(hits(text, list(labels)), lambda k: table[k]))
    return F.slice(found, 1, most) if most else found


def tag_confidence(base: float, field: Column) -> Column:
    return F.when(is_missing(field), 0.0).otherwise(F.bround(F.least(base + F.least(F.length(field) / 100, F.lit(0.05)), F.lit(0.99)), 2))


def tag_rows(df: DataFrame, key: str, dim: str, sub: str, tags: Column, field: str, base: float) -> DataFrame:
    """Long form; a row without tags gives one uncertain tag of confidence 0."""
    none = F.array(F.lit(f"{sub}-未明确"))
    rows = df.select(key, F.posexplode(F.when(F.size(tags) > 0, tags).otherwise(none)).alias("ord", "tag"), tag_confidence(base, F.col(field)).alias("c"))
    return rows.select(key, F.lit(dim).alias("dim"), F.lit(sub).alias("sub_category"), "ord", "tag", F.lit(field).alias("source_field"), F.when(F.col("tag").endswith("未明确"), 0.0).otherwise(F.col("c")).alias("confidence"))


def tag_summary(tags: DataFrame, key: str, seq: str = "ord") -> DataFrame:
    """Mean confidence of tags over 0, their number, the uncertain ones as a list and a note with the first three reasons.

    A dimension has one uncertain tag at most, so the list is as long as there are dimensions.
    """
    sure = F.col("confidence") > 0
    reason = F.concat("sub_category", F.lit("：缺少"), "source_field")
    s = tags.groupBy(key).agg(
        F.bround(F.coalesce(F.avg(F.when(sure, F.col("confidence"))), F.lit(0.0)), 2).alias("confidence"), F.count_if(sure).alias("n_tags"),
        F.sort_array(F.collect_list(F.when(~sure, F.struct("sub_category", seq, "tag", reason.alias("reason"))))).alias("x"),
    )
    n = F.size("x").cast("long")
    state = F.when(F.col("confidence") >= 0.9, "标签生成正常，核心标签基于模块2结构化字段").when(F.col("confidence") >= 0.7, "标签生成部分完成，部分字段缺失影响标签覆盖").otherwise("标签生成受限，多数字段缺失")
    reasons = F.array_join(F.transform(F.slice("x", 1, 3), lambda u: u["reason"]), "; ")
    more = F.when(n > 0, F.concat(F.lit("；未明确标签"), n.cast("string"), F.lit("项："), reasons)).otherwise("")
    return s.select(key, "confidence", "n_tags", n.alias("n_uncertain"), F.array_join(F.transform("x", lambda u: u["tag"]), ",").alias("uncertain"), F.concat(state, more).alias("note"))


def gap_merge(tags: DataFrame, answers: DataFrame, key: str) -> DataFrame:
    """Answers (key, sub_category, tag, confidence) replace the uncertain tags of their sub category, capped at 0.95."""
    bad = tags.where(F.col("tag").endswith("未明确"))
    new = bad.drop("tag", "confidence").join(answers.hint("merge"), [key, "sub_category"]).withColumn("confidence", F.least("confidence", F.lit(0.95)))
    kept = tags.where(~F.col("tag").endswith("未明确")).unionByName(bad.join(answers.select(key, "sub_category").hint("merge"), [key, "sub_category"], "left_anti"))
    return kept.unionByName(new.select(*tags.columns))


def dedup_edges(edges: DataFrame, keys: list[str], confidence: str, seq: str) -> DataFrame:
    """The most confident edge of each key, the first of those alike."""
    best = edges.groupBy(*keys).agg(F.min_by(F.struct(*edges.columns), F.struct(-F.col(confidence), seq)).alias("row"))
    return best.select("row.*")


def type_counts(edges: DataFrame, kind: str, name: str) -> DataFrame:
    """Number of edges by type and the first five objects; only five rows a type are gathered."""
    total = edges.groupBy(kind).agg(F.count("*").alias("n"))
    names = edges.select(kind, name).distinct().withColumn("k", F.row_number().over(Window.partitionBy(kind).orderBy(name))).where("k <= 5")
    return total.join(names.groupBy(kind).agg(F.array_join(F.sort_array(F.collect_list(name)), ",").alias("first")).hint("merge"), kind)


def record_ids(records: DataFrame, key: str, kind: str, prefix: Column, seq: str) -> DataFrame:
    """PREFIX-001 and so on, counted by key and type."""
    rows = numbered(records.withColumn("_prefix", prefix), [key, kind], [F.asc(seq)], "_n")
    return rows.withColumn("record_id", F.format_string("%s-%03d", "_prefix", "_n")).drop("_prefix", "_n")


def parse_amount(text: Column, patterns: list[tuple[str, str, list[str]]] = domain.AMOUNTS, plain: str | None = domain.PLAIN_AMOUNT) -> Column:
    """struct(amount, unit, raw, currency) of the first pattern that matches, if the text has one of its words.

    Without one, plain yuan count: from 10000 on in 万元 to one place, below that in 元. Commas go; '' without an amount.
    """
    t = F.coalesce(text, F.lit(""))
    none = F.struct(*[F.lit("").alias(c) for c in ("amount", "unit", "raw")])
    out = none
    if plain:
        digits, raw = F.replace(F.regexp_extract(t, plain, 1), F.lit(","), F.lit("")), F.regexp_extract(t, plain, 0)
        yuan = digits.try_cast("double")
        large = F.struct(F.bround(yuan / 10000, 1).cast("string").alias("amount"), F.lit("万元").alias("unit"), raw.alias("raw"))
        small = F.struct(digits.alias("amount"), F.lit("元").alias("unit"), raw.alias("raw"))
        out = F.when(yuan >= 10000, large).when(yuan.isNotNull(), small).otherwise(none)
    for p, unit, words in reversed(patterns):
        found = F.struct(F.replace(F.regexp_extract(t, p, 1), F.lit(","), F.lit("")).alias("amount"), F.lit(unit).alias("unit"), F.regexp_extract(t, p, 0).alias("raw"))
        ok = t.rlike(p)
        for_words = F.lit(not words)
        for w in words:
            for_words = for_words | F.contains(t, F.lit(w))
        out = F.when(ok & for_words, found).otherwise(out)
    return F.struct(out["amount"].alias("amount"), out["unit"].alias("unit"), out["raw"].alias("raw"), F.lit("人民币").alias("currency"))


def parse_date(text: Column) -> Column:
    """yyyy-MM[-dd]: the first full date in 年月日, else the first with - or /, else the first year and month."""
    out = F.lit("")
    for p in reversed(DATES):
        m = lambda i, p=p: F.regexp_extract(text, p, i)
        day = F.concat(F.lit("-"), F.lpad(m(3), 2, "0")) if p.count("(") > 2 else F.lit("")
        out = F.when(m(1) != "", F.concat(m(1), F.lit("-"), F.lpad(m(2), 2, "0"), day)).otherwise(out)
    return out


# Dates, in order.
DATES = (r"(\d{4})\s*年\s*(\d{1,2})\s*月\s*(\d{1,2})\s*日", r"(\d{4})\s*[-/]\s*(\d{1,2})\s*[-/]\s*(\d{1,2})", r"(\d{4})\s*年\s*(\d{1,2})\s*月")
