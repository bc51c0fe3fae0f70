"""Company fields from text: one row a company, wide projections of native expressions. Patterns and words are arguments.

A null text counts as empty; a field that isn't found is '' and belongs to the uncertain ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylight.functions import domain as D
from quarrylight.functions.exprs import any_hit, bands, in_both, is_missing, map_all, map_first, ordered_extract, words_array

DATE = r"((?:19|20)[0-9]{2})[年/-]([0-9]{1,2})(?:[月/-]([0-9]{1,2}))?"


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def _before(text: Column, part: Column, n: int) -> Column:
    """Up to n characters before the first place of a part."""
    at = F.position(part, text)
    return F.substring(text, F.greatest(at - n, F.lit(1)), F.least(at - 1, F.lit(n)))


def enterprise_name(given: Column, text: Column, patterns: list[str] = D.NAMES, least: int = 4) -> Column:
    found = ordered_extract(text, patterns, lambda v: F.length(v) >= least)["value"]
    return F.coalesce(F.nullif(F.trim(given), F.lit("")), found)


def establish_time(text: Column, words: list[str] = D.FOUNDED, years: tuple[int, int] = (1990, 2023)) -> Column:
    """struct(value, uncertain): a date up to 30 characters after a founding word, else just before one, else any in the years."""
    w = "(?:" + "|".join(words) + ")"
    t = _text(text)

    def iso(pattern: str, first: int) -> Column:
        m = lambda i: F.regexp_extract(t, pattern, first + i)
        tail = F.when(m(2) != "", F.concat(F.lit("-"), F.lpad(m(2), 2, "0"))).otherwise("")
        return F.when(m(0) != "", F.concat(m(0), F.lit("-"), F.lpad(m(1), 2, "0"), tail))

    sure, near, any_ = iso(rf"{w}[^\n]{{0,30}}?{DATE}", 1), iso(rf"{DATE}日?[^\n]{{0,10}}?{w}", 1), iso(DATE, 1)
    any_ = F.when(F.substring(any_, 1, 4).try_cast("int").between(*years), any_)
    value = F.coalesce(sure, near, any_, F.lit(""))
    return F.struct(value.alias("value"), sure.isNull().alias("uncertain"))


def addresses(text: Column, patterns: list[str] = D.ADDRESSES, actual_words: list[str] = D.ACTUAL_ADDRESS, least: int = 6, fallbacks: list[tuple[str, int]] = D.ADDRESS_FALLBACKS) -> Column:
    """struct(register, actual): by patterns in order, the first addresses without and with one of the words in the 20 characters before the match.

    Where none is registered, that of the first fallback pattern whose match is longer than it asks.
    """
    t = _text(text)
    pairs = lambda p: F.arrays_zip(F.regexp_extract_all(t, F.lit(p), F.lit(0)).alias("whole"), F.regexp_extract_all(t, F.lit(p), F.lit(1)).alias("address"))
    found = F.filter(F.flatten(F.array(*[pairs(p) for p in patterns])), lambda x: F.length(x["address"]) >= least)
    is_actual = lambda x: any_hit(_before(t, x["whole"], 20), actual_words)
    first = lambda x: F.coalesce(F.get(x, F.lit(0))["address"], F.lit(""))
    other = lambda p: F.trim(F.regexp_extract(t, p, 1))
    register = F.coalesce(F.nullif(first(F.filter(found, lambda a: ~is_actual(a))), F.lit("")), *[F.when(F.length(F.regexp_extract(t, p, 1)) > n, other(p)) for p, n in fallbacks], F.lit(""))
    return F.struct(register.alias("register"), first(F.filter(found, is_actual)).alias("actual"))


def main_business(text: Column, scope: Column, rules: list[tuple[str, list[str]]] = D.SEGMENTS) -> Column:
    """All segments with a word in the text, joined; without any, those with a word in the scope or in both together."""
    own = map_all(text, rules)
    return F.array_join(F.when(F.size(own) > 0, own).otherwise(map_all(F.concat_ws(" ", _text(scope), _text(text)), rules)), "、")


def employee_scale(text: Column, patterns: list[str] = D.STAFF, cuts: list[tuple[float, str]] = D.STAFF_BANDS, last: str = D.STAFF_LAST) -> Column:
    """The band of the first pattern's number, or of the middle of its range; '' without one."""
    t, found = _text(text), []
    for p in patterns:
        n = lambda i, p=p: F.regexp_extract(t, p, i).try_cast("long")
        found.append(F.floor((n(1) + n(2)) / 2) if p.count("(") - p.count("(?") > 1 else n(1))
    middle = F.coalesce(*found)
    return F.when(middle.isNull(), "").otherwise(bands(middle, cuts, last))


def legal_person(text: Column, patterns: list[str] = D.LEGAL_PERSON, rejected: list[str] = D.NO_PERSON) -> Column:
    return ordered_extract(text, patterns, lambda v: ~v.isin(*rejected))


def registered_capital(text: Column, patterns: list[tuple[str, str]] = D.CAPITAL, sample: int = 200) -> Column:
    """struct(value, diagnostics): the number without commas and the unit of its pattern; why and where it was missed."""
    t = _text(text)
    found = [F.nullif(F.replace(F.regexp_extract(t, p, 1), F.lit(","), F.lit("")), F.lit("")) for p, _ in patterns]
    value = F.coalesce(*[F.when(f.isNotNull(), F.concat(f, F.lit(unit))) for f, (_, unit) in zip(found, patterns, strict=True)])
    why = F.struct(F.lit("no pattern matched").alias("reason"), F.substring(t, 1, sample).alias("text_sample"), words_array([p for p, _ in patterns]).alias("tried_patterns"))
    return F.struct(F.coalesce(value, F.lit("")).alias("value"), F.when(value.isNull(), why).alias("diagnostics"))


def business_scope(text: Column, patterns: list[str] = D.SCOPE, least: int = 5) -> Column:
    found = ordered_extract(text, patterns, lambda v: F.length(F.regexp_replace(v, r"\s+", "")) > least)["value"]
    return F.regexp_replace(found, r"\s+", "")


def core_products(text: Column, words: list[str] = D.CORE_PRODUCTS, covered: list[tuple[str, str]] = D.COVERED_PRODUCTS) -> Column:
    """The words in the text, in order; of (long, short) the short one goes where the long one is there."""
    out = F.filter(words_array(words), lambda w: F.contains(_text(text), w))
    for long, short in covered:
        out = F.when(F.array_contains(out, long), F.array_remove(out, short)).otherwise(out)
    return out


def product_spec(text: Column, patterns: list[str] = D.SPECS) -> Column:
    return F.concat_ws("；", *[F.nullif(F.regexp_extract(_text(text), p, 0), F.lit("")) for p in patterns])


def qualification_flag(text: Column, yes: list[str], no: list[str], strict: bool = False) -> Column:
    """是, 否 or 未明确. Positive words are tested first; with ``strict`` the negative ones are."""
    y, n = (any_hit(text, yes), F.lit("是")), (any_hit(text, no), F.lit("否"))
    (a, la), (b, lb) = (n, y) if strict else (y, n)
    return F.when(a, la).when(b, lb).otherwise("未明确")


def patent_count(text: Column, patterns: list[str] = D.PATENTS, word: str = "发明") -> Column:
    """struct(total, invention): each pattern's first number; those with the word up to 10 characters before are inventions."""
    t, total, inv = _text(text), [], []
    for p in patterns:
        m, n = F.regexp_extract(t, p, 0), F.regexp_extract(t, p, 1).try_cast("long")
        near = F.contains(_before(t, m, 10), F.lit(word)) | F.contains(m, F.lit(word))
        inv.append(F.when(near, n).otherwise(0))
        total.append(F.when(near, 0).otherwise(n))
    most = lambda xs: F.greatest(*[F.coalesce(x, F.lit(0)) for x in xs], F.lit(0)).cast("long")
    return F.struct(most(total).alias("total"), most(inv).alias("invention"))


def patent_text(text: Column, patterns: list[str] = D.PATENTS, word: str = "发明", topics: list[str] = D.PATENT_TOPICS, about: str = "专利") -> Column:
    """N项（发明专利M项（含…相关）: the parts that there are, with up to three topics that the text names beside patents; '' without a number.

    Only inventions make the total where there is no other; the one closing bracket is as the format has it.
    """
    t, n = _text(text), patent_count(text, patterns, word)
    total = F.when(n["total"] > 0, n["total"]).otherwise(n["invention"])
    named = F.slice(F.filter(words_array(topics), lambda w: F.contains(t, F.lit(about)) & F.contains(t, w)), 1, 3)
    more = F.concat_ws("（", F.when(n["invention"] > 0, F.concat(F.lit("发明专利"), n["invention"].cast("string"), F.lit("项"))), F.when(F.size(named) > 0, F.concat(F.lit("含"), F.array_join(named, "、"), F.lit("相关"))))
    first = F.concat(total.cast("string"), F.lit("项"))
    return F.when(total == 0, "").when(more == "", first).otherwise(F.concat(first, F.lit("（"), more, F.lit("）")))


def bidding_project(text: Column, patterns: list[str], bid_words: list[str], money: str, own: Column, wider: list[str], delimiters: str) -> Column:
    """A pattern's group, else the first sentence with a bid word and money or the own name, else with a wider word and money."""
    parts = F.transform(F.split(_text(text), delimiters), lambda s: F.trim(s))
    first = lambda test: F.get(F.filter(parts, test), F.lit(0))
    paid = lambda s: s.rlike(money)
    direct = F.nullif(ordered_extract(text, patterns)["value"], F.lit("")) if patterns else F.lit(None)
    return F.coalesce(direct, first(lambda s: any_hit(s, bid_words) & (paid(s) | F.contains(s, own))), first(lambda s: any_hit(s, wider) & paid(s)), F.lit(""))


def partners(text: Column, pattern: str, own: Column, known: list[str], stop: list[str], least: int = 4, most: int = 8) -> Column:
    """Names in the text by first place: matches and known ones, without stop names and those that contain the own or lie in it."""
    t = _text(text)
    names = F.array_union(F.regexp_extract_all(t, F.lit(f"({pattern})"), F.lit(1)), F.filter(words_array(known), lambda w: F.contains(t, w)))
    kept = F.filter(names, lambda n: (F.length(n) >= least) & ~n.isin(*stop) & ~in_both(n, own))
    placed = F.array_sort(F.transform(kept, lambda n: F.struct(F.position(n, t).alias("at"), n.alias("name"))))
    return F.slice(F.transform(placed, lambda x: x["name"]), 1, most)


def industry_class(text: Column, rules: list[tuple[str, list[str]]] = D.SEGMENTS, default: str = "", scope: Column | None = None, scopes: list[tuple[str, list[str]]] = D.SCOPE_INDUSTRIES) -> Column:
    """The first three segments with a word in the text; without any, the first industry with a word in the scope; else the default."""
    segments = F.nullif(F.array_join(F.slice(map_all(text, rules), 1, 3), "/"), F.lit(""))
    return F.coalesce(segments, *([F.nullif(map_first(scope, scopes), F.lit(""))] if scope is not None else []), F.lit(default))


def source_labels(urls: Column, rules: list[tuple[str, list[str]]], default: str) -> Column:
    """The distinct labels of the urls, sorted and joined."""
    return F.array_join(F.array_sort(F.array_distinct(F.transform(urls, lambda u: map_first(u, rules, default)))), "、")


def clean_confidence(filled: list[Column], extra: list[tuple[Column, float]]) -> Column:
    """0.3, 0.085 for each filled field up to 0.98, and the extras, up to 0.98 again."""
    n = sum((F.when(is_missing(c), 0).otherwise(1) for c in filled), F.lit(0))
    more = sum((F.when(is_missing(c), 0.0).otherwise(x) for c, x in extra), F.lit(0.0))
    return F.bround(F.least(F.least(0.3 + 0.085 * n, F.lit(0.98)) + more, F.lit(0.98)), 2)


def clean_status(text: Column, core: list[Column]) -> Column:
    full = F.lit(True)
    for c in core:
        full = full & ~is_missing(c)
    return F.when(_text(text) == "", "failed").when(full, "success").otherwise("partial")


def clean_note(text: Column, core: list[Column], uncertain: Column) -> Column:
    """What the status says in words: how many of the core fields are filled, and how many fields are uncertain."""
    n, more = sum((F.when(is_missing(c), 0).otherwise(1) for c in core), F.lit(0)), F.concat(uncertain.cast("string"), F.lit(" 个字段不确定"))
    some = F.when(n >= 2, F.concat(F.lit("部分字段提取成功，"), more)).when(n >= 1, F.concat(F.lit("核心字段提取不充分，仅"), n.cast("string"), F.lit("个字段有值，"), more)).otherwise("核心字段提取不足，但已尽力提取可用信息")
    return F.when(_text(text) == "", "输入数据为空或格式错误").when(n >= len(core), "所有核心字段提取完整").otherwise(some)


def diagnostics(found: dict[str, Column]) -> Column:
    """A map from a missed field to its struct of diagnostics; fields with null diagnostics aren't in it."""
    return F.map_filter(F.create_map(*[x for k, v in found.items() for x in (F.lit(k), v)]), lambda k, v: v.isNotNull())


def uncertain_fields(columns: list[str]) -> Column:
    return F.array_compact(F.array(*[F.when(is_missing(F.col(c)), F.lit(c)) for c in columns]))


def gap_queue(df: DataFrame, key: str, columns: list[str], text: str, sample: int = 6000) -> DataFrame:
    """(key, field, text_sample) of every missing field: what a model outside is to answer."""
    return df.select(key, F.explode(uncertain_fields(columns)).alias("field"), F.substring(text, 1, sample).alias("text_sample"))


def gap_fill(df: DataFrame, answers: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """The rows with answers (key, field, value) in place of missing fields; an answer that is missing itself counts for nothing.

    Of several answers to a field the smallest counts.
    """
    good = answers.where(~is_missing(F.col("value"))).groupBy(key).pivot("field", columns).agg(F.min("value"))
    new = good.select(key, *[F.col(c).alias(f"_{c}") for c in columns])
    filled = df.join(new.hint("merge"), key, "left")
    return filled.select(*[F.when(is_missing(F.col(c)), F.coalesce(f"_{c}", c)).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in df.columns])
