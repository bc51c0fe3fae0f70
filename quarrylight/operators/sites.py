"""Crawl assembly and source configuration: status, relevance, official sites, ids, types, merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylight.functions.exprs import any_hit, words_array
from quarrylight.operators.ordering import numbered


def crawl_score(items: DataFrame, key: str, category: str, text: str) -> DataFrame:
    """(key, filled, confidence, status): filled categories and their length, which counts once more in the joined text."""
    size = F.length(F.coalesce(F.col(text), F.lit(""))).cast("long")
    part = items.groupBy(key, category).agg(F.sum(size).alias("n")).where("n > 0")
    all_ = items.select(key).distinct().join(part.groupBy(key).agg(F.count("*").alias("filled"), F.sum("n").alias("n")).hint("merge"), key, "left")
    filled, total = F.coalesce("filled", F.lit(0)), 2 * F.coalesce("n", F.lit(0))
    score = F.bround(F.least(F.lit(0.95), 0.2 + 0.18 * filled + F.least(total / 15000, F.lit(0.15))), 2)
    return all_.select(key, filled.cast("long").alias("filled"), score.alias("confidence"), F.when(filled >= 4, "success").when(filled >= 1, "partial").otherwise("failed").alias("status"))


def relevance(text: Column, full: str, short: str, words: list[str], stop: str = "。") -> Column:
    """Mentions of both names, and pairs of a sentence with a name and a word in it; between 0.1 and 1, 0 without a text."""
    n = lambda w: F.regexp_count(text, F.lit(w)) if len(w) > 1 else F.lit(0)
    named = F.filter(F.split(text, stop), lambda s: s.contains(full) | s.contains(short))
    pairs = F.aggregate(named, F.lit(0), lambda acc, s: acc + sum((s.contains(w).cast("int") for w in words), F.lit(0)))
    score = F.bround(F.greatest(F.lit(0.1), F.least(F.lit(1.0), n(full) * 0.05 + n(short) * 0.03 + pairs * 0.1)), 2)
    return F.when(F.coalesce(text, F.lit("")) == "", 0.0).otherwise(score)


def discounted(confidence: Column, relevance: Column, least: float = 0.3, factor: float = 0.6) -> Column:
    """The confidence, cut where the text has little to do with the company."""
    return F.when(relevance < least, confidence * factor).otherwise(confidence)


def first_confirmed(pages: DataFrame, key: Column, order: str, text: str, names: list[str], least: int = 100) -> DataFrame:
    """(key, order): the first page of each key that is long enough and holds a name."""
    ok = pages.where((F.length(text) > least) & any_hit(F.col(text), names))
    return ok.groupBy(key.alias("key")).agg(F.min(order).alias(order))


def crawl_friendly(html: Column, seconds: Column, captcha: list[str], throttle: list[str], head: int = 3000) -> Column:
    flag = lambda c, x: F.when(c, x).otherwise(0.0)
    low = F.lower(F.substring(F.coalesce(html, F.lit("")), 1, head))
    slow = F.when(seconds > 8, 0.2).when(seconds > 5, 0.1).otherwise(0.0)
    score = 0.5 - flag(any_hit(low, captcha), 0.4) - flag(any_hit(low, throttle), 0.3) - slow + flag(F.length(html) > 500, 0.2)
    return F.bround(F.least(F.lit(1.0), F.greatest(F.lit(0.0), score)), 2)


def source_ids(df: DataFrame, title: str, seq: str, most: int = 30) -> DataFrame:
    """Ids of letters and digits, ``source`` if none is left; repeated ones get _1, _2 in order of seq."""
    slug = F.substring(F.lower(F.regexp_replace(F.coalesce(F.col(title), F.lit("")), "[^A-Za-z0-9一-龥]", "")), 1, most)
    own = df.withColumn("slug", F.when(slug == "", "source").otherwise(slug))
    rows = numbered(own, ["slug"], [F.asc(seq)])
    return rows.withColumn("source_id", F.when(F.col("n") == 1, F.col("slug")).otherwise(F.concat_ws("_", "slug", (F.col("n") - 1).cast("string")))).drop("slug", "n")


def type_keywords(types: Column, templates: dict[str, list[str]]) -> Column:
    """Distinct templates of the types, in their order."""
    lists = F.lit(None).cast("array<string>")
    out = F.transform(types, lambda t: F.coalesce(*[F.when(t == k, words_array(v)) for k, v in templates.items()], lists))
    return F.array_distinct(F.flatten(F.array_compact(out)))


def merge_config(new: DataFrame, old: DataFrame, key: str, cols: list[str], if_empty: list[str] = ()) -> DataFrame:
    """What the old configuration holds in the columns is kept; in the array columns ``if_empty`` only where the new one has nothing."""
    o = old.select(key, *[F.col(c).alias(f"old_{c}") for c in [*cols, *if_empty]]).dropDuplicates([key])
    j = new.join(o.hint("merge"), key, "left")
    filled = lambda c: F.when(F.coalesce(F.size(c), F.lit(0)) > 0, F.col(c)).otherwise(F.coalesce(f"old_{c}", c)).alias(c)
    return j.select(*[F.coalesce(f"old_{c}", c).alias(c) if c in cols else filled(c) if c in if_empty else F.col(c) for c in new.columns])


def carry_forward(old: DataFrame, done: DataFrame, key: str, at: str, now: Column, days: int = 7) -> DataFrame:
    """Evaluations of the last days of keys that aren't done yet; those without a readable time go."""
    fresh = old.where(F.col(at).isNotNull() & (F.unix_timestamp(now) - F.unix_timestamp(at) <= days * 86400))
    return fresh.join(done.select(key).hint("merge"), key, "left_anti")
