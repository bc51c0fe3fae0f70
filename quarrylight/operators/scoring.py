"""Evaluation and ranking of sources: probes, features, weighted scores, bands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylight.functions.exprs import any_hit, hits, map_first
from quarrylight.operators.ordering import ranked


def probe_stats(probes: DataFrame) -> DataFrame:
    """(domain, avg_ms, success_rate, stability, response) from (domain, ms, success); domains without success go."""
    ms = F.least("ms", F.lit(15000.0))
    s = probes.groupBy("domain").agg(F.avg(ms).alias("avg_ms"), F.avg(F.col("success").cast("double")).alias("success_rate"), (1 - F.avg((ms > 5000).cast("double"))).alias("stability"))
    score = F.greatest(F.lit(0.0), 100 - F.col("avg_ms") / 100) * 0.4 + F.col("success_rate") * 40 + F.col("stability") * 20
    return s.where("success_rate > 0").withColumn("response", score)


def kw_score(text: Column, full: list[str], half: list[str], denominator: float) -> Column:
    n = F.size(hits(text, full)) + F.size(hits(text, half)) * 0.5
    return F.bround(F.least(F.lit(1.0), n / denominator), 2)


def relation_richness(text: Column, words: list[str], pairs: list[tuple[str, str]], denominator: float = 12) -> Column:
    low = F.lower(text)
    bonus = sum((F.when(F.contains(low, F.lit(a)) & F.contains(low, F.lit(b)), 0.1).otherwise(0.0) for a, b in pairs), F.lit(0.0))
    return F.bround(F.least(F.lit(1.0), F.size(hits(text, words)) / denominator + bonus), 2)


# Patterns of structured markup, what each match counts and its most.
STRUCTURED = [(r"(?i)<table[^>]*>", 0.05, 0.3), (r"(?i)<(ul|ol)[^>]*>", 0.03, 0.2), (r"(?i)<dl[^>]*>", 0.05, 0.2), (r"""(?i)<div[^>]*class="[^"]*(?:card|item|list|info|company|enterprise)[^"]*\"""", 0.02, 0.3)]


def structuring(html: Column) -> Column:
    score = sum((F.least(F.lit(most), F.regexp_count(F.coalesce(html, F.lit("")), F.lit(p)) * step) for p, step, most in STRUCTURED), F.lit(0.0))
    return F.bround(F.least(F.lit(1.0), score), 4)


def freshness(text: Column, year: int) -> Column:
    """By the latest year of 2023 to 2039 up to the given one, else by a later date; the year is a parameter, so results don't depend on the day."""
    years = F.transform(F.regexp_extract_all(text, F.lit("20(?:2[3-9]|3[0-9])"), F.lit(0)), lambda x: x.cast("int"))
    top = F.array_max(F.filter(years, lambda y: y <= year))
    dated = F.when(text.rlike("202[3-9]-[0-9]{2}"), 0.8).otherwise(0.3)
    return F.when(F.length(text) == 0, 0.0).when(top >= year - 1, 1.0).when(top >= year - 2, 0.7).when(top.isNotNull(), 0.4).otherwise(dated)


def page_quality(html: Column, text: Column, errors: list[str]) -> Column:
    size = F.when(F.length(html) > 50000, 0.2).when(F.length(html) > 20000, 0.1).otherwise(0.0)
    body = F.when(F.length(text) > 3000, 0.2).when(F.length(text) > 1000, 0.1).otherwise(0.0)
    bad = F.when(any_hit(F.lower(F.substring(html, 1, 500)), errors), 0.3).otherwise(0.0)
    return F.bround(F.least(F.lit(1.0), F.greatest(F.lit(0.0), 0.5 + size - bad + body)), 2)


def authority(domain: Column, text: Column, official: list[str], known: list[str], words: list[str]) -> Column:
    flag = lambda c, x: F.when(c, x).otherwise(0.0)
    return F.bround(F.least(F.lit(1.0), 0.3 + flag(any_hit(domain, official), 0.4) + flag(any_hit(domain, known), 0.2) + flag(any_hit(F.lower(text), words), 0.1)), 2)


def rank(df: DataFrame, score: str, tie: str) -> DataFrame:
    """Ranks from 1 by falling score, ties in order of discovery."""
    return ranked(df, [F.desc(score), F.asc(tie)])


def top(df: DataFrame, score: str, tie: str, k: int = 20) -> DataFrame:
    """The k best with their ranks: what is ranked in one place are k rows."""
    return df.orderBy(F.desc(score), tie).limit(k).withColumn("rank", F.row_number().over(Window.orderBy(F.desc(score), tie)))


# Weights of the features in each score, and of the scores.
DATA_WEIGHTS = {"relation": 0.30, "info": 0.20, "industry": 0.25, "structure": 0.15, "fresh": 0.10}
SITE_WEIGHTS = {"page": 0.4, "friendly": 0.3, "authority": 0.3}
OVERALL_WEIGHTS = {"response": 0.30, "data": 0.40, "site": 0.30}


def weighted(parts: dict[str, Column], weights: dict[str, float], scale: float = 1.0) -> Column:
    return sum((parts[k] * scale * w for k, w in weights.items()), F.lit(0.0))


def site_scores(response: Column, features: dict[str, Column], data: dict[str, float] = DATA_WEIGHTS, site: dict[str, float] = SITE_WEIGHTS, overall: dict[str, float] = OVERALL_WEIGHTS, digits: int = 2) -> Column:
    """struct(data, site, overall), 0 to 100, of features from 0 to 1 and a response from 0 to 100."""
    d, s = weighted(features, data, 100), weighted(features, site, 100)
    all_ = weighted({"response": response, "data": d, "site": s}, overall)
    return F.struct(F.bround(d, digits).alias("data"), F.bround(s, digits).alias("site"), F.bround(all_, digits).alias("overall"))


def best_sample(probes: DataFrame, domain: Column, size: Column, seq: str, sample: str) -> DataFrame:
    """(domain, sample): the longest of each domain's, the first of those alike; empty ones don't count."""
    return probes.where(size > 0).groupBy(domain.alias("domain")).agg(F.max_by(sample, F.struct(size, -F.col(seq))).alias(sample))


def enabled(score: Column, least: float = 40) -> Column:
    return score >= least


def band(score: Column) -> Column:
    return F.when(score >= 85, 1).when(score >= 70, 2).when(score >= 55, 3).otherwise(4)


def grade(score: Column) -> Column:
    return F.when(score >= 85, "A").when(score >= 70, "B").when(score >= 55, "C").when(score >= 40, "D").otherwise("E")


def notes(parts: list[tuple[Column, str]], default: str) -> Column:
    joined = F.concat_ws("；", *[F.when(c, F.lit(t)) for c, t in parts])
    return F.when(joined == "", F.lit(default)).otherwise(joined)


def category(domain: Column, text: Column, by_domain: list[tuple[str, list[str]]], by_text: list[tuple[str, list[str]]], default: str) -> Column:
    found = map_first(domain, by_domain)
    return F.when(found != "", found).otherwise(map_first(F.lower(text), by_text, default))


def discover(seeds: DataFrame, hits: DataFrame, domain: str, seq: str, most: int = 150) -> DataFrame:
    """The first row of each domain, seeds before search hits, up to twice the number of sites that are wanted; seeds all stay.

    The cap is the feature: discovery stops there.
    """
    both = seeds.withColumn("stage", F.lit(0)).unionByName(hits.withColumn("stage", F.lit(1))).where(F.col(domain) != "")
    first = both.groupBy(domain).agg(F.min_by(F.struct(*both.columns), F.struct("stage", seq)).alias("x")).select("x.*")
    found = first.where("stage = 0")
    room = F.greatest(F.lit(0), F.lit(2 * most) - F.count("*"))
    place = first.where("stage = 1").orderBy(seq).limit(2 * most).withColumn("place", F.row_number().over(Window.orderBy(seq)))
    more = place.join(F.broadcast(found.agg(room.alias("room"))), F.lit(True)).where("place <= room").drop("place", "room")  # one row
    return found.unionByName(more).withColumn("source", F.when(F.col("stage") == 0, "seed").otherwise("search")).drop("stage")


def distribution(df: DataFrame, kind: Column) -> DataFrame:
    """(kind, n), the most frequent first."""
    return df.groupBy(kind.alias("kind")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "kind")


def evaluation_summary(discovered: DataFrame, evaluated: DataFrame, domain: str, wanted: int = 20) -> DataFrame:
    """One row: domains discovered and evaluated, and whether as many as wanted could be selected."""
    found = discovered.agg(F.count_distinct(domain).alias("total_discovered"))
    done = evaluated.agg(F.count("*").alias("total_evaluated"), (F.count("*") >= wanted).alias("top20_selected"))
    return found.join(F.broadcast(done), F.lit(True))  # one row


def pending(candidates: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """What is left to do: candidates, or keywords, whose key isn't done yet."""
    return candidates.join(done.select(key).hint("merge"), key, "left_anti")
