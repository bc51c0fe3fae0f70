"""Sentences, records and digests: weighting, in-document dedup, first matches, platforms, confidence of records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylight.operators.text import close_pairs, simhash
from quarrylight.sources.io import dropped, saved


def weighted(segment: Column, high: Column) -> Column:
    """The segment twice if its source is of high value, else once."""
    return F.when(high, F.array_repeat(segment, 2)).otherwise(F.array(segment))


def first_match(filtered: Column, raw: Column, pattern: str) -> Column:
    """Group 1 in the filtered text, else in the raw one, else ''."""
    pick = lambda c: F.nullif(F.regexp_extract(F.coalesce(c, F.lit("")), pattern, 1), F.lit(""))
    return F.coalesce(pick(filtered), pick(raw), F.lit(""))


def record_confidence(base: float, bonuses: list[tuple[Column, float]], most: float = 0.98) -> Column:
    """The base and a bonus for each condition that holds."""
    return F.bround(F.least(F.lit(most), sum((F.when(c, x).otherwise(0.0) for c, x in bonuses), F.lit(base))), 2)


def facts(df: DataFrame, key: Column, kind: Column | None, order: list[Column], number: int, size: int) -> DataFrame:
    """A page of the rows of a key, and of a type if given; the order has to be total."""
    own = df.where(key if kind is None else key & kind)
    return own.orderBy(*order).offset((number - 1) * size).limit(size)


def facts_page(df: DataFrame, key: Column, kind: Column | None, order: list[Column], number: int, size: int) -> DataFrame:
    """A page of ``facts`` with the number of all rows that match, as total."""
    total = df.where(key if kind is None else key & kind).agg(F.count("*").alias("total"))
    return facts(df, key, kind, order, number, size).join(F.broadcast(total), F.lit(True))  # one row


def digest(rows: DataFrame, key: str, tag: str, seq: str, most: int = 5) -> DataFrame:
    """(key, first, n): the first tags of each key, joined, and how many rows it has; only ``most`` are gathered."""
    n = F.row_number().over(Window.partitionBy(key).orderBy(seq, tag))
    first = rows.withColumn("n", n).where(F.col("n") <= most).groupBy(key).agg(F.sort_array(F.collect_list(F.struct("n", F.col(tag).alias("t")))).alias("x"))
    names = first.select(key, F.array_join(F.transform("x", lambda r: r["t"]), ",").alias("first"))
    return rows.groupBy(key).agg(F.count("*").alias("n")).join(names.hint("merge"), key)


def segments(df: DataFrame, key: str, text: str, marker: str) -> DataFrame:
    """(key, pos, tag, body): the text between markers, each with the marker before it; blank bodies go, the first has tag ''."""
    tags = F.concat(F.array(F.lit("")), F.regexp_extract_all(text, F.lit(marker), F.lit(1)))
    rows = df.where(F.col(text).isNotNull()).select(key, F.posexplode(F.arrays_zip(F.split(text, marker, -1).alias("body"), tags.alias("tag"))).alias("pos", "x"))
    return rows.select(key, F.col("pos").cast("long").alias("pos"), "x.tag", F.trim("x.body").alias("body")).where("body <> ''")


def passed_over(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, id): of pairs id < id2, the rows that are left out where rows are taken in order, each that isn't paired with one taken before.

    In a round, rows without an undecided earlier partner are taken, and their later partners left out. As many rounds as the
    longest chain of pairs has links that matter; no row's partners are gathered.
    """
    edges = saved(pairs.select(*keys, "id", "id2"))
    out = saved(edges.select(*keys, F.col("id2").alias("id")).where("false"))
    while not edges.isEmpty():
        later = edges.select(*keys, F.col("id2").alias("id"))
        taken = edges.select(*keys, "id").distinct().join(later.hint("merge"), [*keys, "id"], "left_anti")
        gone = saved(edges.join(taken.hint("merge"), [*keys, "id"], "left_semi").select(*keys, F.col("id2").alias("id")).distinct())
        before, all_ = edges, out
        left = edges.join(gone.hint("merge"), [*keys, "id"], "left_anti").join(gone.select(*keys, F.col("id").alias("id2")).hint("merge"), [*keys, "id2"], "left_anti")
        edges, out = saved(left.select(*keys, "id", "id2")), saved(out.unionByName(gone))
        dropped(before, all_, gone)
    return out


def keep_apart(marked: DataFrame, key: str, most: int = 3) -> DataFrame:
    """The rows of (key, pos, simhash, ...) kept in order: each that isn't within so many bits of one kept before in its document.

    Of equal fingerprints the first row stays. Pairs of near ones meet in the tables of ``close_pairs``, by document.
    """
    firsts = saved(marked.groupBy(key, "simhash").agg(F.min(F.struct("pos", *[c for c in marked.columns if c not in (key, "simhash", "pos")])).alias("x")).select(key, "simhash", "x.*"))
    gone = passed_over(close_pairs(firsts.select(key, F.col("pos").alias("id"), "simhash"), most, [key], most + 1), [key])
    return firsts.join(gone.select(key, F.col("id").alias("pos")).hint("merge"), [key, "pos"], "left_anti")


def near_lines(lines: DataFrame, key: str, most: int = 3) -> DataFrame:
    """(key, pos, sentence) of the lines kept in order: each that isn't within so many bits of one kept before in its document."""
    marked = lines.select(key, "pos", "sentence", simhash(F.col("sentence"), r"[A-Za-z]{2,}|[一-龥]{2,}").alias("simhash"))
    return keep_apart(marked, key, most).select(key, "pos", "sentence")
