"""Ranks over a whole table, and numbers within a key, without a window over all rows.

Rows are dealt into ranges of the order, counted by range, and numbered within each from what the ranges before it hold. So a
table, or a key that holds most of it, is spread over tasks. The order has to be total; nulls are ordered as it says.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylight.sources.io import saved

_PLACE = 33  # bits of monotonically_increasing_id that count within a partition


def ranked(df: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """The rows with their number in the order, from 1. The counts of the ranges, one number each, go through the driver."""
    rows = saved(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", _PLACE)
    counts = sorted(rows.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect())
    before = accumulate([0, *[c["n"] for c in counts]])
    offsets = rows.sparkSession.createDataFrame([(c["part"], b) for c, b in zip(counts, before, strict=False)], "_part long, _before long")
    place = F.col("_at").bitwiseAND((1 << _PLACE) - 1)
    numbered = rows.withColumn("_part", part).join(F.broadcast(offsets), "_part")  # one row a range
    return numbered.select(*[F.col(f"`{c}`") for c in df.columns], (F.col("_before") + place + 1).alias(name))


def numbered(df: DataFrame, keys: list[str], order: list[Column], name: str = "n") -> DataFrame:
    """The rows with their number, from 1, in the order of their key; null keys are a key.

    Ranks of the order (keys, order) less what lies before a key: its first rank is a partial aggregate.
    """
    all_ = saved(ranked(df, [*[F.asc(k) for k in keys], *order], "_rank"))
    first = all_.groupBy(*keys).agg(F.min("_rank").alias("_first")).select("_first", *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)])
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    joined = all_.join(first.hint("merge"), same)
    return joined.select(*[F.col(f"`{c}`") for c in df.columns], (F.col("_rank") - F.col("_first") + 1).alias(name))


def best(df: DataFrame, keys: list[str], order: list[Column], most: int) -> DataFrame:
    """The first rows of each key; Spark limits groups before it sorts them, as ``most`` is a literal."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_n") <= most).drop("_n")
