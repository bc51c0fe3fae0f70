"""Finding companies and tags: completion of tags, distributions, trends, and nested filters as data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylight.functions.exprs import is_missing, words_array


def prefix_index(tags: DataFrame, tag: str, most: int = 10) -> DataFrame:
    """(prefix, place, tag, n): for every prefix of a tag, in lower case, its most frequent tags, ties by name.

    Tags are counted first, so a frequent one is one row; prefixes keep their best on the map side.
    """
    counted = tags.where(~is_missing(F.col(tag))).groupBy(F.col(tag).alias("tag")).agg(F.count("*").alias("n"))
    low = F.lower("tag")
    rows = counted.select("tag", "n", F.explode(F.sequence(F.lit(1), F.length(low))).alias("size")).withColumn("prefix", F.substring(low, F.lit(1), F.col("size")))
    place = F.row_number().over(Window.partitionBy("prefix").orderBy(F.desc("n"), "tag"))
    return rows.withColumn("place", place).where(F.col("place") <= most).select("prefix", "place", "tag", "n")


def complete(index: DataFrame, typed: str) -> DataFrame:
    """The tags that begin with what was typed, the most frequent first; blanks around it don't count."""
    return index.where(F.col("prefix") == typed.strip().lower()).orderBy("place").select("tag", "n")


def distribution(tags: DataFrame, by: list[str], sets: list[list[str]], company: str) -> DataFrame:
    """(by, level, n, companies): rows and distinct companies for each set of columns; columns outside a set are null.

    level: the set's columns, comma-joined. Rows are counted by company first, on the map side: a row for each company and combination is dealt out.
    """
    once = tags.groupBy(*by, company).agg(F.count("*").alias("_n"))
    grouped = once.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in by])
    level = F.concat_ws(",", *[F.when(F.grouping(c) == 0, c) for c in by])
    return grouped.agg(level.alias("level"), F.sum("_n").alias("n"), F.count_distinct(company).alias("companies"))


def top_tags(tags: DataFrame, by: list[str], tag: str, most: int) -> DataFrame:
    """(by, tag, n, place): the most frequent tags of each group, ties by name."""
    counted = tags.groupBy(*by, tag).agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("n"), tag))
    return counted.withColumn("place", place).where(F.col("place") <= most)


def trend(rows: DataFrame, time: str, kind: str, unit: str = "day") -> DataFrame:
    """(kind, period, n, total): rows by period, 0 in those without any, from the first to the last period of all, and the running total.

    Counts are aggregated before they meet the calendar, which has a row a kind and period. Rows without a time or kind go.
    """
    counted = rows.where(F.col(time).isNotNull() & F.col(kind).isNotNull()).groupBy(F.col(kind).alias("kind"), F.trunc(time, unit).alias("period") if unit != "day" else F.to_date(time).alias("period")).agg(F.count("*").alias("n"))
    span = counted.agg(F.min("period").alias("a"), F.max("period").alias("b"))
    kinds = counted.select("kind").distinct()
    step = F.expr(f"INTERVAL 1 {unit}")
    calendar = kinds.join(F.broadcast(span), F.lit(True)).select("kind", F.explode(F.sequence("a", "b", step)).alias("period"))  # one row
    full = calendar.join(counted.hint("merge"), ["kind", "period"], "left").select("kind", "period", F.coalesce("n", F.lit(0)).cast("long").alias("n"))
    return full.withColumn("total", F.sum("n").over(Window.partitionBy("kind").orderBy("period").rowsBetween(Window.unboundedPreceding, 0)))


_OPS = {
    "=": lambda c, v: c == v, "!=": lambda c, v: c != v, "<": lambda c, v: c < v, "<=": lambda c, v: c <= v, ">": lambda c, v: c > v, ">=": lambda c, v: c >= v,
    "in": lambda c, v: c.isin(*v), "between": lambda c, v: c.between(*v), "starts": lambda c, v: c.startswith(v), "contains": lambda c, v: F.contains(c, F.lit(v)),
    "any": lambda c, v: F.arrays_overlap(c, words_array(v)), "all": lambda c, v: F.size(F.array_intersect(c, words_array(v))) == len(set(v)), "missing": lambda c, v: is_missing(c) if v else ~is_missing(c),
}


def condition(tree: dict, fields: dict[str, str]) -> Column:
    """A filter from data: {"and": [...]}, {"or": [...]}, {"not": ...} or {"field", "op", "value"}, nested at will.

    ``fields`` maps the names that a filter may use to columns; other names and operators are errors. An empty "and" holds, an
    empty "or" doesn't. Comparisons, lists, ranges and text ends reach the file scan. A null field holds for nothing but "missing".
    """
    if len(tree) == 1:
        (how, parts), = tree.items()
        if how == "not":
            return ~condition(parts, fields)
        if how in ("and", "or"):
            out = None
            for part in parts:
                c = condition(part, fields)
                out = c if out is None else (out & c if how == "and" else out | c)
            return F.lit(how == "and") if out is None else out
    if set(tree) != {"field", "op", "value"} or tree["field"] not in fields or tree["op"] not in _OPS:
        raise ValueError(f"no such filter: {tree!r}")
    return _OPS[tree["op"]](F.col(fields[tree["field"]]), tree["value"])


def advanced(df: DataFrame, tree: dict, fields: dict[str, str]) -> DataFrame:
    """The rows for which the condition holds."""
    return df.where(condition(tree, fields))
