"""Profile serving: latest batches, search, pages of results, facts, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SORTABLE = ("name", "batch_no", "confidence", "created_at")


def latest_batch(df: DataFrame, key: str = "name", batch: str = "batch_no") -> DataFrame:
    """All rows of each key's greatest batch."""
    top = df.groupBy(key).agg(F.max(batch).alias(batch))
    return df.join(top.hint("merge"), [key, batch], "left_semi")


def search(df: DataFrame, word: str, col: str = "name") -> DataFrame:
    return df.where(F.contains(F.lower(col), F.lit(word.lower())))


def list_sorted(df: DataFrame, col: str, descending: bool, tie: str, allowed: tuple[str, ...] = SORTABLE) -> DataFrame:
    if col not in allowed:
        raise ValueError(f"can't sort by {col}")
    return df.orderBy(F.desc(col) if descending else F.asc(col), tie)


def page(df: DataFrame, number: int, size: int, order: list[Column]) -> DataFrame:
    """A page, with the number of all rows; the order has to be total."""
    total = df.agg(F.count("*").alias("total"))
    return df.orderBy(*order).offset((number - 1) * size).limit(size).join(F.broadcast(total), F.lit(True))  # one row


def detail(df: DataFrame, name: str, batch_no: str | None = None) -> DataFrame:
    own = df.where(F.col("name") == name)
    return own.where(F.col("batch_no") == batch_no) if batch_no else own.orderBy(F.desc("batch_no")).limit(1)


def batch_history(df: DataFrame, name: str) -> DataFrame:
    return df.where(F.col("name") == name).orderBy(F.desc("batch_no"))


def batch_no(ts: Column) -> Column:
    return F.date_format(ts, "yyyyMMddHHmmss")


def overall_confidence(rows: DataFrame, key: str = "name") -> DataFrame:
    """Mean of all confidences over 0, to two places, halves to even; 0 if there is none.

    Confidences count to six places and as integers, so that neither the order of rows nor binary fractions move a half.
    """
    c = F.when(F.col("confidence") > 0, F.round(F.col("confidence") * 1_000_000).cast("long"))
    return rows.groupBy(key).agg((F.bround(F.coalesce(F.try_divide(F.sum(c), F.count(c) * 10_000), F.lit(0.0)), 0) / 100).alias("confidence"))


def token_estimate(docs: DataFrame, stage: Column, text: Column) -> DataFrame:
    """(stage, tokens) at two characters a token, one at least, and the total with a null stage."""
    n = F.greatest(F.lit(1), F.floor(F.length(text) / 2).cast("long"))
    return docs.select(stage.alias("stage"), n.alias("n")).rollup("stage").agg(F.sum("n").alias("tokens"), F.count("*").alias("n_rows"))


def run_summary(results: DataFrame, status: Column, done: str, tokens: Column | None = None) -> DataFrame:
    """One row: companies, completed and failed ones, their share, and the tokens used, if there are any counts."""
    ok = F.count_if(status == done)
    return results.agg(F.count("*").alias("total"), ok.alias("completed"), (F.count("*") - ok).alias("failed"), F.bround(ok / F.count("*"), 4).alias("share"), *([F.coalesce(F.sum(tokens), F.lit(0)).cast("long").alias("total_tokens")] if tokens is not None else []))


def log_summary(log: DataFrame, key: str, level: Column, message: str, seq: str) -> DataFrame:
    """For each key, error before warning, its first three messages."""
    rows = log.withColumn("level", level).where("level IS NOT NULL")
    first = F.row_number().over(Window.partitionBy(key, "level").orderBy(seq))
    top = rows.withColumn("n", first).where("n <= 3").groupBy(key).agg(
        F.max((F.col("level") == "error").cast("int")).alias("e"), F.sort_array(F.collect_list(F.struct("level", "n", F.col(message).alias("m")))).alias("x")
    )
    lead = F.when(F.col("e") == 1, "error").otherwise("warning")
    return top.select(key, lead.alias("level"), F.array_join(F.transform(F.filter("x", lambda r: r["level"] == lead), lambda r: r["m"]), "; ").alias("messages"))


def latest(rows: DataFrame, keys: list[str], order: Column | None) -> DataFrame:
    """One row of each key: the one of the greatest order, or the greatest of all columns."""
    row = F.struct(*rows.columns)
    return rows.groupBy(*keys).agg(F.max_by(row, F.struct(order, row) if order is not None else row).alias("row")).select("row.*")


def upsert(target: DataFrame, updates: DataFrame, keys: list[str], keep: list[str] = (), order: Column | None = None) -> DataFrame:
    """Updates replace rows of equal keys, except the columns to keep; others are added. Of repeated updates the latest by ``order`` counts."""
    t, u = target.alias("t"), latest(updates, keys, order).alias("u")
    on = [F.col(f"t.{k}").eqNullSafe(F.col(f"u.{k}")) for k in keys]
    has = F.col("u._new").isNotNull()
    j = t.withColumn("_old", F.lit(True)).alias("t").join(u.withColumn("_new", F.lit(True)).alias("u").hint("merge"), on, "full")
    cols = [F.when(F.col("t._old").isNotNull() & (F.lit(c in keep) | ~has), F.col(f"t.{c}")).otherwise(F.col(f"u.{c}")).alias(c) for c in target.columns]
    return j.select(*cols)


def append_unique(target: DataFrame, new: DataFrame, keys: list[str], order: Column | None = None) -> DataFrame:
    """New rows whose key isn't there yet, the latest of each key."""
    return target.unionByName(latest(new, keys, order).join(target.select(*keys).hint("merge"), keys, "left_anti"))


def ttl_lookup(requests: DataFrame, cache: DataFrame, now: Column, seconds: int) -> DataFrame:
    """hit, expired or miss for each requested url by the md5 of the url and the latest fetch."""
    latest = cache.groupBy(F.md5(F.col("url").cast("binary")).alias("h")).agg(F.max("fetched_at").alias("fetched_at"))
    j = requests.withColumn("h", F.md5(F.col("url").cast("binary"))).join(latest.hint("merge"), "h", "left")
    age = F.unix_timestamp(now) - F.unix_timestamp("fetched_at")
    return j.select("url", F.when(F.col("fetched_at").isNull(), "miss").when(age > seconds, "expired").otherwise("hit").alias("state"))


def ttl_clean(cache: DataFrame, now: Column, seconds: int) -> DataFrame:
    """The cache without expired rows: those fetched more than the time to live ago, and those without a time."""
    return cache.where(F.unix_timestamp(now) - F.unix_timestamp("fetched_at") <= seconds)


def ttl_stats(states: DataFrame) -> DataFrame:
    n = lambda s: F.count_if(F.col("state") == s)
    return states.agg(n("hit").alias("hits"), n("miss").alias("misses"), n("expired").alias("expired"), F.bround(n("hit") / F.greatest(F.lit(1), n("hit") + n("miss")), 2).alias("hit_rate"))


def decode(df: DataFrame, json: dict[str, str], times: dict[str, str]) -> DataFrame:
    """JSON columns as their types (null if they can't be read), and timestamps as text under a new name."""
    out = df.withColumns({c: F.from_json(c, kind) for c, kind in json.items()})
    return out.withColumns({new: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c, new in times.items()})


def tag_row(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Columns of the tag table: arrays and structs as JSON, '' as null."""
    kinds = dict(df.dtypes)

    def stored(c: str) -> Column:
        if kinds[c].startswith(("array", "struct", "map")):
            return F.to_json(c)
        return F.nullif(F.col(c), F.lit("")) if kinds[c] == "string" else F.col(c)

    return df.select(*[stored(c).alias(name) for name, c in columns.items()])
