"""Sources and sinks with explicit schemas. Each reader is a format and a DataFrame operator, which queries use on tables."""

from __future__ import annotations

import posixpath
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

CATEGORIES = ("official_website", "business_info", "bidding_info", "patent_info")
CRAWL = T.StructType([
    T.StructField("enterprise_name", T.StringType()), T.StructField("source_urls", T.ArrayType(T.StringType())),
    T.StructField("raw_content", T.StructType([T.StructField(c, T.StringType()) for c in (*CATEGORIES, "all_content")])),
    T.StructField("crawl_status", T.StringType()), T.StructField("confidence", T.DoubleType()), T.StructField("content_relevance", T.DoubleType()),
    T.StructField("crawl_time", T.StringType()), T.StructField("note", T.StringType()),
])


def crawl_text(records: DataFrame) -> DataFrame:
    """Crawl records with a text: all_content, else the other categories by line; records without any are left out."""
    blank = lambda c: F.nullif(F.trim(F.col(f"raw_content.{c}")), F.lit(""))
    text = F.coalesce(blank("all_content"), F.concat_ws("\n", *[blank(c) for c in CATEGORIES]))
    return records.withColumn("text", text).where("text <> ''")


def read_crawl(spark: SparkSession, path: str) -> DataFrame:
    return crawl_text(spark.read.schema(CRAWL).json(path, multiLine=True))


def names(lines: DataFrame, col: str, commas: bool = False) -> DataFrame:
    """Names by line, or by comma within one, trimmed, without blank ones and comments."""
    parts = F.explode(F.split(col, "[,，]")) if commas else F.col(col)
    return lines.select(parts.alias("name")).select(F.trim("name").alias("name")).where("name <> '' AND NOT startswith(name, '#')")


def read_names(spark: SparkSession, path_or_names: str) -> DataFrame:
    """Names of a text file, or of a comma-separated list."""
    if re.search("[,，]", path_or_names):
        return names(spark.range(1).select(F.lit(path_or_names).alias("value")), "value", commas=True)
    return names(spark.read.text(path_or_names), "value")


def checked_name(name: str) -> str:
    if not re.fullmatch(r"[\w一-龥]+", name):
        raise ValueError(f"no table name: {name!r}")
    return name


def names_from_table(df: DataFrame, col: str, where: str | None = None, limit: int | None = None) -> DataFrame:
    """The distinct values of a column, as text, but null and empty ones; with a predicate and a limit, if given."""
    rows = df.where(where) if where else df
    found = rows.select(F.col(checked_name(col)).cast("string").alias("name")).where("name <> ''").distinct()
    return found.orderBy("name").limit(limit) if limit else found


def fetched(pages: DataFrame, success: str | None = None) -> DataFrame:
    """Pages that were fetched: with a text, and marked as successful if there is such a column."""
    good = pages.where("html IS NOT NULL AND html <> ''")
    return good.where(F.col(success)) if success else good


def read_pages(spark: SparkSession, path: str, success: str | None = None) -> DataFrame:
    return fetched(spark.read.parquet(path), success)


# Words that name the columns of seed tables.
HEADERS = {"name": "名称|网站|平台|name|site", "url": "网址|链接|域名|url|link", "description": "说明|描述|简介|备注|description|note"}


def seed_rows(lines: DataFrame, doc: str = "doc", seq: str = "seq", line: str = "line") -> DataFrame:
    """(category, name, url, description) from (doc, seq, line) of documents with ``## heading`` lines and pipe tables.

    A row's category is the last heading before it, its columns are those of the last header row; without one they are the
    first three. Separator rows and rows without an http url go; ``[text](url)`` gives its text as name and its url.
    """
    before = Window.partitionBy(doc).orderBy(seq).rowsBetween(Window.unboundedPreceding, 0)
    last = lambda c: F.last(c, ignorenulls=True).over(before)
    text = F.trim(F.col(line))
    heading = F.nullif(F.trim(F.regexp_extract(line, r"^##+\s*(.*)$", 1)), F.lit(""))
    cells = F.transform(F.split(F.regexp_replace(text, r"^\||\|$", ""), r"\|", -1), lambda x: F.trim(x))
    rows = lines.select(doc, seq, heading.alias("heading"), F.when(text.startswith("|"), cells).alias("cells"))
    is_url = F.exists("cells", lambda x: x.rlike(r"https?://"))
    named = lambda p: F.array_position(F.transform("cells", lambda x: x.rlike(f"(?i){p}")), True)
    place = {k: named(p) for k, p in HEADERS.items()}
    is_head = F.col("cells").isNotNull() & ~is_url & (place["name"] + place["url"] > 0)
    rows = rows.select("*", last(F.col("heading")).alias("category"), last(F.when(is_head, F.struct(*[place[k].alias(k) for k in HEADERS]))).alias("at"))
    rows = rows.where(F.col("cells").isNotNull() & F.exists("cells", lambda x: ~x.rlike(r"^:?-*:?$")))
    cell = lambda k, n: F.coalesce(F.get("cells", F.coalesce(F.nullif(F.col(f"at.{k}"), F.lit(0)), F.when(F.col("at").isNull(), F.lit(n))) - 1), F.lit(""))
    link = lambda c, i: F.regexp_extract(c, r"^\[(.*?)\]\((.*?)\)", i)
    bare = lambda c, i: F.when(link(c, i) != "", link(c, i)).otherwise(c)
    in_name = link(cell("name", 1), 2)
    url = F.when(bare(cell("url", 2), 2).startswith("http"), bare(cell("url", 2), 2)).otherwise(in_name)
    return rows.select("category", bare(cell("name", 1), 1).alias("name"), url.alias("url"), cell("description", 3).alias("description")).where(F.col("url").rlike(r"^https?://"))


def scratch(spark: SparkSession) -> str:
    """A new path in the folder that the cluster shares; a local session without one gets a folder of its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="spark-")
    return f"{folder.rstrip('/')}/{uuid.uuid4().hex}"


def saved(df: DataFrame) -> DataFrame:
    """Writes a table to the shared folder and reads it back, so that what follows doesn't do the work again."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, *paths: str) -> None:
    """Deletes files or folders that nothing reads any more."""
    for p in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def dropped(*tables: DataFrame) -> None:
    """Deletes saved tables."""
    for df in tables:
        delete(df.sparkSession, *{posixpath.dirname(f) for f in df.inputFiles()})


def listed(spark: SparkSession, path: str) -> list[str]:
    """The names in a folder; none if it isn't there."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(x.getPath().getName() for x in fs.listStatus(at)) if fs.exists(at) else []


def save_as(df: DataFrame, name: str, mode: str = "overwrite") -> DataFrame:
    """Writes a table under a name that is checked, and reads it."""
    df.write.mode(mode).saveAsTable(checked_name(name))
    return df.sparkSession.table(name)


def write_stage(df: DataFrame, stage: str, batch_no: str, path: str) -> None:
    """Adds a stage's rows to the archive, which is partitioned by stage and batch."""
    df.withColumns({"stage": F.lit(stage), "batch_no": F.lit(batch_no)}).write.mode("append").partitionBy("stage", "batch_no").parquet(path)


def read_stage(spark: SparkSession, path: str, stage: str, batch_no: str | None = None) -> DataFrame:
    """The rows of a stage, of one batch or of all; only its partitions are read."""
    own = spark.read.option("recursiveFileLookup", "false").parquet(path).where(F.col("stage") == stage)
    return (own.where(F.col("batch_no").cast("string") == batch_no) if batch_no else own).drop("stage")


def write_upsert(spark: SparkSession, merged: DataFrame, path: str) -> None:
    """Writes a merged table batch by batch: only partitions that it holds are replaced."""
    merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_no").parquet(path)
