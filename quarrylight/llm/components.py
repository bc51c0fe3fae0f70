"""Saved tables, and connected components by alternating stars, as joins and aggregates over an edge table."""

from __future__ import annotations

import posixpath
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares for checkpoints; where none is set, a local session gets one of its own."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and sc.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return sc._jsc.sc().getCheckpointDir().get()


def save(df: DataFrame) -> DataFrame:
    """Cut the lineage: write a table to the shared folder, once, and read it back."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*saved: DataFrame) -> None:
    """Delete saved tables that nothing reads any more."""
    for df in saved:
        sc = df.sparkSession.sparkContext
        for folder in {posixpath.dirname(f) for f in df.inputFiles()}:
            path = sc._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of an edge; component is the smallest node reachable.

    Nulls, loops and repeated edges are allowed and ignored. Each round moves every node to the smallest neighbour of
    its neighbours (large star, then small star). No neighbour list is ever gathered: the minimum of a node is a partial
    aggregate, and a hub's edges meet it in a join that Spark can split. A round's tables go when the next one is saved.
    """
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u IS NOT NULL AND v IS NOT NULL AND u <> v")
    e = save(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    mark = None
    while (now := e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()) != mark:
        mark, before = now, e
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # large star: the larger neighbours of a node move to the least of its neighbourhood
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("v"), F.least("u", "m").alias("m"))
        large = save(e.join(least.hint("merge"), "v").select("u", F.col("m").alias("v")).where("u <> v").distinct())
        # small star: a node and its smaller neighbours move to the least of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        e = save(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        discard(before, large)
    heads = e.select(F.col("v").alias("node")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(heads.select("node", F.col("node").alias("component")))
