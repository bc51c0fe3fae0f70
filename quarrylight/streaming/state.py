"""A table of keyed rows in hash buckets with a manifest: a batch rewrites only the buckets that hold its keys.

A bucket holds the rows whose key's hash begins with its bits. One that a batch would fill beyond ``rows`` is written as
buckets of more bits, so what a batch of one row writes doesn't grow with the table. A manifest names the batch that wrote each
bucket; it is written last, and what it names is the table. A batch that is run again after that changes nothing. Files that
neither the last manifest nor the one before it names are deleted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrylight.operators.serving import latest
from quarrylight.sources.io import delete, listed, saved

ROWS = 100_000
_MANIFEST = "bits int, prefix long, batch long, rows long"


class BucketTable:
    """keys: of a row; order: which of a key's rows of one batch counts (the greatest; else that of the greatest columns)."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, keys: list[str], order: Column | None = None, rows: int = ROWS) -> None:
        self.spark, self.path, self.schema, self.keys, self.order, self.rows = spark, path, schema, keys, order, rows

    def batches(self) -> list[int]:
        """The batches whose manifest is complete, in order."""
        names = [n for n in listed(self.spark, f"{self.path}/manifest") if n.startswith("batch=")]
        return sorted(int(n[6:]) for n in names if "_SUCCESS" in listed(self.spark, f"{self.path}/manifest/{n}"))

    def manifest(self, batch: int) -> DataFrame:
        return self.spark.read.schema(_MANIFEST).parquet(f"{self.path}/manifest/batch={batch}")

    def _files(self, buckets: list) -> DataFrame:
        paths = [f"{self.path}/data/batch={b['batch']}/bucket={b['bits']}-{b['prefix']}" for b in buckets]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def read(self) -> DataFrame:
        """The table as the last batch left it; empty before the first one."""
        done = self.batches()
        return self._files(self.manifest(done[-1]).collect() if done else [])

    def _hashed(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("_hash", F.xxhash64(*self.keys))

    def _placed(self, rows: DataFrame, buckets: DataFrame, bits: list[int]) -> DataFrame:
        """Rows with the columns of the bucket that their hash's first bits name."""
        prefix = lambda n: F.shiftrightunsigned("_hash", 64 - n) if n else F.lit(0).cast("long")
        at = F.explode(F.array(*[F.struct(F.lit(n).alias("bits"), prefix(n).alias("prefix")) for n in bits])).alias("_at")
        return rows.select("*", at).select(*rows.columns, "_at.*").join(buckets.hint("merge"), ["bits", "prefix"])

    def merge(self, batch: DataFrame, number: int) -> None:
        """Puts the batch's rows in place of those of equal keys, or adds them."""
        done = self.batches()
        if number in done:
            return
        all_ = self.manifest(done[-1]).collect() if done else []
        held = {(b["bits"], b["prefix"]): b for b in all_} or {(0, 0): None}
        known = self.spark.createDataFrame(list(held), "bits int, prefix long")
        new = saved(self._placed(self._hashed(latest(batch.select(*self.schema.names), self.keys, self.order)), known, sorted({n for n, _ in held})))
        count = {(r["bits"], r["prefix"]): r["count"] for r in new.groupBy("bits", "prefix").count().collect()}  # one row a bucket
        targets = []
        for (bits, prefix), n in count.items():
            most, more = n + (held[bits, prefix]["rows"] if held[bits, prefix] else 0), 0
            while most > self.rows << more:
                more += 1
            targets += [(bits, prefix, bits + more)]
        old = self._hashed(self._files([held[k] for k in count if held[k]])).select("*", F.lit(0).alias("_new"))
        own = self.spark.createDataFrame(targets, "bits int, prefix long, to int")
        both = self._placed(old.unionByName(new.select(*self.schema.names, "_hash", F.lit(1).alias("_new"))), own, sorted({t[0] for t in targets}) or [0])
        to = F.when(F.col("to") == 0, F.lit(0).cast("long")).otherwise(F.expr("shiftrightunsigned(_hash, 64 - to)"))
        bucket = F.concat_ws("-", F.col("to").cast("string"), to.cast("string"))
        dealt = both.withColumn("bucket", bucket).repartition("bucket")
        row = F.struct(*[F.col(f"`{c}`") for c in self.schema.names])
        merged = dealt.groupBy("bucket", *self.keys).agg(F.max_by(row, "_new").alias("_row")).select("_row.*", "bucket")
        data = f"{self.path}/data/batch={number}"
        merged.write.mode("overwrite").partitionBy("bucket").parquet(data)
        kept = [tuple(b[c] for c in ("bits", "prefix", "batch", "rows")) for k, b in held.items() if b and k not in count]
        if count:
            found = self.spark.read.parquet(data).groupBy("bucket").count().collect()
            kept += [(*map(int, r["bucket"].split("-")), number, r["count"]) for r in found]
        self.spark.createDataFrame(kept, _MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/batch={number}")
        self._vacuum([*done, number], all_, kept)

    def _vacuum(self, done: list[int], before: list, now: list) -> None:
        named = {(b["batch"], f"bucket={b['bits']}-{b['prefix']}") for b in before} | {(n, f"bucket={bits}-{prefix}") for bits, prefix, n, _ in now}
        gone = []
        for name in listed(self.spark, f"{self.path}/data"):
            parts = listed(self.spark, f"{self.path}/data/{name}")
            unnamed = [p for p in parts if p.startswith("bucket=") and (int(name[6:]), p) not in named]
            gone += [f"{self.path}/data/{name}"] if len(unnamed) == sum(p.startswith("bucket=") for p in parts) else [f"{self.path}/data/{name}/{p}" for p in unnamed]
        delete(self.spark, *gone, *[f"{self.path}/manifest/batch={n}" for n in done[:-2]])
