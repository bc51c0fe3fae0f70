"""Streams over several runs: what a batch writes, runs without input, batches that are run again, late rows, times to live."""

import datetime
import os

import pytest
from pyspark.sql import functions as F

from quarrylight.operators import serving
from quarrylight.streaming import jobs
from quarrylight.streaming.state import BucketTable

PAGE = "page_id long, url string, html string"
ROW = "k long, v string"


def page(i, t):
    return (i, "https://a.org/x", f"<title>{t}</title><p>text {t} a@b.org</p>")


def run_pages(spark, path, rows):
    if rows:
        spark.createDataFrame(rows, PAGE).coalesce(1).write.mode("append").parquet(f"{path}/in")
    source = spark.readStream.schema(PAGE).parquet(f"{path}/in")
    profiles = jobs.profile_pages(source, ["z.org"])
    table = BucketTable(spark, f"{path}/t", profiles.schema, ["page_id"], rows=2)
    jobs.ingest(profiles, f"{path}/cp", table.merge).awaitTermination(120)
    return [(r["page_id"], r["title"], r["contact"]) for r in table.read().orderBy("page_id").collect()]


def test_stream_of_pages_is_merged_batch_by_batch(spark, tmp_path):
    path = str(tmp_path)
    assert run_pages(spark, path, [page(1, "one"), page(2, "two"), (3, "ftp://no", "<p>x</p>"), (4, "https://a.org", None)]) == [(1, "one", "a@b.org"), (2, "two", "a@b.org")]
    want = [(1, "one", "a@b.org"), (2, "new", "a@b.org"), (5, "five", "a@b.org"), (None, "none", "a@b.org")]
    assert sorted(run_pages(spark, path, [page(2, "new"), page(5, "five"), page(None, "none")]), key=str) == want
    assert sorted(run_pages(spark, path, []), key=str) == want  # a run without new files


def test_empty_table_and_batches(spark, tmp_path):
    table = BucketTable(spark, str(tmp_path / "t"), spark.createDataFrame([], ROW).schema, ["k"])
    assert table.read().collect() == []
    table.merge(spark.createDataFrame([], ROW), 0)
    assert table.read().collect() == []
    table.merge(spark.createDataFrame([(1, "a"), (1, "b"), (2, None)], ROW), 1)
    table.merge(spark.createDataFrame([], ROW), 2)
    assert sorted(map(tuple, table.read().collect())) == [(1, "b"), (2, None)]


def written(path):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet"))


def test_a_batch_writes_as_much_however_large_the_table_is(spark, tmp_path):
    table = BucketTable(spark, str(tmp_path / "t"), spark.createDataFrame([], ROW).schema, ["k"], rows=500)
    rows = lambda a, b, v: spark.range(a, b).select(F.col("id").alias("k"), F.concat(F.lit(v), F.col("id").cast("string")).alias("v"))
    sizes = []
    for n, (a, b) in enumerate([(0, 2_000), (2_000, 20_000)]):
        table.merge(rows(a, b, "x"), 2 * n)
        table.merge(rows(7, 8, f"new{n}-"), 2 * n + 1)
        sizes.append(written(tmp_path / "t" / "data" / f"batch={2 * n + 1}"))
    got = table.read()
    assert got.count() == 20_000 and got.where("k = 7").first()["v"] == "new1-7" and got.where("k <> 7").where("v <> concat('x', k)").isEmpty()
    assert sizes[1] < 2 * sizes[0] and sizes[1] < written(tmp_path / "t" / "data") / 10
    last = table.manifest(3).agg(F.max("rows"), F.sum("rows"), F.count("*")).first()
    assert last[0] <= 500 and last[1] == 20_000 and last[2] >= 40
    before = sorted(map(tuple, got.collect()))
    table.merge(rows(0, 20_000, "again"), 3)  # a batch that is there already
    assert sorted(map(tuple, table.read().collect())) == before
    named = {(r["batch"], f"bucket={r['bits']}-{r['prefix']}") for n in (2, 3) for r in table.manifest(n).collect()}
    there = {(int(b[6:]), p) for b in os.listdir(tmp_path / "t" / "data") for p in os.listdir(tmp_path / "t" / "data" / b) if p.startswith("bucket=")}
    assert there == named and sorted(os.listdir(tmp_path / "t" / "manifest")) == ["batch=2", "batch=3"]


def minutes(*rows):
    return [(u, datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=m)) for u, m in rows]


@pytest.mark.parametrize(("parts", "want"), [
    ([[("a", 0)], [("a", 30)], [("a", 90)]], [("a", 0, "miss"), ("a", 30, "hit"), ("a", 90, "expired")]),
    ([[("a", 0), ("a", 30), ("a", 60), ("a", 61), ("b", 5), (None, 5)], [("b", 64), ("b", 66), ("c", 70)]], [("a", 0, "miss"), ("a", 30, "hit"), ("a", 60, "hit"), ("a", 61, "expired"), ("b", 5, "miss"), ("b", 64, "hit"), ("b", 66, "expired"), ("c", 70, "miss")]),
])
def test_time_to_live(spark, tmp_path, parts, want):
    for rows in parts:
        spark.createDataFrame(minutes(*rows), "url string, fetched_at timestamp").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        source = spark.readStream.schema("url string, fetched_at timestamp").parquet(str(tmp_path / "in"))
        jobs.fetches_in_time(source, 3600).writeStream.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(str(tmp_path / "out"), "parquet", "append").awaitTermination(120)
    got = [(r["url"], (r["fetched_at"] - datetime.datetime(2024, 1, 1)).seconds // 60, r["state"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    assert sorted(got) == want
    # the batch form says the same of each fetch by what was kept before it
    kept = minutes(*[(u, m) for u, m, s in want if s != "hit"])
    for u, m, s in want:
        (at,) = minutes((u, m))
        cache = spark.createDataFrame([k for k in kept if k[1] < at[1]], "url string, fetched_at timestamp")
        state = serving.ttl_lookup(spark.createDataFrame([(u,)], "url string"), cache, F.lit(at[1]), 3600).first()["state"]
        assert state == s


def test_expired_state_is_dropped(spark, tmp_path):
    for rows in ([[("a", 0)], [("b", 200)], [("b", 201)], [("a", 400)]]):
        spark.createDataFrame(minutes(*rows), "url string, fetched_at timestamp").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        source = spark.readStream.schema("url string, fetched_at timestamp").parquet(str(tmp_path / "in"))
        q = jobs.fetches_in_time(source, 3600).writeStream.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(str(tmp_path / "out"), "parquet", "append")
        q.awaitTermination(120)
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress) <= 2
    assert [r["state"] for r in spark.read.parquet(str(tmp_path / "out")).where("url = 'a'").collect()] == ["miss", "miss"]  # a's state had gone


def test_closed_hours_and_late_rows(spark, tmp_path):
    parts = [[(10, 1.0), (70, 3.0)], [(20, 5.0), (80, 5.0), (130, 20000.0), (None, 1.0)], [(30, 9.0), (140, 2.0)], [], [(60 * 30, 7.0)], [(60 * 30 + 1, 8.0), (135, 1.0)]]
    base, hours = datetime.datetime(2024, 1, 1), jobs.ClosedHours(spark, str(tmp_path / "h"), seconds=600)
    frame = lambda rows: spark.createDataFrame([(None if m is None else base + datetime.timedelta(minutes=m), x) for m, x in rows], "ts timestamp, ms double")
    for n, rows in enumerate(parts):
        hours.merge(frame(rows), n)
        if n == 1:
            hours.merge(frame(rows), n)  # run again after a failure
    got = sorted((r["hour"].hour, r["n"], r["avg_ms"]) for r in hours.closed().collect())
    # 0:20 comes when the mark is 1:00, so its hour has ended; 2:15 comes a day late
    assert got == [(0, 1, 1.0), (1, 2, 4.0), (2, 2, 7501.0)]
    assert sorted((r["hour"].hour, r["n"]) for r in hours.late().collect()) == [(0, 2), (2, 1)]


def test_urls_of_a_bucket_share_a_state(spark, tmp_path):
    """1,000 urls are one row of state in each of four buckets; each of them has its own time to live."""
    urls = [f"u{i}" for i in range(1_000)]
    for rows in ([(u, 0) for u in urls], [(u, 30 if i % 2 else 90) for i, u in enumerate(urls)]):
        spark.createDataFrame(minutes(*rows), "url string, fetched_at timestamp").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        source = spark.readStream.schema("url string, fetched_at timestamp").parquet(str(tmp_path / "in"))
        q = jobs.fetches_in_time(source, 3600, buckets=4).writeStream.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(str(tmp_path / "out"), "parquet", "append")
        q.awaitTermination(120)
        assert max(p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress) <= 4
    got = {r["state"]: r["count"] for r in spark.read.parquet(str(tmp_path / "out")).groupBy("state").count().collect()}
    assert got == {"miss": 1_000, "hit": 500, "expired": 500}
