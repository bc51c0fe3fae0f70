"""Structured Streaming forms of the incremental operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quarrylight.operators import text, web
from quarrylight.sources.io import delete, dropped, fetched, listed, saved

BUCKETS = 256  # of urls whose times are kept in one state


def probe_stats_hourly(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """(hour, n, avg_ms) from (ts, ms) by tumbling hour; rows later than the watermark are left out."""
    ms = F.least("ms", F.lit(15000.0))
    agg = events.withWatermark("ts", late).groupBy(F.window("ts", "1 hour").alias("w")).agg(F.count("*").alias("n"), F.avg(ms).alias("avg_ms"))
    return agg.select(F.col("w.start").alias("hour"), "n", "avg_ms")


class ClosedHours:
    """Tumbling hours of (ts, ms) in append mode with what came too late beside them.

    A batch's watermark is the latest time of the batches before it less the delay. Rows of an hour that ended by then are late
    and only counted, by hour; the others join the sums of the open hours. Hours that end by the next watermark are
    closed: appended, once. The open hours' sums, one row each, are written anew each batch beside their predecessor, and every
    batch writes its own folders, so one that is run again gives the same.
    """

    OPEN, CLOSED, LATE = "hour timestamp, n long, sum_ms double, latest timestamp", "hour timestamp, n long, avg_ms double", "hour timestamp, n long"

    def __init__(self, spark: SparkSession, path: str, seconds: int = 3600) -> None:
        self.spark, self.path, self.seconds = spark, path, seconds

    def _opened(self, before: int) -> DataFrame:
        done = [n for n in self._numbers("open") if n < before]
        return self.spark.read.schema(self.OPEN).parquet(f"{self.path}/open/batch={done[-1]}") if done else self.spark.createDataFrame([], self.OPEN)

    def _numbers(self, kind: str) -> list[int]:
        names = [n for n in listed(self.spark, f"{self.path}/{kind}") if n.startswith("batch=")]
        return sorted(int(n[6:]) for n in names if "_SUCCESS" in listed(self.spark, f"{self.path}/{kind}/{n}"))

    def merge(self, batch: DataFrame, number: int) -> None:
        opened = self._opened(number)
        latest = opened.agg(F.max("latest")).first()[0]
        hours = batch.where("ts IS NOT NULL").groupBy(F.date_trunc("hour", "ts").alias("hour")).agg(F.count("*").alias("n"), F.sum(F.least("ms", F.lit(15000.0))).alias("sum_ms"), F.max("ts").alias("latest"))
        ended = lambda mark: F.unix_timestamp("hour") + 3600 <= F.unix_timestamp(F.lit(mark)) - self.seconds if mark else F.lit(False)
        hours = saved(hours.withColumn("late", ended(latest)))
        hours.where("late").select("hour", "n").write.mode("overwrite").parquet(f"{self.path}/late/batch={number}")
        now = max(filter(None, [latest, hours.agg(F.max("latest")).first()[0]]), default=None)
        sums = opened.unionByName(hours.where("NOT late").drop("late")).groupBy("hour").agg(F.sum("n").alias("n"), F.sum("sum_ms").alias("sum_ms"), F.max("latest").alias("latest")).where("hour IS NOT NULL")
        sums = saved(sums.withColumn("closed", ended(now)))
        sums.where("closed").select("hour", "n", (F.col("sum_ms") / F.col("n")).alias("avg_ms")).write.mode("overwrite").parquet(f"{self.path}/closed/batch={number}")
        mark = self.spark.createDataFrame([(None, 0, 0.0, now)], self.OPEN)  # keeps the watermark where no hour is open
        sums.where("NOT closed").drop("closed").unionByName(mark).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/open/batch={number}")
        dropped(hours, sums)
        delete(self.spark, *[f"{self.path}/open/batch={n}" for n in self._numbers("open") if n < number - 1])

    def _all(self, kind: str, schema: str) -> DataFrame:
        paths = [f"{self.path}/{kind}/batch={n}" for n in self._numbers(kind)]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def closed(self) -> DataFrame:
        """(hour, n, avg_ms) of the closed hours."""
        return self._all("closed", self.CLOSED)

    def late(self) -> DataFrame:
        """(hour, n): how many rows came after their hour was closed."""
        return self._all("late", self.LATE).groupBy("hour").agg(F.sum("n").alias("n"))


def fetches_in_time(pages: DataFrame, seconds: int, delay: str = "0 seconds", buckets: int = BUCKETS) -> DataFrame:
    """(url, fetched_at, state) of each fetch of a stream of (url, fetched_at): miss, hit or expired.

    A url's state is the time of its last kept fetch. A fetch up to the time to live after it is a hit and changes nothing; a later
    one finds it expired and is kept, as is the first, a miss. Fetches of one batch count in order of time, one from
    before the kept fetch as a hit. The state goes when the watermark has passed its time to live, so a url that returns after that is a miss again
    (it needs fetching just the same). The urls of a hash bucket share a state and a call of Python, whose cost a url of few fetches can't bear;
    a stream keeps its number of buckets.
    """
    kept = "url string, fetched_at timestamp, state string"

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        mark = state.getCurrentWatermarkMs()
        held = dict(zip(*state.get)) if state.exists else {}
        rows = None if state.hasTimedOut else pd.concat(list(frames), ignore_index=True).sort_values(["url", "fetched_at"], kind="stable", ignore_index=True)
        seen, names = set(), []
        if rows is not None:
            times = rows["fetched_at"].to_numpy("datetime64[us]").astype(np.int64).tolist()
            for u, t in zip(rows["url"], times):
                last = held.get(u)
                fresh = last is not None and t - last <= seconds * 1_000_000
                names.append("hit" if fresh else "miss" if last is None else "expired")
                if not fresh:
                    held[u] = t
                seen.add(u)
        ends = {u: t // 1000 + seconds * 1000 + 1 for u, t in held.items()}
        held = {u: t for u, t in held.items() if u in seen or ends[u] >= mark}
        if held:
            state.update((list(held), list(held.values())))
            state.setTimeoutTimestamp(max(min(ends[u] for u in held), mark + 1))
        elif state.exists:
            state.remove()
        if rows is not None:
            yield pd.DataFrame({"url": rows["url"], "fetched_at": rows["fetched_at"], "state": names})

    rows = pages.select("url", "fetched_at").where("url IS NOT NULL AND fetched_at IS NOT NULL").withWatermark("fetched_at", delay)
    bucket = F.pmod(F.xxhash64("url"), F.lit(buckets))
    return rows.withColumn("bucket", bucket).groupBy("bucket").applyInPandasWithState(run, kept, "urls array<string>, lasts array<long>", "append", GroupStateTimeout.EventTimeTimeout)


def profile_pages(pages: DataFrame, blacklist: list[str], email: str = r"([A-Za-z0-9._]+@[A-Za-z0-9.-]+)") -> DataFrame:
    """(page_id, url, domain, title, text, contact) of fetched pages with a valid url: what is done to a page on its way in."""
    good = fetched(pages).where(~web.is_blacklisted(F.col("url"), blacklist))
    body = text.scrub(web.html_text(F.col("html")))
    return good.select("page_id", "url", web.domain(F.col("url")).alias("domain"), web.page_title(F.col("html")).alias("title"), body.alias("text")).withColumn("contact", F.regexp_extract("text", email, 1))


def ingest(source: DataFrame, checkpoint: str, merge: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Runs what is new through ``merge``, batch by batch with its number, and stops."""
    return source.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(merge).start()
