"""Exact top-k by integer inner product: branch and bound over dimension blocks in vertical layout.

A batch of candidates is kept dimension by dimension. For a query, products are added up block by block; what the rest of
the dimensions can still add is at most the product of the remaining norms (Cauchy-Schwarz), so candidates whose upper bound
lies under the k-th best lower bound, or under the k-th best score met so far, are dropped and the survivors compacted. The
last block leaves exact scores.

Queries are the stated set of rows. They are worked in blocks of about QUERY_BLOCK, with one pass over all rows for each: a block
is fetched and broadcast, its k best are saved, and it is let go before the next one is fetched.

Defined results: vectors that are null or hold a null or non-finite component take no part; missing components of the
shorter of two vectors count as 0; rows that repeat an id are candidates of their own, but one query (the least vector);
rows with a query's id are never its results; ties go to the smaller id; null ids take no part. Only the id and vector
columns are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylight.llm.components import save
from quarrylight.llm.frames import released

DIMENSIONS = 8
QUERY_BLOCK = 2048
_SLACK = 1e-6


def _matrix(col: pa.Array, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows that take part, and their components floor(scale * x), padded with zeros."""
    col = col.cast(pa.list_(pa.float64()))
    size = np.array([0 if n is None else n for n in pa.compute.list_value_length(col).to_pylist()], np.int64)
    flat = col.flatten()
    values = flat.fill_null(float("nan")).to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(col)), size)
    bad = np.bincount(row[~np.isfinite(values)], minlength=len(col)) > 0
    keep = np.flatnonzero(~bad & np.asarray(col.is_valid()))
    out = np.zeros((len(col), int(size.max(initial=0))))
    out[row, np.arange(len(values)) - np.repeat(np.cumsum(size) - size, size)] = np.floor(values * scale)
    return keep, out[keep]


def _rest(columns: np.ndarray) -> np.ndarray:
    """Norms of the dimensions from each block on, by block; columns: dimensions x rows."""
    cuts = range(0, len(columns) + DIMENSIONS, DIMENSIONS)
    return np.sqrt(np.array([np.square(columns[c:]).sum(0) for c in cuts]))


def search(query: np.ndarray, query_rest: np.ndarray, columns: np.ndarray, rest: np.ndarray, allowed: np.ndarray, k: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    """(survivors, scores): all allowed columns that can be among the k best and reach ``least``."""
    live, score = allowed, np.zeros(len(allowed))
    for b, d in enumerate(range(0, len(columns), DIMENSIONS)):
        score = score + query[d : d + DIMENSIONS] @ columns[d : d + DIMENSIONS, live]
        more = query_rest[b + 1] * rest[b + 1, live]
        bound = max(least, np.partition(score - more, -k)[-k] if len(live) > k else -math.inf)
        keep = score + more >= bound - _SLACK * (1 + abs(bound))
        if not keep.all():
            live, score = live[keep], score[keep]
    return live, score


def _exact(query: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """Scores of values too large for floats, as whole numbers within a long."""
    q = [int(x) for x in query]
    return np.array([max(-(1 << 63), min((1 << 63) - 1, sum(a * int(x) for a, x in zip(q, c, strict=True)))) for c in columns.T], object)


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, scale: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding", query_block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows of highest score for every query row."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"), is_query.alias("q")).where("id IS NOT NULL AND v IS NOT NULL")
    finite = F.forall("v", lambda x: x.isNotNull() & (F.abs(x.cast("double")) < math.inf))
    asked = rows.where(F.col("q") & finite).groupBy("id").agg(F.min("v").alias("v"))
    blocks = max(1, math.ceil(asked.count() / query_block))
    found = None
    for n in range(blocks):
        got = (asked.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == n) if blocks > 1 else asked).select("id", "v").toArrow().combine_chunks()
        keep, matrix = _matrix(got.column("v").combine_chunks() if got.num_rows else pa.array([], pa.list_(pa.float64())), scale)
        shared = vectors.sparkSession.sparkContext.broadcast((got.column("id").to_numpy()[keep], matrix))
        part = _pass(rows.select("id", "v"), shared, k, scale)
        if blocks > 1:  # a block is done, and let go, before the next one is fetched
            part = save(_best(part, k).drop("rank"))
            shared.destroy()
        found = part if found is None else found.unionByName(part)
    return _best(found, k) if blocks == 1 else found.withColumn("rank", _rank()).select("query_id", "rank", "vec_id", "score")


def _rank() -> Column:
    return F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))


def _best(found: DataFrame, k: int) -> DataFrame:
    return found.withColumn("rank", _rank()).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _pass(rows: DataFrame, shared, k: int, scale: int) -> DataFrame:
    """The k best of every task, for each query of one block (ids, vectors), which is broadcast."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, queries = shared.value
        best: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0))] * len(ids)
        width = queries.shape[1]
        query_rest = _rest(queries.T) if len(ids) else None
        for batch in batches:
            keep, matrix = _matrix(batch.column(1), scale)
            own = batch.column(0).to_numpy(zero_copy_only=False)[keep]
            columns = np.zeros((width, len(own)))
            columns[: min(width, matrix.shape[1])] = matrix.T[:width]
            rest = _rest(columns)
            for n, query in enumerate(queries):
                allowed = np.flatnonzero(own != ids[n])
                if not len(allowed):
                    continue
                old_ids, old = best[n]
                if query_rest[0, n] * rest[0].max() < 2**52:
                    live, score = search(query, query_rest[:, n], columns, rest, allowed, k, float(old.min()) if len(old) >= k else -math.inf)
                else:
                    live, score = allowed, _exact(query, columns[:, allowed])
                new_ids, new = np.concatenate([old_ids, own[live]]), np.concatenate([old, score])
                order = np.lexsort((new_ids, -new))[:k]
                best[n] = (new_ids[order], new[order])
        count = [len(x[0]) for x in best]
        score = [int(s) for x in best for s in x[1]]
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, count)), pa.array(np.concatenate([x[0] for x in best]) if len(ids) else np.zeros(0, np.int64)), pa.array(score, pa.int64())], names=["query_id", "vec_id", "score"])

    return rows.mapInArrow(released(run), "query_id long, vec_id long, score long")
