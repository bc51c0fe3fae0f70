"""Approximate nearest neighbours by multi-index hashing of learned binary codes.

Codes: on a sample of the rows, at most SAMPLE of them and SAMPLE_VALUES components (a bounded fit; every row is indexed), principal axes are
turned by iterative quantisation, as often as BITS asks for, and a row's code holds the signs of its turned components.

Radius: the sample also tells how far, in bits, the codes of pairs of at least some inner product lie apart. A query's k-th best
inner product in the sample is a lower bound of its k-th best of all; its radius is the KEEP quantile of the pairs that reach that bound,
and at least its k-th nearest code in the sample, so that k rows are always found where there are as many.

Search: codes are split into substrings of 16 bits, each indexed by value in every shard of about SHARD rows. With a radius r and m
substrings, a code within r bits has one of its first r % m + 1 substrings within r // m bits, or another within r // m - 1 (pigeonhole): all
these buckets are probed, which retrieves every code within the radius, and the rows found are ranked by their original vectors. Shards meet blocks
of about BLOCK queries as data: both sides are keyed by (shard, block), and a group holds no more than one of each.

Defined results: vectors that are null, zero or hold a null or non-finite component take no part, nor do null ids; missing components of
the shorter of two vectors count as 0; rows that repeat an id are candidates of their own, but one query (the least vector); rows
with a query's id are never its results; ties go to the smaller id. Equal rows are stored once with their number. Only the id and
vector columns are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylight.llm.components import save
from quarrylight.llm.frames import released

BITS = 128
SAMPLE, SAMPLE_VALUES = 16_384, 1 << 21
PAIRS = 512
KEEP = 0.95
SHARD = 32_768
BLOCK = 4_096
_WORD = 16
_COUNT = np.bitwise_count(np.arange(1 << _WORD, dtype=np.uint16))
_BY_COUNT = np.argsort(_COUNT, kind="stable").astype(np.uint16)
_UP_TO = np.cumsum(np.bincount(_COUNT))


def _matrix(col: pa.Array, width: int) -> np.ndarray:
    """Vectors as rows of doubles, padded with zeros."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    size = pc.list_value_length(col).to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(col), width))
    out[np.repeat(np.arange(len(col)), size), np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)] = col.flatten().to_numpy(zero_copy_only=False)
    return out


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(-1, dtype=np.int64)


@dataclass
class Codes:
    """mean and turned axes; scores, falling, and the radius of the pairs that reach each; the sample."""

    mean: np.ndarray
    axes: np.ndarray
    scores: np.ndarray
    radii: np.ndarray
    ids: np.ndarray
    rows: np.ndarray
    codes: np.ndarray

    def encode(self, rows: np.ndarray) -> np.ndarray:
        """Substrings of _WORD bits, rows x substrings."""
        return np.packbits((rows - self.mean) @ self.axes > 0, axis=1).view(np.uint16)

    def radius(self, ids: np.ndarray, rows: np.ndarray, codes: np.ndarray, k: int) -> np.ndarray:
        """By query, how many bits the codes to be retrieved may be away."""
        out = np.full(len(ids), codes.shape[1] * _WORD)
        for n in range(len(ids)):
            other = np.flatnonzero(self.ids != ids[n])
            if len(other) < k:
                continue
            score = np.partition(self.rows[other] @ rows[n].astype(self.rows.dtype), -k)[-k]
            near = np.partition(_distance(self.codes[other], codes[n]), k - 1)[k - 1]
            at = int(np.searchsorted(-self.scores, -score))
            out[n] = max(near, self.radii[at] if at < len(self.radii) else out[n])
        return out


def fit(ids: np.ndarray, rows: np.ndarray, bits: int = BITS, rounds: int = 30, seed: int = 7) -> Codes:
    """Learns codes and radii from sampled rows."""
    rng, width = np.random.default_rng(seed), rows.shape[1]
    mean = rows.mean(0)
    _, principal = np.linalg.eigh((rows - mean).T @ (rows - mean))
    main, turned = (rows - mean) @ principal, []
    for _ in range(-(-bits // width)):
        turn, _ = np.linalg.qr(rng.normal(size=(width, width)))
        for _ in range(rounds):
            u, _, v = np.linalg.svd(np.where(main @ turn > 0, 1.0, -1.0).T @ main)
            turn = v.T @ u.T
        turned.append(principal @ turn)
    axes = np.concatenate(turned, 1)[:, :bits]
    model = Codes(mean, axes, np.zeros(0), np.zeros(0, np.int64), ids, rows.astype(np.float32), np.zeros(0))
    model.codes = model.encode(rows)
    some = rng.choice(len(ids), min(PAIRS, len(ids)), replace=False)
    score, far = [], []
    for n in some:
        s, d = rows @ rows[n], _distance(model.codes, model.codes[n])
        best = np.argsort(-s, kind="stable")[: max(256, len(ids) // 8)]
        best = best[ids[best] != ids[n]]
        score.append(s[best])
        far.append(d[best])
    score, far = np.concatenate(score), np.concatenate(far)
    order = np.argsort(-score, kind="stable")
    score, far = score[order], far[order]
    cuts = [c for c in np.unique((256 * 1.3 ** np.arange(60)).astype(np.int64)) if c <= len(score)]
    model.scores = score[[c - 1 for c in cuts]] if cuts else np.zeros(0)
    model.radii = np.maximum.accumulate([math.ceil(np.quantile(far[:c], KEEP)) for c in cuts]).astype(np.int64) if cuts else np.zeros(0, np.int64)
    return model


class Index:
    """The codes of some rows, by each substring's value: rows of value v are rows[j][start[j][v] : start[j][v + 1]]."""

    def __init__(self, codes: np.ndarray) -> None:
        self.codes = np.ascontiguousarray(codes)
        self.wide = self.codes.view(np.uint64) if codes.shape[1] % 4 == 0 else self.codes
        self.rows = [np.argsort(c, kind="stable") for c in codes.T]
        self.start = [np.concatenate([[0], np.cumsum(np.bincount(c, minlength=1 << _WORD))]) for c in codes.T]

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """All rows whose code is within the radius, by pigeonhole probes of the substrings."""
        m = self.codes.shape[1]
        seen = np.zeros(len(self.codes), bool)
        for j in range(m):
            bits = min(radius // m - (j > radius % m), _WORD)
            if bits < 0:
                continue
            probe = (_BY_COUNT[: _UP_TO[bits]] ^ code[j]).astype(np.int64)
            a, b = self.start[j][probe], self.start[j][probe + 1]
            some = b > a
            a, size = a[some], (b - a)[some]
            seen[self.rows[j][np.repeat(a - np.cumsum(size) + size, size) + np.arange(size.sum())]] = True
        found = np.flatnonzero(seen)
        return found[_distance(self.wide[found], np.ascontiguousarray(code).view(self.wide.dtype)) <= radius]


def _search(ids: np.ndarray, copies: np.ndarray, rows: np.ndarray, codes: np.ndarray, asked: tuple[np.ndarray, ...], k: int) -> Iterator[tuple[int, int, float]]:
    """(query, id, score) of the k best rows of a shard that are within each query's radius."""
    index = Index(codes)
    for query, vector, code, radius in zip(*asked, strict=True):
        found = index.within(code, int(radius))
        found = found[ids[found] != query]
        if len(found) > k:
            rough = rows[found] @ vector
            found = found[rough >= np.partition(rough, -k)[-k] - 1e-9 * (1 + np.abs(rough).max())]
        score = (rows[found] * vector).sum(1)  # row by row alike, so that equal vectors tie
        best = np.lexsort((ids[found], -score))[:k]
        for n in np.repeat(best, copies[found[best]])[:k]:
            yield query, ids[found[n]], score[n]


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", bits: int = BITS, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): for every query row the k rows found of largest inner product."""
    spark, made = vectors.sparkSession, "query_id long, vec_id long, score double"
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"), is_query.alias("q")).where("id IS NOT NULL AND v IS NOT NULL")
    rows = rows.where(F.forall("v", lambda x: x.isNotNull() & (F.abs(x.cast("double")) < math.inf)) & F.exists("v", lambda x: x != 0))
    stored = save(rows.groupBy("id", "v").agg(F.bool_or("q").alias("q"), F.least(F.count("*"), F.lit(k)).alias("copies")))
    n, asked, width = stored.agg(F.count("*"), F.count_if("q"), F.max(F.size("v"))).first()
    if not asked:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    most = max(2, min(SAMPLE, SAMPLE_VALUES // width))
    some = stored if n <= most else stored.where(F.pmod(F.xxhash64("id", "v"), F.lit(n)) < most).limit(2 * most)
    got = some.select("id", "v").toArrow()
    shared = spark.sparkContext.broadcast(fit(got.column("id").to_numpy(), _matrix(got.column("v"), width), bits))  # its size is bounded by the sample's

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = shared.value.encode(_matrix(batch.column("v"), width))
            yield batch.append_column("code", pa.array([c.tobytes() for c in codes], pa.binary()))

    def aim(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, vectors_ = batch.column("id").to_numpy(), _matrix(batch.column("v"), width)
            codes = shared.value.encode(vectors_)
            yield batch.append_column("code", pa.array([c.tobytes() for c in codes], pa.binary())).append_column("radius", pa.array(shared.value.radius(ids, vectors_, codes, k)))

    def meet(rows_: pa.Table, queries: pa.Table) -> pa.Table:
        unpack = lambda t: (t.column("id").to_numpy(), _matrix(t.column("v"), width), np.frombuffer(b"".join(t.column("code").to_pylist()), np.uint16).reshape(len(t), -1))
        found: list[tuple[int, int, float]] = []
        if len(rows_) and len(queries):
            ids, matrix, codes = unpack(rows_)
            found = list(_search(ids, rows_.column("copies").to_numpy(), matrix, codes, (*unpack(queries), queries.column("radius").to_numpy()), k))
        q, i, s = zip(*found, strict=True) if found else ((), (), ())
        return pa.table({"query_id": pa.array(q, pa.int64()), "vec_id": pa.array(i, pa.int64()), "score": pa.array(s, pa.float64())})

    kind = stored.schema["v"].dataType.simpleString()
    shards, blocks = -(-n // shard), -(-asked // block)
    place = lambda count, *by: F.pmod(F.xxhash64(*by), F.lit(count)).cast("int")
    each = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    index = stored.select("id", "v", "copies").mapInArrow(released(code), f"id long, v {kind}, copies long, code binary")
    index = index.select("*", place(shards, "id", "v").alias("shard"), each(blocks).alias("block"))
    queries = stored.where("q").groupBy("id").agg(F.min("v").alias("v")).mapInArrow(released(aim), f"id long, v {kind}, code binary, radius long")
    queries = queries.select("*", place(blocks, "id").alias("block"), each(shards).alias("shard"))
    found = index.groupBy("shard", "block").cogroup(queries.groupBy("shard", "block")).applyInArrow(meet, made)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
