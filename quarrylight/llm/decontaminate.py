"""Benchmark decontamination by latent semantic retrieval.

Benchmark items are cut into passages of up to PASSAGE words, documents into windows of WINDOW words that start every
STRIDE words, so each run of PASSAGE words lies whole in some window; short passages meet windows of their own size
(TIERS). Both become TF-IDF vectors over hashed words, with
document frequencies over all documents. A distributed randomised SVD of the benchmark's passages gives a latent space; a
window is projected into it and meets the passages by cosine. Candidates are then read as word sequences: the longest
common subsequence with the whole item must cover enough of it, and so must the answer, the item's rarest words (or
its own answer text, if given).

A window's mass is the sum of tf * idf^2 over its benchmark words, a passage's the same sum over its own. Windows of less
than MASS of a passage's aren't its candidates; one that holds the passage whole has all of it, however words repeat.

The benchmark is the stated query set. It is worked in blocks of about BLOCK_ITEMS items, one after the other, with one pass
over the documents for each. That bounds what the driver and a task hold: SLOTS x RANK floats and the words of a block's items.

Words are compared without case and punctuation.

Defined results: null or empty documents and items match nothing; an item that is repeated, or whose text is, matches
under each of its ids; ids may be null or repeated; of several matches of an item in a document the best counts; an empty benchmark
flags nothing.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylight.llm.components import save
from quarrylight.llm.frames import extend, inputs_of, released
from quarrylight.llm.words import words

SLOTS = 1 << 15
RANK = 64
PASSAGE, WINDOW, STRIDE = 32, 48, 16
TIERS = ((8, 12, 4), (16, 24, 8), (PASSAGE, WINDOW, STRIDE))  # words of a passage at most; its windows and their stride
BLOCK_ITEMS = 4096
COSINE = 0.4  # of a window's latent vector and a passage's
MASS = 0.5  # of a passage's mass that a window has to hold at least
SEQUENCE = 0.6  # of an item's words in the longest common subsequence
ANSWER = 0.6  # of the answer's words
LEAKS = "array<struct<item_id:long,cosine:double,lcs:double>>"


def _slot(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(49)).astype(np.int64)


def document_frequencies(docs: DataFrame, text_col: str = "text") -> tuple[np.ndarray, int]:
    """By slot, the documents that have a word of it, and the number of documents; SLOTS rows reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, rows = np.zeros(SLOTS, np.int64), 0
        for batch in batches:
            rows += batch.num_rows
            for w in words(batch.column(0), plain=True):
                df += np.bincount(np.unique(w.row_of() * SLOTS + _slot(w.hash)) % SLOTS, minlength=SLOTS)
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(df[at], rows))], names=["slot", "n"])

    got = docs.select(F.col(text_col).cast("string")).mapInArrow(released(run), "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    slot, n = got.column("slot").to_numpy(), got.column("n").to_numpy()
    out = np.zeros(SLOTS, np.int64)
    out[slot[slot >= 0]] = n[slot >= 0]
    return out, int(n[slot < 0].sum())


def _passages(items: DataFrame, idf: np.ndarray) -> DataFrame:
    """(item_id, part, slots, weights, mass, n): TF-IDF of every passage, of length 1, its mass and words; the last one ends where its item does."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], [], []]
            for w in words(batch.column(1), plain=True):
                for r in range(w.last - w.first):
                    own = _slot(w.hash[w.bounds[r] : w.bounds[r + 1]])
                    starts = sorted({*range(0, max(1, len(own) - PASSAGE + 1), PASSAGE), max(0, len(own) - PASSAGE)}) if len(own) else []
                    for k, a in enumerate(starts):
                        at, tf = np.unique(own[a : a + PASSAGE], return_counts=True)
                        v = tf * idf[at]
                        for held, x in zip(out, (batch.column(0)[w.first + r].as_py(), k, at, v / max(1e-9, np.linalg.norm(v)), float(v @ idf[at]), int(tf.sum())), strict=True):
                            held.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.list_(pa.int64())), pa.array(out[3], pa.list_(pa.float64())), pa.array(out[4], pa.float64()), pa.array(out[5], pa.int64())], names=["item_id", "part", "slots", "weights", "mass", "n"])

    return items.mapInArrow(released(run), "item_id long, part long, slots array<long>, weights array<double>, mass double, n long")


def randomised_svd(vectors: DataFrame, rank: int, rounds: int = 2, seed: int = 7) -> np.ndarray:
    """Right singular vectors, SLOTS x rank, of the sparse rows (slots, weights).

    Every round multiplies the matrix and its transpose with a SLOTS x rank block, by partition; the partial products are
    summed by row of the block, and only that block, of fixed size, reaches the driver, where it is orthonormalised.
    """
    block = np.linalg.qr(np.random.default_rng(seed).standard_normal((SLOTS, rank)))[0]
    for _ in range(rounds):
        shared = vectors.sparkSession.sparkContext.broadcast(block.astype(np.float32))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            part: dict[int, np.ndarray] = {}
            for batch in batches:
                for slots, weights in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    w = np.array(weights)
                    y = w @ shared.value[slots]
                    for s, x in zip(slots, np.outer(w, y), strict=True):
                        part[s] = part[s] + x if s in part else x
            rows = pa.array([x.tolist() for x in part.values()], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([pa.array(list(part), pa.int64()), rows], names=["slot", "row"])

        sums = [F.sum(F.col("row")[k]).alias(f"x{k}") for k in range(rank)]
        got = vectors.select("slots", "weights").mapInArrow(released(run), "slot long, row array<double>").groupBy("slot").agg(*sums).toArrow()
        block = np.zeros((SLOTS, rank))
        block[got.column("slot").to_numpy()] = np.column_stack([got.column(f"x{k}").to_numpy() for k in range(rank)]) if got.num_rows else 0
        shared.unpersist()
        block = np.linalg.qr(block)[0] if block.any() else block
    return block.astype(np.float32)


def _lcs(item: np.ndarray, text: np.ndarray) -> int:
    """Length of the longest common subsequence, bit-parallel over the item's words."""
    where: dict[int, int] = {}
    for k, x in enumerate(item.tolist()):
        where[x] = where.get(x, 0) | 1 << k
    full = (1 << len(item)) - 1
    v = full
    for x in text.tolist():
        if m := where.get(x):
            u = v & m
            v = ((v + u) | (v - u)) & full
    return len(item) - bin(v).count("1")


class Benchmark:
    """One block of items: their words, passages, latent vectors and answers."""

    def __init__(self, rows: list[tuple], passages: list[tuple], idf: np.ndarray, space: np.ndarray):
        self.idf, self.words, self.answers, self.mass = idf, [], [], np.zeros(1 << 20, np.float32)
        for _, text, answer in rows:
            own = next(iter(words(pa.array([text], pa.string()), plain=True)))
            self.words.append(own.hash)
            if answer:
                key = next(iter(words(pa.array([answer], pa.string()), plain=True))).hash
            else:
                key = np.unique(own.hash)
                key = key[np.argsort(-idf[_slot(key)], kind="stable")][: max(1, len(key) // 3)]
            self.answers.append(set(key.tolist()))
            np.maximum.at(self.mass, (own.hash >> np.uint64(44)).astype(np.int64), idf[_slot(own.hash)] ** 2)
        self.ids = [x[0] for x in rows]
        place = {}
        for k, x in enumerate(self.ids):
            place.setdefault(x, []).append(k)
        use = np.zeros(SLOTS, bool)
        owner, vectors, least, size = [], [], [], []
        for item, slots, weights, m, n in passages:
            use[slots] = True
            for k in place[item]:
                owner.append(k)
                vectors.append(np.array(weights, np.float32) @ space[slots])
                least.append(MASS * m)
                size.append(n)
        self.owner, self.least, size = np.array(owner, np.int64), np.array(least), np.array(size)
        self.vectors = np.array(vectors, np.float32).reshape(len(owner), space.shape[1])
        self.vectors /= np.maximum(1e-9, np.linalg.norm(self.vectors, axis=1, keepdims=True))
        self.space = np.where(use[:, None], space, 0).astype(np.float32) * idf[:, None].astype(np.float32)
        self.tiers, low = [], 0
        for most, window, stride in TIERS:
            at = np.flatnonzero((size > low) & (size <= most))
            low = most
            if len(at):
                self.tiers.append((at, window, stride))

    def matches(self, h: np.ndarray, bounds: np.ndarray) -> dict[int, dict[int, tuple[float, float]]]:
        """By row, by item: the best (cosine, share of the item in the common subsequence)."""
        found: dict[int, dict[int, tuple[float, float]]] = {}
        if not len(h) or not len(self.owner):
            return found
        mass = np.concatenate([[0.0], np.cumsum(self.mass[(h >> np.uint64(44)).astype(np.int64)], dtype=np.float64)])
        for at, window, stride in self.tiers:
            self._meet(found, h, bounds, mass, at, window, stride)
        return {r: good for r, x in found.items() if (good := {i: v for i, v in x.items() if v[1] >= SEQUENCE})}

    def _meet(self, found: dict, h: np.ndarray, bounds: np.ndarray, mass: np.ndarray, own: np.ndarray, window: int, stride: int) -> None:
        """Adds what passages own find in windows of one size."""
        count = np.diff(bounds)
        per = np.where(count > 0, -(-np.maximum(0, count - window) // stride) + 1, 0)
        row = np.repeat(np.arange(len(count)), per)
        start = bounds[row] + (np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per)) * stride
        end = np.minimum(start + window, bounds[row + 1])
        keep = mass[end] - mass[start] >= self.least[own].min() * (1 - 1e-6)
        row, start, end = row[keep], start[keep], end[keep]
        slots = _slot(h)
        for k in range(0, len(row), 512):
            a, b = start[k : k + 512], end[k : k + 512]
            at = np.minimum(a[:, None] + np.arange(window), len(h) - 1)
            v = np.einsum("nwr,nw->nr", self.space[slots[at]], (np.arange(window) < (b - a)[:, None]).astype(np.float32))
            v /= np.maximum(1e-9, np.linalg.norm(v, axis=1, keepdims=True))
            cosine = v @ self.vectors[own].T
            enough = (mass[b] - mass[a])[:, None] >= self.least[own] * (1 - 1e-6)
            for i, j in zip(*np.nonzero((cosine >= COSINE) & enough), strict=True):
                r, item = int(row[k + i]), int(self.owner[own[j]])
                old = found.setdefault(r, {}).get(item, (0.0, 0.0))
                if old[1] >= 1:
                    continue
                size = len(self.words[item])
                text = h[max(bounds[r], a[i] - size) : min(bounds[r + 1], b[i] + size)]
                held = set(text.tolist())
                part = _lcs(self.words[item], text) / size if len(self.answers[item] & held) >= ANSWER * len(self.answers[item]) else 0.0
                if part > old[1]:
                    found[r][item] = (float(cosine[i, j]), part)


def find_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", answer_col: str | None = None, carry: list[str] | None = None) -> DataFrame:
    """The carried columns and ``leaks``: the items that a document holds, by item id."""
    df, total = document_frequencies(docs, text_col)
    idf = np.log((total + 1) / (df + 1)) + 1e-3
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text).cast("string").alias("text"), (F.col(answer_col).cast("string") if answer_col else F.lit(None).cast("string")).alias("answer"))
    items = items.where("item_id IS NOT NULL AND trim(text) <> ''").distinct()
    blocks = max(1, math.ceil(items.count() / BLOCK_ITEMS))
    if blocks == 1:
        return _marked(docs, text_col, _block(items, idf), carry)
    held = [c for c in docs.columns if c.lower() != "leaks" and (carry is None or c in carry)]
    rows = save(docs.select(F.struct(*held).alias("row"), F.col(text_col).cast("string").alias("text"), F.monotonically_increasing_id().alias("n")))
    found = None
    for k in range(blocks):  # one after the other: a block's matches are saved, and it is let go, before the next one is fetched
        shared = _block(items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k), idf)
        part = save(_marked(rows, "text", shared, ["n"]).where(F.size("leaks") > 0))
        shared.destroy()
        found = part if found is None else found.unionByName(part)
    best = found.select("n", F.explode("leaks").alias("x")).groupBy("n", "x.item_id").agg(F.max_by("x", F.struct("x.lcs", "x.cosine")).alias("x"))
    leaks = best.groupBy("n").agg(F.sort_array(F.collect_list("x")).alias("leaks"))
    return rows.join(leaks.hint("merge"), "n", "left").select("row.*", F.coalesce("leaks", F.array().cast(LEAKS)).alias("leaks"))


def _block(items: DataFrame, idf: np.ndarray):
    """A broadcast of what is needed to match the items: words, passages and their latent space."""
    passages = _passages(items.select("item_id", "text"), idf).cache()
    space = randomised_svd(passages, RANK)
    rows = [(r["item_id"], r["text"], r["answer"]) for r in items.orderBy("item_id", "text", "answer").collect()]
    parts = [(r["item_id"], r["slots"], r["weights"], r["mass"], r["n"]) for r in passages.orderBy("item_id", "part").collect()]
    passages.unpersist()
    return items.sparkSession.sparkContext.broadcast((rows, parts, idf, space))


def _marked(docs: DataFrame, text_col: str, shared, carry: list[str] | None) -> DataFrame:
    """The carried columns and the leaks of one block of items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        mark = Benchmark(*shared.value)
        kind = pa.list_(pa.struct([("item_id", pa.int64()), ("cosine", pa.float64()), ("lcs", pa.float64())]))
        for batch in batches:
            for w in words(inputs_of(batch, 1)[0], plain=True):
                leaks: list[list[dict]] = [[] for _ in range(w.last - w.first)]
                for r, got in mark.matches(w.hash, w.bounds).items():
                    best: dict[int, tuple[float, float]] = {}
                    for i, (cosine, part) in got.items():  # an id may have several texts
                        best[mark.ids[i]] = max(best.get(mark.ids[i], (0.0, 0.0)), (part, cosine))
                    leaks[r] = [{"item_id": i, "cosine": c, "lcs": p} for i, (p, c) in sorted(best.items())]
                yield batch, w.first, w.last, [pa.array(leaks, kind)]

    return extend(docs, [F.col(text_col).cast("string")], f"leaks {LEAKS}", run, carry)
