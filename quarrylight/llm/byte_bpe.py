"""Byte-level BPE encoding and decoding with a segment tree per piece.

The leaves of a piece's tree stand for byte positions. A live leaf holds the rank of the pair that starts there, its
position in the low bits, so the root is the leftmost pair of least rank; a merge changes three leaves (the pair, its
right part, the left neighbour) and the paths above them. Pieces of up to 64 bytes are worked many at a time as rows of
one array of trees; longer ones have a tree of their own.

Defined results: a null or empty text has no ids and decodes to no bytes; a null id keeps its row; repeated rows give
repeated results; an empty table gives an empty one. Only the id and the text column are read, so other columns, of any
name, do no harm.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylight.llm.frames import released
from quarrylight.llm.words import row_slices

BATCH_LEAVES, BATCH_PIECES = 64, 8_000
CACHE_PIECES = 200_000
_NONE = np.int32(1 << 30)


class BPE:
    """Ranks, with a hash table from two adjacent token ids to the id of their merge. Made on the driver and broadcast; its size is fixed."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, pattern
        self.token = {i: t for t, i in ranks.items()}
        pairs = {(ranks[t[:k]] << 20) | ranks[t[k:]]: i for t, i in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks}
        self.bits = max(4, int(len(pairs) * 4).bit_length())
        self.keys, self.vals = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, _NONE, np.int32)
        key = np.fromiter(pairs, np.int64, len(pairs))
        val = np.fromiter(pairs.values(), np.int32, len(pairs))
        slot = self._slot(key)
        while len(key):  # linear probing, all keys a step at a time
            free = np.flatnonzero(self.keys[slot] < 0)
            at, first = np.unique(slot[free], return_index=True)
            self.keys[at], self.vals[at] = key[free[first]], val[free[first]]
            left = np.ones(len(key), bool)
            left[free[first]] = False
            key, val, slot = key[left], val[left], (slot[left] + 1) & ((1 << self.bits) - 1)
        self.byte_id = np.array([ranks[bytes([b])] for b in range(256)], np.int32)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def pair(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The id of the merge of tokens a and b, or _NONE."""
        key = (a.astype(np.int64) << 20) | b
        slot, out = self._slot(key), np.full(len(key), _NONE, np.int32)
        live = np.arange(len(key))
        while len(live):
            held = self.keys[slot]
            hit = held == key[live]
            out[live[hit]] = self.vals[slot[hit]]
            on = ~hit & (held >= 0)
            live, slot = live[on], (slot[on] + 1) & ((1 << self.bits) - 1)
        return out

    def encode_batch(self, pieces: list[bytes]) -> list[bytes]:
        """int32 ids of every piece, as bytes."""
        out: list[bytes] = [b""] * len(pieces)
        groups: dict[int, list[int]] = {}
        for i, p in enumerate(pieces):
            if (r := self.ranks.get(p)) is not None:
                out[i] = np.int32(r).tobytes()
            elif len(p) <= BATCH_LEAVES:
                groups.setdefault(max(2, 1 << (len(p) - 1).bit_length()), []).append(i)
            else:
                out[i] = self.encode_long(p)
        for leaves, rows in groups.items():
            for k in range(0, len(rows), BATCH_PIECES):
                part = rows[k : k + BATCH_PIECES]
                for i, ids in zip(part, self._trees([pieces[i] for i in part], leaves), strict=True):
                    out[i] = ids
        return out

    def _trees(self, pieces: list[bytes], leaves: int) -> list[bytes]:
        n, size = len(pieces), np.array([len(p) for p in pieces])
        raw = np.frombuffer(b"".join(p.ljust(leaves, b"\0") for p in pieces), np.uint8).reshape(n, leaves)
        ids = self.byte_id[raw]
        live = np.arange(leaves)[None, :] < size[:, None]
        after = np.tile(np.arange(1, leaves + 1, dtype=np.int64), (n, 1))  # a position at or past the size is an end
        before = np.tile(np.arange(-1, leaves, dtype=np.int64), (n, 1))  # one more column takes writes past the end
        tree = np.full((n, 2 * leaves), _NONE, np.int32)
        shift = leaves.bit_length() - 1
        r, c = np.nonzero(live[:, 1:])
        rank = self.pair(ids[r, c], ids[r, c + 1])
        has = rank != _NONE
        tree[r[has], leaves + c[has]] = (rank[has] << shift) | c[has]
        for node in range(leaves - 1, 0, -1):
            tree[:, node] = np.minimum(tree[:, 2 * node], tree[:, 2 * node + 1])
        rows = np.flatnonzero(tree[:, 1] != _NONE)
        while len(rows):
            best = tree[rows, 1]
            at, new = (best & (leaves - 1)).astype(np.int64), best >> shift
            right = after[rows, at]
            end = after[rows, right]
            ids[rows, at], live[rows, right] = new, False
            after[rows, at], before[rows, end] = end, at
            tree[rows, leaves + right] = _NONE
            self._leaf(tree, ids, rows, at, end, end < size[rows], leaves, shift)
            left = before[rows, at]
            k = left >= 0
            self._leaf(tree, ids, rows[k], left[k], at[k], np.ones(int(k.sum()), bool), leaves, shift)
            row = np.concatenate([rows, rows, rows[k]])
            node = (np.concatenate([at, right, left[k]]) + leaves) >> 1
            for _ in range(shift):
                tree[row, node] = np.minimum(tree[row, 2 * node], tree[row, 2 * node + 1])
                node >>= 1
            rows = rows[tree[rows, 1] != _NONE]
        flat, ends = ids[live].astype("<i4").tobytes(), np.cumsum(live.sum(1)) * 4
        return [flat[a:b] for a, b in zip(np.concatenate([[0], ends[:-1]]), ends, strict=True)]

    def _leaf(self, tree, ids, rows, at, nxt, has, leaves, shift) -> None:
        rank = np.full(len(rows), _NONE, np.int32)
        if has.any():
            rank[has] = self.pair(ids[rows[has], at[has]], ids[rows[has], nxt[has]])
        tree[rows, leaves + at] = np.where(rank == _NONE, _NONE, (rank << shift) | at.astype(np.int32))

    def encode_long(self, piece: bytes) -> bytes:
        n = len(piece)
        leaves = 1 << (n - 1).bit_length()
        none = 1 << 62
        ids = self.byte_id[np.frombuffer(piece, np.uint8)]
        rank = self.pair(ids[:-1], ids[1:]).astype(np.int64)
        leaf = np.full(leaves, none, np.int64)
        leaf[: n - 1] = np.where(rank == _NONE, none, (rank << 40) | np.arange(n - 1))
        levels = [leaf]
        while len(levels[-1]) > 1:
            levels.append(np.minimum(levels[-1][::2], levels[-1][1::2]))
        tree = np.concatenate([np.zeros(1, np.int64), *levels[::-1]]).tolist()
        ids, after, before = ids.tolist(), list(range(1, n + 1)), list(range(-1, n))
        live = bytearray(b"\1" * n)
        low, merged = (1 << 40) - 1, self._merge_of

        def put(at: int, value: int) -> None:
            node = at + leaves
            tree[node] = value
            while node > 1:
                node >>= 1
                a, b = tree[2 * node], tree[2 * node + 1]
                value = a if a < b else b
                if tree[node] == value:
                    break
                tree[node] = value

        while tree[1] < none:
            at, ids_new = tree[1] & low, tree[1] >> 40
            right = after[at]
            end = after[right]
            ids[at], live[right], after[at] = ids_new, 0, end
            if end < n:
                before[end] = at
            put(right, none)
            put(at, none if end >= n or (m := merged(ids_new, ids[end])) is None else (m << 40) | at)
            if (left := before[at]) >= 0:
                put(left, none if (m := merged(ids[left], ids_new)) is None else (m << 40) | left)
        return np.array([ids[i] for i in range(n) if live[i]], "<i4").tobytes()

    def _merge_of(self, a: int, b: int) -> int | None:
        return self.ranks.get(self.token[a] + self.token[b])


def load_ranks(path: str) -> dict[bytes, int]:
    """A rank file: base64 of a token's bytes, a blank, its rank, by line. Read on the driver; its size is fixed."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def _encoder(shared) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Batches of (id, text) to batches of (id, ids); a task remembers the ids of pieces that it has met."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, cache = shared.value, {}
        find = regex.compile(bpe.pattern)
        for batch in batches:
            texts = batch.column(1).fill_null("") if batch.column(1).null_count else batch.column(1)
            sizes = np.concatenate([[0], np.cumsum(pa.compute.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))])
            for i, j in row_slices(sizes):
                rows = [find.findall(t) for t in texts.slice(i, j - i).to_pylist()]
                new = list({p for row in rows for p in row if p not in cache})
                if len(cache) > CACHE_PIECES:
                    cache.clear()
                    new = list({p for row in rows for p in row})
                cache.update(zip(new, bpe.encode_batch([p.encode() for p in new]), strict=True))
                ids = [b"".join([cache[p] for p in row]) for row in rows]
                off = np.concatenate([[0], np.cumsum([len(x) // 4 for x in ids])]).astype(np.int32)
                values = pa.array(np.frombuffer(b"".join(ids), "<i4"), pa.int32())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.ListArray.from_arrays(pa.array(off), values)], names=["id", "ids"])

    return run


def _decoder(shared) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Batches of (id, ids) to batches of (id, ids, decoded)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = shared.value.token.__getitem__
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                out = [b"".join(map(token, x or ())) for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(out, pa.binary())], names=["id", "ids", "decoded"])

    return run


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))


def encode(docs: DataFrame, bpe: BPE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>) of every text; each match of the pattern is encoded separately, without special tokens."""
    shared = docs.sparkSession.sparkContext.broadcast(bpe)
    return _texts(docs, id_col, text_col).mapInArrow(released(_encoder(shared)), "id long, ids array<int>").withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, bpe: BPE, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, ids, decoded binary): the bytes of every id, in order."""
    shared = encoded.sparkSession.sparkContext.broadcast(bpe)
    rows = encoded.select(F.col(id_col).cast("long").alias("id"), F.col(ids_col).alias("ids"))
    return rows.mapInArrow(released(_decoder(shared)), "id long, ids array<int>, decoded binary").withColumnRenamed("id", id_col)


def encode_and_decode(docs: DataFrame, bpe: BPE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """What ``decode`` returns of what ``encode`` does, in one pass, so that ids cross to Python workers once."""
    shared = docs.sparkSession.sparkContext.broadcast(bpe)
    there, back = _encoder(shared), _decoder(shared)
    return _texts(docs, id_col, text_col).mapInArrow(released(lambda batches: back(there(batches))), "id long, ids array<int>, decoded binary").withColumnRenamed("id", id_col)


def digests(decoded: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) of what ``decode`` returns."""
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return decoded.select(id_col, F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids.cast("binary"), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
