"""Trigram language model scores from a log-frequency Bloom filter.

Tokens are words with A-Z lower-cased, then one end token a text. Counts of words and of word pairs over all training texts, and
of triples that are seen LEAST times at least, go into a Bloom filter: a count c is quantised to level 1 + floor(log2 c) and every
level up to it is inserted, so a count is read by probing levels 1, 2, ... until one misses. The filter is partitioned: a key's
first bits name its segment, and a task sums and builds the segments of a bucket from the packed counts of all blocks of
texts. The bits grow with the tokens, at least four for each. Up to MAX_BITS the filter is broadcast. A larger one stays a
table of segments: documents are dealt to blocks, a block sends its distinct keys to the segments and gets their levels back,
so that a task holds some segments or a block. Both ways give the same scores. The filter knows keys by the first KEY_BYTES bytes of their
hashes: keys that share these share a count, so one of n distinct keys is mistaken with n in 2^48, less often than by the filter's bits.

Probabilities are smoothed by those of the shorter context: p(w|v) = (c(v,w) + MU p(w)) / (c(v) + MU) and
p(w|u,v) = (c(u,v,w) + MU_3 p(w|v)) / (c(u,v) + MU_3), with p(w) from the probed count of w. A triple is only asked for where both of its
pairs are seen LEAST times, as it couldn't be in the filter otherwise.

The base score needs exact counts: those of the most frequent words come from a table of at most TABLE_ROWS rows, all
others from a join.

Defined results: a null or empty text has its end token only; null ids are kept, learned from, and never held out; repeated
rows count as often as they come and come back as often; with no training text all counts are 0. Only the id and text
columns are read. Words are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylight.llm.components import save
from quarrylight.llm.frames import released
from quarrylight.llm.words import Words, mix, signed, words

TABLE_ROWS = 1 << 18
BLOCK = 4_000_000  # tokens that are counted together in a task
SEGMENT_BITS = 12
KEY_BYTES = 6  # of a key's hash that the filter knows
MAX_BITS = 1 << 29  # of a filter that is broadcast
SEGMENT_SIZE = 17  # a power of two; there are more segments where they would be larger
BUCKETS = 10  # a power of two; as many groups of segments at most that keys are sent to, until a group has as many segments
BLOCK_CHARS = 8_000_000  # of the texts that ask for their keys together
MU, MU_3 = 500.0, 50.0
LEAST = 2  # times that a triple is seen
BUCKET_KEYS = 1 << 18  # of counted keys that are summed together, about
END, START = np.uint64(0xE17D), np.uint64(0x57A7)
_STEP = 0x9E3779B97F4A7C15


def _tokens(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of all rows, what stands before each, and the offsets by row."""
    rows = w.last - w.first
    offsets = w.bounds + np.arange(rows + 1)
    out = np.empty(len(w.hash) + rows, np.uint64)
    out[np.arange(len(w.hash)) + w.row_of()] = w.hash
    out[offsets[1:] - 1] = END
    before = np.concatenate([[START], out[:-1]]).astype(np.uint64)
    before[offsets[:-1]] = START
    return out, before, offsets


def _pair(before: np.ndarray, token: np.ndarray) -> np.ndarray:
    return mix(mix(before + np.uint64(1)) + token)


def _triple(pair: np.ndarray, token: np.ndarray) -> np.ndarray:
    """Keys of the triples that end with the tokens; pair: the keys of the two before."""
    return mix(mix(pair + np.uint64(0x3C6E)) + token)


def _inner(offsets: np.ndarray) -> np.ndarray:
    """Places of tokens that aren't the first of their text."""
    inner = np.ones(int(offsets[-1]), bool)
    inner[offsets[:-1]] = False
    return np.flatnonzero(inner)


def _single(token: np.ndarray) -> np.ndarray:
    return mix(token ^ np.uint64(0x51A61E))


def _segment_bits(bits: int) -> int:
    return max(SEGMENT_BITS, bits.bit_length() - 1 - SEGMENT_SIZE)


def _counts(docs: DataFrame) -> DataFrame:
    """(h, c): tokens, counted by blocks of tasks."""

    def flush(held: list) -> pa.RecordBatch:
        h, c = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(signed(h)), pa.array(c.astype(np.int64))], names=["h", "c"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for w in words(batch.column(0)):
                held.append(_tokens(w)[0])
                size += len(held[-1])
                if size >= BLOCK:
                    yield flush(held)
                    held, size = [], 0
        if held:
            yield flush(held)

    return docs.select("text").mapInArrow(released(run), "h long, c long")


_PACKED = "bucket int, least int, keys binary, counts binary"


def _packed(keys: np.ndarray, counts: np.ndarray, least: int, bucket_bits: int) -> pa.RecordBatch:
    """A row for each bucket of sorted keys: their first KEY_BYTES bytes, and their counts; least: what a key's sum has to reach."""
    bucket, first = np.unique(keys >> np.uint64(64 - bucket_bits), return_index=True)
    ends = [*first[1:].tolist(), len(keys)][: len(first)]
    raw = keys.astype(">u8").view(np.uint8).reshape(-1, 8)[:, :KEY_BYTES]
    cut = [(raw[a:b].tobytes(), counts[a:b].astype("<u4").tobytes()) for a, b in zip(first.tolist(), ends, strict=True)]
    arrays = [pa.array(bucket.astype(np.int32)), pa.array(np.full(len(bucket), least, np.int32)), pa.array([x for x, _ in cut], pa.binary()), pa.array([y for _, y in cut], pa.binary())]
    return pa.RecordBatch.from_arrays(arrays, names=["bucket", "least", "keys", "counts"])


def _split(keys: np.ndarray, counts: np.ndarray, most: int = (1 << 32) - 1) -> tuple[np.ndarray, np.ndarray]:
    """Counts that four bytes hold: a larger one becomes several of the same key, which are summed again."""
    n = np.maximum(1, -(-counts // most))
    out = np.full(int(n.sum()), most, np.int64)
    out[np.cumsum(n) - 1] = counts - (n - 1) * most
    return np.repeat(keys, n), out


def _cut(h: np.ndarray) -> np.ndarray:
    """Keys as the filter knows them, by their first KEY_BYTES bytes."""
    return h & np.uint64((1 << 64) - (1 << (64 - 8 * KEY_BYTES)))


def _blocks(docs: DataFrame, counts: DataFrame, bucket_bits: int) -> DataFrame:
    """Packed counts of the filter's keys: pairs and triples by blocks of texts, and single tokens from their table."""

    def flush(pairs: list, triples: list) -> Iterator[pa.RecordBatch]:
        for held, least in ((pairs, 1), (triples, LEAST)):
            h, c = np.unique(_cut(np.concatenate(held)), return_counts=True)
            yield _packed(h, c, least, bucket_bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, triples, size = [], [], 0
        for batch in batches:
            for w in words(batch.column(0)):
                token, before, off = _tokens(w)
                pair, at = _pair(before, token), _inner(off)
                pairs.append(pair)
                triples.append(_triple(pair[at - 1], token[at]))
                size += len(token)
                if size >= BLOCK:
                    yield from flush(pairs, triples)
                    pairs, triples, size = [], [], 0
        if pairs:
            yield from flush(pairs, triples)

    def one(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        h, c = (np.concatenate([b.column(k).to_numpy() for b in held]) for k in (0, 1))
        h = _cut(_single(h.astype(np.int64).view(np.uint64)))
        order = np.argsort(h)
        return _packed(*_split(h[order], c[order]), 1, bucket_bits)

    def single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= BLOCK // 8:
                yield one(held)
                held, size = [], 0
        if held:
            yield one(held)

    return docs.select("text").mapInArrow(released(run), _PACKED).unionByName(counts.select("h", "c").mapInArrow(released(single), _PACKED))


def _places(h: np.ndarray, level: int, mask: np.uint64) -> list[np.ndarray]:
    """The four bits, within its segment, that stand for a key's level."""
    v = mix(h + np.uint64(level * _STEP % (1 << 64)))
    return [(x & mask).astype(np.int64) for x in (v, v >> np.uint64(20), v >> np.uint64(40), mix(v))]


def segments(docs: DataFrame, counts: DataFrame, tokens: int, bits: int) -> DataFrame:
    """(segment, bits) of the filter; segments without keys are left out."""
    segment_bits = _segment_bits(bits)
    bucket_bits = min(segment_bits, max(8, (2 * max(1, tokens) // BUCKET_KEYS).bit_length()))
    size, inner = bits >> segment_bits, segment_bits - bucket_bits
    mask = np.uint64(size - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, got in _groups(batches):
            bitmap = np.zeros((1 << inner, size), bool)
            for least in (1, LEAST):
                own = got.filter(pc.equal(got.column("least"), least))
                raw = np.frombuffer(b"".join(own.column("keys").to_pylist()), np.uint8).reshape(-1, KEY_BYTES)
                h = np.zeros((len(raw), 8), np.uint8)
                h[:, :KEY_BYTES] = raw
                h, back = np.unique(h.reshape(-1).view(">u8").astype(np.uint64), return_inverse=True)
                c = np.bincount(back, np.frombuffer(b"".join(own.column("counts").to_pylist()), "<u4"), len(h))
                h, c = h[c >= least], c[c >= least]
                level, row = 1 + np.floor(np.log2(c)).astype(np.int64), ((h >> np.uint64(64 - segment_bits)) & np.uint64((1 << inner) - 1)).astype(np.int64)
                for k in range(1, int(level.max(initial=0)) + 1):
                    has = level >= k
                    for place in _places(h[has], k, mask):
                        bitmap[row[has], place] = True
            parts = [np.packbits(x, bitorder="little").tobytes() for x in bitmap]
            yield pa.RecordBatch.from_arrays([pa.array(((bucket << inner) + np.arange(1 << inner)).astype(np.int32)), pa.array(parts, pa.binary())], names=["segment", "bits"])

    packed = _blocks(docs, counts, bucket_bits).repartition("bucket").sortWithinPartitions("bucket")
    return packed.mapInArrow(released(run), "segment int, bits binary")


def build_filter(table: DataFrame, bits: int) -> np.ndarray:
    """The filter's bytes."""
    size, got = bits >> _segment_bits(bits), table.toArrow()
    out = np.zeros(bits >> 3, np.uint8)
    for segment, part in zip(got.column("segment").to_pylist(), got.column("bits").to_pylist(), strict=True):
        out[segment * (size >> 3) : (segment + 1) * (size >> 3)] = np.frombuffer(part, np.uint8)
    return out


def _levels(bitmap: np.ndarray, base: np.ndarray, size: int, h: np.ndarray) -> np.ndarray:
    """The last level of each key that is there; base: where its segment of size bits begins."""
    level, live, mask = np.zeros(len(h), np.int64), np.arange(len(h)), np.uint64(size - 1)
    k = 0
    while len(live) and k < 62:
        k += 1
        ok = np.ones(len(live), bool)
        for place in _places(h[live], k, mask):
            bit = base[live] + place
            ok &= ((bitmap[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1).astype(bool)
        live = live[ok]
        level[live] = k
    return level


def _middle(level: np.ndarray) -> np.ndarray:
    low = 2.0 ** np.maximum(0, level - 1)
    return np.where(level == 0, 0.0, np.sqrt(low * np.maximum(1, 2 * low - 1)))


def probe(bitmap: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Counts as the filter has them: the middle of the last level that is there, 0 if there is none."""
    bits = len(bitmap) * 8
    size = bits >> _segment_bits(bits)
    base = (h >> np.uint64(64 - _segment_bits(bits))).astype(np.int64) * size
    return _middle(_levels(bitmap, base, size, h))


class Model:
    """What scoring needs: the filter (its bytes, or none if it is a table), totals, and exact counts of the most frequent tokens."""

    def __init__(self, bitmap: np.ndarray | None, tokens: int, types: int, texts: int, keys: np.ndarray, counts: np.ndarray, bits: int = 0, table: DataFrame | None = None):
        self.bits, self.table = bits, table
        self.bitmap, self.tokens, self.types, self.texts, self.keys, self.counts = bitmap, tokens, types, texts, keys, counts

    def __getstate__(self) -> dict:
        return self.__dict__ | {"table": None}  # of no use in a task

    def log_probabilities(self, token: np.ndarray, before: np.ndarray, offsets: np.ndarray, asked: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
        """asked: sorted keys and their levels, where the filter is a table."""
        count_of = (lambda h: probe(self.bitmap, h)) if asked is None else (lambda h: _middle(asked[1][np.searchsorted(asked[0], h)]))
        own, back = np.unique(token, return_inverse=True)
        count = count_of(_cut(_single(own)))
        p = (count + 1) / (self.tokens + self.types + 1)
        known = np.concatenate([own, [START]])
        order = np.argsort(known)
        at = order[np.minimum(np.searchsorted(known, before, sorter=order), len(known) - 1)]  # what stands before is a token of the text or its start
        c_before = np.concatenate([count, [float(self.texts)]])[at]
        whole = _pair(before, token)
        pairs, pair_back = np.unique(_cut(whole), return_inverse=True)
        c_pair = np.minimum(count_of(pairs)[pair_back], c_before)
        p = (c_pair + MU * p[back]) / (c_before + MU)
        at = _inner(offsets)
        c_last, c_triple = c_pair[at - 1], np.zeros(len(at))
        ask = np.flatnonzero((c_last >= LEAST) & (c_pair[at] >= LEAST))
        if len(ask):
            triples, triple_back = np.unique(_cut(_triple(whole[at[ask] - 1], token[at[ask]])), return_inverse=True)
            c_triple[ask] = np.minimum(count_of(triples)[triple_back], np.minimum(c_last[ask], c_pair[at[ask]]))
        p[at] = (c_triple + MU_3 * p[at]) / (c_last + MU_3)
        return np.log10(np.minimum(1.0, p))


def train(docs: DataFrame, max_bits: int = MAX_BITS) -> tuple[Model, DataFrame]:
    """The model of all rows of ``text``, and the exact counts (h, c) of all tokens as a table."""
    counts = save(_counts(docs).groupBy("h").agg(F.sum("c").alias("c")))
    level = F.floor(F.log2("c") * 8).cast("int")
    by_level = sorted(counts.groupBy(level.alias("level")).agg(F.count("*").alias("rows"), F.sum("c").alias("c")).collect(), key=lambda r: -r["level"])
    tokens, types = sum(r["c"] for r in by_level), sum(r["rows"] for r in by_level)
    least, rows = 10_000, 0
    for r in by_level:
        if (rows := rows + r["rows"]) > TABLE_ROWS:
            break
        least = r["level"]
    top = counts.where(level >= least).toArrow()
    keys, c = top.column("h").to_numpy().astype(np.int64).view(np.uint64), top.column("c").to_numpy().astype(np.int64)
    order = np.argsort(keys)
    end = dict(zip(keys.tolist(), c.tolist(), strict=True)).get(int(END))
    texts = end if end is not None else docs.count()
    bits = max(1 << 22, 1 << (4 * max(1, tokens) - 1).bit_length())
    own = segments(docs, counts, tokens, bits)
    bitmap, table = (build_filter(own, bits), None) if bits <= max_bits else (None, save(own))
    return Model(bitmap, tokens, types, texts, keys[order], c[order], bits, table), counts


def _scored(m: Model, w: Words, serial: pa.Array, ids: pa.Array, asked: tuple[np.ndarray, np.ndarray] | None) -> pa.RecordBatch:
    token, before, off = _tokens(w)
    rows = len(off) - 1
    row = np.repeat(np.arange(rows), np.diff(off))
    at = np.minimum(np.searchsorted(m.keys, token), max(0, len(m.keys) - 1))
    hit = m.keys[at] == token if len(m.keys) else np.zeros(len(token), bool)
    exact = np.where(hit, m.counts[at], 0) if len(m.keys) else np.zeros(len(token))
    base = np.bincount(row, np.log10(exact + 1.0), rows)
    known = np.bincount(row[hit], minlength=rows)
    total = np.bincount(row, m.log_probabilities(token, before, off, asked), rows)
    rest = np.flatnonzero(~hit)  # in row order
    rest = rest[np.lexsort((token[rest], row[rest]))]
    new = np.ones(len(rest), bool)
    new[1:] = (token[rest[1:]] != token[rest[:-1]]) | (row[rest[1:]] != row[rest[:-1]])
    first = np.flatnonzero(new)
    often = np.diff(np.append(first, len(rest)))
    ends = np.concatenate([[0], np.cumsum(np.bincount(row[rest[first]], minlength=rows))]).astype(np.int32)
    pairs = pa.StructArray.from_arrays([pa.array(signed(token[rest[first]]), pa.int64()), pa.array(often, pa.int64())], names=["h", "n"])
    arrays = [serial, ids, pa.array(np.diff(off)), pa.array(known.astype(np.int64)), pa.array(base), pa.array(total), pa.ListArray.from_arrays(pa.array(ends), pairs)]
    return pa.RecordBatch.from_arrays(arrays, names=["row", "id", "n_tokens", "known", "base", "score", "rest"])


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Table]]:
    """The rows of each value of the first column, by which they are in order."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        key = batch.column(0).to_numpy()
        cuts = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(key)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if b > a:
                if held and held[0].column(0)[0].as_py() != int(key[a]):
                    yield held[0].column(0)[0].as_py(), pa.Table.from_batches(held)
                    held = []
                held.append(batch.slice(a, b - a))
    if held:
        yield held[0].column(0)[0].as_py(), pa.Table.from_batches(held)


def _asked(plain: DataFrame, model: Model, shared, schema: str) -> DataFrame:
    """Scores where the filter is a table: blocks of documents send their distinct keys to the segments, which send levels back."""
    segment_bits = _segment_bits(model.bits)
    size, shift = model.bits >> segment_bits, min(segment_bits, max(BUCKETS, segment_bits - BUCKETS))
    rows = save(plain.withColumn("row", F.monotonically_increasing_id()))
    blocks = 1 + (rows.agg(F.sum(F.length("text"))).first()[0] or 0) // BLOCK_CHARS
    rows = rows.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks)))

    def keys_of(texts: pa.ChunkedArray) -> np.ndarray:
        held = []
        for w in words(texts):
            token, before, off = _tokens(w)
            pair, at = _pair(before, token), _inner(off)
            held.append(np.unique(_cut(np.concatenate([pair, _triple(pair[at - 1], token[at]), _single(token)]))))
        return np.unique(np.concatenate(held)) if held else np.zeros(0, np.uint64)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, got in _groups(batches):
            h = keys_of(got.column("text"))
            bucket, first = np.unique(h >> np.uint64(64 - shift), return_index=True)
            parts = [h[a:b].tobytes() for a, b in zip(first, [*first[1:], len(h)], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(bucket.astype(np.int64)), pa.array(np.full(len(bucket), block)), pa.array(np.full(len(bucket), -1, np.int32)), pa.array(parts, pa.binary())], names=["bucket", "block", "segment", "bits"])

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, bitmap = None, np.zeros(0, np.uint8)
        for batch in batches:
            out: list[list] = [[], [], []]
            for bucket, block, segment, bits in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if bucket != here:
                    here, bitmap = bucket, np.zeros((size >> 3) << (segment_bits - shift), np.uint8)
                if segment >= 0:  # segments stand before keys
                    a = (segment - (bucket << (segment_bits - shift))) * (size >> 3)
                    bitmap[a : a + (size >> 3)] = np.frombuffer(bits, np.uint8)
                    continue
                h = np.frombuffer(bits, np.uint64)
                base = ((h >> np.uint64(64 - segment_bits)).astype(np.int64) - (bucket << (segment_bits - shift))) * size
                for held, x in zip(out, (block, bucket, _levels(bitmap, base, size, h).astype(np.uint8).tobytes()), strict=True):
                    held.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.binary())], names=["block", "bucket", "levels"])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, got in _groups(batches):
            levels = np.frombuffer(b"".join(x for x in got.column("levels").to_pylist() if x is not None), np.uint8)  # in the order of the keys
            own = got.filter(pc.is_valid(got.column("row"))).combine_chunks()
            texts, ids, serial = (pa.concat_arrays(own.column(c).chunks) for c in ("text", "id", "row"))
            asked = keys_of(texts), levels.astype(np.int64)
            for w in words(texts):
                n = w.last - w.first
                yield _scored(shared.value, w, serial.slice(w.first, n), ids.slice(w.first, n), asked)

    dealt = rows.select("block", "text").repartition("block").sortWithinPartitions("block")
    keys = dealt.mapInArrow(released(ask), "bucket long, block long, segment int, bits binary")
    table = model.table.select(F.shiftright(F.col("segment"), segment_bits - shift).cast("long").alias("bucket"), F.lit(-1).cast("long").alias("block"), "segment", "bits")
    levels = keys.unionByName(table).repartition("bucket").sortWithinPartitions("bucket", "block").mapInArrow(released(answer), "block long, bucket long, levels binary")
    both = levels.unionByName(rows.select("block", "row", "id", "text"), allowMissingColumns=True)
    return both.repartition("block").sortWithinPartitions("block", "bucket").mapInArrow(released(finish), schema)


def score(docs: DataFrame, model: Model, counts: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, n_known, train_tokens, base_score, score) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        serial = TaskContext.get().partitionId() << 40
        for batch in batches:
            for w in words(batch.column(1)):
                rows = w.last - w.first
                yield _scored(shared.value, w, pa.array(serial + np.arange(rows)), batch.column(0).slice(w.first, rows), None)
                serial += rows

    schema = "row long, id long, n_tokens long, known long, base double, score double, rest array<struct<h:long,n:long>>"
    plain = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    scored = save(plain.mapInArrow(released(run), schema) if model.table is None else _asked(plain, model, shared, schema))
    rare = scored.select("row", F.explode("rest").alias("x")).select("row", "x.h", "x.n").join(counts.hint("merge"), "h")
    rare = rare.groupBy("row").agg(F.sum("n").alias("more"), F.sum(F.col("n") * F.log10(F.col("c") + F.lit(1.0))).alias("plus"))
    log_all = F.log10(F.lit(float(model.tokens + model.types + 1)))
    return scored.drop("rest").join(rare.hint("merge"), "row", "left").select(
        F.col("id").alias(id_col), "n_tokens", (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"), F.lit(model.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("plus", F.lit(0.0)) - F.col("n_tokens") * log_all).alias("base_score"), "score",
    )


def held_out(id_col: str = "doc_id") -> Column:
    """Documents from which nothing is learned."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 7 == 2, F.lit(False))
