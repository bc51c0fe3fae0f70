"""N-gram Jaccard join: rare-first prefix filtering with length, positional and suffix filters.

A document's set holds the hashes of its distinct word n-grams. Sets are ordered rarest first: by how often the n-gram
is seen where it is frequent, else by the product of its words' frequencies, then by hash. Any total order gives the same
links; the two frequency tables behind it have a fixed number of rows, and every n-gram outside them still has its place.
Two sets can link only if their prefixes share an n-gram, so documents meet in the buckets of their prefix n-grams, and
each pair that passes the filters is verified once, on whole sets. Beside the length and positional filters stand three
bounds of the symmetric difference: parities of hashes, inside the join; counts of hashes by part, of the documents of its pairs; and the
suffix filter before verification.

Equal sets count as one class. Large groups of near copies are not turned into all their pairs: some rounds first verify
every member of a bucket against some pivots of it and contract what links; after that only pairs of still different
components are verified, each of them, so that no link that joins components is lost.

Defined results: a document without words (or null text) has an empty set and is linked with nothing; one of fewer than
n words has its whole sequence as its set; a null id has a null component and links nothing; rows that repeat an id and
text come back as often as they came; rows that share an id but not the text count as one node. Only the id and text
columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylight.llm.components import components, discard, save
from quarrylight.llm.frames import released
from quarrylight.llm.words import mix, ngrams, signed, words

TABLE_ROWS = 1 << 18  # rows at most in each of the two frequency tables that are broadcast
BLOCK = 1_000_000  # words that are counted together in a task
FREQUENT_IN_BLOCK = 3
MARK_BITS, MARK_PARTS = (1 << 23, 1 << 27), 16  # of the filter that picks documents to verify: at least and at most
PIVOTS = 6  # of a bucket in each round
PARITIES, FOLDED = 1024, 256  # of a document, and as its postings carry them
COUNTS = 1024  # parts of a set that are counted before whole sets are compared
_MEMBER = ["doc", "size", "pos", *(f"s{i}" for i in range(FOLDED // 64))]


def _frequencies(docs: DataFrame, n: int) -> DataFrame:
    """(kind, h, c): counts of words (0), and of n-grams that a block of a task has much more often than their words explain (1)."""

    def flush(held: list) -> Iterator[pa.RecordBatch]:
        h = np.concatenate([x for x, _ in held])
        ends = np.cumsum([0] + [len(x) for x, _ in held])
        bounds = np.concatenate([[0], *[b[1:] + e for (_, b), e in zip(held, ends, strict=False)]])
        own, back, count = np.unique(h, return_inverse=True, return_counts=True)
        grams, off = ngrams(h, bounds, n)
        alone = _window_sums(np.log2(count)[back] - np.log2(max(1, len(h))), bounds, n, off) + np.log2(max(1, len(h)))
        seen, first, often = np.unique(grams, return_index=True, return_counts=True)
        more = (often >= FREQUENT_IN_BLOCK) & (np.log2(often) >= alone[first] + 2)
        for kind, keys, c in ((0, own[count > 1], count[count > 1]), (1, seen[more], often[more])):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), kind, np.int32)), pa.array(signed(keys)), pa.array(c.astype(np.int64))], names=["kind", "h", "c"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        for batch in batches:
            for w in words(batch.column(0)):
                held.append((w.hash, w.bounds))
                if sum(len(x) for x, _ in held) >= BLOCK:
                    yield from flush(held)
                    held = []
        if held:
            yield from flush(held)

    return docs.select("text").mapInArrow(released(run), "kind int, h long, c long").groupBy("kind", "h").agg(F.sum("c").alias("c"))


def _tables(docs: DataFrame, n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For words and n-grams: sorted hashes, and log2 of their counts, of at most TABLE_ROWS rows each."""
    counts = save(_frequencies(docs, n))
    level = F.floor(F.log2("c") * 8).cast("int")
    sizes = counts.groupBy("kind", level.alias("level")).count().collect()  # a few hundred rows
    out = []
    for kind in (0, 1):
        least, rows = 10_000, 0
        for x in sorted((r for r in sizes if r["kind"] == kind), key=lambda r: -r["level"]):
            if (rows := rows + x["count"]) > TABLE_ROWS:
                break
            least = x["level"]
        got = counts.where((F.col("kind") == kind) & (level >= least)).select("h", "c").toArrow()
        h = got.column("h").to_numpy().astype(np.int64).view(np.uint64)
        order = np.argsort(h)
        out.append((h[order], np.log2(got.column("c").to_numpy().astype(np.float64)[order])))
    return out


def _look(table: tuple[np.ndarray, np.ndarray], h: np.ndarray, default: float) -> np.ndarray:
    keys, vals = table
    if not len(keys):
        return np.full(len(h), default)
    at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
    return np.where(keys[at] == h, vals[at], default)


def _window_sums(x: np.ndarray, bounds: np.ndarray, n: int, offsets: np.ndarray) -> np.ndarray:
    """Sums of x over the words of every n-gram; 0 for a row's only, short n-gram."""
    padded = np.concatenate([x, np.zeros(n)])
    total = np.zeros(len(x))
    for k in range(n):
        total += padded[k : k + len(x)]
    count, has = np.diff(bounds), np.diff(offsets)
    at = np.repeat(bounds[:-1], has) + (np.arange(offsets[-1]) - np.repeat(offsets[:-1], has))
    return np.where(np.repeat(count >= n, has), total[at], 0.0) if len(x) else np.zeros(0)


def _features(docs: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """(doc, size, digest, parity, prefix): the set's size, a digest and parities of it, and its rarest n-grams in order."""
    shared = docs.sparkSession.sparkContext.broadcast(_tables(docs, n))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word_table, gram_table = shared.value
        maybe = np.zeros(1 << 22, bool)
        maybe[gram_table[0] & np.uint64(len(maybe) - 1)] = True
        for batch in batches:
            for w in words(batch.column(1)):
                grams, off = ngrams(w.hash, w.bounds, n)
                key = _window_sums(_look(word_table, w.hash, 0.0), w.bounds, n, off)
                often = np.flatnonzero(maybe[grams & np.uint64(len(maybe) - 1)])
                key[often] += 1000 * _look(gram_table, grams[often], 0.0)  # frequent ones come last
                sizes, digests, parities, prefixes = [], [], [], []
                for a, b in zip(off[:-1], off[1:], strict=True):
                    own, first = np.unique(grams[a:b], return_index=True)
                    size = len(own)
                    sizes.append(size)
                    digests.append(hashlib.blake2b(own.tobytes(), digest_size=16).digest() if size else None)
                    parities.append(np.packbits((np.bincount((own & np.uint64(PARITIES - 1)).astype(np.int64), minlength=PARITIES) & 1).astype(np.uint8)))
                    keep = size - -(-num * size // den) + 1 if size else 0
                    prefixes.append(own[np.argsort(key[a + first], kind="stable")[:keep]])
                ends = np.concatenate([[0], np.cumsum([len(p) for p in prefixes])]).astype(np.int32)
                flat = signed(np.concatenate(prefixes)) if prefixes else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(w.first, w.last - w.first), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.FixedSizeListArray.from_arrays(pa.array(np.concatenate(parities).view(np.int64)), PARITIES // 64).cast(pa.list_(pa.int64())), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, pa.int64()))],
                    names=["doc", "size", "digest", "parity", "prefix"],
                )

    return docs.select("doc", "text").mapInArrow(released(run), "doc long, size long, digest binary, parity array<long>, prefix array<long>")


def _marks(ids: DataFrame, bits: int) -> np.ndarray:
    """A Bloom filter over document ids, as bytes; at most MARK_PARTS copies of it reach the driver, fewer of a larger one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(bits, bool)
        for batch in batches:
            for place in _places(batch.column(0), bits):
                own[place] = True
        yield pa.RecordBatch.from_arrays([pa.array([np.packbits(own, bitorder="little").tobytes()], pa.binary())], names=["bits"])

    out = np.zeros(bits // 8, np.uint8)
    for part in ids.coalesce(max(4, MARK_PARTS * MARK_BITS[0] // bits)).mapInArrow(released(run), "bits binary").toArrow().column("bits").to_pylist():
        out |= np.frombuffer(part, np.uint8)
    return out


def _places(ids: pa.Array, bits: int) -> list[np.ndarray]:
    h = mix(ids.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64))
    return [(x & np.uint64(bits - 1)).astype(np.int64) for x in (h, h >> np.uint64(20), mix(h))]


def _counts(own: np.ndarray) -> bytes:
    """How many members of a set fall in each of COUNTS parts, up to 255: the sum of differences is at most the symmetric difference."""
    return np.minimum(np.bincount((own & np.uint64(COUNTS - 1)).astype(np.int64), minlength=COUNTS), 255).astype(np.uint8).tobytes()


def _sets(docs: DataFrame, pairs: DataFrame, n: int, form: Callable[[np.ndarray], bytes] = np.ndarray.tobytes) -> DataFrame:
    """(doc, size, grams binary) of the documents of the pairs, and a few more: the whole set, sorted by hash, or what is made of it.

    The scan passes only documents that the filter may hold, so neither texts nor all sets are shuffled.
    """
    ids = pairs.select(F.col("a").alias("doc")).unionByName(pairs.select(F.col("b").alias("doc")))
    least, most = MARK_BITS
    bits = min(most, max(least, 1 << (16 * pairs.count()).bit_length()))  # past the most, more documents pass that aren't asked for
    shared = docs.sparkSession.sparkContext.broadcast(_marks(ids, bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            low, mid, high = (shared.value[p >> 3] >> (p & 7) for p in _places(batch.column(0), bits))
            batch = batch.filter(pa.array((low & mid & high & 1).astype(bool)))
            for w in words(batch.column(1)):
                grams, off = ngrams(w.hash, w.bounds, n)
                own = [np.unique(grams[a:b]) for a, b in zip(off[:-1], off[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(w.first, w.last - w.first), pa.array([len(x) for x in own], pa.int64()), pa.array([form(x) for x in own], pa.binary())], names=["doc", "size", "grams"])

    return docs.select("doc", "text").where("doc IS NOT NULL").mapInArrow(released(run), "doc long, size long, grams binary")


def _apart(x: np.ndarray, y: np.ndarray, most: int, depth: int = 2) -> int:
    """Suffix filter: a lower bound of the symmetric difference of two sorted sets, from the parts around a median."""
    gap = abs(len(x) - len(y))
    if depth == 0 or gap > most or not len(x) or not len(y):
        return gap
    mid = len(y) // 2
    k = int(np.searchsorted(x, y[mid]))
    hit = k < len(x) and x[k] == y[mid]
    low = _apart(x[:k], y[:mid], most, depth - 1)
    return low + _apart(x[k + hit :], y[mid + 1 :], most - low, depth - 1) + (not hit)


def _near(pairs: DataFrame, counts: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose counts by part differ by no more than similar sets may: long sets that differ needn't be brought together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(-1, COUNTS).astype(np.int16) for k in (2, 3))
            total = batch.column(4).to_numpy()
            keep = np.abs(x - y).sum(1) <= total - 2 * -(-num * total // (num + den))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep))

    side = lambda k: counts.select(F.col("doc").alias(k), F.col("grams").alias(f"counts_{k}"), F.col("size").alias(f"size_{k}"))
    both = pairs.join(side("b").hint("merge"), "b").join(side("a").hint("merge"), "a")
    return both.select("a", "b", "counts_a", "counts_b", (F.col("size_a") + F.col("size_b")).alias("total")).mapInArrow(released(run), "a long, b long")


def _verified(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose whole sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, keep = batch.column(2), batch.column(3), []
            for i in range(batch.num_rows):
                x, y = np.frombuffer(a[i].as_buffer(), np.uint64), np.frombuffer(b[i].as_buffer(), np.uint64)
                need = -(-num * (len(x) + len(y)) // (num + den))
                apart = len(x) + len(y) - 2 * need
                keep.append(_apart(x, y, apart) <= apart and len(np.intersect1d(x, y, assume_unique=True)) >= need)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    x = sets.select(F.col("doc").alias("b"), F.col("grams").alias("grams_b"))
    y = sets.select(F.col("doc").alias("a"), F.col("grams").alias("grams_a"))
    both = pairs.join(x.hint("merge"), "b").join(y.hint("merge"), "a")
    return both.select("a", "b", "grams_a", "grams_b").mapInArrow(released(run), "a long, b long")


def _folded(i: int) -> Column:
    step = FOLDED // 64
    out = F.col("parity")[i]
    for k in range(i + step, PARITIES // 64, step):
        out = out.bitwiseXOR(F.col("parity")[k])
    return out


def _candidates(m: DataFrame, other: DataFrame, num: int, den: int, ordered: bool) -> DataFrame:
    """Distinct pairs of a bucket that pass the length and the positional filter; other has its columns with a ``2``."""
    need = F.ceil((F.col("size") + F.col("size2")) * num / (num + den) - 1e-9)
    rest = F.least(F.col("size") - F.col("pos"), F.col("size2") - F.col("pos2"))
    pairs = m.join(other.hint("merge"), "gram").where(F.col("comp") != F.col("comp2"))
    if ordered:
        pairs = pairs.where("doc < doc2")
    apart = sum((F.bit_count(F.col(f"s{i}").bitwiseXOR(F.col(f"s{i}2"))) for i in range(FOLDED // 64)), F.lit(0))
    if ordered:
        apart = F.greatest(apart, sum((F.bit_count(F.col("parity")[i].bitwiseXOR(F.col("parity2")[i])) for i in range(PARITIES // 64)), F.lit(0)))
    pairs = pairs.where(F.col("size") + F.col("size2") - 2 * need >= apart)
    pairs = pairs.where((F.least("size", "size2") * den >= F.greatest("size", "size2") * num) & (rest >= need))
    return pairs.select(F.least("doc", "doc2").alias("a"), F.greatest("doc", "doc2").alias("b")).distinct()


def _edges_of_ids(full: DataFrame, reps: DataFrame) -> DataFrame | None:
    """(a, b): ids that have several texts, each with the representatives of these; None if there is no such id."""
    several = save(full.groupBy("doc").agg(F.min("digest").alias("first"), F.max("digest").alias("last")).where("first <> last").select("doc"))
    if several.isEmpty():
        return None
    own = full.select("doc", "digest").join(several.hint("merge"), "doc", "left_semi")
    return save(own.join(reps.hint("merge"), "digest").select(F.col("doc").alias("a"), F.col("rep").alias("b")).distinct())


def ngram_join(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, rounds: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id): documents link when den * |intersection| >= num * |union|.

    component_id is the smallest id that links reach, the document's own included.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text"))
    feats = save(_features(docs, n, num, den))
    full = feats.where("digest IS NOT NULL AND doc IS NOT NULL")
    reps = save(full.groupBy("digest").agg(F.min("doc").alias("rep")))
    heads = full.join(reps.select(F.col("rep").alias("doc"), F.col("digest").alias("own")).hint("merge"), "doc").where("digest = own")
    posts = heads.select("doc", F.posexplode("prefix").alias("pos", "gram"))
    shared = posts.groupBy("gram").agg(F.min("doc").alias("low"), F.max("doc").alias("high")).where("low <> high").select("gram")
    folded = heads.select("doc", "size", *[_folded(i).alias(f"s{i}") for i in range(FOLDED // 64)])
    posts = save(posts.join(shared.hint("merge"), "gram", "left_semi").join(folded.hint("merge"), "doc").select("gram", *_MEMBER))
    same_id = _edges_of_ids(full, reps)
    edges = same_id
    for k in range(rounds + 1):
        m = posts.withColumn("comp", F.col("doc"))
        if edges is not None:
            known = components(edges).select(F.col("node").alias("doc"), "component")
            m = save(posts.join(known.hint("merge"), "doc", "left").select(*posts.columns, F.coalesce("component", "doc").alias("comp")))
        used = [m] if edges is not None else []
        low, high = F.min("comp").alias("low"), F.max("comp").alias("high")
        if k < rounds:
            pivots = [F.min(F.struct(F.xxhash64("doc", F.lit(PIVOTS * k + j)), *_MEMBER, "comp")) for j in range(PIVOTS)]
            other = m.groupBy("gram").agg(low, high, F.array(*pivots).alias("pivots")).where("low <> high")
            plain = F.transform("pivots", lambda p: F.struct(*[p[c].alias(f"{c}2") for c in [*_MEMBER, "comp"]]))
            other = other.select("gram", F.explode(F.array_distinct(plain)).alias("pivot")).select("gram", "pivot.*")
        else:  # whatever is still apart, all of it
            mixed = m.groupBy("gram").agg(low, high).where("low <> high").select("gram")
            m = save(m.join(mixed.hint("merge"), "gram", "left_semi").join(heads.select("doc", "parity").hint("merge"), "doc"))
            used.append(m)
            other = m.select("gram", *[F.col(c).alias(f"{c}2") for c in [*_MEMBER, "comp", "parity"]]).where("doc2 IS NOT NULL")
        pairs = save(_candidates(m, other, num, den, k == rounds))
        near = save(_near(pairs, _sets(docs, pairs, n, _counts), num, den))
        found = save(_verified(near, _sets(docs, near, n), num, den))
        discard(pairs, near, *used)
        edges = found if edges is None else edges.unionByName(found)
    discard(posts)
    labels = components(edges).select(F.col("node").alias("doc"), "component")
    named = reps.join(labels.select(F.col("doc").alias("rep"), "component").hint("merge"), "rep", "left")
    named = save(named.select("digest", F.coalesce("component", "rep").alias("component_id")))
    linked = full.select("doc", "size", "digest").join(named.hint("merge"), "digest").select("doc", "size", "component_id")
    alone = feats.where("digest IS NULL OR doc IS NULL").select("doc", "size", F.col("doc").alias("component_id"))
    return linked.unionByName(alone).select(F.col("doc").alias(id_col), F.col("size").alias("n_shingles"), "component_id")
