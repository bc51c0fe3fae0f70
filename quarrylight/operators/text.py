"""Text cleaning, exact and near duplicates."""

from __future__ import annotations

import ctypes
import gc
import hashlib
import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarrylight.functions import domain
from quarrylight.functions.exprs import strip


KNOWN_TOKENS = 32_768  # whose votes a task remembers, 64 bytes each
CHUNK = 16_384  # tokens that are summed at once


def scrub(text: Column, markers: list[str] = domain.MARKERS) -> Column:
    """Without markers of sources and sections, tags, entities and control characters; blanks and tabs collapse, lines stay."""
    out = F.coalesce(text, F.lit(""))
    for m in markers:
        out = F.regexp_replace(out, m, "")
    out = F.regexp_replace(F.regexp_replace(out, r"<[^>]+>", ""), r"&[A-Za-z]+;", " ")
    return strip(F.regexp_replace(F.regexp_replace(out, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", ""), r"[ \t]+", " "))


def sentences(docs: DataFrame, delimiters: str = r"[。；\n]", id_col: str = "doc_id", carry: list[Column] = ()) -> DataFrame:
    """(id, pos, sentence) and what is carried, trimmed and not empty."""
    rows = docs.select(id_col, *carry, F.posexplode(F.split("text", delimiters, -1)).alias("pos", "sentence"))
    return rows.withColumns({"pos": F.col("pos").cast("long"), "sentence": F.trim("sentence")}).where("sentence <> ''")


def noise_lines(lines: DataFrame, words: list[str] = domain.NAV_WORDS, blocks: list[str] = domain.NOISE_BLOCKS, licence: str = domain.LICENCE, least: int = 3, high: Column | None = None, most_of_high: int = 5) -> DataFrame:
    """Lines that aren't noise: noise has so many words of navigation, begins like a block of it, is a short line with a
    licence number, or a short one of Latin letters and signs. A line of a source of high value with few such words stays.
    """
    s = F.col("sentence")
    n = sum((F.contains(s, F.lit(w)).cast("int") for w in words), F.lit(0))
    noise = (n >= least) | ((F.length(s) < 30) & s.rlike(r"^[a-zA-Z\s&;,.>/\-=_()]+$"))
    for p in blocks:
        noise = noise | s.rlike(p)
    if licence:
        noise = noise | ((F.length(s) < 50) & s.rlike(licence))
    return lines.where(~noise | ((high & (n < most_of_high)) if high is not None else F.lit(False)))


def exact_lines(lines: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The first of the lines of a document that are equal but for white space, if longer than 4 without it."""
    key = F.regexp_replace("sentence", r"\s+", "")
    return lines.where(F.length(key) > 4).groupBy(id_col, key.alias("key")).agg(F.min_by(F.struct(*lines.columns), "pos").alias("first")).select("first.*")


def drop_repeats(lines: DataFrame, id_col: str = "doc_id", least: int = 20, size: Column | None = None, least_size: int = 300) -> DataFrame:
    """Without all copies of lines that a document repeats, if their white-space-free form is longer than ``least``.

    With ``size``, only in documents that are longer than ``least_size``.
    """
    w = Window.partitionBy(id_col, "key")
    own = lines.withColumn("key", F.regexp_replace("sentence", r"\s+", "")).withColumn("n", F.count("*").over(w))
    kept = (F.col("n") < 2) | (F.length("key") <= least)
    return own.where(kept | (size <= least_size) if size is not None else kept).drop("key", "n")


class Fingerprints:
    """The tokens' votes, +1 or -1 for each md5 bit, of the KNOWN_TOKENS that came last, and sums of them for many texts at once."""

    def __init__(self, token: str) -> None:
        self.find, self.place, self.votes = re.compile(token).findall, {}, np.empty((KNOWN_TOKENS, 64), np.int8)

    def learn(self, new: list[str]) -> None:
        bits = np.frombuffer(b"".join([hashlib.md5(t.encode()).digest()[8:] for t in new]), np.uint8).reshape(-1, 8)
        n = len(self.place)
        self.votes[n : n + len(new)] = 2 * np.unpackbits(bits, axis=1).view(np.int8) - 1
        self.place.update(zip(new, range(n, n + len(new))))

    def of(self, texts: pd.Series) -> np.ndarray:
        sums, some = np.zeros((len(texts), 64), np.int64), np.zeros(len(texts), bool)
        flat, starts, rows = [], [], []

        def add() -> None:
            if flat:
                sums[rows] += np.add.reduceat(self.votes[flat], starts, axis=0, dtype=np.int64)
                flat.clear(), starts.clear(), rows.clear()

        for k, x in enumerate(texts):
            tokens = self.find(x) if x else []
            for i in range(0, len(tokens), CHUNK):
                part = tokens[i : i + CHUNK]
                new = [t for t in set(part) if t not in self.place]
                if len(self.place) + len(new) > KNOWN_TOKENS:
                    add()
                    self.place.clear()
                    new = list(set(part))
                if new:
                    self.learn(new)
                some[k] = True
                starts.append(len(flat)), rows.append(k)
                flat.extend(map(self.place.__getitem__, part))
                if len(flat) >= CHUNK:
                    add()
        add()
        return np.where(some, np.packbits(sums >= 0, axis=1).view(">i8")[:, 0], 0).astype(np.int64)


def simhash(text: Column, token: str = r"[A-Za-z]{2,}") -> Column:
    """Bit i is set if the votes of the tokens' md5 bits are not negative; 0 without tokens. Texts are worked where they are read.

    A session that has Spark's default size of Arrow batches, 64 MB, gets one of 8 MB, and workers, which are reused, give back
    what they have freed, so that they don't grow with the table.
    """
    size = "spark.sql.execution.arrow.maxBytesPerBatch"
    if (session := SparkSession.getActiveSession()) is not None and session.conf.get(size).removesuffix("b") == str(64 << 20):
        session.conf.set(size, str(8 << 20))

    @F.pandas_udf("long")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known = Fingerprints(token)
        try:
            for batch in batches:
                yield pd.Series(known.of(batch))
        finally:
            del known
            gc.collect()
            pa.default_memory_pool().release_unused()
            if (trim := getattr(ctypes.CDLL(None), "malloc_trim", None)) is not None:
                trim(0)

    return run(text)


def simhash64(docs: DataFrame, token: str = r"[A-Za-z]{2,}", id_col: str = "doc_id") -> DataFrame:
    """(id, simhash) of every row."""
    return docs.select(id_col, simhash(F.col("text"), token).alias("simhash"))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def close_pairs(rows: DataFrame, most: int = 3, within: list[str] = (), blocks: int = 6) -> DataFrame:
    """(within, id, simhash, id2, simhash2) of all pairs id < id2 that differ in few bits, each once.

    Of so many blocks of bits all but ``most`` at least are equal then, so rows meet in a table for each choice of blocks. Six blocks
    make 20 tables with keys of some 32 bits, so that buckets stay small among very many fingerprints; four make four of 16
    bits, enough among those of one document. A pair is taken from the first table whose blocks agree.
    """
    cuts = [64 * k // blocks for k in range(blocks + 1)]
    part = lambda c, k: F.shiftrightunsigned(c, cuts[k]).bitwiseAND((1 << (cuts[k + 1] - cuts[k])) - 1)
    choices = list(combinations(range(blocks), blocks - most))

    def key(n: int, choice: tuple[int, ...]) -> Column:
        out = part("simhash", choice[0])
        for k in choice[1:]:
            out = F.shiftleft(out, cuts[k + 1] - cuts[k]).bitwiseOR(part("simhash", k))
        return F.shiftleft(out, 5).bitwiseOR(F.lit(n).cast("long"))

    tables = rows.select(*within, "id", "simhash", F.explode(F.array(*[key(n, c) for n, c in enumerate(choices)])).alias("block"))
    other = tables.select(*within, F.col("id").alias("id2"), F.col("simhash").alias("simhash2"), "block")  # in the same order, so that one shuffle serves both
    equal = sum((F.when(part("simhash", k) == part("simhash2", k), 1 << k).otherwise(0) for k in range(blocks)), F.lit(0))
    first = [next((n for n, c in enumerate(choices) if all(mask >> k & 1 for k in c)), -1) for mask in range(1 << blocks)]
    pairs = tables.join(other.hint("merge"), [*within, "block"]).where("id < id2").where(hamming(F.col("simhash"), F.col("simhash2")) <= most)
    return pairs.where(F.col("block").bitwiseAND(31) == F.get(F.lit(first), equal)).drop("block")


def near_duplicates(hashes: DataFrame, most: int = 3, id_col: str = "doc_id") -> DataFrame:
    """(a, b): pairs of distinct fingerprints, each by its least id, that differ in few bits; equal ones are one row, so copies make no pairs."""
    reps = hashes.where("simhash <> 0").groupBy("simhash").agg(F.min(id_col).alias("id"))
    return close_pairs(reps, most).select(F.col("id").alias("a"), F.col("id2").alias("b"))


def preview_first(items: DataFrame, key: str, seq: str, text: str = "text", size: int = 80) -> DataFrame:
    """The first item of those whose first characters are equal, among items longer than that."""
    first = F.min_by(F.struct(*items.columns), seq).alias("first")
    return items.where(F.length(text) > size).groupBy(key, F.substring(text, 1, size).alias("preview")).agg(first).select("first.*")
