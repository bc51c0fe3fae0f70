"""Dictionaries as tables: all or the first of very many words in a text, by an Aho-Corasick automaton.

A dictionary's words are numbered in their order and read in blocks of at most about BLOCK_BYTES, each broadcast and made an automaton once
a worker; a larger dictionary takes several blocks, whose results are joined per row. The plan has a column a block, however many
words there are. Null texts count as empty; null and empty words and those with a line feed are left
out; of equal words the first counts.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylight.operators.ordering import ranked

BLOCK_BYTES = 8 << 20
KEPT_BLOCKS = 4  # in a Python worker
HIT = "struct<place:long,label:string>"
_BUILT: dict[int, _Block] = {}


class _Block:
    """Words in order with their places and labels."""

    def __init__(self, rows: list[tuple[int, str, str]]) -> None:
        self.places, words, self.labels = zip(*rows, strict=True)
        self.exact = {w: n for n, w in reversed(list(enumerate(words)))}
        self.automaton = ahocorasick.Automaton()
        for w, n in self.exact.items():
            self.automaton.add_word(w, n)
        self.automaton.make_automaton()
        self.blob = "\n".join(words)
        self.starts = [0]
        for w in words:
            self.starts.append(self.starts[-1] + len(w) + 1)

    def inside(self, text: str) -> list[int]:
        """The words that the text contains, in order."""
        return sorted({n for _, n in self.automaton.iter(text)})

    def around(self, text: str) -> list[int]:
        """The first word that contains the text, if any."""
        at = -1 if "\n" in text else self.blob.find(text)
        return [bisect_right(self.starts, at) - 1] if at >= 0 else []

    def first_either_way(self, text: str) -> list[int]:
        return sorted([*self.inside(text)[:1], *self.around(text)])[:1]


def _block(shared: Broadcast, key: int) -> _Block:
    if key not in _BUILT:
        while len(_BUILT) >= KEPT_BLOCKS:
            del _BUILT[next(iter(_BUILT))]
        _BUILT[key] = _Block(shared.value)
    return _BUILT[key]


class Terms:
    """A dictionary of (word, label), by default the word itself, in the given order; with ``fold``, case doesn't matter."""

    def __init__(self, table: DataFrame, order: list[Column], word: str = "word", label: str | None = None, fold: bool = False, block_bytes: int = BLOCK_BYTES) -> None:
        spark, self.fold = table.sparkSession, fold
        text = F.lower(word) if fold else F.col(word)
        rows = table.where(F.col(word) != "").withColumns({"_word": text, "_label": F.col(label or word).cast("string")})
        rows = ranked(rows, order, "_place").select("_place", "_word", "_label").where(~F.contains("_word", F.lit("\n")))
        rows = rows.groupBy("_word").agg(F.min(F.struct("_place", "_label")).alias("x")).select("x._place", "_word", "x._label")
        n, size = rows.agg(F.count("*"), F.sum(F.octet_length("_word") + F.octet_length(F.coalesce("_label", F.lit(""))))).first()
        blocks = max(1, -(-(size or 0) // block_bytes))
        self.blocks = []
        for k in range(blocks if n else 0):
            got = rows.where(F.floor((F.col("_place") - 1) * blocks / n) == k).orderBy("_place").collect()  # a block's bytes are bounded
            if got:
                self.blocks.append(spark.sparkContext.broadcast([tuple(r) for r in got]))

    def _column(self, text: Column, find: Callable[[_Block, str], list[int]], shared: Broadcast) -> Column:
        key, fold = shared._jbroadcast.id() if shared._jbroadcast is not None else id(shared), self.fold

        @F.arrow_udf(f"array<{HIT}>")
        def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            block = _block(shared, key)
            for batch in batches:
                found = [find(block, (x.lower() if fold else x) if x else "") for x in batch.to_pylist()]
                yield pa.array([[{"place": block.places[n], "label": block.labels[n]} for n in f] for f in found], pa.list_(pa.struct([("place", pa.int64()), ("label", pa.string())])))

        return run(text)

    def _all(self, text: Column, find: Callable[[_Block, str], list[int]]) -> Column:
        none = F.array().cast(f"array<{HIT}>")
        parts = [self._column(text, find, b) for b in self.blocks]
        return F.concat(*parts) if len(parts) > 1 else parts[0] if parts else none

    def found(self, text: Column) -> Column:
        """(place, label) of all words in the text, in the dictionary's order."""
        return self._all(text, _Block.inside)

    def first_label(self, text: Column) -> Column:
        """The label of the first word that the text contains, else ''."""
        return F.coalesce(F.get(self.found(text), F.lit(0))["label"], F.lit(""))

    def lookup(self, text: Column) -> Column:
        """The label of the equal word, else of the first word within the text or around it, else null; an empty text is within any word."""
        exact = self._all(text, lambda b, x: [b.exact[x]] if x in b.exact else [])
        return F.coalesce(F.get(exact, F.lit(0))["label"], F.get(self._all(text, _Block.first_either_way), F.lit(0))["label"])
