"""Periodic runs of words by a descending-LCP Kruskal over the suffixes of each text.

Suffixes of a text are sorted by doubled ranks; neighbours in that order are edges that weigh their longest common prefix (LCP).
Edges are taken by falling LCP, and a union-find unites the classes of suffixes that share a prefix of that length. Each class
keeps its positions in order, and the smaller one is merged into the larger. Positions p < q that become neighbours at an LCP
of l, with q - p <= l, seed a run: words q - p apart are equal from p on for l words and no further, so it ends at q + l, and it
begins at p if the word before p breaks the period. A run's first position and the one a period later have no other position
of their class between them (the period would not be the smallest), so every run is seeded at its beginning, once.

Edges that weigh less than any run of the asked length needs are left out; so are positions whose word n-gram of about that
length occurs once in the text, as no suffix shares so long a prefix with them.

Texts are worked in row ranges of a few MB, a long text alone, and never cut. Words are compared by their bytes.

Defined results: words are runs of characters other than blanks and \\t to \\r; a null text or one without words has no run and
an empty collapsed text; repeated rows and null ids are rows of their own; an empty table gives none. Columns that clash with
a made one give way to it.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylight.llm.frames import extend, inputs_of
from quarrylight.llm.words import SLICE_BYTES, row_slices, text_buffers

WORD = r"[^\x20\x09-\x0D]+"
MADE = "n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


@dataclass
class _Words:
    """Words of some rows: bytes, places, offsets by row, and a code for each word that is equal where the words are."""

    buf: np.ndarray
    start: np.ndarray
    end: np.ndarray
    bounds: np.ndarray
    code: np.ndarray


def _words(data: np.ndarray, off: np.ndarray) -> _Words:
    """data: texts that each end in a blank."""
    ink = ~_SPACE[data]
    edge = np.diff(np.concatenate([[0], ink.view(np.int8)]))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    plain, cut = data[ink], np.concatenate([[0], np.cumsum(end - start)]).astype(np.int64)
    each = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(cut), pa.py_buffer(np.ascontiguousarray(plain))])
    code = each.dictionary_encode().indices.to_numpy() if len(start) else np.zeros(0)
    return _Words(data, start, end, np.searchsorted(start, off), code.astype(np.int64))


def least_lcp(times: int, least: int) -> int:
    """The smallest LCP of two positions a period apart in a run of ``times`` periods and ``least`` words."""
    return min(max((times - 1) * d, least - d, d) for d in range(1, least + 1))


def _classes(code: np.ndarray, row: np.ndarray, least: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """(positions, ranks by level): level k ranks the word sequences of 2**k words; the last level tells all positions apart.

    Positions are those whose sequence of the greatest power of two up to ``least`` words occurs again in its row, in suffix order.
    """
    n = len(code)
    active, key, more = np.arange(n), row * (int(code.max(initial=0)) + 1) + code, np.zeros(n, np.int64)
    rank, levels, kept, width = np.zeros(n + 1, np.int64), [], np.arange(n), 1
    rank[n] = -1
    own = np.concatenate([row, [-1]])
    while True:
        order = np.lexsort((more, key)) if levels else np.argsort(key, kind="stable")
        a, k, m = active[order], key[order], more[order]
        old = np.ones(len(a), bool)
        old[1:] = k[1:] != k[:-1]
        new = old.copy()
        new[1:] |= m[1:] != m[:-1]
        index = np.arange(len(a))
        first = np.maximum.accumulate(np.where(new, index, 0))
        rank[a] = first if not levels else k + first - np.maximum.accumulate(np.where(old, index, 0))
        levels.append(rank.astype(np.int32 if n < 1 << 31 else np.int64))
        last = np.ones(len(a), bool)
        last[:-1] = new[1:]
        active = np.sort(a[~(new & last)])
        if width <= least:
            kept = active
        if not len(active):
            return kept[np.argsort(rank[kept])], levels
        then = np.minimum(active + width, n)
        key, more = rank[active], np.where(own[then] == row[active], rank[then], -1)
        width *= 2


def _common(a: np.ndarray, b: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    """The longest common prefixes of suffixes of a row."""
    length, end = np.zeros(len(a), np.int64), len(levels[0]) - 1
    for k in range(len(levels) - 2, -1, -1):
        x, y = np.minimum(a + length, end), np.minimum(b + length, end)
        length += np.where(levels[k][x] == levels[k][y], 1 << k, 0)
    return length


def _kruskal(edges: Iterator[tuple[int, int, int]]) -> Iterator[tuple[int, int, int]]:
    """(p, q, lcp) of positions that become neighbours in a class, at distance within the LCP; edges by falling LCP."""
    up: dict[int, int] = {}
    held: dict[int, list[int]] = {}
    for a, b, lcp in edges:
        for x in (a, b):
            if x not in up:
                up[x], held[x] = x, [x]
        while up[a] != a:
            up[a] = a = up[up[a]]
        while up[b] != b:
            up[b] = b = up[up[b]]
        if len(held[a]) < len(held[b]):
            a, b = b, a
        large, small = held[a], held.pop(b)
        up[b] = a
        places = [bisect_left(large, x) for x in small]
        for n, (x, at) in enumerate(zip(small, places, strict=True)):
            if at and (not n or places[n - 1] < at) and x - large[at - 1] <= lcp:
                yield large[at - 1], x, lcp
            if at < len(large) and (n + 1 == len(small) or places[n + 1] > at) and large[at] - x <= lcp:
                yield x, large[at], lcp
        if len(small) * 8 < len(large):
            for x in small:
                insort(large, x)
        else:
            held[a] = sorted(large + small)


def runs(code: np.ndarray, bounds: np.ndarray, times: int, least: int) -> np.ndarray:
    """(row, start, length, period) of all runs of ``times`` periods and ``least`` words at least, in this order; starts by row.

    code: a number for each word; bounds: offsets of the rows.
    """
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    lowest = least_lcp(times, least)
    places, levels = _classes(code, row, lowest)
    if len(places) < 2:
        return np.zeros((0, 4), np.int64)
    a, b = places[:-1], places[1:]
    same = row[a] == row[b]
    a, b = a[same], b[same]
    lcp = _common(a, b, levels)
    order = np.argsort(-lcp, kind="stable")
    order = order[lcp[order] >= lowest]
    seeds = np.array(list(_kruskal(zip(a[order].tolist(), b[order].tolist(), lcp[order].tolist(), strict=True))), np.int64).reshape(-1, 3)
    p, q, lcp = seeds.T
    length, period = lcp + q - p, q - p
    first = p == bounds[row[p]]
    keep = (length >= np.maximum(least, times * period)) & (first | (code[p - 1] != code[q - 1]))
    out = np.stack([row[p], p - bounds[row[p]], length, period], 1)[keep]
    return out[np.lexsort((out[:, 3], out[:, 1], out[:, 0]))]


def _joined(w: _Words, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets by row) of the kept words of each row, joined by one blank."""
    start, size = w.start[keep], w.end[keep] - w.start[keep] + 1
    upto = np.cumsum(size)
    row = np.concatenate([[0], np.cumsum(keep)])[w.bounds]
    off = np.concatenate([[0], upto])[row]
    some = np.diff(row) > 0
    ends = upto - 1
    last = np.zeros(len(size), bool)
    last[row[1:][some] - 1] = True
    out = np.empty(int(upto[-1]) if len(upto) else 0, np.uint8)
    for i in range(0, len(size), 1 << 17):  # a block of words at a time
        j = min(len(size), i + (1 << 17))
        begin = upto[i:j] - size[i:j]
        out[begin[0] : upto[j - 1]] = w.buf[np.arange(begin[0], upto[j - 1]) - np.repeat(begin - start[i:j], size[i:j])]
    out[ends] = 32
    return np.delete(out, ends[last]), off - np.concatenate([[0], np.cumsum(some)])


def find_runs(docs: DataFrame, text: str = "text", times: int = 4, least: int = 6, carry: list[str] | None = None) -> DataFrame:
    """The carried columns (all, if None) and (n_words, runs, collapsed).

    A run is a stretch of words with smallest period q, of ``times`` periods and ``least`` words at least, that no neighbouring
    word extends; runs are in order of start, then period, counted in words from 0. collapsed: the words that stand in no run after
    its first period, joined by a blank.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            (col,) = inputs_of(batch, 1)
            data, off = text_buffers(pc.binary_join_element_wise(pc.fill_null(col.cast(pa.large_string()), ""), pa.scalar(" ", pa.large_string()), pa.scalar("", pa.large_string())))
            for i, j in row_slices(off, SLICE_BYTES):
                w = _words(data[off[i] : off[j]], off[i : j + 1] - off[i])
                found = runs(w.code, w.bounds, times, least)
                step = np.zeros(len(w.code) + 1, np.int64)
                begin = w.bounds[found[:, 0]] + found[:, 1]
                np.add.at(step, begin + found[:, 3], 1)
                np.add.at(step, begin + found[:, 2], -1)
                out, cut = _joined(w, np.cumsum(step)[:-1] == 0)
                fields = pa.StructArray.from_arrays([pa.array(found[:, k]) for k in (1, 2, 3)], ["start", "length", "period"])
                lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(found[:, 0], np.arange(j - i + 1)).astype(np.int32)), fields)
                collapsed = pa.Array.from_buffers(pa.large_string(), j - i, [None, pa.py_buffer(cut.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(out))])
                yield batch, i, j, [pa.array(np.diff(w.bounds).astype(np.int64)), lists, collapsed.cast(pa.string())]

    return extend(docs, [F.col(f"`{text}`").cast("string")], MADE, run, carry)


def with_period(text: Column, key: Column, share: int = 10) -> Column:
    """The text, of which from some word on a stretch is said again and again where the key's checksum says so: runs to be found.

    With h = crc32(key), n words and g = h // share, texts with h % share = 0 keep a = g % n words, and p = 1 + (n - a) // (3 + g % 8)
    words then repeat up to n words. Other texts, and those of null keys, stay as they are.
    """
    h = F.crc32(key.cast("string").cast("binary"))
    g = F.floor(h / share)
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))

    def again(w: Column) -> Column:
        n = F.size(w).cast("long")
        a = (g % n).cast("int")
        p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
        tail = F.flatten(F.array_repeat(F.slice(w, a + 1, p), F.ceil((n - a) / p).cast("int")))
        return F.array_join(F.concat(F.slice(w, 1, a), F.slice(tail, 1, (n - a).cast("int"))), " ")

    return F.when((h % share == 0) & text.rlike(WORD), F.get(F.transform(F.array(words), again), 0)).otherwise(text)


def digests(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, n_runs, the longest run's start, length, period and exponent, digests of the runs and of the collapsed text)."""
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")]), F.lit("\n"))), "")
    rows = found.select(key, "runs", "collapsed", best.alias("best"))
    length, period = F.col("best.length"), -F.col("best.period")
    return rows.select(
        key, F.size("runs").cast("long").alias("n_runs"), (-F.col("best.start")).alias("start"), length.alias("length"), period.alias("period"),
        F.floor(1000 * length / period).alias("exponent_milli"), F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
