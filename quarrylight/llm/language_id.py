"""Language identification as inference over mixtures of languages.

Each language has byte trigram likelihoods, from counts over all training texts. For a document, expectation-maximisation
finds the proportions of the languages that explain its trigrams best; languages are then taken in by falling proportion
while the log-likelihood gains more than the penalty of one more language. One with a share under 1 % after ROUNDS rounds isn't
asked for, so up to that much of a text can be of a language that isn't listed.

Defined results: a null text, or one without any letter, is ``und`` with score 0; null ids and repeated rows are kept as
they are; where two languages explain a text alike, the one that sorts first wins; with no training row, every text is
``und``. The score is the proportion of the predicted language. The number of languages is taken to be small, as language
tags are; the model has a fixed number of slots for each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylight.llm.frames import extend, inputs_of, released
from quarrylight.llm.words import row_slices, text_buffers

SLOTS = 1 << 16
ROUNDS = 12
PENALTY = 3.0  # trigrams overlap, so a byte counts thrice

_FOLD = np.full(256, 32, np.uint8)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def _trigrams(col: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row, slots, bounds): slots of the byte trigrams by row; bytes that are no letters are blanks."""
    data, off = text_buffers(col)
    for i, j in row_slices(off):
        buf, own = _FOLD[data[off[i] : off[j]]].astype(np.uint32), off[i : j + 1] - off[i]
        if len(buf) < 3:
            yield i, j, np.zeros(0, np.int64), np.zeros(j - i + 1, np.int64)
            continue
        code = (buf[:-2] << 16) | (buf[1:-1] << 8) | buf[2:]
        row = np.repeat(np.arange(j - i), np.diff(own))
        keep = (row[:-2] == row[2:]) & (buf[1:-1] != 32)
        slot = ((code.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)).astype(np.int64)
        yield i, j, slot[keep], np.concatenate([[0], np.cumsum(np.bincount(row[:-2][keep], minlength=j - i))])


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], np.ndarray]:
    """(languages, likelihoods by slot and language) from all rows with a language and a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = np.array(batch.column(1).to_pylist(), object)
            for i, j, slots, bounds in _trigrams(batch.column(0)):
                by_row = np.repeat(langs[i:j], np.diff(bounds))
                for lang in set(langs[i:j]):
                    held[lang] = held.get(lang, 0) + np.bincount(slots[by_row == lang], minlength=SLOTS)
        for lang, c in held.items():
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(c[at].astype(np.int64))], names=["lang", "slot", "c"])

    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(text_col).cast("string"), F.col(lang_col).cast("string"))
    got = rows.mapInArrow(released(run), "lang string, slot int, c long").groupBy("lang", "slot").agg(F.sum("c").alias("c")).toArrow()
    langs = sorted(set(got.column("lang").to_pylist()))
    counts = np.full((SLOTS, max(1, len(langs))), 0.5)
    place = {x: k for k, x in enumerate(langs)}
    where = np.array([place[x] for x in got.column("lang").to_pylist()], np.int64)
    np.add.at(counts, (got.column("slot").to_numpy().astype(np.int64), where), got.column("c").to_numpy())
    return langs, (counts / counts.sum(0)).astype(np.float64)


def _em(p: np.ndarray, c: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, float]:
    """Proportions of the columns of p that explain c occurrences of its rows, and the log-likelihood."""
    share = np.full(p.shape[1], 1 / p.shape[1])
    for _ in range(rounds):
        share = share * (p.T @ (c / (p @ share))) / c.sum()
    return share, float(c @ np.log(p @ share))


def infer(slots: np.ndarray, prob: np.ndarray, penalty: float = PENALTY) -> tuple[list[int], np.ndarray]:
    """The set of languages, by falling proportion, and their proportions."""
    own, c = np.unique(slots, return_counts=True)
    p = prob[own]
    p = p / p.max(1, keepdims=True)
    if p.shape[1] == 1:
        return [0], np.ones(1)
    share, _ = _em(p, c)
    order = np.argsort(-share, kind="stable")
    alone = c @ np.log(p)
    chosen, part, best = [int(np.argmax(alone))], np.ones(1), float(alone.max())
    for lang in order:
        if int(lang) in chosen or share[lang] < 0.01:
            continue
        new, ll = _em(p[:, [*chosen, lang]], c)
        if ll - best <= penalty * 0.5 * np.log(c.sum() + 1) + penalty:
            break
        chosen, part, best = [*chosen, int(lang)], new, ll
    order = np.argsort(-part, kind="stable")
    return [chosen[k] for k in order], part[order]


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """The carried columns, lang_pred, score and langs, the whole set of languages with their proportions."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        langs, prob = shared.value
        for batch in batches:
            col = inputs_of(batch, 1)[0]
            for i, j, slots, bounds in _trigrams(col):
                texts = col.slice(i, j - i).to_pylist()
                pred, score, sets = [], [], []
                for k, text in enumerate(texts):
                    if not langs or not text or not any(map(str.isalpha, text)):
                        got, part = [], []
                    elif bounds[k] == bounds[k + 1]:
                        got, part = [0], [1.0 / len(langs)]
                    else:
                        got, part = infer(slots[bounds[k] : bounds[k + 1]], prob)
                    pred.append(langs[got[0]] if len(got) else "und")
                    score.append(min(1.0, float(part[0])) if len(got) else 0.0)
                    sets.append([{"lang": langs[g], "share": float(s)} for g, s in zip(got, part, strict=True)])
                yield batch, i, j, [pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(sets, pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())])))]

    return extend(docs, [F.col(text_col).cast("string")], "lang_pred string, score double, langs array<struct<lang:string,share:double>>", run, carry)


def held_out(id_col: str = "doc_id") -> Column:
    """Documents from which nothing is learned."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))
