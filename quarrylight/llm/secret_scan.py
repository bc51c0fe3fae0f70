"""Secret scans: fixed patterns, and sliding-window Shannon entropy per character class over candidate strings.

Kinds: ``assign``, ``access`` and ``hex`` are the fixed patterns. ``entropy`` spans come from candidate strings, maximal runs
of a character class that mix letters and digits or both cases: a window slides over the run, its counts change by one character in and
one out, and windows whose entropy reaches the class's threshold are joined, over classes too. A threshold is what some 99.5 % of
random windows over the class's alphabet reach. Spans of the classes with both cases need a fifth of their letters in each, as
random strings have and names hardly. Letters of one case only are no candidate: entropy doesn't tell them from words. A candidate that an allow-list pattern
matches whole, or of both cases that reads as words with few numbers, or whose span lies in one of another kind, is suppressed; the fixed kinds are never suppressed.

Defined results: a null or empty text has no spans; null ids and repeated rows are kept as they are; spans are in code
points of the whole text, end exclusive. Only the id and text columns are read, besides carried ones.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylight.llm.frames import extend, inputs_of

KINDS = ("assign", "access", "hex", "entropy")
SPANS = "array<struct<kind:string,start:long,end:long>>"
# class: its run of characters, the window, the least entropy of a window in bits
CLASSES = {
    "hexadecimal": (r"[0-9A-Fa-f]{16,}", 16, 2.6),
    "lower": (r"[a-z0-9]{16,}", 16, 3.05),
    "upper": (r"[A-Z0-9]{16,}", 16, 3.0),
    "mixed": (r"[A-Za-z0-9]{16,}", 16, 3.3),
    "base64": (r"[A-Za-z0-9+/=_-]{16,}", 16, 3.3),
}
BOTH_CASES, CASE_SHARE = ("mixed", "base64"), 0.2
_WORD = r"(?:[A-Z]?[a-z]+|[A-Z]+)"
# Candidates that are no secrets: identifiers of version 4, words joined by dashes or underscores or each with a capital, one character repeated.
ALLOW = (r"[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}", rf"{_WORD}(?:[-_/]{_WORD})*[-_/]?\d{{0,4}}", r"[A-Z]?[a-z]{2,}(?:[A-Z][a-z]{2,})*\d{0,4}", r"(.)\1+")
# Names, paths and titles of both cases: most letters in words with a vowel, in these short words or in these abbreviations; numbers short, few but at the end of a path's parts.
_SHORT = frozenset("a an as at by do for go id if in io is it me my no of on or so to up us we css dns ftp gif html http https jpg js pdf php png sql ssh tcp xml".split())
_VOWEL = re.compile("[aeiouyAEIOUY]")
_TOKEN = re.compile(r"([A-Z]+(?=[A-Z][a-z])|[A-Z]?[a-z]+|[A-Z]+)|([0-9]+)([-_/]|$)?|[^A-Za-z0-9]+")
WORD_SHARE, WORD_SIZE, NUMBER_SHARE, NUMBER_SIZE = 0.65, 3, 0.5, 4

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")


def entropy_spans(run: str, window: int, least: float) -> list[tuple[int, int]]:
    """Joined windows of the run whose Shannon entropy is high enough."""
    part = [0.0] + [n * math.log2(n) for n in range(1, window + 2)]
    counts: dict[str, int] = {}
    total, out = 0.0, []
    for i, c in enumerate(run):
        n = counts.get(c, 0)
        total += part[n + 1] - part[n]
        counts[c] = n + 1
        if i >= window:
            old = run[i - window]
            n = counts[old]
            total += part[n - 1] - part[n]
            counts[old] = n - 1
        if i >= window - 1 and math.log2(window) - total / window >= least:
            first = i - window + 1
            if out and first <= out[-1][1]:
                out[-1] = (out[-1][0], i + 1)
            else:
                out.append((first, i + 1))
    return out


def _even(span: str) -> bool:
    upper, lower = sum(c.isupper() for c in span), sum(c.islower() for c in span)
    return min(upper, lower) >= CASE_SHARE * (upper + lower)


def _named(run: str) -> bool:
    """Whether the run reads as words and a few numbers; one pass, however long it is."""
    words = letters = good = spare = numbers = 0
    parted = run.count("-") + run.count("_") + run.count("/") >= 2
    for m in _TOKEN.finditer(run):
        if w := m[1]:
            words, letters = words + 1, letters + len(w)
            short = w.lower() in _SHORT
            spare += short * (WORD_SIZE - len(w))
            good += len(w) * (short or len(w) >= 3 and _VOWEL.search(w) is not None)
        elif m[2]:
            if len(m[2]) > NUMBER_SIZE:
                return False
            numbers += not (parted and m[3] is not None)
    return good >= WORD_SHARE * letters > 0 and letters + max(0, spare) >= WORD_SIZE * words and numbers <= max(1, NUMBER_SHARE * words)


class Scanner:
    def __init__(self, classes: dict[str, tuple[str, int, float]], allow: tuple[str, ...]):
        self.classes = [(re.compile(p), w, h, k in BOTH_CASES) for k, (p, w, h) in classes.items()]
        self.allow = [re.compile(p) for p in allow]

    def spans(self, text: str) -> list[tuple[int, int, int]]:
        """(start, kind's place, end) in order."""
        out = []
        if ":" in text or "=" in text:
            out += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 12]
        if "AKIA" in text:
            out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18]
        out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
        base, more = list(out), []
        for find, window, least, both in self.classes:
            for m in find.finditer(text):
                run = m[0]
                if run.islower() and run.isalpha() or run.isupper() and run.isalpha() or run.isdigit() or not any(c.isalpha() for c in run) or any(a.fullmatch(run) for a in self.allow) or both and _named(run):
                    continue
                for a, b in entropy_spans(run, window, least):
                    if both and not _even(run[a:b]):
                        continue
                    a, b = a + m.start(), b + m.start()
                    if not any(x <= a and b <= y for x, _, y in base):
                        more.append((a, b))
        last = -1
        for a, b in sorted(more):
            if a <= last:
                out[-1] = (out[-1][0], 3, last := max(last, b))
            else:
                out.append((a, 3, last := b))
        return sorted(out)


def scan(docs: DataFrame, text_col: str = "text", carry: list[str] | None = None, classes: dict = CLASSES, allow: tuple[str, ...] = ALLOW, redact: str | None = None) -> DataFrame:
    """The carried columns and ``spans``; with ``redact``, also ``redacted``: the text with that in place of every span."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        scanner = Scanner(classes, allow)
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                texts = inputs_of(batch, 1)[0].slice(k, 256).to_pylist()
                found = [scanner.spans(t) if t else [] for t in texts]
                arrays = [pa.array([[{"kind": KINDS[p], "start": a, "end": b} for a, p, b in spans] for spans in found], SPAN_TYPE)]
                if redact is not None:
                    arrays.append(pa.array([t if not spans else _redacted(t, spans, redact) for t, spans in zip(texts, found, strict=True)], pa.string()))
                yield batch, k, k + len(texts), arrays

    return extend(docs, [F.col(text_col).cast("string")], f"spans {SPANS}" + (", redacted string" if redact is not None else ""), run, carry)


SPAN_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def _redacted(text: str, spans: list[tuple[int, int, int]], mark: str) -> str:
    out, at = [], 0
    for a, _, b in spans:
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join([*out, text[at:]])


def digests(scanned: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, n_assign, n_access, n_hex, base_sha256, spans) as text of what ``scan`` returns."""
    line = lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))
    base = F.filter("spans", lambda x: x["kind"] != "entropy")
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    sha = F.sha2(F.array_join(F.transform(base, line), ",").cast("binary"), 256).alias("base_sha256")
    return scanned.select(id_col, count("assign"), count("access"), count("hex"), sha, F.array_join(F.transform("spans", line), ",").alias("spans"))
