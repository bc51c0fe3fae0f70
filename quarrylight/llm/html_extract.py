"""Main text of pages: structure, and runs of tokens that repeat over the pages of a host.

A page becomes blocks of text; each stands in the article, outside it, or on a page whose article no element names. Blocks
inside chrome (menus, headers, footers, asides, forms, scripts, adverts, notices, comments, by element or by class and id words) are
left out. Inside an article only a container whose class or id is the very name of an advert, a notice, a share bar or comments is
chrome; elsewhere class words make no paragraph or heading chrome, nor an element that holds ``main``, or a h1 and two paragraphs.
The article is ``article`` or ``main``, else the deepest container of two thirds of the page's text and two blocks.

The token streams of a host's pages are one text, whose suffixes are ordered as far as RUN tokens, by hashes of doubled length. A run
is repeated if it stands outside articles on PAGES distinct pages of the host; pages with the same tokens, or the same id, are one page here.
Spark counts over the whole host, whatever its size. What repeats outside an article goes and its unique runs are kept. Inside an article
repetition removes nothing, as articles share passages and are copied whole. On a page whose article no element names, blocks that runs
cover whole go, unless no block has text of its own: those that are no paragraphs wherever they stand, paragraphs before the first and after the
last block with text of its own, if runs cover no more than half of the page (else it is a near copy).

Defined results: null or empty html gives an empty text; a null url counts as the empty host; null ids and repeated rows
are kept; a row without id is a page of its own unless its tokens are another's; an unclosed element ends with its
parent; markup that the page's end cuts off is dropped. Only the id, url and html columns are read.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylight.llm.components import discard, save
from quarrylight.llm.frames import released
from quarrylight.llm.url_filter import host_of
from quarrylight.llm.words import hash_spans, mix, signed

RUN, PAGES = 8, 3  # tokens of a run, a power of two; distinct pages that have it at least
ARTICLE, OUTSIDE, PARAGRAPH, OTHER = range(4)  # where a block stands; the last two on a page whose article no element names

# Fixed values of the markup language.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre search section summary table tbody td tfoot th thead title tr ul".split())
_CHROME = frozenset("nav header footer aside form menu dialog noscript button select head iframe svg template object canvas audio video".split())
_RAW = frozenset("script style textarea title xmp noembed noframes".split())
_WORDS = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisements?|sponsor(?:ed|s)?|promo(?:s|tion)?|banner|cookies?|consent|gdpr|notices?|notification|alert|popup|modal|newsletter|subscribe|signup|login|nav|navbar|navigation|menu|breadcrumbs?|sidebar|side|widget|footer|masthead|header|toolbar|share|sharing|social|related|recommended|comments?|replies|respond|disqus|pagination|pager|skip|search)(?:$|[\s_-])", re.I
)
_APART = frozenset("ad ads advert adverts advertisement advertisements sponsored promo comment comments comment-list comments-area commentlist replies respond disqus disqus_thread cookies cookie-notice newsletter share sharing share-bar social related related-posts".split())
_FLOW = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dd dt td th caption figcaption summary".split())
_CONTAINERS = frozenset("div section td center blockquote".split())
_TAG = re.compile(r"""<!--.*?(?:-->|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|$)|<[!?/][^>]*(?:>|$)""", re.S)
_NAMED = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?:$|[\s=/])|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)


def _named(name: str, attributes: str, inside: bool) -> bool:
    """Whether class, id or role make an element chrome."""
    names = " ".join(a or b or c for a, b, c in _NAMED.findall(attributes)).lower()
    apart = not _APART.isdisjoint(names.split())
    return apart and not inside if name in _FLOW else apart if inside else bool(_WORDS.search(names))


def blocks_of(page: str) -> list[tuple[str, int]]:
    """(text, where it stands) of every block that is not in chrome, in page order."""
    found: list[tuple[str, int, int, bool, bool]] = []  # text, element, chrome by name, in the article, paragraph
    held: list[str] = []
    stack: list[tuple[str, bool, int, bool, int]] = []  # name, in chrome, chrome by name, in the article, element
    parents, names = [-1], [""]
    outer, heads, paragraphs = [-1], [0], [0]  # of elements that are chrome by name, from 1: the next one around, h1s, ps
    at, n = 0, len(page)

    def close() -> None:
        if held:
            if text := " ".join(entities.unescape("".join(held)).split()):
                flow = next((e[0] in _FLOW for e in reversed(stack) if e[0] in _BLOCK), False)
                found.append((text, stack[-1][4], stack[-1][2], stack[-1][3], flow) if stack else (text, 0, 0, False, flow))
            held.clear()

    while at < n:
        m = _TAG.search(page, at)
        chrome, soft, inside = stack[-1][1:4] if stack else (False, 0, False)
        if not chrome:
            held.append(page[at : m.start() if m else n])
        if m is None:
            break
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        shut, attributes = bool(m[1] or m[4]), m[3] or m[6] or ""
        if name in _BLOCK and not (chrome and not shut):
            close()
        if shut:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    del stack[k:]
                    break
            continue
        if name in _RAW:
            end = re.compile(rf"</{name}\b[^>]*>?", re.I).search(page, at)
            at = end.end() if end else n
            continue
        if name in _VOID:
            if name == "br" and not chrome:
                held.append(" ")
            continue
        if name == "p" or name == "li":  # one that is open ends
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    del stack[k:]
                    break
                if stack[k][0] in ("article", "main", "section", "div", "ul", "ol", "td", "body", "blockquote", "aside", "nav", "form"):
                    break
            chrome, soft, inside = stack[-1][1:4] if stack else (False, 0, False)
        if not chrome and name not in ("html", "body", "main", "article"):
            chrome = (name in _CHROME and not (name == "header" and inside)) or bool(attributes and _HIDDEN.search(attributes))
            if not chrome and attributes and _named(name, attributes, inside):
                outer.append(soft)
                heads.append(0)
                paragraphs.append(0)
                soft = len(outer) - 1
        elif name == "article" and inside and re.search("comment|reply", attributes, re.I):
            chrome = True
        if name in ("main", "h1", "p") and not chrome:
            k = soft
            while k > 0:
                heads[k] += name != "p"
                paragraphs[k] += 2 if name == "main" else name == "p"
                k = outer[k]
        if not attributes.endswith("/"):
            parents.append(stack[-1][4] if stack else 0)
            names.append(name)
            stack.append((name, chrome, soft, inside or name in ("article", "main"), len(parents) - 1))
    close()
    gone = [False]
    for k in range(1, len(outer)):
        gone.append(gone[outer[k]] or not (heads[k] and paragraphs[k] >= 2))
    return _placed([(text, e, inside, flow) for text, e, soft, inside, flow in found if not gone[soft]], parents, names)


def _placed(found: list[tuple[str, int, bool, bool]], parents: list[int], names: list[str]) -> list[tuple[str, int]]:
    """Where each block stands."""
    if any(inside for _, _, inside, _ in found):
        return [(text, ARTICLE if inside else OUTSIDE) for text, _, inside, _ in found]
    size, blocks = [0] * len(parents), [0] * len(parents)
    for text, e, _, _ in found:
        size[e] += len(text)
        blocks[e] += 1
    for e in range(len(parents) - 1, 0, -1):  # elements come after their parents
        size[parents[e]] += size[e]
        blocks[parents[e]] += blocks[e]
    dense = max((e for e in range(1, len(parents)) if names[e] in _CONTAINERS and 3 * size[e] >= 2 * size[0] and blocks[e] >= 2), default=0)
    if not dense:
        return [(text, PARAGRAPH if flow else OTHER) for text, _, _, flow in found]
    within = [False] * len(parents)
    for e in range(dense, len(parents)):
        within[e] = e == dense or within[parents[e]]
    return [(text, ARTICLE if within[e] else OUTSIDE) for text, e, _, _ in found]


_BLOCKS = pa.list_(pa.struct([("text", pa.string()), ("place", pa.int32())]))


def _runs(blocks: list[dict]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the runs of a page, in order; which of them lie in part outside the article; the token counts of blocks."""
    buf = np.frombuffer(" ".join(b["text"] for b in blocks).encode(errors="replace"), np.uint8)
    cut = np.flatnonzero(buf == 32)  # blocks are joined, and their tokens parted, by single blanks
    h = hash_spans(buf, np.concatenate([[0], cut + 1]), np.append(cut, len(buf))) if len(buf) else np.zeros(0, np.uint64)
    sizes = np.array([b["text"].count(" ") + 1 for b in blocks], np.int64)
    if len(h) < RUN:
        return np.zeros(0, np.uint64), np.zeros(0, bool), sizes
    loose = np.concatenate([[0], np.cumsum(np.repeat([b["place"] != ARTICLE for b in blocks], sizes))])
    step = 1
    while step < RUN:
        h, step = mix(h[:-step] * np.uint64(0x9E3779B97F4A7C15) + h[step:]), 2 * step
    return h, loose[RUN:] > loose[:-RUN], sizes


def _cleaned(blocks: list[dict], gone: set[int]) -> str:
    """The text of a page without what repeated runs cover."""
    if not gone:
        return "\n\n".join(b["text"] for b in blocks)
    runs, _, sizes = _runs(blocks)
    mark = np.zeros(int(sizes.sum()) + 1, np.int64)
    hit = np.flatnonzero([x in gone for x in signed(runs).tolist()])
    np.add.at(mark, hit, 1)
    np.add.at(mark, hit + RUN, -1)
    covered = np.split(np.cumsum(mark)[:-1] > 0, np.cumsum(sizes)[:-1])
    own = [k for k, c in enumerate(covered) if not c.all()]
    copy = 2 * sum(int(c.sum()) for c in covered) > int(sizes.sum())
    kept = []
    for k, (b, cover) in enumerate(zip(blocks, covered, strict=True)):
        whole, place = bool(cover.all()), b["place"]
        if place == OUTSIDE and cover.any():
            if not whole:
                kept.append(" ".join(t for t, c in zip(b["text"].split(" "), cover, strict=True) if not c))
        elif not (whole and own and (place == OTHER or (place == PARAGRAPH and not copy and not own[0] < k < own[-1]))):
            kept.append(b["text"])
    return "\n\n".join(kept)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text, n_chars) of every page."""
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html")).withColumn("host", host_of(F.col("url")))

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 128):
                part = batch.slice(k, 128)
                found = [[{"text": t, "place": a} for t, a in blocks_of(x)] if x else [] for x in part.column(3).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(found, _BLOCKS)], names=["host", "id", "url", "blocks"])

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for host, page, row, blocks in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own, loose, _ = _runs(blocks)
                h = np.unique(own[loose])
                n, stream = len(h), int(signed(np.frombuffer(hashlib.blake2b(" ".join(b["text"] for b in blocks).encode(errors="replace"), digest_size=8).digest(), np.uint64))[0])
                arrays = [pa.array([host] * n, pa.string()), pa.array(signed(h)), pa.array([f"row {row}" if page is None else str(page)] * n, pa.string()), pa.array([stream] * n, pa.int64()), pa.array([row] * n, pa.int64())]
                yield pa.RecordBatch.from_arrays(arrays, names=["host", "h", "page", "stream", "row"])

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [_cleaned(b, set(h or ())) for b, h in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["id", "url", "text"])

    parsed = rows.select("host", "id", "url", "html").mapInArrow(released(parse), "host string, id long, url string, blocks array<struct<text:string,place:int>>")
    parsed = save(parsed.withColumn("row", F.monotonically_increasing_id()))
    hits = F.lit(None).cast("array<long>").alias("hits")
    outside = parsed.where(F.exists("blocks", lambda b: b["place"] != ARTICLE))
    if outside.isEmpty():  # nothing that the repeated runs could remove
        dealt = parsed.select("id", "url", "blocks", hits)
    else:
        found = outside.select("host", "id", "row", "blocks").mapInArrow(released(runs), "host string, h long, page string, stream long, row long")
        own = save(found.select(F.xxhash64("host", "h").alias("key"), "h", F.xxhash64("page").alias("page"), "stream", "row"))
        # map-side sums leave the few runs that could be on several pages; only these meet their pages again
        twice = own.groupBy("key").agg(F.count("*").alias("n"), *[f(c).alias(a) for c in ("page", "stream") for a, f in ((f"{c}_1", F.min), (f"{c}_2", F.max))])
        twice = twice.where(f"n >= {PAGES} AND page_1 < page_2 AND stream_1 < stream_2").select("key")
        seen = save(own.join(twice.hint("merge"), "key"))
        often = seen.groupBy("key").agg(F.countDistinct("page").alias("pages"), F.countDistinct("stream").alias("streams")).where(f"pages >= {PAGES} AND streams >= {PAGES}")
        hit = save(seen.join(often.select("key").hint("merge"), "key").groupBy("row").agg(F.collect_set("h").alias("hits")))
        discard(own, seen)
        dealt = parsed.join(hit.hint("merge"), "row", "left").select("id", "url", "blocks", "hits")
    done = dealt.mapInArrow(released(clean), "id long, url string, text string")
    return done.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", F.length("text").cast("long").alias("n_chars"))
