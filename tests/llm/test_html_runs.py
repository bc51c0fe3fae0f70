"""HTML extraction against a plain walk over all runs of a host, and pages with class words, without article and with templates."""

import itertools
import random
from collections import defaultdict

from quarrylight.llm import html_extract
from quarrylight.llm.html_extract import ARTICLE, OTHER, OUTSIDE, PAGES, PARAGRAPH, RUN, blocks_of

SCHEMA = "page_id long, url string, html string"


def texts(spark, rows):
    return {r["page_id"]: r["text"] for r in html_extract.extract(spark.createDataFrame(rows, SCHEMA)).collect()}


def text_of(page):
    return "\n\n".join(t for t, _ in blocks_of(page))


def words(mark, n):
    return " ".join(f"{mark}{k}" for k in range(n))


def plain(rows):
    """Texts by host, by comparing all runs as word lists."""
    pages, seen = [], defaultdict(set)
    for k, (page_id, url, html) in enumerate(rows):
        host = (url or "").partition("://")[2].partition("/")[0].lower()
        blocks = blocks_of(html) if html else []
        tokens = [(w, b) for b, (t, _) in enumerate(blocks) for w in t.split(" ")]
        pages.append((host, page_id, blocks, tokens))
        for i in range(len(tokens) - RUN + 1):
            if any(blocks[b][1] != ARTICLE for _, b in tokens[i : i + RUN]):
                seen[host, tuple(w for w, _ in tokens[i : i + RUN])].add((("row", k) if page_id is None else page_id, tuple(w for w, _ in tokens)))
    often = {r for r, where in seen.items() if min(len({p for p, _ in where}), len({s for _, s in where})) >= PAGES}
    out = []
    for host, page_id, blocks, tokens in pages:
        covered = [False] * len(tokens)
        for i in range(len(tokens) - RUN + 1):
            if (host, tuple(w for w, _ in tokens[i : i + RUN])) in often:
                covered[i : i + RUN] = [True] * RUN
        by_block = [[(w, c) for (w, x), c in zip(tokens, covered, strict=True) if x == b] for b in range(len(blocks))]
        own = [b for b, ws in enumerate(by_block) if not all(c for _, c in ws)]
        text = []
        for b, ((block, place), ws) in enumerate(zip(blocks, by_block, strict=True)):
            whole = all(c for _, c in ws)
            edge = not own or b < own[0] or b > own[-1]
            if place == OUTSIDE:
                text.append(" ".join(w for w, c in ws if not c))
            elif whole and own and (place == OTHER or (place == PARAGRAPH and edge and 2 * sum(covered) <= len(covered))):
                continue
            else:
                text.append(block)
        out.append((page_id, "\n\n".join(t for t in text if t)))
    return out


def test_equals_brute_force(spark):
    rng = random.Random(8)
    shared = [words(f"s{k}x", rng.randrange(6, 20)) for k in range(4)]
    rows, fresh = [], itertools.count()
    for k in range(160):
        parts = []
        for _ in range(rng.randrange(1, 6)):
            text = rng.choice(shared) if rng.random() < 0.5 else words(f"u{next(fresh)}x", rng.randrange(1, 25))
            text = f"{text} own{k}" if rng.random() < 0.3 else text
            tag = rng.choice(["p", "div", "section", "li"])
            parts.append(f"<{tag}>{text}</{tag}>")
        cut = rng.randrange(len(parts) + 1)
        body = rng.choice(["{0}{1}", "<article>{0}</article>{1}", "<div>{0}</div>{1}"]).format("".join(parts[:cut]), "".join(parts[cut:]))
        rows.append((rng.choice([k, k, k % 5, None]), rng.choice(["http://a.org/1", "https://B.org/2", None]), body))
    rows += rows[:10] + [(900, "http://a.org/x", None), (901, None, "")]
    got = html_extract.extract(spark.createDataFrame(rows, SCHEMA)).select("page_id", "text").collect()
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, plain(rows)))
    assert any(t != "\n\n".join(x for x, _ in blocks_of(h or "")) for (_, t), (_, _, h) in zip(plain(rows), rows, strict=True))


def test_class_words_inside_an_article():
    assert text_of('<article><h1 class="article-header">Title</h1><p>a</p></article>') == "Title\n\na"
    assert text_of('<article><p class="alert">mind</p><p>a</p></article>') == "mind\n\na"
    assert text_of('<article><section id="search"><p>how to search</p></section></article>') == "how to search"
    assert text_of('<article><p>a</p><div class="ad">buy</div><section id="comments"><p>c</p></section><form>f</form></article>') == "a"
    assert text_of('<div class="has-sidebar"><h1>T</h1><p>a</p><p>b</p><div class="sidebar"><p>s</p></div></div>') == "T\n\na\n\nb"
    assert text_of('<div class="comments"><article class="comment"><p>c</p></article></div><article><p>a</p></article>') == "a"


def test_shared_passages_stay_with_and_without_article(spark):
    passage = words("shared", 10)
    for form in ("<article>{}</article>", "{}", "<div>{}</div>", "<main>{}</main>"):
        rows = [(k, "http://h.org/", form.format(f"<h1>own{k} text</h1><p>own{k} text {passage} end{k}</p><p>{passage} {passage}</p><p>last{k}</p>")) for k in range(5)]
        assert texts(spark, rows) == {k: f"own{k} text\n\nown{k} text {passage} end{k}\n\n{passage} {passage}\n\nlast{k}" for k in range(5)}


def test_template_outside_known_names_goes_with_and_without_article(spark):
    line, end = words("line", 9), words("end", 12)
    for form in ("<article>{}</article>", "{}", "<div>{}</div>"):
        text = "<h1>{0}</h1><p>{0} one</p><p>{0} two</p>"
        rows = [(k, "http://h.org/", f'<div class="zone x7">{line}</div>' + form.format(text.format(words(f"o{k}x", 9))) + f"<div>{end}</div>") for k in range(4)]
        want = {k: "{0}\n\n{0} one\n\n{0} two".format(words(f"o{k}x", 9)) for k in range(4)}
        assert texts(spark, rows) == want
        two = [(k, f"http://h{k}.org/", h) for k, _, h in rows]  # other hosts: nothing repeats
        assert all(line in t and end in t for t in texts(spark, two).values())


def test_near_copies_without_article_stay(spark):
    rows = [(k, "http://h.org/", f"<p>{words('a', 30)}</p><p>{words('b', 30)}</p><p>v{k}</p>") for k in range(6)]
    assert texts(spark, rows) == {k: f"{words('a', 30)}\n\n{words('b', 30)}\n\nv{k}" for k in range(6)}
