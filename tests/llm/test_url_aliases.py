"""Edges between urls: markup that counts, resolution of targets, and whole judgements against a plain walk over random link graphs."""

import html
import random
from html.parser import HTMLParser
from urllib.parse import urljoin, urlsplit

from pyspark.sql import functions as F

from quarrylight.llm import url_filter

PAGES = "page_id long, url string, html string"


def node(url):
    s = urlsplit(urljoin(url, url_path(url)))
    host = s.netloc.lower()
    for scheme, port in (("http", ":80"), ("https", ":443")):
        host = host.removesuffix(port) if s.scheme == scheme else host
    return f"{s.scheme}://{host}{s.path or '/'}" + (f"?{s.query}" if s.query else "")


def url_path(url):
    """The url from its path on, which ``urljoin`` rids of dot segments."""
    rest = url.split("://", 1)[1]
    at = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
    return rest[at:] or "/"


class Links(HTMLParser):
    def __init__(self, page):
        super().__init__()
        self.base = self.canonical = self.refresh = None
        self.feed(page)

    def handle_starttag(self, tag, attrs):
        a = dict(reversed([(k, v or "") for k, v in attrs]))
        if tag == "base" and self.base is None:
            self.base = a.get("href")
        if tag == "link" and "canonical" in a.get("rel", "").lower().split() and self.canonical is None and a.get("href"):
            self.canonical = a["href"]
        if tag == "meta" and a.get("http-equiv", "").lower() == "refresh" and self.refresh is None and "url=" in a.get("content", ""):
            self.refresh = a["content"].split("url=", 1)[1].strip("'\"")


def targets(url, page):
    found = Links(page)
    base = urljoin(url, found.base) if found.base else url
    return {node(urljoin(base, t)) for t in (found.canonical, found.refresh) if t and "://" in urljoin(base, t)} - {node(url)}


def edges(spark, rows):
    return sorted((r["a"], r["b"]) for r in url_filter.alias_edges(spark.createDataFrame(rows, PAGES)).collect())


def test_targets_are_resolved(spark):
    url = "http://Shop.net:80/a/b/./c.html?x=1#top"
    want = {
        "../../x/q": "http://shop.net/x/q", "../../../../x": "http://shop.net/x", "./d": "http://shop.net/a/b/d", "d/..": "http://shop.net/a/b/", "/e/./f/../g": "http://shop.net/e/g", "//O.org/k": "http://o.org/k", "?y=2&amp;z=3": "http://shop.net/a/b/c.html?y=2&z=3",
        "https://T.com:443": "https://t.com/", "http://t.com:8080/": "http://t.com:8080/", "/p&#x2F;q&eacute;": "http://shop.net/p/qé", " /tr\nim ": "http://shop.net/trim", "HTTP://T.com/A/../B": "http://t.com/B", "/a//../b": "http://shop.net/a/b",
    }
    for form in ('<link rel="canonical" href="{}">', "<LINK href='{}' data-href='/no' REL='nofollow Canonical'/>", '<meta content="0; URL=\'{}\'" http-equiv="Refresh">'):
        assert edges(spark, [(k, url, form.format(t)) for k, t in enumerate(want)]) == sorted(("http://shop.net/a/b/c.html?x=1", b) for b in want.values())


def test_what_is_no_alias(spark):
    link = '<link rel="canonical" href="/b">'
    pages = [f"<!-- {link} -->", f"<script>x='{link}'</script>", f"<style>{link}</style>", f"<title>{link}</title>", f"<textarea>{link}", f"<!-- open {link}", '<link rel="canonical-x" href="/b">', '<link rel="canonical" data-href="/b">', '<link rel="canonical">', '<meta http-equiv="refresh" content="30">']
    pages += [f'<link rel="canonical" href="{t}">' for t in ("", "#x", "mailto:a@b.net", "javascript:void(0)", "/a", "http://h.net:80/a#y")] + ['<p title="<link">canonical refresh</p>', "canonical" * 10_000, None, '<link rel="canonical" href="/b', "<link " + "canonical" * 50_000]
    assert edges(spark, [(k, "http://h.net/a", p) for k, p in enumerate(pages)] + [(99, None, link), (98, "no url", link)]) == []


def test_several_links_and_a_base(spark):
    pages = ['<link rel="canonical" href=""><link rel="canonical" href="/b"><link rel="canonical" href="/c">', '<base href="../z/"><link rel="canonical" href="b">', '<base href="http://o.org"><link rel="canonical" href="b?c"><meta http-equiv=refresh content=5;url=/d>', '<!--><link rel="canonical" href="/b"><!-- x -->']
    got = edges(spark, [(k, f"http://h{k}.net/q/a", p) for k, p in enumerate(pages)])
    assert got == [("http://h0.net/q/a", "http://h0.net/b"), ("http://h1.net/q/a", "http://h1.net/z/b"), ("http://h2.net/q/a", "http://o.org/b?c"), ("http://h2.net/q/a", "http://o.org/d"), ("http://h3.net/q/a", "http://h3.net/b")]
    assert url_filter.judge(spark.createDataFrame([], PAGES)).count() == 0


def written(rng, url, own):
    """A target as a page may write it."""
    s = urlsplit(url)
    ways = [url, html.escape(url), url.replace(s.netloc, s.netloc.upper() + (":80" if s.scheme == "http" else "")), url.replace("/", "&#47;"), url + "#part", url.replace("/n", "/x/../n").replace("/de", "/./de"), f"//{s.netloc}{s.path}?{s.query}" if s.query else f"//{s.netloc}{s.path}"]
    if s.netloc == urlsplit(own).netloc:
        ways += ["../.." + s.path + (f"?{s.query}" if s.query else ""), s.path + (f"?{s.query}" if s.query else "")] * 3
    return rng.choice(ways)


def test_random_link_graphs(spark):
    rng, rows = random.Random(8), []
    for g in range(1000):
        urls = [f"http://{rng.choice((f'a{g}.net', f'b{g}.net', f'x{g}.com', f'k{g}.org', f'x{g}.com:8080'))}/{rng.choice(('de', 'fr', 'n', 'n/m'))}/{k}{rng.choice(('', '', '?q=1&r=2'))}" for k in range(rng.randint(2, 7))]
        for own in urls:
            to = rng.choice(urls)
            t = written(rng, to, own)
            page = rng.choice(("", "<p>canonical</p>", '<link rel="canonical" href="{}">', "<!-- <link rel=canonical href='{}'> -->", '<meta http-equiv="refresh" content="0;url={}">', '<link rel="canonical" href="{}"><link rel="canonical" href="/de/other">')).format(t)
            rows.append((len(rows), own, page))
    def fit(url):
        rest = url.split("://", 1)[1]
        host, _, path = rest.partition("/")
        best = [(len(h + p), v == "allow", v) for v, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and ("/" + path.split("?")[0]).startswith(p)]
        return max(best)[2] if best else None

    near, want = {}, {}
    for _, url, page in rows:
        for b in targets(url, page):
            near.setdefault(node(url), set()).add(b)
            near.setdefault(b, set()).add(node(url))
    for i, url, _ in rows:
        seen, todo = {node(url)}, [node(url)]
        while todo:
            fresh = near.get(todo.pop(), set()) - seen
            seen |= fresh
            todo += fresh
        told = {fit(u) for u in seen} if node(url) in near else set()
        want[i] = fit(url) or ("block" if "block" in told and "allow" not in told else "allow")
    got = {r["page_id"]: r["verdict"] for r in url_filter.judge(spark.createDataFrame(rows, PAGES).repartition(4)).collect()}
    assert got == want
    carried = [i for i, url, _ in rows if want[i] == "block" and fit(url) is None]
    assert len(carried) > 100 and sum(len(v) for v in near.values()) > 2000


def test_hub_of_aliases_and_repeated_rows(spark):
    """A third of all pages name one blocked url; rows that repeat come back as often."""
    hub = spark.range(3000).select(F.col("id").alias("page_id"), F.concat(F.lit("http://m"), "id", F.lit(".net/")).alias("url"), F.lit('<link rel="canonical" href="http://x.com/de/1">').alias("html"))
    rest = spark.range(3000, 9000).select(F.col("id").alias("page_id"), F.concat(F.lit("http://m"), "id", F.lit(".net")).alias("url"), F.lit("").alias("html"))
    got = url_filter.judge(hub.unionByName(hub).unionByName(rest)).groupBy("verdict").count()
    assert {r["verdict"]: r["count"] for r in got.collect()} == {"block": 6000, "allow": 6000}
