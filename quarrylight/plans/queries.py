"""The queries of the profile operators over the given tables, each with the SQL that it is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylight.functions import exprs as X
from quarrylight.functions.domain import BLOCK_TAGS
from quarrylight.operators import fields, scoring, serving, sites, tags, text, web

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
BAD = ["spam-farm.example.org", "ads-track.example.com"]
EN, OTHER = ["the", "that", "with", "tion", "ing"], ["der", "une", "los"]


def query(name: str, table: str, sql: str | None):
    """Registers a function of the table's DataFrame (or several, comma separated)."""

    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(*[spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in table.split(",")])

        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql
        return f

    return add


DOMAIN = "coalesce(regexp_replace(lower(regexp_extract(url, '^[^:/?#]+://([^/?#]*)', 1)), '^www\\.', ''), '')"
BARE = "coalesce(html, '')"
for _t in "script style noscript nav footer header aside iframe form button svg img".split():
    BARE = f"regexp_replace({BARE}, '(?is)<{_t}[^>]*>.*?</{_t}>', '', 'g')"
BARE = f"regexp_replace({BARE}, '(?s)<!--.*?-->', '', 'g')"
SQUEEZE = "trim(regexp_replace({}, '\\s+', ' ', 'g'))"
TEXT = SQUEEZE.format(f"regexp_replace({BARE}, '(?s)<[^>]+>', ' ', 'g')")
HITS = lambda c, ws: "(" + " + ".join(f"CAST(contains(lower({c}), '{w}') AS INT)" for w in ws) + ")"
LINES = """s AS (SELECT doc_id, pos - 1 AS pos, trim(x) AS sentence FROM (SELECT doc_id, unnest(string_split_regex(text, '[.;\\n]')) AS x, generate_subscripts(string_split_regex(text, '[.;\\n]'), 1) AS pos FROM documents) WHERE trim(x) <> '')"""

# Sources, urls and html


@query("s7_upsert", "orders", "SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice FROM orders")
def _(o):
    rows = o.select("o_orderkey", "o_custkey", "o_totalprice")
    new = rows.where("o_orderkey % 2 = 0").withColumn("o_totalprice", F.col("o_totalprice") + 1)
    return serving.upsert(rows.where("o_orderkey % 3 <> 0"), new.unionByName(rows.where("o_orderkey % 3 = 0 AND o_orderkey % 2 <> 0")), ["o_orderkey"])


@query("s8_append_unique", "lineitem", "SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem")
def _(li):
    rows = li.select("l_orderkey", "l_linenumber").distinct()
    return serving.append_unique(rows.where("l_orderkey % 2 = 0"), rows, ["l_orderkey", "l_linenumber"])


_TTL = """WITH c AS (SELECT user_id || ':' || event_type AS url, ts FROM events), n AS (SELECT max(ts) AS now FROM c), l AS (SELECT url, max(ts) AS ts FROM c GROUP BY url),
    r AS (SELECT url FROM l UNION ALL SELECT 'none'), s AS (SELECT r.url, CASE WHEN l.ts IS NULL THEN 'miss' WHEN floor(epoch(now)) - floor(epoch(l.ts)) > 86400 THEN 'expired' ELSE 'hit' END AS state FROM r CROSS JOIN n LEFT JOIN l USING (url)) """


def _ttl(e):
    cache = e.select(F.concat_ws(":", "user_id", "event_type").alias("url"), F.col("ts").alias("fetched_at"))
    now = e.agg(F.max("ts").alias("now"))
    asked = cache.select("url").distinct().unionByName(e.sparkSession.range(1).select(F.lit("none").alias("url")))
    return serving.ttl_lookup(asked.join(F.broadcast(now), F.lit(True)), cache, F.col("now"), 86400)


@query("s12_ttl_cache", "events", _TTL + "SELECT url, state FROM s")
def _(e):
    return _ttl(e)


@query("s12_ttl_stats", "events", _TTL + "SELECT count(*) FILTER (state = 'hit') AS hits, count(*) FILTER (state = 'miss') AS misses, count(*) FILTER (state = 'expired') AS expired, round_even(count(*) FILTER (state = 'hit') / greatest(1, count(*) FILTER (state <> 'expired')), 2) AS hit_rate FROM s")
def _(e):
    return serving.ttl_stats(_ttl(e))


@query("s12_ttl_cleanup", "events", "WITH c AS (SELECT event_id, user_id || ':' || event_type AS url, ts FROM events), n AS (SELECT max(ts) AS now FROM c) SELECT event_id, url FROM c, n WHERE floor(epoch(now)) - floor(epoch(ts)) <= 86400")
def _(e):
    cache = e.select("event_id", F.concat_ws(":", "user_id", "event_type").alias("url"), F.col("ts").alias("fetched_at"))
    now = e.agg(F.max("ts").alias("now"))
    return serving.ttl_clean(cache.join(F.broadcast(now), F.lit(True)), F.col("now"), 86400).select("event_id", "url")


@query("p1_extract_domain", "pages", f"SELECT page_id, {DOMAIN} AS domain FROM pages")
def _(p):
    return p.select("page_id", web.domain(F.col("url")).alias("domain"))


_BLACK = "(NOT regexp_matches(url, '^(?i)https?://') OR " + " OR ".join(f"contains({DOMAIN}, '{d}') OR contains('{d}', {DOMAIN})" for d in BAD) + ")"


@query("p2_url_blacklist", "pages", f"SELECT page_id, {_BLACK} AS bad FROM pages")
def _(p):
    return p.select("page_id", web.is_blacklisted(F.col("url"), BAD).alias("bad"))


@query("p3_url_path_keywords", "pages", f"SELECT page_id, {_BLACK} OR regexp_matches(lower(regexp_extract(url, '^[^:/?#]+://[^/?#]*([^?#]*)', 1) || regexp_extract(url, '^[^?#]*\\?([^#]*)', 1)), 'utm_|/es/') AS bad FROM pages")
def _(p):
    return p.select("page_id", web.is_blacklisted(F.col("url"), BAD, ["utm_", "/es/"]).alias("bad"))


@query("p4_valid_url_filter", "pages", f"SELECT page_id, url FROM pages WHERE NOT {_BLACK}")
def _(p):
    return p.where(~web.is_blacklisted(F.col("url"), BAD)).select("page_id", "url")


@query("p5_html_to_text_simple", "pages", f"SELECT page_id, {TEXT} AS text FROM pages")
def _(p):
    return p.select("page_id", web.html_text(F.col("html")).alias("text"))


_SPACE = "\\t-\\r\\x{85}\\p{Z}"  # white space as the query has it; \s of the SQL's engine is less
_BLOCKS = " || ".join(
    f"[x FOR x IN [regexp_replace(regexp_replace(y, '(?s)<[^>]+>', '', 'g'), '^[{_SPACE}]+|[{_SPACE}]+$', '', 'g') FOR y IN regexp_extract_all({BARE}, '(?is)<{t}[^>]*>(.*?)</{t}>', 1)] IF length(x) > {n} AND NOT regexp_matches(x, '^[\\p{{Nd}}{_SPACE}.,;:!?+/()-]+$')]"
    for t, n in BLOCK_TAGS
)


@query("p6_html_to_text_blocks", "pages", f"SELECT page_id, trim(regexp_replace(array_to_string({_BLOCKS}, ' '), '[\\t-\\r ]+', ' ', 'g')) AS text FROM pages")
def _(p):
    return p.select("page_id", web.html_blocks(F.col("html")).alias("text"))


_PICK = lambda t: "nullif(" + SQUEEZE.format(f"regexp_replace(regexp_extract(html, '(?is)<{t}[^>]*>(.*?)</{t}>', 1), '(?s)<[^>]+>', '', 'g')") + ", '')"


@query("p7_page_title", "pages", f"SELECT page_id, coalesce({_PICK('title')}, {_PICK('h1')}, '') AS title FROM pages")
def _(p):
    return p.select("page_id", web.page_title(F.col("html")).alias("title"))


@query("p11_build_search_urls", "nation", """SELECT n_name AS name, CAST(e.i AS INTEGER) AS engine, CAST(p.p AS INTEGER) AS page, replace(replace(e.t, '{q}', replace(n_name, ' ', '%20')), '{page}', CAST(p.p AS VARCHAR)) AS url
    FROM nation, (VALUES (0, 'https://a.example/?q={q}&p={page}'), (1, 'https://b.example/s/{q}/{page}')) e(i, t), (VALUES (1), (2)) p(p)""")
def _(n):
    return web.search_urls(n.select(F.col("n_name").alias("name")), ["https://a.example/?q={q}&p={page}", "https://b.example/s/{q}/{page}"])


@query("p12_expand_keywords", "supplier", "SELECT s_suppkey, t AS data_type, CAST(i AS INTEGER) AS place, replace(replace(w, '{name}', s_name), '{short}', s_name[1:8]) AS keyword FROM supplier, (VALUES ('bids', 0, '{name} bid'), ('bids', 1, '{short} bid of {name}'), ('patents', 0, '{name} patent')) x(t, i, w)")
def _(s):
    names = s.select("s_suppkey", F.col("s_name").alias("name"), F.substring("s_name", 1, 8).alias("short"))
    return web.expand_keywords(names, {"bids": ["{name} bid", "{short} bid of {name}"], "patents": ["{name} patent"]}).drop("name", "short")


@query("p13_classify_url", "pages", f"""SELECT page_id, CASE WHEN {DOMAIN} = 'tionsh.example.net' THEN 'hub' WHEN {DOMAIN} <> '' AND (contains({DOMAIN}, 'tionsh.example.net') OR contains('tionsh.example.net', {DOMAIN})) THEN 'hub'
    WHEN contains(lower(url), 'blog.') THEN 'blog' WHEN contains(lower(url), '://m.') THEN 'mobile' ELSE 'site' END AS kind FROM pages""")
def _(p):
    return p.select("page_id", web.classify_url(F.col("url"), {"tionsh.example.net": "hub"}, [("blog", ["blog."]), ("mobile", ["://m."])], "site").alias("kind"))


@query("p14_detail_page_pred", "pages", "SELECT page_id, contains(url, '.html') OR contains(url, '/en/') AS detail FROM pages")
def _(p):
    return p.select("page_id", X.any_hit(F.col("url"), [".html", "/en/"]).alias("detail"))


# Source evaluation
_PROBE = "WITH p AS (SELECT user_id AS domain, least(value * 1000, 15000) AS ms, event_type <> 'error' AS ok FROM events), s AS (SELECT domain, avg(ms) AS avg_ms, avg(CAST(ok AS INT)) AS success_rate, 1 - avg(CAST(ms > 5000 AS INT)) AS stability FROM p GROUP BY domain) "


@query("d2_probe_stats", "events", _PROBE + "SELECT domain, round(avg_ms, 4) AS avg_ms, round(success_rate, 6) AS success_rate, round(stability, 6) AS stability, round(greatest(0, 100 - avg_ms / 100) * .4 + success_rate * 40 + stability * 20, 4) AS response FROM s WHERE success_rate > 0")
def _(e):
    s = scoring.probe_stats(e.select(F.col("user_id").alias("domain"), (F.col("value") * 1000).alias("ms"), (F.col("event_type") != "error").alias("success")))
    return s.select("domain", F.round("avg_ms", 4).alias("avg_ms"), F.round("success_rate", 6).alias("success_rate"), F.round("stability", 6).alias("stability"), F.round("response", 4).alias("response"))


@query("d3_best_sample", "pages", f"SELECT {DOMAIN} AS domain, arg_max(page_id, {{'n': length(html), 's': -page_id}}) AS page_id FROM pages WHERE length(html) > 0 GROUP BY 1")
def _(p):
    return scoring.best_sample(p, web.domain(F.col("url")), F.length("html"), "page_id", "page_id")


@query("d4_industry_relevance", "documents", f"SELECT doc_id, round_even(least(1, ({HITS('text', EN)} + {HITS('text', OTHER)} * .5) / 8), 2) AS score FROM documents")
def _(d):
    return d.select("doc_id", scoring.kw_score(F.col("text"), EN, OTHER, 8).alias("score"))


@query("d5_info_richness", "pages", f"SELECT page_id, round_even(least(1, {HITS('html', EN)} / 10), 2) AS score FROM pages")
def _(p):
    return p.select("page_id", scoring.kw_score(F.col("html"), EN, [], 10).alias("score"))


@query("d6_relation_richness", "documents", f"SELECT doc_id, round_even(least(1, {HITS('text', EN)} / 12 + CASE WHEN {HITS('text', ['der', 'und'])} = 2 THEN .1 ELSE 0 END + CASE WHEN {HITS('text', ['the', 'with'])} = 2 THEN .1 ELSE 0 END), 2) AS score FROM documents")
def _(d):
    return d.select("doc_id", scoring.relation_richness(F.col("text"), EN, [("der", "und"), ("the", "with")]).alias("score"))


_COUNT = lambda p: f"len(regexp_extract_all(html, '{p}'))"
_STRUCT = f"round_even(least(.3, .05 * {_COUNT('(?i)<table')}) + least(.2, .03 * {_COUNT('(?i)<(ul|ol)')}) + least(.2, .05 * {_COUNT('(?i)<dl')}) + least(.3, .02 * {_COUNT('(?i)<div[^>]*class=[^>]*(card|item|list|info|company|enterprise)')}), 4)"


@query("d7_structuring_score", "pages", f"SELECT page_id, {_STRUCT} AS score FROM pages")
def _(p):
    return p.select("page_id", scoring.structuring(F.col("html")).alias("score"))


_YEARS = "list_max([CAST(y AS INT) FOR y IN regexp_extract_all(text, '20(?:2[3-9]|3[0-9])') IF CAST(y AS INT) <= 2026])"


@query("d8_freshness", "documents", f"SELECT doc_id, CAST(CASE WHEN length(text) = 0 THEN 0 WHEN {_YEARS} >= 2025 THEN 1 WHEN {_YEARS} >= 2024 THEN .7 WHEN {_YEARS} IS NOT NULL THEN .4 WHEN regexp_matches(text, '202[3-9]-[0-9][0-9]') THEN .8 ELSE .3 END AS DOUBLE) AS score FROM (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN text WHEN 1 THEN text || ' bis 2028-05' ELSE text || ' am 202' || doc_id % 9 || '-11' END AS text FROM documents)")
def _(d):
    """Texts, two thirds of them with a date at the end, some in years to come."""
    k = F.col("doc_id")
    text_ = F.when(k % 3 == 0, F.col("text")).when(k % 3 == 1, F.concat("text", F.lit(" bis 2028-05"))).otherwise(F.concat("text", F.lit(" am 202"), (k % 9).cast("string"), F.lit("-11")))
    return d.select("doc_id", scoring.freshness(text_, 2026).alias("score"))


_QUALITY = f"round_even(least(1, greatest(0, .5 + CASE WHEN length(html) > 50000 THEN .2 WHEN length(html) > 20000 THEN .1 ELSE 0 END - CASE WHEN contains(lower(html[1:500]), 'error') THEN .3 ELSE 0 END + CASE WHEN length({TEXT}) > 3000 THEN .2 WHEN length({TEXT}) > 1000 THEN .1 ELSE 0 END)), 2)"


@query("d9_page_quality", "pages", f"SELECT page_id, CAST({_QUALITY} AS DOUBLE) AS score FROM pages")
def _(p):
    return p.select("page_id", scoring.page_quality(F.col("html"), web.html_text(F.col("html")), ["error"]).alias("score"))


_AUTH = f"round_even(least(1, .3 + CASE WHEN contains({DOMAIN}, 'example.org') THEN .4 ELSE 0 END + CASE WHEN contains({DOMAIN}, 'blog.') THEN .2 ELSE 0 END + CASE WHEN contains(lower(html), 'the') THEN .1 ELSE 0 END), 2)"


@query("d11_authority", "pages", f"SELECT page_id, CAST({_AUTH} AS DOUBLE) AS score FROM pages")
def _(p):
    return p.select("page_id", scoring.authority(web.domain(F.col("url")), F.col("html"), ["example.org"], ["blog."], ["the"]).alias("score"))


_OVERALL = f"round_even(100 * (.4 * round_even(least(1, {HITS('html', EN)} / 8), 2) + .3 * {_STRUCT} + .3 * {_AUTH}), 2)"


def _scored(p):
    score = F.bround(100 * (0.4 * scoring.kw_score(F.col("html"), EN, [], 8) + 0.3 * scoring.structuring(F.col("html")) + 0.3 * scoring.authority(web.domain(F.col("url")), F.col("html"), ["example.org"], ["blog."], ["the"])), 2)
    return p.select("page_id", web.domain(F.col("url")).alias("domain"), score.alias("overall"))


@query("d12_weighted_scores", "pages", f"SELECT page_id, {DOMAIN} AS domain, CAST({_OVERALL} AS DOUBLE) AS overall FROM pages")
def _(p):
    return _scored(p)


_SITE = f"""WITH f AS (SELECT page_id, greatest(0, 100 - length(html) / 100) AS response, round_even(least(1, {HITS('html', EN)} / 12 + CASE WHEN {HITS('html', ['the', 'with'])} = 2 THEN .1 ELSE 0 END), 2) AS relation, round_even(least(1, {HITS('html', EN)} / 10), 2) AS info, round_even(least(1, ({HITS('html', EN)} + .5 * {HITS('html', OTHER)}) / 8), 2) AS industry,
    {_STRUCT} AS structure, CASE WHEN {_YEARS.replace('text', 'html')} >= 2025 THEN 1 WHEN {_YEARS.replace('text', 'html')} >= 2024 THEN .7 WHEN {_YEARS.replace('text', 'html')} IS NOT NULL THEN .4 WHEN regexp_matches(html, '202[3-9]-[0-9][0-9]') THEN .8 ELSE .3 END AS fresh, {_QUALITY} AS page,
    round_even(least(1, greatest(0, .5 - CASE WHEN contains(lower(html[1:3000]), 'form') THEN .4 ELSE 0 END - CASE WHEN contains(lower(html[1:3000]), 'cookie') THEN .3 ELSE 0 END - CASE WHEN page_id % 10 > 8 THEN .2 WHEN page_id % 10 > 5 THEN .1 ELSE 0 END + CASE WHEN length(html) > 500 THEN .2 ELSE 0 END)), 2) AS friendly, {_AUTH} AS authority FROM pages WHERE html <> ''),
    d AS (SELECT {', '.join(f'CAST({c} AS DOUBLE) AS {c}' for c in 'response relation info industry structure fresh page friendly authority'.split())}, page_id FROM f),
    s AS (SELECT page_id, response, relation * 30 + info * 20 + industry * 25 + structure * 15 + fresh * 10 AS data, page * 40 + friendly * 30 + authority * 30 AS site FROM d) SELECT page_id, round(data, 6) AS data, round(site, 6) AS site, round(response * .3::DOUBLE + data * .4::DOUBLE + site * .3::DOUBLE, 6) AS overall FROM s"""


@query("d12_site_scores", "pages", _SITE)
def _(p):
    """All features of every page, weighted in two levels; a page's size stands for its response. To six places, which no score ends within."""
    html, ok = F.col("html"), p.where("html <> ''")
    features = {
        "relation": scoring.relation_richness(html, EN, [("the", "with")]), "info": scoring.kw_score(html, EN, [], 10), "industry": scoring.kw_score(html, EN, OTHER, 8), "structure": scoring.structuring(html), "fresh": scoring.freshness(html, 2026),
        "page": scoring.page_quality(html, web.html_text(html), ["error"]), "friendly": sites.crawl_friendly(html, F.col("page_id") % 10, ["form"], ["cookie"]), "authority": scoring.authority(web.domain(F.col("url")), html, ["example.org"], ["blog."], ["the"]),
    }
    rows = ok.select("page_id", F.greatest(F.lit(0.0), 100 - F.length("html") / 100).alias("response"), *[c.alias(k) for k, c in features.items()])
    x = scoring.site_scores(F.col("response"), {k: F.col(k) for k in features}, digits=6)
    return rows.select("page_id", x.alias("x")).select("page_id", "x.*")


@query("d15_top20_sites", "pages", f"SELECT page_id, {DOMAIN} AS domain, CAST({_OVERALL} AS DOUBLE) AS overall, CAST(row_number() OVER (ORDER BY {_OVERALL} DESC, page_id) AS INTEGER) AS rank FROM pages QUALIFY rank <= 20")
def _(p):
    return scoring.top(_scored(p), "overall", "page_id")


@query("d13_infer_category", "pages", f"SELECT page_id, CASE WHEN contains({DOMAIN}, 'blog.') THEN 'blog' WHEN contains({DOMAIN}, 'm.') THEN 'mobile' WHEN contains(lower(html), 'lang=\"de\"') THEN 'german' ELSE 'other' END AS category FROM pages")
def _(p):
    return p.select("page_id", scoring.category(web.domain(F.col("url")), F.col("html"), [("blog", ["blog."]), ("mobile", ["m."])], [("german", ['lang="de"'])], "other").alias("category"))


@query("d14_evaluation_notes", "pages", "SELECT page_id, CASE WHEN length(html) > 3000 AND contains(url, 'blog.') THEN 'long；blog' WHEN length(html) > 3000 THEN 'long' WHEN contains(url, 'blog.') THEN 'blog' ELSE '常规网站' END AS notes FROM pages")
def _(p):
    return p.select("page_id", scoring.notes([(F.length("html") > 3000, "long"), (F.col("url").contains("blog."), "blog")], "常规网站").alias("notes"))


@query("d18_priority_band", "pages", f"SELECT page_id, CAST(CASE WHEN {_OVERALL} >= 85 THEN 1 WHEN {_OVERALL} >= 70 THEN 2 WHEN {_OVERALL} >= 55 THEN 3 ELSE 4 END AS INTEGER) AS band, CASE WHEN {_OVERALL} >= 85 THEN 'A' WHEN {_OVERALL} >= 70 THEN 'B' WHEN {_OVERALL} >= 55 THEN 'C' WHEN {_OVERALL} >= 40 THEN 'D' ELSE 'E' END AS grade, {_OVERALL} >= 40 AS enabled FROM pages")
def _(p):
    return _scored(p).select("page_id", scoring.band(F.col("overall")).alias("band"), scoring.grade(F.col("overall")).alias("grade"), scoring.enabled(F.col("overall")).alias("enabled"))


# Text


@query("e6_split_sentences", "documents", f"WITH {LINES} SELECT doc_id, CAST(pos AS INTEGER) AS pos, sentence FROM s")
def _(d):
    return text.sentences(d, r"[.;\n]")


_KEY = "regexp_replace(sentence, '\\s+', '', 'g')"


@query("e10_exact_norm_dedup", "documents", f"WITH {LINES} SELECT doc_id, CAST(min(pos) AS INTEGER) AS pos, arg_min(sentence, pos) AS sentence FROM s WHERE length({_KEY}) > 4 GROUP BY doc_id, {_KEY}")
def _(d):
    return text.exact_lines(text.sentences(d, r"[.;\n]"))


BITS = " + ".join(f"(CASE WHEN sum(CASE WHEN (h >> {i}) & 1 = 1 THEN c ELSE -c END) >= 0 THEN {1 << i}::HUGEINT ELSE 0 END)" for i in range(64))
_SIM = f"""t AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z]{{2,}}')) AS t FROM documents), k AS (SELECT doc_id, ('0x' || md5(t)[17:32])::UBIGINT AS h, count(*) AS c FROM t GROUP BY ALL),
    b AS (SELECT doc_id, {BITS} AS v FROM k GROUP BY doc_id), f AS (SELECT doc_id, coalesce(CASE WHEN v >= 9223372036854775808 THEN CAST(v - 18446744073709551616 AS BIGINT) ELSE CAST(v AS BIGINT) END, 0) AS simhash FROM documents LEFT JOIN b USING (doc_id))"""


@query("e7_simhash64", "documents", f"WITH {_SIM} SELECT doc_id, simhash FROM f")
def _(d):
    return text.simhash64(d)


@query("e12_near_dup_corpus", "documents", f"WITH {_SIM}, r AS (SELECT simhash, min(doc_id) AS id FROM f WHERE simhash <> 0 GROUP BY simhash) SELECT x.id AS a, y.id AS b FROM r x JOIN r y ON x.id < y.id AND bit_count(xor(x.simhash, y.simhash)) <= 3")
def _(d):
    return text.near_duplicates(text.simhash64(d))


@query("c1_content_preview_dedup", "documents", "SELECT min(doc_id) AS doc_id, source FROM documents WHERE length(text) > 80 GROUP BY source, text[1:80]")
def _(d):
    return text.preview_first(d.select("doc_id", "source", "text"), "source", "doc_id").select("doc_id", "source")


# Fields and tags


@query("f0_ordered_extract", "documents", """WITH x AS (SELECT doc_id, nullif(trim(regexp_extract(text, '([A-Za-z0-9._]+@[A-Za-z0-9.-]+)', 1)), '') AS a, nullif(trim(regexp_extract(text, '(licensed under [A-Za-z ]+)', 1)), '') AS b FROM documents)
    SELECT doc_id, coalesce(a, b, '') AS value, CASE WHEN coalesce(a, b) IS NULL THEN 'miss' ELSE 'regex' END AS method FROM x""")
def _(d):
    return d.select("doc_id", X.ordered_extract(F.col("text"), [r"([A-Za-z0-9._]+@[A-Za-z0-9.-]+)", r"(licensed under [A-Za-z ]+)"]).alias("x")).select("doc_id", "x.*")


@query("f2_short_name", "customer", "SELECT c_custkey, CASE WHEN ends_with(c_name, '01') THEN c_name[1:length(c_name) - 2] WHEN ends_with(c_name, '1') THEN c_name[1:length(c_name) - 1] ELSE c_name END AS short FROM customer")
def _(c):
    return c.select("c_custkey", tags.short_name(F.col("c_name"), ("01", "1")).alias("short"))


_PART = "CASE WHEN contains(p_type, 'STEEL') THEN 'steel' WHEN contains(p_type, 'BRASS') OR contains(p_type, 'COPPER') THEN 'copper' ELSE '' END"


@query("f7_enterprise_type", "part", f"SELECT p_partkey, {_PART} AS kind FROM part")
def _(p):
    return p.select("p_partkey", X.map_first(F.col("p_type"), [("steel", ["STEEL"]), ("copper", ["BRASS", "COPPER"])]).alias("kind"))


@query("f8_operating_status", "orders", "SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'F' THEN 'done' ELSE 'other' END AS status FROM orders")
def _(o):
    return o.select("o_orderkey", X.map_first(F.col("o_orderstatus"), [("open", ["O"]), ("done", ["F"])], "other").alias("status"))


@query("f13_employee_scale", "part", """WITH n AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN (p_size + p_size * 40) // 2 WHEN 1 THEN p_size * 100 WHEN 2 THEN p_size * 7 END AS n FROM part)
    SELECT p_partkey, CASE WHEN n IS NULL THEN '' WHEN n < 50 THEN '50人以下' WHEN n < 150 THEN '50-150人' WHEN n < 500 THEN '150-500人' WHEN n < 1000 THEN '500-1000人' WHEN n < 5000 THEN '1000-5000人' ELSE '5000人以上' END AS band FROM n""")
def _(p):
    """A range, a number of staff, a lower bound or none in a sentence made of each part's size."""
    k, n = F.col("p_partkey") % 4, lambda x: (F.col("p_size") * x).cast("string")
    said = F.when(k == 0, F.concat(F.lit("规模"), n(1), F.lit(" - "), n(40), F.lit("人"))).when(k == 1, F.concat(F.lit("员工："), n(100), F.lit("人"))).when(k == 2, F.concat(n(7), F.lit("人以上"))).otherwise("人员不详")
    return p.select("p_partkey", fields.employee_scale(said).alias("band"))


_SEGMENTS = "array_to_string(list_filter([CASE WHEN contains({0}, 'tion') THEN 'a' END, CASE WHEN contains({0}, 'sch') THEN 'b' END], lambda x: x IS NOT NULL), '、')"


@query("f10_main_business", "documents", f"SELECT doc_id, coalesce(nullif({_SEGMENTS.format('text')}, ''), {_SEGMENTS.format('source')}, '') AS business FROM (SELECT doc_id, coalesce(text, '') AS text, coalesce(source, '') || 'tion' AS source FROM documents)")
def _(d):
    return d.select("doc_id", fields.main_business(F.col("text"), F.concat(F.coalesce("source", F.lit("")), F.lit("tion")), [("a", ["tion"]), ("b", ["sch"])]).alias("business"))


@query("g1_normalize_terms", "part", "SELECT p_partkey, replace(replace(p_name, 'a', 'bb'), 'b', 'c') AS name, replace(replace(replace(replace(p_name, 'ring', chr(1)), 'widget', chr(2)), 'r', 'widget'), chr(1), 'r') AS once FROM (SELECT p_partkey, replace(p_name, 'widget', 'ring') AS p_name FROM part)")
def _(p):
    """One after the other, and in one pass, which leaves what it has made alone."""
    name = F.replace("p_name", F.lit("widget"), F.lit("ring"))
    return p.select("p_partkey", tags.normalize_terms(name, [("a", "bb"), ("b", "c")]).alias("name"), tags.normalize_terms(name, [("r", "widget"), ("ring", "r")], longest_first=True).alias("once"))


_TAGS = "list_distinct_keep([x FOR x IN [CASE WHEN contains(lower(text), 'the') THEN 'en' END, CASE WHEN contains(lower(text), 'und') THEN 'de' END, CASE WHEN contains(lower(text), 'los') THEN 'es' END] IF x IS NOT NULL])".replace("list_distinct_keep", "")


@query("g2_keyword_tags", "documents", f"SELECT doc_id, array_to_string({_TAGS}, ',') AS tags FROM documents")
def _(d):
    return d.select("doc_id", F.array_join(tags.keyword_tags(F.col("text"), {"the": "en", "und": "de", "los": "es"}), ",").alias("tags"))


@query("g3_tag_confidence", "part", "SELECT p_partkey, CASE WHEN coalesce(p_name, '') IN ('', '未提取到', '未明确') THEN 0 ELSE round_even(least(CAST(.9 AS DOUBLE) + least(length(p_name) / 100, CAST(.05 AS DOUBLE)), CAST(.99 AS DOUBLE)), 2) END AS confidence FROM part")
def _(p):
    return p.select("p_partkey", tags.tag_confidence(0.9, F.col("p_name")).alias("confidence"))


def _tag_rows(d):
    return tags.tag_rows(d, "doc_id", "language", "words", tags.keyword_tags(F.col("text"), {"the": "en", "und": "de", "los": "es"}), "text", 0.9)


# Relations and records


@query("i9_dedup_relations", "lineitem", "SELECT l_suppkey, l_partkey, l_returnflag, l_orderkey FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_suppkey, l_partkey, l_returnflag ORDER BY l_discount DESC, l_orderkey * 10 + l_linenumber) = 1")
def _(li):
    e = li.select("l_suppkey", "l_partkey", "l_returnflag", "l_orderkey", "l_discount", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"))
    return tags.dedup_edges(e, ["l_suppkey", "l_partkey", "l_returnflag"], "l_discount", "seq").drop("l_discount", "seq")


@query("i10_relation_type_counts", "lineitem", "WITH d AS (SELECT DISTINCT l_returnflag, l_suppkey FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_returnflag ORDER BY l_suppkey) <= 0 OR true), f AS (SELECT l_returnflag, array_to_string(list(l_suppkey ORDER BY l_suppkey)[1:5], ',') AS first FROM d GROUP BY 1) SELECT l_returnflag, count(*) AS n, any_value(first) AS first FROM lineitem JOIN f USING (l_returnflag) GROUP BY 1")
def _(li):
    return tags.type_counts(li.select("l_returnflag", "l_suppkey"), "l_returnflag", "l_suppkey")


@query("j7_parse_date", "orders", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS bid_date FROM orders")
def _(o):
    return o.select("o_orderkey", tags.parse_date(F.date_format("o_orderdate", "yyyy年M月d日")).alias("bid_date"))


@query("j20_record_ids", "lineitem", "SELECT l_orderkey, l_linenumber, l_returnflag || '-' || printf('%03d', row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_linenumber)) AS record_id FROM lineitem")
def _(li):
    return tags.record_ids(li, "l_orderkey", "l_returnflag", F.col("l_returnflag"), "l_linenumber").select("l_orderkey", "l_linenumber", "record_id")


# Serving


def _profiles(o):
    return o.select(F.col("o_custkey").alias("name"), serving.batch_no(F.col("o_orderdate")).alias("batch_no"), "o_orderkey")


_BATCH = "SELECT o_custkey AS name, strftime(o_orderdate, '%Y%m%d%H%M%S') AS batch_no, o_orderkey FROM orders"


@query("q1_latest_batch", "orders", f"WITH b AS ({_BATCH}) SELECT * FROM b QUALIFY rank() OVER (PARTITION BY name ORDER BY batch_no DESC) = 1")
def _(o):
    return serving.latest_batch(_profiles(o))


@query("q2_keyword_search", "customer", "SELECT c_custkey, c_name FROM customer WHERE contains(lower(c_name), 'r#0000001')")
def _(c):
    return serving.search(c.select("c_custkey", "c_name"), "R#0000001", "c_name")


@query("q4_paginate", "customer", "SELECT c_custkey, c_acctbal, (SELECT count(*) FROM customer) AS total FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 20 OFFSET 20")
def _(c):
    return serving.page(c.select("c_custkey", "c_acctbal"), 2, 20, [F.desc("c_acctbal"), F.asc("c_custkey")])


@query("q6_batch_history", "orders", f"WITH b AS ({_BATCH}) SELECT * FROM b WHERE name = 7")
def _(o):
    return serving.batch_history(_profiles(o), 7)


@query("q10_batch_no", "orders", _BATCH)
def _(o):
    return _profiles(o)


@query("q13_token_estimate", "documents", "SELECT source AS stage, CAST(sum(greatest(1, length(text) // 2)) AS BIGINT) AS tokens, count(*) AS n_rows FROM documents GROUP BY ROLLUP (source)")
def _(d):
    return serving.token_estimate(d, F.col("source"), F.col("text"))


@query("q14_batch_run_summary", "orders", "SELECT count(*) AS total, count(*) FILTER (o_orderstatus = 'F') AS completed, count(*) FILTER (o_orderstatus <> 'F') AS failed, round_even(count(*) FILTER (o_orderstatus = 'F') / count(*), 4) AS share, CAST(sum(CAST(floor(o_totalprice) AS BIGINT)) AS BIGINT) AS total_tokens FROM orders")
def _(o):
    return serving.run_summary(o, F.col("o_orderstatus"), "F", F.floor("o_totalprice"))


@query("q16_run_log_summary", "events", """WITH r AS (SELECT user_id, event_id, CASE event_type WHEN 'error' THEN 'error' WHEN 'click' THEN 'warning' END AS level FROM events), n AS (SELECT *, row_number() OVER (PARTITION BY user_id, level ORDER BY event_id) AS k FROM r WHERE level IS NOT NULL),
    l AS (SELECT user_id, min(level) AS level FROM n GROUP BY 1) SELECT user_id, level, string_agg(CAST(event_id AS VARCHAR), '; ' ORDER BY k) AS messages FROM n JOIN l USING (user_id, level) WHERE k <= 3 GROUP BY ALL""")
def _(e):
    level = F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "click", "warning")
    return serving.log_summary(e.select("user_id", "event_id", "event_type", F.col("event_id").cast("string").alias("m")), "user_id", level, "m", "event_id")
