"""Queries of crawl assembly, candidate sites, result links, source configuration and sheets, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrylight.operators import crawl, web
from quarrylight.plans.queries import DOMAIN, query


@query("c6_official_site_score", "pages", f"""SELECT page_id, round_even(greatest(0::DOUBLE, least(1::DOUBLE, CASE WHEN contains(t, 'The') THEN .25 WHEN contains(t, 'e') THEN .2 ELSE 0 END::DOUBLE + CASE WHEN contains(b, 'The') THEN least(.3::DOUBLE, len(regexp_extract_all(b, 'The')) / length(b) * 1000 * .03::DOUBLE) WHEN contains(b, 'e') THEN .15::DOUBLE ELSE 0 END
    + least(.15::DOUBLE, .03::DOUBLE * (contains(b, 'nav')::INT + contains(b, 'footer')::INT)) + CASE WHEN contains({DOMAIN}, 'example') THEN .15 ELSE 0 END::DOUBLE - CASE WHEN contains(t, '&') THEN .15 ELSE 0 END::DOUBLE)), 4) AS score FROM (SELECT page_id, url, coalesce(html, '') AS b, regexp_extract(coalesce(html, ''), '<title>([^<]*)', 1) AS t FROM pages)""")
def _(p):
    title = F.regexp_extract(F.coalesce("html", F.lit("")), "<title>([^<]*)", 1)
    return p.select("page_id", crawl.official_score(title, F.col("html"), web.domain(F.col("url")), "The", "e", ["nav", "footer"], "example", ["&"]).alias("score"))


@query("d20_infer_data_types", "part", "SELECT p_partkey, CASE WHEN contains(p_name, 'ring') THEN 'a,b' WHEN contains(p_name, 'widget') THEN 'c' WHEN contains(p_name, 'e') THEN 'd' ELSE 'z' END AS types FROM part")
def _(p):
    return p.select("p_partkey", F.array_join(crawl.data_types(F.col("p_name"), [("ring", ["a", "b"]), ("widget", ["c"])], [("e", ["d"])], ["z"]), ",").alias("types"))


@query("d22_template_lookup", "part", "SELECT p_partkey, CASE WHEN p_name = 'red widget' THEN 'exact' WHEN contains(p_name, 'widget') OR contains('widget', p_name) THEN 'part' END AS template FROM part")
def _(p):
    return p.select("p_partkey", crawl.template_of(F.col("p_name"), {"red widget": "exact", "widget": "part"}).alias("template"))


@query("p16_candidate_sites", "pages", f"""WITH u AS (SELECT page_id, url, {DOMAIN} AS site, contains({DOMAIN}, 'blog') OR contains({DOMAIN}, 'net') AS own, nullif(regexp_extract(coalesce(html, ''), 'lang="([a-z]+)"', 1), '') AS lang FROM pages)
    SELECT lang, page_id, own FROM u WHERE lang IS NOT NULL QUALIFY row_number() OVER (PARTITION BY lang, own ORDER BY page_id) <= CASE WHEN own THEN 5 ELSE 3 END""")
def _(p):
    rows = p.withColumn("lang", F.nullif(F.regexp_extract(F.coalesce("html", F.lit("")), 'lang="([a-z]+)"', 1), F.lit(""))).where("lang IS NOT NULL")
    return crawl.candidates(rows, "lang", web.domain(F.col("url")), ["blog", "net", "x"], "page_id").select("lang", "page_id", "own")
