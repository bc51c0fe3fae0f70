"""URL filters with redirect equivalence.

Rules allow or block a host and its subdomains below a path. Pages that redirect to, or name as canonical, another url
are aliases: connected components over these edges carry decisions to urls that no rule fits. In a component, an explicit
allow takes precedence over any block; a url that a rule fits keeps the rule's decision; what nothing decides is allowed.

A url's node is the url without fragment, its scheme and host in lower case, without the scheme's default port, with dot segments
resolved and an empty path as ``/``. Percent-encoding, ``www.`` and the scheme itself still tell urls apart. Edges come from
``<link rel=canonical>`` and ``<meta http-equiv=refresh>`` of the whole html: the first of each that names a target, as the page's
other ones contradict it. Markup inside comments, scripts, styles, templates and text fields is none. Targets have their character references
decoded and are resolved against the page's ``<base>``, else its url; a target of a scheme without ``://`` is no alias.

Defined results: a null url, or one without ``://``, has an empty host and path, fits no rule, has no aliases and is allowed; null
html gives no edges; repeated rows come back as often as they come; of rules that fit and are equally long, an allow wins.
Only the id, url and html columns are read.
"""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from quarrylight.llm.components import components, save

Rule = tuple[str, str, str]  # allow or block, host, path
RULES: list[Rule] = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]

# Parts of the markup language.
_NO_MARKUP = r"(?is)<!--(?:-?>|.*?(?:--!?>|\z))|<(script|style|textarea|title|xmp|template)\b.*?(?:</\1\s*>|\z)"
_TAG = r"""(?is)<(?:link|meta|base)\b(?:[^>"']++|"[^"]*+"|'[^']*+'){0,400}+>"""
_ATTRIBUTE = r"""(?s)(?<=[\s"'/])([^\s"'>/=<]+)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""


def _lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    return F.coalesce(_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[Rule] = RULES) -> Column:
    """The longest rule that fits, as struct(verdict, rule), or null. Rules are few and inlined, longest first."""
    out = F.lit(None).cast("struct<verdict:string,rule:string>")
    for verdict, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[0] == "allow")):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(h + p).alias("rule"))).otherwise(out)
    return out


def _resolved(path: Column) -> Column:
    """A path without its dot segments; each ``..`` takes the segment before it away."""
    plain = F.regexp_replace(F.regexp_replace(path, r"/(?:\./)+", "/"), r"/\.$", "/")
    parts = F.split(F.regexp_replace(plain, r"/\.\.$", "/../"), r"/\.\.(?=/)", -1)
    whole = F.aggregate(F.slice(parts, 2, F.greatest(F.size(parts), F.lit(1))), F.get(parts, F.lit(0)), lambda acc, p: F.concat(F.regexp_replace(acc, "/[^/]*$", ""), p))
    return F.when(path.rlike(r"/\.\.?(?:/|$)"), whole).otherwise(path)


def node_of(url: Column) -> Column:
    """The url as a node; null without ``://``."""
    part = lambda k: F.regexp_extract(url, r"(?s)^(.*?)://([^/?#]*)([^?#]*)([^#]*)", k)
    head = F.regexp_replace(_lower(F.concat(part(1), F.lit("://"), part(2))), r"^(?:(http://[^/]*?):(?:80)?|(https://[^/]*?):(?:443)?)$", "$1$2")
    return F.when(url.contains("://"), F.concat(head, F.coalesce(F.nullif(_resolved(part(3)), F.lit("")), F.lit("/")), part(4)))


def joined(base: Column, target: Column) -> Column:
    """A target's url as seen from a base url; null for an empty one, a fragment alone, or a scheme without ``://``."""
    t = F.trim(F.regexp_replace(target, r"[\t\r\n]|^[\x00-\x20]+|[\x00-\x20]+$", ""))
    part = lambda k: F.regexp_extract(base, r"(?s)^((.*?)://[^/?#]*)((?:/(?:[^?#]*/)?)?)([^?#]*)", k)
    out = F.when((t == "") | t.startswith("#"), None).when(t.rlike("(?s)^[A-Za-z][A-Za-z0-9+.-]*:"), F.when(t.rlike("(?s)^[A-Za-z][A-Za-z0-9+.-]*://"), t))
    out = out.when(t.startswith("//"), F.concat(part(2), F.lit(":"), t)).when(t.startswith("/"), F.concat(part(1), t))
    folder = F.coalesce(F.nullif(part(3), F.lit("")), F.lit("/"))
    return out.when(t.startswith("?"), F.concat(part(1), folder, part(4), t)).otherwise(F.concat(part(1), folder, t))


@F.pandas_udf(StringType())
def _decoded(values: pd.Series) -> pd.Series:
    """Character references decoded; only short attributes come here."""
    return values.map(html.unescape, na_action="ignore")


def _attribute(tag: Column, name: str) -> Column:
    """The first attribute of that name without its quotes, or null."""
    names = F.transform(F.regexp_extract_all(tag, F.lit(_ATTRIBUTE), F.lit(1)), _lower)
    at = F.array_position(names, name).cast("int") - 1
    return F.regexp_replace(F.get(F.regexp_extract_all(tag, F.lit(_ATTRIBUTE), F.lit(2)), at), r"""^["']|["']$""", "")


def alias_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(a, b): a page's node and the nodes that it redirects to or names as canonical."""
    url, page = F.col(url_col).cast("string"), F.col(html_col).cast("string")
    asked = pages.where(url.contains("://") & page.rlike("(?i)canonical|refresh")).select(url.alias("url"), F.regexp_extract_all(F.regexp_replace(page, _NO_MARKUP, " "), F.lit(_TAG), F.lit(0)).alias("tags"))

    def first(element: str, fits, attribute: str) -> Column:
        own = F.filter("tags", lambda t: t.rlike(f"(?i)^<{element}") & F.coalesce(fits(t), F.lit(False)))
        return F.get(F.filter(F.transform(own, lambda t: _attribute(t, attribute)), lambda v: v.isNotNull() & (F.trim(v) != "")), F.lit(0))

    is_canonical = lambda t: _attribute(t, "rel").rlike(r"(?i)(?:^|\s)canonical(?:\s|$)")
    is_refresh = lambda t: _attribute(t, "http-equiv").rlike(r"(?i)^\s*refresh\s*$") & _attribute(t, "content").rlike(r"(?i)url\s*=")
    named = asked.select("url", first("base", lambda t: F.lit(True), "href").alias("base"), first("link", is_canonical, "href").alias("canonical"), first("meta", is_refresh, "content").alias("refresh"))
    named = named.where("canonical IS NOT NULL OR refresh IS NOT NULL").select("url", *[_decoded(c).alias(c) for c in ("base", "canonical", "refresh")])
    moved = F.regexp_replace(F.nullif(F.regexp_extract("refresh", r"""(?is)\burl\s*=\s*(["']?.*)$""", 1), F.lit("")), r"""(?s)^(["'])(.*?)(?:\1.*)?$""", "$2")
    rows = named.select("url", F.coalesce(joined(F.col("url"), F.col("base")), F.col("url")).alias("base"), F.explode(F.array("canonical", moved)).alias("target"))
    return rows.select(node_of(F.col("url")).alias("a"), node_of(joined(F.col("base"), F.col("target"))).alias("b")).where("b IS NOT NULL AND a <> b").distinct()


def judge(pages: DataFrame, rules: list[Rule] = RULES, edges: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, host, path, rule, verdict) of every page; edges (a, b) between nodes, from the pages' html if not given."""
    edges = save(alias_edges(pages, url_col, html_col) if edges is None else edges.select("a", "b"))
    url = F.col(url_col).cast("string")
    own = pages.select(F.col(id_col).alias("id"), host_of(url).alias("host"), path_of(url).alias("path"), node_of(url).alias("node"))
    own = own.withColumn("fit", rule_of(F.col("host"), F.col("path"), rules))
    plain = [F.col("id").alias(id_col), "host", "path", F.col("fit.rule").alias("rule")]
    groups = save(components(edges))
    fit = rule_of(host_of(F.col("node")), path_of(F.col("node")), rules)["verdict"]
    ruled = groups.withColumn("verdict", fit).groupBy("component").agg(F.max((F.col("verdict") == "allow").cast("int")).alias("allow"), F.max((F.col("verdict") == "block").cast("int")).alias("block"))
    blocked = save(ruled.where("block = 1 AND coalesce(allow, 0) = 0").select("component"))
    nodes = save(groups.join(blocked.hint("merge"), "component", "left_semi").select("node", F.lit("block").alias("carried")))
    open_ = own.where("fit IS NULL AND node IS NOT NULL").join(nodes.hint("merge"), "node", "left")
    done = own.where("fit IS NOT NULL OR node IS NULL")
    return done.select(*plain, F.coalesce("fit.verdict", F.lit("allow")).alias("verdict")).unionByName(open_.select(*plain, F.coalesce("carried", F.lit("allow")).alias("verdict")))
