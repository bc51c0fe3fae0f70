"""Queries of dictionaries, tag completion, distributions, trends and nested filters, each with its SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from quarrylight.operators import discovery as V
from quarrylight.operators.terms import Terms
from quarrylight.plans.queries import query

_WORDS = "SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]{5,}')) AS word FROM benchmark"


@query("g2_dictionary_tags", "documents,benchmark", f"""WITH w AS (SELECT word, upper(word) AS label, row_number() OVER (ORDER BY length(word), word) AS place FROM ({_WORDS})), h AS (SELECT doc_id, place, label FROM documents JOIN w ON contains(lower(text), word))
    SELECT d.doc_id, count(h.place) AS n, coalesce(string_agg(label, ',' ORDER BY place) FILTER (h.place IS NOT NULL), '') AS labels FROM documents d LEFT JOIN h USING (doc_id) GROUP BY d.doc_id""")
def _(d, b):
    """The words of the benchmark that each document contains, as a dictionary in order of length."""
    words = b.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{5,}"), F.lit(0))).alias("word")).distinct().withColumn("label", F.upper("word"))
    found = Terms(words, [F.length("word").asc(), F.asc("word")], label="label", fold=True).found(F.col("text"))
    return d.select("doc_id", found.alias("x")).select("doc_id", F.size("x").cast("long").alias("n"), F.array_join(F.transform("x", lambda h: h["label"]), ",").alias("labels"))


_NAMES = "SELECT word, row_number() OVER (ORDER BY length(word) DESC, word) AS place FROM (SELECT p_name || ' of ' || p_type AS word FROM part WHERE p_size > 45 UNION SELECT unnest(string_split(p_name, ' ')) FROM part UNION SELECT 'red widget')"


@query("d22_dictionary_lookup", "part", f"""WITH t AS ({_NAMES}), n AS (SELECT DISTINCT p_name FROM part), e AS (SELECT p_name, arg_min(word, place) FILTER (word = p_name) AS exact, arg_min(word, place) AS part FROM n JOIN t ON contains(p_name, word) OR contains(word, p_name) GROUP BY p_name)
    SELECT p_partkey, coalesce(exact, part) AS template FROM part LEFT JOIN e USING (p_name)""")
def _(p):
    """By the equal name, else by the first that contains a part's name or lies in it, long names first; the dictionary's names come from the table."""
    long_ = p.where("p_size > 45").select(F.concat("p_name", F.lit(" of "), "p_type").alias("word"))
    words = long_.union(p.select(F.explode(F.split("p_name", " ")))).union(p.sparkSession.range(1).select(F.lit("red widget"))).distinct()
    return p.select("p_partkey", Terms(words, [F.length("word").desc(), F.asc("word")]).lookup(F.col("p_name")).alias("template"))


_TAGS = "SELECT unnest([p_name, p_type, p_brand] || string_split(p_name, ' ')) AS tag FROM part"


@query("tag_autocomplete", "part", f"""WITH c AS (SELECT tag, count(*) AS n FROM ({_TAGS}) WHERE tag <> '' GROUP BY tag), p AS (SELECT tag, n, lower(tag)[1:size] AS prefix FROM (SELECT *, unnest(range(1, length(tag) + 1)) AS size FROM c))
    SELECT prefix, CAST(row_number() OVER (PARTITION BY prefix ORDER BY n DESC, tag) AS INTEGER) AS place, tag, n FROM p QUALIFY place <= 5""")
def _(p):
    return V.prefix_index(p.select(F.explode(F.concat(F.array("p_name", "p_type", "p_brand"), F.split("p_name", " "))).alias("tag")), "tag", 5)


_RUNS = "SELECT o_custkey, o_orderpriority AS tag, year(o_orderdate) AS batch, n_regionkey AS region FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey"


def _runs(o, c, n):
    rows = o.select("o_custkey", F.col("o_orderpriority").alias("tag"), F.year("o_orderdate").alias("batch"))
    at = c.join(n.hint("merge"), c.c_nationkey == n.n_nationkey).select("c_custkey", F.col("n_regionkey").alias("region"))
    return rows.join(at.hint("merge"), rows.o_custkey == at.c_custkey).drop("c_custkey")


@query("tag_distribution", "orders,customer,nation", f"""SELECT tag, batch, region, concat_ws(',', CASE WHEN grouping(tag) = 0 THEN 'tag' END, CASE WHEN grouping(batch) = 0 THEN 'batch' END, CASE WHEN grouping(region) = 0 THEN 'region' END) AS level, count(*) AS n, count(DISTINCT o_custkey) AS companies
    FROM ({_RUNS}) GROUP BY GROUPING SETS ((tag), (tag, batch), (tag, region), (batch, region), ())""")
def _(o, c, n):
    return V.distribution(_runs(o, c, n), ["tag", "batch", "region"], [["tag"], ["tag", "batch"], ["tag", "region"], ["batch", "region"], []], "o_custkey")


@query("tag_top_n", "orders,customer,nation", f"SELECT region, batch, tag, count(*) AS n, CAST(row_number() OVER (PARTITION BY region, batch ORDER BY count(*) DESC, tag) AS INTEGER) AS place FROM ({_RUNS}) GROUP BY region, batch, tag QUALIFY place <= 3")
def _(o, c, n):
    return V.top_tags(_runs(o, c, n), ["region", "batch"], "tag", 3)


@query("dashboard_trends", "orders", """WITH c AS (SELECT o_orderpriority AS kind, CAST(o_orderdate AS DATE) AS period, count(*) AS n FROM orders GROUP BY ALL), d AS (SELECT DISTINCT kind, CAST(unnest(range((SELECT min(period) FROM c), (SELECT max(period) FROM c) + INTERVAL 1 DAY, INTERVAL 1 DAY)) AS DATE) AS period FROM c)
    SELECT kind, period, coalesce(n, 0) AS n, CAST(sum(coalesce(n, 0)) OVER (PARTITION BY kind ORDER BY period) AS BIGINT) AS total FROM d LEFT JOIN c USING (kind, period)""")
def _(o):
    """Orders by day and priority, days without any too."""
    return V.trend(o, "o_orderdate", "o_orderpriority")


# The five filters and the same conditions in SQL; filters are the feature here.
_F = lambda field, op, value: {"field": field, "op": op, "value": value}
TREES = [
    ({"and": [_F("status", "=", "O"), {"or": [_F("price", ">=", 300000.0), _F("priority", "in", ["1-URGENT", "2-HIGH"])]}]}, "o_orderstatus = 'O' AND (o_totalprice >= 300000 OR o_orderpriority IN ('1-URGENT', '2-HIGH'))"),
    ({"or": [{"and": [_F("price", "between", [1000.0, 50000.0]), _F("status", "!=", "F")]}, {"and": [_F("price", ">", 400000.0), {"not": _F("priority", "starts", "5")}]}]}, "(o_totalprice BETWEEN 1000 AND 50000 AND o_orderstatus <> 'F') OR (o_totalprice > 400000 AND NOT starts_with(o_orderpriority, '5'))"),
    ({"not": {"or": [_F("status", "in", ["O", "P"]), _F("price", "<", 200000.0)]}}, "NOT (o_orderstatus IN ('O', 'P') OR o_totalprice < 200000)"),
    ({"and": [_F("tags", "any", ["P", "5-LOW"]), {"not": _F("tags", "all", ["F", "5-LOW"])}]}, "(o_orderstatus = 'P' OR o_orderpriority = '5-LOW') AND NOT (o_orderstatus = 'F' AND o_orderpriority = '5-LOW')"),
    ({"and": [{"and": []}, {"or": [_F("priority", "contains", "URGENT"), {"or": []}, _F("status", "missing", True)]}, _F("price", "<=", 100000.0)]}, "contains(o_orderpriority, 'URGENT') AND o_totalprice <= 100000"),
]
FIELDS = {"status": "o_orderstatus", "price": "o_totalprice", "priority": "o_orderpriority", "tags": "tags"}


@query("advanced_filter", "orders", " UNION ALL ".join(f"SELECT {n} AS tree, o_orderkey FROM orders WHERE {sql}" for n, (_, sql) in enumerate(TREES)))
def _(o):
    rows = o.withColumn("tags", F.array("o_orderstatus", "o_orderpriority"))
    return reduce(lambda a, b: a.unionByName(b), [V.advanced(rows, tree, FIELDS).select(F.lit(n).alias("tree"), "o_orderkey") for n, (tree, _) in enumerate(TREES)])
