"""Queries of the company graph, each with its SQL: edges are made of the line items, suppliers and parts by relation type."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrylight.operators import graph
from quarrylight.plans.queries import query

# a relation type is the return flag and the line's number; the filter on it is the feature
_EDGES = "SELECT DISTINCT 'S' || l_suppkey AS a, 'P' || l_partkey AS b FROM lineitem WHERE l_returnflag || l_linenumber IN ({})"
_BOTH = "e AS ({0}), g AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e)"


def _graph(li, kinds, **more):
    rows = li.select(F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("subject"), F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("object"), F.concat("l_returnflag", F.col("l_linenumber").cast("string")).alias("rel_type"))
    return graph.Graph(rows, kind="rel_type", kinds=kinds, **more)


_NEAR = """WITH RECURSIVE {}, r(start, node, d) AS (SELECT 'S' || s_suppkey, 'S' || s_suppkey, 0 FROM supplier UNION SELECT r.start, g.b, r.d + 1 FROM r JOIN g ON g.a = r.node WHERE r.d < 3)
    SELECT start, node, CAST(min(d) AS INTEGER) AS distance FROM r GROUP BY start, node HAVING min(d) > 0"""


@query("graph_neighbours", "lineitem,supplier", _NEAR.format(_BOTH.format(_EDGES.format("'A1', 'R2'"))))
def _(li, s):
    """Every supplier's neighbours within three hops, over two relation types."""
    return graph.neighbours(_graph(li, ["A1", "R2"]), s.select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("start")), 3)


_PATH = """WITH RECURSIVE {}, q AS (SELECT 'S' || s_suppkey AS src, 'P' || (s_suppkey * 7 % (SELECT count(*) FROM part)) AS dst FROM supplier),
    r(dst, node, d) AS (SELECT DISTINCT dst, dst, 0 FROM q UNION SELECT r.dst, g.b, r.d + 1 FROM r JOIN g ON g.a = r.node WHERE r.d < 6),
    n AS (SELECT dst, node, min(d) AS d FROM r GROUP BY dst, node),
    p(src, dst, node, path, d) AS (SELECT src, dst, src, [src], d FROM q JOIN n USING (dst) WHERE n.node = q.src
        UNION ALL SELECT src, dst, x, list_append(path, x), d FROM (SELECT p.src, p.dst, p.path, p.d - 1 AS d, min(g.b) AS x FROM p JOIN g ON g.a = p.node JOIN n ON n.dst = p.dst AND n.node = g.b AND n.d = p.d - 1 WHERE p.d > 0 GROUP BY ALL))
    SELECT q.src, q.dst, CAST(len(path) - 1 AS INTEGER) AS length, array_to_string(path, '>') AS path FROM q LEFT JOIN (SELECT * FROM p WHERE d = 0) p ON p.src = q.src AND p.dst = q.dst"""


@query("graph_shortest_path", "lineitem,supplier,part", _PATH.format(_BOTH.format(_EDGES.format("'A1'"))))
def _(li, s, p):
    """The shortest path of every supplier to a part, over one relation type."""
    total = p.agg(F.count("*").alias("n"))
    pairs = s.join(F.broadcast(total), F.lit(True)).select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("src"), F.concat(F.lit("P"), (F.col("s_suppkey") * 7 % F.col("n")).cast("string")).alias("dst"))  # one row
    g = _graph(li, ["A1"])
    return graph.shortest_paths(g, g, pairs).withColumn("path", F.array_join("path", ">"))
