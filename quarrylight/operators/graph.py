"""Neighbourhoods and paths over an edge table, by expanding frontiers as joins.

Edges are read in both directions unless ``directed``. A node with more than SPLIT neighbours is a hub: its neighbours are dealt
into parts of that size, and a frontier row that reaches it goes to each of them, so that no task holds all of a hub's.
Null ends, loops and repeated edges count for nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylight.sources.io import dropped, saved

SPLIT = 1_000
ENTRIES = 1_000_000  # neighbours that a task of the last level holds


class Graph:
    """The edges as ``lists`` of (a, part, n, nexts), each of some SPLIT neighbours at most, saved; (a, b, part) of them; (a, parts) of the hubs."""

    def __init__(self, edges: DataFrame, src: str = "subject", dst: str = "object", kind: str | None = None, kinds: list[str] | None = None, directed: bool = False, split: int = SPLIT) -> None:
        self.directed = directed
        rows = edges.where(F.col(kind).isin(kinds)) if kinds is not None else edges
        there = rows.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
        both = there if directed else there.unionByName(there.select(F.col("b").alias("a"), F.col("a").alias("b")))
        plain = saved(both.distinct())
        parts = F.ceil(F.col("n") / split).cast("int").alias("parts")
        self.hubs = saved(plain.groupBy("a").agg(F.count("*").alias("n")).where(F.col("n") > split).select("a", parts))
        part = F.pmod(F.xxhash64("b"), F.coalesce("parts", F.lit(1))).cast("int").alias("part")
        dealt = plain.join(self.hubs.hint("merge"), "a", "left").select("a", "b", part)
        self.lists = saved(dealt.groupBy("a", "part").agg(F.count("*").cast("int").alias("n"), F.sort_array(F.collect_list("b")).alias("nexts")))
        self.edges = self.lists.select("a", F.explode("nexts").alias("b"), "part")
        self.plain = self.hubs.isEmpty()
        dropped(plain)

    def around(self, frontier: DataFrame, node: str) -> DataFrame:
        """The frontier's rows with each list (n, nexts) of their node's neighbours."""
        if self.plain:  # no node has more than one list
            spread = frontier.withColumn("part", F.lit(0))
        else:
            held = self.hubs.select(F.col("a").alias(node), "parts")
            parts = F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("part")
            spread = frontier.join(held.hint("merge"), node, "left").select(*frontier.columns, parts)
        return spread.join(self.lists.withColumnRenamed("a", node).hint("merge"), [node, "part"]).drop("part")

    def step(self, frontier: DataFrame, node: str) -> DataFrame:
        """The frontier's rows with each neighbour of their node as ``next``."""
        return self.around(frontier, node).select(*frontier.columns, F.explode("nexts").alias("next"))


def neighbours(graph: Graph, starts: DataFrame, hops: int, start: str = "start") -> DataFrame:
    """(start, node, distance): every node within 1 to ``hops`` edges of a start, once, by its least distance.

    A level is what the frontier's edges reach less what was reached before. The last one, mostly the largest, isn't saved: whole lists of
    neighbours meet the levels before by start, and by slices of the nodes where a start has very many, in as many
    partitions as hold ENTRIES each. Null starts go; one without edges has no rows.
    """
    seen = saved(starts.select(F.col(start).alias("start")).where("start IS NOT NULL").distinct().select("start", F.col("start").alias("node"), F.lit(0).alias("distance")))
    frontier, levels = seen, [seen]
    for d in range(1, hops):
        reached = graph.step(frontier.select("start", "node"), "node").select("start", F.col("next").alias("node")).distinct()
        for level in levels if graph.directed else levels[-2:]:  # where edges go both ways, a neighbour is at most one level nearer
            reached = reached.join(level.select("start", "node").hint("merge"), ["start", "node"], "left_anti")
        frontier = saved(reached.withColumn("distance", F.lit(d)))
        levels.append(frontier)
    last = graph.around(frontier.select("start", "node"), "node")
    size = last.groupBy("start").agg(F.sum("n").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("all"), F.coalesce(F.max("n"), F.lit(0)).alias("most")).first()
    slices, tasks = 1 + size["most"] // ENTRIES, 1 + size["all"] // ENTRIES
    of = lambda x: F.pmod(F.xxhash64(x), F.lit(slices)).cast("int")
    if slices == 1:
        far = last.select("start", F.lit(0).alias("slice"), F.lit(hops).alias("distance"), "nexts")
    else:
        cut = lambda k: F.filter("nexts", lambda x: of(x) == k)
        far = last.select("start", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice"), "nexts").select("start", "slice", F.lit(hops).alias("distance"), cut(F.col("slice")).alias("nexts"))
    for level in levels:
        far = far.unionByName(level.select("start", of("node").alias("slice"), "distance", F.array("node").alias("nexts")))
    met = far.repartition(max(tasks, int(graph.lists.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "start", "slice")
    out = met.select("start", "slice", "distance", F.explode("nexts").alias("node")).groupBy("start", "slice", "node").agg(F.min("distance").alias("distance"))
    return out.where("distance > 0").select("start", "node", "distance")


def _grown(graph: Graph, frontier: DataFrame, levels: list[DataFrame], live: DataFrame, path: Column) -> DataFrame:
    """The next level of (pair, node, path) of the live pairs: of each new node the least path."""
    at = graph.step(frontier.join(live.hint("merge"), "pair", "left_semi"), "node")
    new = at.select("pair", F.col("next").alias("node"), path.alias("path")).groupBy("pair", "node").agg(F.min("path").alias("path"))
    for level in levels if graph.directed else levels[-2:]:
        new = new.join(level.select("pair", "node").hint("merge"), ["pair", "node"], "left_anti")
    return saved(new)


def shortest_paths(graph: Graph, back: Graph, pairs: DataFrame, src: str = "src", dst: str = "dst", hops: int = 6) -> DataFrame:
    """(src, dst, length, path) of each distinct pair: of its shortest paths the first by the names along it; nulls without one within ``hops``.

    Searches from both ends, the one with fewer neighbours ahead first, keep the way to each node; a path is found where they meet, and its
    pair is done. Any shortest path of a + b edges has a node a from the one end and b from the other, so only the last levels
    are matched. What the last step reaches is matched without its ways, and not saved. ``back`` is the graph with its edges turned, the same one if they go both ways.
    """
    asked = saved(pairs.select(F.col(src).alias("src"), F.col(dst).alias("dst")).where("src IS NOT NULL AND dst IS NOT NULL").distinct().withColumn("pair", F.monotonically_increasing_id()))
    side = lambda c: saved(asked.where("src <> dst").select("pair", F.col(c).alias("node"), F.array(c).alias("path")))
    ahead = lambda g, frontier: g.around(frontier.select("node"), "node").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    forth, to = [side("src")], [side("dst")]
    found = saved(asked.where("src = dst").select("pair", F.array("src").alias("path")))
    live = asked.where("src <> dst").select("pair")
    sizes = [ahead(graph, forth[0]), ahead(back, to[0])]
    for k in range(1, hops + 1):
        if not min(sizes):
            break
        first = sizes[0] <= sizes[1]
        g, levels, other = (graph, forth, to[-1]) if first else (back, to, forth[-1])
        if k == hops:  # no live pair has a shorter path, so every meeting is on one of its shortest
            near = g.step(levels[-1].select("pair", "node").join(live.hint("merge"), "pair", "left_semi"), "node")
            ends = other.select("pair", F.col("node").alias("next"), F.col("path").alias("rest"))
            meet = near.join(ends.hint("merge"), ["pair", "next"]).join(levels[-1].hint("merge"), ["pair", "node"])
            path = F.concat("path", "rest") if first else F.concat("rest", "path")
        else:
            levels.append(_grown(g, levels[-1], levels, live, F.concat("path", F.array("next")) if first else F.concat(F.array("next"), "path")))
            sizes[0 if first else 1] = ahead(g, levels[-1])
            rest = to[-1].select("pair", "node", F.slice("path", 2, 1 << 30).alias("rest"))
            meet, path = forth[-1].join(rest.hint("merge"), ["pair", "node"]), F.concat("path", "rest")
        met = meet.groupBy("pair").agg(F.min(path).alias("path"))
        before = found
        found = saved(before.unionByName(met.join(before.select("pair").hint("merge"), "pair", "left_anti")))
        live = asked.where("src <> dst").select("pair").join(found.select("pair").hint("merge"), "pair", "left_anti")
        dropped(before)
    all_ = asked.join(found.hint("merge"), "pair", "left")
    return all_.select("src", "dst", (F.size("path") - 1).alias("length"), "path").withColumn("length", F.when(F.col("path").isNotNull(), F.col("length")))
