"""Graph searches, whole-table numbers and in-document near lines against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from quarrylight.operators import graph, ordering, records
from quarrylight.sources import io


def edge_rows(spark, pairs):
    return spark.createDataFrame(pairs, "subject string, object string").withColumn("part", F.lit("clash"))


def reach(adj, start):
    d, todo = {start: 0}, [start]
    for x in todo:
        for y in adj.get(x, ()):
            if y not in d:
                d[y] = d[x] + 1
                todo.append(y)
    return d


def adjacency(pairs, directed):
    adj = {}
    for a, b in pairs:
        if a is not None and b is not None and a != b:
            adj.setdefault(a, set()).add(b)
            if not directed:
                adj.setdefault(b, set()).add(a)
    return adj


@pytest.mark.parametrize("directed", [False, True])
def test_neighbours_and_paths(spark, directed):
    rng = random.Random(4)
    pairs = [(f"n{rng.randrange(60)}", f"n{rng.randrange(60)}") for _ in range(90)] + [("hub", f"n{i}") for i in range(0, 60, 2)] + [("lone", "pair"), (None, "n1"), ("n2", None), ("n3", "n3"), ("n4", "n5"), ("n4", "n5")]
    adj, turned = adjacency(pairs, directed), adjacency([(b, a) for a, b in pairs], directed)
    g = graph.Graph(edge_rows(spark, pairs), directed=directed, split=7)
    back = graph.Graph(edge_rows(spark, [(b, a) for a, b in pairs]), directed=True, split=7) if directed else g
    starts = spark.createDataFrame([("n1",), ("hub",), ("lone",), ("absent",), (None,), ("n1",)], "start string")
    for hops in (1, 3):
        got = sorted(map(tuple, graph.neighbours(g, starts, hops).collect()))
        assert got == sorted((s, n, d) for s in ("n1", "hub", "lone", "absent") for n, d in reach(adj, s).items() if 0 < d <= hops)
    asked = [(f"n{rng.randrange(60)}", f"n{rng.randrange(60)}") for _ in range(60)] + [("n1", "n1"), ("lone", "n1"), ("lone", "pair"), ("absent", "n1"), ("absent", "absent"), (None, "n1"), ("lone", "pair")]
    got = {(r["src"], r["dst"]): r for r in graph.shortest_paths(g, back, spark.createDataFrame(asked, "src string, dst string")).collect()}
    assert set(got) == {(a, b) for a, b in asked if a is not None}
    for (a, b), r in got.items():
        far = reach(turned, b)
        if far.get(a, 99) > 6:
            assert r["length"] is None and r["path"] is None
            continue
        path = [a]
        while path[-1] != b:
            path.append(min(x for x in adj[path[-1]] if far.get(x, 99) == far[path[-1]] - 1))
        assert (r["length"], r["path"]) == (len(path) - 1, path)


def test_hub_of_many_edges(spark):
    """100,000 edges at one node: they are dealt into parts, and all are found."""
    edges = spark.range(100_000).select(F.lit("hub").alias("subject"), F.concat(F.lit("n"), F.col("id").cast("string")).alias("object"))
    g = graph.Graph(edges)
    assert g.edges.where("a = 'hub'").groupBy("part").count().agg(F.count("*"), F.max("count") < 1_300).first() == (100, True)
    starts = spark.createDataFrame([("n7",), ("hub",)], "start string")
    assert graph.neighbours(g, starts, 2).groupBy("start", "distance").count().orderBy("start", "distance").collect() == [("hub", 1, 100_000), ("n7", 1, 1), ("n7", 2, 99_999)]
    path = graph.shortest_paths(g, g, spark.createDataFrame([("n5", "n99999")], "src string, dst string")).first()
    assert path["path"] == ["n5", "hub", "n99999"]


def test_ranks_and_numbers(spark):
    rng = random.Random(6)
    rows = [(i, rng.choice([None, "hot", "hot", "hot", "x", "y"]), rng.randrange(20)) for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, k string, v int").repartition(5)
    got = {r["id"]: r["rank"] for r in ordering.ranked(df, [F.desc("v"), F.asc("id")]).collect()}
    assert got == {r[0]: n for n, r in enumerate(sorted(rows, key=lambda r: (-r[2], r[0])), 1)}
    numbered = ordering.numbered(df, ["k"], [F.desc("v"), F.asc("id")])
    want, seen = {}, {}
    for r in sorted(rows, key=lambda r: (-r[2], r[0])):
        want[r[0]] = seen[r[1]] = seen.get(r[1], 0) + 1
    assert {r["id"]: r["n"] for r in numbered.collect()} == want
    assert "Window" not in numbered._jdf.queryExecution().toString() and "SinglePartition" not in ordering.ranked(df, [F.asc("id")])._jdf.queryExecution().toString()
    assert ordering.ranked(df.where("false"), [F.asc("id")]).collect() == [] == ordering.numbered(df.where("false"), ["k"], [F.asc("id")]).collect()


def test_hot_key_is_spread(spark):
    df = spark.range(50_000).select("id", F.lit("hot").alias("k"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # which joins small ranges
    try:
        parts = io.saved(df.repartitionByRange("k", "id").withColumn("p", F.spark_partition_id())).groupBy("p").count()
        assert parts.where("count < 20000").count() >= 3
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert ordering.numbered(df, ["k"], [F.desc("id")]).where(F.col("n") + F.col("id") != 50_000).isEmpty()


def test_lines_kept_apart(spark):
    rng, rows = random.Random(3), []
    for doc in range(3):
        seen = []
        for pos in range(600):
            h = rng.getrandbits(64) if not seen or rng.random() < 0.2 else rng.choice(seen) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64))
            seen.append(h)
            rows.append((doc, pos, h - (1 << 63)))
    want = []
    for doc in range(3):
        kept = []
        for d, pos, h in rows:
            if d == doc and all(((h ^ k) & ((1 << 64) - 1)).bit_count() > 3 for k in kept):
                kept.append(h)
                want.append((d, pos))
    got = records.keep_apart(spark.createDataFrame(rows, "doc long, pos long, simhash long"), "doc")
    assert sorted((r["doc"], r["pos"]) for r in got.collect()) == sorted(want)


def test_lines_of_a_million(spark):
    """One document of 10**6 lines in pairs of near ones: the first of each pair stays."""
    lines = spark.range(1_000_000, numPartitions=8).select(F.lit(1).alias("doc"), F.col("id").alias("pos"), F.xxhash64(F.shiftright("id", 1)).bitwiseXOR(F.col("id") % 2).alias("simhash"))
    got = records.keep_apart(lines, "doc")
    assert got.agg(F.count("*"), F.sum(F.col("pos") % 2)).first() == (500_000, 0)


@pytest.mark.parametrize("entries", [graph.ENTRIES, 40])
def test_last_level_is_shuffled_as_lists(spark, monkeypatch, entries):
    """In slices as well as whole, with and without hubs; no row of a single neighbour is shuffled at the end."""
    monkeypatch.setattr(graph, "ENTRIES", entries)
    rng = random.Random(9)
    pairs = [(f"a{rng.randrange(40)}", f"b{rng.randrange(300)}") for _ in range(900)]
    adj, starts = adjacency(pairs, False), spark.createDataFrame([("a1",), ("b7",)], "start string")
    for split in (7, graph.SPLIT):
        near = graph.neighbours(graph.Graph(edge_rows(spark, pairs), split=split), starts, 3)
        assert sorted(map(tuple, near.collect())) == sorted((s, n, d) for s in ("a1", "b7") for n, d in reach(adj, s).items() if 0 < d <= 3)
        plan = near._jdf.queryExecution().optimizedPlan().toString()
        assert plan.index("Aggregate") < plan.index("Generate explode(nexts") < plan.index("RepartitionByExpression [start") and "Aggregate" not in plan[plan.index("RepartitionByExpression [start"):]


def test_last_step_of_paths_is_not_saved(spark, monkeypatch):
    """Two trees without a path between them: of the levels up to six edges the largest is met, but not kept."""
    rows = []
    monkeypatch.setattr(graph, "saved", lambda df: rows.append((df.columns, n := io.saved(df))) or n)
    edges = [(f"{t}{i // 9}", f"{t}{i}") for t in "xy" for i in range(1, 9 + 81 + 729 + 1)]
    g = graph.Graph(edge_rows(spark, edges))
    assert graph.shortest_paths(g, g, spark.createDataFrame([("x0", "y0"), ("x0", "x700")], "src string, dst string")).select("dst", "length").sort("dst").collect() == [("x700", len(way(700))), ("y0", None)]
    assert sum(n.count() for c, n in rows if c == ["pair", "node", "path"]) < 1_000


def way(i):
    """The nodes above i in a tree of nines."""
    return [i, *way(i // 9)] if i else []
