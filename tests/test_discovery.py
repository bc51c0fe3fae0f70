"""Dictionaries, completion, trends and filters against brute force."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from quarrylight.operators import discovery
from quarrylight.operators.terms import Terms
from quarrylight.plans.discovery import FIELDS, TREES


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("block_bytes", [8 << 20, 300_000])
def test_a_hundred_thousand_words(spark, block_bytes):
    """All words in all texts, and the first of them; the plan is that of two words."""
    rng = random.Random(1)
    words = sorted({"".join(rng.choice("abcdefgh") for _ in range(rng.randrange(3, 9))) for _ in range(140_000)})[:100_000]
    texts = ["".join(rng.choice("abcdefgh ") for _ in range(rng.randrange(200))) for _ in range(300)] + [None, "", words[70_000], "ABC" + words[5].upper()]
    order = rng.sample(range(len(words)), len(words))
    table = spark.createDataFrame([(w, n, f"L{n}") for w, n in zip(words, order, strict=True)] + [(None, 1, "x"), ("", 2, "x"), (words[0], 10**9, "later")], "word string, ord long, label string")
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    terms = Terms(table, [F.asc("ord"), F.asc("word")], label="label", fold=True, block_bytes=block_bytes)
    assert len(terms.blocks) == (1 if block_bytes > 1 << 20 else 4)
    got = {r["id"]: r for r in docs.select("id", terms.found(F.col("text")).alias("x"), terms.first_label(F.col("text")).alias("first")).collect()}
    place = dict(zip(words, order, strict=True))
    for n, t in enumerate(texts):
        low = (t or "").lower()
        want = sorted({place[low[i:j]] for i in range(len(low)) for j in range(i + 3, min(i + 9, len(low) + 1)) if low[i:j] in place})
        assert [h["label"] for h in got[n]["x"]] == [f"L{p}" for p in want]
        assert got[n]["first"] == (f"L{want[0]}" if want else "")
    if len(terms.blocks) == 1:
        few = Terms(table.limit(2), [F.asc("ord"), F.asc("word")], label="label", fold=True)
        assert len(plan(docs.select(terms.found(F.col("text"))))) < 1.2 * len(plan(docs.select(few.found(F.col("text")))))


def test_lookup_is_first_in_order(spark):
    words = [("widget", 1), ("red widget of steel", 2), ("red", 3), ("red widget", 4), ("ring", 5)]
    names = ["red widget", "red", "blue widget", "ing", "steel", "none", "", None, "a ring of red"]
    for size in (8 << 20, 30):
        terms = Terms(spark.createDataFrame(words, "word string, ord int"), [F.asc("ord")], block_bytes=size)
        got = [r["x"] for r in spark.createDataFrame(list(enumerate(names)), "id int, name string").select("id", terms.lookup(F.col("name")).alias("x")).orderBy("id").collect()]
        assert got == ["red widget", "red", "widget", "ring", "red widget of steel", None, "widget", "widget", "red"]
    empty = Terms(spark.createDataFrame([], "word string, ord int"), [F.asc("ord")])
    assert spark.range(1).select(empty.lookup(F.lit("a")).alias("x"), F.size(empty.found(F.lit("a"))).alias("n"), empty.first_label(F.lit("a")).alias("f")).first() == (None, 0, "")


def test_every_prefix_completes(spark):
    rng = random.Random(2)
    tags = [rng.choice(["Roll", "roll", "roller", "Ring", "ri", "滚动轴承", "滚子", "x"]) + rng.choice(["", "er", "1"]) for _ in range(300)] + [None, "", "未明确"]
    index = discovery.prefix_index(spark.createDataFrame([(t,) for t in tags], "tag string"), "tag", 3).cache()
    good = [t for t in tags if t and t != "未明确"]
    prefixes = {t.lower()[:n] for t in good for n in range(1, len(t) + 1)}
    assert {r["prefix"] for r in index.select("prefix").distinct().collect()} == prefixes
    rows = index.collect()
    for p in prefixes:
        want = sorted(((good.count(t), t) for t in set(good) if t.lower().startswith(p)), key=lambda x: (-x[0], x[1]))[:3]
        assert [(r["n"], r["tag"]) for r in sorted((r for r in rows if r["prefix"] == p), key=lambda r: r["place"])] == want
    assert discovery.complete(index, " ROLLER1 ").collect()[0]["tag"] == "roller1"
    assert discovery.complete(index, "nothing").collect() == []


def test_trends_fill_gaps(spark):
    day = lambda n: datetime.datetime(2024, 1, n, 5)
    rows = [("a", day(2)), ("a", day(2)), ("a", day(5)), ("b", day(3)), (None, day(9)), ("b", None)]
    got = discovery.trend(spark.createDataFrame(rows, "k string, t timestamp"), "t", "k").orderBy("kind", "period").collect()
    assert [(r["kind"], r["period"].day, r["n"], r["total"]) for r in got] == [("a", 2, 2, 2), ("a", 3, 0, 2), ("a", 4, 0, 2), ("a", 5, 1, 3), ("b", 2, 0, 0), ("b", 3, 1, 1), ("b", 4, 0, 1), ("b", 5, 0, 1)]
    months = discovery.trend(spark.createDataFrame([("a", datetime.datetime(2023, 11, 30)), ("a", datetime.datetime(2024, 2, 1))], "k string, t timestamp"), "t", "k", "month")
    assert [r["n"] for r in months.orderBy("period").collect()] == [1, 0, 0, 1]
    assert discovery.trend(spark.createDataFrame([], "k string, t timestamp"), "t", "k").collect() == []


def test_filters_reach_the_scan(spark):
    orders = spark.read.parquet("/root/testdata/sf0.001/orders.parquet").withColumn("tags", F.array("o_orderstatus"))
    wanted = [["Or(GreaterThanOrEqual(o_totalprice,300000.0)", "EqualTo(o_orderstatus,O)"], ["GreaterThan(o_totalprice,400000.0)", "Not(StringStartsWith(o_orderpriority,5))"], ["GreaterThanOrEqual(o_totalprice,200000.0)"], [], ["LessThanOrEqual(o_totalprice,100000.0)", "StringContains(o_orderpriority,URGENT)"]]
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    for (tree, _), parts in zip(TREES, wanted, strict=True):
        pushed = plan(discovery.advanced(orders, tree, FIELDS).select("o_orderkey")).split("PushedFilters: ")[1].split("ReadSchema")[0]
        assert all(p in pushed for p in parts), pushed


@pytest.mark.parametrize("tree", [{"field": "secret", "op": "=", "value": 1}, {"field": "price", "op": "rlike", "value": "x"}, {"xor": []}, {"and": [{"field": "price"}]}, {}])
def test_bad_filters(spark, tree):
    with pytest.raises(ValueError, match="no such filter"):
        discovery.condition(tree, FIELDS)


def test_distribution_counts_companies_once(spark):
    rows = [("c1", "x", 1), ("c1", "x", 1), ("c1", "y", 1), ("c2", "x", 2), ("c2", None, 2)]
    got = discovery.distribution(spark.createDataFrame(rows, "c string, tag string, batch int"), ["tag", "batch"], [["tag"], ["batch"], []], "c").collect()
    assert {(r["level"], r["tag"], r["batch"]): (r["n"], r["companies"]) for r in got} == {("tag", "x", None): (3, 2), ("tag", "y", None): (1, 1), ("tag", None, None): (1, 1), ("batch", None, 1): (3, 1), ("batch", None, 2): (2, 1), ("", None, None): (5, 2)}
