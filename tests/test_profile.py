import datetime
import glob
import os
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from quarrylight.functions import exprs
from quarrylight.operators import records, serving, tags, text, web
from quarrylight.plans import crawl, discovery, fields, more, network, profile, relations, whole  # noqa: F401
from quarrylight.plans.queries import ORACLES, QUERIES
from quarrylight.sources import io
from quarrylight.streaming import jobs

SF = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, float):
        return f"{v:.6g}"
    return str(v)


def rows_of(table):
    names = sorted(table.column_names)
    return names, sorted(tuple(plain(v) for v in r.values()) for r in table.select(names).to_pylist())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_agrees_with_sql(spark, name):
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    assert rows_of(QUERIES[name](spark, SF).toArrow()) == rows_of(con.sql(ORACLES[name]).to_arrow_table())


def one(spark, value, expr):
    return spark.createDataFrame([(value,)], "x string").select(expr(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(("url", "want"), [("https://www.example.com/page", "example.com"), ("https://example.com/page", "example.com"), ("https://sub.example.com/page", "sub.example.com"), ("", ""), (None, "")])
def test_domain(spark, url, want):
    assert one(spark, url, web.domain) == want


@pytest.mark.parametrize(("url", "bad"), [("https://example.com/page", False), ("https://www.baidu.com/s?wd=test", True), ("ftp://example.com/file", True), ("", True), (None, True)])
def test_blacklist(spark, url, bad):
    assert one(spark, url, lambda c: web.is_blacklisted(c, ["baidu.com", "zhihu.com"])) is bad


def test_html(spark):
    assert one(spark, "<script>alert('xss')</script><p>Content</p>", web.html_text) == "Content"
    assert one(spark, None, web.html_text) == ""
    assert one(spark, "<p>Short paragraph with enough content to pass filter</p>", lambda c: web.html_blocks(c, [("p", 15)])) == "Short paragraph with enough content to pass filter"
    assert one(spark, "<h1>Heading</h1>", web.page_title) == "Heading"


def test_links(spark):
    page = spark.createDataFrame([(1, "https://a.org/x", '<a href="https://b.org/one#f"></a><a data-url="https://c.org/two"></a><a href="//d.org/three"></a><a href="/four"></a><a href="/four#x"></a>')], "page_id int, url string, html string")
    assert [r["link"] for r in web.page_links(page, ["c.org"]).orderBy("pos").collect()] == ["https://b.org/one", "https://d.org/three", "https://a.org/four"]


@pytest.mark.parametrize(
    ("text_", "amount", "unit", "raw"),
    [
        ("金额3,200万元", "3200", "万元", "金额3,200万元"), ("金额1.5亿元", "1.5", "亿元", "1.5亿元"), ("总价25000元", "2.5", "万元", "总价25000元"), ("合计800元", "800", "元", "合计800元"), ("共25000元", "", "", ""),
        ("投资5万元", "", "", ""), ("采购5万元", "5", "万元", "5万元"), ("投资1亿元，中标金额30万元", "30", "万元", "中标金额30万元"), ("没有", "", "", ""), (None, "", "", ""),
    ],
)
def test_amount(spark, text_, amount, unit, raw):
    assert tuple(one(spark, text_, tags.parse_amount)) == (amount, unit, raw, "人民币")


@pytest.mark.parametrize(("text_", "want"), [("2024年3月15日中标", "2024-03-15"), ("2024/3/5", "2024-03-05"), ("2024年3月", "2024-03"), ("2024年3月公告，2024-5-6成交", "2024-05-06"), ("2024-3", ""), ("无", "")])
def test_date(spark, text_, want):
    assert one(spark, text_, tags.parse_date) == want


def test_names_and_terms(spark):
    assert one(spark, "洛阳轴承股份有限公司", tags.short_name) == "洛阳轴承"
    assert one(spark, "直线导轨", lambda c: tags.normalize_terms(c, [("直线导轨", "导轨"), ("导轨", "直线导轨")])) == "直线导轨"
    assert tuple(one(spark, "法定代表人：张三", lambda c: exprs.ordered_extract(c, ["法人代表[:：](..)", "法定代表人[:：](..)"]))) == ("张三", "regex")


def test_simhash_and_near_duplicates(spark):
    docs = spark.createDataFrame([(1, "alpha beta gamma"), (2, "alpha beta gamma"), (3, "delta epsilon zeta eta"), (4, ""), (5, None)], "doc_id long, text string")
    h = {r["doc_id"]: r["simhash"] for r in text.simhash64(docs).collect()}
    assert h[1] == h[2] != h[3] and h[4] == h[5] == 0
    assert text.near_duplicates(text.simhash64(docs)).count() == 0  # copies are one fingerprint
    near = spark.createDataFrame([(1, 7), (2, 6), (3, -1)], "doc_id long, simhash long")
    assert [tuple(r) for r in text.near_duplicates(near).collect()] == [(1, 2)]


def test_upsert_and_append(spark):
    old = spark.createDataFrame([(1, "a", "x"), (2, "b", "x")], "k int, v string, made string")
    new = spark.createDataFrame([(2, "c", "y"), (3, "d", "y")], "k int, v string, made string")
    got = sorted(tuple(r) for r in serving.upsert(old, new, ["k"], ["made"]).collect())
    assert got == [(1, "a", "x"), (2, "c", "x"), (3, "d", "y")]
    assert sorted(r["k"] for r in serving.append_unique(old, new, ["k"]).collect()) == [1, 2, 3]
    again = spark.createDataFrame([(2, "c", "1"), (2, "e", "3"), (2, "d", "2")], "k int, v string, made string")
    assert {r["v"] for r in serving.upsert(old, again, ["k"], order=F.col("made")).where("k = 2").collect()} == {"e"}


def test_seed_rows_and_names(spark, tmp_path):
    lines = ["## 协会", "| 名称 | 网址 |", "|---|---|", "| [轴承网](https://z.org/a) | 说明 |", "| 另一 | https://y.org |", "text"]
    df = spark.createDataFrame([("d", i, x) for i, x in enumerate(lines)], "doc string, seq int, line string")
    assert sorted(tuple(r)[:3] for r in io.seed_rows(df).collect()) == [("协会", "另一", "https://y.org"), ("协会", "轴承网", "https://z.org/a")]
    assert sorted(r["name"] for r in io.read_names(spark, "a, b，c,#d,").collect()) == ["a", "b", "c"]
    (tmp_path / "n.txt").write_text("# c\n a \n\nb\n")
    assert sorted(r["name"] for r in io.read_names(spark, str(tmp_path / "n.txt")).collect()) == ["a", "b"]
    with pytest.raises(ValueError):
        io.checked_name("a; drop")


def test_stream_equals_batch(spark, tmp_path):
    t = datetime.datetime(2024, 1, 1)
    rows = [(t + datetime.timedelta(minutes=7 * i), float(i * 100)) for i in range(60)] + [(t + datetime.timedelta(days=2), 1.0)]
    spark.createDataFrame(rows, "ts timestamp, ms double").coalesce(1).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("ts timestamp, ms double").parquet(str(tmp_path / "in"))
    q = jobs.probe_stats_hourly(source).writeStream.format("memory").queryName("hourly").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination(120)
    batch = jobs.probe_stats_hourly(spark.read.parquet(str(tmp_path / "in"))).where("hour < '2024-01-02'")
    assert sorted(map(tuple, spark.table("hourly").collect())) == sorted(map(tuple, batch.collect()))


@pytest.mark.parametrize(("lines", "kept"), [(["轴承制造企业 产品", "轴承制造企业 产品"], 1), (["公司成立于2015年", "主要生产深沟球轴承"], 2), (["公司成立于2015年", "企业2015年成立"], 2), ([], 0), (["alpha beta", "gamma delta", "alpha beta"], 2)])
def test_near_lines(spark, lines, kept):
    rows = spark.createDataFrame([(1, i, x) for i, x in enumerate(lines)], "doc_id long, pos int, sentence string")
    got = records.near_lines(rows, "doc_id").collect()
    assert len(got) <= kept if "企业2015年成立" in lines else len(got) == kept
    assert all(r["sentence"] == lines[r["pos"]] for r in got)


def test_near_lines_agree_with_a_loop(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("length(text) < 3000")
    lines = text.sentences(docs, r"[.;\n]").where("doc_id IS NOT NULL")
    own = lines.withColumn("id", F.struct("doc_id", "pos"))
    h = {tuple(r["id"]): r["simhash"] & (2**64 - 1) for r in text.simhash64(own.select("id", F.col("sentence").alias("text")), r"[A-Za-z]{2,}|[一-龥]{2,}", "id").collect()}
    want, kept = set(), {}
    for d, p in sorted(h):
        if all((h[d, p] ^ k).bit_count() > 3 for k in kept.setdefault(d, [])):
            kept[d].append(h[d, p])
            want.add((d, p))
    assert want == {(r["doc_id"], r["pos"]) for r in records.near_lines(lines, "doc_id").collect()}


def test_fingerprints_in_bounded_memory(monkeypatch):
    """Texts of many batches against counts; what is remembered doesn't grow with the tokens seen."""
    import hashlib
    import random
    from collections import Counter

    import pandas as pd

    monkeypatch.setattr(text, "KNOWN_TOKENS", 64)
    monkeypatch.setattr(text, "CHUNK", 16)
    rng = random.Random(3)
    texts = [None, "", "a 1 2", "aa aa bb"] + [" ".join("".join(rng.choices("abc", k=rng.randrange(1, 9))) for _ in range(rng.choice([1, 3, 40, 200]))) for _ in range(200)]

    def plain(x):
        count = Counter(re.findall("[A-Za-z]{2,}", x or ""))
        sums = [sum(c if int.from_bytes(hashlib.md5(t.encode()).digest()[8:]) >> i & 1 else -c for t, c in count.items()) for i in range(64)]
        v = sum(1 << i for i in range(64) if count and sums[i] >= 0)
        return v - (1 << 64) if v >> 63 else v

    known = text.Fingerprints("[A-Za-z]{2,}")
    got = [v for i in range(0, len(texts), 50) for v in known.of(pd.Series(texts[i : i + 50], dtype=object)).tolist()]
    assert got == [plain(x) for x in texts] and len(known.place) <= 64 and known.votes.nbytes <= 64 * 64
