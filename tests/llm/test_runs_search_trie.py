"""Brute-force versions of the run detection, the hash search and the conversation trie."""

import glob
import hashlib
import os
import random
import re
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrylight.llm import conversation_trie, hash_search, queries, run_detect

SF = "/root/testdata/sf0.001"
WORD = r"[^\x20\x09-\x0D]+"
ODD = [None, "", " \t\n", "one", "a a a a a", "a a a a a a", "b " + "a b " * 9 + "c", "x" * 40_000, "é 中文 " * 20, "A a " * 6, "k " * 5000, " ".join(f"w{i % 700}" for i in range(4000)), "\x00 \x00 \x00 \x00 \x00 \x00 \x00"]


def brute_runs(words, times=4, least=6):
    """All maximal stretches with smallest period q, by trying every period; of equal stretches the smallest period counts."""
    code = np.unique(np.array(words, object), return_inverse=True)[1] if words else np.zeros(0, int)
    found = {}
    for q in range(1, len(words) // times + 1):
        same = np.concatenate([[0], code[:-q] == code[q:], [0]]).astype(int)
        for a, b in zip(np.flatnonzero(np.diff(same) == 1), np.flatnonzero(np.diff(same) == -1), strict=True):
            if (size := b - a + q) >= max(least, times * q) and not any(q % p == 0 and s <= a and a + size <= s + n for (s, n), p in found.items()):
                found[int(a), int(size)] = q
    return sorted((s, n, q) for (s, n), q in found.items())


def collapsed(words, found):
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def again(words, doc_id):
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    g = h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_op11_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = {r["doc_id"]: r for r in queries.op11_periodic_runs(spark, SF).collect()}
    assert len(got) == len(docs)
    several = 0
    for doc_id, text in docs:
        words = again(re.findall(WORD, text or ""), doc_id)
        found = brute_runs(words)
        best = max(found, key=lambda r: (r[1], -r[0], -r[2]), default=None)
        row = got[doc_id]
        assert row["n_runs"] == len(found)
        assert (row["start"], row["length"], row["period"], row["exponent_milli"]) == ((*best, 1000 * best[1] // best[2]) if best else (None,) * 4)
        assert row["runs_sha256"] == sha("".join(f"{s},{n},{q}\n" for s, n, q in found))
        assert row["collapsed_sha256"] == sha(collapsed(words, found))
        several += len(found) > 0
    assert several > 5


def test_runs_of_odd_texts(spark):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(3, "one"), (None, "z " * 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("runs", F.lit("clash")).withColumn("Collapsed", F.lit("clash"))
    got = run_detect.find_runs(docs).collect()
    assert len(got) == len(rows) and set(got[0].asDict()) == {"doc_id", "text", "n_words", "runs", "collapsed"}
    for r in got:
        words = re.findall(WORD, r["text"] or "")
        found = brute_runs(words) if len(words) < 4500 else [(0, 5000, 1)]
        assert ([tuple(x) for x in r["runs"]], r["n_words"], r["collapsed"]) == (found, len(words), collapsed(words, found))
    assert run_detect.digests(run_detect.find_runs(docs.where("false"))).collect() == []


def test_random_runs():
    rng = random.Random(5)
    for _ in range(400):
        docs = []
        for _ in range(rng.randrange(1, 5)):
            n, k = rng.randrange(0, 40), rng.choice([1, 2, 2, 3, 20])
            d = [rng.randrange(k) for _ in range(n)]
            if n and rng.random() < 0.6:
                p, a = rng.randrange(1, 6), rng.randrange(n)
                d = [d[i] if i < a else d[a + (i - a) % min(p, n - a)] for i in range(n)]
            docs.append(d)
        for times, least in ((4, 6), (2, 2), (3, 8)):
            got = run_detect.runs(np.array(sum(docs, []), np.int64), np.cumsum([0] + [len(d) for d in docs]), times, least)
            assert got.tolist() == [[r, *x] for r, d in enumerate(docs) for x in brute_runs(d, times, least)]


def exact(rows, k=20, share=20):
    """(query, ids, scores) over all rows that take part; rows: id to vector."""
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    width = max(len(v) for _, v in good)
    ids, m = np.array([i for i, _ in good]), np.array([np.pad(v, (0, width - len(v))) for _, v in good])
    for q in sorted({i for i in ids.tolist() if i % share == 0}):
        vector = min((v for i, v in good if i == q), key=list)
        score = (m * np.pad(vector, (0, width - len(vector)))).sum(1)
        order = [n for n in np.lexsort((ids, -score)) if ids[n] != q][:k]
        yield q, ids[order].tolist(), score[order].tolist()


def recall(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()]
    vectors = {i: np.array(v, float) for i, v in rows}
    got = defaultdict(list)
    for r in queries.op12_multi_index_hashing(spark, sf).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    hit = all_ = 0
    for q, ids, _ in exact(rows):
        assert [x[0] for x in got[q]] == list(range(1, len(ids) + 1))
        assert [x[1:] for x in got[q]] == sorted([x[1:] for x in got[q]], key=lambda x: (-x[1], x[0]))
        assert all(abs(s - vectors[q] @ vectors[i]) < 1e-12 and i != q for _, i, s in got[q])
        hit, all_ = hit + len({x[1] for x in got[q]} & set(ids)), all_ + len(ids)
    assert all_ == sum(len(v) for v in got.values())
    return hit / all_


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.1"])
def test_op12_recall(spark, sf):
    assert recall(spark, f"/root/testdata/{sf}") >= 0.9


def test_codes_within_radius():
    rng = np.random.default_rng(3)
    codes = rng.integers(0, 1 << 16, (3000, 8), dtype=np.uint16)
    codes[1000:] = codes[0] ^ (1 << rng.integers(0, 16, (2000, 8))).astype(np.uint16) * rng.integers(0, 2, (2000, 8)).astype(np.uint16)
    index = hash_search.Index(codes)
    for radius in (0, 1, 3, 7, 8, 9, 16, 40, 64, 127, 128):
        for n in (0, 5, 1500):
            assert index.within(codes[n], radius).tolist() == np.flatnonzero(hash_search._distance(codes, codes[n]) <= radius).tolist()


def test_search_of_odd_rows_and_shards(spark):
    rng = np.random.default_rng(1)
    rows = [(int(i), rng.normal(size=6).tolist()) for i in range(300)]
    rows += [(400 + i, rows[7][1]) for i in range(50)]  # copies tie
    rows += [(500, None), (500, []), (501, [0.0] * 6), (502, [1.0, None]), (503, [float("nan")] * 6), (504, [float("inf")] * 6), (None, [1.0] * 6), (20, [1.0, 2.0]), (20, [9.0]), (40, rows[40][1]), (9, rows[9][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("v", F.lit("clash")).withColumn("code", F.lit(1))
    one = hash_search.nearest(df, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect()
    assert one == hash_search.nearest(df, F.col("vec_id") % 20 == 0, shard=40, block=4).orderBy("query_id", "rank").collect()
    want = {q: (ids, scores) for q, ids, scores in exact(rows)}
    assert {r["query_id"] for r in one} == set(want)
    hits = sum(r["vec_id"] in want[r["query_id"]][0] for r in one)
    assert len(one) == 20 * len(want) and hits / len(one) >= 0.9
    few = df.where("vec_id IN (20, 40, 41)")
    got = hash_search.nearest(few, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["vec_id"]) for r in got] == [(q, i) for q, ids, _ in exact([x for x in rows if x[0] in (20, 40, 41)]) for i in ids]
    assert hash_search.nearest(df.where("false"), F.col("vec_id") % 20 == 0).collect() == []
    assert hash_search.nearest(df.where("vec_id = 20"), F.col("vec_id") % 20 == 0).collect() == []


def brute_trie(seqs):
    """seqs: conv_id to its turns."""
    members = defaultdict(list)
    for c, s in seqs.items():
        for d in range(len(s) + 1):
            members[s[:d]].append(c)
    kids = defaultdict(int)
    for p in members:
        if p:
            kids[p[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not kids[p]
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1].encode()) if p else 0
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), kids[p], leaves[p], saved[p], sha(",".join(map(str, sorted(c for c in m if seqs[c] == p))))) for p, m in members.items())


COLUMNS = "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256".split()


def as_rows(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=lambda r: (r[0], r[1], str(r)))


def turns(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("ids", F.lit("clash")).withColumn("kind", F.lit("clash"))


@pytest.mark.parametrize("shard", [3, 40, 10_000])
def test_trie_equals_brute_force(spark, shard):
    rng, seqs = random.Random(2), {}
    for c in range(150):
        seqs[c] = tuple((rng.choice(["user", "assistant"]), rng.choice(["é", "a", "b", ""])) for _ in range(rng.randrange(1, 6)))
    seqs |= {c: (("user", "copy"), ("assistant", "of many")) for c in range(200, 320)}  # a group larger than a shard
    seqs[400] = tuple(("user", str(i)) for i in range(300))  # deep
    rows = [(c, i, *t) for c, s in seqs.items() for i, t in enumerate(s)]
    rng.shuffle(rows)
    got = as_rows(conversation_trie.trie(conversation_trie.encode(turns(spark, rows)), shard=shard))
    assert got == sorted(brute_trie(seqs), key=lambda r: (r[0], r[1], str(r)))


def test_trie_of_odd_rows(spark):
    rows = [(1, None, None, None), (1, 0, "user", None), (2, None, "", ""), (2, 0, "user", ""), (None, 0, "user", "gone"), (3, 0, "user", "x" * 100_000), (3, 0, "user", "x" * 100_000), (-4, 1, "user", "neg")]
    seqs = {1: (("", ""), ("user", "")), 2: (("", ""), ("user", "")), 3: (("user", "x" * 100_000),) * 2, -4: (("user", "neg"),)}
    coded = conversation_trie.encode(turns(spark, rows))
    assert as_rows(conversation_trie.trie(coded)) == sorted(brute_trie(seqs), key=lambda r: (r[0], r[1], str(r)))
    assert conversation_trie.trie(conversation_trie.encode(turns(spark, rows).where("false"))).collect() == []
    # 3 takes from the absent group head, -4 from the head of its group
    h = {c: zlib.crc32(str(c).encode()) % 9 for c in seqs}
    want = {c: seqs.get(c - c % 5, ())[: h[c]] + s[h[c] :] for c, s in seqs.items()}
    assert as_rows(conversation_trie.trie(conversation_trie.rebuilt(coded))) == sorted(brute_trie(want), key=lambda r: (r[0], r[1], str(r)))


def test_op13_equals_brute_force(spark):
    seqs = defaultdict(list)
    for r in spark.read.parquet(f"{SF}/conversations.parquet").orderBy("conv_id", F.asc_nulls_first("turn")).collect():
        seqs[r["conv_id"]].append((r["role"] or "", r["text"] or ""))
    h = {c: zlib.crc32(str(c).encode()) % 9 for c in seqs}
    want = {c: tuple(seqs.get(c - c % 5, [])[: h[c]] + s[h[c] :]) for c, s in seqs.items()}
    assert as_rows(queries.op13_conversation_trie(spark, SF)) == sorted(brute_trie(want), key=lambda r: (r[0], r[1], str(r)))


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_agrees_with_sql(spark, name):
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    want = con.sql(queries.ORACLES[name]).to_arrow_table()
    got = queries.QUERIES[name](spark, SF).toArrow()
    assert sorted(got.column_names) == sorted(want.column_names)
    rows = lambda t: sorted(str(list(r.values())) for r in t.select(sorted(t.column_names)).to_pylist())
    assert rows(got) == rows(want)
