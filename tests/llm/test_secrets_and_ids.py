"""Secret scans of long runs and of names, titles and paths; ids of other integer types."""

import random
import string
import time

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from quarrylight.llm import byte_bpe, secret_scan

SCANNER = secret_scan.Scanner(secret_scan.CLASSES, secret_scan.ALLOW)
WORDS = "get set http response code from server user file path index parser write read spark table column value name title how to and the in more of project main test build data frame join window".split()


@pytest.mark.parametrize("unit", ["ab", "aB", "Ab", "abC", "a1", "A1", "aB1", "-a", "_A1b", "0", "f0", "+/aZ9", "a" * 50 + "-"])
def test_long_runs_take_linear_time(unit):
    for tail in ("", "1b", "-", "!", "A", "12345"):
        run = unit * (10_000 // len(unit)) + tail
        began = time.time()
        SCANNER.spans(f"x {run} y {run}")
        assert time.time() - began < 2


def test_names_titles_and_paths_are_no_secrets():
    for name in ("How-To-Write-A-Parser-In-2024-And-More", "/Users/Bob/Projects/Spark41/MyFile2", "getHTTPResponseCode200FromServer1", "readParquetTableIntoDataFrame2", "org/apache/spark/sql/execution/WholeStageCodegenExec", "MAX_RETRY_COUNT_OF_READ_2"):
        assert SCANNER.spans(name) == [], name
    rng, hits, lines = random.Random(8), 0, 3000
    for _ in range(lines):
        parts = [rng.choice(WORDS) for _ in range(rng.randrange(3, 8))]
        style = rng.randrange(4)
        name = [lambda: parts[0] + "".join(w.title() for w in parts[1:]), lambda: "-".join(w.title() for w in parts), lambda: "/" + "/".join(w.title() + rng.choice(["", "", str(rng.randrange(100))]) for w in parts), lambda: "_".join(w.upper() for w in parts)][style]()
        hits += bool(SCANNER.spans(f"val x = https://a.org/{name}?page=2; call({name})"))
    assert hits <= lines / 1000


@pytest.mark.parametrize(("alphabet", "least"), [(string.ascii_letters + string.digits, 0.94), (string.ascii_lowercase + string.digits, 0.98), ("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 0.94), (string.ascii_letters + string.digits + "+/", 0.94)])
def test_random_strings_are_found(alphabet, least):
    rng = random.Random(5)
    found = sum(bool(SCANNER.spans("x = f(" + "".join(rng.choice(alphabet) for _ in range(20)) + ")")) for _ in range(2000))
    assert found / 2000 >= least


def test_ids_of_other_integer_types(spark):
    bpe = byte_bpe.BPE(byte_bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN)
    for kind in ("int", "smallint", "long"):
        docs = spark.range(2).select(F.col("id").cast(kind).alias("doc_id"), F.lit("some text").alias("text"))
        assert [bytes(r["decoded"]) for r in byte_bpe.encode_and_decode(docs, bpe).collect()] == [b"some text"] * 2
        assert byte_bpe.decode(byte_bpe.encode(docs, bpe), bpe).count() == 2
